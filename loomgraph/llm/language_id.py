"""Language identification with interpolated Kneser-Ney character models of order four.

A symbol is a lower-cased letter or combining mark as its own code point; everything else is one boundary symbol, and
runs of it count once. Grams are counted per language over all labelled training texts, by Spark: what is learned is a
table of grams that grows with the corpus. Texts are packed into blocks of a bounded size; a block asks the table for the
grams that occur in it (and those they back off to), and holds the answers as sorted arrays of 64-bit gram hashes. So no
model passes the driver and no task holds more of one than its own texts need. Tables join on the grams themselves; the
hashes serve within a block only.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.repeats import pieces
from loomgraph.session import materialize

ORDER = 4
UNDECIDED = "und"
#: Share of a language's training texts whose cross-entropy is accepted, within their length class.
ACCEPTED = 0.999
#: Grams that count as evidence for the score; more do not make it surer.
EVIDENCE = 40
#: A length class spans a factor of 2**3 in grams.
CLASS_BITS = 3
#: Bytes of text at which a block is closed.
BLOCK = 16 << 20
#: Distinct grams a counting task holds before it sends them on.
HELD = 1 << 20
BITS = 21  # of a code point; three fill a long
LOW, LOW2 = (1 << BITS) - 1, (1 << 2 * BITS) - 1
#: Shorter grams have a mark in place of the first symbol: -1 to -3 by length, then the empty one and the discounts.
EMPTY, DISCOUNT = -4, -5

_tables: list[np.ndarray] = []


def symbol_tables() -> list[np.ndarray]:
    """Symbol of every code point (0: boundary), and whether it is a letter."""
    if not _tables:
        symbol, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            char = chr(c)
            if char.isalpha():
                symbol[c], letter[c] = ord(char.lower()[0]), True
            elif c > 127 and unicodedata.category(char)[0] == "M":
                symbol[c] = c
        _tables[:] = symbol, letter
    return _tables


def symbols_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of some texts, the range of each text, and whether it has a letter.

    Two boundaries stand before and one behind each text, and runs of boundaries count once."""
    symbol, letter = symbol_tables()
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begins = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]  # offsets in code points
    n = len(offsets) - 1
    letters = np.diff(np.r_[0, np.cumsum(letter[points])][begins]) > 0
    text_of = np.repeat(np.arange(n), np.diff(begins))
    symbols = np.zeros(len(points) + 3 * n, np.uint32)
    symbols[np.arange(len(points)) + 3 * text_of + 2] = symbol[points]
    first = begins + 3 * np.arange(n + 1)
    keep = symbols != 0
    keep[1:] |= symbols[:-1] != 0
    keep[first[:-1]] = keep[first[:-1] + 1] = True
    return symbols[keep], np.r_[0, np.cumsum(keep)][first], letters


def grams_in(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First symbols and the other three of all grams, and the range of each text."""
    s = symbols.astype(np.int64)
    if len(s) < ORDER:
        return s[:0], s[:0], np.zeros(len(at), np.int64)
    head, rest = s[:-3], s[1:-2] << 2 * BITS | s[2:-1] << BITS | s[3:]
    # grams that begin in one text and end in another are left out
    within = np.ones(len(head), bool)
    for back in (1, 2, 3):
        cut = at[1:] - back
        within[cut[(cut >= 0) & (cut < len(head))]] = False
    upto = np.r_[0, np.cumsum(within)]
    return head[within], rest[within], upto[np.minimum(at, len(head))]


def folded(symbols: np.ndarray, at: np.ndarray) -> pa.Array:
    """The texts as their symbols, a space for a boundary; their symbols are the same again."""
    points = np.where(symbols == 0, np.uint32(32), symbols)
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    offsets = np.r_[0, np.cumsum(width)][at].astype(np.int32)
    data = points.tobytes().decode("utf-32-le").encode("utf-8")
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def hashed(head: np.ndarray, rest: np.ndarray) -> np.ndarray:
    x = rest.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ head.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def distinct(head: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different grams, and the place of each given one among them."""
    place, keys = pd.factorize(hashed(head, rest))
    some = np.zeros(len(keys), np.int64)
    some[place] = np.arange(len(place))
    return head[some], rest[some], place


def gram_counts(docs: DataFrame, lang: Column, text: Column) -> DataFrame:
    """``(lang, head, rest, n)`` over all texts with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts):
            head, rest, n = (np.concatenate(p) for p in zip(*parts))
            head, rest, place = distinct(head, rest)
            return head, rest, np.bincount(place, weights=n, minlength=len(head)).astype(np.int64)

        def flush():
            for name, parts in held.items():
                head, rest, n = merged(parts)
                for a in range(0, len(n), 50_000):
                    cut = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(n[cut]), pa.string()), *(pa.array(x[cut]) for x in (head, rest, n))],
                        names=["lang", "head", "rest", "n"],
                    )
            held.clear()

        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, data, offsets in pieces(batch.column(1)):
                symbols, at, _ = symbols_of(data, offsets)
                head, rest, bounds = grams_in(symbols, at)
                own = names[a:b]
                for name in dict.fromkeys(own):
                    mine = np.repeat(np.array([x == name for x in own]), np.diff(bounds))
                    if mine.any():
                        held.setdefault(name, []).append(merged([(head[mine], rest[mine], np.ones(mine.sum(), np.int64))]))
                        size += len(held[name][-1][0])
                if size > HELD:
                    for name, parts in held.items():
                        held[name] = [merged(parts)]
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > HELD // 2:
                        yield from flush()
                        size = 0
        yield from flush()

    src = docs.select(lang.cast("string").alias("lang"), text.cast("string").alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    counted = src.mapInArrow(run, "lang string, head long, rest long, n long")
    return counted.groupBy("lang", "head", "rest").agg(F.sum("n").alias("n"))


def learn(counts: DataFrame) -> DataFrame:
    """``(head, rest, figures)``: the models of all languages as one table, a row per gram with ``(lang, n, total, kinds)``
    of each language that has it.

    ``n`` counts a gram: occurrences if it is of full length, else the different symbols before it. ``total`` and ``kinds``
    belong to the gram as a context: the sum of ``n`` over what follows it, and how many different symbols do.
    """
    head, rest, n = F.col("head"), F.col("rest"), F.col("n")
    before = F.shiftright("rest", BITS)

    def shorter(longer: DataFrame, kept: Column) -> DataFrame:
        return longer.groupBy("lang", kept.alias("rest")).agg(F.count(F.lit(1)).alias("n"))

    four = materialize(counts, "grams")
    three = shorter(four, rest)
    two = shorter(three, rest.bitwiseAND(F.lit(LOW2)))
    one = shorter(two, rest.bitwiseAND(F.lit(LOW)))
    parts = []
    for order, table in ((4, four), (3, three), (2, two), (1, one)):
        mark = F.lit(EMPTY if order == 1 else 1 - order).cast("long")
        context = F.shiftleft(head, 2 * BITS).bitwiseOR(before) if order == 4 else before if order > 1 else F.lit(0)
        context = context.cast("long")
        parts.append(
            table.select(
                "lang", (head if order == 4 else F.lit(-order).cast("long")).alias("head"), "rest",
                n.cast("double").alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("kinds"),
            )
        )
        follow = table.groupBy("lang", context.alias("rest")).agg(
            F.sum(n.cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("kinds")
        )
        parts.append(follow.select("lang", mark.alias("head"), "rest", F.lit(0.0).alias("n"), "total", "kinds"))
        once, twice = F.count_if(n == 1), F.count_if(n == 2)
        discount = F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.5)
        parts.append(
            table.groupBy("lang").agg(discount.alias("n")).select(
                "lang", F.lit(DISCOUNT).cast("long").alias("head"), F.lit(order).cast("long").alias("rest"), "n",
                F.lit(0.0).alias("total"), F.lit(0.0).alias("kinds"),
            )
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.groupBy("lang", "head", "rest").agg(*(F.sum(c).alias(c) for c in ("n", "total", "kinds")))
    figures = F.collect_list(F.struct("lang", "n", "total", "kinds"))
    return materialize(rows.groupBy("head", "rest").agg(figures.alias("figures")), "models")


class Model:
    """What a block needs of one language: sorted gram hashes, each with its count and its figures as a context."""

    def __init__(self, head: np.ndarray, rest: np.ndarray, n: np.ndarray, total: np.ndarray, kinds: np.ndarray):
        keys = hashed(head, rest)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.stack([n, total, kinds])[:, order]

    def look(self, head: np.ndarray | int, rest: np.ndarray) -> np.ndarray:
        """Rows n, total, kinds; zeros for what was never seen."""
        wanted = hashed(np.broadcast_to(np.asarray(head, np.int64), rest.shape), rest)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[:, at], 0.0)

    def log_p(self, head: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each gram after the other three."""
        discount = self.look(DISCOUNT, np.arange(ORDER + 1))[0]
        p = np.full(len(rest), 1 / 0x110000)
        steps = (
            (-1, rest & LOW, EMPTY, np.zeros_like(rest)),
            (-2, rest & LOW2, -1, rest >> BITS & LOW),
            (-3, rest, -2, rest >> BITS),
            (head, rest, -3, head << 2 * BITS | rest >> BITS),
        )
        for order, (mark, gram, before, context) in enumerate(steps, 1):
            n, (_, total, kinds) = self.look(mark, gram)[0], self.look(before, context)
            d = discount[order]
            seen = (np.maximum(n - d, 0) + d * kinds * p) / np.maximum(total, 1)
            p = np.where(total > 0, seen, p)
        return np.log(p)


def needed(head: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every gram and context that scoring some different grams looks up, once each."""
    heads, rests = [head, np.full(5, DISCOUNT)], [rest, np.arange(5)]
    heads[1][0], rests[1][0] = EMPTY, 0
    for mark, wanted in (
        (-1, np.r_[rest & LOW, rest >> BITS & LOW]),
        (-2, np.r_[rest & LOW2, rest >> BITS]),
        (-3, np.r_[rest, head << 2 * BITS | rest >> BITS]),
    ):
        wanted = np.unique(wanted)
        heads.append(np.full(len(wanted), mark))
        rests.append(wanted)
    return np.concatenate(heads).astype(np.int64), np.concatenate(rests).astype(np.int64)


def packed(src: DataFrame) -> DataFrame:
    """Blocks of rows: ``(block, body, grams)``, with the rows compressed, their texts folded to symbols, and the grams
    that scoring them looks up.

    The last column of ``src`` is the text. Block names are unique within one run only, so the result must be written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, size = TaskContext.get().partitionId(), 0, 0
        held: list[pa.RecordBatch] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def block():
            sink = pa.BufferOutputStream()
            options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            head, rest = (np.concatenate(x) for x in zip(*found))
            head, rest = needed(*distinct(head, rest)[:2])
            grams = pa.StructArray.from_arrays([pa.array(head), pa.array(rest)], names=["head", "rest"])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part}-{count}"]),
                    pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(head)], pa.int32()), grams),
                ],
                names=["block", "body", "grams"],
            )

        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b, data, offsets in pieces(texts):
                symbols, at, _ = symbols_of(data, offsets)
                found.append(distinct(*grams_in(symbols, at)[:2])[:2])
                kept = [c.slice(a, b - a) for c in batch.columns[:-1]]
                held.append(pa.RecordBatch.from_arrays([*kept, folded(symbols, at)], names=batch.schema.names))
                size += int(offsets[-1])
                if size >= BLOCK:
                    yield block()
                    count, size = count + 1, 0
                    held.clear()
                    found.clear()
        if held:
            yield block()

    return src.mapInArrow(run, "block string, body binary, grams array<struct<head:long,rest:long>>")


def cross_entropies(docs: DataFrame, model: DataFrame, keep: dict[str, Column], text: Column) -> DataFrame:
    """The columns ``keep`` of every row, the language with the lowest cross-entropy per gram, that value, the share of
    that language among all by likelihood, and the number of grams."""
    src = docs.select(*(c.alias(k) for k, c in keep.items()), text.cast("string").alias("__text"))
    schema = T.StructType(
        [
            *src.schema.fields[:-1],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("cross_entropy", T.DoubleType()),
            T.StructField("n_grams", T.LongType()),
        ]
    )
    names = schema.names

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        head, rest = (right.column(c).to_numpy() for c in ("head", "rest"))
        figures = right.column("figures").combine_chunks()
        gram = np.repeat(np.arange(len(head)), figures.value_lengths().to_numpy(zero_copy_only=False))
        values = figures.flatten()
        names_of = values.field("lang").dictionary_encode()
        langs = sorted(names_of.dictionary.to_pylist())
        of = np.array([langs.index(x) for x in names_of.dictionary.to_pylist()], int)[names_of.indices.to_numpy()]
        rows = [head[gram], rest[gram], *(values.field(c).to_numpy() for c in ("n", "total", "kinds"))]
        models = [Model(*(v[of == k] for v in rows)) for k in range(len(langs))]
        done = []
        for body in left.column("body"):
            for batch in pa.ipc.open_stream(body.as_buffer()):
                for a, b, data, offsets in pieces(batch.column(batch.num_columns - 1)):
                    symbols, at, letters = symbols_of(data, offsets)
                    head, rest, bounds = grams_in(symbols, at)
                    head, rest, place = distinct(head, rest)
                    n = np.where(letters, np.diff(bounds), 0)
                    entropy = np.full((max(len(models), 1), b - a), np.inf)
                    for k, model in enumerate(models):
                        upto = np.r_[0.0, np.cumsum(model.log_p(head, rest)[place])]
                        entropy[k] = -(upto[bounds[1:]] - upto[bounds[:-1]]) / np.maximum(n, 1)
                    best = entropy.argmin(axis=0)
                    least = entropy[best, np.arange(b - a)]
                    sure = (n > 0) & np.isfinite(least)
                    with np.errstate(invalid="ignore"):
                        odds = np.exp(-(entropy - least) * np.minimum(n, EVIDENCE)).sum(axis=0)
                    lang = [langs[k] if s else UNDECIDED for k, s in zip(best.tolist(), sure.tolist())]
                    done.append(
                        pa.RecordBatch.from_arrays(
                            [
                                *(c.slice(a, b - a) for c in batch.columns[:-1]),
                                pa.array(lang, pa.string()),
                                pa.array(np.where(sure, 1 / np.where(sure, odds, 1), 0.0)),
                                pa.array(np.where(sure, least, 0.0)),
                                pa.array(n),
                            ],
                            names=names,
                        )
                    )
        return pa.Table.from_batches(done)

    blocks = materialize(packed(src), "language-blocks")
    wanted = blocks.select(F.col("block").alias("asked"), F.explode("grams").alias("g")).select("asked", "g.head", "g.rest")
    answers = wanted.join(model, ["head", "rest"])
    return blocks.select("block", "body").groupBy("block").cogroup(answers.groupBy("asked")).applyInArrow(score, schema)


def is_held_out(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def language_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", accepted: float = ACCEPTED
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score, cross_entropy, rejected.

    Learns from all rows that are not held out and have a text and a language. ``lang_pred`` is a learned language, or
    ``und`` (score 0) if the text is null or has no letter, or nothing was learned. ``rejected`` marks a text whose
    cross-entropy is above what ``accepted`` of the training texts of that language and of its length class have; a
    class without training texts rejects nothing. A null id counts as an empty one and is not held out.
    """
    held = is_held_out(docs[id_col])
    usable = docs.where(~held)
    model = learn(gram_counts(usable, usable[lang_col], usable[text_col]))
    keep = {"id": docs[id_col], "held_out": held, "lang": docs[lang_col].cast("string")}
    scored = materialize(cross_entropies(docs, model, keep, docs[text_col]), "languages")
    scored = scored.withColumn("length", F.floor(F.log2(F.col("n_grams") + 1) / CLASS_BITS))
    known = scored.where("NOT held_out AND lang = lang_pred AND n_grams > 0")
    limits = known.groupBy("lang_pred", "length").agg(
        F.percentile_approx("cross_entropy", F.lit(float(accepted)), F.lit(10_000)).alias("limit")
    )
    # a dozen rows per language; written out, Spark knows their size and does not shuffle the documents for them
    return scored.join(materialize(limits, "limits"), ["lang_pred", "length"], "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "lang_pred",
        "score",
        "cross_entropy",
        F.coalesce(F.col("cross_entropy") > F.col("limit"), F.lit(False)).alias("rejected"),
    )
