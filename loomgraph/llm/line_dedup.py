"""Near-duplicate lines by a deletion-neighbourhood join.

A line is its sequence of words. Two lines of at least ``min_words`` words are alike if one word is replaced, added or
left out between them; shorter lines must be equal. Every line gives the hash of itself, and of itself less one word:

* less word i, with i: lines that share it differ at most in word i;
* less any word: equal to a whole line that is one word shorter.

So sharing a key is being alike, and a key's earliest place is all its lines need: no pairs are formed within a key.
Each link is then verified on the words of both lines.

Alike lines share their first or their last half, so only lines with a half that another line has give the shorter forms,
and only keys that two lines give are sent on with their places. Which halves and keys those are is counted in passes of
their own, eight bytes each, and handed on as bitmaps of ``filter_bits`` bits: their size does not depend on the data,
and a wrong bit costs a few more keys, never a link.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.repeats import pieces, text_key, unzipped, zipped
from loomgraph.llm.textarrays import Words, mix, powers, prefix_hash
from loomgraph.session import materialize

MIN_WORDS = 8
FILTER_BITS = 1 << 27
CHUNK = 32768  # bits of one bitmap row, as in bitmap_construct_agg
WHOLE, LONGER, CHANGED = 0, 1, 2
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True


class Lines:
    """Lines with a word of a piece of texts; ``begin`` and ``end`` number their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = Words(data, offsets)
        lines = Words(data, offsets, NEWLINE)
        begin = np.searchsorted(self.words.start, lines.start)
        end = np.searchsorted(self.words.start, lines.end)
        own = end > begin
        self.begin, self.end, self.text = begin[own], end[own], lines.of_text()[own]
        self.n = self.end - self.begin
        # number of the line among all lines of its text
        breaks = np.r_[0, np.cumsum(data == 0x0A)]
        self.number = breaks[lines.start[own]] - breaks[offsets[self.text]]
        self.sums = prefix_hash(self.words.hashes())
        self.inverse = powers(len(self.sums) + 1)[1]

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.inverse[begin])

    def without(self, row: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Hash of a line less one of its words."""
        begin, end, at = self.begin[row], self.end[row], self.begin[row] + word
        rest = (self.sums[at] - self.sums[begin]) + (self.sums[end] - self.sums[at + 1]) * self.inverse[1]
        return mix(rest * self.inverse[begin])

    def halves(self, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the first and last half for a pair whose shorter line has ``length`` words."""
        half, salt = length // 2, mix(length.astype(np.uint64))
        first = self.hash(self.begin, self.begin + half)
        last = self.hash(self.end - half, self.end)
        return mix(first ^ salt), mix(last ^ ~salt)


class Bitmap:
    """Which hashes are in a set, up to chance."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.int64) % np.int64(len(self.bits) * 8)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1) == 1


def _bitmap(keys: DataFrame, filter_bits: int) -> Bitmap:
    """The bitmap of a column ``key`` of longs."""
    bit = F.pmod("key", F.lit(filter_bits))
    rows = (
        keys.select(F.floor(bit / CHUNK).cast("int").alias("chunk"), F.pmod(bit, F.lit(CHUNK)).alias("bit"))
        .groupBy("chunk")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()  # filter_bits / 8 bytes at most
    )
    out = np.zeros(filter_bits // 8, np.uint8)
    for chunk, bits in rows:
        place = chunk * CHUNK // 8
        own = np.frombuffer(bits, np.uint8)[: len(out) - place]
        out[place : place + len(own)] = own
    return Bitmap(out)


def _shared_halves(docs: DataFrame, text_col: str, min_words: int, filter_bits: int) -> Bitmap:
    """Halves that two different lines of one length share, and the complements of halves that a line shares with one
    a word longer."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                lines = Lines(data, offsets)
                own = lines.hash(lines.begin, lines.end)
                for less in (0, 1):
                    length = np.maximum(lines.n - less, 0)
                    long = length >= min_words
                    # the longer line of a pair only has to be there
                    line = own[long].view(np.int64) if not less else np.zeros(int(long.sum()), np.int64)
                    for key in lines.halves(length):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(key[long].view(np.int64)),
                                pa.array(line, mask=np.full(len(line), bool(less))),
                            ],
                            names=["half", "line"],
                        )

    halves = docs.select(docs[text_col].cast("string").alias("t")).mapInArrow(run, "half long, line long")
    met = halves.groupBy("half").agg(
        F.min("line").alias("a"), F.max("line").alias("b"), F.bool_or(F.col("line").isNull()).alias("longer")
    )
    each = F.array(F.when(F.col("a") != F.col("b"), F.col("half")), F.when(F.col("longer"), F.bitwise_not("half")))
    shared = met.where("a IS NOT NULL AND (a <> b OR longer)").select(F.explode(each).alias("key"))
    return _bitmap(shared.where("key IS NOT NULL"), filter_bits)


def _forms(lines: Lines, shared: Bitmap, min_words: int) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], np.ndarray]:
    """(line, key, role) of the shorter forms of lines and, per line, whether it may be alike to another."""
    rows = np.arange(len(lines.n))
    found, close = [], np.zeros(len(rows), bool)
    for less, role in ((0, CHANGED), (1, LONGER)):
        length = np.maximum(lines.n - less, 0)
        halves = lines.halves(length)
        long = length >= min_words
        first, last = (shared(k if role == CHANGED else ~k) & long for k in halves)
        close |= first | last
        if role == CHANGED:  # or the shorter one of a pair
            close |= (shared(~halves[0]) | shared(~halves[1])) & long
        # a shared first half leaves the rest to differ, and the other way round
        low = np.where(last, 0, length // 2)
        high = np.where(first, lines.n, lines.n - length // 2)
        count = np.where(first | last, high - low, 0)
        row = np.repeat(rows, count)
        word = np.arange(len(row)) - np.repeat(np.cumsum(count) - count - low, count)
        key = lines.without(row, word)
        if role == CHANGED:
            key = mix(key + mix(word.astype(np.uint64) + np.uint64(1)))
        found.append((row, key, role))
    return found, close


def _shared_keys(docs: DataFrame, text_col: str, shared: Bitmap, min_words: int, filter_bits: int) -> Bitmap:
    """Keys that two different lines give, and those of whole lines that occur twice."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                lines = Lines(data, offsets)
                forms, _ = _forms(lines, shared, min_words)
                whole = lines.hash(lines.begin, lines.end)
                keys = np.concatenate([whole, *(key for _, key, _ in forms)])
                line = np.concatenate([whole, *(whole[row] for row, _, _ in forms)])
                own = np.arange(len(keys)) < len(whole)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(line.view(np.int64)), pa.array(own)],
                    names=["key", "line", "whole"],
                )

    keys = docs.select(docs[text_col].cast("string").alias("t")).mapInArrow(run, "key long, line long, whole boolean")
    met = keys.groupBy("key").agg(
        F.min("line").alias("a"), F.max("line").alias("b"), F.count_if("whole").alias("n_whole")
    )
    return _bitmap(met.where("a <> b OR n_whole > 1"), filter_bits)


def _keys(keyed: DataFrame, shared: Bitmap, twice: Bitmap, min_words: int) -> DataFrame:
    """(key, role, doc, text_id, line, words) of the keys that two lines give; a line's words come with its whole form."""
    schema = T.StructType(
        [
            T.StructField("key", T.LongType()),
            T.StructField("role", T.ByteType()),
            keyed.schema["doc"],
            keyed.schema["text_id"],
            T.StructField("line", T.IntegerType()),
            T.StructField("words", T.BinaryType()),
        ]
    )

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(2)):
                lines = Lines(data, offsets)
                forms, close = _forms(lines, shared, min_words)
                met = np.zeros(len(close), bool)
                found = []
                for row, key, role in forms:
                    again = twice(key)
                    met[row[again]] = True
                    found.append((row[again], key[again], role))
                whole = lines.hash(lines.begin, lines.end)
                rows = np.flatnonzero(met | twice(whole))
                found.append((rows, whole[rows], WHOLE))
                flat, begin, end = lines.words.joined()
                body = flat.tobytes()
                left, right = begin[lines.begin].tolist(), end[lines.end - 1].tolist()
                for row, key, role in found:
                    text = [body[left[r] : right[r]] if c else None for r, c in zip(row.tolist(), close[row].tolist())]
                    at = pa.array(lines.text[row] + a)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key.view(np.int64)),
                            pa.array(np.full(len(row), role, np.int8)),
                            batch.column(0).take(at),
                            batch.column(1).take(at),
                            pa.array(lines.number[row].astype(np.int32)),
                            pa.array(text if role == WHOLE else [None] * len(row), pa.binary()),
                        ],
                        names=schema.names,
                    )

    return keyed.select("doc", "text_id", "text").mapInArrow(run, schema)


def alike(a: bytes, b: bytes) -> bool:
    """At most one word is replaced, added or left out."""
    x, y = a.split(b" "), b.split(b" ")
    least = min(len(x), len(y))
    if abs(len(x) - len(y)) > 1:
        return False
    p = 0
    while p < least and x[p] == y[p]:
        p += 1
    s = 0
    while s < least - p and x[-1 - s] == y[-1 - s]:
        s += 1
    return max(len(x), len(y)) - p - s <= 1


def _verified(links: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            same = [alike(a, b) for a, b in zip(batch.column("words").to_pylist(), batch.column("like").to_pylist())]
            yield batch.filter(pa.array(same, pa.bool_())).select(["doc", "text_id", "line"])

    return links.select("doc", "text_id", "line", "words", "like").mapInArrow(
        run, links.select("doc", "text_id", "line").schema
    )


def duplicate_lines(
    docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """``(doc, text_id, line)`` of every line with an earlier one that is alike, in the order of id, text digest and
    line. Lines are numbered from 0; ``text_id`` is the digest of the whole text."""
    shared = _shared_halves(docs, text_col, min_words, filter_bits)
    twice = _shared_keys(docs, text_col, shared, min_words, filter_bits)
    text = docs[text_col].cast("string")
    keyed = docs.select(docs[id_col].alias("doc"), text_key(text).alias("text_id"), F.coalesce(text, F.lit("")).alias("text"))
    keys = materialize(_keys(keyed, shared, twice, min_words), "line-keys")
    place = F.struct("doc", "text_id", "line")
    slim = keys.select("key", "role", place.alias("place"))

    def least(role: int):
        return F.min(F.when(F.col("role") == role, F.col("place")))

    groups = slim.groupBy("key").agg(
        least(WHOLE).alias("whole"),
        least(LONGER).alias("longer"),
        least(CHANGED).alias("changed"),
        F.min("place").alias("low"),
        F.max("place").alias("high"),
    )
    groups = groups.where("low < high").select("key", "whole", "longer", "changed")
    met = slim.join(groups, "key")
    equal = met.where((F.col("role") == WHOLE) & (F.col("whole") < F.col("place"))).select("place.*")
    role = F.col("role")
    other = F.when(role == CHANGED, F.col("changed")).when(role == LONGER, F.col("whole")).otherwise(F.col("longer"))
    links = met.withColumn("other", other).where("other < place").groupBy("place").agg(F.min("other").alias("other"))
    lines = keys.where((F.col("role") == WHOLE) & F.col("words").isNotNull())
    lines = lines.select(place.alias("at"), "words").dropDuplicates(["at"])
    mine = links.join(lines, F.col("place").eqNullSafe(F.col("at"))).drop("at")
    theirs = lines.select("at", F.col("words").alias("like"))
    pairs = mine.join(theirs, F.col("other").eqNullSafe(F.col("at"))).select("place.*", "words", "like")
    return equal.union(_verified(pairs)).distinct()


def line_report(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_removed, kept_sha256 (and ``kept_text``: what stays, by ``\\n``).

    A line without a word is never removed. Lines are judged on the input: a line goes if any earlier line is alike,
    whether or not that one stays. Equal rows (id and text) are one place and lose the same lines; a null id comes
    first; a null text has no lines. Other columns are ignored; an empty table gives no rows.
    """
    gone = duplicate_lines(docs, id_col, text_col, min_words, filter_bits)
    per_text = gone.groupBy(F.col("doc").alias("__doc"), F.col("text_id").alias("__id")).agg(
        F.collect_list("line").alias("gone")
    )
    text = docs[text_col].cast("string")
    keyed = docs.select(docs[id_col].alias("doc"), text_key(text).alias("key"), text.alias("text"))
    same = F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("key") == F.col("__id"))
    rows = zipped(keyed).join(per_text, same, "left").select("doc", "text", "gone")
    schema = T.StructType(
        [
            T.StructField(id_col, rows.schema["doc"].dataType),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
            T.StructField("kept_text", T.StringType()),
        ]
    )

    def run(batches):
        for batch in batches:
            total, removed, texts = [], [], []
            for text, lines in zip(unzipped(batch.column(1)).cast(pa.string()).to_pylist(), batch.column(2).to_pylist()):
                own = text.split("\n") if text is not None else []
                drop = set(lines or ())
                total.append(len(own))
                removed.append(len(drop))
                texts.append("\n".join(x for k, x in enumerate(own) if k not in drop))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(total, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                    pa.array(texts, pa.string()),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)
