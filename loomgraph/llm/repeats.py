"""Windows of units (words or bytes) that start more than once in a corpus.

Equal windows have the same minimiser, the smallest hash among their grams of ``gram`` units, at the same place. So the
windows of a text fall into runs that share one minimiser, its anchor:

1. every text gives its runs as (anchor, first window, windows), a few bytes per run;
2. anchors are counted; runs with an anchor of their own hold nothing that repeats and go no further;
3. the other runs travel, each as one packed string, to the bucket of their anchor, where windows are compared;
4. windows found twice go back to their texts.

Equal texts take part once, with their number, and in a bucket so do equal strings. Strings of an anchor that are too
many to be compared at once are dealt again by another minimiser of their windows (``dealt_again``), as often as it
takes. An anchor with more than ``hot`` runs (a passage in a large share of all texts) is not brought into one task at
all: its windows are counted by digest, with partial sums before the shuffle. Texts are shuffled once, compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.textarrays import Words, mix, prefix_hash, repeated, slices, text_bytes, windows
from loomgraph.session import materialize

PIECE = 1 << 20
#: Runs of one anchor from which on its windows are counted outside its bucket: a few hundred bytes each at most.
HOT = 500_000
#: Bytes of packed strings that a task compares at once; the runs of one anchor stay together.
AT_ONCE = 2 << 20
#: How often strings are dealt again. Each time, windows without a partner leave and the rest is cut.
DEALS = 6
PLACE_BITS = np.uint64(21)


class ByteUnits:
    """A piece of texts as bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.first, self.n = data, offsets, len(data)

    def sums(self) -> np.ndarray:
        return prefix_hash(self.data + np.uint64(1))

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(self.n + 1)
        return self.data, at[:-1], at[1:]


class WordUnits:
    """A piece of texts as words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = Words(data, offsets)
        self.first, self.n = self.words.first, len(self.words.start)

    def sums(self) -> np.ndarray:
        return prefix_hash(self.words.hashes())

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.words.joined()


@dataclass(frozen=True)
class Plan:
    """What a window is, and how the windows of a bucket are compared.

    ``again(packed, offsets, windows, copies)`` gets the packed strings of some whole anchors and tells which of their
    windows, in turn, occur twice or more.
    """

    units: type
    window: int
    gram: int
    again: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    hot: int = HOT
    at_once: int = AT_ONCE


def text_key(text: Column) -> Column:
    # the outer default never applies; it tells Spark that keys are not null, which spares a filter
    return F.coalesce(F.unhex(F.md5(F.coalesce(text, F.lit("")))), F.lit(b""))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, from minima inside blocks towards either side."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def runs_of(units, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first window counted from the text's start, windows) of every run of a piece."""
    grams = windows(units.sums(), plan.gram)
    width = plan.window - plan.gram + 1
    text_of = np.repeat(np.arange(len(units.first) - 1), np.diff(units.first))
    step = (1 << int(PLACE_BITS)) - plan.window
    parts = []
    # places have a fixed number of bits, so a longer text is taken in overlapping stretches
    for a in range(0, max(units.n - plan.window + 1, 0), step):
        own = grams[a : a + step + width - 1]
        keys = (own & ~((np.uint64(1) << PLACE_BITS) - np.uint64(1))) | np.arange(len(own), dtype=np.uint64)
        least = sliding_least(keys, width)
        place = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64) + a
        begin = np.arange(a, a + len(place))
        inside = text_of[begin] == text_of[begin + plan.window - 1]
        begin, place = begin[inside], place[inside]
        if not len(begin):
            continue
        text = text_of[begin]
        new = np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])]
        at = np.flatnonzero(new)
        parts.append((text[at], grams[place[at]], begin[at] - units.first[text[at]], np.diff(np.r_[at, len(begin)])))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts))


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(column)
    for a, b in slices(offsets, PIECE):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def zipped(keyed: DataFrame) -> DataFrame:
    """The rows with their text compressed, for the shuffle."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = [None if t is None else squeeze(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.binary())], names=["doc", "key", "text"])

    schema = T.StructType([*keyed.schema.fields[:2], T.StructField("text", T.BinaryType())])
    return keyed.select("doc", "key", "text").mapInArrow(run, schema)


def unzipped(column: pa.Array) -> pa.Array:
    restore = zstandard.ZstdDecompressor().decompress
    return pa.array([None if t is None else restore(t) for t in column.to_pylist()], pa.binary())


def _runs(keyed: DataFrame, plan: Plan) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(1)):
                text, anchor, start, n = runs_of(plan.units(data, offsets), plan)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(text)),
                        pa.array(anchor.view(np.int64)),
                        pa.array(start.astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    names=["key", "anchor", "start", "n"],
                )

    return keyed.select("key", "text").mapInArrow(run, "key binary, anchor long, start int, n int")


def _packed(texts: DataFrame, plan: Plan, single: bool) -> DataFrame:
    """The runs of ``texts`` (key, copies, runs, text) as packed strings, or each of their windows by itself.

    Equal strings of a piece of texts are one row, with the places (key, start) that hold them.
    """

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in pieces(unzipped(batch.column(3))):
                units = plan.units(data, offsets)
                flat, begin, end = units.packed()
                lists = batch.column(2).slice(a, b - a)
                count = np.diff(lists.offsets.to_numpy())
                runs = lists.flatten()
                text = np.repeat(np.arange(b - a), count)
                start, n, anchor = (runs.field(k).to_numpy() for k in ("start", "n", "anchor"))
                if single:
                    text, anchor = np.repeat(text, n), np.repeat(anchor, n)
                    start = np.repeat(start, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    n = np.ones(len(start), np.int32)
                first = units.first[text] + start
                left, right = begin[first], end[first + n + plan.window - 2]
                body = flat.tobytes()
                keys, copies = (batch.column(k).slice(a, b - a) for k in (0, 1))
                # a line repeated in a text gives one string over and over, and so does a passage that texts share
                turn = np.argsort(anchor, kind="stable")
                for x in range(0, len(turn), 20_000):
                    own = turn[x : x + 20_000]
                    strings = pa.array(
                        [body[y:z] for y, z in zip(left[own].tolist(), right[own].tolist())], pa.binary()
                    ).dictionary_encode()
                    # equal strings have one anchor and as many windows
                    which = strings.indices.to_numpy()
                    order = np.argsort(which, kind="stable")
                    held = own[order]
                    bounds = np.searchsorted(which[order], np.arange(len(strings.dictionary) + 1))
                    some = held[bounds[:-1]]
                    weight = np.bincount(which, weights=copies.to_numpy()[text[own]])
                    holders = pa.StructArray.from_arrays(
                        [keys.take(pa.array(text[held])), pa.array(start[held].astype(np.int32))], ["key", "start"]
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), holders),
                            pa.array(weight.astype(np.int64)),
                            pa.array(anchor[some]),
                            pa.array(n[some].astype(np.int32)),
                            strings.dictionary,
                        ],
                        names=["holders", "copies", "anchor", "n", "packed"],
                    )

    return texts.select("key", "copies", "runs", "text").mapInArrow(
        run, "holders array<struct<key: binary, start: int>>, copies long, anchor long, n int, packed binary"
    )


def dealt_again(
    data: np.ndarray, offsets: np.ndarray, n: np.ndarray, copies: np.ndarray, plan: Plan, at_once: int, deal: int = 1
) -> np.ndarray:
    """What ``plan.again`` tells of the strings, in parts of about ``at_once`` bytes.

    A window whose hash no other window has occurs once in each copy of its string. The others are cut into runs that
    share a minimiser under a hash function of this deal; equal windows get into the same part, and equal runs are
    compared once. What one minimiser holds beyond ``at_once`` is dealt again.
    """
    if len(data) <= at_once or deal > DEALS:
        return plan.again(data, offsets, n, copies)
    hashes, least = [], []
    for a, b in slices(offsets, PIECE):
        units = plan.units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        sums, own = units.sums(), n[a:b]
        at = np.repeat(units.first[:-1] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        hashes.append(windows(sums, plan.window)[at])
        grams = mix(windows(sums, plan.gram) + np.uint64(deal))
        least.append(sliding_least(grams, plan.window - plan.gram + 1)[at])
    shared, least = repeated(np.concatenate(hashes)), np.concatenate(least)
    row = np.repeat(np.arange(len(n)), n)
    new = np.r_[True, (row[1:] != row[:-1]) | (least[1:] != least[:-1]) | ~shared[:-1]]
    head = np.flatnonzero(new & shared)
    if not len(head):
        return copies[row] > 1
    run = np.cumsum(new & shared) - 1
    count = np.bincount(run[shared], minlength=len(head))
    begins = np.cumsum(n) - n
    first = head - begins[row[head]]  # counted from the start of its string
    # the runs as strings of their own
    strings, number = [], 0
    for a, b in slices(offsets, PIECE):
        units = plan.units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        flat, begin, end = units.packed()
        body, upto = flat.tobytes(), int(np.searchsorted(row[head], b))
        own = slice(number, upto)
        place = units.first[row[head[own]] - a] + first[own]
        left, right = begin[place].tolist(), end[place + count[own] + plan.window - 2].tolist()
        strings.append(pa.array([body[x:y] for x, y in zip(left, right)], pa.binary()).dictionary_encode())
        number = upto
    runs = pa.chunked_array(strings).unify_dictionaries().combine_chunks()
    used, where, which = np.unique(runs.indices.to_numpy(), return_index=True, return_inverse=True)
    which, different = which.ravel(), runs.dictionary.take(pa.array(used))
    weight, anchor, n_own = np.bincount(which, weights=copies[row[head]]), least[head[where]], count[where]
    turn = np.argsort(anchor, kind="stable")
    size = np.cumsum(pc.binary_length(different).to_numpy()[turn])
    edges = np.r_[np.flatnonzero(np.diff(anchor[turn])) + 1, len(turn)]
    twice = [np.zeros(0, bool)] * len(turn)
    a, base = 0, 0
    for e, following in zip(edges, [*edges[1:], None]):
        if following is None or size[following - 1] - base > at_once:
            part = turn[a:e]
            body, bounds = text_bytes(different.take(pa.array(part)))
            found = dealt_again(body, bounds, n_own[part], weight[part], plan, at_once, deal + 1)
            for k, own in zip(part.tolist(), np.split(found, np.cumsum(n_own[part])[:-1])):
                twice[k] = own
            a, base = int(e), int(size[e - 1])
    out = copies[row] > 1
    begin = np.cumsum(n_own) - n_own
    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    out[shared] = np.concatenate(twice)[begin[which][np.repeat(np.arange(len(head)), count)] + inside]
    return out


def _compared(packed: DataFrame, plan: Plan) -> DataFrame:
    """(key, begin, end) of stretches of windows that occur again, from all runs of each anchor."""

    def found(table: pa.Table) -> pa.RecordBatch:
        n = table.column("n").to_numpy()
        # equal strings once, with the number of their texts; they have the same windows
        packed = table.column("packed").unify_dictionaries().combine_chunks()
        used, first, which = np.unique(packed.indices.to_numpy(), return_index=True, return_inverse=True)
        which, different = which.ravel(), packed.dictionary.take(pa.array(used))
        copies = np.bincount(which, weights=table.column("copies").to_numpy())
        # an anchor whose strings all occur twice is settled, and so is one with a single string: no window of a run
        # equals another of the same run, since both would have the anchor at one place
        _, of = np.unique(table.column("anchor").to_numpy()[first], return_inverse=True)
        lone = np.bincount(of, weights=copies == 1)[of] > 0
        open_ = np.flatnonzero(lone & (np.bincount(of)[of] > 1))
        count = n[first]
        twice = np.repeat(copies > 1, count)
        if len(open_):
            data, offsets = text_bytes(different.take(pa.array(open_)))
            own = np.repeat(np.isin(np.arange(len(first)), open_), count)
            twice[own] = dealt_again(data, offsets, count[open_], copies[open_], plan, plan.at_once)
        begin = np.cumsum(count) - count
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        again = twice[np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(len(row))]
        row, place = row[again], place[again]
        edge = np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)] if len(row) else np.zeros(0, bool)
        at = np.flatnonzero(edge)
        last = np.r_[at[1:], len(row)] - 1 if len(at) else at
        # each stretch for all places that hold its string
        holders = table.column("holders").combine_chunks()
        bounds = holders.offsets.to_numpy()
        count = np.diff(bounds)[row[at]]
        stretch = np.repeat(np.arange(len(at)), count)
        held = np.arange(len(stretch)) + np.repeat(bounds[:-1][row[at]] - bounds[0] - (np.cumsum(count) - count), count)
        places = holders.flatten()
        start = places.field("start").to_numpy()[held]
        return pa.RecordBatch.from_arrays(
            [
                places.field("key").take(pa.array(held)),
                pa.array((start + place[at][stretch]).astype(np.int32)),
                pa.array((start + place[last][stretch] + 1).astype(np.int32)),
            ],
            names=["key", "begin", "end"],
        )

    def run(batches):
        held, size, limit = [], 0, plan.at_once
        for batch in batches:
            # a passage that many texts share is held once
            held.append(batch.set_column(4, "packed", batch.column(4).dictionary_encode()))
            size += held[-1].nbytes
            if size >= limit:
                table = pa.Table.from_batches(held).unify_dictionaries().combine_chunks()
                anchor = table.column("anchor").to_numpy()
                # the last anchor may go on in the next batch
                cut = int(np.searchsorted(anchor, anchor[-1], "left"))
                if not cut:
                    held, size, limit = table.to_batches(), table.nbytes, 2 * table.nbytes
                    continue
                for part in _cut(table.slice(0, cut), anchor[:cut], plan.at_once):
                    yield found(part)
                plain = table.slice(cut).column("packed").cast(pa.binary()).combine_chunks()
                rest = table.slice(cut).set_column(4, "packed", plain.dictionary_encode())
                held, size, limit = rest.to_batches(), rest.nbytes, plan.at_once
        if held:
            table = pa.Table.from_batches(held).unify_dictionaries().combine_chunks()
            for part in _cut(table, table.column("anchor").to_numpy(), plan.at_once):
                yield found(part)

    return (
        packed.select("holders", "copies", "anchor", "n", "packed")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(run, "key binary, begin int, end int")
    )


def _cut(table: pa.Table, anchor: np.ndarray, at_once: int) -> Iterator[pa.Table]:
    """Whole anchors of about ``at_once`` bytes at a time."""
    if not len(anchor):
        return
    packed = table.column("packed").combine_chunks()
    length = np.cumsum(pc.binary_length(packed.dictionary).to_numpy()[packed.indices.to_numpy()])
    edges = np.r_[np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor)]
    a, base = 0, 0
    for e, following in zip(edges, [*edges[1:], None]):
        if following is None or length[following - 1] - base > at_once:
            yield table.slice(a, e - a)
            a, base = int(e), int(length[e - 1])


def _counted(single: DataFrame) -> DataFrame:
    """The same from windows by themselves: a count per digest, with partial sums before the shuffle."""
    each = single.select("holders", "copies", F.unhex(F.md5("packed")).alias("window"))
    twice = each.groupBy("window").agg(F.sum("copies").alias("n")).where("n > 1").select("window")
    places = each.join(twice, "window").select(F.inline("holders"))
    return places.select("key", F.col("start").alias("begin"), (F.col("start") + 1).alias("end"))


def repeated_stretches(docs: DataFrame, id_col: str, text_col: str, plan: Plan) -> DataFrame:
    """Rows ``(doc, key, text, copies, stretches)``, one per row of ``docs``; ``text`` is for ``unzipped``.

    ``stretches`` lists (begin, end) ranges of windows that start elsewhere too, null if there are none. They are left
    out for a text that occurs as a whole more than once (``copies``): all its windows repeat.
    """
    text = docs[text_col].cast("string")
    keyed = docs.select(docs[id_col].alias("doc"), text_key(text).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    runs = materialize(_runs(keyed, plan), "runs")
    anchors = runs.groupBy("anchor").agg(F.count("*").alias("n_runs")).where("n_runs > 1")
    anchors = materialize(anchors.select("anchor", (F.col("n_runs") > plan.hot).alias("hot")), "anchors")
    copies = materialize(
        keyed.groupBy("key").agg(F.min("doc").alias("of"), F.count("*").alias("copies")), "copies"
    )
    shared = runs.join(anchors, "anchor")
    dense = zipped(keyed)

    def packed(rows: DataFrame, single: bool) -> DataFrame:
        per_text = rows.groupBy("key").agg(F.collect_set(F.struct("start", "n", "anchor")).alias("runs"))
        per_text = per_text.join(copies, "key")
        # of equal texts the one with the smallest id takes part; two inequalities, since an equality would be taken for
        # a join key and the texts shuffled once more
        first = (F.col("doc") <= F.col("of")) & (F.col("doc") >= F.col("of")) | F.col("doc").isNull() & F.col("of").isNull()
        texts = dense.join(per_text, "key").where(first)
        return _packed(texts, plan, single)

    found = _compared(packed(shared.where("NOT hot"), False), plan)
    if not anchors.where("hot").isEmpty():
        found = found.unionByName(_counted(packed(shared.where("hot"), True)))
    stretches = found.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("stretches"))
    own = copies.select("key", "copies").join(stretches, "key", "left").where("copies > 1 OR stretches IS NOT NULL")
    own = own.withColumn("stretches", F.when(F.col("copies") == 1, F.col("stretches")))
    return dense.join(own, "key", "left")


def removed(units, stretches: pa.ListArray, copies: np.ndarray, window: int) -> np.ndarray:
    """Which units of a piece lie in a repeated window."""
    step = np.zeros(units.n + 1, np.int64)
    lists = stretches.fill_null([]) if stretches.null_count else stretches
    count = np.diff(lists.offsets.to_numpy())
    text = np.repeat(np.arange(len(lists)), count)
    flat = lists.flatten()
    begin, end = flat.field("begin").to_numpy(), flat.field("end").to_numpy()
    np.add.at(step, units.first[text] + begin, 1)
    np.subtract.at(step, units.first[text] + end + window - 1, 1)
    whole = np.flatnonzero((copies > 1) & (np.diff(units.first) >= window))
    np.add.at(step, units.first[whole], 1)
    np.subtract.at(step, units.first[whole + 1], 1)
    return np.cumsum(step[:-1]) > 0
