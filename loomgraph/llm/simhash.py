"""SimHash near-duplicates, compared bit-sliced.

Fingerprints that differ in at most ``radius`` bits agree in at least two of ``radius + 2`` bit blocks, so each distinct
fingerprint is sent to one bucket per pair of blocks. A bucket's fingerprints are stored as 64 bit planes; the distances
of all rows to the row ``lag`` places further on are counted together, one machine word for 64 rows, in a carry-save
counter per bit of the distance, and blocks of rows leave the count once each of them exceeds the radius. A bucket sends
on one link per joined fingerprint, never its pairs. A bucket above ``split_over`` rows is dealt again by the blocks of
its remaining bits, which again lose no pair, and so on until it is small or ``FREE_BITS`` bits are left, which no more
than 2 ** ``FREE_BITS`` distinct fingerprints can share.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.components import connected_components
from loomgraph.llm.textarrays import LOWER, Words, slices, text_bytes
from loomgraph.session import materialize

PIECE = 1 << 20
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Rows of a bucket from which on it is dealt again by its remaining bits.
SPLIT_OVER = 1 << 14
FREE_BITS = 14
#: Rows that are compared at once in a task (a larger bucket is taken whole).
AT_ONCE = 1 << 16


# ---------------------------------------------------------------------------------------------- fingerprints


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every n-word shingle of some texts and, per text, the number of its shingles."""
    words = Words(LOWER[data], offsets)
    size = words.end - words.start
    flat, begins, ends = words.joined()  # a shingle is a slice of it
    count = np.where(words.count >= n, words.count - n + 1, np.minimum(words.count, 1))
    span = np.minimum(words.count, n)
    first = np.arange(int(count.sum())) + np.repeat(words.first[:-1] - (np.cumsum(count) - count), count)
    last = first + np.repeat(span, count) - 1
    body, digest = flat.tobytes(), xxhash.xxh64_intdigest
    begin, end = begins[first].tolist(), ends[last].tolist()
    found = np.fromiter((digest(body[a:b], SEED) for a, b in zip(begin, end)), np.uint64, len(begin))
    return found, count


def fingerprints(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """A bit is set if it is set in more than half of a text's shingle hashes; no shingle: zero."""
    hashes, count = shingle_hashes(data, offsets, n)
    ends = np.cumsum(count)
    out = np.zeros(len(count), np.uint64)
    for bit in range(64):
        run = np.zeros(len(hashes) + 1, np.int64)
        np.cumsum((hashes >> np.uint64(bit)) & np.uint64(1), out=run[1:])
        votes = run[ends] - run[ends - count]
        out |= (2 * votes > count).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprint_column(column: pa.Array, n: int = SHINGLE) -> np.ndarray:
    data, offsets = text_bytes(column)
    parts = [
        fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
        for a, b in slices(offsets, PIECE)
    ]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def fingerprint_rows(docs: DataFrame, keep: dict[str, Column], text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` of every row and its fingerprint ``fp`` (the 64 bits as a long)."""
    src = docs.select(*(c.alias(k) for k, c in keep.items()), docs[text_col].cast("string").alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("fp", T.LongType())])
    names = schema.names

    def run(batches):
        for batch in batches:
            found = fingerprint_column(batch.column(batch.num_columns - 1), n).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=names)

    return src.mapInArrow(run, schema)


# ---------------------------------------------------------------------------------------------- comparison


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Bit b of all values as one row of machine words (row b); one spare word at the end."""
    words = (len(values) + 63) // 64 + 1
    bits = np.zeros((64, words * 64), np.uint8)
    bits[:, : len(values)] = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def close_at(planes: np.ndarray, wanted: np.ndarray, lag: int, radius: int) -> np.ndarray:
    """Rows r, among those set in ``wanted``, whose distance to row r + lag is at most ``radius``."""
    place = np.flatnonzero(wanted)  # words with a row still of interest
    live = wanted[place]
    digits = radius.bit_length()
    # the counters start so high that the step above the radius leaves their last digit
    start = (1 << digits) - 1 - radius
    counts = np.stack([np.full(len(place), -(start >> k & 1), np.int64).view(np.uint64) for k in range(digits)])
    whole, part = divmod(lag, 64)
    end = planes.shape[1] - 1  # a spare word of zeros
    for first in range(0, 64, 8):
        some = planes[first : first + 8]
        differ = some[:, np.minimum(place + whole, end)]
        if part:
            after = some[:, np.minimum(place + whole + 1, end)]
            differ = (differ >> np.uint64(part)) | (after << np.uint64(64 - part))
        differ ^= some[:, place]
        for carry in differ:
            for digit in counts:
                both = digit & carry
                digit ^= carry
                carry = both
            live &= ~carry
        on = live != 0
        if not on.all():
            place, live, counts = place[on], live[on], counts[:, on]
            if not len(place):
                return np.zeros(0, np.int64)
    bits = np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(bits)
    return place[word] * 64 + bit


def joined(group: np.ndarray, values: np.ndarray, radii: tuple[int, ...] = (RADIUS,)) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by group: links that join the rows of a group just as all pairs in reach would.

    Links within the first radius are taken first, and so on, so rows are joined over the nearest ones.
    """
    n = len(values)
    parent = np.arange(n)
    links: list[tuple[int, int]] = []
    size = np.bincount(group, minlength=1)
    for radius in radii:
        rows, lag, upto = _open_rows(np.flatnonzero(size[group] > 1), group, parent), 1, 1
        while len(rows):
            sub = group[rows]
            planes = bit_planes(values[rows])
            most = int(size[sub].max())
            while lag < min(upto + 1, most):
                same = np.zeros(planes.shape[1] * 64, np.uint8)
                if lag < len(sub):
                    same[: len(sub) - lag] = sub[lag:] == sub[:-lag]
                found = close_at(planes, np.packbits(same, bitorder="little").view(np.uint64), lag, radius)
                a, b = rows[found], rows[found + lag]
                apart = np.flatnonzero(parent[a] != parent[b])
                if len(apart):
                    for x, y in zip(a[apart].tolist(), b[apart].tolist()):
                        if _unite(parent, x, y):
                            links.append((x, y))
                    _flatten(parent)
                lag += 1
            # go on with the groups that have rows further apart and are not one set yet
            rows = _open_rows(rows[size[sub] > lag], group, parent)
            upto = 2 * upto
    found = np.array(links, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _open_rows(rows: np.ndarray, group: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The given rows less the groups that are one set already."""
    if not len(rows):
        return rows
    own, root = group[rows], parent[rows]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    one = np.minimum.reduceat(root, first) == np.maximum.reduceat(root, first)
    return rows[~np.repeat(one, np.diff(np.r_[first, len(rows)]))]


def _unite(parent: np.ndarray, x: int, y: int) -> bool:
    while parent[x] != x:
        x = parent[x]
    while parent[y] != y:
        y = parent[y]
    parent[max(x, y)] = min(x, y)
    return x != y


def _flatten(parent: np.ndarray) -> None:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return
        parent[:] = up


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(np.array(bits), n)]


def _mask(bits) -> int:
    value = sum(1 << int(b) for b in bits)
    return value - (1 << 64) if value >> 63 else value


def bucket_masks(radius: int) -> list[int]:
    """Masks of two of ``radius + 2`` bit blocks each; any two fingerprints in reach agree under one of them."""
    blocks = _blocks(list(range(64)), radius + 2)
    return [_mask(a + b) for a, b in combinations(blocks, 2)]


def finer_masks(mask: int, radius: int) -> list[int]:
    """The bits of a mask with one of ``radius + 1`` blocks of the others; rows in reach agree under one of them."""
    own = [b for b in range(64) if mask >> b & 1]
    rest = [b for b in range(64) if not mask >> b & 1]
    return [_mask(own + block) for block in _blocks(rest, radius + 1)]


def _dealt(fps: DataFrame, masks: list[int]) -> DataFrame:
    """One row per fingerprint and mask: (mask, masked bits, fingerprint)."""
    keys = [F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for m in masks]
    return fps.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.mask", "k.bits", "fp")


def _dealt_again(rows: DataFrame, radius: int) -> DataFrame:
    """The rows once for each finer mask of their mask."""

    def run(batches):
        for batch in batches:
            mask, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for own in np.unique(mask).tolist():
                some = fp[mask == own]
                for finer in finer_masks(own, radius):
                    columns = [np.full(len(some), finer), some & np.int64(finer), some]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["mask", "bits", "fp"])

    return rows.select("mask", "fp").mapInArrow(run, "mask long, bits long, fp long").distinct()


def linked_rows(dealt: DataFrame, keys: list[str], node: str, radii: tuple[int, ...]) -> DataFrame:
    """Links ``(a, b)`` of nodes with close fingerprints ``fp`` among the rows that agree on ``keys`` (integers)."""
    width = len(keys)
    kind = dealt.schema[node].dataType

    def run(batches):
        def links(table: pa.Table) -> pa.RecordBatch:
            own = [table.column(k).to_numpy() for k in range(width)]
            edge = np.zeros(len(table), bool)
            for key in own:
                edge[1:] |= key[1:] != key[:-1]
            fp = table.column(width).to_numpy().astype(np.int64).view(np.uint64)
            a, b = joined(np.cumsum(edge), fp, radii)
            nodes = table.column(width + 1).combine_chunks()
            return pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b))], names=["a", "b"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= AT_ONCE:
                # the last bucket may go on in the next batch
                table = pa.Table.from_batches(held)
                other = np.zeros(size, bool)
                for k in range(width):
                    key = table.column(k).to_numpy()
                    other |= key != key[-1]
                cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
                if cut:
                    yield links(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                size -= cut
        if size:
            yield links(pa.Table.from_batches(held))

    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    rows = dealt.select(*keys, "fp", F.col(node).alias("__node"))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, schema)


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, split_over: int = SPLIT_OVER) -> DataFrame:
    """Links ``(a, b)`` that join distinct fingerprints ``fp`` in the same way as all pairs in reach would."""
    dealt, links = _dealt(fps, bucket_masks(radius)), None
    fixed = 64 - max(FREE_BITS, radius + 1)
    while True:
        large = dealt.groupBy("mask", "bits").count().where(F.col("count") > split_over)
        large = large.where(F.bit_count("mask") < fixed).select("mask", "bits")
        large = materialize(large, "large-buckets")
        last = large.isEmpty()
        usual = dealt if last else dealt.join(large, ["mask", "bits"], "left_anti")
        found = linked_rows(usual, ["mask", "bits"], "fp", (radius,))
        links = found if links is None else links.union(found)
        if last:
            return links
        dealt = materialize(_dealt_again(dealt.join(large, ["mask", "bits"]), radius), "dealt-again")


def fingerprint_classes(rows: DataFrame, radius: int = RADIUS, split_over: int = SPLIT_OVER) -> DataFrame:
    """``(fp, label)`` of every distinct fingerprint of ``rows``; linked ones share the smallest of them as label."""
    fps = materialize(rows.select("fp").distinct(), "fingerprints")
    found = connected_components(fingerprint_links(fps, radius, split_over))
    return fps.join(found, fps.fp == found.node, "left").select("fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs``.

    Texts with fewer words than a shingle have one shingle; without words (or null) the fingerprint is zero and is
    linked like any other. ``component_id`` is the smallest non-null id that can be reached, null if there is none.
    Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    rows = materialize(fingerprint_rows(docs, {"doc_id": docs[id_col]}, text_col), "fingerprint-rows")
    classes = fingerprint_classes(rows, radius)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    known = classes.join(least, "fp")
    per_label = known.groupBy("label").agg(F.min("least").alias("component_id"))
    per_fp = known.join(per_label, "label").select("fp", "component_id")
    return rows.join(per_fp, "fp").select(
        F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
