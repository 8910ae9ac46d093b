"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A SimHash fingerprint within three bits finds all but the closest copies too far apart, so here fingerprints are
compared bit-sliced with a wide radius, inside buckets of two min-hashes: texts in reach share one of 16 such buckets
but for a chance below one in ten million. Rows of a bucket are first joined over their nearest neighbours, so a bucket
sends on fewer links than it has rows, and each link is verified on the whole sets. Rows of a bucket that are then still
in different classes are compared set by set, at any distance. Buckets are cut into blocks that meet pair by pair, so no
task grows with a bucket. Equal texts take part once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.components import connected_components
from loomgraph.llm.repeats import pieces, text_key
from loomgraph.llm.simhash import linked_rows, shingle_hashes
from loomgraph.llm.textarrays import mix
from loomgraph.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BUCKETS = 16
#: Bits of 64; at a similarity of 0.8 about 10 differ, with a deviation of 3.
RADII = (3, 6, 9, 12, 16, 20)
#: Rows of a bucket that are joined over their nearest neighbours in one task.
SPLIT_OVER = 1 << 12
#: Rows a class of a large bucket sends to meet other classes.
SOME = 64
#: Rows and shingles of a block whose sets are compared with another's.
BLOCK = 1 << 10
BLOCK_GRAMS = 1 << 21
#: Cells of a matrix of sets and shingles.
CELLS = 1 << 22


def _as_sets(hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, in order, and their number."""
    text = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=len(count))


def _sketches(keyed: DataFrame, n: int) -> DataFrame:
    """(key, fp, least): fingerprint and min-hashes of every text with a word."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(1)):
                hashes, count = _as_sets(*shingle_hashes(data, offsets, n))
                some = np.flatnonzero(count)
                ends = np.cumsum(count)
                first = (ends - count)[some]
                fp = np.zeros(len(some), np.uint64)
                for bit in range(64):
                    ones = (hashes >> np.uint64(bit) & np.uint64(1)).astype(np.int64)
                    votes = np.add.reduceat(ones, first) if len(some) else first
                    fp |= (2 * votes > count[some]).astype(np.uint64) << np.uint64(bit)
                least = np.empty((len(some), 2 * BUCKETS), np.uint64)
                for k in range(2 * BUCKETS):
                    salted = mix(hashes ^ mix(np.full(1, k + 1, np.uint64)))
                    least[:, k] = np.minimum.reduceat(salted, first) if len(some) else 0
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(some) + 1, dtype=np.int32) * (2 * BUCKETS)),
                    pa.array(least.ravel().view(np.int64)),
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(some + a)), pa.array(fp.view(np.int64)), lists],
                    names=["key", "fp", "least"],
                )

    return keyed.mapInArrow(run, "key binary, fp long, least array<long>")


def _gram_sets(keyed: DataFrame, n: int) -> DataFrame:
    """(key, size, grams): the set of shingles of every text, hashed."""

    def sets(batches):
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(1)):
                hashes, count = shingle_hashes(data, offsets, n)
                ends = np.cumsum(count).tolist()
                own = [np.unique(hashes[e - c : e]).view(np.int64) for e, c in zip(ends, count.tolist())]
                size = np.array([len(x) for x in own], np.int64)
                at = np.r_[0, np.cumsum(size)].astype(np.int32)
                flat = np.concatenate([*own, np.zeros(0, np.int64)])
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(size), lists], names=["key", "size", "grams"]
                )

    return keyed.mapInArrow(sets, "key binary, size long, grams array<long>")


def _verified(grams: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """The links whose texts are as similar as asked for."""

    def compare(batches):
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            same = []
            for k in range(len(batch)):
                x, y = left[k].values.to_numpy(), right[k].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                same.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.filter(pa.array(same, pa.bool_())).select(["a", "b"])

    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = grams.select(F.col("key").alias("a"), F.col("grams").alias("left"))
    right = grams.select(F.col("key").alias("b"), F.col("grams").alias("right"))
    return links.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(compare, "a binary, b binary")


def common(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many members each two of some sets share; set k is ``flat[at[k]:at[k + 1]]``."""
    n = len(at) - 1
    both = np.zeros((n, n))
    row = np.repeat(np.arange(n), np.diff(at))
    _, code, often = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(often > 1) - 1  # members of one set only are left out
    kept = often[code] > 1
    row, code = row[kept], number[code[kept]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    width = max(64, CELLS // max(n, 1))
    total = int(code[-1]) + 1 if len(code) else 0
    for first in range(0, total, width):
        x, y = np.searchsorted(code, [first, first + width])
        some = np.zeros((n, min(width, total - first)), np.float32)
        some[row[x:y], code[x:y] - first] = 1
        both += some @ some.T
    return both


def similar_links(label: np.ndarray, flat: np.ndarray, at: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of similar sets that join the classes ``label`` just as all similar pairs would."""
    both, size = common(flat, at), np.diff(at)
    alike = both >= similarity * (size[:, None] + size[None, :] - both)
    alike &= label[:, None] != label[None, :]
    parent, links = list(range(int(label.max()) + 1)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(alike)))):
        x, y = root(int(label[i])), root(int(label[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            links.append((i, j))
    return links


def _open_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the buckets that hold more than one class, with their ``label``."""
    tagged = rows.join(labels.withColumnRenamed("node", "key"), "key", "left")
    tagged = materialize(tagged.withColumn("label", F.coalesce("label", "key")), "labelled")
    per = tagged.groupBy("band", "bits").agg((F.min("label") < F.max("label")).alias("several"))
    return tagged.join(per.where("several").select("band", "bits"), ["band", "bits"])


def _near_links(rows: DataFrame, grams: DataFrame, similarity: float, split_over: int, turn: int) -> DataFrame:
    """Verified links of nearest neighbours; a bucket (of ``count`` rows) is cut into blocks by chance."""
    block = F.pmod(F.xxhash64("key", F.lit(turn)), F.ceil(F.col("count") / split_over))
    found = linked_rows(rows.withColumn("block", block), ["band", "bits", "block"], "key", RADII)
    return materialize(_verified(grams, found, similarity), "near-links")


def _far_links(rows: DataFrame, grams: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links between the classes ``label`` of a bucket, from comparing the sets of all rows of different classes.

    A bucket is cut into blocks of about ``block`` rows; a large class has blocks of its own, which do not meet.
    """
    where = ["band", "bits"]
    rows = rows.select("key", *where, "label").join(grams.select("key", "size"), "key")

    def parts(n: str, size: str):
        return F.greatest(F.ceil(F.col(n) / block), F.ceil(F.col(size) / BLOCK_GRAMS))

    per = rows.groupBy(*where, "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    per = materialize(per.withColumn("own", parts("n", "total")), "classes-of-buckets")
    rest = per.where("own = 1").groupBy(*where).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    rest = rest.select(*where, parts("n", "total").alias("shared"))
    placed = rows.join(per.select(*where, "label", "own"), [*where, "label"]).join(rest, where, "left")
    alone = F.col("own") > 1
    placed = placed.select(
        "key", *where, "label", F.when(alone, F.col("label")).otherwise(F.lit(b"")).alias("class"),
        F.pmod(F.xxhash64("key"), F.when(alone, F.col("own")).otherwise(F.col("shared"))).alias("part"),
    )
    placed = materialize(placed, "blocks")
    blocks = placed.select(*where, "class", "part").distinct()
    other = blocks.select(*where, F.col("class").alias("class2"), F.col("part").alias("part2"))
    meet = F.expr("(class < class2 OR class = class2 AND part <= part2) AND (class <> class2 OR class = X'')")
    pairs = blocks.join(other, where).where(meet).withColumn("pair", F.xxhash64("class", "part", "class2", "part2"))
    sides = F.explode(F.array(F.struct("class", "part"), F.struct(F.col("class2").alias("class"), F.col("part2").alias("part"))))
    members = pairs.select(*where, "pair", sides.alias("s")).select(*where, "pair", "s.class", "s.part").distinct()
    meeting = placed.join(members, [*where, "class", "part"]).select("key", "label", *where, "pair")
    full = meeting.join(grams.select("key", "grams"), "key").select(*where, "pair", "key", "label", "grams")

    def run(batches):
        def links(table: pa.Table):
            edge = np.zeros(len(table), bool)
            edge[0] = True
            for k in range(3):
                own = table.column(k).to_numpy()
                edge[1:] |= own[1:] != own[:-1]
            ends = [*np.flatnonzero(edge).tolist(), len(table)]
            keys = table.column(3).combine_chunks()
            label = table.column(4).combine_chunks().dictionary_encode().indices.to_numpy()
            sets = table.column(5).combine_chunks()
            at, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
            a, b = [], []
            for x, y in zip(ends, ends[1:]):
                own = at[x : y + 1]
                for i, j in similar_links(label[x:y], flat[own[0] : own[-1]], own - own[0], similarity):
                    a.append(x + i)
                    b.append(x + j)
            picks = [keys.take(pa.array(side, pa.int64())) for side in (a, b)]
            return pa.RecordBatch.from_arrays(picks, names=["a", "b"])

        held = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            # the last group may go on in the next batch
            other = np.zeros(len(held), bool)
            for k in range(3):
                own = held.column(k).to_numpy()
                other |= own != own[-1]
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if cut:
                yield links(held.slice(0, cut).combine_chunks())
                held = held.slice(cut).combine_chunks()
        if held is not None:
            yield links(held.combine_chunks())

    dealt = full.repartition(*where, "pair").sortWithinPartitions(*where, "pair")
    return dealt.mapInArrow(run, "a binary, b binary")


def near_copy_classes(
    docs: DataFrame,
    text_col: str = "text",
    n: int = SHINGLE,
    similarity: float = SIMILARITY,
    split_over: int = SPLIT_OVER,
    block: int = BLOCK,
) -> DataFrame:
    """``(key, label)`` of every text that has a near copy with another key; ``key`` is the digest of the text."""
    text = docs[text_col].cast("string")
    keyed = docs.select(text_key(text).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    sketches = materialize(_sketches(keyed, n), "sketches").dropDuplicates(["key"])
    pairs = [F.xxhash64(F.get("least", F.lit(2 * k)), F.get("least", F.lit(2 * k + 1))) for k in range(BUCKETS)]
    dealt = sketches.select("key", "fp", F.posexplode(F.array(*pairs)).alias("band", "bits"))
    size = materialize(dealt.groupBy("band", "bits").count().where("count > 1"), "buckets")
    shared = materialize(dealt.join(size, ["band", "bits"]), "shared-buckets")
    one = keyed.join(shared.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    grams = materialize(_gram_sets(one, n), "gram-sets")

    links = _near_links(shared, grams, similarity, split_over, 0)
    labels = connected_components(links)
    # the classes of a large bucket's blocks meet by some rows of each, until few are left
    rows, turn, last = shared.where(F.col("count") > split_over), 0, None
    while not rows.isEmpty():
        turn += 1
        opened = _open_rows(rows.drop("count", "label"), labels)
        per = opened.groupBy("band", "bits", "label").agg(F.count(F.lit(1)).alias("n"))
        some = F.pmod(F.xxhash64("key", F.lit(-turn)), F.ceil(F.col("n") / SOME)) == 0
        some = materialize(opened.join(per, ["band", "bits", "label"]).where(some).drop("n", "label"), "some-rows")
        rows = materialize(some.join(some.groupBy("band", "bits").count(), ["band", "bits"]), "some-rows")
        size = rows.count()
        if not size or last is not None and 2 * size > last:
            break
        last = size
        links = links.union(_near_links(rows, grams, similarity, split_over, turn))
        labels = connected_components(links)
        rows = rows.where(F.col("count") > split_over)

    # what is still apart is compared in full, so that no near pair is lost to a nearer one that failed
    far = materialize(_far_links(_open_rows(shared, labels), grams, similarity, block), "far-links")
    if far.isEmpty():
        return labels.withColumnRenamed("node", "key")
    return connected_components(links.union(far)).withColumnRenamed("node", "key")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` less near copies: of each class the row with the smallest (id, text digest) stays.

    Equal texts are one class, empty and null ones too. A null id counts as the largest; of wholly equal rows one
    stays. All columns are returned as they are.
    """
    key = text_key(docs[text_col].cast("string"))
    rows = docs.select(docs[id_col].alias("id"), key.alias("key"))
    classes = near_copy_classes(docs, text_col, **options)
    labelled = rows.join(classes, "key", "left").withColumn("label", F.coalesce("label", "key"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    firsts = labelled.groupBy("label").agg(best.alias("first"))
    chosen = materialize(firsts.select(F.col("first.id").alias("__id"), F.col("first.key").alias("__key")), "chosen")
    own = docs.withColumn("__own", key)
    kept = own.join(chosen, own[id_col].eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")))
    is_chosen = F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))
    twice = rows.groupBy("id", "key").count().where("count > 1").join(chosen, is_chosen, "left_semi")
    if not twice.isEmpty():
        kept = kept.dropDuplicates(["__id", "__key"])
    return kept.select(*docs.columns)
