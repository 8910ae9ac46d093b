"""Shards from a hierarchical weighted hash tree.

A key descends from the root to a region, a rack and a shard. At each level every child draws ln(u) / weight, where u
in (0, 1) is a hash of the key and the child's name, and the largest draw wins: a child gets keys in proportion to its
weight (the sum of what is below it), and a changed weight moves keys only into or out of the subtree that changed.
Everything is column expressions; the only shuffles are of one narrow row per document, for the places in a shard.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hex digits of an MD5 that cut a shard into parts numbered separately: only 4,096 counts of it meet in one window.
DIGITS = 3


@dataclass(frozen=True)
class Node:
    """A region, a rack, or (with a ``shard`` number) a shard of the tree."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    def shards(self) -> list[Node]:
        return [s for c in self.children for s in c.shards()] if self.children else [self]


def tree(layout: Sequence[Sequence[Sequence[float]]]) -> Node:
    """The tree of regions of racks of shard weights; shards are numbered from 0 in that order."""
    number, regions = 0, []
    for r, racks in enumerate(layout):
        nodes = []
        for k, weights in enumerate(racks):
            shards = tuple(Node(f"s{number + i}", (), number + i, float(w)) for i, w in enumerate(weights))
            number += len(shards)
            nodes.append(Node(f"r{r}k{k}", shards))
        regions.append(Node(f"r{r}", tuple(nodes)))
    return Node("", tuple(regions))


def grown(root: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own: no draw between older nodes changes, so keys move only
    into the new shard."""
    number, r = len(root.shards()), len(root.children)
    rack = Node(f"r{r}k0", (Node(f"s{number}", (), number, weight),))
    return Node("", (*root.children, Node(f"r{r}", (rack,))))


def draw(key: Column, node: Node) -> Column:
    """ln(u) / weight with u from the first 13 hex digits of an MD5."""
    digits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/" + node.name))), 1, 13), 16, 10).cast("double")
    return F.ln((digits + 0.5) / float(1 << 52)) / F.lit(node.weight)


def shard_of(key: Column, node: Node) -> Column:
    """The number of the shard to which the key descends."""
    if not node.children:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if len(live) == 1:
        return shard_of(key, live[0])
    draws = [F.struct(draw(key, c).alias("d"), F.lit(i).alias("child")) for i, c in enumerate(live)]
    picked = F.array_max(F.array(*draws))["child"]
    out = F.when(picked == 0, shard_of(key, live[0]))
    for i, child in enumerate(live[1:], 1):
        out = out.when(picked == i, shard_of(key, child))
    return out


DEFAULT = tree([[[1, 1], [1, 1]], [[1, 1], [1, 1]]])


def numbered(df: DataFrame, group: str, order: Sequence[str], name: str, digits: int = DIGITS) -> DataFrame:
    """Gapless numbers from 0 inside each group, in the order of hash buckets and of ``order`` inside them.

    Only counts of (group, bucket) meet in one window per group.
    """
    key = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order))
    cut = df.withColumn("__bucket", F.substring(F.md5(key), 1, digits))
    upto = W.partitionBy(group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    start = (
        cut.groupBy(group, "__bucket")
        .agg(F.count("*").alias("__n"))
        .select(group, "__bucket", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__start"))
    )
    inside = W.partitionBy(group, "__bucket").orderBy(*order)
    return (
        cut.withColumn("__place", F.row_number().over(inside).cast("long"))
        .join(start, [group, "__bucket"])
        .withColumn(name, F.col("__start") + F.col("__place") - 1)
        .drop("__bucket", "__place", "__start", "__n")
    )


def place(docs: DataFrame, root: Node = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of the law ``key``: id and tree decide the shard, and a tree grown by one shard takes rows into it only.

    One row per row of ``docs``: id, size (UTF-8 bytes + 1), CRC-32 of the text, law, shard, slot and the shard in the
    grown tree. A null text has size 1 and the CRC of no bytes; a null id is a key of its own; rows with equal ids
    share a shard and get slots of their own; an empty table gives no rows.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    key = F.coalesce(docs[id_col].cast("string"), F.lit("null"))
    rows = docs.select(
        docs[id_col].alias(id_col),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, root).cast("int").alias("shard"),
        shard_of(key, grown(root)).cast("int").alias("grown_shard"),
    )
    return numbered(rows, "shard", [id_col, "text_crc32"], "slot").select(
        id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def with_shards(docs: DataFrame, root: Node = DEFAULT, id_col: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` with their ``shard``; a column of that name is replaced. No shuffle."""
    key = F.coalesce(docs[id_col].cast("string"), F.lit("null"))
    return docs.withColumn("shard", shard_of(key, root).cast("int"))
