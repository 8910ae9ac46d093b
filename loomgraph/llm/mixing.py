"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source with a target above its size is repeated in complete epochs first; of what is left, documents are taken in the
order of exponential keys -ln(u) / quality until the words run out, the last one in part. Keys lie on a fixed scale of
buckets: the words of (source, bucket) are summed before they meet, and only the one bucket of a source in which its
words run out is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2.0
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"
#: White space and the printable ASCII characters that are no letters.
NO_LETTERS = "".join(map(chr, [*range(9, 14), *range(32, 65), *range(91, 97), *range(123, 127)]))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """Default quality: the share of a text's characters that are ASCII letters or beyond ASCII, at least 0.01."""
    letters = F.length(F.translate(text, NO_LETTERS, ""))
    return F.coalesce(F.greatest(letters / F.greatest(F.length(text), F.lit(1)), F.lit(0.01)), F.lit(0.01))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Sources by code point, null last, have the weights in turn and share ``share`` times all words; none gets more than
    ``most`` times its size, and what is cut off is shared again by weight. In the order of size by weight the sources
    that are cut come first, so one running sum finds the level at which the rest is shared.
    """
    in_turn = F.array(*(F.lit(float(w)) for w in weights))
    rank = F.row_number().over(W.orderBy(F.col("source").cast("binary").asc_nulls_last()))
    sized = sizes.withColumn("weight", F.element_at(in_turn, F.pmod(rank - 1, F.lit(len(weights))).cast("int") + 1))
    order = W.orderBy((F.col("most") / F.col("weight")), F.col("source").cast("binary").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = (
        sized.withColumn("most", F.col("source_size") * F.lit(float(most)))
        .withColumn("all", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("cut", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("turn", F.row_number().over(order))
        .withColumn("level", (F.col("all") - F.col("cut")) / F.col("rest"))
        # the first source that stays below its limit sets the level of all behind it
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
        .withColumn("at", F.min(F.when(F.col("fits"), F.struct(F.col("turn"), F.col("level")))).over(whole))
    )
    level = F.coalesce(F.col("at.level"), F.lit(float("inf")))
    return found.select(
        "source", "source_size", F.least("most", level * F.col("weight")).alias("target")
    )


def take(rows: DataFrame, seed: str = SEED, **targets) -> DataFrame:
    """``rows`` (id, tie, source, size, quality) with source_size, target and the words taken of each.

    A source's rows may be a third of all: its words are summed by bucket, and one bucket of each source is sorted.
    """
    name = F.concat_ws("/", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null")), "tie")
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    keyed = materialize(
        rows.withColumn("key", -F.ln(u) / F.col("quality"))
        # 1 - exp(-key) runs from 0 to 1 with the key, evenly where the quality is 1
        .withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * F.lit(BUCKETS)).cast("int")),
        "mix-keys",
    )
    by_bucket = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = materialize(by_bucket.withColumn("upto", F.sum("words").over(upto)), "mix-buckets")
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    aims = (
        source_targets(sizes, **targets)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    )
    a, s = aims.alias("a"), sums.alias("s")
    place = F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))
    last = (
        a.join(s, F.col("a.source").eqNullSafe(F.col("s.source")), "left")
        .groupBy("a.source", "source_size", "target", "epochs", "rest")
        .agg(F.min(F.when(F.col("upto") > F.col("rest"), place)).alias("last"))
        .select(F.col("source").alias("of"), "source_size", "target", "epochs", "rest", "last.bucket", "last.before")
        .withColumnRenamed("bucket", "last_bucket")
    )
    aimed = keyed.join(materialize(last, "mix-targets"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    whole = F.col("epochs") * F.col("size")
    # no last bucket: the rest is not above what the source has, so all of it is taken
    sure = F.when(F.col("last_bucket").isNull() | (F.col("bucket") < F.col("last_bucket")), F.col("size")).otherwise(0)
    none_left = F.col("rest") <= 0
    rest = aimed.where(~none_left & F.col("bucket").eqNullSafe(F.col("last_bucket")))
    inside = W.partitionBy("source").orderBy("key", "id", "tie", "row").rowsBetween(W.unboundedPreceding, -1)
    parted = rest.withColumn("row", F.monotonically_increasing_id()).withColumn(
        "left", F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    ).withColumn("taken", whole + F.greatest(F.least("size", "left"), F.lit(0)))
    others = aimed.where(none_left | ~F.col("bucket").eqNullSafe(F.col("last_bucket"))).withColumn(
        "taken", whole + F.when(none_left, 0).otherwise(sure)
    )
    cols = [*rows.columns, "source_size", "target", "taken"]
    typed = [F.col(c).cast("long").alias(c) if c == "taken" else F.col(c) for c in cols]
    return others.select(*typed).unionByName(parted.select(*typed))


def _rows(docs: DataFrame, quality: Column | None, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    return docs.select(
        docs[id_col].alias("id"),
        text_tie(text).alias("tie"),
        docs[source_col].cast("string").alias("source"),
        n_words(text).alias("size"),
        (letter_share(text) if quality is None else quality).alias("quality"),
    )


def text_tie(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("\0")))


def mix(
    docs: DataFrame,
    quality: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    **targets,
) -> DataFrame:
    """Digest of the mix: id, size in words, source_size, target of the source, words taken (repeats counted).

    A null text has size 0 and nothing to take; null is a source of its own; repeated rows are drawn each by itself as
    far as their texts differ and one after the other where they do not; an empty table gives no rows. Runs agree.
    """
    rows = _rows(docs, quality, id_col, text_col, source_col)
    return take(rows, **targets).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mixed(
    docs: DataFrame,
    quality: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    **targets,
) -> DataFrame:
    """The mix itself: each row of ``docs`` once per epoch that takes it, all columns as they are.

    A document that is taken in part is in if at least half of its words are; rows without words are left out.
    """
    taken = take(_rows(docs, quality, id_col, text_col, source_col), **targets)
    # equal rows (id, text and source) cannot be told apart, so they share their copies
    copies = (
        taken.withColumn("copies", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0))
        .groupBy(F.col("id").alias("__id"), F.col("tie").alias("__tie"), F.col("source").alias("__source"))
        .agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
        .where("__copies > 0")
    )
    own = docs.withColumn("__own", text_tie(docs[text_col].cast("string")))
    joined = own.join(
        copies,
        own[id_col].eqNullSafe(F.col("__id"))
        & (F.col("__own") == F.col("__tie"))
        & own[source_col].cast("string").eqNullSafe(F.col("__source")),
    )
    turn = W.partitionBy("__id", "__tie", "__source").orderBy(F.lit(1))
    number = F.when(F.col("__rows") > 1, F.row_number().over(turn)).otherwise(F.lit(1))
    more = F.when(number <= F.col("__copies") % F.col("__rows"), 1).otherwise(0)
    each = joined.withColumn("__each", F.floor(F.col("__copies") / F.col("__rows")) + more).where("__each > 0")
    return each.withColumn("__times", F.explode(F.sequence(F.lit(1), F.col("__each").cast("int")))).select(*docs.columns)
