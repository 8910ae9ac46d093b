"""Building blocks that stay balanced when one key holds a large share of all rows.

Three patterns recur in the operators:

* running values inside a key (``prefix_scan``): a plain window would put the whole key
  into one task, so the rows of a key are cut into ordered buckets, the running value is
  computed inside each bucket, and only one summary row per bucket is scanned across;
* row numbers over a whole table or a large stratum (``bucketed_row_number``): the same
  idea with counts;
* joins on a key with a hot value (``salted_join``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET, KEY = "__bucket", "__key"


def scalar(df: DataFrame) -> Column:
    """One-row, one-column frame as a scalar subquery."""
    return df.scalar()


def unnest(df: DataFrame, keep: Sequence, array: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per non-null element of ``array``, positions from 0.

    The outer form plus a filter keeps Spark from evaluating a costly array expression a
    second time in the emptiness filter it infers below a plain ``explode``.
    """
    if pos is None:
        return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).where(F.col(name).isNotNull())


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of the same name in which null equals null; the columns of ``left`` keep their names."""
    names = {c: f"__r_{c}" for c in on}
    other = right.withColumnsRenamed(names)
    condition = None
    for c, r in names.items():
        same = left[c].eqNullSafe(other[r])
        condition = same if condition is None else condition & same
    return left.join(other, condition, how).drop(*names.values())


def in_buckets(df: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """``df`` with its keys and its bucket as two structs, in which a null is a value like any other.

    Windows over both and a plain join on both then deal rows alike, so rows travel once; a null-safe join would deal them again.
    """
    return df.withColumn(BUCKET, F.struct(bucket.alias("b"))).withColumn(KEY, F.struct(*keys) if keys else F.struct(F.lit(0)))


def join_in_place(rows: DataFrame, buckets: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of ``in_buckets`` beside the values of their bucket; rows that a window has dealt stay where they are."""
    return rows.join(buckets, [KEY, BUCKET], how)


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    firsts: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns per key, in ``order``, in two levels.

    ``bucket`` must not decrease along ``order``. ``sums`` are inclusive running sums,
    ``lasts``/``firsts`` the latest/earliest non-null value so far (inclusive), ``lags``
    the previous row's value.
    """
    sums, lasts, firsts, lags = (dict(m or {}) for m in (sums, lasts, firsts, lags))
    src = in_buckets(df, keys, bucket)
    inside = W.partitionBy(KEY, BUCKET).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    at = F.struct(*order)

    local, summary = [], []
    for n, e in sums.items():
        local.append(F.sum(e).over(upto).alias(f"__l_{n}"))
        summary.append(F.sum(e).alias(f"__s_{n}"))
    for n, e in lasts.items():
        local.append(F.last(e, ignorenulls=True).over(upto).alias(f"__l_{n}"))
        summary.append(F.max_by(e, F.when(e.isNotNull(), at)).alias(f"__s_{n}"))
    for n, e in firsts.items():
        local.append(F.first(e, ignorenulls=True).over(upto).alias(f"__l_{n}"))
        summary.append(F.min_by(e, F.when(e.isNotNull(), at)).alias(f"__s_{n}"))
    for n, e in lags.items():
        # wrapped, so that "no previous row" and "previous value is null" differ
        local.append(F.lag(F.struct(e.alias("v"))).over(inside).alias(f"__l_{n}"))
        summary.append(F.max_by(F.struct(e.alias("v")), at).alias(f"__s_{n}"))

    across = W.partitionBy(KEY).orderBy(BUCKET)
    before = across.rowsBetween(W.unboundedPreceding, -1)
    carried = []
    for n in sums:
        carried.append(F.sum(f"__s_{n}").over(before).alias(f"__p_{n}"))
    for n in lasts:
        carried.append(F.last(f"__s_{n}", ignorenulls=True).over(before).alias(f"__p_{n}"))
    for n in firsts:
        carried.append(F.first(f"__s_{n}", ignorenulls=True).over(before).alias(f"__p_{n}"))
    for n in lags:
        carried.append(F.lag(f"__s_{n}").over(across).alias(f"__p_{n}"))

    buckets = src.groupBy(KEY, BUCKET).agg(*summary).select(KEY, BUCKET, *carried)
    joined = join_in_place(src.select("*", *local), buckets, "left")

    out = [F.col(c) for c in df.columns]
    for n in sums:
        total = F.coalesce(F.col(f"__l_{n}"), F.lit(0)) + F.coalesce(F.col(f"__p_{n}"), F.lit(0))
        out.append(total.alias(n))
    for n in lasts:
        out.append(F.coalesce(f"__l_{n}", f"__p_{n}").alias(n))
    for n in firsts:
        out.append(F.coalesce(f"__p_{n}", f"__l_{n}").alias(n))
    for n in lags:
        out.append(F.coalesce(f"__l_{n}", f"__p_{n}").getField("v").alias(n))
    return joined.select(*out)


def bucketed_row_number(
    df: DataFrame,
    bucket: Column,
    order: Sequence,
    name: str,
    partition: Sequence[str] = (),
) -> DataFrame:
    """Exact ``row_number()`` over a table or a large group without one task sorting it all.

    ``bucket`` must not decrease along ``order``; the only rows brought together are one
    count per bucket.
    """
    src = in_buckets(df, partition, bucket)
    across = W.partitionBy(KEY)
    before = across.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        src.groupBy(KEY, BUCKET)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(KEY, BUCKET, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    )
    inside = W.partitionBy(KEY, BUCKET).orderBy(*order)
    placed = src.withColumn("__rn", F.row_number().over(inside))
    return join_in_place(placed, offsets).select(
        *df.columns, (F.col("__rn") + F.col("__off")).cast("long").alias(name)
    )


def hash_row_number(
    df: DataFrame, key: Column, name: str, seed: str = "", partition: Sequence[str] = ()
) -> DataFrame:
    """Row number in the order of ``md5(seed || key)``: a reproducible shuffle.

    The first three hex digits spread the rows evenly over 4,096 buckets.
    """
    src = df.withColumn("__h", F.md5(F.concat(F.lit(seed), key.cast("string"))))
    out = bucketed_row_number(
        src, F.substring("__h", 1, 3), ["__h", key.cast("string")], name, partition
    )
    return out.drop("__h")


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread: Column, how: str = "inner", salts: int = 16
) -> DataFrame:
    """Equi-join whose hot keys are spread over ``salts`` tasks.

    ``big`` rows get a salt from ``spread``; every ``small`` row is repeated once per salt.
    ``how`` may be inner, left, left_semi or left_anti (``big`` on the left).
    """
    left = big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def ordered_concat(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: Column,
    sep: str,
    name: str,
    bucket: Column | None = None,
) -> DataFrame:
    """One string per key from its rows in ``order``; built from partial strings per bucket.

    With ``bucket`` the sort of a long group happens bucket by bucket.
    """
    item = F.struct(*order, text.alias("__t"))

    def glue(col: Column, separator: str) -> Column:
        return F.array_join(F.transform(F.array_sort(col), lambda s: s["__t"]), separator)

    if bucket is None:
        return df.groupBy(*keys).agg(glue(F.collect_list(item), sep).alias(name))
    parts = (
        df.withColumn(BUCKET, bucket)
        .groupBy(*keys, BUCKET)
        .agg(glue(F.collect_list(item), sep).alias("__t"))
    )
    return parts.groupBy(*keys).agg(
        glue(F.collect_list(F.struct(F.col(BUCKET), F.col("__t"))), sep).alias(name)
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark keeps ``k`` rows per key and task before it shuffles."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key in ``order``."""
    return top_k(df, keys, order, 1, "__first").drop("__first")


def break_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, fields: Sequence[str], starts_new, name: str
) -> DataFrame:
    """Number the runs of each key, where a run ends as soon as ``starts_new(prev, cur)`` holds.

    ``prev`` and ``cur`` are structs of ``fields``. Neighbours inside a bucket are compared in
    a window; across buckets only each bucket's first and last row and its number of breaks
    are compared, so no task holds a whole key.
    """
    keys = list(keys)
    row = F.struct(*fields)
    inside = W.partitionBy(*keys, BUCKET).orderBy(*order)
    src = df.withColumn(BUCKET, bucket).withColumn("__cur", row)
    local = src.withColumn("__prev", F.lag("__cur").over(inside)).withColumn(
        "__br", F.when(F.col("__prev").isNotNull() & starts_new(F.col("__prev"), F.col("__cur")), 1).otherwise(0)
    )
    at = F.struct(*order)
    per = local.groupBy(*keys, BUCKET).agg(
        F.min_by("__cur", at).alias("__first"), F.max_by("__cur", at).alias("__last"), F.sum("__br").alias("__n")
    )
    across = W.partitionBy(*keys).orderBy(BUCKET)
    prev = F.lag("__last").over(across)
    heads = per.withColumn("__pl", prev).withColumn(
        "__open", F.when(F.col("__pl").isNull() | starts_new(F.col("__pl"), F.col("__first")), 1).otherwise(0)
    )
    base = F.sum(F.col("__n") + F.col("__open")).over(across.rowsBetween(W.unboundedPreceding, -1))
    heads = heads.select(*keys, BUCKET, (F.coalesce(base, F.lit(0)) + F.col("__open")).alias("__base"))
    running = F.sum("__br").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    return join_null_safe(local.withColumn("__run", running), heads, [*keys, BUCKET]).select(
        *df.columns, (F.col("__base") + F.col("__run")).cast("long").alias(name)
    )
