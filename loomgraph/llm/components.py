"""Connected components of an edge table, by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` for every node of ``edges``; the label is the smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then the label of that label, so chains shorten by
    half or better. Rounds are written to the shared folder; no node's neighbours are ever gathered in one row. Rows
    with a null end link nothing; an empty table gives no rows.
    """
    src = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = materialize(src.union(src.select("v", "u")).distinct(), "links")
    labels = materialize(
        both.groupBy("u").agg(F.min("v").alias("least")).select(
            F.col("u").alias("node"), F.least("u", "least").alias("label")
        ),
        "labels",
    )
    while True:
        seen = labels.select(F.col("node").alias("v"), F.col("label").alias("there"))
        best = both.join(seen, "v").groupBy("u").agg(F.min("there").alias("best"))
        near = labels.join(best.withColumnRenamed("u", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "best").alias("near")
        )
        far = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        step = materialize(
            near.join(far, "near").select("node", F.least("near", "far").alias("label"), "old"), "labels"
        )
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels


def no_rows(spark: SparkSession, **types: str) -> DataFrame:
    """An empty table with these columns."""
    return spark.range(0).select(*(F.lit(None).cast(t).alias(c) for c, t in types.items()))
