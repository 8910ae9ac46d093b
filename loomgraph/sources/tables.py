"""Relational inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table stored as parquet; filters and columns are pushed to the scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_jdbc(
    spark: SparkSession, url: str, table: str, split_column: str, lower: int, upper: int, parts: int, **options
) -> DataFrame:
    """One database table read in ``parts`` parallel ranges of a numeric column."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=split_column,
            lowerBound=lower,
            upperBound=upper,
            numPartitions=parts,
            **options,
        )
        .load()
    )


def read_spread(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """A table whose rows are costly to process, spread over all cores.

    A small file arrives in one or two tasks while the work per row is high. Only then the
    rows are redistributed; a table with at least one split per core is left as it is, so a
    large input is never shuffled for this.
    """
    df = read_table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
