"""JSON-lines files, one object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of a JSON-lines folder under a given schema; nothing is inferred."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, split_column: str | None = None) -> str:
    """Write one JSON object per row, one sub-folder per value of ``split_column``."""
    writer = df.write.mode("errorifexists")
    if split_column:
        writer = writer.partitionBy(split_column)
    writer.json(path)
    return path


def read_split(spark: SparkSession, path: str, schema, split_column: str) -> DataFrame:
    """Read back a folder written by :func:`write_jsonl` with its split column."""
    return spark.read.schema(schema.add(split_column, "string")).json(path).withColumn(
        split_column, F.col(split_column)
    )
