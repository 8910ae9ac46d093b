"""Message archive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import is_blank


def stream_archive(messages: DataFrame, channels: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Opted-in, non-blank messages, each (channel, ts) once even when delivered again.

    The state holds one key per message within the watermark only.
    """
    on = channels.where("archive_enabled").select("channel_id")
    ok = messages.where(
        ~is_blank(F.col("channel_id")) & ~is_blank(F.col("ts")) & ~is_blank(F.col("user_id")) & ~is_blank(F.col("text"))
    ).join(on, "channel_id", "left_semi")
    once = ok.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["channel_id", "ts"])
    root = F.when(is_blank(F.col("thread_ts")), F.col("ts")).otherwise(F.col("thread_ts"))
    return once.select("channel_id", "ts", root.alias("thread_ts"), "user_id", "text", "created_at")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is available into parquet files and stop."""
    query = (
        stream.writeStream.outputMode(mode).format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1_000) -> DataFrame:
    """File source; each trigger takes a bounded number of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
