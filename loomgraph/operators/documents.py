"""Filters and updates over the document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import is_blank
from loomgraph.operators.scale import top_k


def list_documents(docs: DataFrame, space: str | None = None, offset: int = 0, size: int = 20) -> DataFrame:
    """One page of the unarchived documents of each space (or of one), newest first."""
    rows = docs.where(F.col("status") != "ARCHIVED")
    if space is not None:
        rows = rows.where(F.col("space") == space)
    page = top_k(rows, ["space"], [F.desc("created_at"), "doc_id"], offset + size, "pos")
    return page.where(F.col("pos") > offset)


def list_stale(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("status") == "STALE")


def staleness_candidates(docs: DataFrame, now: Column) -> DataFrame:
    """Active documents not verified (or created, if never verified) within their time to live."""
    limit = now - F.make_dt_interval(F.col("ttl_days"))
    return docs.where((F.col("status") == "ACTIVE") & (F.coalesce("verified_at", "created_at") < limit))


def mark_stale(docs: DataFrame, now: Column) -> DataFrame:
    """Documents with their new status and whether it changed; a second run changes nothing."""
    limit = now - F.make_dt_interval(F.col("ttl_days"))
    old = (F.col("status") == "ACTIVE") & (F.coalesce("verified_at", "created_at") < limit)
    return docs.withColumn("changed", old).withColumn("status", F.when(F.col("changed"), "STALE").otherwise(F.col("status")))


def stale_notifications(stale: DataFrame, owners: DataFrame) -> DataFrame:
    """One message row per newly stale document whose owner has a chat id."""
    reachable = owners.where(~is_blank(F.col("chat_id"))).select("owner_id", "chat_id")
    return stale.join(reachable, "owner_id").select(
        "doc_id",
        "chat_id",
        "title",
        F.coalesce(F.date_format("verified_at", "yyyy-MM-dd"), F.lit("never")).alias("last_verified"),
        F.col("ttl_days").cast("long").alias("ttl_days"),
        F.concat(F.lit("/d/"), F.col("doc_id")).alias("url"),
    )


def docs_with_triples(docs: DataFrame, triples: DataFrame) -> DataFrame:
    ids = triples.select(F.col("document_id").alias("doc_id")).distinct()
    return docs.join(ids, "doc_id", "left_semi")


def doc_first_source(docs: DataFrame, triples: DataFrame, order: str) -> DataFrame:
    """Channel of the first triple of each document, null without triples."""
    first = triples.groupBy(F.col("document_id").alias("doc_id")).agg(F.min_by("channel_id", order).alias("channel_id"))
    return docs.join(first, "doc_id", "left")


def decision_nodes(triples: DataFrame, prefix: str) -> DataFrame:
    """Smallest statement per (document, event node)."""
    rows = triples.where(F.col("subject").startswith(prefix) & F.col("statement").isNotNull())
    return rows.groupBy("document_id", "subject").agg(F.min("statement").alias("statement"))
