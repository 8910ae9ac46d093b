"""Measures over the triple graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.scale import hash_row_number


def graph_edges(triples: DataFrame) -> DataFrame:
    return triples.select(
        F.col("subject").alias("source"), F.col("object").alias("target"), "predicate", "kind", "document_id",
        "statement", "event_at",
    )


def graph_nodes(triples: DataFrame) -> DataFrame:
    """Degree per entity: occurrences as subject plus as object, a self-loop counts two."""
    ends = triples.select(F.explode(F.array("subject", "object")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def ranked_edges(hits: DataFrame, triples: DataFrame) -> DataFrame:
    """Edges of the triples that a query found, in the order of the hits.

    ``hits``: qid, triple_id, rank (at most k rows per query).
    """
    own = triples.select("triple_id", "subject", "object", "predicate", "kind", "document_id", "statement", "event_at")
    return hits.select("qid", "rank", "triple_id").join(own, "triple_id").select(
        "qid", "rank", F.col("subject").alias("source"), F.col("object").alias("target"), "predicate", "kind",
        "document_id", "statement", "event_at",
    )


def ranked_nodes(edges: DataFrame) -> DataFrame:
    """Entities of ``ranked_edges`` with their degree inside the hits of each query."""
    ends = edges.select("qid", F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("qid", "id").agg(F.count(F.lit(1)).alias("degree"))


def graph_period(triples: DataFrame) -> DataFrame:
    """First and last event time, share of edges with a time, number of kinds."""
    # kinds are counted over partial groups, so no task sees more than one row per kind
    per = triples.groupBy("kind").agg(
        F.min("event_at").alias("a"), F.max("event_at").alias("b"),
        F.count("event_at").alias("dated"), F.count(F.lit(1)).alias("n"),
    )
    return per.agg(
        F.min("a").alias("first_at"), F.max("b").alias("last_at"),
        F.round(F.sum("dated") / F.sum("n"), 6).alias("dated_share"), F.count("kind").alias("kinds"),
    )


def entity_spread(triples: DataFrame, source: Column) -> DataFrame:
    """Per entity: occurrences, whether it stays in one document, whether it has two sources."""
    ends = triples.select("document_id", source.alias("src"), F.explode(F.array("subject", "object")).alias("entity"))
    return ends.groupBy("entity").agg(
        F.count(F.lit(1)).alias("degree"),
        # equal extremes mean one distinct value; no distinct shuffle is needed
        (F.min("document_id") == F.max("document_id")).alias("isolated"),
        (F.min("src") != F.max("src")).alias("shared"),
    )


def entity_isolation(triples: DataFrame, source: Column) -> DataFrame:
    """Share of entities that occur in exactly one document; entities present in two sources."""
    return entity_spread(triples, source).agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if("isolated").alias("isolated"),
        F.round(F.count_if("isolated") / F.count(F.lit(1)), 6).alias("isolated_share"),
        F.count_if("shared").alias("in_two_sources"),
    )


def hub_entities(triples: DataFrame, source: Column, threshold: int) -> DataFrame:
    """Entities with at least ``threshold`` occurrences and the isolation rate of all others."""
    hub = F.col("degree") >= threshold
    return entity_spread(triples, source).agg(
        F.count_if(hub).alias("hubs"),
        F.count_if(hub & F.col("isolated")).alias("isolated_hubs"),
        F.round(F.count_if("isolated") / F.count(F.lit(1)), 6).alias("isolated_share"),
    )


def predicate_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


def predicate_singletons(triples: DataFrame, canonical: list[str]) -> DataFrame:
    """Predicates used once, and the share of edges with a canonical predicate."""
    return predicate_counts(triples).agg(
        F.count(F.lit(1)).alias("predicates"),
        F.count_if(F.col("n") == 1).alias("singletons"),
        F.round(F.count_if(F.col("n") == 1) / F.count(F.lit(1)), 6).alias("singleton_share"),
        F.round(F.sum(F.when(F.col("predicate").isin(*canonical), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("canonical_share"),
    )


def predicate_entropy(triples: DataFrame) -> DataFrame:
    """Entropy of the predicate distribution with natural logarithms."""
    counts = predicate_counts(triples)
    total = counts.agg(F.sum("n").alias("t")).select("t").scalar()
    p = F.col("n") / total
    return counts.agg(F.round(F.sum(-p * F.log(p)), 6).alias("entropy"), F.count(F.lit(1)).alias("predicates"))


def decision_completeness(triples: DataFrame, roles) -> DataFrame:
    """Average number of edges of each role per event node."""
    def n(role: str) -> Column:
        return F.count_if(F.col("predicate") == role)

    rows = triples.where(F.col("subject").startswith(roles.prefix))
    per = rows.groupBy("document_id", "subject").agg(
        n(roles.value).alias("v"), n(roles.rationale).alias("r"), n(roles.condition).alias("c"), n(roles.rejected).alias("x")
    )
    return per.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.round(F.avg("v"), 6).alias("avg_value"),
        F.round(F.avg("r"), 6).alias("avg_rationale"),
        F.round(F.avg("c"), 6).alias("avg_condition"),
        F.round(F.avg("x"), 6).alias("avg_rejected"),
    )


def kg_vocab(triples: DataFrame) -> DataFrame:
    """Dense ids from 1 for entities and for relations, in the order of a hash of the name."""
    names = triples.select(
        F.explode(
            F.array(
                F.struct(F.lit("entity").alias("kind"), F.col("subject").alias("name")),
                F.struct(F.lit("entity").alias("kind"), F.col("object").alias("name")),
                F.struct(F.lit("relation").alias("kind"), F.col("predicate").alias("name")),
            )
        ).alias("x")
    ).select("x.*").distinct()
    return hash_row_number(names, F.col("name"), "id", partition=["kind"])
