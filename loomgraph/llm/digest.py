"""Registered queries of the operators in this package; ``SQL`` holds their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from loomgraph.llm import (
    decontaminate,
    fill_middle,
    language_id,
    line_dedup,
    mixing,
    quality_classifier,
    quality_rules,
    ranked_search,
    sharding,
    simhash,
    substring_dedup,
    suffix_dedup,
    token_files,
)
from loomgraph.llm.oracle import SQL
from loomgraph.session import fresh_path
from loomgraph.sources.tables import read_table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(read_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read_table(spark, sf_dir, "documents")).drop("kept_text")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "benchmark")
    return decontaminate.decontamination_report(read_table(spark, sf_dir, "documents"), items)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_report(read_table(spark, sf_dir, "documents")).drop("kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(read_table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_report(read_table(spark, sf_dir, "documents")).drop("kept_text")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_tokens(read_table(spark, sf_dir, "documents"), path, tokenizer)
    return token_files.token_digest(token_files.read_tokens(spark, path))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    return quality_classifier.quality_report(read_table(spark, sf_dir, "documents"), labels)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.rearrangement_digest(fill_middle.rearranged(read_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_language_id,
        op3_line_dedup,
        op4_decontamination,
        op5_mixing,
        op6_suffix_array_dedup,
        op7_quality_rules,
        op8_simhash_near_dedup,
        op9_substring_dedup,
        op10_token_files,
        op11_quality_classifier,
        op12_ranked_search,
        op13_fill_middle,
    )
} | {"pipeline": corpus_pipeline.run}

__all__ = ["QUERIES", "SQL"]
