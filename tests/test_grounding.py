"""Containment of claims in sentences through rare tokens, against all pairs."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import evaluation as E
from loomgraph.operators.retrieval import sentences_of
from loomgraph.operators.scale import unnest


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    words = ["the", "of", "and"] * 6 + [f"word{k}" for k in range(40)]
    docs = [(d, ". ".join(" ".join(rng.choices(words, k=rng.randrange(4, 14))) for _ in range(rng.randrange(1, 25))) + ".") for d in range(20)]
    claims = [(d, c, f"s{c % 2}", " ".join(rng.choices(words, k=rng.randrange(0, 14)))) for d in range(22) for c in range(6)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string").persist(),
        spark.createDataFrame(claims, "doc_id long, claim_id long, system string, claim string").persist(),
    )


@pytest.mark.parametrize("least", [0.0, 0.3, 0.5, 1.0])
def test_same_pairs_as_all_pairs(tables, least):
    docs, claims = tables
    tokens = lambda s: set(re.findall(r"[^\W_]+", s.lower()))
    sents = sentences_of(docs, "doc_id", "text").collect()
    want = []
    for c in claims.collect():
        own = tokens(c.claim)
        for s in sents:
            share = len(own & tokens(s.sentence)) / len(own) if own and s.doc_id == c.doc_id else 0
            if share > 0 and share >= least:
                want.append((c.doc_id, c.claim_id, s.ordinal, share))
    got = E.token_overlap(claims, docs, X.LATIN_CORE_MARKERS, X.LATIN_EXTENDED_MARKERS, least)
    assert sorted(tuple(r) for r in got.select("doc_id", "claim_id", "ordinal", "overlap").collect()) == sorted(want)


def test_fewer_rows_meet(tables):
    docs, claims = tables
    held = unnest(sentences_of(docs, "doc_id", "text").withColumn("s", F.array_distinct(X.tokenize(F.col("sentence")))), ["doc_id"], F.col("s"), "token")
    rows = {least: held.join(E.rare_tokens(claims, held, least), ["doc_id", "token"]).count() for least in (0.0, 0.3, 0.5)}
    assert rows[0.3] < 0.75 * rows[0.0] and rows[0.5] < 0.6 * rows[0.0]
    cut = E.rare_tokens(claims, held, 0.5).select("t", "prefix").distinct().collect()
    assert all(len(r.prefix) == len(r.t) - max(1, math.ceil(len(r.t) * 0.5)) + 1 for r in cut)


def test_texts_are_shuffled_once_and_not_per_token(spark):
    # a sentence of many tokens: a row per token that carries the whole sentence would grow with their square
    words = [f"w{k}" for k in range(4000)]
    docs = spark.createDataFrame([(1, " ".join(words) + ".")], "doc_id long, text string")
    claims = spark.createDataFrame([(1, c, "s", " ".join(words[c : c + 400])) for c in range(600)], "doc_id long, claim_id long, system string, claim string")
    got = E.token_overlap(claims, docs, X.LATIN_CORE_MARKERS, X.LATIN_EXTENDED_MARKERS, 0.3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    assert {(r.claim_id, r.ordinal, r.overlap) for r in got.collect()} == {(c, 1, 1.0) for c in range(600)}


def test_pairs_are_counted_in_parts(monkeypatch):
    sents, claims = ["a b c", "", "c d", "x"], ["a c", "", "d q", "z"]
    whole = [tuple(map(tuple, p)) for p in E.shared_tokens("\n".join(claims), "\n".join(sents), 0.0)]
    monkeypatch.setattr(E, "PAIRS_AT_ONCE", 4)
    parts = [x for p in E.shared_tokens("\n".join(claims), "\n".join(sents), 0.0) for x in zip(*p)]
    assert parts == list(zip(*whole[0])) == [(0, 0, 1.0), (0, 2, 0.5), (2, 2, 0.5)]
