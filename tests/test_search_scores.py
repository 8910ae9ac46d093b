"""Scores from the texts themselves: two passes, one exchange of tokens by document."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import retrieval as R

TEXTS = {k: " ".join(f"w{(k * j) % 7}" for j in range(k % 9)) + (" hub hub" if k % 3 else "") for k in range(60)} | {60: None, 61: "", 62: "Hub, hub! W1"}
QUERIES = {1: "hub w1", 2: "w2 W2 absent", 3: "absent", 4: None}


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def plain():
    counts = {k: Counter(words(t)) for k, t in TEXTS.items()}
    size = {k: sum(c.values()) for k, c in counts.items()}
    n, avgdl = len(counts), sum(size.values()) / len(counts)
    out = {}
    for qid, q in QUERIES.items():
        for term, qtf in Counter(words(q)).items():
            df = sum(term in c for c in counts.values())
            for k, c in counts.items():
                if c[term]:
                    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                    out[qid, k] = out.get((qid, k), 0) + qtf * idf * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * size[k] / avgdl))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(k, t) for k, t in TEXTS.items()], "doc_id long, text string")
    return docs, spark.createDataFrame(list(QUERIES.items()), "qid long, q string")


def test_scores_equal_a_plain_version(spark, tables):
    got = {(r.qid, r.doc_id): r.score for r in R.bm25_search_scores(tables[0], "doc_id", "text", tables[1], "qid", "q").collect()}
    assert got == pytest.approx(plain(), abs=1e-6)
    none = tables[0].where("false")
    assert R.bm25_search_scores(none, "doc_id", "text", tables[1], "qid", "q").count() == 0


def test_tasks_follow_the_hits(spark, tables, monkeypatch):
    monkeypatch.setattr(R, "TASK_HITS", 4)
    scores = R.bm25_search_scores(tables[0], "doc_id", "text", tables[1], "qid", "q")
    assert scores.rdd.getNumPartitions() >= len(plain()) / 4 > 8
    # tokens are dealt by document, and nothing that follows is dealt again
    plan = scores._jdf.queryExecution().executedPlan().toString()
    dealt = {x for x in re.findall(r"Exchange hashpartitioning\(([a-z_]+)#", plan)}
    assert dealt - {"term"} == {"doc_id"} and "hashpartitioning(qid" not in plan


def test_one_hop_cuts_hubs_before_queries_meet_them(spark):
    rows = [(f"t{k:03d}", "hub", f"leaf{k}", k, f"leaf{k} ask{k % 2}") for k in range(90)]
    triples = spark.createDataFrame(rows, "triple_id string, subject string, object string, event_at int, corpus string")
    asked = spark.createDataFrame([(1, "ask0"), (2, "ask1")], "qid long, q string")
    out = R.expand_one_hop(triples, asked, "qid", "q", seeds=2, total=5)
    found = {q: [r.triple_id for r in out.where(F.col("qid") == q).orderBy("rank").collect()] for q in (1, 2)}
    assert found == {1: ["t088", "t086", "t089", "t087", "t085"], 2: ["t089", "t087", "t088", "t086", "t085"]}
