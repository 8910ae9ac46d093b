"""Keyword ranking by nearness against all pairs of places."""

import math
import re

from loomgraph.operators.retrieval import proximity_topk

CHUNKS = [
    ("a", "red fox and red hen"),
    ("b", "red " + "x " * 40 + "fox"),
    ("c", "red " + "x " * 150 + "fox"),
    ("d", "fox fox fox red"),
    ("e", "Fox, red!"),
    ("f", "only a fox"),
    ("g", ""),
    ("h", None),
]
QUERIES = [(1, "red fox"), (2, "fox"), (3, "fox FOX red red"), (4, "nowhere fox"), (5, ""), (6, None)]


def plain(text, query):
    words, terms = (re.findall(r"\w+", (s or "").lower()) for s in (text, query))
    terms = set(terms)
    places = [(i, w) for i, w in enumerate(words) if w in terms]
    if not terms or {w for _, w in places} != terms:
        return None
    if len(terms) == 1:
        return 0.1 * sum(1 / (j + 1) ** 2 for j in range(len(places))) / 1.64493406685
    miss = 1.0
    for i, v in places:
        for j, w in places:
            if v != w and 0 < j - i <= 100:
                miss *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp((j - i) / 1.5 - 2)))
    return 1 - miss


def test_nearness(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, text string")
    queries = spark.createDataFrame(QUERIES, "qid long, q string")
    got = {}
    for r in proximity_topk(chunks, queries, 3).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.chunk_id, r.score))
    for qid, q in QUERIES:
        want = [(round(s, 6), c) for c, t in CHUNKS if (s := plain(t, q)) is not None]
        want = sorted(want, key=lambda x: (-x[0], x[1]))[:3]
        assert sorted(got.get(qid, [])) == [(i, c, s) for i, (s, c) in enumerate(want, 1)], qid
    assert proximity_topk(chunks.where("false"), queries, 3).count() == 0
