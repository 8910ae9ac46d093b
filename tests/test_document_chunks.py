"""Chunks cut inside their document's row, against the operators on tables of blocks, and searches over them."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import retrieval as R
from loomgraph.operators import sections as S

KINDS = {"1": "HEADING1", "2": "HEADING2", "3": "HEADING3", "p": "PARAGRAPH"}
DOCS = {
    1: ("t1", "p2p1p2p3p2p", None),
    2: ("t2", "ppp", ["a" * 7, " \t", "b\U0001f600c"]),
    3: (None, "1p2p", None),
    4: ("t4", "2p2p3p1p", ["", "x", "h", "y", "i", "z" * 12, "k", "w"]),
    5: ("t5", "p", [" \r\n\x0b\f"]),
    6: ("t6", "123", None),
    7: ("t7", "p1p", [" ", "　", " "]),
}


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, [KINDS[c] for c in kinds], texts or [f"{c}{n} words" for n, c in enumerate(kinds)]) for i, (t, kinds, texts) in DOCS.items()]
    return spark.createDataFrame([*rows, (None, "t", ["PARAGRAPH"], ["lost"]), (9, "t", None, None)], "doc_id long, title string, types array<string>, texts array<string>")


def test_chunks_equal_those_of_the_block_table(documents):
    blocks = documents.select("doc_id", F.posexplode(F.arrays_zip("types", "texts")).alias("position", "b")).select(
        "doc_id", F.col("position").cast("long").alias("position"), F.col("b.types").alias("type"), F.col("b.texts").alias("text")
    )
    want = S.fixed_chunks(S.heading_sections(blocks, documents.select("doc_id", "title")), 5)
    got = S.document_chunks(documents, 5)
    assert got.dtypes == want.dtypes
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(map(tuple, want.collect()), key=str) and len(rows) > 20


def test_nothing_is_shuffled_for_chunks(documents):
    assert "Exchange" not in S.document_chunks(documents)._jdf.queryExecution().executedPlan().toString()


def test_keyword_terms_are_counted_in_their_row(spark):
    chunks = spark.createDataFrame([("a", "x y x z"), ("b", "x"), ("c", None), ("d", "y x")], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "x y"), (2, "z"), (3, "none")], "qid long, q string")
    got = R.keyword_topk(chunks, queries)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3
    assert [(r.qid, r.chunk_id, r["rank"]) for r in got.orderBy("qid", "rank").collect()] == [(1, "d", 1), (1, "a", 2), (2, "a", 1)]
