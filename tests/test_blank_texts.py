"""Queries and their SQL on documents whose text is empty, blank, white space of other kinds or null."""

import duckdb
import pytest

from harness import compare
from loomgraph.operators import ingest as G
from loomgraph.operators import modelio as MI

TEXTS = ["zero", "a\n\n b \n", "", " ", "\t", None, "c", "d", "\n", "\u00a0 e \u3000\r\n\tf\t\n\u00a0", " \n\t\n "]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("blank")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(TEXTS)))
    con.execute("CREATE TABLE customer AS SELECT i AS c_custkey, 'Customer#' || i AS c_name FROM range(20) t(i)")
    con.execute(
        "CREATE TABLE orders AS SELECT i AS o_orderkey, i % 20 AS o_custkey, DATE '2024-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority, 'O' AS o_orderstatus FROM range(60) t(i)"
    )
    for t in ("documents", "customer", "orders"):
        con.execute(f"COPY {t} TO '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["judge_jobs", "judge_jobs_by_document", "judge_join"])
def test_jobs_equal_their_sql(spark, tables, name):
    import __spark_entry__ as entry

    folder, con = tables
    ok, message, *_ = compare(spark, con, folder, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message
    got = {r.document_id for r in entry.queries()[name](spark, folder).collect()}
    assert got == {i for i in range(len(TEXTS)) if i % 7}


def test_the_operator_drops_blank_documents(spark):
    nodes = spark.createDataFrame([(i, "s", "t") for i in range(4)], "document_id long, subject string, statement string")
    texts = spark.createDataFrame([(0, "x"), (1, " \n"), (2, None), (3, "")], "document_id long, text string")
    assert [r.document_id for r in MI.judge_jobs(nodes, texts).collect()] == [0]
    assert [r.document_id for r in MI.judge_jobs_by_document(nodes, texts).collect()] == [0]


def test_paragraphs_equal_their_sql(spark, tables):
    import __spark_entry__ as entry

    folder, con = tables
    ok, message, *_ = compare(spark, con, folder, entry.queries()["paragraph_blocks"], entry.oracle_sql()["paragraph_blocks"])
    assert ok, message
    got = {}
    for r in entry.queries()["paragraph_blocks"](spark, folder).orderBy("doc_id", "position").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {0: ["zero"], 1: ["a", "b"], 4: ["\t"], 6: ["c"], 7: ["d"], 9: ["e \u3000\r", "\tf\t"], 10: ["\t"]}


def test_the_operator_marks_blank_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, " \t\n "), (3, ""), (4, None)], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in G.paragraph_blocks(docs).collect()} == {(1, "a"), (2, G.EMPTY_DOCUMENT), (3, G.EMPTY_DOCUMENT)}
