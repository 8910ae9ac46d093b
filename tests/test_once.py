"""Costly texts are taken apart once: what a filter or a struct names twice is computed twice."""

from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import evaluation as E
from loomgraph.operators import markdown as M
from loomgraph.operators import passages as P
from loomgraph.operators import retrieval as R


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sentence_jobs_split_once(spark):
    chunks = spark.createDataFrame([(1, 1, "One is here. Two\nwill go!"), (1, 2, ""), (2, 1, None)], "doc_id long, chunk long, text string")
    jobs = P.sentence_jobs(chunks, ["doc_id", "chunk"], core=[("WILL", "will")], extended=[("IS", "is")])
    assert plan(jobs).count("split(") == 1
    assert [tuple(r) for r in jobs.collect()] == [(1, 1, "S001 * One is here.\nS002   Two\nS003 * will go!", 3, 2)]


def test_marker_matches_each_rule_once(spark):
    rows = spark.createDataFrame([("go now",), (None,), ("then go",), ("not",)], "s string")
    rules = [("A", "now"), ("B", "go")], [("C", "not")]
    marked = rows.select(X.marker(F.col("s"), *rules).alias("m"), X.is_marked(F.col("s"), *rules).alias("f"))
    assert plan(marked.select("m")).count("regexp_instr") == 2
    assert [tuple(r) for r in marked.collect()] == [("B", True), (None, False), ("B", True), ("C", True)]


def test_kappa_reads_its_pairs_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            asked.add(batch.num_rows)
            yield batch

    pairs = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), (None, "x")], "a string, b string").mapInArrow(seen, "a string, b string")
    k = E.cohen_kappa(pairs, "a", "b").first()
    assert (k.n, k.observed, k.expected, k.kappa) == (4, 0.5, 0.375, 0.2) and asked.value == 4


def test_counted_index_deals_no_token(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, "a")], "doc_id long, text string")
    index = R.counted_index(docs, "doc_id", "text")
    assert "HashAggregate" not in index._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in index.collect()) == [(1, "a", 1, 3, 2, 3, 1.333333), (1, "b", 2, 3, 1, 3, 1.333333), (3, "a", 1, 1, 2, 3, 1.333333)]
    assert R.counted_index(docs.where("false"), "doc_id", "text").count() == 0


def test_term_counts_do_not_pass_the_driver(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, "a")], "doc_id long, text string")
    index = R.counted_index(docs, "doc_id", "text")
    assert "Broadcast" not in index._jdf.queryExecution().executedPlan().toString() and "__salt" not in plan(index)


def test_markdown_lines_split_once(spark):
    docs = spark.createDataFrame([(1, "# a\r\n| x |\n|---|\n| y |\n")], "doc_id long, text string")
    blocks = M.markdown_to_blocks(docs)
    assert plan(blocks).count("split(text#") == 1
    assert sorted(tuple(r) for r in blocks.collect()) == [(1, 0, "HEADING1", "a"), (1, 1, "TABLE", "x\ny")]
