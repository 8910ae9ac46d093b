"""A stored index against one built from nothing; atomic versions."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import retrieval as R
from loomgraph.operators import search_index as S
from loomgraph.session import fresh_path
from loomgraph.sources.versioned import VersionedTable, WriteConflict


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def texts(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, text string")


def rebuilt(docs):
    ix = R.text_index(docs.withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text")
    n = ix.totals.first()
    return sorted(((r.doc_id, r.term, r.tf, r.len, r.df, n.n, n.avgdl) for r in ix.postings.join(ix.terms, "term").collect()), key=repr)


def test_refresh_tokenises_what_changed(spark):
    index = S.SearchIndex(spark, fresh_path(spark, "index"))
    one = texts(spark, [(1, "a b b"), (2, "c"), (3, None), (4, "a c")])
    assert index.refresh(one) == {"tokenised": 4, "removed": 0, "n": 4}
    assert rows(index.postings()) == rebuilt(one)
    two = texts(spark, [(1, "a b b"), (2, "c d"), (3, None), (5, "")])
    assert index.refresh(two) == {"tokenised": 2, "removed": 1, "n": 4}
    assert rows(index.postings()) == rebuilt(two)
    assert index.refresh(two) == {"tokenised": 0, "removed": 0, "n": 4} and index.folder.versions() == [1, 2]
    back = index.refresh(one)
    assert back["tokenised"] == 2 and rows(index.postings()) == rebuilt(one)
    index.compact()
    assert rows(index.postings()) == rebuilt(one) and len(index.folder.state()[1]["segments"]) == 1
    index.folder.vacuum()
    assert rows(index.postings()) == rebuilt(one) and len(index.folder.versions()) == 1
    assert index.refresh(one.where("false"))["n"] == 0 and index.postings().count() == 0


def test_skipping_keeps_the_ranking(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGE_DOCS", 4)
    monkeypatch.setattr(S, "FIRST_RANGES", 2)
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    weight = [1 / (k + 1) for k in range(60)]
    docs = [(k, " ".join(rng.choices(words, weight, k=rng.randrange(0, 40)))) for k in range(300)] + [(300 + k, "w0 w1 w2") for k in range(20)]
    table = texts(spark, docs)
    queries = spark.createDataFrame([(1, "w0 w1"), (2, "w59 w3"), (3, "w50 w51 w52"), (4, "nothing"), (5, ""), (6, "w0 w0 w7"), (7, "w58")], "qid long, q string")
    index = S.SearchIndex(spark, fresh_path(spark, "index"))
    index.refresh(texts(spark, [(k, t + " w1 w58") for k, t in docs[::2]]))
    index.refresh(table)
    for k in (1, 3, 10):
        hits, reads = index.search(queries, "qid", "q", k)
        assert rows(hits, "qid", "doc_id", "score", "rank") == rows(R.bm25_search(table, "doc_id", "text", queries, "qid", "q", k), "qid", "doc_id", "score", "rank")
    index.compact()
    hits, reads = index.search(queries, "qid", "q", 3)
    assert rows(hits, "qid", "doc_id", "score", "rank") == rows(R.bm25_search(table, "doc_id", "text", queries, "qid", "q", 3), "qid", "doc_id", "score", "rank")
    got = {r.qid: (r.postings, r.read) for r in reads.collect()}
    assert all(read <= all_of for all_of, read in got.values()) and sum(r for _, r in got.values()) < 0.8 * sum(a for a, _ in got.values())


def test_replacing_rows_is_all_or_nothing(spark, monkeypatch):
    table = VersionedTable(spark, fresh_path(spark, "triples"), ["doc"], buckets=4)
    schema = "doc long, fact string"
    table.replace(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "x")], schema))
    old = rows(table.read())
    # killed while parts are written, then just before the version is made
    for name in ("stage", "commit"):
        with monkeypatch.context() as m:
            real, calls = getattr(table.folder, name), []

            def dies(*args, **kw):
                calls.append(args)
                if name == "commit" or len(calls) == 2:
                    raise KeyboardInterrupt
                return real(*args, **kw)

            m.setattr(table.folder, name, dies)
            with pytest.raises(KeyboardInterrupt):
                table.replace(spark.createDataFrame([(1, "new")], schema))
        assert rows(table.read()) == old
    # the same write again goes through and once more changes nothing
    table.replace(spark.createDataFrame([(1, "new"), (None, "y")], schema), gone=spark.createDataFrame([(2,)], "doc long"))
    now = [(1, "new"), (None, "y")]
    assert rows(table.read()) == now and rows(table.read(1)) == old
    table.replace(spark.createDataFrame([(1, "new"), (None, "y")], schema), gone=spark.createDataFrame([(2,)], "doc long"))
    assert rows(table.read()) == now
    table.folder.vacuum()
    assert rows(table.read()) == now
    table.replace(spark.createDataFrame([], schema), gone=spark.createDataFrame([(1,), (None,)], "doc long"))
    assert table.read().count() == 0


def test_second_writer_is_told(spark):
    table = VersionedTable(spark, fresh_path(spark, "rows"), ["id"])
    table.replace(spark.createDataFrame([(1, "a")], "id long, x string"))
    base, state = table.folder.state()
    table.folder.commit(base, state)
    with pytest.raises(WriteConflict):
        table.folder.commit(base, state)
    assert table.folder.versions() == [1, 2]


def test_nothing_but_whole_rows_travels(spark):
    """Blocks and scores are made where a range lies: no exchange of single postings or hits."""
    rows_in = texts(spark, [(1, "b a b"), (2, None), (3, "c")]).select("doc_id", R.tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))
    counted = R.count_terms(rows_in)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert [(r.doc_id, [tuple(x) for x in r.terms]) for r in counted.orderBy("doc_id").collect()] == [(1, [("a", 1), ("b", 2)]), (2, []), (3, [("c", 1)])]
