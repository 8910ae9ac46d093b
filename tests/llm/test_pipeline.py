"""The pipeline's stages on awkward rows and as a whole."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute as B  # noqa: E402

import corpus_pipeline  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns(spark):
    docs = B.table(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for table in (docs, docs.where("false")):
            out = stage(spark, table, FOLDER)
            assert out.columns == docs.columns + ["shard"] * (k == 4)
            assert out.count() >= 0


def test_run(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    out = corpus_pipeline.run(spark, FOLDER)
    got = out.toPandas()
    assert list(got.columns) == [*table.columns, "shard"] and got.shard.between(0, 7).all()
    text = dict(zip(table.doc_id, table.text))
    kept = sorted(set(got.doc_id))
    assert all(text[d] == t for d, t in zip(got.doc_id, got.text))
    assert not any(B.quality(text[d])[5] for d in kept)
    windows = {tuple(w[k : k + 10]) for _, i in items for w in [B.ITEM_WORD.findall(B.lower(i))] for k in range(len(w) - 9)}
    for d in kept:
        w = B.ITEM_WORD.findall(B.lower(text[d]))
        assert not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (B.words(B.lower(text[d])) for d in kept)]
    for i in range(len(kept)):
        for j in range(i):
            assert len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j])
    again = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert sorted(again.doc_id) == sorted(got.doc_id)
