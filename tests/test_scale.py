"""Two-level helpers agree with plain windows, also when one key holds most rows."""

import random
import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators import lifecycle as L
from loomgraph.operators import nearest
from loomgraph.operators import retrieval as R
from loomgraph.operators import scale as S


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 9)}", i, rng.choice([None, 1, 2, 3])) for i in range(3000)]
    return spark.createDataFrame(rows, "key string, pos long, v int").cache()


def test_prefix_scan(spark, skewed):
    w = W.partitionBy("key").orderBy("pos")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    plain = skewed.select(
        "key", "pos", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"), F.last("v", True).over(upto).alias("l"),
        F.first("v", True).over(upto).alias("f"), F.lag("v").over(w).alias("g"),
    )
    v = F.col("v")
    two = S.prefix_scan(
        skewed, ["key"], ["pos"], F.floor(F.col("pos") / 100), sums={"s": v}, lasts={"l": v}, firsts={"f": v}, lags={"g": v}
    ).select("key", "pos", "s", "l", "f", "g")
    assert plain.exceptAll(two).count() == 0 and two.exceptAll(plain).count() == 0


def test_row_numbers(spark, skewed):
    plain = skewed.select("key", "pos", F.row_number().over(W.partitionBy("key").orderBy("pos")).cast("long").alias("n"))
    two = S.bucketed_row_number(skewed, F.floor(F.col("pos") / 64), ["pos"], "n", ["key"]).select("key", "pos", "n")
    assert plain.exceptAll(two).count() == 0
    numbers = [r["n"] for r in S.hash_row_number(skewed, F.col("pos"), "n").select("n").collect()]
    assert sorted(numbers) == list(range(1, 3001))


def test_break_groups(spark, skewed):
    w = W.partitionBy("key").orderBy("pos")
    gap = F.col("pos") - F.lag("pos").over(w)
    plain = skewed.withColumn("b", F.when(gap < 3, 0).otherwise(1)).select(
        "key", "pos", F.sum("b").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("g")
    )
    two = S.break_groups(
        skewed, ["key"], ["pos"], F.floor(F.col("pos") / 50), ["pos"], lambda p, c: c["pos"] - p["pos"] >= 3, "g"
    ).select("key", "pos", "g")
    assert plain.exceptAll(two).count() == 0 and two.count() == 3000


def test_salted_join(spark, skewed):
    small = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = skewed.join(small, "key", how)
        b = S.salted_join(skewed, small, ["key"], F.col("pos"), how).select(*a.columns)
        assert a.exceptAll(b).count() == 0 and b.count() == a.count()


def test_ordered_concat(spark, skewed):
    rows = skewed.withColumn("t", F.col("pos").cast("string"))
    out = S.ordered_concat(rows, ["key"], ["pos"], F.col("t"), ",", "s", F.floor(F.col("pos") / 100)).collect()
    for r in out:
        nums = [int(x) for x in r["s"].split(",")]
        assert nums == sorted(nums)
    assert sum(len(r["s"].split(",")) for r in out) == 3000


def test_nearest_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(300, 6)), rng.normal(size=(40, 6))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, qv array<double>")
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 8 * 6 * 14)  # about seven vectors per block
    got = {}
    for r in nearest.nearest_k(queries, "qid", "qv", corpus, "id", "vec", 5, "l2").collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    dist = np.linalg.norm(q[:, None] - x[None], axis=2)
    for i in range(40):
        assert [b for _, b in sorted(got[i])] == list(np.argsort(dist[i], kind="stable")[:5])


def test_vectors_that_lack_come_last(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, None)], "id long, vec array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.1]), (8, None)], "qid long, qv array<double>")
    got = nearest.nearest_k(queries, "qid", "qv", corpus, "id", "vec", 3).orderBy("rank").collect()
    assert [(r["qid"], r["id"], r["distance"] is None) for r in got] == [(7, 1, False), (7, 3, False), (7, 2, True)]
    none = nearest.nearest_k(queries, "qid", "qv", corpus.where("false"), "id", "vec", 3)
    assert none.count() == 0


def test_max_delay_against_loop(spark):
    rng = random.Random(2)
    times = {k: sorted(rng.sample(range(2000), 300)) for k in ("hot", "b")}
    rows = [(k, i, t) for k, ts in times.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "k string, i long, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = sorted((r["k"], r["first_at"], r["n_events"], r["fire_at"]) for r in L.debounce_max_delay(df, "k", "ts", "i", 5, 30).collect())
    want = []
    for k, ts in times.items():
        first, last, n = ts[0], ts[0], 1
        for t in ts[1:]:
            if t - last >= 5 or t > first + 30:
                want.append((k, first, n, min(last + 5, first + 30)))
                first, n = t, 0
            last, n = t, n + 1
        want.append((k, first, n, min(last + 5, first + 30)))
    assert got == sorted(want)


def test_phrase_documents(spark):
    docs = spark.createDataFrame([(1, "a b  c\nd e"), (2, "b c d"), (3, "a b")], "id long, text string")
    ph = spark.createDataFrame([(9, "b c d"), (8, "a b c")], "qid long, q string")
    got = {(r["qid"], r["id"]) for r in R.documents_with_phrase(docs, "id", "text", ph, "qid", "q", 3).collect()}
    assert got == {(9, 1), (9, 2), (8, 1)}


def test_status_fold_buckets(spark):
    rng = random.Random(4)
    acts = ["create", "replace", "verify", "stale", "archive"]
    rows = [(1 if rng.random() < 0.7 else 2, i, i * 600, rng.choice(acts[:4]) if i < 990 else rng.choice(acts), rng.random() < 0.5) for i in range(1000)]
    df = spark.createDataFrame(rows, "document_id long, event_id long, s long, action string, human boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["document_id"]: r["status"] for r in L.status_fold(df).collect()}
    for doc in (1, 2):
        s = 0
        for d, _, _, a, h in rows:
            if d == doc:
                s = L.MOVES["none" if a == "replace" and not h else a][s]
        assert got[doc] == L.STATES[s]


def test_rows_are_dealt_once(spark):
    """Running values and row numbers join their buckets where a window has dealt the rows; null keys and buckets included."""
    rows = [(k, None if i % 11 == 0 else i, i) for k in (None, "a", "b") for i in range(60)]
    table = spark.createDataFrame(rows, "key string, pos long, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        bucket = F.floor(F.col("pos") / 16)
        scanned = S.prefix_scan(table, ["key"], ["pos", "v"], bucket, sums={"s": F.col("v")})
        numbered = S.bucketed_row_number(table, bucket, ["pos", "v"], "n", ["key"])
        for df in (scanned, numbered):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(coalesce" not in plan
        got = {(r.key, r.v): (r.s, r.n) for r in scanned.join(numbered, [scanned.v == numbered.v, scanned.key.eqNullSafe(numbered.key)]).select(scanned.key, scanned.v, "s", "n").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for key in (None, "a", "b"):
        total = 0
        for place, (_, _, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2])), 1):
            total += v
            assert got[key, v] == (total, place)
