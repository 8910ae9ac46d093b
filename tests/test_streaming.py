"""Streaming forms against their batch forms on the same rows."""

import datetime as dt

from pyspark.sql import functions as F

from loomgraph.operators import lifecycle as L
from loomgraph.plans.lifecycle import as_stream, drained
from loomgraph.streaming import stateful as SS

START = dt.datetime(2024, 1, 1)


def messages(spark, rows):
    data = [(c, t, f"{i:03d}", START + dt.timedelta(minutes=m)) for i, (c, t, m) in enumerate(rows)]
    return spark.createDataFrame(data, "channel_id string, thread_ts string, ts string, created_at timestamp")


def test_quiet_threads_reopen(spark):
    # thread a is quiet, then gets a message and is quiet again; b never has enough messages
    rows = [("C", "a", m) for m in (0, 1, 2)] + [("C", "b", 3)] + [("C", "x", 200)] + [("C", "a", 300)] + [("C", "x", 900), ("C", "x", 901)]
    df = messages(spark, rows).select("created_at", "channel_id", "thread_ts", "ts")
    out = drained(spark, SS.quiet_threads_stream(as_stream(spark, df, "q-in", parts=8)), "q-out").collect()
    seen = sorted((r["thread_ts"], r["n_messages"], r["last_ts"]) for r in out if r["thread_ts"] == "a")
    assert seen[-1] == ("a", 4, "005") and all(r["thread_ts"] != "b" for r in out)


def test_max_delay_stream(spark):
    secs = [0, 3, 6, 9, 20, 24, 28, 32, 36, 40, 44, 48, 52, 300]
    df = spark.createDataFrame([(START + dt.timedelta(seconds=s), "k", s) for s in secs], "ts timestamp, k string, i long")
    stream = SS.debounce_max_delay_stream(as_stream(spark, df, "d-in", parts=1), "k", "ts", 5, 30)
    out = drained(spark, stream, "d-out").collect()
    batch = L.debounce_max_delay(df, "k", "ts", "i", 5, 30).collect()
    got = sorted((r["first_at"], r["n_events"], r["fire_at"]) for r in out)
    want = sorted((r["first_at"], r["n_events"], r["fire_at"]) for r in batch)
    # the last burst stays open until the watermark passes it
    assert got == want[: len(got)] and len(got) >= len(want) - 1


def test_debounce_stream(spark):
    secs = [0, 10, 100, 110, 1000]
    df = spark.createDataFrame([(START + dt.timedelta(seconds=s), "k", s) for s in secs], "ts timestamp, k string, i long")
    out = drained(spark, SS.debounce_stream(as_stream(spark, df, "s-in", parts=1), "k", "ts", "30 seconds"), "s-out").collect()
    assert sorted(r["n_events"] for r in out) == [2, 2]
