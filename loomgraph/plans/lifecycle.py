"""Lifecycle queries: threads, revisions, status, debouncing, compaction, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import lifecycle as L
from loomgraph.operators.ingest import archive_ingest
from loomgraph.plans import inputs as I
from loomgraph.plans.oracle_views import NOW, oracle
from loomgraph.plans.registry import Plans
from loomgraph.session import fresh_path
from loomgraph.sources.tables import read_table, read_spread
from loomgraph.streaming import archive as SA
from loomgraph.streaming import stateful as SS

PLANS = Plans()
SIX_HOURS = 6 * 3600

EXTRA = {
    "v_quiet": f"""
SELECT channel_id, thread_ts, count(*) AS n_messages, max(ts) AS last_ts FROM v_archive GROUP BY channel_id, thread_ts
HAVING count(*) >= 3 AND max(created_at) < {NOW} - INTERVAL 30 MINUTE""",
    "v_open": """
SELECT q.* FROM v_quiet q LEFT JOIN v_thread_log l USING (channel_id, thread_ts) WHERE q.last_ts IS DISTINCT FROM l.last_ts""",
    "v_update": "SELECT user_id AS key, event_id AS id, value AS payload FROM events",
    "v_seq": """
SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts, event_id) AS i FROM v_status_event""",
}


def sql(text: str) -> str:
    return oracle(text, EXTRA)


def now():
    return F.expr(I.NOW)


def archive(spark, d):
    return archive_ingest(I.v_msg(spark, d), I.v_channel(spark, d))


def quiet(spark, d):
    return L.quiet_threads(archive(spark, d), now())


@PLANS.add("quiet_threads", sql("SELECT * FROM v_quiet"))
def quiet_threads(spark, d):
    return quiet(spark, d)


@PLANS.add("unprocessed_threads", sql("SELECT * FROM v_open"))
def unprocessed_threads(spark, d):
    return L.unprocessed_threads(quiet(spark, d), I.v_thread_log(spark, d))


@PLANS.add(
    "decision_log_update",
    sql("""
WITH p AS (SELECT channel_id, thread_ts, last_ts, CASE WHEN n_messages % 2 = 1 THEN 1000000 + CAST(split_part(thread_ts, '.', 1) AS BIGINT) END AS nd FROM v_open)
SELECT coalesce(l.channel_id, p.channel_id) AS channel_id, coalesce(l.thread_ts, p.thread_ts) AS thread_ts, coalesce(p.last_ts, l.last_ts) AS last_ts,
  coalesce(l.document_id, nd) AS document_id,
  CASE WHEN p.last_ts IS NULL THEN 'untouched' WHEN nd IS NULL THEN 'examined' WHEN l.document_id IS NULL THEN 'create'
    WHEN d.status = 'DRAFT' THEN 'update' ELSE 'kept' END AS action
FROM v_thread_log l FULL JOIN p ON p.channel_id = l.channel_id AND p.thread_ts = l.thread_ts LEFT JOIN v_doc d ON d.doc_id = l.document_id"""),
)
def decision_log_update(spark, d):
    log = I.v_thread_log(spark, d)
    todo = L.unprocessed_threads(quiet(spark, d), log)
    processed = todo.selectExpr(
        "channel_id", "thread_ts", "last_ts",
        "CASE WHEN n_messages % 2 = 1 THEN 1000000 + cast(split_part(thread_ts, '.', 1) AS bigint) END AS new_document_id",
    )
    status = I.v_doc(spark, d).selectExpr("doc_id AS document_id", "status")
    return L.decision_log_update(log, processed, status)


@PLANS.add(
    "thread_sessions",
    sql("""
SELECT channel_id, thread_ts, session, min(created_at) AS started_at, max(created_at) AS ended_at, count(*) AS n_messages FROM (
  SELECT *, CAST(sum(brk) OVER (PARTITION BY channel_id, thread_ts ORDER BY created_at, ts) AS BIGINT) AS session FROM (
    SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY channel_id, thread_ts ORDER BY created_at, ts) < INTERVAL 2 MINUTE THEN 0 ELSE 1 END AS brk
    FROM v_archive)) GROUP BY channel_id, thread_ts, session"""),
)
def thread_sessions(spark, d):
    return L.thread_sessions(archive(spark, d), gap_minutes=2)


@PLANS.add("stream_archive", sql("SELECT * FROM v_archive"))
def stream_archive(spark, d):
    """Messages arrive as files, redeliveries included; the archive is what the stream wrote."""
    source, out, ck = (fresh_path(spark, n) for n in ("messages", "archive", "archive-state"))
    msgs = I.v_msg(spark, d).withColumn("created_at", F.col("created_at").cast("timestamp"))
    msgs.repartition(4, "delivery").write.parquet(source)
    stream = SA.read_stream(spark, source, msgs.schema, files_per_trigger=1)
    SA.run_available(SA.stream_archive(stream, I.v_channel(spark, d), lateness="3650 days"), out, ck)
    rows = spark.read.parquet(out)
    return rows.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@PLANS.add(
    "debounce_events",
    sql("""
SELECT user_id, session, count(*) AS n_events, arg_max(event_id, ts) AS last_event, max(ts) + INTERVAL 6 HOUR AS fire_at FROM (
  SELECT *, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM events))
GROUP BY user_id, session"""),
)
def debounce_events(spark, d):
    return L.debounce_events(read_table(spark, d, "events"), "user_id", "ts", "event_id", SIX_HOURS)


@PLANS.add(
    "debounce_max_delay",
    sql("""
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, t, t AS first_at FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.t, CASE WHEN e.t - r.t >= 21600 OR e.t > r.first_at + 43200 THEN e.t ELSE r.first_at END
  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, first_at, count(*) AS n_events, least(max(t) + 21600, first_at + 43200) AS fire_at FROM r GROUP BY user_id, first_at"""),
)
def debounce_max_delay(spark, d):
    return L.debounce_max_delay(read_table(spark, d, "events"), "user_id", "ts", "event_id", SIX_HOURS, 2 * SIX_HOURS)


@PLANS.add(
    "revision_squash",
    sql("""
SELECT document_id, revision, count(*) AS merged, max(created_at) AS created_at, arg_max(editor_id, created_at) AS editor_id,
  arg_max(cause, created_at) AS cause, arg_max(snapshot, created_at) AS snapshot FROM (
  SELECT *, CAST(sum(brk) OVER (PARTITION BY document_id ORDER BY created_at, event_id) AS BIGINT) AS revision FROM (
    SELECT *, CASE WHEN lag(editor_id) OVER w = editor_id AND cause IN ('MANUAL', 'SNAPSHOT_COMMIT') AND lag(cause) OVER w IN ('MANUAL', 'SNAPSHOT_COMMIT')
      AND created_at - lag(created_at) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk
    FROM v_rev WINDOW w AS (PARTITION BY document_id ORDER BY created_at, event_id))) GROUP BY document_id, revision"""),
)
def revision_squash(spark, d):
    return L.revision_squash(I.v_rev(spark, d), SIX_HOURS)


@PLANS.add(
    "latest_revision",
    sql("""SELECT document_id, event_id, editor_id, cause, snapshot, created_at FROM (
SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, event_id DESC) AS r FROM v_rev) WHERE r = 1"""),
)
def latest_revision(spark, d):
    return L.latest_revision(I.v_rev(spark, d))


@PLANS.add(
    "status_fold",
    sql("""
WITH RECURSIVE r AS (
  SELECT document_id, CAST(0 AS BIGINT) AS i, '' AS s, CAST(NULL AS TIMESTAMP) AS v FROM (SELECT DISTINCT document_id FROM v_seq)
  UNION ALL
  SELECT e.document_id, e.i,
    CASE WHEN e.action = 'create' AND s = '' THEN 'DRAFT' WHEN s = '' THEN '' WHEN e.action = 'archive' THEN 'ARCHIVED'
      WHEN e.action = 'replace' AND e.human AND s = 'DRAFT' THEN 'ACTIVE' WHEN e.action = 'verify' AND s = 'STALE' THEN 'ACTIVE'
      WHEN e.action = 'stale' AND s = 'ACTIVE' THEN 'STALE' ELSE s END,
    CASE WHEN e.action = 'verify' AND s <> '' THEN e.ts ELSE v END
  FROM r JOIN v_seq e ON e.document_id = r.document_id AND e.i = r.i + 1)
SELECT document_id, arg_max(s, i) AS status, max(v) AS verified_at FROM r GROUP BY document_id HAVING arg_max(s, i) <> ''"""),
)
def status_fold(spark, d):
    return L.status_fold(I.v_status_event(spark, d))


UPDATE = "user_id AS key", "event_id AS id", "value AS payload"


@PLANS.add(
    "log_compaction",
    sql("""
WITH c AS (SELECT key, count(*) AS n, max(id) AS last_id, arg_max(payload, id) AS payload FROM v_update GROUP BY key)
SELECT 'snapshot' AS part, key, last_id AS id, payload FROM c WHERE n >= 60
UNION ALL SELECT 'log', key, id, payload FROM v_update WHERE key NOT IN (SELECT key FROM c WHERE n >= 60)"""),
)
def log_compaction(spark, d):
    folded, rest = L.log_compaction(read_table(spark, d, "events").selectExpr(*UPDATE), None, 60)
    return folded.selectExpr("'snapshot' AS part", "key", "last_id AS id", "payload").unionByName(
        rest.selectExpr("'log' AS part", "key", "id", "payload")
    )


@PLANS.add("read_compacted", sql("SELECT key, max(id) AS id, arg_max(payload, id) AS payload FROM v_update GROUP BY key"))
def read_compacted(spark, d):
    updates = read_table(spark, d, "events").selectExpr(*UPDATE)
    folded, rest = L.log_compaction(updates, None, 60)
    return L.read_compacted(folded, rest)


@PLANS.add(
    "poison_filter",
    """
SELECT source, doc_id, CASE WHEN oks - ok > 0 THEN 'done' WHEN ok = 1 THEN 'ok' WHEN fails >= 10 THEN 'poison' ELSE 'retry' END AS route,
  CASE WHEN oks - ok = 0 AND ok = 1 THEN length(text) END AS n_chars FROM (
  SELECT *, sum(ok) OVER w AS oks, sum(1 - ok) OVER w AS fails FROM (
    SELECT source, doc_id, text, CASE WHEN length(trim(text)) >= 6000 THEN 1 ELSE 0 END AS ok FROM documents)
  WINDOW w AS (PARTITION BY source ORDER BY doc_id))""",
)
def poison_filter(spark, d):
    attempts = read_spread(spark, d).selectExpr("source", "doc_id", "text AS body")
    rows = L.poison_filter(attempts, "source", "doc_id", F.floor(F.col("doc_id") / 10_000), min_body=6000)
    return rows.select("source", "doc_id", "route", F.length("body").cast("long").alias("n_chars"))


@PLANS.add(
    "event_route",
    """
SELECT event_id, CASE event_type WHEN 'click' THEN 'smart_note' WHEN 'view' THEN 'transcript' ELSE 'renew' END AS route,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('click', 'view', 'signup')""",
)
def event_route(spark, d):
    kinds = f"CASE event_type WHEN 'click' THEN '{L.SMART_NOTE}' WHEN 'view' THEN '{L.TRANSCRIPT}' WHEN 'signup' THEN '{L.REMINDER}' ELSE 'other' END"
    events = read_table(spark, d, "events").selectExpr(
        "event_id", f"CASE WHEN event_id % 2 = 0 THEN map('ce-type', {kinds}) ELSE map('ce-type', ' ', 'ce_type', {kinds}) END AS attributes",
        "props AS payload",
    )
    names = {L.SMART_NOTE: "smart_note", L.TRANSCRIPT: "transcript", L.REMINDER: "renew"}
    routed = L.event_route(events, names)
    return routed.select("event_id", "route", F.get_json_object("payload", "$.k").cast("long").alias("k"))


# ---- streaming forms over the same tables

def as_stream(spark, df, name: str, parts: int = 4):
    """The rows written to the shared folder and read back as a file stream."""
    path = fresh_path(spark, name)
    df.repartitionByRange(parts, df.columns[0]).write.parquet(path)
    return SA.read_stream(spark, path, df.schema)


def drained(spark, stream, name: str):
    out, ck = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    schema = stream.schema
    SA.run_available(stream, out, ck)
    return spark.read.schema(schema).parquet(out)


@PLANS.add("stream_quiet_threads")
def stream_quiet_threads(spark, d):
    """Threads reported quiet once event time has moved past them."""
    rows = archive(spark, d).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return drained(spark, SS.quiet_threads_stream(as_stream(spark, rows, "quiet-in")), "quiet")


@PLANS.add("stream_debounce")
def stream_debounce(spark, d):
    ev = read_table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_id")
    return drained(spark, SS.debounce_stream(as_stream(spark, ev, "changes"), "user_id", "ts", "6 hours"), "debounced")


@PLANS.add(
    "stream_status",
    sql("""
WITH RECURSIVE r AS (
  SELECT document_id, CAST(0 AS BIGINT) AS i, '' AS s FROM (SELECT DISTINCT document_id FROM v_seq)
  UNION ALL
  SELECT e.document_id, e.i,
    CASE WHEN e.action = 'create' AND s = '' THEN 'DRAFT' WHEN s = '' THEN '' WHEN e.action = 'archive' THEN 'ARCHIVED'
      WHEN e.action = 'replace' AND e.human AND s = 'DRAFT' THEN 'ACTIVE' WHEN e.action = 'verify' AND s = 'STALE' THEN 'ACTIVE'
      WHEN e.action = 'stale' AND s = 'ACTIVE' THEN 'STALE' ELSE s END
  FROM r JOIN v_seq e ON e.document_id = r.document_id AND e.i = r.i + 1)
SELECT document_id, arg_max(s, i) AS status FROM r GROUP BY document_id HAVING arg_max(s, i) <> ''"""),
)
def stream_status(spark, d):
    """All events in one trigger, so each document reports its final status once."""
    ev = I.v_status_event(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "document_id", "event_id", "action", "human")
    return drained(spark, SS.status_stream(as_stream(spark, ev, "status-in")), "status")
