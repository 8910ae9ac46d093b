"""Threads, revisions, status changes, debouncing and log compaction (batch forms)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.text import is_blank
from loomgraph.operators.ingest import upsert_latest
from loomgraph.operators.scale import break_groups, prefix_scan

THREAD = ["channel_id", "thread_ts"]
# fixed values: causes whose revisions may be merged
SQUASHABLE = ["MANUAL", "SNAPSHOT_COMMIT"]
MAX_FAILURES = 10
MIN_BODY = 200


def minutes(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))


def quiet_threads(archive: DataFrame, now: Column, quiet_minutes: int = 30, min_messages: int = 3) -> DataFrame:
    """Threads with enough messages and none within the quiet period, with their last ts."""
    per = archive.groupBy(*THREAD).agg(
        F.count(F.lit(1)).alias("n_messages"), F.max("ts").alias("last_ts"), F.max("created_at").alias("last_at")
    )
    return per.where((F.col("n_messages") >= min_messages) & (F.col("last_at") < now - minutes(quiet_minutes))).select(
        *THREAD, "n_messages", "last_ts"
    )


def unprocessed_threads(quiet: DataFrame, log: DataFrame) -> DataFrame:
    """Quiet threads not logged, or logged at another last ts."""
    seen = log.select(*THREAD, F.col("last_ts").alias("logged_ts"))
    return quiet.join(seen, THREAD, "left").where(~F.col("last_ts").eqNullSafe(F.col("logged_ts"))).drop("logged_ts")


def decision_log_update(log: DataFrame, processed: DataFrame, status: DataFrame) -> DataFrame:
    """Log after a run, with what happened to the document.

    ``processed``: thread keys, last_ts, new_document_id (null: nothing worth recording).
    ``status``: document_id, status of existing documents. A thread without a document gets
    the new one (create); an existing draft is updated; other documents stay as they are.
    """
    old = log.select(*THREAD, F.col("last_ts").alias("old_ts"), "document_id")
    rows = old.join(processed, THREAD, "full_outer").join(status, "document_id", "left")
    fresh = F.col("new_document_id").isNotNull()
    action = (
        F.when(F.col("last_ts").isNull(), "untouched")
        .when(~fresh, "examined")
        .when(F.col("document_id").isNull(), "create")
        .when(F.col("status") == "DRAFT", "update")
        .otherwise("kept")
    )
    return rows.select(
        *THREAD,
        F.coalesce("last_ts", "old_ts").alias("last_ts"),
        F.coalesce("document_id", "new_document_id").alias("document_id"),
        action.alias("action"),
    )


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def hour_bucket(ts: Column) -> Column:
    """Hour of the time: a long-lived or busy key is handled hour by hour."""
    return F.date_trunc("hour", ts)


def gap_sessions(rows: DataFrame, keys: list[str], ts: str, tie: str, gap_seconds: float, name: str = "session") -> DataFrame:
    """Session number per row: a row starts a session when the previous one is at least ``gap_seconds`` older."""
    return break_groups(
        rows, keys, [ts, tie], hour_bucket(F.col(ts)), [ts],
        lambda prev, cur: seconds_between(prev[ts], cur[ts]) >= gap_seconds, name,
    )


def thread_sessions(archive: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Gap-based sessions of the messages of each thread."""
    marked = gap_sessions(archive, THREAD, "created_at", "ts", gap_minutes * 60)
    return marked.groupBy(*THREAD, "session").agg(
        F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"), F.count(F.lit(1)).alias("n_messages")
    )


def debounce_events(events: DataFrame, key: str, ts: str, tie: str, quiet_seconds: float = 30) -> DataFrame:
    """One action per burst of changes, ``quiet_seconds`` after its last change."""
    marked = gap_sessions(events, [key], ts, tie, quiet_seconds)
    return marked.groupBy(key, "session").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max_by(tie, F.struct(ts, tie)).alias("last_event"),
        (F.max(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(quiet_seconds))).alias("fire_at"),
    )


def debounce_max_delay(
    events: DataFrame, key: str, ts: str, tie: str, quiet_seconds: float = 5, max_seconds: float = 30
) -> DataFrame:
    """Bursts that fire at min(last change + quiet, first change + max).

    A pause of ``quiet_seconds`` always ends a burst, so sessions are independent work items;
    each is read as a sorted stream, and only the open burst is held. Times are seconds.
    """
    marked = gap_sessions(events, [key], ts, tie, quiet_seconds)
    rows = marked.select(key, "session", (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))
    parts = rows.repartition(key, "session").sortWithinPartitions(key, "session", "t")
    schema = T.StructType(
        [events.schema[key], T.StructField("first_at", T.DoubleType()), T.StructField("n_events", T.LongType()),
         T.StructField("fire_at", T.DoubleType())]
    )

    def bursts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = None
        for pdf in batches:
            out = []
            k, s, t = pdf[key].to_numpy(), pdf["session"].to_numpy(), pdf["t"].to_numpy()
            cuts = np.flatnonzero((k[1:] != k[:-1]) | (s[1:] != s[:-1])) + 1 if len(t) else []
            for lo, hi in zip(np.r_[0, cuts].astype(int), np.r_[cuts, len(t)].astype(int)):
                if hi <= lo:
                    continue
                if open_ and (open_[0], open_[1]) != (k[lo], s[lo]):
                    out.append(open_)
                    open_ = None
                i = lo
                while i < hi:
                    if open_ is None:
                        open_ = [k[lo], s[lo], t[i], 0, t[i]]
                    j = i + int(np.searchsorted(t[i:hi], open_[2] + max_seconds, side="right"))
                    if j > i:
                        open_[3] += j - i
                        open_[4] = t[j - 1]
                    if j < hi:
                        out.append(open_)
                        open_ = None
                    i = j
            yield frame(out)
        if open_:
            yield frame([open_])

    def frame(items) -> pd.DataFrame:
        return pd.DataFrame(
            [(k, a, n, min(last + quiet_seconds, a + max_seconds)) for k, _, a, n, last in items],
            columns=[key, "first_at", "n_events", "fire_at"],
        )

    return parts.mapInPandas(bursts, schema)


def revision_squash(revisions: DataFrame, window_seconds: float = 600) -> DataFrame:
    """Neighbouring revisions of one editor with squashable causes merged into the latest content.

    The merged revision takes the newer time, so the window counts from the previous change.
    """
    def new(prev: Column, cur: Column) -> Column:
        return (
            (prev["editor_id"] != cur["editor_id"])
            | ~prev["cause"].isin(*SQUASHABLE)
            | ~cur["cause"].isin(*SQUASHABLE)
            | (seconds_between(prev["created_at"], cur["created_at"]) >= window_seconds)
        )

    runs = break_groups(
        revisions, ["document_id"], ["created_at", "event_id"], hour_bucket(F.col("created_at")),
        ["editor_id", "cause", "created_at"], new, "revision",
    )
    at = F.struct("created_at", "event_id")
    return runs.groupBy("document_id", "revision").agg(
        F.count(F.lit(1)).alias("merged"),
        F.max("created_at").alias("created_at"),
        F.max_by("editor_id", at).alias("editor_id"),
        F.max_by("cause", at).alias("cause"),
        F.max_by("snapshot", at).alias("snapshot"),
    )


def latest_revision(revisions: DataFrame) -> DataFrame:
    """Newest revision per document."""
    row = F.max_by(F.struct("event_id", "editor_id", "cause", "snapshot", "created_at"), F.struct("created_at", "event_id"))
    return revisions.groupBy("document_id").agg(row.alias("r")).select("document_id", "r.*")


STATES = ["", "DRAFT", "ACTIVE", "STALE", "ARCHIVED"]
# new state by action, indexed by the old state; the order of STATES
MOVES = {
    "create": [1, 1, 2, 3, 4],
    "replace": [0, 2, 2, 3, 4],
    "verify": [0, 1, 2, 2, 4],
    "stale": [0, 1, 3, 3, 4],
    "archive": [0, 4, 4, 4, 4],
    "none": [0, 1, 2, 3, 4],
}


def status_fold(events: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Status and verification time per document from its ordered events.

    An event maps each state to a state, and such maps compose. The events of a bucket are
    composed to one map, then the few maps of a document are applied in order.
    ``events``: document_id, event_id, ts, action, human. Only human replacements activate.
    """
    action = F.when((F.col("action") == "replace") & ~F.col("human"), "none").otherwise(F.col("action"))
    moves = F.create_map(
        *[x for name, m in MOVES.items() for x in (F.lit(name), F.array(*[F.lit(s) for s in m]))]
    )
    step = F.coalesce(F.try_element_at(moves, action), F.array(*[F.lit(s) for s in MOVES["none"]]))
    rows = events.withColumn("__b", bucket if bucket is not None else hour_bucket(F.col("ts"))).withColumn("__m", step)
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "__m")))
    identity = F.array(*[F.lit(s) for s in MOVES["none"]])
    composed = F.aggregate(ordered, identity, lambda acc, e: F.transform(acc, lambda s: F.get(e["__m"], s)))
    # time of the first creation and of the verifications, for verified_at
    per = rows.groupBy("document_id", "__b").agg(composed.alias("__m"))
    maps = F.array_sort(F.collect_list(F.struct("__b", "__m")))
    final = F.aggregate(maps, F.lit(0), lambda s, m: F.get(m["__m"], s))
    state = per.groupBy("document_id").agg(final.alias("s"))
    born = events.where("action = 'create'").groupBy("document_id").agg(F.min(F.struct("ts", "event_id")).alias("born"))
    seen = (
        events.where("action = 'verify'").join(born, "document_id")
        .where(F.struct("ts", "event_id") > F.col("born"))
        .groupBy("document_id").agg(F.max("ts").alias("verified_at"))
    )
    names = F.array(*[F.lit(s) for s in STATES])
    return state.where("s > 0").join(seen, "document_id", "left").select(
        "document_id", F.get(names, F.col("s")).alias("status"), "verified_at"
    )


def log_compaction(updates: DataFrame, snapshots: DataFrame | None, threshold: int = 500):
    """(snapshots, remaining log) after compaction.

    Keys with at least ``threshold`` rows fold them into a snapshot of the last payload and
    the highest id; their log rows are dropped. ``updates``: key, id, payload.
    """
    per = updates.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"), F.max_by("payload", "id").alias("payload")
    )
    folded = per.where(F.col("n") >= threshold).select("key", "last_id", "payload")
    rest = updates.join(folded.select("key"), "key", "left_anti")
    if snapshots is not None:
        folded = upsert_latest(snapshots, folded, ["key"], "last_id")
    return folded, rest


def read_compacted(snapshots: DataFrame, log: DataFrame) -> DataFrame:
    """Current payload per key: the latest of the snapshot and the log rows after it."""
    base = snapshots.select("key", F.col("last_id").alias("id"), "payload")
    newer = log.join(snapshots.select("key", "last_id"), "key", "left").where("last_id IS NULL OR id > last_id")
    return upsert_latest(base, newer.select("key", "id", "payload"), ["key"], "id")


def poison_filter(
    attempts: DataFrame, key: str, order: str, bucket: Column, max_failures: int = MAX_FAILURES,
    min_body: int = MIN_BODY, max_body: int | None = None,
) -> DataFrame:
    """Route of each attempt: ok, retry, poison (the key has failed too often) or done (already imported).

    A body shorter than ``min_body`` after trimming is a failure; an accepted body is cut at
    ``max_body`` characters if that is given.
    """
    good = ~is_blank(F.col("body")) & (F.length(F.trim("body")) >= min_body)
    rows = attempts.withColumn("__ok", good.cast("int"))
    counted = prefix_scan(
        rows, [key], [order], bucket, sums={"__oks": F.col("__ok"), "__fails": 1 - F.col("__ok")}
    )
    route = (
        F.when(F.col("__oks") - F.col("__ok") > 0, "done")
        .when(F.col("__ok") == 1, "ok")
        .when(F.col("__fails") >= max_failures, "poison")
        .otherwise("retry")
    )
    return counted.select(
        key, order, route.alias("route"), F.when(route == "ok", F.col("body") if max_body is None else F.substring("body", 1, max_body)).alias("body")
    )


# fixed values: routed event types
SMART_NOTE = "google.workspace.meet.smartNote.v2.fileGenerated"
TRANSCRIPT = "google.workspace.meet.transcript.v2.fileGenerated"
REMINDER = "google.workspace.events.subscription.v1.expirationReminder"


def event_route(events: DataFrame, names: dict[str, str]) -> DataFrame:
    """Routed events; the type attribute has two spellings, unknown types are left out unread.

    ``events``: event_id, attributes map, payload JSON.
    """
    plain = F.try_element_at("attributes", F.lit("ce-type"))
    kind = F.when(~is_blank(plain), plain).otherwise(F.try_element_at("attributes", F.lit("ce_type")))
    route = None
    for type_name, target in names.items():
        hit = kind == type_name
        route = F.when(hit, target) if route is None else route.when(hit, target)
    return events.withColumn("route", route).where("route IS NOT NULL")
