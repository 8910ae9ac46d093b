"""Lifecycle operators with per-key state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph.operators.lifecycle import MOVES, STATES


def debounce_stream(events: DataFrame, key: str, ts: str, quiet: str = "30 seconds", lateness: str = "1 minute") -> DataFrame:
    """One row per burst of changes, emitted once the watermark passes its end."""
    return (
        events.withWatermark(ts, lateness)
        .groupBy(F.session_window(ts, quiet), key)
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(key, "n_events", F.col("session_window.end").alias("fire_at"))
    )


def quiet_threads_stream(
    messages: DataFrame, quiet_minutes: int = 30, min_messages: int = 3, lateness: str = "10 minutes"
) -> DataFrame:
    """A row each time a thread with enough messages has been quiet.

    The state of a thread is its message count, last ts and last time; an event-time timer
    fires ``quiet_minutes`` after the last message, and a later message sets it again.
    """
    quiet_ms = quiet_minutes * 60_000

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last_ts, last_ms = state.get if state.exists else (0, "", 0)
        if state.hasTimedOut:
            state.update((n, last_ts, last_ms))
            if n >= min_messages:
                yield pd.DataFrame(
                    {"channel_id": [key[0]], "thread_ts": [key[1]], "n_messages": [n], "last_ts": [last_ts]}
                )
            return
        for pdf in batches:
            n += len(pdf)
            last_ts = max(last_ts, pdf["ts"].max())
            last_ms = max(last_ms, int(pdf["ms"].max()))
        state.update((n, last_ts, last_ms))
        state.setTimeoutTimestamp(max(last_ms + quiet_ms, state.getCurrentWatermarkMs() + 1))

    rows = messages.withWatermark("created_at", lateness).select(
        "channel_id", "thread_ts", "ts", "created_at", F.unix_millis(F.col("created_at").cast("timestamp")).alias("ms")
    )
    return rows.groupBy("channel_id", "thread_ts").applyInPandasWithState(
        update,
        "channel_id string, thread_ts string, n_messages long, last_ts string",
        "n long, last_ts string, last_ms long",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def debounce_max_delay_stream(
    events: DataFrame, key: str, ts: str, quiet_seconds: float = 5, max_seconds: float = 30, lateness: str = "10 seconds"
) -> DataFrame:
    """Bursts that fire at min(last change + quiet, first change + max); times in seconds.

    Only the open burst of a key is kept. Rows of a trigger are sorted by time first.
    """
    key_type = events.schema[key].dataType.simpleString()

    def update(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        burst = list(state.get) if state.exists else None
        out = []

        def close():
            out.append((k[0], burst[0], burst[2], min(burst[1] + quiet_seconds, burst[0] + max_seconds)))

        if state.hasTimedOut:
            close()
            state.remove()
        else:
            times = sorted(t for pdf in batches for t in pdf["t"])
            for t in times:
                if burst and (t - burst[1] >= quiet_seconds or t - burst[0] > max_seconds):
                    close()
                    burst = None
                burst = [t, t, 1] if burst is None else [burst[0], max(burst[1], t), burst[2] + 1]
            state.update(tuple(burst))
            due = min(burst[1] + quiet_seconds, burst[0] + max_seconds)
            state.setTimeoutTimestamp(max(int(due * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "first_at", "n_events", "fire_at"])

    rows = events.withWatermark(ts, lateness).select(key, ts, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))
    return rows.groupBy(key).applyInPandasWithState(
        update,
        f"{key} {key_type}, first_at double, n_events long, fire_at double",
        "first_at double, last_at double, n long",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def status_stream(events: DataFrame) -> DataFrame:
    """Status of a document after each trigger in which it changed."""
    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = state.get[0] if state.exists else 0
        rows = sorted(
            (r for pdf in batches for r in zip(pdf["ts"], pdf["event_id"], pdf["action"], pdf["human"])), key=lambda r: r[:2]
        )
        before = s
        for _, _, action, human in rows:
            name = "none" if action == "replace" and not human else action
            s = MOVES.get(name, MOVES["none"])[s]
        state.update((s,))
        if s != before:
            yield pd.DataFrame({"document_id": [key[0]], "status": [STATES[s]]})

    return events.groupBy("document_id").applyInPandasWithState(
        update, "document_id long, status string", "s int", "append", GroupStateTimeout.NoTimeout
    )
