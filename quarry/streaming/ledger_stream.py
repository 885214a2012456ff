"""Streaming run-state folds (L3 over a stream of transitions).

* ``run_state_stream``: a stateful streaming aggregation keyed by run (one
  small state row per run, ``max_by`` over seq), emitted in ``update`` mode.
* ``run_state_stream_bounded``: the same fold with ``applyInPandasWithState``
  and an event-time timeout, so runs that reached a final state leave the
  state store once the watermark passes them: state stays proportional to
  the open runs, not to every run ever seen.

Invalid states are filtered out before the fold (rejected, as in batch).
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.ledger import FINAL_STATES, RUN_STATES


def run_state_stream(transitions: DataFrame) -> DataFrame:
    ok = transitions.filter(F.col("status").isin(*RUN_STATES))
    running = F.col("status") == "RUNNING"
    final = F.col("status").isin(*FINAL_STATES)
    return ok.groupBy("run_id").agg(
        F.max_by("status", "seq").alias("status"),
        F.max_by(F.when(running, F.col("ts")), F.when(running, F.col("seq"))).alias("started_at"),
        F.max_by(F.when(final, F.col("ts")), F.when(final, F.col("seq"))).alias("finished_at"),
        F.max_by(F.col("progress"), F.when(F.col("progress").isNotNull(), F.col("seq"))).alias("progress"),
        F.count(F.lit(1)).cast("long").alias("transitions"))


STATE_SCHEMA = ("status string, status_seq long, started_at timestamp, started_seq long, "
                "finished_at timestamp, finished_seq long, progress int, progress_seq long, "
                "transitions long, last_ts timestamp")
OUT_SCHEMA = ("run_id string, status string, started_at timestamp, finished_at timestamp, "
              "progress int, transitions long")


def _later(seq, cur_seq) -> bool:
    return cur_seq is None or seq > cur_seq


def _fold_run(key, batches, state, retention_ms: int | None):
    """Last-write-wins by seq across micro-batches; state dropped on timeout."""
    import pandas as pd

    if state.hasTimedOut:
        state.remove()
        return
    names = ["status", "status_seq", "started_at", "started_seq", "finished_at", "finished_seq",
             "progress", "progress_seq", "transitions", "last_ts"]
    cur = dict(zip(names, state.get)) if state.exists else dict.fromkeys(names)
    cur["transitions"] = cur["transitions"] or 0
    for pdf in batches:
        for status, seq, ts, progress in zip(pdf["status"], pdf["seq"], pdf["ts"], pdf["progress"]):
            seq = int(seq)
            cur["transitions"] += 1
            if _later(seq, cur["status_seq"]):
                cur["status"], cur["status_seq"] = status, seq
            if status == "RUNNING" and _later(seq, cur["started_seq"]):
                cur["started_at"], cur["started_seq"] = ts, seq
            if status in FINAL_STATES and _later(seq, cur["finished_seq"]):
                cur["finished_at"], cur["finished_seq"] = ts, seq
            if pd.notna(progress) and _later(seq, cur["progress_seq"]):
                cur["progress"], cur["progress_seq"] = int(progress), seq
            if cur["last_ts"] is None or ts > cur["last_ts"]:
                cur["last_ts"] = ts
    state.update(tuple(cur[n] for n in names))
    if retention_ms is not None and cur["status"] in FINAL_STATES:
        # evict once the watermark passes the last event plus the retention; a
        # timeout must lie after the watermark
        due = int(pd.Timestamp(cur["last_ts"]).timestamp() * 1000) + retention_ms
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame([{"run_id": key[0], "status": cur["status"], "started_at": cur["started_at"],
                         "finished_at": cur["finished_at"], "progress": cur["progress"],
                         "transitions": cur["transitions"]}])


def run_state_stream_bounded(transitions: DataFrame, watermark: str = "10 minutes",
                             retention_ms: int | None = None) -> DataFrame:
    """L3 with ``applyInPandasWithState``: one small state row per run. By
    default none is dropped, so the result is complete. With ``retention_ms``
    a run in a final state is evicted when the event-time watermark passes its
    last transition by that much; transitions that come even later then start
    a fresh state, so choose it only where finished runs get no more."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    ok = transitions.filter(F.col("status").isin(*RUN_STATES)).withWatermark("ts", watermark)
    return ok.groupBy("run_id").applyInPandasWithState(
        partial(_fold_run, retention_ms=retention_ms), OUT_SCHEMA, STATE_SCHEMA, "update",
        GroupStateTimeout.EventTimeTimeout)
