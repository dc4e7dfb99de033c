"""The task state machine and activity sessions over a stream of events."""

from __future__ import annotations

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("done", "error", "canceled")
OUT = "task_id long, status string, attempts long, progress long"
STATE = "status string, attempts long, progress long, retry double"


def step(state: tuple, kind: str, now: float, retryable: bool, most: int, value: int) -> tuple:
    """State (status, attempts, progress, retry) after one event; an event that does not fit changes nothing."""
    status, attempts, progress, retry = state
    if kind == "create":
        return "pending", 0, 0, None
    if kind == "enqueue" and status not in TERMINAL:
        return "queued", attempts, progress, None
    if kind == "claim" and status == "queued" and (retry is None or retry <= now):
        return "running", attempts + 1, progress, None
    if kind == "progress" and status == "running":
        return status, attempts, min(max(value, 0), 100), retry
    if kind == "done" and status == "running":
        return "done", attempts, 100, None
    if kind == "fail" and status == "running":
        again = retryable and attempts < most
        return "queued" if again else "error", attempts, progress, now + min(2.0 * 2.0 ** max(attempts - 1, 0), 60.0) if again else None
    if kind == "cancel" and status not in TERMINAL:
        return "canceled", attempts, progress, None
    return state


def _update(key: tuple, batches, state: GroupState):
    now = state.get if state.exists else (None, 0, 0, None)
    events = pd.concat(list(batches)).sort_values("seq", kind="stable")
    for e in events.itertuples():
        now = step(now, e.kind, e.now, e.retryable, e.max_attempts, e.value)
    state.update(now)
    yield pd.DataFrame({"task_id": [key[0]], "status": [now[0]], "attempts": [now[1]], "progress": [now[2]]})


def task_states(events: DataFrame) -> DataFrame:
    """Streaming events(task_id, seq, kind, now, retryable, max_attempts, value) -> the changed tasks' states, in update mode.

    State is one small row for each task, kept in the state store; events of a batch are applied in order of seq."""
    return events.groupBy("task_id").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def _timed(events: DataFrame, ts: str, late: str | None) -> DataFrame:
    timed = events.withColumn("_t", F.col(ts).cast("timestamp"))
    return timed.withWatermark("_t", late) if late else timed


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """Streaming activity sessions of each key: closed by a gap, events later than `late` are dropped.

    Without `late` no event is dropped and no session closed: for complete mode, whose state holds all sessions."""
    timed = _timed(events, ts, late)
    return timed.groupBy(key, F.session_window("_t", gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("a"), F.col("session_window.end").alias("b"), "n")


def windows(events: DataFrame, ts: str, kind: str, value: str, size: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """Streaming counts and sums of each kind in tumbling windows; `late` as in sessions."""
    timed = _timed(events, ts, late)
    return timed.groupBy(F.window("_t", size), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("a"), kind, "n", "total")


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns all it wrote; in update mode, with the batch of each row.

    Append mode leaves out what the watermark has not closed by the end; complete mode returns that too."""
    spark = stream.sparkSession
    if mode == "update":
        # A batch that is tried again writes its own folder again.
        write = stream.writeStream.outputMode("update").foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{folder}/out/batch={k}"))
    elif mode == "complete":
        write = stream.writeStream.outputMode("complete").foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{folder}/out"))
    else:
        write = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out")
    query = write.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
