"""The task queue as a stream with timers: waits end and silent runs are recovered without an event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .tasks import step

OUT = "task_id long, at double, cause string, status string, attempts long, resumed long, exhausted long"
STATE = "status string, attempts long, progress long, retry double, news double, resumed long, exhausted long, most long"
START = (None, 0, 0, None, None, 0, 0, 0)


def due(state: tuple, stale: float) -> float | None:
    """When a task changes without an event: a waiting one when its retry may begin, a running one when it is stale."""
    status, _, _, retry, news, *_ = state
    return news + stale if status == "running" and news is not None else retry if status == "queued" else None


def expire(state: tuple, stale: float) -> tuple[str, tuple]:
    """What happens then, and the state after it."""
    status, attempts, progress, _, news, resumed, exhausted, most = state
    if status == "queued":
        return "ready", (status, attempts, progress, None, news, resumed, exhausted, most)
    if attempts < most:
        return "resumed", ("queued", attempts, progress, None, news + stale, resumed + 1, exhausted, most)
    return "exhausted", ("error", attempts, progress, None, news + stale, resumed, exhausted + 1, most)


def advance(state: tuple, until: float, stale: float):
    """(time, cause, state) of all that is due before an instant."""
    while (at := due(state, stale)) is not None and at <= until:
        cause, state = expire(state, stale)
        yield at, cause, state


def apply(state: tuple, e, stale: float) -> tuple:
    """State after an event: what was due before it happens first."""
    for _, _, state in advance(state, e.at, stale):
        pass
    after = step(state[:4], e.kind, e.at, e.retryable, e.max_attempts, e.value)
    news = e.at if after != state[:4] or e.kind == "progress" and state[0] == "running" else state[4]
    return (*after, news, state[5], state[6], int(e.max_attempts))


class Tasks(StatefulProcessor):
    def __init__(self, stale: float):
        self.stale = stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("task", STATE)

    def _read(self) -> tuple:
        found = self.state.get() if self.state.exists() else START
        clean = lambda x: None if x is None or x != x else x
        status, attempts, progress, retry, news, *rest = map(clean, found)
        return status, int(attempts), int(progress), retry, news, *map(int, rest)

    def _store(self, state: tuple) -> None:
        self.state.update(state)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if (at := due(state, self.stale)) is not None:
            self.handle.registerTimer(int(at * 1000) + 1)

    @staticmethod
    def _row(key, at: float, cause: str, state: tuple) -> dict:
        return {"task_id": key[0], "at": at, "cause": cause, "status": state[0], "attempts": state[1], "resumed": state[5], "exhausted": state[6]}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, out = self._read(), []
        for e in pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable").itertuples():
            for at, cause, state in advance(state, e.at, self.stale):
                out.append(self._row(key, at, cause, state))
            state = apply(state, e, self.stale)
            out.append(self._row(key, e.at, e.kind, state))
        self._store(state)
        yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, out = self._read(), []
        for at, cause, state in advance(state, timerValues.getCurrentWatermarkInMs() / 1000, self.stale):
            out.append(self._row(key, at, cause, state))
        self._store(state)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def timed_states(events: DataFrame, stale: float = 600.0, late: str = "0 seconds") -> DataFrame:
    """Streaming events(task_id, seq, ts, kind, retryable, max_attempts, value) -> a row for each event and for each timer:
    task_id, at, cause (the event's kind; ready, resumed or exhausted), status, attempts, resumed, exhausted.

    A task waiting for a retry is ready when its wait ends, and a running task without news for `stale` seconds goes back
    to the queue, or to error without attempts left, as soon as the watermark passes that instant, whether or not events
    follow. What is due before an event happens before it, so that results don't depend on how events are batched. Needs
    the RocksDB state store."""
    timed = events.withColumn("_t", F.col("ts").cast("timestamp")).withWatermark("_t", late).withColumn("at", F.col("_t").cast("double"))
    return timed.groupBy("task_id").transformWithStateInPandas(statefulProcessor=Tasks(stale), outputStructType=OUT, outputMode="append", timeMode="eventTime")


class Average(StatefulProcessor):
    """The last value of an exponential moving average."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("ema", "ema double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows)).sort_values(["t", "id"], kind="stable")
        s, out = self.last.get()[0] if self.last.exists() else None, []
        for v in df["v"]:
            if v == v and v is not None:
                s = v if s is None else self.alpha * v + (1 - self.alpha) * s
            out.append(s)
        if s is not None:
            self.last.update((s,))
        yield pd.DataFrame({"track": key[0], "id": df["id"].to_numpy(), "ema": out})


def averages(samples: DataFrame, alpha: float = 0.35) -> DataFrame:
    """Streaming samples(track, id, t, v), each batch later than the one before -> track, id, ema: as series.ema in a batch.

    State is one number for each track."""
    return samples.groupBy("track").transformWithStateInPandas(statefulProcessor=Average(alpha), outputStructType="track long, id long, ema double", outputMode="append", timeMode="none")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain_stateful(stream, folder: str) -> DataFrame:
    """Runs a stream of this module over what is there, in as many batches as its source makes, and returns what it wrote.
    A stream that was stopped goes on from its checkpoint in the folder."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass",)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        write = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
        write.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
