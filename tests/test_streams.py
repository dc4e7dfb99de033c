"""Drained streams against plain counts over all events."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pyspark.sql.functions as F
import pytest

from cutflow.queries import QUERIES
from cutflow.streaming import timers

START = datetime(2024, 1, 1)


@pytest.fixture(params=["as given", "a later month, two files"])
def events(request, spark, data, tmp_path):
    """Folder and rows of an events table."""
    e = spark.read.parquet(f"{data}/events.parquet")
    if request.param == "as given":
        return data, e.collect()
    later = e.withColumn("ts", F.expr("ts + interval 70 days"))
    later.repartition(2).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path), later.collect()


def test_window_counts_hold_all_events(spark, events):
    folder, rows = events
    n, total = Counter(), defaultdict(float)
    for r in rows:
        key = START + (r["ts"] - START) // timedelta(hours=6) * timedelta(hours=6), r["event_type"]
        n[key] += 1
        total[key] += r["value"]
    got = QUERIES["window_counts_stream"](spark, folder).select(F.col("a").cast("timestamp_ntz").alias("a"), "event_type", "n", "total").collect()
    assert {(r["a"], r["event_type"]): r["n"] for r in got} == n and len(got) == len(n)
    assert {(r["a"], r["event_type"]): r["total"] for r in got} == pytest.approx(total)


def test_sessions_hold_all_events(spark, events):
    folder, rows = events
    times = defaultdict(list)
    for r in rows:
        times[r["user_id"]].append(r["ts"])
    want = Counter()
    for user, ts in times.items():
        first, n, last = None, 0, None
        for t in sorted(ts):
            if last is not None and t - last >= timedelta(hours=4):
                want[user, n, first.date()] += 1
                first, n = None, 0
            first, n, last = first or t, n + 1, t
        want[user, n, first.date()] += 1
    got = QUERIES["sessions_stream"](spark, folder).collect()
    assert Counter((r["user_id"], r["n"], r["day"]) for r in got) == want


def task_events(seed, n=400):
    rng = random.Random(seed)
    kinds = ["create", "enqueue", "claim", "progress", "done", "fail", "cancel"]
    at = 0.0
    for i in range(n):
        at += rng.expovariate(1 / 4)
        yield rng.randrange(12), i, START + timedelta(seconds=at), rng.choices(kinds, [1, 5, 6, 4, 2, 6, 0.3])[0], rng.random() < 0.7, 3, rng.randrange(130)


EVENTS = "task_id long, seq long, ts timestamp_ntz, kind string, retryable boolean, max_attempts int, value int"


@pytest.mark.parametrize("files", [[400], [90, 160, 170, 400]])
def test_timers_fire_alike_however_events_are_batched(spark, tmp_path, files):
    """In one batch, and in four of which the last two run after a stop, from the checkpoint."""
    rows, at, stale = [*task_events(3)], 0, 40.0
    write = lambda k: spark.createDataFrame(rows[at:k], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for k in files:
        write(k)
        at = k
        if k in (160, 400):
            stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            found = timers.drain_stateful(timers.timed_states(stream, stale), str(tmp_path)).collect()
    end = max((r[2] - START).total_seconds() for r in rows)
    want = []
    for task in {r[0] for r in rows}:
        state = timers.START
        for r in [r for r in rows if r[0] == task]:
            e = SimpleNamespace(at=(r[2] - START).total_seconds(), kind=r[3], retryable=r[4], max_attempts=r[5], value=r[6])
            for moment, cause, state in timers.advance(state, e.at, stale):
                want.append((task, cause, state[0], round(moment, 3)))
            state = timers.apply(state, e, stale)
            want.append((task, r[3], state[0], round(e.at, 3)))
        want += [(task, cause, state[0], round(moment, 3)) for moment, cause, state in timers.advance(state, end - 0.002, stale)]
    zero = START.replace(tzinfo=timezone.utc).timestamp()
    assert Counter((r["task_id"], r["cause"], r["status"], round(r["at"] - zero, 3)) for r in found) == Counter(want)
    assert {"ready", "resumed", "exhausted"} <= {w[1] for w in want}
