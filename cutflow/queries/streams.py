"""Streaming forms, run over what the table holds."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import SparkSession

from ..streaming import tasks as S
from ..streaming import timers as T
from ..tables import shared_folder, table
from .work import FOLD, event_kind


def _folder(spark: SparkSession) -> str:
    return shared_folder(spark, "stream")


def _events(spark, d):
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")  # a pattern, as the table may be one file


def q_task_state_stream(spark, d):
    seq = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") * 1_000_000 + F.col("event_id")
    e = _events(spark, d).select(F.col("user_id").alias("task_id"), seq.alias("seq"), event_kind().alias("kind"), F.col("event_id").cast("double").alias("now"), (F.col("event_id") % 3 != 0).alias("retryable"), F.lit(3).alias("max_attempts"), (F.col("event_id") % 120).cast("int").alias("value"))
    out = S.drain(S.task_states(e), _folder(spark), "update")
    return out.groupBy("task_id").agg(F.max_by(F.struct("status", "attempts", "progress"), "batch").alias("x")).select("task_id", "x.status", "x.attempts", "x.progress")


def q_window_counts_stream(spark, d):
    return S.drain(S.windows(_events(spark, d), "ts", "event_type", "value", "6 hours", late=None), _folder(spark), "complete").withColumn("a", F.col("a").cast("timestamp_ntz"))


def q_sessions_stream(spark, d):
    return S.drain(S.sessions(_events(spark, d), "user_id", "ts", "4 hours", late=None), _folder(spark), "complete").select("user_id", "n", F.to_date("a").alias("day"))


def _in_files(spark, d, files: int):
    """The events as a stream of files in order of time, one for each batch."""
    e = table(spark, d, "events")
    folder = f"{_folder(spark)}/source"
    ranges = e.repartitionByRange(files, "ts", "event_id").withColumn("_p", F.spark_partition_id())
    ranges.write.partitionBy("_p").parquet(f"{folder}/all")
    for k in range(files):  # files get their times one after the other
        spark.read.schema(e.schema).parquet(f"{folder}/all/_p={k}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


STALE = 43200.0


def q_task_timers(spark, d):
    """Tasks as in the state stream, by event time, silent for half a day at most; what timers and events made of each."""
    seq = F.col("event_id")
    e = _in_files(spark, d, 4).select(F.col("user_id").alias("task_id"), seq.alias("seq"), "ts", event_kind().alias("kind"), (seq % 3 != 0).alias("retryable"), F.lit(3).alias("max_attempts"), (seq % 120).cast("int").alias("value"))
    out = T.drain_stateful(T.timed_states(e, STALE), _folder(spark))
    fired = out.groupBy("task_id").agg(F.max("resumed").alias("resumed"), F.max("exhausted").alias("exhausted"), F.count_if(F.col("cause").isin("signup", "create")).alias("created"))
    return fired.select("task_id", "resumed", "exhausted", "created")


def q_ema_stream(spark, d):
    e = _in_files(spark, d, 3)
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / F.lit(1e6)
    return T.drain_stateful(T.averages(e.select(F.col("user_id").alias("track"), F.col("event_id").alias("id"), t.alias("t"), F.col("value").alias("v")), 0.1), _folder(spark))


#: The fold of tasks with what is due before an event happening first; the watermark's last stand is one more event.
TIMED = f"""with recursive k0 as (select user_id as task_id, ts, event_id, epoch(ts)::double as moment, event_id % 3 <> 0 as retryable, case when event_type = 'click' and event_id % 2 = 0 then 'progress' when event_type = 'signup' then 'create' when event_type = 'view' then 'enqueue' when event_type = 'click' then 'claim' when event_type = 'purchase' then 'done' when event_type = 'error' then 'fail' end as kind, event_id % 120 as value from events
  union all select user_id, max(max(ts)) over (), 9e15::bigint, epoch(max(max(ts)) over ())::double, false, 'end', 0 from events group by user_id),
k as (select *, row_number() over (partition by task_id order by ts, event_id) as rn from k0),
s(task_id, rn, status, attempts, progress, retry, news, resumed, exhausted) as (select distinct task_id, 0::bigint, null::varchar, 0, 0, null::double, null::double, 0, 0 from k union all
select task_id, rn, st, att, pr, re, case when st is distinct from status or att <> attempts or pr <> progress or re is distinct from retry or (kind = 'progress' and status = 'running') then moment else news end, resumed, exhausted from (
select *,
 case when kind = 'create' then 'pending' when kind = 'enqueue' and open then 'queued' when kind = 'claim' and status = 'queued' then 'running' when kind = 'done' and status = 'running' then 'done' when kind = 'fail' and status = 'running' then case when retryable and attempts < 3 then 'queued' else 'error' end else status end as st,
 case when kind = 'create' then 0 when kind = 'claim' and status = 'queued' and retry is null then attempts + 1 else attempts end as att,
 case when kind = 'create' then 0 when kind = 'progress' and status = 'running' then least(greatest(value, 0), 100) when kind = 'done' and status = 'running' then 100 else progress end as pr,
 case when kind = 'fail' and status = 'running' and retryable and attempts < 3 then moment + least(2.0 * pow(2.0, greatest(attempts - 1, 0)), 60.0) when kind = 'progress' or kind = 'end' or (kind = 'claim' and status <> 'queued') or (kind in ('done', 'fail') and status <> 'running') or (kind = 'enqueue' and not open) then retry end as re
 from (select task_id, rn, moment, kind, retryable, value, attempts, progress, news, case when stale and attempts < 3 then 'queued' when stale then 'error' else status end as status, case when retry <= moment then null else retry end as retry, resumed + (stale and attempts < 3)::int as resumed, exhausted + (stale and attempts >= 3)::int as exhausted, coalesce(case when stale then attempts < 3 else status not in ('done', 'error', 'canceled') end, true) as open
  from (select s.* exclude (rn), k.rn, k.moment, k.kind, k.retryable, k.value, coalesce(s.status = 'running' and s.news + {STALE} <= k.moment, false) as stale from s join k on k.task_id = s.task_id and k.rn = s.rn + 1))))
select task_id, max(resumed)::bigint as resumed, max(exhausted)::bigint as exhausted, (select count(*) from events where user_id = task_id and event_type = 'signup') as created from s group by task_id"""
EMA = "with recursive r as (select user_id as track, event_id as id, value as v, row_number() over (partition by user_id order by ts, event_id) as n from events), e(track, n, id, ema) as (select track, n, id, v from r where n = 1 union all select r.track, r.n, r.id, 0.1::double * r.v + 0.9::double * e.ema from e join r on r.track = e.track and r.n = e.n + 1) select track, id, ema from e"
QUERIES = {
    "task_timers_stream": (q_task_timers, TIMED),
    "ema_stream": (q_ema_stream, EMA),
    "task_state_stream": (q_task_state_stream, "select task_id, status, attempts, progress from (" + FOLD + ")"),
    "window_counts_stream": (q_window_counts_stream, "select time_bucket(interval '6 hours', ts, timestamp '2024-01-01') as a, event_type, count(*) as n, sum(value) as total from events group by 1, 2"),
    "sessions_stream": (q_sessions_stream, "with m as (select user_id, ts, coalesce((ts - lag(ts) over w >= interval '4 hours')::int, 1) as new from events window w as (partition by user_id order by ts)), g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as g from m) select user_id, count(*) as n, min(ts)::date as day from g group by user_id, g"),
}
