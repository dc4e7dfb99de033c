"""The task queue and its state machine."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Window

from ..operators import tasks as Q
from ..tables import table

NOW = 904694400.0  # 1998-09-02


def tasks(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("done")).when(F.col("o_orderstatus") == "O", F.lit("queued")).otherwise(F.lit("running")).alias("status"),
        (5 - F.left("o_orderpriority", F.lit(1)).cast("int")).alias("priority"),
        (F.col("o_orderkey") % 5).cast("int").alias("attempts"),
        F.lit(3).alias("max_attempts"),
        F.col("o_orderkey").alias("seq"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)").cast("double").alias("updated_at"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(NOW) + F.col("o_orderkey") % 100 - 50).alias("next_retry_at"),
    )


TASKS = f"""tasks as (select o_orderkey as id, case o_orderstatus when 'F' then 'done' when 'O' then 'queued' else 'running' end as status, 5 - left(o_orderpriority, 1)::int as priority, (o_orderkey % 5)::int as attempts, 3 as max_attempts,
o_orderkey as seq, epoch(o_orderdate)::double as updated_at, case when o_orderkey % 7 = 0 then {NOW}::double + o_orderkey % 100 - 50 end as next_retry_at from orders)"""


def q_claim(spark, d):
    return Q.claim_next(tasks(spark, d), NOW, 25).select("id", "status", "priority", "attempts")


def q_stats(spark, d):
    return Q.stats(tasks(spark, d))


def q_resume(spark, d):
    return Q.resume_stale(tasks(spark, d), NOW).agg(F.count_if("resumed").alias("resumed"), F.count_if("exhausted").alias("exhausted"))


def q_backoff(spark, d):
    return tasks(spark, d).select("id", Q.backoff(F.col("attempts"), 1.0, 8.0).alias("wait"))


def q_fail(spark, d):
    return Q.fail(tasks(spark, d).where("status = 'running'"), NOW, F.col("id") % 11 != 0).select("id", "status", "next_retry_at")


def q_list(spark, d):
    return tasks(spark, d).where("status = 'running'").orderBy(F.desc("seq")).limit(50).select("id", "status", "attempts")


def q_next_seq(spark, d):
    return tasks(spark, d).agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))


def q_purge(spark, d):
    return tasks(spark, d).where(~F.col("status").isin(Q.TERMINAL) | (F.col("updated_at") >= NOW - 86400 * 365.0)).select("id", "status")


def event_kind() -> F.Column:
    """Events of each user as the life of a task: signup creates, view enqueues, click claims, or every second one reports
    progress, purchase ends, error fails."""
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "create", "view", "enqueue", "click", "claim", "purchase", "done", "error", "fail")])
    return F.when((F.col("event_type") == "click") & (F.col("event_id") % 2 == 0), F.lit("progress")).otherwise(F.element_at(kinds, F.col("event_type")))


def q_state_fold(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.struct("ts", "event_id").alias("seq"), event_kind().alias("kind"), F.col("event_id").cast("double").alias("now"), (F.col("event_id") % 3 != 0).alias("retryable"), F.lit(3).alias("max_attempts"), (F.col("event_id") % 120).cast("int").alias("value"))
    return Q.fold_events(e)


FOLD = """with recursive k as (select user_id as task_id, row_number() over (partition by user_id order by ts, event_id) as rn, event_id::double as now, event_id % 3 <> 0 as retryable, event_id % 120 as value, case when event_type = 'click' and event_id % 2 = 0 then 'progress' when event_type = 'signup' then 'create' when event_type = 'view' then 'enqueue' when event_type = 'click' then 'claim' when event_type = 'purchase' then 'done' when event_type = 'error' then 'fail' end as kind from events),
s(task_id, rn, status, attempts, progress, retry) as (select distinct task_id, 0::bigint, null::varchar, 0, 0, null::double from k union all
select s.task_id, k.rn,
 case when kind = 'create' then 'pending' when kind = 'enqueue' and coalesce(status, '') not in ('done', 'error', 'canceled') then 'queued' when kind = 'claim' and status = 'queued' and (retry is null or retry <= now) then 'running' when kind = 'done' and status = 'running' then 'done' when kind = 'fail' and status = 'running' then case when retryable and attempts < 3 then 'queued' else 'error' end else status end,
 case when kind = 'create' then 0 when kind = 'claim' and status = 'queued' and (retry is null or retry <= now) then attempts + 1 else attempts end,
 case when kind = 'create' then 0 when kind = 'progress' and status = 'running' then least(greatest(value, 0), 100) when kind = 'done' and status = 'running' then 100 else progress end,
 case when kind = 'create' or (kind = 'enqueue' and coalesce(status, '') not in ('done', 'error', 'canceled')) or (kind = 'claim' and status = 'queued' and (retry is null or retry <= now)) or (kind = 'done' and status = 'running') then null
  when kind = 'fail' and status = 'running' then case when retryable and attempts < 3 then now + least(2.0 * pow(2.0, greatest(attempts - 1, 0)), 60.0) end else retry end
 from s join k on k.task_id = s.task_id and k.rn = s.rn + 1)
select task_id, arg_max({'v': status}, rn).v as status, arg_max(attempts, rn) as attempts, arg_max(progress, rn) as progress, arg_max({'v': retry}, rn).v as next_retry_at from s group by task_id"""


def stored(spark, d):
    """The queue with all that a task holds."""
    t = tasks(spark, d)
    kind = F.when(F.col("id") % 4 == 0, F.lit("export")).when(F.col("id") % 4 == 1, F.lit("odd")).otherwise(F.lit("montage"))
    extra = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("note"), F.lit("old"), F.lit("kind"), F.lit("hidden"))).otherwise(F.create_map().cast("map<string,string>"))
    return t.select("id", kind.alias("kind"), "status", (F.col("id") % 100).cast("int").alias("progress"), "attempts", "max_attempts", "priority", "seq", F.lit("{}").alias("payload"), extra.alias("extra"))


STORED = f"{TASKS}, stored as (select id, case id % 4 when 0 then 'export' when 1 then 'odd' else 'montage' end as kind, status, (id % 100)::int as progress, attempts, max_attempts, priority, seq, '{{}}' as payload, id % 3 = 0 as has from tasks)"


def q_create(spark, d):
    c = table(spark, d, "customer")
    new = c.select((F.col("c_custkey") % 900 * 5).alias("id"), F.lit("montage").alias("kind"), F.struct(F.col("c_nationkey").alias("nation")).alias("payload"), F.lit(1).alias("priority"), F.lit(2).alias("max_attempts"), F.col("c_custkey").alias("at"))
    return Q.create(stored(spark, d), new).select("id", "kind", "status", "progress", "max_attempts", "seq", "payload")


def _patched(spark, d):
    fields = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("status"), F.lit("queued"), F.lit("progress"), F.lit("7.9"), F.lit("note"), F.lit("new"))).otherwise(F.create_map(F.lit("priority"), F.lit("soon"), F.lit("clip"), F.col("id").cast("string")))
    return Q.update(stored(spark, d), stored(spark, d).where("id % 5 = 0").select("id", fields.alias("fields")))


def q_update(spark, d):
    t = _patched(spark, d)
    return t.select("id", "kind", "status", "progress", "priority", F.try_element_at("extra", F.lit("note")).alias("note"), F.try_element_at("extra", F.lit("clip")).alias("clip"))


def q_read(spark, d):
    return Q.with_extra(_patched(spark, d)).select("id", F.explode("task").alias("name", "value")).where("name in ('kind', 'note', 'clip', 'progress')")


def q_cancel(spark, d):
    return Q.cancel(stored(spark, d), stored(spark, d).where("id % 6 = 0").select("id")).select("id", "status")


def q_run(spark, d):
    fails = lambda retryable: F.struct(F.lit("went wrong").alias("message"), F.lit(retryable).alias("retryable"))
    claimed = stored(spark, d).where("status = 'running'").withColumn("payload", (F.col("id") % 10).cast("string"))
    handlers = {"montage": lambda x: F.when(x == "3", fails(True)).when(x == "6", fails(False)), "export": lambda x: F.lit(None)}
    return Q.run_claimed(claimed, handlers, NOW).select("id", "status", "message", "next_retry_at")


def q_lines(spark, d):
    return stored(spark, d).withColumn("message", F.concat(F.lit("task of "), F.col("status"))).select("id", Q.table_line().alias("line"))


_wait = "least(1.0 * pow(2.0, greatest(attempts - 1, 0)), 8.0)"
QUERIES = {
    "task_claim_next": (q_claim, f"with {TASKS} select id, 'running' as status, priority, attempts + 1 as attempts from tasks where status = 'queued' and (next_retry_at is null or next_retry_at <= {NOW}) order by priority desc, seq limit 25"),
    "task_stats_zero_filled": (q_stats, f"with {TASKS} select s.status, count(t.id) as n from (values ('pending'), ('queued'), ('running'), ('done'), ('error'), ('canceled')) s(status) left join tasks t on t.status = s.status group by s.status"),
    "task_resume_stale": (q_resume, f"with {TASKS}, s as (select * from tasks where status = 'running' and updated_at < {NOW} - 600) select count_if(attempts < max_attempts) as resumed, count_if(attempts >= max_attempts) as exhausted from s"),
    "task_backoff": (q_backoff, f"with {TASKS} select id, {_wait}::double as wait from tasks"),
    "task_fail_retry": (q_fail, f"with {TASKS} select id, case when id % 11 <> 0 and attempts < 3 then 'queued' else 'error' end as status, case when id % 11 <> 0 and attempts < 3 then {NOW}::double + least(2.0 * pow(2.0, greatest(attempts - 1, 0)), 60.0) end as next_retry_at from tasks where status = 'running'"),
    "task_list_filtered": (q_list, f"with {TASKS} select id, status, attempts from tasks where status = 'running' order by seq desc limit 50"),
    "task_next_seq": (q_next_seq, f"with {TASKS} select coalesce(max(seq), 0) + 1 as next_seq from tasks"),
    "task_purge": (q_purge, f"with {TASKS} select id, status from tasks where status not in ('done', 'error', 'canceled') or updated_at >= {NOW} - 86400 * 365.0"),
    "task_state_fold": (q_state_fold, FOLD),
    "task_create": (q_create, f"""with {STORED}, n as (select c_custkey % 900 * 5 as id, c_nationkey as nation, c_custkey as asked from customer qualify row_number() over (partition by c_custkey % 900 * 5 order by c_custkey desc) = 1)
select id, kind, status, progress, max_attempts, seq, payload from stored where id not in (select id from n) union all select id, 'montage', 'pending', 0, 2, (select max(seq) from tasks) + row_number() over (order by asked, id), '{{"nation":' || nation || '}}' from n"""),
    "task_update": (q_update, f"with {STORED} select id, kind, case when id % 10 = 0 then 'queued' else status end as status, case when id % 10 = 0 then 7 else progress end as progress, case when id % 10 = 5 then 0 else priority end as priority, case when id % 10 = 0 then 'new' when has then 'old' end as note, case when id % 10 = 5 then id::varchar end as clip from stored"),
    "task_read": (q_read, f"with {STORED} select id, 'kind' as name, kind as value from stored union all select id, 'progress', (case when id % 10 = 0 then 7 else progress end)::varchar from stored union all select id, 'note', case when id % 10 = 0 then 'new' else 'old' end from stored where has or id % 10 = 0 union all select id, 'clip', id::varchar from stored where id % 10 = 5"),
    "task_cancel": (q_cancel, f"with {STORED} select id, case when id % 6 = 0 and status not in ('done', 'error', 'canceled') then 'canceled' else status end as status from stored"),
    "task_run_batch": (q_run, f"with {STORED}, o as (select *, case when kind = 'montage' and id % 10 in (3, 6) then 'went wrong' when kind = 'odd' then 'no handler: odd' end as message, kind = 'montage' and id % 10 = 3 and attempts < max_attempts as again from stored where status = 'running') select id, case when message is null then 'done' when again then 'queued' else 'error' end as status, message, case when again then {NOW}::double + least(2.0 * pow(2.0, greatest(attempts - 1, 0)), 60.0) end as next_retry_at from o"),
    "task_table_lines": (q_lines, f"with {STORED} select id, '  ' || rpad(left(id::varchar, 14), 14, ' ') || ' ' || rpad(kind, 8, ' ') || ' ' || rpad(status, 9, ' ') || ' ' || rpad(attempts || '/' || max_attempts, 5, ' ') || ' ' || lpad(progress::varchar, 4, ' ') || '%  ' || left('task of ' || status, 38) as line from stored"),
}
