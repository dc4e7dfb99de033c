"""The work queue: claims, retries, recovery and statistics over tables of tasks and task events."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

STATUSES = ["pending", "queued", "running", "done", "error", "canceled"]
TERMINAL = ["done", "error", "canceled"]


def backoff(attempts: Column, base: float = 2.0, cap: float = 60.0) -> Column:
    """Seconds to wait after a number of attempts: doubling from base up to cap."""
    return F.least(base * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(cap))


def claim_next(tasks: DataFrame, now: float, k: int = 1) -> DataFrame:
    """The k tasks to run next, claimed: highest priority first, then oldest; those waiting for a retry not before it."""
    ready = tasks.where((F.col("status") == "queued") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)))
    return ready.orderBy(F.desc("priority"), "seq").limit(k).withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1, "next_retry_at": F.lit(None).cast("double")})


def stats(tasks: DataFrame) -> DataFrame:
    """status, n for every status, 0 where none."""
    every = tasks.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, STATUSES))).alias("status"))
    return every.join(tasks.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def resume_stale(tasks: DataFrame, now: float, stale_seconds: float = 600.0) -> DataFrame:
    """Running tasks without news go back to the queue, or to error when their attempts are used up."""
    stale = (F.col("status") == "running") & (F.col("updated_at") < now - stale_seconds)
    status = F.when(stale & (F.col("attempts") < F.col("max_attempts")), F.lit("queued")).when(stale, F.lit("error")).otherwise(F.col("status"))
    return tasks.withColumns({"status": status, "resumed": stale & (F.col("attempts") < F.col("max_attempts")), "exhausted": stale & (F.col("attempts") >= F.col("max_attempts"))})


def fail(tasks: DataFrame, now: float, retryable: Column) -> DataFrame:
    """Failed runs: requeued with a wait while attempts remain and the failure can be retried, else error."""
    again = retryable & (F.col("attempts") < F.col("max_attempts"))
    return tasks.withColumns({"status": F.when(again, F.lit("queued")).otherwise(F.lit("error")), "next_retry_at": F.when(again, now + backoff(F.col("attempts")))})


def fold_events(events: DataFrame) -> DataFrame:
    """events(task_id, seq, kind, now, retryable, max_attempts, value) -> task_id, status, attempts, progress,
    next_retry_at after all of them.

    Kinds: create, enqueue, claim, progress (to value, of a running task), done, fail, cancel; one that does not fit the
    state changes nothing. A task has a few events, folded in order of seq."""
    state = "struct<status:string,attempts:int,progress:int,retry:double>"
    ordered = events.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "now", "retryable", "max_attempts", "value"))).alias("e"))

    def step(s: Column, e: Column) -> Column:
        def new(status=None, attempts=None, progress=None, retry=None) -> Column:
            return F.struct((F.lit(status) if isinstance(status, str) else s["status"] if status is None else status).alias("status"), (s["attempts"] if attempts is None else attempts).cast("int").alias("attempts"), (s["progress"] if progress is None else progress).cast("int").alias("progress"), (F.lit(None) if retry is None else retry).cast("double").alias("retry")).cast(state)

        kind, status = e["kind"], s["status"]
        again = e["retryable"] & (s["attempts"] < e["max_attempts"])
        open_ = ~F.coalesce(status.isin(TERMINAL), F.lit(False))
        ready = s["retry"].isNull() | (s["retry"] <= e["now"])
        return (
            F.when(kind == "create", new("pending", F.lit(0), F.lit(0)))
            .when((kind == "enqueue") & open_, new("queued"))
            .when((kind == "claim") & (status == "queued") & ready, new("running", s["attempts"] + 1))
            .when((kind == "progress") & (status == "running"), new(progress=F.least(F.greatest(e["value"], F.lit(0)), F.lit(100)), retry=s["retry"]))
            .when((kind == "done") & (status == "running"), new("done", progress=F.lit(100)))
            .when((kind == "fail") & (status == "running"), new(F.when(again, F.lit("queued")).otherwise(F.lit("error")), retry=F.when(again, e["now"] + backoff(s["attempts"]))))
            .when((kind == "cancel") & open_, new("canceled"))
            .otherwise(s)
        )

    start = F.lit(None).cast(state)
    first = F.coalesce(start, F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).alias("attempts"), F.lit(0).alias("progress"), F.lit(None).cast("double").alias("retry")).cast(state))
    return ordered.select("task_id", F.aggregate("e", first, step).alias("s")).select("task_id", "s.status", "s.attempts", "s.progress", F.col("s.retry").alias("next_retry_at"))


def create(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """tasks and the new ones, new(id, kind, payload, priority, max_attempts, at): pending, numbered on from the last seq
    in order of at. A task of an id that is there already takes its place, and of equal new ids the last one stands. new
    is one batch of requests, numbered in one task."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("at")))).where("_n = 1")
    top = tasks.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_top"))
    rows = last.crossJoin(F.broadcast(top)).withColumn("seq", F.col("_top") + F.row_number().over(Window.orderBy("at", "id")))  # top is one row
    made = rows.select("id", "kind", F.lit("pending").alias("status"), F.lit(0).alias("progress"), F.lit(0).alias("attempts"), "max_attempts", "priority", "seq", F.to_json("payload").alias("payload"), F.create_map().cast("map<string,string>").alias("extra"))
    return tasks.join(last.select("id"), "id", "left_anti").select(*made.columns).unionByName(made)


#: Columns of a task that a patch sets; other keys of it go to extra. Those of INTEGERS are 0 for what is no number.
COLUMNS, INTEGERS = ["kind", "status", "payload"], ["progress", "attempts", "max_attempts", "priority"]


def update(tasks: DataFrame, patches: DataFrame) -> DataFrame:
    """patches(id, fields: map<string,string>), one for each id at most -> tasks with the fields set; unknown keys are
    merged into extra, the newer value of a key stands."""
    both = tasks.join(patches.select("id", F.col("fields").alias("_f")), "id", "left")
    has = lambda c: F.coalesce(F.map_contains_key("_f", F.lit(c)), F.lit(False))
    value = lambda c: F.try_element_at("_f", F.lit(c))
    whole = lambda c: F.coalesce(value(c).try_cast("double").cast("int"), F.lit(0))
    unknown = F.map_filter(F.coalesce("_f", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*COLUMNS, *INTEGERS, "id"))
    extra = F.map_concat(F.map_filter("extra", lambda k, _: ~F.map_contains_key(unknown, k)), unknown)
    sets = {c: F.when(has(c), value(c)).otherwise(F.col(c)) for c in COLUMNS} | {c: F.when(has(c), whole(c)).otherwise(F.col(c)) for c in INTEGERS}
    return both.withColumns(sets | {"extra": extra}).drop("_f")


def with_extra(tasks: DataFrame) -> DataFrame:
    """id, task: each task as a map; its own columns stand over keys of extra with the same name."""
    own = [c for c in tasks.columns if c not in ("id", "extra")]
    columns = F.create_map(*[x for c in own for x in (F.lit(c), F.col(c).cast("string"))])
    return tasks.select("id", F.map_concat(F.map_filter("extra", lambda k, _: ~k.isin(*own)), columns).alias("task"))


def cancel(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """Tasks of ids(id) that have not ended are canceled."""
    marked = tasks.join(ids.select("id", F.lit(True).alias("_c")), "id", "left")
    return marked.withColumn("status", F.when(F.col("_c") & ~F.col("status").isin(TERMINAL), F.lit("canceled")).otherwise(F.col("status"))).drop("_c")


def run_claimed(claimed: DataFrame, handlers: dict, now: float) -> DataFrame:
    """Outcomes of claimed tasks(kind, payload, attempts, max_attempts, ...): handlers gives for each kind a function of
    the payload column that returns null, or struct(message, retryable) of a failure. An unknown kind fails for good."""
    failure = "struct<message:string,retryable:boolean>"
    unknown = F.struct(F.concat(F.lit("no handler: "), F.coalesce("kind", F.lit(""))).alias("message"), F.lit(False).alias("retryable")).cast(failure)
    outcome = unknown
    for kind, handler in handlers.items():
        outcome = F.when(F.col("kind") == kind, handler(F.col("payload")).cast(failure)).otherwise(outcome)
    done = claimed.withColumn("_o", outcome)
    again = F.col("_o.retryable") & (F.col("attempts") < F.col("max_attempts"))
    status = F.when(F.col("_o").isNull(), F.lit("done")).when(again, F.lit("queued")).otherwise(F.lit("error"))
    return done.withColumns({"status": status, "message": F.col("_o.message"), "next_retry_at": F.when(F.col("_o").isNotNull() & again, now + backoff(F.col("attempts")))}).drop("_o")


def table_line() -> Column:
    """A task as a line of a table: id, kind, status, attempts, progress, message."""
    cut = lambda c, n: F.rpad(F.left(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(n)), n, " ")
    tries = F.rpad(F.concat(F.col("attempts").cast("string"), F.lit("/"), F.col("max_attempts").cast("string")), 5, " ")
    return F.concat(F.lit("  "), cut("id", 14), F.lit(" "), cut("kind", 8), F.lit(" "), cut("status", 9), F.lit(" "), tries, F.lit(" "), F.lpad(F.col("progress").cast("string"), 4, " "), F.lit("%  "), F.left(F.coalesce("message", F.lit("")), F.lit(38)))
