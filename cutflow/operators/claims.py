"""A task queue that several drivers share: a table of tasks and a log of what was done with them.

An entry of the log is a file of the next number. It is made only if nobody else has made it, so whoever read the queue
as it was before that entry knows that nothing has come between; who comes second reads the queue again. The state of
the queue is the fold of the log over the table, and a claim counts if its task was ready when its turn came."""

from __future__ import annotations

import json
import os
import uuid

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .tasks import backoff

STATE = "struct<status:string,attempts:int,retry:double,updated:double,who:string>"
ENTRY = "entry long, id long, kind string, now double, who string, retryable boolean"


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with a text, all of it at once, unless there is one of that name."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    if path.startswith(("/", "file:/")):
        temporary, path = (p.removeprefix("file://").removeprefix("file:") for p in (temporary, path))
        with open(temporary, "w") as f:
            f.write(text)
        try:
            os.link(temporary, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(temporary)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = to(path).getFileSystem(conf)
    out = files.create(to(temporary), True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(to(path).toUri(), conf).rename(to(temporary), to(path), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception as e:
        files.delete(to(temporary), False)
        if "FileAlreadyExists" in str(e):
            return False
        raise


class TaskLog:
    """tasks(id, status, priority, seq, attempts, max_attempts, next_retry_at, updated_at) in a folder, and their log."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def create(self, tasks: DataFrame) -> TaskLog:
        tasks.write.parquet(f"{self.folder}/tasks")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
        return self

    def length(self) -> int:
        """The number of the last entry; entries have no gaps."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log")
        names = [f.getPath().getName() for f in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)]
        return max([int(n.removesuffix(".json")) for n in names if n.endswith(".json")], default=0)

    def entries(self, until: int) -> DataFrame:
        """The log's first entries, a row for each task that one names."""
        if not until:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).option("pathGlobFilter", "*.json").json(f"{self.folder}/log").where(F.col("entry") <= until)

    def state(self, until: int | None = None) -> DataFrame:
        """The tasks after the log, with the one who claimed each last and claims: who has claimed it, in order."""
        tasks = self.spark.read.parquet(f"{self.folder}/tasks")
        log = self.entries(self.length() if until is None else until)
        per = log.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("entry", "kind", "now", "who", "retryable"))).alias("_e"))  # a task's few attempts
        start = F.struct("status", F.col("attempts").cast("int").alias("attempts"), F.col("next_retry_at").cast("double").alias("retry"), F.col("updated_at").cast("double").alias("updated"), F.lit(None).cast("string").alias("who")).cast(STATE)
        none = F.array().cast("array<string>")

        def step(s: Column, e: Column) -> Column:
            now = s["now"]
            ready = (now["status"] == "queued") & (now["retry"].isNull() | (now["retry"] <= e["now"]))
            running = now["status"] == "running"
            again = e["retryable"] & (now["attempts"] < s["most"])

            def to(status: Column, attempts: Column, retry: Column, who: Column, claims: Column) -> Column:
                after = F.struct(status.alias("status"), attempts.alias("attempts"), retry.cast("double").alias("retry"), e["now"].alias("updated"), who.alias("who")).cast(STATE)
                return F.struct(after.alias("now"), s["most"].alias("most"), claims.alias("claims"))

            nothing = F.lit(None)
            claimed = to(F.lit("running"), now["attempts"] + 1, nothing, e["who"], F.array_append(s["claims"], e["who"]))
            failed = to(F.when(again, F.lit("queued")).otherwise(F.lit("error")), now["attempts"], F.when(again, e["now"] + backoff(now["attempts"])), now["who"], s["claims"])
            mine = running & now["who"].eqNullSafe(e["who"])  # nobody ends another's run
            return F.when((e["kind"] == "claim") & ready, claimed).when((e["kind"] == "done") & mine, to(F.lit("done"), now["attempts"], nothing, now["who"], s["claims"])).when((e["kind"] == "fail") & mine, failed).otherwise(s)

        first = F.struct(start.alias("now"), F.col("max_attempts").cast("int").alias("most"), none.alias("claims"))
        empty = F.array().cast("array<struct<entry:bigint,kind:string,now:double,who:string,retryable:boolean>>")
        folded = tasks.join(per, "id", "left").withColumn("_s", F.aggregate(F.coalesce("_e", empty), first, step))
        return folded.select("id", "_s.now.status", "priority", "seq", "_s.now.attempts", "max_attempts", F.col("_s.now.retry").alias("next_retry_at"), F.col("_s.now.updated").alias("updated_at"), "_s.now.who", "_s.claims")

    def _append(self, entry: int, rows: list[dict]) -> bool:
        return put_if_absent(self.spark, f"{self.folder}/log/{entry:012d}.json", "".join(json.dumps({"entry": entry} | r) + "\n" for r in rows))

    def claim(self, who: str, now: float, k: int = 1) -> list[int]:
        """The ids of up to k tasks that are who's to run now; best priority first, then the oldest. None if none is ready."""
        while True:
            n = self.length()
            tasks = self.state(n).where((F.col("status") == "queued") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)))
            ids = [r["id"] for r in tasks.orderBy(F.desc("priority"), "seq").limit(k).select("id").collect()]
            if not ids or self._append(n + 1, [{"id": i, "kind": "claim", "now": now, "who": who} for i in ids]):
                return ids

    def finish(self, who: str, ids: list[int], now: float, kind: str = "done", retryable: bool = True) -> None:
        """Ends runs of who: kind is done, or fail, after which a task with attempts left waits to be claimed again."""
        if kind not in ("done", "fail"):
            raise ValueError(f"a run ends as done or fail, not {kind}")
        while ids and not self._append(self.length() + 1, [{"id": i, "kind": kind, "now": now, "who": who, "retryable": retryable} for i in ids]):
            pass

    def work(self, who: str, handler, clock, sleep, k: int = 1, wait: float = 1.0, until: int | None = None) -> int:
        """A worker: claims, runs handler(id), which may raise, and ends its tasks; waits when none is ready. It stops after
        `until` tasks, or when no task is queued or running any more; returns how many it ran."""
        ran = 0
        while until is None or ran < until:
            ids = self.claim(who, clock(), k)
            for i in ids:
                try:
                    handler(i)
                    self.finish(who, [i], clock())
                except Exception as e:  # what a handler raises is its task's failure
                    self.finish(who, [i], clock(), "fail", getattr(e, "retryable", True))
                ran += 1
            if not ids:
                if self.state().where(F.col("status").isin("queued", "running")).isEmpty():
                    break
                sleep(wait)
        return ran

    def compact(self) -> int:
        """Puts the state after the log in place of the tasks in a new folder's table; returns the last entry it holds."""
        n = self.length()
        TaskLog(self.spark, f"{self.folder}/compact-{n:012d}").create(self.state(n).drop("who", "claims"))
        return n
