"""Small helpers shared by the operators: reading tables, cutting lineage, splitting words."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

#: Words are maximal runs of characters other than space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def importable(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it, however the session was started."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; on a local master without one, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cutflow-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def staged(df: DataFrame, name: str, compression: str | None = None, parts: int | None = None) -> DataFrame:
    """Write df as a compressed table in the shared folder and read it back: cuts lineage, survives lost executors.
    "none" for what is compressed already: Spark's codecs hold whole pages beside the heap. parts: files at most, for a
    table that may be far smaller than the number of shuffle partitions is meant for."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(parts) if parts else df).write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(df: DataFrame, rows: int = 4096) -> int:
    """How many tasks are enough for work in proportion to a written table: one for so many rows, 12 at least."""
    return max(12, -(-df.count() // rows))


def remove_staged(df: DataFrame) -> None:
    """Deletes the table that staged() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    folder = next((f.rsplit("/", 1)[0] for f in df.inputFiles()), None)
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_checked(left: DataFrame, right: DataFrame, on, how: str, most: int = 2_000_000) -> DataFrame:
    """A join that broadcasts right if it has at most `most` narrow rows, so that left is not shuffled; else a plain
    one. right is counted, so it should be a written table."""
    return left.join(F.broadcast(right) if right.count() <= most else right, on, how)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once, though body uses it many times or inside lambdas."""
    return F.transform(F.array(value), body)[0]


CHUNK = 64


def running(values: Column, zero: Column, op) -> Column:
    """Of an array, at each place what op folds all values before it into, starting from zero.

    Chunks are folded first, so that no array grows value by value and a long one costs little more than its length."""

    def fold(xs: Column) -> Column:
        at = lambda i: F.floor(i / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), at(F.size(xs) - 1)), lambda j: F.aggregate(F.slice(xs, j * CHUNK + 1, F.lit(CHUNK)), zero, op))
        starts = F.aggregate(chunks, F.array(zero), lambda out, c: F.array_append(out, op(F.element_at(out, -1), c)))
        return let(starts, lambda s: F.transform(xs, lambda _, i: op(F.get(s, at(i)), F.aggregate(F.slice(xs, at(i) * CHUNK + 1, i % CHUNK), zero, op))))

    return let(values, lambda xs: F.when(F.size(xs) > 0, fold(xs)).otherwise(F.slice(xs, 1, 0)))


def alnum_text(text: Column) -> Column:
    """The words of a text (A-Z lower-cased, runs of ASCII letters and digits and of all characters beyond ASCII), each
    after one space, and a last space: " under the mit license ". A text without words gives one space."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_ALNUM, " ")), F.lit(" "))


def alnum_words(text: Column) -> Column:
    """Array of the words of alnum_text."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_ALNUM), lambda w: w != "")


def values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small constant table (of fixed parameters or of bounded size) as SQL VALUES; an empty list gives no rows."""
    names = ", ".join(c.split()[0] for c in columns.split(","))
    cast = [f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in columns.split(",")]
    lit = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else repr(x)
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows or [(None,) * len(cast)])
    return spark.sql(f"select {', '.join(cast)} from values {body} as t({names})" + " where false" * (not rows))
