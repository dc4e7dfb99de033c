"""Logical inputs over the test tables; each with the DuckDB expression of the same rows."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window


def importable(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it, however the session was started."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder; on a local master without one, in a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="cutflow-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to a new folder in the shared one and read again: lineage ends there, and a lost executor costs nothing
    that was done before."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _seconds() -> F.Column:
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / F.lit(1e6)


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shot for each event: its source is the event's type, its motion the event's value."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    start, duration = _seconds(), F.lit(0.2) + (i % 97) / F.lit(10.0)
    return e.select(
        i.alias("shot_id"),
        F.col("event_type").alias("source_video"),
        start.alias("start_time"),
        duration.alias("duration"),
        (start + duration).alias("end_time"),
        (F.col("value") / F.lit(10.0)).alias("magnitude"),
        ((i % 7) / F.lit(2.0)).alias("shake"),
        ((i % 5) / F.lit(2.0)).alias("zoom"),
        ((i % 4) * F.lit(1.0)).alias("dx"),
        ((i % 3) * F.lit(-1.0)).alias("dy"),
        F.when(i % 3 == 0, F.array(F.col("event_type"), F.lit("a Happy face"))).when(i % 3 == 1, F.array(F.lit("sad then angry"))).otherwise(F.array().cast("array<string>")).alias("actions"),
    )


SHOTS = """shots as (
  select event_id as shot_id, event_type as source_video, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as start_time, 0.2::double + (event_id % 97) / 10.0::double as duration,
    (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 + (0.2::double + (event_id % 97) / 10.0::double) as end_time, value / 10.0::double as magnitude, (event_id % 7) / 2.0::double as shake, (event_id % 5) / 2.0::double as zoom,
    (event_id % 4) * 1.0::double as dx, (event_id % 3) * -1.0::double as dy,
    case when event_id % 3 = 0 then [event_type, 'a Happy face'] when event_id % 3 = 1 then ['sad then angry'] else [] end as actions
  from events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as a time series."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), F.col("event_id").alias("id"), _seconds().alias("t"), F.col("value").alias("v"), F.col("event_type").alias("kind"))


SAMPLES = "samples as (select user_id as track, event_id as id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as t, value as v, event_type as kind from events)"


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, idx, t, onset, energy: the views of each user as the beats of a music track."""
    i, views = F.col("event_id"), table(spark, sf_dir, "events").where("event_type = 'view'")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return views.select(F.col("user_id").alias("track"), idx.alias("idx"), (F.lit(0.5) * idx + (i % 7) * F.lit(0.01)).alias("t"), F.col("value").alias("onset"), (i * 37 % 101).cast("double").alias("energy"))


BEATS = "beats as (select user_id as track, idx, 0.5::double * idx + (event_id % 7) * 0.01::double as t, value as onset, (event_id * 37 % 101)::double as energy from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as idx from events where event_type = 'view'))"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, a, b: overlapping windows of each user."""
    return samples(spark, sf_dir).select(F.col("track").alias("key"), F.col("id"), F.col("t").alias("a"), (F.col("t") + F.col("v") * 60).alias("b"))


INTERVALS = f"{SAMPLES}, ivs as (select track as key, id, t as a, t + v * 60 as b from samples)"
