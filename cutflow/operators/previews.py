"""A cache of previews: what has been made of which source with which parameters, and what is still to make."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from .scan import Chunks

CACHE = "key string, source string, bytes bigint, made_at double"


def keyed(requests: DataFrame) -> DataFrame:
    """requests(source, stamp, params: map<string,string>, ...) with key: 16 hex digits of what a preview depends on. A
    source of another stamp (its time and size), or other parameters, has another key."""
    sorted_params = F.map_from_entries(F.array_sort(F.map_entries("params")))
    return requests.withColumn("key", F.left(F.sha1(F.to_json(F.struct("source", "stamp", sorted_params.alias("params")))), F.lit(16)))


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The previews of a cache's folder; none of an empty one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(CACHE).parquet(folder) if there else spark.createDataFrame([], CACHE)


def to_make(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Of keyed requests those that the cache doesn't have, each key once: nothing, when nothing has changed."""
    return requests.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def remember(made: DataFrame, folder: str) -> None:
    """Adds made(key, source, bytes, made_at) to a cache."""
    made.selectExpr("key", "source", "cast(bytes as bigint) as bytes", "cast(made_at as double) as made_at").write.mode("append").parquet(folder)


def evict(cache: DataFrame, now: float, max_age: float, max_bytes: int) -> DataFrame:
    """The cache with kept: previews of at most max_age seconds, the newest (then by key) first while they fit max_bytes
    together. The running sum goes over range partitions, so that no task holds the cache."""
    young = cache.withColumns({"_all": F.lit(0), "_age": now - F.col("made_at")})
    c = Chunks(young, "_all", "_age")
    sized = F.when(F.col("_age") <= max_age, F.col("bytes")).otherwise(F.lit(0))
    carried = c.before(c.df, _before=(F.sum(sized), "sum"))
    total = F.sum(sized).over(c.w.orderBy("_age", "key").rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_before", F.lit(0))
    return carried.withColumn("kept", (F.col("_age") <= max_age) & (total <= max_bytes)).select(*cache.columns, "kept")
