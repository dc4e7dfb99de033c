"""Nearest-in-time joins: as-of, nearest frame, linear interpolation."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .scan import Chunks


def neighbours(probes: DataFrame, points: DataFrame, key: str, id: str) -> DataFrame:
    """probes(key, id, t), points(key, t, v) -> key, id, t, before and after: structs (t, v) of the points around t.

    Both sides go through one sort per key, or per chunk of a large one, which gets the last point before it and the first
    one after it; a point at t itself counts as before and after. Of points at the same time the smallest v is taken."""
    p = probes.select(key, id, "t", F.lit(None).cast("double").alias("v"), F.lit(1).alias("_probe"))
    q = points.groupBy(key, "t").agg(F.min("v").cast("double").alias("v")).select(key, F.lit(None).cast(dict(probes.dtypes)[id]).alias(id), "t", "v", F.lit(0).alias("_probe"))
    point = F.when(F.col("_probe") == 0, F.struct("t", "v"))
    c = Chunks(p.unionByName(q), key, "t")
    both = c.after(c.before(c.df, _last=(F.max(point), "nearest")), _first=(F.min(point), "nearest"))
    before = F.coalesce(F.last(point, ignorenulls=True).over(c.w.orderBy("t", "_probe", id)), F.col("_last"))
    after = F.coalesce(F.last(point, ignorenulls=True).over(c.w.orderBy(F.desc("t"), "_probe", id)), F.col("_first"))
    return both.withColumns({"before": before, "after": after}).where("_probe = 1").select(key, id, "t", "before", "after")


def nearest(around: DataFrame) -> DataFrame:
    """Of neighbours, the closer one as near_t, near_v; the earlier one on a tie."""
    db, da = F.col("t") - F.col("before.t"), F.col("after.t") - F.col("t")
    pick = F.when(da.isNull() | (db <= da), F.col("before")).otherwise(F.col("after"))
    return around.withColumn("near", F.when(db.isNull(), F.col("after")).otherwise(pick))


def lerp() -> Column:
    """Value at t between the neighbours; that of the only one at the ends."""
    a, b = F.col("before"), F.col("after")
    inside = a["v"] + (b["v"] - a["v"]) * (F.col("t") - a["t"]) / (b["t"] - a["t"])
    return F.when(a.isNull(), b["v"]).when(b.isNull() | (a["t"] == b["t"]), a["v"]).otherwise(inside)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
