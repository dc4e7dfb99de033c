"""Time-interval algebra: pairing, islands, merging, complements, range joins. Keys may have any number of rows; those of
one point in time share a task."""

from __future__ import annotations

import math

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from .scan import Chunks, numbered


def pair_cuts(cuts: DataFrame, key: str, t: str, duration: Column, min_len: float) -> DataFrame:
    """cuts(key, t) -> key, i, a, b: from each cut to the next, the last one to the duration.

    The head from 0 to the first cut comes first if that is above 0. i counts before short shots are dropped."""
    c = Chunks(cuts, key, t)
    ahead = c.after(c.df, _next=(F.min(t), "nearest")).withColumn("_b", F.coalesce(F.lead(t).over(c.w.orderBy(t)), F.col("_next"), duration))
    heads = cuts.groupBy(key).agg(F.min(t).alias("b")).where("b > 0").select(key, F.lit(0.0).alias("a"), "b", F.lit(0).alias("_chunk"))
    pairs = ahead.select(key, F.col(t).alias("a"), F.col("_b").alias("b"), "_chunk").unionByName(heads)
    return numbered(c, pairs, "a", "b", name="i").where(F.col("b") - F.col("a") >= min_len).select(key, "i", "a", "b")


def index_shots(cuts: DataFrame, key: str, t: str, duration: float, min_len: float = 0.4) -> DataFrame:
    """cuts -> key, i, a, b between distinct cuts inside (0, duration); short ones go, the rest is numbered densely."""
    inner = cuts.where((F.col(t) > 0) & (F.col(t) < duration)).select(key, F.col(t).alias("a")).distinct()
    bounds = inner.unionByName(cuts.select(key).distinct().select(key, F.lit(0.0).alias("a")))
    pairs = bounds.withColumn("b", F.coalesce(F.lead("a").over(Window.partitionBy(key).orderBy("a")), F.lit(float(duration)))).where(F.col("b") - F.col("a") >= min_len)
    return pairs.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("a")) - 1).alias("i"), "a", "b")


def islands(samples: DataFrame, key: str, t: str, hot: Column, id: str, min_len: float, open_end: Column | None = None) -> DataFrame:
    """Runs of hot samples -> key, a, b: from the first hot one to the first cold one after it.

    Runs of at most min_len go. A run still open at the end is lost, or ends at open_end if given."""
    c = Chunks(samples, key, t)
    w = c.w.orderBy(t, id)
    flagged = c.before(c.df.withColumn("_h", hot), _last=(F.max_by("_h", F.struct(t, id)), "nearest"))
    flagged = c.after(flagged, _first=(F.min(t), "nearest"))
    flagged = flagged.withColumn("_n", F.coalesce(F.lead(t).over(w), F.col("_first"))).withColumn("_s", F.col("_h") & ~F.coalesce(F.lag("_h").over(w), F.col("_last"), F.lit(False)))
    runs = c.before(flagged, _runs=(F.sum(F.col("_s").cast("int")), "sum"))
    runs = runs.withColumn("_g", F.sum(F.col("_s").cast("int")).over(w) + F.coalesce("_runs", F.lit(0))).where("_h")
    ends = runs.groupBy(key, "_g").agg(F.min(t).alias("a"), F.max(F.struct(F.col(t).alias("t"), F.col(id).alias("id"), F.col("_n").alias("n"))).getField("n").alias("b"))
    closed = ends.where(F.col("b").isNotNull() & (F.col("b") - F.col("a") > min_len)).select(key, "a", "b")
    if open_end is None:
        return closed
    return closed.unionByName(ends.where("b is null").select(key, "a", open_end.alias("b")))


def merge(intervals: DataFrame, key: str, a: str = "a", b: str = "b", gap: float = 0.0) -> DataFrame:
    """Overlapping intervals, and those at most gap apart, become one -> key, a, b."""
    c = Chunks(intervals, key, a)
    w = c.w.orderBy(a, b)
    reach = F.greatest(F.max(b).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reach"))
    marked = c.before(c.df, _reach=(F.max(b), "max")).withColumn("_new", F.coalesce((F.col(a) - reach > gap).cast("int"), F.lit(1)))
    counted = c.before(marked, _starts=(F.sum("_new"), "sum"))
    grouped = counted.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_starts", F.lit(0)))
    return grouped.groupBy(key, "_g").agg(F.min(a).alias("a"), F.max(b).alias("b")).drop("_g")


def complement(merged: DataFrame, key: str, end: Column, margin: float = 0.0, min_len: float = 0.0) -> DataFrame:
    """What disjoint intervals leave of [0, end] -> key, a, b, each side margin short, longer than min_len."""
    c = Chunks(merged, key, "a")
    last = F.coalesce(F.lag("b").over(c.w.orderBy("a")), F.col("_last"))
    before = c.before(c.df, _last=(F.max_by("b", "a"), "nearest")).select(key, F.coalesce(last + margin, F.lit(0.0)).alias("a"), (F.col("a") - margin).alias("b"))
    tails = merged.groupBy(key).agg((F.max("b") + margin).alias("a")).select(key, "a", end.alias("b"))
    return before.unionByName(tails).where(F.col("b") - F.col("a") > min_len)


GROWTH = 8  # times that a level's buckets are as long as those of the level below


def in_windows(points: DataFrame, windows: DataFrame, key: str, t: str, width: float) -> DataFrame:
    """points whose t lies in some closed window [a, b] of their key.

    Both sides meet in time buckets of nested levels: those of the lowest are `width` long. A window goes to the lowest
    level whose buckets are as long as it is, so it stands in two buckets at most however long it is, and a point looks
    into one bucket of each level that has windows."""
    long = F.greatest((F.col("b") - F.col("a")) / width, F.lit(1.0))
    level = F.ceil(F.ln(long) / math.log(GROWTH) - 1e-9).cast("int")
    bucket = lambda x, n: F.floor(x / (width * F.pow(F.lit(float(GROWTH)), n)))
    levelled = windows.where("b >= a").select(key, "a", "b", level.alias("_l"))
    spread = levelled.select(key, "a", "b", "_l", F.explode(F.sequence(bucket(F.col("a"), F.col("_l")), bucket(F.col("b"), F.col("_l")))).alias("_k"))
    levels = levelled.select("_l").distinct()  # a few: lengths of doubles differ by a factor of 8^700 at most
    probes = points.select(key, t).distinct().crossJoin(F.broadcast(levels)).withColumn("_k", bucket(F.col(t), F.col("_l")))
    same = (F.col(f"p.{key}") == F.col(f"w.{key}")) & (F.col("p._l") == F.col("w._l")) & (F.col("p._k") == F.col("w._k"))
    hits = probes.alias("p").join(spread.alias("w"), same & F.col(f"p.{t}").between(F.col("w.a"), F.col("w.b")), "left_semi")
    return points.join(hits.select(key, t), [key, t], "left_semi")


def clip_shift(captions: DataFrame, offset: Column, length: Column) -> DataFrame:
    """captions(a, b, ...) seen from a clip that starts at offset: shifted, clipped to [0, length], others gone."""
    a, b = F.col("a") - offset, F.col("b") - offset
    return captions.where((b > 0) & (a < length)).withColumns({"a": F.greatest(a, F.lit(0.0)), "b": F.least(b, length)})
