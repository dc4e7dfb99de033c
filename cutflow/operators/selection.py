"""Greedy selection: non-overlapping highlights per source, round-robin interleaving."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..tables import staged

BEST = 512  # rows of a source looked at in one round


def within(shots: DataFrame, seconds: float) -> DataFrame:
    """Shots that start in the first seconds of their source; all of them for 0."""
    return shots.where(F.col("start_time") < seconds) if seconds > 0 else shots


def with_separation(shots: DataFrame, gap: float | str, most: int | str) -> DataFrame:
    """Adds most and min_sep: the gap, or more if the source is long; 0 without a gap. gap and most are numbers, or the
    names of columns that are the same for all shots of a source."""
    value = lambda x: F.col(x) if isinstance(x, str) else F.lit(x)
    least, span = F.first(value(gap)).cast("double"), F.max("end_time") - F.min("start_time")
    sep = F.when(least > 0, F.greatest(least, span / (F.first(value(most)) * 2.5))).otherwise(F.lit(0.0))
    return shots.withColumn("most", value(most)).join(shots.groupBy("source_video").agg(sep.alias("min_sep")), "source_video")


def _apart(a: Column, b: Column) -> Column:
    """Distance of two intervals; negative where they overlap."""
    return F.greatest(a["start_time"], b["start_time"]) - F.least(a["end_time"], b["end_time"])


def select_highlights(shots: DataFrame, most: int | str = 15, gap: float | str = 1.0) -> DataFrame:
    """shots(source_video, shot_id, start_time, end_time, highlight_score) -> the selected ones, with rank.

    Of each source, best score first (then start, then id), up to `most` shots that are at least min_sep away from all
    selected before. A round folds over the best BEST rows of each source, which is all a task holds of one; sources
    that are not full by then go on with the rows that nothing selected rules out."""
    item = "struct<score:double,start_time:double,shot_id:bigint,end_time:double,min_sep:double,most:int>"
    order = [F.desc("highlight_score"), "start_time", "shot_id"]
    left = with_separation(shots, gap, most).select("source_video", "shot_id", "start_time", "end_time", "highlight_score", "min_sep", F.col("most").cast("int").alias("most"))
    chosen = left.limit(0).groupBy("source_video").agg(F.array().cast(f"array<{item}>").alias("chosen"), F.first("most").alias("full"))
    while True:
        top = left.withColumn("_r", F.row_number().over(Window.partitionBy("source_video").orderBy(*order))).where(F.col("_r") <= BEST)
        rows = F.array_sort(F.collect_list(F.struct((-F.col("highlight_score")).alias("score"), "start_time", "shot_id", "end_time", "min_sep", "most")))
        best = top.groupBy("source_video").agg(rows.alias("rows"), F.count("*").alias("n"), F.first("most").alias("most")).join(chosen, "source_video", "full")

        def step(taken: Column, x: Column) -> Column:
            free = (F.size(taken) < x["most"]) & F.forall(taken, lambda y: _apart(x, y) >= x["min_sep"])
            return F.when(free, F.array_append(taken, x)).otherwise(taken)

        none = F.array().cast(f"array<{item}>")
        now = best.select("source_video", F.aggregate(F.coalesce("rows", none), F.coalesce("chosen", none), step).alias("chosen"), (F.coalesce("n", F.lit(0)) >= BEST).alias("more"), F.coalesce("most", "full").alias("full"))
        now = staged(now, "selected")
        chosen = now.select("source_video", "chosen", "full")
        last = now.where(F.col("more") & (F.size("chosen") < F.col("full")))
        if last.isEmpty():
            break
        here = F.struct(F.col("start_time"), F.col("end_time"))
        ranked = left.join(top.select("source_video", "shot_id"), ["source_video", "shot_id"], "left_anti").join(last.select("source_video", "chosen"), "source_video")
        left = staged(ranked.where(F.forall("chosen", lambda y: _apart(here, y) >= F.col("min_sep"))).select(*left.columns), "left")
    out = chosen.select("source_video", F.posexplode("chosen").alias("rank", "x"))
    return out.select("source_video", "rank", "x.shot_id", "x.start_time", "x.end_time", (-F.col("x.score")).alias("highlight_score"))


def interleave(selected: DataFrame, most: int = 50, by: str | None = None) -> DataFrame:
    """Turns by turns one of each source, sources in order of their best shot -> rows with place, at most `most`, of all
    or of each `by`."""
    key = [by] if by else []
    first = selected.where("rank = 0").select(*key, "source_video", F.col("highlight_score").alias("_s"), F.col("start_time").alias("_t"))
    order = ["rank", F.desc("_s"), "_t", "source_video"]
    joined = selected.join(first, [*key, "source_video"])
    if not by:
        joined = joined.orderBy(*order).limit(most)  # so that the window has at most `most` rows
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return joined.withColumn("place", place).where(F.col("place") < most).drop("_s", "_t")
