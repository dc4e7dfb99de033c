"""Readers of tool logs and landed search results: text in, rows out."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

TRACKS = "struct<tracks:array<struct<path:string,role:string,gain_db:double,start:double,loop:boolean,duck_db:double>>,duration:double>"
ROLES = ["voice", "bgm", "sfx", "other"]


def _all(text: str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def scene_cuts(logs: DataFrame, key: str, text: str) -> DataFrame:
    """Times of scene changes in a filter log -> key, t, each time once."""
    return logs.select(key, F.explode_outer(F.array_distinct(_all(text, r"pts_time:(\d+\.?\d*)"))).alias("t")).where("t is not null").select(key, F.col("t").cast("double").alias("t")).distinct()


def black_ranges(logs: DataFrame, key: str, text: str) -> DataFrame:
    """Black stretches in a filter log -> key, a, b, neighbours at most 0.02 apart merged."""
    from ..operators.intervals import merge

    p = r"black_start:([\d.]+)\s+black_end:([\d.]+)"
    rows = logs.select(key, F.explode_outer(F.arrays_zip(_all(text, p, 1).alias("a"), _all(text, p, 2).alias("b"))).alias("x")).where("x is not null")
    return merge(rows.select(key, F.col("x.a").cast("double").alias("a"), F.col("x.b").cast("double").alias("b")), key, gap=0.02)


def silences(logs: DataFrame, key: str, text: str, duration: Column) -> DataFrame:
    """Silent stretches in a filter log -> key, a, b; one that does not end lasts to the duration."""
    starts, ends = _all(text, r"silence_start: (-?[\d.]+)"), _all(text, r"silence_end: ([\d.]+)")
    rows = logs.select(key, duration.alias("_d"), F.posexplode_outer(starts).alias("_i", "a"), ends.alias("_e")).where("a is not null")
    return rows.select(key, F.greatest(F.col("a").cast("double"), F.lit(0.0)).alias("a"), F.coalesce(F.get("_e", F.col("_i")).cast("double"), F.col("_d")).alias("b"))


def volume_stats(text: Column) -> list[Column]:
    """Mean and greatest volume of a measuring log, in dB."""
    return [F.regexp_extract(text, rf"{k}_volume: (-?[\d.]+) dB", 1).try_cast("double").alias(f"{k}_db") for k in ("mean", "max")]


def mix_spec(specs: DataFrame, key: str, text: str) -> DataFrame:
    """JSON mix specifications -> key, i, path, role, gain_db, start, loop, duck_db; unknown roles become other."""
    rows = specs.select(key, F.posexplode_outer(F.from_json(text, TRACKS)["tracks"]).alias("i", "t")).where("t is not null")
    role = F.when(F.col("t.role").isin(ROLES), F.col("t.role")).otherwise(F.lit("other"))
    return rows.select(key, "i", "t.path", role.alias("role"), F.coalesce("t.gain_db", F.lit(0.0)).alias("gain_db"), F.coalesce("t.start", F.lit(0.0)).alias("start"), F.coalesce("t.loop", F.lit(False)).alias("loop"), "t.duck_db")


def repair_json(text: Column) -> Column:
    """JSON from a model's answer: without code fence, line comments and trailing commas, open brackets closed."""
    t = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    t = F.regexp_replace(t, r"(?m)(?<!:)//.*$", "")
    t = F.regexp_replace(t, r",\s*([}\]])", "$1")
    count = lambda c: F.char_length(t) - F.char_length(F.replace(t, F.lit(c), F.lit("")))
    more = lambda a, b: F.greatest(count(a) - count(b), F.lit(0))
    return F.concat(F.regexp_replace(t, r",\s*$", ""), F.repeat(F.lit("]"), more("[", "]")), F.repeat(F.lit("}"), more("{", "}")))


def first_with_rows(results: DataFrame, key: str, priority: str) -> DataFrame:
    """Of each key only the rows of the source that comes first and has any."""
    best = results.groupBy(key).agg(F.min(priority).alias("_p"))
    return results.join(best, key).where(F.col(priority) == F.col("_p")).drop("_p")


def best_format(formats: DataFrame, key: str, limit: int = 720) -> DataFrame:
    """formats(key, height, bandwidth, id) -> the best within the height limit of each key, else the best of all."""
    order = F.struct((F.col("height") <= limit).alias("fits"), "height", "bandwidth", "id")
    return formats.groupBy(key).agg(F.max(order).alias("x")).select(key, "x.id", "x.height", "x.bandwidth")
