"""What a renderer is told: speed curves, crops, transitions, mixer chains, as columns of numbers and text."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..operators.scan import Chunks

#: Output sizes of the usual aspect ratios (fixed values).
SIZES = [(9 / 16, 1080, 1920), (2 / 3, 1080, 1620), (3 / 4, 1080, 1440), (4 / 5, 1080, 1350), (1.0, 1080, 1080), (4 / 3, 1440, 1080), (16 / 9, 1920, 1080), (21 / 9, 2520, 1080)]


def preset_speed(preset: str, u: Column) -> Column:
    """Speed of a preset curve at u in [0, 1]."""
    one = F.lit(1.0)
    curves = {
        "rush": 1.0 + 2.2 * F.pow(u, F.lit(1.6)),
        "slowmo": 2.4 - 2.0 * F.least(one, u * 1.15),
        "hero": 0.4 + 1.4 * F.pow(F.abs(2 * u - 1), F.lit(1.3)),
        "punch": F.when(((u > 0.18) & (u < 0.30)) | ((u > 0.55) & (u < 0.67)), F.lit(2.6)).otherwise(one),
    }
    return curves[preset]


def ramp(start: float, end: float):
    """A speed function that goes straight from start to end; a constant one, if they are equal."""
    return lambda u: start + (end - start) * u


def sampled_speed(clips: DataFrame, length: str, speed, steps: int = 10) -> DataFrame:
    """clips -> a row for each of equal steps: step, a, b, speed, which is the function of a column u in [0, 1] at the
    step's middle, 0.05 at least."""
    n = max(1, steps)
    out = clips.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u0, u1 = F.col("step") / n, (F.col("step") + 1) / n
    return out.withColumns({"a": u0 * F.col(length), "b": u1 * F.col(length), "speed": F.greatest(F.lit(0.05), F.lit(0.0) + speed((u0 + u1) / 2))})


def speed_segments(clips: DataFrame, length: str, preset: str, steps: int = 10) -> DataFrame:
    """As sampled_speed, of a preset curve."""
    return sampled_speed(clips, length, lambda u: preset_speed(preset, u), max(steps, 20) if preset == "punch" else steps)


def atempo(speed: Column, lo: float = 0.5, hi: float = 2.0) -> Column:
    """Factors within [lo, hi] whose product is the speed."""
    s = F.greatest(speed.cast("double"), F.lit(0.05))
    up = F.greatest(F.ceil(F.log2(s / hi) - 1e-12), F.lit(0)).cast("int")
    down = F.greatest(F.ceil(F.log2(lo / s) - 1e-12), F.lit(0)).cast("int")
    rest = F.round(s / F.pow(F.lit(hi), up) * F.pow(F.lit(1 / lo), down), 6)
    return F.concat(F.array_repeat(F.lit(hi), up), F.array_repeat(F.lit(lo), down), F.array(rest))


def crop_window(width: Column, height: Column, aspect: Column) -> Column:
    """struct(w, h): the largest even window of an aspect ratio in a picture."""
    w0 = F.rint(height * aspect)
    fits = w0 <= width
    w = F.when(fits, w0).otherwise(width).cast("bigint")
    h = F.when(fits, height).otherwise(F.rint(width / aspect)).cast("bigint")
    return F.struct(F.greatest(F.lit(2), w - w % 2).alias("w"), F.greatest(F.lit(2), h - h % 2).alias("h"))


def output_size(crop: Column, aspect: Column, base: int = 1080) -> Column:
    """struct(w, h): the usual size of the ratio, within 2 %, else one scaled from the crop."""
    usual = F.coalesce(*[F.when(F.abs(aspect - a) / a < 0.02, F.struct(F.lit(w).cast("bigint").alias("w"), F.lit(h).cast("bigint").alias("h"))) for a, w, h in SIZES])
    tall = crop["w"] <= crop["h"]
    w = F.when(tall, F.lit(base)).otherwise(F.rint(base * crop["w"] / crop["h"])).cast("bigint")
    h = F.when(tall, F.rint(base * crop["h"] / crop["w"])).otherwise(F.lit(base)).cast("bigint")
    return F.coalesce(usual, F.struct((w - w % 2).alias("w"), (h - h % 2).alias("h")))


def segments(entries: DataFrame, key: str, i: str) -> DataFrame:
    """Runs of clips joined by transitions: a cut starts a new one -> entries with segment. A key has any number of
    clips; i is a number."""
    c = Chunks(entries, key, i)
    cuts = F.sum(F.when((F.col("transition_type") == "cut") | (F.col("transition_duration") <= 0), 1).otherwise(0))
    found = c.before(c.df, _before=(cuts, "sum"))
    return found.withColumn("segment", cuts.over(c.w.orderBy(i)) + F.coalesce("_before", F.lit(0))).drop("_before", "_chunk")


def xfade_offsets(entries: DataFrame, key: str, i: str) -> DataFrame:
    """entries(key, segment, i, duration, transition_duration) -> with offset, where each clip's transition starts.

    A segment is a few clips of one video, folded in order: a transition is at most nine tenths of either side."""
    one = "struct<i:bigint,offset:double,length:double>"
    rows = entries.groupBy(key, "segment").agg(F.array_sort(F.collect_list(F.struct(F.col(i).cast("bigint").alias("i"), F.col("duration").cast("double").alias("d"), F.col("transition_duration").cast("double").alias("x")))).alias("c"))
    start = F.struct(F.lit(0.0).alias("acc"), F.array().cast(f"array<{one}>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        first = F.size(s["out"]) == 0
        length = F.greatest(F.lit(0.05), F.least(c["x"], 0.9 * F.least(c["d"], s["acc"])))
        at = s["acc"] - length
        at = F.when(at < 0, F.greatest(F.lit(0.1), s["acc"] * 0.5)).otherwise(at)
        acc = F.when(first, c["d"]).otherwise(at + c["d"])
        made = F.struct(c["i"].alias("i"), F.when(~first, at).alias("offset"), F.when(~first, length).alias("length")).cast(one)
        return F.struct(acc.cast("double").alias("acc"), F.array_append(s["out"], made).alias("out"))

    return rows.select(key, "segment", F.inline(F.aggregate("c", start, step)["out"]))


def harmonise(clips: DataFrame, luma: str, strength: float = 0.5) -> DataFrame:
    """clips with brightness: towards the mean luma of all, null where it is closer than 2."""
    mean = clips.agg(F.avg(luma).alias("_m"))
    diff = F.col("_m") - F.col(luma)
    return clips.crossJoin(F.broadcast(mean)).withColumn("brightness", F.when(F.abs(diff) >= 2, diff * strength / 255)).drop("_m")  # one row


def mixer_chain(tracks: DataFrame) -> DataFrame:
    """tracks(i, start_ms, gain_db, windows, duck_db) -> i, chain: the filter chain of each, windows as text a..b."""
    ms = F.col("start_ms").cast("string")
    parts = F.array(
        F.when(F.col("start_ms") > 0, F.concat(F.lit("adelay="), ms, F.lit("|"), ms)),
        F.when(F.col("gain_db") != 0, F.concat(F.lit("volume="), F.col("gain_db").cast("string"), F.lit("dB"))),
        F.when((F.col("windows") != "") & (F.col("duck_db") < 0), F.concat(F.lit("volume=enable='"), F.col("windows"), F.lit("':volume="), F.col("duck_db").cast("string"), F.lit("dB"))),
        F.lit("aformat=sample_fmts=fltp:sample_rates=44100:channel_layouts=stereo"),
    )
    n = F.col("i").cast("string")
    return tracks.select("i", F.concat(F.lit("["), n, F.lit(":a]"), F.array_join(F.array_compact(parts), ","), F.lit("[t"), n, F.lit("]")).alias("chain"))
