"""Beat analysis and beat-quantised scheduling of music tracks."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions.details import pick_transition, transition_seconds

#: Tempo styles (fixed values): beats for strong, normal and weak beats, speeds and their range.
STYLES = {
    "dynamic": {"strong": (1, 2), "normal": (2, 3), "weak": (3, 4), "range": (0.85, 1.15), "strong_speed": 0.9, "weak_speed": 1.1},
    "calm": {"strong": (2, 3), "normal": (3, 4), "weak": (4, 6), "range": (0.9, 1.1), "strong_speed": 0.95, "weak_speed": 1.05},
    "intense": {"strong": (1, 1), "normal": (1, 2), "weak": (2, 3), "range": (0.8, 1.2), "strong_speed": 0.85, "weak_speed": 1.15},
}
#: Transitions of a style without a pattern, on strong and on other beats (fixed values).
TRANSITIONS = {"dynamic": (["cut", "fade", "flash"], ["cut", "dissolve"]), "calm": (["fade", "dissolve"], ["dissolve", "fade"]), "intense": (["flash", "zoom", "cut"], ["cut"])}
#: Transitions that darken the picture (fixed values); fade stands in for them.
DARKENING = ["fadeblack", "flash", "blur", "motion_blur", "shake", "circlecrop", "rectcrop", "zoom"]


def classify(beats: DataFrame, key: str) -> DataFrame:
    """beats(key, idx, t, onset, energy) with beat_type and strength: strong if onset or energy is well above its median
    over the track."""
    med = beats.groupBy(key).agg(F.median("onset").alias("med"), F.median("energy").alias("loud"))
    strong = (F.col("onset") > 1.2 * F.col("med")) | F.coalesce(F.col("energy") > 1.3 * F.col("loud"), F.lit(False))
    strength = F.least(F.col("onset") / (F.col("med") + 1e-8), F.lit(2.0)) / 2
    return beats.join(med, key).select(key, "idx", "t", "onset", F.when(strong, F.lit("strong")).otherwise(F.lit("normal")).alias("beat_type"), strength.alias("strength"))


def upper_median_interval(beats: DataFrame, key: str) -> DataFrame:
    """key, interval: the upper median of the distances of neighbouring beats; 0.5 below two beats."""
    d = beats.select(key, (F.lead("t").over(Window.partitionBy(key).orderBy("t")) - F.col("t")).alias("d"))
    ranked = d.select(key, "d", F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last("d"))).alias("r"), F.count("d").over(Window.partitionBy(key)).alias("n"))
    return ranked.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("d"))), F.lit(0.5)).alias("interval"))


def align_music(beats: DataFrame, key: str) -> DataFrame:
    """beats shifted so that the first one of a track is at 0, if it is later than 0.05."""
    first = beats.groupBy(key).agg(F.min("t").alias("first"))
    off = F.when(F.col("first") > 0.05, F.col("first")).otherwise(F.lit(0.0))
    return beats.join(first, key).select(key, "idx", F.greatest(F.col("t") - off, F.lit(0.0)).alias("t"), off.alias("shift"))


def beat_count(score: Column, beat_type: Column, style: dict) -> Column:
    """How many beats a shot lasts: fewer for better shots, bounds by the kind of beat it starts on."""
    lo = F.when(beat_type == "strong", F.when(score > 0.7, F.lit(style["strong"][0])).otherwise(F.lit(style["strong"][0] + 1))).when(beat_type == "weak", F.lit(style["weak"][0])).otherwise(F.lit(style["normal"][0]))
    hi = F.when(beat_type == "strong", F.when(score > 0.7, F.lit(style["strong"][1])).otherwise(F.lit(style["strong"][1] + 1))).when(beat_type == "weak", F.lit(style["weak"][1])).otherwise(F.lit(style["normal"][1]))
    return F.when((lo == hi) | (score > 0.6), lo).when(score > 0.3, F.floor((lo + hi) / 2).cast("int")).otherwise(hi)


def shot_speed(score: Column, beat_type: Column, style: dict) -> Column:
    strong = beat_type == "strong"
    base = F.when(strong, F.lit(style["strong_speed"])).otherwise(F.lit(style["weak_speed"]))
    base = base + F.when(score > 0.7, F.when(strong, F.lit(0.05)).otherwise(F.lit(-0.05))).otherwise(F.lit(0.0))
    lo, hi = style["range"]
    return F.least(F.greatest(base, F.lit(lo)), F.lit(hi))


def without_black(kind: Column) -> Column:
    """The transition, or fade for one that darkens the picture."""
    return F.when(kind.isin(DARKENING), F.lit("fade")).otherwise(kind)


def transition(style: str, pattern: str | None, beat_type: Column, motion: Column, key: Column) -> Column:
    """struct(type, ratio): the transition into a shot, chosen by key, and its length as a share of the beat interval."""
    strong = beat_type == "strong"
    if pattern:
        found = pick_transition(pattern, strong, motion, key)
        return F.struct(without_black(found["type"]).alias("type"), F.when(strong, F.lit(_raw(pattern)[0])).otherwise(F.lit(_raw(pattern)[1])).alias("ratio"))
    at = lambda c: F.get(F.array(*map(F.lit, c)), F.pmod(key, F.lit(len(c))).cast("int"))
    on, off = TRANSITIONS.get(style, TRANSITIONS["dynamic"])
    return F.struct(without_black(F.when(strong, at(on)).otherwise(at(off))).alias("type"), F.lit(0.5).alias("ratio"))


def _raw(pattern: str) -> tuple[float, float]:
    from ..functions.details import PATTERNS

    return PATTERNS[pattern][2], PATTERNS[pattern][3]


def sync(shots: DataFrame, beats: DataFrame, key: str, style: str = "dynamic", pattern: str | None = None, most: int = 50) -> DataFrame:
    """shots(version, place, shot_id, duration, highlight_score), beats(key, idx, t, beat_type) -> timelines.

    Every version's shots, at most `most`, are laid on the beats of every track in order of place: one lasts a whole
    number of beats, no longer than its picture at the slowest speed allows. A shot without room is skipped and takes no
    beat. A timeline is one fold over its shots; the carried state is the current beat. Of a track only as many beats are
    needed as so many shots can last."""
    cfg = STYLES[style]
    slow = cfg["range"][0]
    reach = most * max(cfg["strong"][1] + 1, cfg["normal"][1], cfg["weak"][1]) + 1
    beat = "struct<idx:bigint,t:double,kind:string>"
    counts = beats.groupBy(key).agg(F.count("*").cast("int").alias("n"))
    music = beats.where(F.col("idx") < reach).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), F.col("t"), F.col("beat_type").alias("kind")))).cast(f"array<{beat}>").alias("beats"))
    clips = shots.groupBy("version").agg(F.array_sort(F.collect_list(F.struct(F.col("place"), F.col("shot_id"), F.col("duration").cast("double").alias("avail"), F.col("highlight_score").alias("score")))).alias("shots"))
    one = music.join(counts, key).join(upper_median_interval(beats, key), key).crossJoin(F.broadcast(clips))  # a few rows of at most `most` shots
    entry = "struct<shot_id:bigint,start_time:double,duration:double,speed:double,beats:int,kind:string>"
    state = F.struct(F.lit(0).cast("int").alias("cur"), F.array().cast(f"array<{entry}>").alias("out"))
    n = F.col("n")

    def length(cur: Column, count: Column) -> Column:
        return F.get("beats", F.least(cur + count, n - 1))["t"] - F.get("beats", cur)["t"]

    def step(s: Column, x: Column) -> Column:
        cur = s["cur"]
        kind = F.get("beats", cur)["kind"]
        fit = F.floor(x["avail"] / F.lit(max(0.1, slow)) / F.col("interval") + 1e-6).cast("int")
        count = F.least(beat_count(x["score"], kind, cfg), fit)
        first = F.when(length(cur, count) <= 0, count * F.col("interval")).otherwise(length(cur, count))
        roomy = lambda d: (d > 0) & (x["avail"] / d >= slow - 1e-4)
        # The longest count that the picture fills; shorter ones don't have the last beat's own rule.
        fewer = F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))), lambda k: (k < count) & ((length(cur, k) <= 0) | (x["avail"] / length(cur, k) >= slow - 1e-4))))
        taken = F.when(roomy(first), count).otherwise(F.when(count > 1, F.coalesce(fewer, F.lit(1))).otherwise(count))
        lasts = F.when(roomy(first), first).otherwise(length(cur, taken))
        good = (cur < n) & (fit >= 1) & roomy(lasts)
        speed = F.greatest(F.lit(slow), F.least(shot_speed(x["score"], kind, cfg), x["avail"] / lasts))
        made = F.struct(x["shot_id"].cast("long").alias("shot_id"), F.get("beats", cur)["t"].alias("start_time"), lasts.cast("double").alias("duration"), speed.cast("double").alias("speed"), taken.cast("int").alias("beats"), kind.alias("kind"))
        return F.when(good, F.struct((cur + taken).cast("int").alias("cur"), F.array_append(s["out"], made).alias("out"))).otherwise(s)

    laid = one.select(key, "version", "interval", F.aggregate("shots", state, step)["out"].alias("out")).select(key, "version", "interval", F.inline("out"))
    laid = laid.withColumn("x", transition(style, pattern, F.col("kind"), F.lit(0.0), F.col("shot_id")))
    seconds = transition_seconds(F.col("x.type"), F.col("interval"), F.col("x.ratio"))
    return laid.select(key, "version", "shot_id", "start_time", (F.col("start_time") + F.col("duration")).alias("end_time"), "duration", "speed", "beats", F.col("x.type").alias("transition_type"), seconds.alias("transition_duration"))


def closest_version(timelines: DataFrame, key: str, target: float) -> DataFrame:
    """timelines(key, version, duration, start_time if there is one) -> key, version, total, clips: for each track the version
    closest to the target. Versions can differ by the last bits of their totals only, so durations are summed in order of
    start, however the rows are dealt to tasks.

    Version 0 is what there is; the others are tried in order. One that is closer takes its place, and the first that
    reaches 95 % of the target is the last one tried. A track without a timeline of version 0 has no row."""
    ordered = F.array_sort(F.collect_list(F.struct(*[c for c in ("start_time", "duration") if c in timelines.columns])))
    total = F.aggregate(ordered, F.lit(0.0), lambda s, x: s + x["duration"])
    totals = timelines.groupBy(key, "version").agg(total.alias("total"), F.count("*").alias("clips"))
    item = "struct<version:int,total:double,clips:bigint>"
    tried = totals.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("version").cast("int").alias("version"), "total", "clips"))).cast(f"array<{item}>").alias("v")).where("v[0].version = 0")
    off = lambda x: F.abs(x["total"] - target)
    start = F.struct(F.get("v", F.lit(0)).alias("best"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        best = F.when(~s["done"] & (off(x) < off(s["best"])), x).otherwise(s["best"])
        return F.struct(best.alias("best"), (s["done"] | (x["total"] >= target * 0.95)).alias("done"))

    return tried.select(key, F.aggregate(F.slice("v", F.lit(2), F.size("v")), start, step)["best"].alias("b")).select(key, "b.version", "b.total", "b.clips")
