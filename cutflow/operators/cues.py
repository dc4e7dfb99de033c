"""Sound cues on beats."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

#: Share of beats that get a cue, gains in dB, and the riser's lead in seconds (fixed values).
DENSITY = {"intense": 0.75, "dynamic": 0.5, "calm": 0.25}
GAIN = {"impact": -5.0, "whoosh": -9.0, "click": -11.0, "riser": -14.0}
RISER_LEAD = 0.9


def plan(beats: DataFrame, key: str, duration: float, style: str = "dynamic", most: int = 16, cuts: DataFrame | None = None) -> DataFrame:
    """beats(key, t, beat_type, strength), cuts(key, t) -> key, t, kind, gain_db.

    Of each track: strong beats first, evenly over the clip; whooshes on every other cut; a riser before the strongest
    beat; of cues closer than 0.02 s the first stays. The last steps fold over the chosen cues, at most `most` and a few,
    and over the cuts inside the clip."""
    clip = beats.where((F.col("t") >= 0) & (F.col("t") < duration))
    strong = F.col("beat_type") == "strong"
    target = F.greatest(F.lit(2), F.least(F.floor(F.count("*") * DENSITY.get(style, 0.5)), F.lit(max(2, most - 4))))
    counts = clip.groupBy(key).agg(target.cast("int").alias("target"), F.count_if(strong).alias("n_strong"), F.count_if(~strong).alias("n_other"), F.max(F.struct(F.col("strength"), (-F.col("t")).alias("t"))).alias("peak"))
    rows = clip.withColumn("strong", strong).withColumn("k", F.row_number().over(Window.partitionBy(key, "strong").orderBy("t")) - 1).join(counts, key)
    taken = F.least("target", "n_strong")
    size = F.when(F.col("strong"), F.col("target")).otherwise(F.col("target") - taken)
    step = F.when(F.col("strong") & (F.col("n_strong") <= F.col("target")), F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.when(F.col("strong"), F.col("n_strong")).otherwise(F.col("n_other")) / F.greatest(size, F.lit(1)))))
    chosen = rows.where((F.col("k") % step == 0) & (F.col("k") / step < size)).withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("t")) - 1)  # at most `most` rows a track
    kind = F.when(F.col("strong"), F.when(F.col("i") % 3 == 2, F.lit("whoosh")).otherwise(F.lit("impact"))).otherwise(F.when(F.col("i") % 2 == 1, F.lit("whoosh")).otherwise(F.lit("click")))
    cue = "array<struct<t:double,kind:string>>"
    folded = chosen.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), kind.alias("kind")))).cast(cue).alias("cues"), F.first("peak").alias("peak"))
    if cuts is not None:
        numbered = cuts.withColumn("j", F.row_number().over(Window.partitionBy(key).orderBy("t")) - 1)
        inside = numbered.where((F.col("j") % 2 == 0) & F.col("t").between(0.15, duration - 0.15))
        placed = inside.groupBy(key).agg(F.array_sort(F.collect_list(F.col("t").cast("double"))).alias("cuts"))

        def add(s: Column, t: Column) -> Column:
            free = (s["n"] < 3) & (F.size(s["cues"]) < most) & F.forall(s["cues"], lambda c: F.abs(c["t"] - t) >= 0.15)
            return F.when(free, F.struct((s["n"] + 1).alias("n"), F.array_append(s["cues"], F.struct(t.alias("t"), F.lit("whoosh").alias("kind"))).alias("cues"))).otherwise(s)

        folded = folded.join(placed, key, "left").withColumn("cues", F.aggregate(F.coalesce("cuts", F.array().cast("array<double>")), F.struct(F.lit(0).alias("n"), F.col("cues")), add)["cues"])
    rise = -F.col("peak.t") - RISER_LEAD
    riser = F.when((F.size("cues") < most) & (rise > 0.3) & (rise < duration - 0.05), F.array(F.struct(rise.alias("t"), F.lit("riser").alias("kind")))).otherwise(F.array().cast(cue))
    ordered = F.array_sort(F.filter(F.concat("cues", riser), lambda c: (c["t"] >= 0) & (c["t"] < duration - 0.02)))
    kept = F.aggregate(ordered, F.array().cast(cue), lambda out, c: F.when((F.size(out) > 0) & (F.abs(c["t"] - F.element_at(out, -1)["t"]) < 0.02), out).otherwise(F.array_append(out, c)))
    gains = F.create_map(*[F.lit(x) for kv in GAIN.items() for x in kv])
    return folded.select(key, F.inline(F.slice(kept, 1, most))).select(key, "t", "kind", F.element_at(gains, F.col("kind")).alias("gain_db"))
