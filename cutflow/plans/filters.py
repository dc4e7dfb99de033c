"""Filter text and command lines that a renderer is given: one text a row, decoding and encoding stay outside."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions.details import escape_drawtext
from ..functions.values import safe_float
from .render import atempo

#: The renderer's transition for each of ours that isn't its own name; others unknown become fade (fixed values).
XFADES = {"wipe": "wipeleft", **dict.fromkeys(["flash", "zoom", "blur", "motion_blur", "circlecrop", "rectcrop", "fadeblack", "shake"], "fade")}
#: Transitions the renderer knows by the same name (fixed values).
PLAIN = "fade dissolve wipeleft wiperight wipeup wipedown slideleft slideright slideup slidedown smoothleft smoothright smoothup smoothdown circleopen circleclose diagtl diagtr diagbl diagbr vertopen vertclose horzopen horzclose radial pixelize distance fadewhite hlslice hrslice vuslice vdslice".split()
#: Steadying profiles: shakiness, accuracy, smoothing (fixed values).
STEADY = {"vlog_action": (8, 12, 30), "documentary": (6, 10, 20), "cinematic": (4, 8, 10), "extreme": (10, 15, 40)}
#: Filter chains of colour presets (fixed values).
GRADES = {"natural": "eq=saturation=1.02:contrast=1.01", "warm": "eq=contrast=1.05:brightness=0.05:saturation=1.1", "cool": "eq=contrast=1.05:brightness=-0.05:saturation=1.1", "vibrant": "eq=saturation=1.25:contrast=1.1,unsharp=3:3:0.4", "desaturated": "eq=saturation=0.75:contrast=1.05", "documentary": "eq=saturation=1.0:contrast=1.02,unsharp=3:3:0.3"}
LONGEST, SHORTEST = 0.08, 0.03  # seconds of a transition


def _number(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))


def xfade_name(kind: Column) -> Column:
    other = F.create_map(*[F.lit(x) for kv in XFADES.items() for x in kv])
    return F.when(kind.isin(PLAIN), kind).otherwise(F.coalesce(F.try_element_at(other, kind), F.lit("fade")))


def demoted(entries: DataFrame, key: str, i: str) -> DataFrame:
    """entries(key, i, transition_type, transition_duration, ...) with too short transitions made cuts, and tail: the
    seconds that a clip is prepared longer for the transition into the next one. A video's first entry is left as it is."""
    w = Window.partitionBy(key).orderBy(i)
    seconds = F.least(F.greatest(F.coalesce("transition_duration", F.lit(0.0)), F.lit(0.0)), F.lit(LONGEST))
    short = (F.row_number().over(w) > 1) & (F.col("transition_type") != "cut") & (seconds < SHORTEST)
    out = entries.withColumn("_short", short)
    out = out.withColumns({"transition_type": F.when(F.col("_short"), F.lit("cut")).otherwise(F.col("transition_type")), "transition_duration": F.when(F.col("_short"), F.lit(0.0)).otherwise(F.col("transition_duration"))})
    own = F.when(F.col("transition_type") != "cut", F.col("transition_duration")).otherwise(F.lit(0.0))
    return out.withColumn("tail", F.coalesce(F.lead(own).over(w), F.lit(0.0))).drop("_short")


def existing(entries: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Entries whose path is not empty and stands in files(path)."""
    return entries.where(F.coalesce(F.col(path), F.lit("")) != "").join(files.select(F.col("path").alias(path)), path, "left_semi")


def clip_filter(duration: Column, picture: Column, speed: Column, width: int = 1280, height: int = 720) -> Column:
    """Picture filters of a clip: rate, speed, size, and its last frame held where the picture is too short."""
    scale = f"scale={width}:{height}:force_original_aspect_ratio=decrease,pad={width}:{height}:(ow-iw)/2:(oh-ih)/2:color=black"
    missing = duration - F.when(speed > 0, picture / speed).otherwise(picture)
    held = F.when(missing > 0.02, F.concat(F.lit(",tpad=stop_mode=clone:stop_duration="), _number(missing + 0.10, 3))).otherwise(F.lit(""))
    pts = F.when(speed != 1.0, F.concat(F.lit("setpts="), _number(1 / speed, 6), F.lit("*PTS,"))).otherwise(F.lit(""))
    return F.concat(F.lit("fps=30,"), pts, F.lit(scale), held)


def cut_command(source: Column, start: Column, end: Column, target: Column) -> Column:
    """The command that cuts a shot out of its source, frame by frame."""
    return F.concat(F.lit("ffmpeg -y -ss "), _number(start, 3), F.lit(" -i "), source, F.lit(" -t "), _number(end - start, 3), F.lit(" -c:v libx264 -crf 18 -preset veryfast -pix_fmt yuv420p -c:a aac -b:a 192k -avoid_negative_ts make_zero "), target)


def keep_parts(ranges: DataFrame, key: str, stem: str) -> DataFrame:
    """ranges(key, a, b) -> key, i, command: what cuts the parts of a source that stay."""
    i = F.row_number().over(Window.partitionBy(key).orderBy("a")) - 1
    text = F.concat(F.lit("ffmpeg -y -v error -ss "), _number(F.col("a"), 3), F.lit(f" -i {stem}"), F.col(key).cast("string"), F.lit(".mp4 -t "), _number(F.col("b") - F.col("a"), 3), F.lit(" -c:v libx264 -crf 18 -preset fast -pix_fmt yuv420p -c:a aac -b:a 192k -ar 44100 -ac 2 part_"), F.col("i").cast("string"), F.lit(".mp4"))
    return ranges.withColumn("i", i).select(key, "i", text.alias("command"))


def next_margin(still_black: Column, margin: Column) -> Column:
    """The margin of another try, where the cleaned source still has black and the margin is below 0.3; else null."""
    return F.when(still_black & (margin < 0.30), margin + 0.10)


def loudness_filter(stats: Column, target: float = -14.0) -> Column:
    """The second pass of loudness normalisation, from the first one's JSON; one pass for silence or without numbers."""
    get = lambda name, default: safe_float(F.get_json_object(stats, f"$.{name}"), default)
    names = [("measured_I", "input_i", -14.0), ("measured_TP", "input_tp", -1.5), ("measured_LRA", "input_lra", 11.0), ("measured_thresh", "input_thresh", -24.0), ("offset", "target_offset", 0.0)]
    base = f"loudnorm=I={target}:TP=-1.5:LRA=11"
    measured = F.concat(F.lit(base), *[F.concat(F.lit(f":{n}="), get(k, v).cast("string")) for n, k, v in names], F.lit(":linear=true"))
    return F.concat(F.when(get("input_i", -14.0) <= -70, F.lit(base)).otherwise(measured), F.lit(",afade=t=in:st=0:d=0.03"))


def cue_mix(cues: DataFrame, key: str) -> DataFrame:
    """cues(key, t, gain_db), a bounded list a clip -> key, filter: every cue delayed and mixed with the clip's sound."""
    i = F.row_number().over(Window.partitionBy(key).orderBy("t", "gain_db")) - 1
    n = F.col("i").cast("string")
    ms = F.greatest(F.lit(0), (F.col("t") * 1000).cast("int"))
    rows = cues.withColumn("i", i)
    part = F.concat(F.lit("["), (F.col("i") + 1).cast("string"), F.lit(":a]adelay="), ms.cast("string"), F.lit(":all=1,volume="), F.col("gain_db").cast("string"), F.lit("dB[sfx"), n, F.lit("]"))
    ordered = F.array_sort(F.collect_list(F.struct("i", part.alias("p"), F.concat(F.lit("[sfx"), n, F.lit("]")).alias("l"))))
    joined = rows.groupBy(key).agg(ordered.alias("x"))
    text = lambda f, mark: F.array_join(F.transform("x", lambda r: r[f]), mark)
    return joined.select(key, F.concat(text("p", ";"), F.lit(";[0:a]"), text("l", ""), F.lit("amix=inputs="), (F.size("x") + 1).cast("string"), F.lit(":duration=first:normalize=0[aout]")).alias("filter"))


def narration_mix(seconds: Column, voice_db: Column, music_db: Column, duck_db: float = -9.0) -> Column:
    duck = F.when(seconds > 0, F.concat(F.lit(",volume=enable='between(t,0,"), _number(seconds, 3), F.lit(f")':volume={duck_db}dB"))).otherwise(F.lit(""))
    return F.concat(F.lit("[0:a]volume="), music_db.cast("string"), F.lit("dB"), duck, F.lit("[bgm];[1:a]volume="), voice_db.cast("string"), F.lit("dB[vo];[bgm][vo]amix=inputs=2:duration=first:normalize=0[aout]"))


def duck_expression(windows: DataFrame, key: str, level_db: float) -> DataFrame:
    """windows(key, a, b), a bounded list -> key, expression: the gain inside any of them, 1 outside."""
    between = F.concat(F.lit("between(t,"), _number(F.col("a"), 3), F.lit(","), _number(F.col("b"), 3), F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct("a", between.alias("x"))))
    gain = f"{10 ** (level_db / 20):.4f}"
    return windows.groupBy(key).agg(F.concat(F.lit("volume='if("), F.array_join(F.transform(ordered, lambda r: r["x"]), "+"), F.lit(f",{gain},1)':eval=frame")).alias("expression"))


def caption_filter(text: Column, a: Column, b: Column, size: Column, color: str = "white") -> Column:
    """A caption drawn in the middle near the lower edge while it lasts."""
    return F.concat(F.lit("drawtext=text='"), escape_drawtext(text), F.lit("':fontsize="), size.cast("string"), F.lit(f":fontcolor={color}:borderw=2:bordercolor=black:x=(w-text_w)/2:y=h-80:enable='between(t,"), _number(a, 3), F.lit(","), _number(b, 3), F.lit(")'"))


def static_crop(width: Column, height: Column, crop: Column) -> Column:
    """A crop from the middle."""
    x, y = F.floor((width - crop["w"]) / 2), F.floor((height - crop["h"]) / 2)
    return F.format_string("crop=%d:%d:%d:%d", crop["w"], crop["h"], x, y)


def pixel_track(points: DataFrame, crop_w: int, crop_h: int, width: int, height: int) -> DataFrame:
    """points(cx, cy in [0, 1]) with x, y: the crop's upper left corner around the subject, inside the picture."""
    at = lambda c, size, crop: F.least(F.lit(max(0.0, float(size - crop))), F.greatest(F.lit(0.0), F.col(c) * size - crop / 2))
    return points.withColumns({"x": at("cx", width, crop_w), "y": at("cy", height, crop_h)})


def increasing(points: DataFrame, key: str, order: str, t: str) -> DataFrame:
    """Points in order, without those that are not later than all before them."""
    before = F.max(t).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return points.withColumn("_b", before).where(F.col("_b").isNull() | (F.col(t) > F.col("_b"))).drop("_b")


def key_frames(points: DataFrame, key: str, t: str, most: int = 60) -> DataFrame:
    """At most `most` points of each key, evenly from the first to the last (places rounded half to even)."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(t)) - 1
    rows = points.withColumns({"_i": place, "_n": F.count("*").over(Window.partitionBy(key))})
    at = lambda k: F.rint(k * (F.col("_n") - 1) / (most - 1))
    near = F.rint(F.col("_i") * (most - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = (at(near) == F.col("_i")) | (at(near - 1) == F.col("_i")) | (at(near + 1) == F.col("_i"))
    return rows.where((F.col("_n") <= most) | hit).drop("_i", "_n")


def steady_filter(profile: Column) -> Column:
    of = lambda k: F.format_string("vidstabdetect=shakiness=%d:accuracy=%d|smoothing=%d:zoom=5:interpol=bicubic", *map(F.lit, STEADY[k]))
    return F.coalesce(*[F.when(profile == k, of(k)) for k in STEADY], of("documentary"))


def grade_filter(preset: Column) -> Column:
    """The filter chain of a colour preset; empty for none and unknown ones."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in GRADES.items() for x in kv]), preset), F.lit(""))


def speed_filter(segments: DataFrame, key: str) -> DataFrame:
    """segments(key, step, a, b, speed), a bounded list a clip -> key, filter: each cut, sped and joined again."""
    n = F.col("step").cast("string")
    cut = F.concat(F.lit("trim=start="), _number(F.col("a"), 4), F.lit(":end="), _number(F.col("b"), 4))
    tempo = F.array_join(F.transform(atempo(F.col("speed")), lambda x: F.concat(F.lit("atempo="), F.format_string("%.4f", x))), ",")
    part = F.concat(F.lit("[0:v]"), cut, F.lit(",setpts=(PTS-STARTPTS)/"), _number(F.col("speed"), 6), F.lit("[v"), n, F.lit("];[0:a]a"), cut, F.lit(",asetpts=PTS-STARTPTS,"), tempo, F.lit("[a"), n, F.lit("]"))
    label = F.concat(F.lit("[v"), n, F.lit("][a"), n, F.lit("]"))
    ordered = F.array_sort(F.collect_list(F.struct("step", part.alias("p"), label.alias("l"))))
    text = lambda f, mark: F.array_join(F.transform("x", lambda r: r[f]), mark)
    return segments.groupBy(key).agg(ordered.alias("x")).select(key, F.concat(text("p", ";"), F.lit(";"), text("l", ""), F.lit("concat=n="), F.size("x").cast("string"), F.lit(":v=1:a=1[outv][outa]")).alias("filter"))


def proxy_command(source: Column, start: Column, width: int = 480, crf: int = 32, mute: bool = False) -> Column:
    """The command that makes a small preview of a source."""
    seek = F.when(start > 0, F.concat(F.lit(" -ss "), _number(start, 3))).otherwise(F.lit(""))
    sound = " -an" if mute else " -c:a aac -b:a 64k"
    return F.concat(F.lit("ffmpeg -y"), seek, F.lit(" -i "), source, F.lit(f" -vf scale='min({width},iw)':-2 -c:v libx264 -crf {crf} -preset veryfast -pix_fmt yuv420p{sound}"))
