"""Parsing and formatting of single values, and what a prompt changes in the settings."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

from .text import COLOR_WORDS, first_match

#: File-name suffixes of aspect ratios, in order (fixed values).
SUFFIXES = [(16 / 9, "16x9"), (9 / 16, "9x16"), (1.0, "1x1"), (4 / 3, "4x3"), (3 / 4, "3x4"), (4 / 5, "4x5"), (21 / 9, "21x9"), (2.35, "235x100")]
#: Shot densities: gap between shots in seconds, and shots of a source (fixed values).
DENSITIES = {"standard": (1.0, 15), "dense": (0.5, 25), "max": (0.0, 40)}
#: Names of languages (fixed values).
LANGUAGES = {"zh": "中文", "zh-cn": "简体中文", "zh-tw": "繁体中文", "en": "英文", "ja": "日文", "ko": "韩文", "es": "西班牙文", "fr": "法文", "de": "德文", "ru": "俄文", "pt": "葡萄牙文", "it": "意大利文", "ar": "阿拉伯文"}
#: Noise strengths of film grains (fixed values).
GRAINS = {"fine": 8, "medium": 12, "coarse": 18, "35mm": 10, "16mm": 15, "8mm": 22}
#: Tempo words of a prompt, in order (fixed values).
TEMPO_WORDS = [("intense", ["快", "fast", "rapid", "intense", "高燃", "激烈", "动作"]), ("calm", ["慢", "slow", "calm", "平静", "舒缓", "冥想"])]


def safe_float(text: Column, default: float) -> Column:
    """A finite number, else the default."""
    x = F.trim(text).try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def parse_ratio(text: Column, default: float = 9 / 16) -> Column:
    """The ratio of "a:b" or of a positive number, else the default."""
    t = F.trim(F.coalesce(text, F.lit("")))
    a, b = F.regexp_extract(t, "^([^:]*):", 1).try_cast("double"), F.regexp_extract(t, "^[^:]*:(.*)$", 1).try_cast("double")
    pair = F.when(b != 0, a / b)
    plain = t.try_cast("double")
    return F.coalesce(F.when(F.contains(t, F.lit(":")), pair).when(plain > 0, plain), F.lit(default))


def ratio_suffix(ratio: Column, default: float = 9 / 16) -> Column:
    """File-name suffix of a ratio: a usual one within 0.001, else its decimals with p for the point."""
    r = F.when(ratio.isNull() | F.isnan(ratio) | (ratio <= 0) | (ratio == float("inf")), F.lit(default)).otherwise(ratio)
    usual = F.coalesce(*[F.when(F.abs(r - a) < 1e-3, F.lit(label)) for a, label in SUFFIXES])
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", r), "0+$", ""), r"\.$", "")
    return F.concat(F.lit("_"), F.coalesce(usual, F.replace(text, F.lit("."), F.lit("p"))))


def safe_name(title: Column, kind: str = "title") -> Column:
    """A file name: of a title (60 characters), a quote (30) or the last part of an address (40)."""
    if kind == "quote":
        return F.replace(F.trim(F.regexp_replace(F.left(title, F.lit(30)), r"(?U)[^\w\s-]", "")), F.lit(" "), F.lit("_"))
    if kind == "address":
        return F.left(F.regexp_replace(F.element_at(F.split(title, "/"), -1), r"(?U)[^\w]", "_"), F.lit(40))
    return F.left(F.regexp_replace(title, r"[<>:\"/\\|?*]", "_"), F.lit(60))


def stamped_text(line: Column) -> list[Column]:
    """Seconds and text of "01:02:39 text"; null where the line has no stamp."""
    part = lambda i: F.regexp_extract(line, r"(\d{2}):(\d{2}):(\d{2})\s+(.*)", i)
    seconds = part(1).try_cast("double") * 3600 + part(2).try_cast("double") * 60 + part(3).try_cast("double")
    return [seconds.alias("seconds"), F.when(seconds.isNotNull(), part(4)).alias("text")]


def language_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(F.coalesce(code, F.lit("")))), code, F.lit(""))


def minutes_seconds(seconds: Column) -> Column:
    """M:SS, truncated."""
    whole = F.floor(seconds)
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def stamp_text(epoch: Column) -> Column:
    """Month, day and time of seconds since 1970, in the session's time zone; - for none."""
    return F.when(F.coalesce(epoch, F.lit(0.0)) == 0, F.lit("-")).otherwise(F.date_format(F.timestamp_seconds(epoch), "MM-dd HH:mm:ss"))


def linear_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def task_progress(percent: Column) -> Column:
    """A run's own 0..100 as the task's 30..85."""
    return F.greatest(F.lit(30), F.least(F.lit(85), (30 + percent * 0.55).cast("int")))


def denoise_filter(temporal: Column, spatial: Column, chroma: Column) -> Column:
    return F.format_string("hqdn3d=%.1f:%.1f:%.1f:%.1f", spatial * 8, chroma * 6, temporal * 6, chroma * temporal * 4)


def sharpen_filter(amount: Column, radius: Column) -> Column:
    size = F.greatest(F.lit(3), F.least(F.lit(23), (radius * 2).cast("int") * 2 + 1))
    return F.format_string("unsharp=%d:%d:%.2f:%d:%d:%.2f", size, size, amount * 2, size, size, amount)


def grain_filter(kind: Column, intensity: Column) -> Column:
    strengths = F.create_map(*[F.lit(x) for kv in GRAINS.items() for x in kv])
    return F.format_string("noise=c0s=%d:c0f=t+u:allf=t+u", (F.coalesce(F.try_element_at(strengths, kind), F.lit(8)) * intensity).cast("int"))


def scale_eq(chain: Column, intensity: Column) -> Column:
    """A filter chain with its saturation, contrast and brightness values drawn towards neutral; negative ones stay."""
    number = r"(saturation|contrast|brightness)=(?=[0-9.])"
    parts = F.split(F.regexp_replace(chain, number, "\u0001$1=\u0002"), "\u0001")

    def one(x: Column) -> Column:
        name, rest = F.regexp_extract(x, "^([a-z]+)=\u0002", 1), F.regexp_extract(x, "^[a-z]+=\u0002[0-9.]+(.*)$", 1)
        v = F.regexp_extract(x, "^[a-z]+=\u0002([0-9.]+)", 1).try_cast("double")
        scaled = F.when(name == "brightness", F.format_string("%.3f", v * intensity)).otherwise(F.format_string("%.2f", 1 + (v - 1) * intensity))
        return F.when(v.isNull(), x).otherwise(F.concat(name, F.lit("="), scaled, rest))

    return F.array_join(F.transform(parts, one), "")


def density_gap(density: Column) -> Column:
    """struct(gap, most) of a shot density; that of standard for others."""
    of = lambda k: F.struct(F.lit(DENSITIES[k][0]).alias("gap"), F.lit(DENSITIES[k][1]).alias("most"))
    return F.when(density == "dense", of("dense")).when(density == "max", of("max")).otherwise(of("standard"))


def overlay(user: Column, parsed: Column, default) -> Column:
    """The prompt's value where the user has left the default, else the user's."""
    return F.when((user == F.lit(default)) & parsed.isNotNull(), parsed).otherwise(user)


def default_instructions(prompt: Column) -> Column:
    """Editing instructions without a model: tempo and colours from the prompt, the rest fixed."""
    t = F.lower(F.coalesce(prompt, F.lit("")))
    tempo, color = F.coalesce(first_match(t, TEMPO_WORDS), F.lit("dynamic")), F.coalesce(first_match(t, COLOR_WORDS), F.lit("neutral"))
    return F.struct(
        F.struct(F.lit("documentary").alias("name"), F.lit("calm").alias("mood")).alias("style"),
        F.struct(tempo.alias("speed"), F.lit("moderate").alias("variation"), F.lit(8).alias("intro_duration_beats"), F.lit(0.8).alias("climax_intensity")).alias("pacing"),
        F.struct(F.lit("cut").alias("type"), F.lit(0.5).alias("crossfade_duration_sec")).alias("transitions"),
        F.struct(color.alias("color_grading"), F.lit(True).alias("stabilization"), F.lit(False).alias("sharpness_boost")).alias("effects"),
        F.struct(F.lit(1.0).alias("min_clip_duration_sec"), F.lit(8.0).alias("max_clip_duration_sec")).alias("constraints"),
    )


def under_roots(path: Column, roots: list[str]) -> Column:
    """Whether a path lies inside one of the folders, without .. in it."""
    inside = [F.startswith(path, F.lit(r.rstrip("/") + "/")) for r in roots]
    out = F.lit(False)
    for x in inside:
        out = out | x
    return out & ~F.regexp_like(path, F.lit(r"(^|/)\.\.(/|$)"))


def wrapped(text: Column, size: float, width: float) -> Column:
    """array<string>: lines no wider than width, filled character by character; a line break starts a new one."""
    from .text import text_width

    lines = "array<string>"

    def fill(out: Column, c: Column) -> Column:
        trial = F.concat(F.element_at(out, -1), c)
        wide = (text_width(trial) * size > width) & (F.element_at(out, -1) != "")
        return F.when(wide, F.array_append(out, c)).otherwise(F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), trial))

    each = lambda p: F.aggregate(F.filter(F.split(p, ""), lambda c: c != ""), F.array(F.lit("")).cast(lines), fill)
    return F.flatten(F.transform(F.split(text, "\n"), each))
