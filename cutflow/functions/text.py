"""Text rules and time codes as column expressions."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

#: Keyword rules of the effect prompt, in order of precedence (fixed values).
STYLE_RULES = [("intense", ["高燃", "热血", "战斗", "打斗", "动作", "爆炸", "燃", "amv", "踩点", "卡点"]), ("calm", ["丝滑", "柔和", "治愈", "唯美", "抒情", "慢节奏", "温柔"])]
SOUND_WORDS = ["音效", "打击", "impact", "whoosh", "卡点", "踩点", "鼓点"]
DENSITY_RULES = [("max", ["极密", "尽量多", "用满", "快剪", "高燃", "密集"]), ("dense", ["多一点", "密", "紧凑"])]
ANIME_WORDS = ["动漫", "动画", "二次元", "amv"]
MUTE_RULES = [("true", ["只留bgm", "只保留bgm", "静音原声", "去掉原声", "不要原声", "纯音乐"]), ("false", ["保留原声", "原声"])]
BLACK_WORDS = ["不要黑场", "无黑场", "去黑场", "去掉黑场", "不要黑屏"]
ASPECT_RULES = [("9/16", ["竖屏", "9:16", "9/16", "抖音", "tiktok"]), ("1/1", ["方形", "1:1", "1/1"]), ("4/5", ["4:5", "4/5", "小红书"])]

#: Style and mood words, in order (fixed values).
STYLE_WORDS = [
    ("hitchcock", ["hitchcock", "悬疑", "惊悚", "紧张", "thriller", "suspense", "tension"]),
    ("action", ["action", "动作", "爆炸", "高速", "blockbuster", "explosive", "adrenaline", "高燃"]),
    ("mtv", ["mtv", "音乐视频", "快节奏", "fast-paced", "energetic", "rapid"]),
    ("documentary", ["documentary", "纪录片", "真实", "realism", "natural", "观察"]),
    ("minimalist", ["minimalist", "艺术", "冥想", "平静", "contemplative", "长镜头", "慢节奏"]),
    ("wes_anderson", ["wes anderson", "对称", "symmetry", "pastel", "quirky", "复古文艺"]),
]
MOOD_STYLES = [("hitchcock", ["cinematic"]), ("hitchcock", ["电影感"]), ("hitchcock", ["史诗"]), ("documentary", ["专业"]), ("documentary", ["流畅"]), ("minimalist", ["画廊"]), ("wes_anderson", ["唯美"]), ("minimalist", ["艺术"])]
#: Colour words, in order (fixed values).
COLOR_WORDS = [
    ("teal_orange", ["teal and orange", "好莱坞", "hollywood", "blockbuster", "cinematic look", "橙青"]),
    ("warm", ["warm", "暖色", "golden", "sunset", "sunrise", "cozy", "autumn", "秋天"]),
    ("cool", ["cool", "冷色", "blue", "cold", "winter", "icy", "夜晚"]),
    ("vintage", ["vintage", "复古", "retro", "old film", "classic", "怀旧"]),
    ("noir", ["noir", "黑白", "black and white", "monochrome", "film noir", "侦探"]),
    ("vibrant", ["vibrant", "鲜艳", "saturated", "colorful", "pop", "vivid"]),
    ("desaturated", ["desaturated", "低饱和", "muted", "faded", "matte"]),
    ("golden_hour", ["golden hour", "magic hour", "黄金时刻", "sunset glow"]),
    ("blue_hour", ["blue hour", "twilight", "dusk", "蓝色时刻"]),
    ("high_contrast", ["high contrast", "高对比", "dramatic", "punchy", "bold"]),
    ("natural", ["natural", "自然", "true to life", "authentic", "realistic"]),
]
CHARS_PER_SECOND = 4.5


def has_any(text: Column, words: list[str]) -> Column:
    """Whether a lower-cased text holds one of the words."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def first_match(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Label of the first rule with a word in the text, else null."""
    return F.coalesce(*[F.when(has_any(text, words), F.lit(label)) for label, words in rules])


def effect_params(prompt: Column) -> list[Column]:
    """What a prompt asks for, a column each; null where it says nothing."""
    t = F.lower(F.trim(prompt))
    seconds = F.regexp_extract(t, r"(\d+(?:\.\d+)?)\s*(?:秒|s\b|sec)", 1)
    seconds = F.when(seconds != "", seconds.cast("double"))
    return [
        first_match(t, STYLE_RULES).alias("style"),
        F.when(has_any(t, SOUND_WORDS), F.lit(True)).alias("enable_sfx"),
        first_match(t, DENSITY_RULES).alias("shot_density"),
        F.when(has_any(t, ANIME_WORDS), F.lit(0.5)).alias("threshold"),
        F.when(seconds.between(2, 300), seconds).alias("target_duration"),
        first_match(t, MUTE_RULES).cast("boolean").alias("mute_source_audio"),
        F.when(has_any(t, BLACK_WORDS), F.lit(True)).alias("clean_black"),
        first_match(t, ASPECT_RULES).alias("aspect_ratio"),
    ]


def sentences(text: Column) -> Column:
    """Spoken lines of a script: trimmed, unquoted, without list numbers, split after sentence ends."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.btrim(F.trim(x), F.lit("\"'“”‘’")), r"^\d+[.、)]\s*", ""))
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[。！？!?])")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def read_seconds(text: Column) -> Column:
    """Estimated time to read a text aloud, to hundredths."""
    return F.floor(F.char_length(F.regexp_replace(text, r"\s", "")) / CHARS_PER_SECOND * 100 + 0.5) / 100


def _clock(seconds: Column) -> tuple[Column, Column, Column]:
    whole = F.floor(seconds)
    return F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60))


def _pad(x: Column, n: int = 2) -> Column:
    return F.lpad(x.cast("bigint").cast("string"), n, "0")


def srt_time(seconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm, everything truncated; with mark "." the WebVTT form."""
    h, m, s = _clock(seconds)
    return F.concat(_pad(h), F.lit(":"), _pad(m), F.lit(":"), _pad(s), F.lit(mark), _pad(F.floor((seconds - F.floor(seconds)) * 1000), 3))


def ass_time(seconds: Column) -> Column:
    """H:MM:SS.cc, rounded half to even."""
    cs = F.rint(F.greatest(seconds, F.lit(0.0)) * 100).cast("bigint")
    return F.concat(F.floor(cs / 360000).cast("string"), F.lit(":"), _pad(F.floor(F.pmod(cs, F.lit(360000)) / 6000)), F.lit(":"), _pad(F.floor(F.pmod(cs, F.lit(6000)) / 100)), F.lit("."), _pad(F.pmod(cs, F.lit(100))))


def timecode(seconds: Column, fps: float = 30.0) -> Column:
    """HH:MM:SS:FF without dropped frames, truncated."""
    h, m, s = _clock(seconds)
    return F.concat(_pad(h), F.lit(":"), _pad(m), F.lit(":"), _pad(s), F.lit(":"), _pad(F.floor((seconds - F.floor(seconds)) * fps)))


def clock_seconds(text: Column) -> Column:
    """Seconds of M:SS or H:MM:SS, else 0."""
    p = F.transform(F.split(text, ":"), lambda x: x.try_cast("double"))
    n = F.size(p)
    return F.coalesce(F.when(n == 2, p[0] * 60 + p[1]).when(n == 3, p[0] * 3600 + p[1] * 60 + F.get(p, F.lit(2))), F.lit(0.0))


def strip_html(text: Column) -> Column:
    """Text without tags, with the common character references decoded."""
    out = F.regexp_replace(text, r"<[^>]+>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def text_width(text: Column) -> Column:
    """Width in em: 1 for wide characters (beyond U+2E80), else a half."""
    wide = F.char_length(F.regexp_replace(text, "[\\x{0}-\\x{2E80}]", ""))
    return wide * 1.0 + (F.char_length(text) - wide) * 0.5


def fitting_font(em: Column, width: int, size: int = 48) -> Column:
    """Font size at which a text of so many em fits nine tenths of a width: the usual one or less, 16 at least."""
    limit = width * 0.9
    return F.when(em * size > limit, F.greatest(F.lit(16), F.floor(size * (limit / (em * size))).cast("int"))).otherwise(F.lit(size)).cast("int")
