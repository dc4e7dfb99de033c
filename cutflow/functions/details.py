"""Smaller column functions: transition picks, script and subtitle text, quote lines."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

#: Transitions that suit fast motion (fixed values).
FAST = ["cut", "slideleft", "slideright", "wipeleft", "motion_blur", "flash"]
#: Transition patterns: strong and weak candidates, their duration ratios, and whether motion counts (fixed values).
PATTERNS = {
    "auto": (["cut", "fade", "flash", "zoom"], ["cut", "dissolve"], 0.3, 0.5, True),
    "hard_cut": (["cut"], ["cut"], 0.0, 0.0, False),
    "mtv_energy": (["flash", "zoom", "cut", "shake"], ["cut", "cut", "dissolve"], 0.25, 0.0, False),
    "cinematic_flow": (["dissolve", "fade", "fadeblack"], ["dissolve", "fade", "wipeleft"], 0.6, 0.8, False),
    "smooth_slide": (["slideleft", "slideright", "smoothleft"], ["dissolve", "wipeleft", "smoothright"], 0.4, 0.6, True),
    "action_whip": (["motion_blur", "slideleft", "cut", "wipeleft"], ["cut", "cut"], 0.2, 0.0, True),
    "dreamy_fade": (["circleopen", "radial", "fade"], ["dissolve", "circleclose", "pixelize"], 0.7, 0.9, False),
    "retro_wipe": (["diagtl", "diagbr", "rectcrop"], ["wipeleft", "dissolve", "fadeblack"], 0.5, 0.7, False),
    "vlog_gentle": (["fade", "dissolve"], ["fade", "dissolve", "wipeleft"], 0.5, 0.7, False),
    "random_mix": (["fade", "dissolve", "wipeleft", "slideleft", "circleopen", "radial", "flash", "zoom", "diagtl", "pixelize", "fadeblack"], ["cut", "dissolve", "fade", "wipeleft", "smoothleft"], 0.4, 0.6, False),
}
#: Template sentences of the offline script, after the first one that names the topic (fixed values).
SCRIPT = ["先看第一个细节。", "这个画面张力十足。", "节奏开始加快了。", "注意这里的转折。", "越到后面越精彩。", "这就是它的魅力。", "喜欢记得点赞关注。"]


def pick_transition(pattern: str, strong: Column, motion: Column, key: Column) -> Column:
    """struct(type, ratio): a candidate by key, the fast ones at high motion if the pattern heeds it."""
    s, w, rs, rw, heeds = PATTERNS[pattern]

    def of(candidates: list[str], ratio: float) -> Column:
        at = lambda c: F.get(F.array(*map(F.lit, c)), F.pmod(key, F.lit(len(c))).cast("int"))
        fast = [c for c in candidates if c in FAST]
        plain = F.struct(at(candidates).alias("type"), F.lit(ratio).alias("ratio"))
        return F.when(motion > 0.7, F.struct(at(fast).alias("type"), F.lit(ratio * 0.6).alias("ratio"))).otherwise(plain) if heeds and fast else plain

    return F.when(strong, of(s, rs)).otherwise(of(w, rw))


def transition_seconds(kind: Column, interval: Column, ratio: Column) -> Column:
    """0 for cuts, else the ratio of a beat interval, 0.08 at most."""
    return F.when(kind == "cut", F.lit(0.0)).otherwise(F.least(interval * ratio, F.lit(0.08)))


def offline_script(topic: Column, seconds: Column) -> Column:
    """Template lines for a topic: one for five seconds, three to eight."""
    n = F.greatest(F.lit(3), F.least(F.lit(10), F.floor(seconds / 5))).cast("int")
    return F.slice(F.array(F.concat(F.lit("今天聊聊"), topic, F.lit("。")), *map(F.lit, SCRIPT)), F.lit(1), n)


def numbered_lines(text: Column, expected: Column) -> Column:
    """Lines of a numbered answer without their numbers; null unless there are as many as expected."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(lines) == expected, F.transform(lines, lambda x: F.regexp_replace(x, r"^\d+\s*[.、):：]\s*", "")))


def ass_color(rgb: Column) -> Column:
    """RRGGBB, with or without #, as &H00BBGGRR."""
    x = F.upper(F.ltrim(rgb, F.lit("#")))
    return F.concat(F.lit("&H00"), F.substring(x, 5, 2), F.substring(x, 3, 2), F.substring(x, 1, 2))


def escape_drawtext(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in "':%":
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return out


def escape_ass(text: Column) -> Column:
    out = F.translate(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), "{}", "()")
    return F.trim(F.regexp_replace(out, r"\n+", r"\\N"))


def quote_info(info: Column) -> list[Column]:
    """Movie, year and seconds of "Movie (2020) [00:19:48]"."""
    year = F.regexp_extract(info, r"\((\d{4})\)", 1)
    part = lambda i: F.coalesce(F.regexp_extract(info, r"\[(\d+):(\d+):(\d+)\]", i).try_cast("double"), F.lit(0.0))
    movie = F.when(year != "", F.trim(F.regexp_replace(info, r"(?s)\(\d{4}\).*$", ""))).otherwise(info)
    return [movie.alias("movie"), year.alias("year"), (part(1) * 3600 + part(2) * 60 + part(3)).alias("start")]


def cover_times(duration: Column, n: int = 10) -> Column:
    """n times evenly from 5 % to 95 % of a duration."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: duration * (0.05 + 0.9 * i / (n - 1)))
