"""Transition picks, scripts, subtitles' text, quotes, beat grids."""

from __future__ import annotations

import pyspark.sql.functions as F

from ..functions import details as D
from ..tables import samples, table

_S = "s as (select user_id as track, event_id as id, value as v, event_type as kind from events)"


def q_transition_pick(spark, d):
    s = samples(spark, d)
    each = [s.select("id", F.lit(p).alias("pattern"), D.pick_transition(p, F.col("kind") == "view", F.col("v") / 100, F.col("id")).alias("x")) for p in D.PATTERNS]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.select("id", "pattern", "x.type", "x.ratio", D.transition_seconds(F.col("x.type"), F.lit(0.1), F.col("x.ratio")).alias("seconds"))


def _pick(p: str) -> str:
    s, w, rs, rw, heeds = D.PATTERNS[p]
    lst = lambda c: "[" + ", ".join(f"'{x}'" for x in c) + "]"
    fast = lambda c: [x for x in c if x in D.FAST]

    def arm(c: list[str], r: float) -> tuple[str, str]:
        at = lambda y: f"({lst(y)})[(id % {len(y)}) + 1]"
        return (f"case when v / 100 > 0.7 then {at(fast(c))} else {at(c)} end", f"case when v / 100 > 0.7 then {r * 0.6!r} else {r} end") if heeds and fast(c) else (at(c), str(r))

    (ts, xs), (tw, xw) = arm(s, rs), arm(w, rw)
    return f"select id, '{p}' as pattern, case when kind = 'view' then {ts} else {tw} end as type, (case when kind = 'view' then {xs} else {xw} end)::double as ratio from s"


def q_offline_script(spark, d):
    return samples(spark, d).select("id", F.posexplode(D.offline_script(F.col("kind"), F.col("id") % 70)).alias("i", "line"))


def q_numbered_lines(spark, d):
    text = F.concat(F.lit("1. "), F.col("kind"), F.lit("\n\n 2、second"), F.when(F.col("id") % 3 == 0, F.lit("\n3) third")).otherwise(F.lit("")))
    return samples(spark, d).select("id", F.array_join(D.numbered_lines(text, F.lit(2)), "|").alias("lines"))


def q_batches(spark, d):
    """Captions dealt into batches of twenty in order of their turn."""
    c = table(spark, d, "conversations").select("conv_id", "turn")
    return c.groupBy("conv_id", F.floor((F.col("turn") - 0) / 20).alias("batch")).agg(F.count("*").alias("n"))


def q_escapes(spark, d):
    text = F.concat(F.lit("it's {"), F.col("kind"), F.lit("}: 50% \\ done\n\nnext\r"))
    return samples(spark, d).select("id", D.escape_drawtext(text).alias("drawtext"), D.escape_ass(text).alias("ass"), D.ass_color(F.concat(F.lit("#"), F.lpad(F.conv((F.col("id") * 7919 % 16777216).cast("string"), 10, 16), 6, "0"))).alias("color"))


def q_quote_info(spark, d):
    info = F.concat(F.lit("The "), F.col("kind"), F.when(F.col("id") % 4 > 0, F.concat(F.lit(" ("), (1950 + F.col("id") % 70).cast("string"), F.lit(") [0"), (F.col("id") % 9).cast("string"), F.lit(":19:48]"))).otherwise(F.lit("")))
    return samples(spark, d).select("id", *D.quote_info(info))


def q_cover_times(spark, d):
    return samples(spark, d).select("id", F.posexplode(D.cover_times(F.col("v"), 5)).alias("i", "t"))


def q_beat_grid(spark, d):
    """Sixteenth steps of a drum pattern, kick on each fourth and snare on the third of each four, for a bar a track."""
    t = samples(spark, d).select("track").distinct()
    step = t.select("track", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    bpm = 90 + F.col("track") % 60
    return step.select("track", "k", (F.col("k") * 60 / bpm / 4).alias("t"), (F.col("k") % 4 == 0).alias("kick"), (F.col("k") % 4 == 2).alias("snare"))


ESCAPES = f"""with {_S} select id, 'it\\''s {{' || kind || '}}\\: 50\\% \\\\ done' || chr(10) || chr(10) || 'next' || chr(13) as drawtext, 'it''s (' || kind || '): 50% \\ done\\Nnext' as ass, '&H00' || x[5:6] || x[3:4] || x[1:2] as color from (select *, lpad(hex(id * 7919 % 16777216), 6, '0') as x from s)"""

QUERIES = {
    "transition_pick": (q_transition_pick, f"with {_S}, p as (" + " union all ".join(map(_pick, D.PATTERNS)) + ") select *, case when type = 'cut' then 0.0 else least(0.1 * ratio, 0.08) end::double as seconds from p"),
    "offline_script": (q_offline_script, f"with {_S}, l as (select id, ['今天聊聊' || kind || '。', {', '.join(repr(x) for x in D.SCRIPT)}][1:greatest(3, least(10, (id % 70) // 5))] as l from s) select id, unnest(range(len(l)))::int as i, unnest(l) as line from l"),
    "numbered_lines": (q_numbered_lines, f"with {_S} select id, case when id % 3 > 0 then kind || '|second' end as lines from s"),
    "caption_batches": (q_batches, "select conv_id, floor(turn / 20)::bigint as batch, count(*) as n from conversations group by all"),
    "text_escapes": (q_escapes, ESCAPES),
    "quote_info": (q_quote_info, f"with {_S} select id, 'The ' || kind as movie, case when id % 4 > 0 then (1950 + id % 70)::varchar else '' end as year, case when id % 4 > 0 then (id % 9) * 3600 + 19 * 60 + 48 else 0 end::double as start from s"),
    "cover_times": (q_cover_times, f"with {_S} select id, i::int as i, v * (0.05 + 0.9 * i / 4) as t from s, range(5) r(i)"),
    "beat_grid": (q_beat_grid, f"with {_S} select track, k::int as k, k * 60.0::double / (90 + track % 60) / 4 as t, k % 4 = 0 as kick, k % 4 = 2 as snare from (select distinct track from s), range(16) r(k)"),
}
