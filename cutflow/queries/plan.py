"""Cue, export and render plans."""

from __future__ import annotations

import pyspark.sql.functions as F

from ..operators import cues as C
from ..plans import export as E
from ..plans import render as R
from ..tables import SHOTS, shots, table
from .media import CLASSIFIED, classified


FIFTY = 50  # clips of a video, at most


def clips(spark, d, whole=False):
    """A video for every fifty shots, of each source: its shots in order, in whole hundredths. So a video, and the document
    of one, has fifty clips at most. If whole, a source is one video, however many shots it has."""
    s = shots(spark, d)
    cents = lambda x: F.floor(x * 100).cast("bigint") / F.lit(100.0)
    types = F.array(*map(F.lit, ["cut", "fade", "dissolve", "wipe"]))
    return s.select(
        (F.col("source_video") if whole else F.concat("source_video", F.lit("-"), F.floor(F.col("shot_id") / FIFTY).cast("string"))).alias("video"),
        (F.col("shot_id") + 1).alias("i"),
        F.concat(F.lit("/media/"), F.col("source_video"), F.lit("/clip_"), F.col("shot_id").cast("string"), F.lit(".mp4")).alias("source_path"),
        cents(F.col("start_time") % 7200).alias("start_time"),
        cents(F.col("duration")).alias("duration"),
        ((F.col("shot_id") % 5000) * F.lit(1.5)).alias("timeline_start"),
        F.get(types, (F.col("shot_id") % 4).cast("int")).alias("transition_type"),
        ((F.col("shot_id") % 4) * F.lit(0.25)).alias("transition_duration"),
        (F.col("magnitude") * 3).alias("luma"),
    )


_clips = lambda video: f"""{SHOTS}, clips as (select {video} as video, shot_id + 1 as i, '/media/' || source_video || '/clip_' || shot_id || '.mp4' as source_path, floor((start_time % 7200) * 100)::bigint / 100.0::double as start_time, floor(duration * 100)::bigint / 100.0::double as duration,
(shot_id % 5000) * 1.5::double as timeline_start, (['cut', 'fade', 'dissolve', 'wipe'])[(shot_id % 4) + 1] as transition_type, (shot_id % 4) * 0.25::double as transition_duration, magnitude * 3 as luma from shots)"""  # noqa: E731
CLIPS = _clips(f"source_video || '-' || (shot_id // {FIFTY})")
WHOLE = _clips("source_video")


def _tc(x: str) -> str:
    p = lambda y: f"lpad(({y})::bigint::varchar, 2, '0')"
    return f"({p(f'floor(floor({x}) / 3600)')} || ':' || {p(f'floor((floor({x}) % 3600) / 60)')} || ':' || {p(f'floor({x}) % 60')} || ':' || {p(f'floor(({x} - floor({x})) * 30)')})"


def _two(x: str) -> str:
    c = f"floor({x} * 100 + 0.5)::bigint"
    return f"(({c} // 100)::varchar || '.' || lpad(({c} % 100)::varchar, 2, '0'))"


_A, _B, _C, _E = "start_time", "(start_time + duration)", "timeline_start", "(timeline_start + duration)"


def q_edl(spark, d):
    return E.edl(clips(spark, d))


def q_csv(spark, d):
    return E.csv_rows(clips(spark, d))


def q_frames(spark, d):
    return E.frames(clips(spark, d))


def q_otio(spark, d):
    return E.otio_rows(clips(spark, d))


def q_json(spark, d):
    return E.json_rows(clips(spark, d))


def q_segments(spark, d):
    return R.segments(clips(spark, d, whole=True), "video", "i").select("video", "i", "segment")


def q_xfade(spark, d):
    return R.xfade_offsets(R.segments(clips(spark, d), "video", "i"), "video", "i")


def q_harmonise(spark, d):
    return R.harmonise(clips(spark, d).select("i", "luma"), "luma")


ASPECTS = [9 / 16, 1.0, 16 / 9, 0.9, 2.0]


def q_crop(spark, d):
    c = clips(spark, d)
    aspect = F.get(F.array(*map(F.lit, ASPECTS)), (F.col("i") % 5).cast("int"))
    crop = R.crop_window(1280 + F.col("i") % 640, 720 + F.col("i") % 360, aspect)
    return c.select("i", crop.alias("c"), R.output_size(crop, aspect).alias("o")).select("i", F.col("c.w").alias("crop_w"), F.col("c.h").alias("crop_h"), F.col("o.w").alias("out_w"), F.col("o.h").alias("out_h"))


def q_speed(spark, d):
    c = clips(spark, d).select("i", "duration")
    each = [R.speed_segments(c, "duration", p).groupBy("i").agg(F.lit(p).alias("preset"), F.sum((F.col("b") - F.col("a")) / F.col("speed")).alias("out_duration"), F.sum(F.col("b") - F.col("a")).alias("in_duration")) for p in ("rush", "slowmo", "hero", "punch")]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


def q_atempo(spark, d):
    return clips(spark, d).select("i", R.atempo((F.col("i") % 400 + 1) / 10).alias("f")).select("i", F.size("f").cast("bigint").alias("n"), F.aggregate("f", F.lit(1.0), lambda s, x: s * x).alias("product"), F.array_max("f").alias("hi"), F.array_min("f").alias("lo"))


def q_mixer(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track"), F.col("l_linenumber").alias("k"))
    window = F.concat(F.lit("between(t,"), (F.col("k") * 2).cast("string"), F.lit(","), (F.col("k") * 2 + 1).cast("string"), F.lit(")"))
    tracks = l.distinct().groupBy("track").agg(F.array_join(F.array_sort(F.collect_list(window)), "+").alias("windows"))
    return R.mixer_chain(tracks.select(F.col("track").alias("i"), ((F.col("track") % 3) * 500).alias("start_ms"), (F.col("track") % 4).cast("int").alias("gain_db"), "windows", F.lit(-12).alias("duck_db")))


def q_cue_plan(spark, d):
    return C.plan(classified(spark, d), "track", 20.0)


def q_cue_plan_cuts(spark, d):
    cuts = classified(spark, d).where("idx % 3 = 1").select("track", (F.col("t") + 0.22).alias("t"))
    return C.plan(classified(spark, d), "track", 20.0, "calm", 16, cuts)


def _cues_sql(density: float, cuts: bool) -> str:
    """The rules of plan for a clip of 20 seconds and 16 cues; cuts are every third beat, later by 0.22."""
    added = """ct as (select track, t + 0.22::double as t, row_number() over (partition by track order by t) - 1 as j from cb where idx % 3 = 1),
cl as (select track, list([{'t': t, 'kind': 'whoosh'}] order by t) as c from ct where j % 2 = 0 and t between 0.15 and 19.85 group by track),
base as (select track, list({'t': t, 'kind': kind} order by t, kind) as l, count(*) as n0 from q group by track),
q2 as (select track, unnest(case when c is null then l else list_reduce(list_concat([l], c), lambda a, x: case when len(a) - n0 < 3 and len(a) < 16 and len(list_filter(a, lambda y: abs(y.t - x[1].t) < 0.15)) = 0 then list_concat(a, x) else a end) end) as x from base left join cl using (track)),
qq as (select track, x.t as t, x.kind as kind from q2)""" if cuts else "qq as (select * from q)"
    return f"""with {CLASSIFIED}, b as (select track, t, kind = 'strong' as strong, strength from cb where t >= 0 and t < 20),
c as (select track, greatest(2, least(floor(count(*) * {density}), 12)) as target, count_if(strong) as ns, count_if(not strong) as no, arg_max(t, {{'s': strength, 't': -t}}) as peak from b group by track),
r as (select b.*, c.* exclude (track), row_number() over (partition by track, strong order by t) - 1 as k, case when strong then target else target - least(target, ns) end as size from b join c using (track)),
s as (select *, case when strong and ns <= target then 1 else greatest(1, floor((case when strong then ns else no end) / greatest(size, 1))) end as step from r),
ch as (select *, row_number() over (partition by track order by t) - 1 as i from s where k % step = 0 and k / step < size),
q as (select track, t, case when strong then case when i % 3 = 2 then 'whoosh' else 'impact' end else case when i % 2 = 1 then 'whoosh' else 'click' end end as kind from ch),
{added},
a as (select * from qq union all select track, peak - 0.9, 'riser' from c where peak - 0.9 > 0.3 and peak - 0.9 < 19.95 and (select count(*) from qq where qq.track = c.track) < 16),
o as (select track, list([{{'t': t, 'kind': kind}}] order by t, kind) as l from a where t >= 0 and t < 19.98 group by track),
z as (select track, list_reduce(l, lambda x, y: case when abs(y[1].t - x[-1].t) < 0.02 then x else list_concat(x, y) end)[1:16] as l from o),
u as (select track, unnest(l) as x from z)
select track, x.t as t, x.kind as kind, case x.kind when 'impact' then -5.0 when 'whoosh' then -9.0 when 'click' then -11.0 else -14.0 end::double as gain_db from u"""


XFADE = f"""with recursive {CLIPS}, seg as (select video, i, duration::double as d, transition_duration::double as x, sum(case when transition_type = 'cut' or transition_duration <= 0 then 1 else 0 end) over (partition by video order by i)::bigint as segment from clips),
n as (select *, row_number() over (partition by video, segment order by i) as k from seg),
r(video, segment, i, k, "offset", "length", acc) as (select video, segment, i, k, null::double, null::double, d from n where k = 1 union all
 select video, segment, i, k, o, l, o + d from (select video, segment, i, k, d, l, case when acc - l < 0 then greatest(0.1, acc * 0.5) else acc - l end as o from (select n.video, n.segment, n.i, n.k, n.d, r.acc, greatest(0.05, least(n.x, 0.9 * least(n.d, r.acc))) as l from r join n on n.video = r.video and n.segment = r.segment and n.k = r.k + 1)))
select video, segment, i, "offset", "length" from r"""

_even = lambda x: f"greatest(2, ({x}) - ({x}) % 2)"
_size = lambda k: "case " + " ".join(f"when abs(a - {r!r}::double) / {r!r}::double < 0.02 then {(w, h)[k]}" for r, w, h in R.SIZES) + " end"
CROP = f"""with {CLIPS}, x as (select i, 1280 + i % 640 as w, 720 + i % 360 as h, ([{', '.join(f'{v!r}::double' for v in ASPECTS)}])[(i % 5) + 1] as a from clips),
f as (select *, round_even(h * a, 0) as w0 from x), g as (select i, a, (case when w0 <= w then w0 else w end)::bigint as cw, (case when w0 <= w then h else round_even(w / a, 0) end)::bigint as ch from f),
c as (select i, a, {_even('cw')} as w, {_even('ch')} as h from g), o as (select *, (case when w <= h then 1080 else round_even(1080 * w / h::double, 0) end)::bigint as ow, (case when w <= h then round_even(1080 * h / w::double, 0) else 1080 end)::bigint as oh from c)
select i, w as crop_w, h as crop_h, coalesce({_size(0)}, ow - ow % 2)::bigint as out_w, coalesce({_size(1)}, oh - oh % 2)::bigint as out_h from o"""

_name = "regexp_extract(source_path, '[^/]*$')"
_asp = f"([{', '.join(f'{a!r}::double' for a in ASPECTS)}])[(i % 5) + 1]"
_speed = {"rush": "1.0 + 2.2 * pow(u, 1.6)", "slowmo": "2.4 - 2.0 * least(1.0, u * 1.15)", "hero": "0.4 + 1.4 * pow(abs(2 * u - 1), 1.3)", "punch": "case when (u > 0.18 and u < 0.30) or (u > 0.55 and u < 0.67) then 2.6 else 1.0 end"}
QUERIES = {
    "export_edl": (q_edl, f"with {CLIPS} select i, lpad(i::varchar, greatest(3, len(i::varchar))::int, '0') || '  ' || rpad(left(regexp_replace({_name}, '\\.[^.]*$', ''), 8), 8, ' ') || ' V     C        ' || {_tc(_A)} || ' ' || {_tc(_B)} || ' ' || {_tc(_C)} || ' ' || {_tc(_E)} || chr(10) || '* FROM CLIP NAME: ' || {_name} || chr(10) || '* SOURCE FILE: ' || source_path || chr(10) as line from clips"),
    "export_csv": (q_csv, f"with {CLIPS} select i, source_path, {', '.join(f'{_two(x)} as {n}, {_tc(x)} as {n}_tc' for n, x in (('src_in', _A), ('src_out', _B), ('rec_in', _C), ('rec_out', _E)))}, {_two('duration')} as duration from clips"),
    "export_fcp_frames": (q_frames, f"with {CLIPS}, f as (select i, floor({_C} * 30)::bigint as start, floor({_E} * 30)::bigint as stop, floor({_A} * 30)::bigint as src_in from clips) select i, start, stop as \"end\", src_in, src_in + stop - start as src_out from f"),
    "export_otio_rows": (q_otio, f"with {CLIPS} select i, 0 as part, 'Transition.1' as schema, case when transition_type = 'dissolve' then transition_type else 'custom_' || transition_type end as name, floor(transition_duration / 2 * 30)::bigint as start, floor(transition_duration / 2 * 30)::bigint as length from clips where transition_duration > 0 and transition_type <> 'cut' and i > 1 union all select i, 1, 'Clip.1', source_path, floor(start_time * 30)::bigint, floor(duration * 30)::bigint from clips"),
    "export_json": (q_json, f"with {CLIPS} select i, '{{\"i\":' || i || ',\"source_path\":\"' || source_path || '\",\"start_ms\":' || floor(start_time * 1000)::bigint || ',\"duration_ms\":' || floor(duration * 1000)::bigint || '}}' as json from clips"),
    "render_segments": (q_segments, f"with {WHOLE} select video, i, sum(case when transition_type = 'cut' or transition_duration <= 0 then 1 else 0 end) over (partition by video order by i)::bigint as segment from clips"),
    "xfade_offsets": (q_xfade, XFADE),
    "harmonize_luma": (q_harmonise, f"with {CLIPS}, m as (select avg(luma) as m from clips) select i, luma, case when abs(m - luma) >= 2 then (m - luma) * 0.5 / 255 end as brightness from clips, m"),
    "crop_geometry": (q_crop, CROP),
    "speed_curves": (q_speed, f"with {CLIPS} " + " union all ".join(f"select i, '{p}' as preset, sum(((k + 1) / {n}::double * duration - k / {n}::double * duration) / greatest(0.05, {e})) as out_duration, sum((k + 1) / {n}::double * duration - k / {n}::double * duration) as in_duration from (select i, duration, k, (k / {n}::double + (k + 1) / {n}::double) / 2 as u from clips, range({n}) r(k)) group by i" for p, e in _speed.items() for n in [20 if p == "punch" else 10])),
    "atempo_chain": (q_atempo, f"with {CLIPS}, s as (select i, (i % 400 + 1) / 10.0::double as s from clips), k as (select i, s, greatest(ceil(log2(s / 2) - 1e-12), 0)::int as up, greatest(ceil(log2(0.5 / s) - 1e-12), 0)::int as dn from s), r as (select *, round(s / pow(2, up) * pow(2, dn), 6) as rest from k) select i, (up + dn + 1)::bigint as n, rest * pow(2, up) / pow(2, dn) as product, greatest(case when up > 0 then 2.0 end, case when dn > 0 then 0.5 end, rest)::double as hi, least(case when up > 0 then 2.0 end, case when dn > 0 then 0.5 end, rest)::double as lo from r"),
    "mixer_chain": (q_mixer, "with w as (select l_orderkey as i, string_agg('between(t,' || k * 2 || ',' || k * 2 + 1 || ')', '+' order by 'between(t,' || k * 2 || ',' || k * 2 + 1 || ')') as windows from (select distinct l_orderkey, l_linenumber as k from lineitem) group by l_orderkey) select i, '[' || i || ':a]' || case when i % 3 > 0 then 'adelay=' || (i % 3) * 500 || '|' || (i % 3) * 500 || ',' else '' end || case when i % 4 > 0 then 'volume=' || i % 4 || 'dB,' else '' end || 'volume=enable=''' || windows || ''':volume=-12dB,aformat=sample_fmts=fltp:sample_rates=44100:channel_layouts=stereo[t' || i || ']' as chain from w"),
    "sfx_cue_plan": (q_cue_plan, _cues_sql(0.5, False)),
    "sfx_cue_plan_cuts": (q_cue_plan_cuts, _cues_sql(0.25, True)),
}
