"""Shots, beats and intervals."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from ..functions.details import PATTERNS
from ..functions.scoring import frame_score, highlight_score
from ..operators import beats as B
from ..operators import intervals as I
from ..operators import nearest as N
from ..operators import selection as S
from ..operators import series as R
from ..operators import vector_index as K
from ..tables import BEATS, INTERVALS, SAMPLES, SHOTS, beats, intervals, samples, shots, table

SCORE = """least(greatest(0.25 * (1 / (1 + exp(-(magnitude - 3)))) + 0.20 * (case when duration < 1 then duration when duration <= 3 then 1.0 else greatest(0.3, 1 - 0.1 * (duration - 3)) end)
  + 0.25 * (case when shot_id % 3 = 0 then 0.5 when shot_id % 3 = 1 then 0.9 else 0.5 end)
  + 0.15 * (0.4 * least(shake / 3, 1.0) + 0.3 * least(abs(zoom - 1) / 0.5, 1.0) + 0.3 * least((abs(dx) + abs(dy)) / 5, 1.0))
  + 0.15 * (case when duration < 0.5 then 0.2 when duration > 10 then 0.4 else 0.6 end), 0.0), 1.0)::double"""
SCORED = f"{SHOTS}, scored as (select *, {SCORE} as highlight_score from shots)"


def scored(spark, d) -> DataFrame:
    s = shots(spark, d)
    return s.withColumn("highlight_score", highlight_score(*(F.col(c) for c in ("duration", "magnitude", "shake", "zoom", "dx", "dy", "actions"))))


def q_highlight_score(spark, d):
    return scored(spark, d).select("shot_id", "source_video", "highlight_score")


def q_frame_score(spark, d):
    s = shots(spark, d)
    return s.select("shot_id", frame_score(F.col("magnitude"), F.col("shake") / 3).alias("frame_score"))


def q_source_cap(spark, d):
    """Shots of the first 120 hours of each source, as far as it is analysed."""
    return S.within(shots(spark, d), 120 * 3600.0).select("shot_id", "source_video")


def q_source_spans(spark, d):
    return S.with_separation(shots(spark, d), 1.0, 15).groupBy("source_video").agg(F.count("*").alias("n"), F.max("min_sep").alias("min_sep"))


def selected(spark, d):
    return S.select_highlights(scored(spark, d), 15, 1.0)


SELECTED = f"""{SCORED},
sep as (select source_video, greatest(1.0, (max(end_time) - min(start_time)) / 37.5) as min_sep from scored group by source_video),
g(source_video, rank, sel) as (
  select source_video, 0, []::struct(s double, e double)[] from sep union all
  select source_video, rank + 1, list_append(any_value(sel), arg_min({{'s': start_time, 'e': end_time}}, {{'a': -highlight_score, 'b': start_time, 'c': shot_id}}))
  from (select g.source_video, g.rank, g.sel, c.* exclude (source_video) from g join sep using (source_video) join scored c using (source_video)
    where g.rank < 15 and len(list_filter(g.sel, lambda y: greatest(c.start_time, y.s) - least(c.end_time, y.e) < sep.min_sep)) = 0) group by source_video, rank),
sel as (select source_video, unnest(list_zip(range(len(sel)), sel)) as x from (select source_video, arg_max(sel, rank) as sel from g group by source_video)),
picked as (select s.source_video, x[1] as rank, c.shot_id, c.start_time, c.end_time, c.highlight_score from sel s join scored c on c.source_video = s.source_video and c.start_time = x[2].s and c.end_time = x[2].e)"""


def q_select_highlights(spark, d):
    return selected(spark, d)


def q_interleave_sources(spark, d):
    return S.interleave(selected(spark, d), 50).select("place", "source_video", "shot_id")


def classified(spark, d):
    return B.classify(beats(spark, d), "track")


def q_beat_classify(spark, d):
    return classified(spark, d).select("track", "idx", "t", "beat_type", "strength")


def q_beat_interval(spark, d):
    return B.upper_median_interval(beats(spark, d), "track")


def q_bgm_align(spark, d):
    return B.align_music(beats(spark, d).where("idx > 0"), "track")


def timeline(spark, d, style="dynamic", pattern=None):
    """The selected highlights laid on the beats of every track."""
    picked = S.interleave(selected(spark, d), 50).select(F.lit(0).alias("version"), "place", "shot_id", (F.col("end_time") - F.col("start_time")).alias("duration"), "highlight_score")
    return B.sync(picked, classified(spark, d), "track", style, pattern).drop("version")


def q_beat_sync_timeline(spark, d):
    return timeline(spark, d)


def q_timeline_pattern(spark, d):
    return timeline(spark, d, "calm", "retro_wipe")


#: Shots of a source and gap of each version of a selection, the usual one first (fixed values).
VERSIONS = [(15, 1.0), (5, 1.0), (10, 1.0), (20, 0.6), (30, 0.3), (40, 0.0), (50, 0.0)]


def q_target_duration(spark, d):
    """For each track, of the timelines of all versions the one closest to eight seconds. All versions are selected at
    once, as sources of their own."""
    versions = F.array(*[F.struct(F.lit(i).alias("version"), F.lit(most).alias("top"), F.lit(gap).alias("gap")) for i, (most, gap) in enumerate(VERSIONS)])
    s = scored(spark, d).withColumn("x", F.explode(versions)).select("shot_id", "start_time", "end_time", "highlight_score", "x.*", "source_video")
    picked = S.select_highlights(s.withColumn("source_video", F.concat(F.col("version").cast("string"), F.lit("/"), F.col("source_video"))), "top", "gap")
    placed = S.interleave(picked.withColumn("version", F.split("source_video", "/")[0].cast("int")), 50, "version")
    laid = B.sync(placed.withColumn("duration", F.col("end_time") - F.col("start_time")), classified(spark, d), "track")
    return B.closest_version(laid, "track", 8.0)


def hot():
    return F.col("v") > 60


def q_drops_islands(spark, d):
    return I.islands(samples(spark, d), "track", "t", hot(), "id", 1.0)


def q_vad_islands(spark, d):
    s = samples(spark, d)
    end = s.agg(F.max("t")).first()[0]
    return I.islands(s, "track", "t", hot(), "id", 0.2, F.lit(end))


def _islands(least: float, keep_open: str) -> str:
    return f"""with {SAMPLES},
f as (select *, v > 60 as h, lead(t) over w as n, lag(v > 60) over w as p from samples window w as (partition by track order by t, id)),
g as (select *, sum((h and not coalesce(p, false))::int) over (partition by track order by t, id) as g from f),
e as (select track, g, min(t) as a, arg_max({{'n': n}}, {{'t': t, 'id': id}}).n as b from g where h group by track, g)
select track, a, b from e where b - a > {least} {keep_open}"""


def q_merge_intervals(spark, d):
    return I.merge(intervals(spark, d), "key", gap=0.12)


def q_near_merge_intervals(spark, d):
    return I.merge(intervals(spark, d), "key", gap=60.0).where("b - a >= 0.1")


def q_complement_intervals(spark, d):
    return I.complement(I.merge(intervals(spark, d), "key", gap=0.12), "key", F.lit(30 * 86400.0))


def q_keep_ranges(spark, d):
    return I.complement(I.merge(intervals(spark, d), "key", gap=0.02), "key", F.lit(30 * 86400.0), margin=0.12, min_len=0.20)


def _merged(gap: float) -> str:
    return f"""{INTERVALS}, mk as (select *, coalesce((a - max(b) over (partition by key order by a, b rows between unbounded preceding and 1 preceding) > {gap})::int, 1) as new from ivs),
gr as (select *, sum(new) over (partition by key order by a, b rows unbounded preceding) as g from mk), merged as (select key, min(a) as a, max(b) as b from gr group by key, g)"""


def _complement(gap: float, margin: float, least: float) -> str:
    return f"""with {_merged(gap)}, c as (select key, coalesce(lag(b) over (partition by key order by a) + {margin}, 0) as a, a - {margin} as b from merged
union all select key, max(b) + {margin}, 2592000.0 from merged group by key) select key, a::double as a, b::double as b from c where b - a > {least}"""


def q_shot_pairs_from_cuts(spark, d):
    return I.pair_cuts(samples(spark, d).select("track", "t"), "track", "t", F.lit(30 * 86400.0), 60.0)


def q_index_shots(spark, d):
    return I.index_shots(samples(spark, d).select("track", "t"), "track", "t", 20 * 86400.0)


def q_duck_windows(spark, d):
    s = samples(spark, d)
    windows = I.merge(intervals(spark, d), "key", gap=0.12)
    return I.in_windows(s.select(F.col("track").alias("key"), "id", "t"), windows, "key", "t", 3600.0).select("key", "id", F.lit(-12.0).alias("gain_db"))


def q_caption_clip_shift(spark, d):
    return I.clip_shift(intervals(spark, d).select("id", "a", "b"), F.lit(5 * 86400.0), F.lit(86400.0))


def _around(spark, d):
    s = samples(spark, d)
    probes = s.where("kind = 'purchase'").select("track", "id", "t")
    return N.neighbours(probes, s.where("kind = 'view'").select("track", "t", "v"), "track", "id")


def q_asof_prev(spark, d):
    return _around(spark, d).select("track", "id", F.col("before.t").alias("prev_t"), F.col("before.v").alias("prev_v"))


def q_nearest_frame_join(spark, d):
    return N.nearest(_around(spark, d)).select("track", "id", F.col("near.t").alias("near_t"), F.col("near.v").alias("near_v"))


def q_lerp_track(spark, d):
    return _around(spark, d).select("track", "id", N.lerp().alias("value"))


AROUND = f"""{SAMPLES}, pr as (select track, id, t from samples where kind = 'purchase'), pt as (select track, t, min(v) as v from samples where kind = 'view' group by track, t),
ar as (select pr.track, pr.id, pr.t, b.t as bt, b.v as bv, f.t as ft, f.v as fv from pr asof left join pt b on pr.track = b.track and pr.t >= b.t asof left join pt f on pr.track = f.track and pr.t <= f.t)"""


def q_series_smoothing(spark, d):
    x = R.smoothed(samples(spark, d), "track", ["t", "id"], "v")
    return x.select("track", "id", "ema", "ma")


def q_best_window(spark, d):
    hours = samples(spark, d).groupBy("track", F.floor(F.col("t") / 86400).alias("i")).agg(F.sum("v").alias("p"))
    grid = hours.select("track").distinct().select("track", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(29).cast("bigint"))).alias("i"))
    return R.best_window(grid.join(hours, ["track", "i"], "left").select("track", "i", F.coalesce("p", F.lit(0.0)).alias("p")), "track", "i", "p", 5)


def q_downsample(spark, d):
    return R.every(samples(spark, d).select("track", "id", "t"), "track", ["t", "id"], 10)


def q_frame_difference(spark, d):
    w = Window.partitionBy("track").orderBy("t", "id")
    return samples(spark, d).select("track", "id", F.abs(F.col("v") - F.lag("v").over(w)).alias("diff"))


def q_motion_stats(spark, d):
    return samples(spark, d).groupBy("track").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.percentile("v", 0.8).alias("p80"), F.median("v").alias("med"))


def q_minmax_normalise(spark, d):
    return R.minmax(samples(spark, d), "track", "v", "energy").select("track", "id", "energy")


def q_vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return K.top_k(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10)


def q_vector_topk_min_score(spark, d):
    e = table(spark, d, "embeddings")
    return K.top_k(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10, 0.5)


def q_label_topk(spark, d):
    e = table(spark, d, "embeddings")
    return K.top_k(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 3, -1.0, "label")


def _topk(where: str, k: int, least: float, per: str = "") -> str:
    p, sel = (f", {per}", f"{per}, ") if per else ("", "")
    return f"""with s as (select q.vec_id as query_id, e.vec_id, e.label, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::double * x[2]::double)) as score from embeddings e, embeddings q where q.{where}),
r as (select *, row_number() over (partition by query_id{p} order by score desc, vec_id) as rank from s where score >= {least}) select query_id, {sel}vec_id, score, rank from r where rank <= {k}"""


CLASSIFIED = f"{BEATS}, med as (select track, median(onset) as med, median(energy) as loud from beats group by track), cb as (select track, idx, t, case when onset > 1.2 * med or energy > 1.3 * loud then 'strong' else 'normal' end as kind, least(onset / (med + 1e-8), 2.0) / 2 as strength from beats join med using (track))"
PACE = "dist as (select track, lead(t) over (partition by track order by t) - t as d from beats), pace as (select track, coalesce(list_sort(list(d) filter (d is not null))[count(d) // 2 + 1], 0.5) as interval from dist group by track)"


def _sync_sql(style: str, pattern: str | None = None) -> str:
    """CTEs clips(version, place, shot_id, avail, score), cb and pace -> laid, by the rules of sync, shot after shot."""
    c = B.STYLES[style]
    slow, (lo, hi) = c["range"][0], c["range"]
    bound = lambda k: f"case when kind = 'strong' then case when score > 0.7 then {c['strong'][k]} else {c['strong'][k] + 1} end when kind = 'weak' then {c['weak'][k]} else {c['normal'][k]} end"
    gone = lambda k: f"(ts[least(cur + {k}, n - 1) + 1] - ts[cur + 1])"
    pick = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + f"][(shot_id % {len(names)}) + 1]"
    dark = "(" + ", ".join(f"'{x}'" for x in B.DARKENING) + ")"
    if pattern:
        on, off, r_on, r_off, _ = PATTERNS[pattern]
    else:
        (on, off), r_on, r_off = B.TRANSITIONS[style], 0.5, 0.5
    return f"""mu as (select track, list(t order by idx) as ts, list(kind order by idx) as ks, count(*)::int as n, interval as bi from cb join pace using (track) group by track, interval),
st(track, version, place, cur, shot_id, start_time, lasts, speed, beats, kind, bi) as (
  select track, version, -1, 0, null::bigint, null::double, null::double, null::double, null::int, null::varchar, bi from mu, (select distinct version from clips)
  union all select track, version, place, case when good then cur + taken else cur end, case when good then shot_id end, case when good then ts[cur + 1] end, lasts,
    greatest({slow}, least(greatest({lo}, least({hi}, case when kind = 'strong' then {c['strong_speed']} + case when score > 0.7 then 0.05 else 0 end else {c['weak_speed']} - case when score > 0.7 then 0.05 else 0 end end)), avail / nullif(lasts, 0))), taken, kind, bi
  from (select *, coalesce(cur < n and fit >= 1 and lasts > 0 and avail / nullif(lasts, 0) >= {slow - 1e-4!r}, false) as good
  from (select *, case when roomy then whole else {gone('taken')} end as lasts
  from (select *, case when roomy then cnt when cnt > 1 then coalesce(list_max(list_filter(range(1, cnt), lambda k: {gone('k')} <= 0 or avail / nullif({gone('k')}, 0) >= {slow - 1e-4!r})), 1) else cnt end::int as taken
  from (select *, coalesce(whole > 0 and avail / nullif(whole, 0) >= {slow - 1e-4!r}, false) as roomy
  from (select *, case when {gone('cnt')} <= 0 then cnt * bi else {gone('cnt')} end as whole
  from (select *, least(case when least_n = most_n or score > 0.6 then least_n when score > 0.3 then (least_n + most_n) // 2 else most_n end, fit)::int as cnt
  from (select *, {bound(0)} as least_n, {bound(1)} as most_n, floor(avail / {max(0.1, slow)} / bi + 1e-6)::int as fit
  from (select st.track, st.version, c.place::int as place, st.cur, c.shot_id, c.avail, c.score, mu.ts, mu.n, mu.bi, mu.ks[st.cur + 1] as kind from st join clips c on c.version = st.version and c.place = st.place + 1 join mu on mu.track = st.track))))))))),
laid as (select track, version, shot_id, start_time, start_time + lasts as end_time, lasts as duration, speed, beats, case when raw in {dark} then 'fade' else raw end as transition_type, case when raw = 'cut' then 0.0 else least(bi * case when kind = 'strong' then {r_on} else {r_off} end, 0.08) end::double as transition_duration
  from (select *, case when kind = 'strong' then {pick(on)} else {pick(off)} end as raw from st where shot_id is not null))"""


def _timeline_sql(style: str, pattern: str | None = None) -> str:
    return f"with recursive {SELECTED}, f as (select source_video, highlight_score as s, start_time as t from picked where rank = 0), clips as (select 0 as version, row_number() over (order by rank, s desc, t, source_video) - 1 as place, shot_id, end_time - start_time as avail, highlight_score as score from picked join f using (source_video) qualify place < 50), {CLASSIFIED}, {PACE}, {_sync_sql(style, pattern)} select * exclude (version) from laid"


def _target_sql() -> str:
    versions = ", ".join(f"({i}, {most}, {gap}::double)" for i, (most, gap) in enumerate(VERSIONS))
    shot = "{'s': start_time, 'e': end_time, 'i': shot_id, 'h': highlight_score}"
    return f"""with recursive {SCORED}, ver(version, most, gap) as (values {versions}),
src as (select version, source_video, most, case when gap > 0 then greatest(gap, (max(end_time) - min(start_time)) / (most * 2.5::double)) else 0.0 end::double as sep, list([{shot}] order by highlight_score desc, start_time, shot_id) as c from scored, ver group by version, source_video, most, gap),
sel as (select version, source_video, list_reduce(c, lambda a, x: case when len(a) < most and len(list_filter(a, lambda y: greatest(x[1].s, y.s) - least(x[1].e, y.e) < sep)) = 0 then list_concat(a, x) else a end) as p from src),
pick as (select version, source_video, unnest(range(len(p))) as rank, unnest(p) as x, p[1] as top from sel),
clips as (select version, row_number() over (partition by version order by rank, top.h desc, top.s, source_video) - 1 as place, x.i as shot_id, x.e - x.s as avail, x.h as score from pick qualify place < 50),
{CLASSIFIED}, {PACE}, {_sync_sql("dynamic")},
tot as (select track, version, sum(duration) as total, count(*) as clips from laid group by track, version),
l as (select track, list({{'version': version, 'total': total, 'clips': clips, 'done': false}} order by version) as v from tot group by track having min(version) = 0),
r as (select track, list_reduce(v, lambda a, x: case when a.done then a else {{'version': case when abs(x.total - 8) < abs(a.total - 8) then x.version else a.version end, 'total': case when abs(x.total - 8) < abs(a.total - 8) then x.total else a.total end, 'clips': case when abs(x.total - 8) < abs(a.total - 8) then x.clips else a.clips end, 'done': x.total >= 7.6}} end) as b from l)
select track, b.version as version, b.total as total, b.clips as clips from r"""


QUERIES = {
    "highlight_score": (q_highlight_score, f"with {SCORED} select shot_id, source_video, highlight_score from scored"),
    "frame_score": (q_frame_score, f"with {SHOTS}, m as (select shot_id, magnitude as s, shake / 3 as m from shots) select shot_id, 0.7 * ln(1 + s) + 0.3 * greatest(case when m between 0.35 and 0.65 then 1.0 when m < 0.35 then m / 0.35 else (1 - m) / 0.35 end, 0.0) * ln(1 + s) as frame_score from m"),
    "source_cap": (q_source_cap, f"with {SHOTS} select shot_id, source_video from shots where start_time < 432000"),
    "source_spans": (q_source_spans, f"with {SHOTS} select source_video, count(*) as n, greatest(1.0, (max(end_time) - min(start_time)) / 37.5)::double as min_sep from shots group by source_video"),
    "select_highlights": (q_select_highlights, f"with recursive {SELECTED} select * from picked"),
    "interleave_sources": (q_interleave_sources, f"with recursive {SELECTED}, f as (select source_video, highlight_score as s, start_time as t from picked where rank = 0) select row_number() over (order by rank, s desc, t, source_video) - 1 as place, source_video, shot_id from picked join f using (source_video) qualify place < 50"),
    "beat_classify": (q_beat_classify, f"with {CLASSIFIED} select track, idx, t, kind as beat_type, strength from cb"),
    "beat_interval_upper_median": (q_beat_interval, f"with {BEATS}, {PACE} select track, interval from pace"),
    "bgm_align": (q_bgm_align, f"with {BEATS}, b as (select * from beats where idx > 0), o as (select track, case when min(t) > 0.05 then min(t) else 0.0 end as off from b group by track) select track, idx, greatest(t - off, 0.0) as t, off as shift from b join o using (track)"),
    "beat_sync_timeline": (q_beat_sync_timeline, _timeline_sql("dynamic")),
    "timeline_with_pattern": (q_timeline_pattern, _timeline_sql("calm", "retro_wipe")),
    "timeline_target_duration": (q_target_duration, _target_sql()),
    "drops_islands": (q_drops_islands, _islands(1.0, "")),
    "vad_islands": (q_vad_islands, _islands(0.2, "union all select track, a, (select max(t) from samples) from e where b is null")),
    "merge_intervals": (q_merge_intervals, f"with {_merged(0.12)} select * from merged"),
    "near_merge_intervals": (q_near_merge_intervals, f"with {_merged(60.0)} select * from merged where b - a >= 0.1"),
    "complement_intervals": (q_complement_intervals, _complement(0.12, 0.0, 0.0)),
    "keep_ranges": (q_keep_ranges, _complement(0.02, 0.12, 0.20)),
    "shot_pairs_from_cuts": (q_shot_pairs_from_cuts, f"with {SAMPLES}, p as (select track, t as a, coalesce(lead(t) over (partition by track order by t), 2592000.0) as b from samples union all select track, 0.0, min(t) from samples group by track having min(t) > 0), n as (select *, row_number() over (partition by track order by a, b) - 1 as i from p) select track, i, a, b from n where b - a >= 60"),
    "index_shots": (q_index_shots, f"with {SAMPLES}, c as (select distinct track, t as a from samples where t > 0 and t < 1728000 union all select distinct track, 0.0 from samples), p as (select track, a, coalesce(lead(a) over (partition by track order by a), 1728000.0) as b from c) select track, row_number() over (partition by track order by a) - 1 as i, a, b from p where b - a >= 0.4"),
    "duck_windows": (q_duck_windows, f"with {_merged(0.12)} select track as key, id, -12.0::double as gain_db from samples s where exists (select 1 from merged m where m.key = s.track and s.t between m.a and m.b)"),
    "caption_clip_shift": (q_caption_clip_shift, f"with {INTERVALS} select id, greatest(a - 432000.0, 0.0) as a, least(b - 432000.0, 86400.0) as b from ivs where b - 432000.0 > 0 and a - 432000.0 < 86400"),
    "asof_prev": (q_asof_prev, f"with {AROUND} select track, id, bt as prev_t, bv as prev_v from ar"),
    "nearest_frame_join": (q_nearest_frame_join, f"with {AROUND} select track, id, case when bt is null then ft when ft is null or t - bt <= ft - t then bt else ft end as near_t, case when bt is null then fv when ft is null or t - bt <= ft - t then bv else fv end as near_v from ar"),
    "lerp_track": (q_lerp_track, f"with {AROUND} select track, id, case when bt is null then fv when ft is null or bt = ft then bv else bv + (fv - bv) * (t - bt) / (ft - bt) end as value from ar"),
    "series_smoothing": (q_series_smoothing, f"with recursive {SAMPLES}, r as (select track, id, v, row_number() over w as n, avg(v) over () as x, count(*) over (partition by track) as m from samples window w as (partition by track order by t, id)), e(track, n, ema) as (select track, n, v from r where n = 1 union all select e.track, r.n, 0.35::double * r.v + 0.65::double * e.ema from e join r on r.track = e.track and r.n = e.n + 1), j as (select r.track, r.id, r.n, ema from r join e using (track, n)) select track, id, ema, (coalesce(lag(ema) over w, ema) + ema + coalesce(lead(ema) over w, ema)) / 3 as ma from j window w as (partition by track order by n)"),
    "best_window": (q_best_window, f"with {SAMPLES}, h as (select track, floor(t / 86400)::bigint as i, sum(v) as p from samples group by all), gr as (select track, i, coalesce(p, 0.0) as p from (select distinct track from h) cross join range(30) r(i) left join h using (track, i)), s as (select track, i, sum(p) over (partition by track order by i rows between 4 preceding and current row) as total, sum(p * i) over (partition by track) / sum(p) over (partition by track) as c from gr), n as (select *, max(total) over (partition by track) as best from s where i >= 4) select track, arg_min(i - 4, {{'a': abs(i - 4 + 2.0 - c), 'b': i}}) as lo, arg_min(total, {{'a': abs(i - 4 + 2.0 - c), 'b': i}}) as total from n where total >= best - 0.02 * abs(best) group by track"),
    "downsample": (q_downsample, f"with {SAMPLES} select track, id, t from samples qualify (row_number() over (partition by track order by t, id) - 1) % 10 = 0"),
    "frame_difference": (q_frame_difference, f"with {SAMPLES} select track, id, abs(v - lag(v) over (partition by track order by t, id)) as diff from samples"),
    "motion_stats": (q_motion_stats, f"with {SAMPLES} select track, avg(v) as mean, stddev_pop(v) as std, quantile_cont(v, 0.8) as p80, median(v) as med from samples group by track"),
    "minmax_normalise": (q_minmax_normalise, f"with {SAMPLES} select track, id, (v - min(v) over (partition by track)) / (max(v) over (partition by track) - min(v) over (partition by track) + 1e-8) as energy from samples"),
    "vector_topk": (q_vector_topk, _topk("vec_id % 50 = 0", 10, 0.0)),
    "vector_topk_min_score": (q_vector_topk_min_score, _topk("vec_id % 50 = 0", 10, 0.5)),
    "label_topk": (q_label_topk, _topk("vec_id % 50 = 0", 3, -1.0, "label")),
}
