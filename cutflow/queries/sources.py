"""Logs, specifications and landed results; keyword vectors and fingerprints."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Window

from ..functions import features as V
from ..operators import similar as S
from ..sources import logs as L
from ..tables import SHOTS, samples, table
from .media import SCORE, SCORED, SELECTED, scored
from .text import PROMPT_SQL, prompts

DAY = 86400.0


def _log(spark, d, line):
    """track, log: a text for each user, its lines in order of the events."""
    s = samples(spark, d).select("track", "id", F.round(F.col("v"), 2).alias("v"), "kind")
    return s.groupBy("track").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "v", "kind"))), line), "\n").alias("log"))


def q_scene_cuts(spark, d):
    return L.scene_cuts(_log(spark, d, lambda x: F.concat(F.lit("[showinfo] n:1 pts_time:"), x["id"].cast("string"), F.lit(".5 pos:7"))), "track", "log")


def q_black_ranges(spark, d):
    return L.black_ranges(_log(spark, d, lambda x: F.concat(F.lit("black_start:"), x["id"].cast("string"), F.lit(" black_end:"), (x["id"] + x["id"] % 90).cast("string"))), "track", "log")


def q_silences(spark, d):
    pairs = samples(spark, d).where("kind = 'view'").select("track", "id").groupBy("track").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: F.concat(F.lit("silence_start: "), i.cast("string"), F.when(i % 7 > 0, F.concat(F.lit("\nsilence_end: "), (i + 1).cast("string"))).otherwise(F.lit("\nsilence_end: ")), F.when(i % 7 == 0, (i + 2).cast("string")).otherwise(F.lit("")))), "\n").alias("log"))
    return L.silences(pairs, "track", "log", F.lit(DAY))


def q_volume_stats(spark, d):
    return samples(spark, d).select("id", F.concat(F.lit("mean_volume: -"), (F.col("id") % 60).cast("string"), F.lit(".5 dB\nmax_volume: -"), (F.col("id") % 9).cast("string"), F.lit(".0 dB")).alias("log")).select("id", *L.volume_stats(F.col("log")))


def q_mix_spec(spark, d):
    one = lambda role: F.concat(F.lit('{"path": "'), F.col("id").cast("string"), F.lit(f'.wav", "role": "{role}"'), F.when(F.col("id") % 2 == 0, F.lit(', "gain_db": -3.5}')).otherwise(F.lit(', "start": 2, "loop": true}')))
    spec = F.when(F.col("id") % 10 == 9, F.lit("{broken")).otherwise(F.concat(F.lit('{"tracks": ['), one("bgm"), F.lit(", "), one("noise"), F.lit("]}")))
    return L.mix_spec(samples(spark, d).select("id", spec.alias("spec")), "id", "spec")


def q_json_repair(spark, d):
    text = F.concat(F.lit('```json\n{"id": '), F.col("id").cast("string"), F.lit(', // the id\n "tags": ["a", "b",], "n": [1, 2'), F.when(F.col("id") % 2 == 0, F.lit("]}\n```")).otherwise(F.lit("")))
    fixed = L.repair_json(text)
    return samples(spark, d).select("id", F.get_json_object(fixed, "$.id").cast("long").alias("back"), F.get_json_object(fixed, "$.tags[1]").alias("tag"), F.get_json_object(fixed, "$.n[1]").cast("long").alias("n"))


def q_source_fallback(spark, d):
    s = samples(spark, d).select("track", "id", (F.col("id") % 4).alias("priority")).where("(track + priority) % 3 > 0")
    return L.first_with_rows(s, "track", "priority")


def q_best_format(spark, d):
    l = table(spark, d, "lineitem")
    return L.best_format(l.select(F.col("l_orderkey").alias("video"), (F.col("l_quantity") * 30).cast("int").alias("height"), F.col("l_partkey").alias("bandwidth"), F.col("l_linenumber").alias("id")), "video")


def q_text_query_vector(spark, d):
    text = F.concat(F.col("prompt"), F.lit(" "), F.get(F.array(*map(F.lit, WORDS)), (F.col("turn") % len(WORDS)).cast("int")))
    v = prompts(spark, d).select("conv_id", "turn", V.text_vector(text).alias("v"))
    return v.select("conv_id", "turn", F.posexplode("v").alias("dim", "x")).where("x <> 0")


WORDS = ["bright red flat", "dark blue night", "white", "yellow golden soft", "black", "plain"]


def _vector_sql() -> str:
    has = lambda words: "(" + " or ".join(f"contains(t, '{w}')" for w in words) + ")"
    dims = ", ".join("coalesce(" + ", ".join(f"case when {has(w)} then {v} end" for w, v in rules) + ", 0.5)::double - 0.5" if rules else "0.0::double" for rules in V.rules_by_dimension().values())
    words = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
    return f"""with {PROMPT_SQL}, q as (select conv_id, turn, lower(prompt || ' ' || ({words})[(turn % {len(WORDS)}) + 1]) as t from prompts), v as (select conv_id, turn, [{dims}] as v from q),
n as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from v), u as (select conv_id, turn, unnest(range({V.DIM})) as dim, unnest(v) as x, n from n) select conv_id, turn, dim, x / n as x from u where x <> 0"""


def q_histogram(spark, d):
    top = samples(spark, d).agg(F.max("v").alias("top"))
    b = samples(spark, d).crossJoin(F.broadcast(top)).select("track", V.histogram_bin(F.col("v") / F.col("top")).alias("bin"))
    return b.groupBy("track", "bin").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("track")))


def q_similarity_dedup(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 17).cast("double").alias("score"), F.col("embedding").cast("array<double>").alias("embedding"))
    return S.similarity_dedup(v, 0.25)


def _frames(spark, d):
    e = table(spark, d, "embeddings")
    f = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.transform(F.slice("embedding", 1 + i * 8, 8), lambda x: x.cast("double") * 100))
    return e.select("vec_id", f.alias("frames"))


def q_window_min_mse(spark, d):
    """Fingerprints of seven frames; every 50th against all."""
    f = _frames(spark, d)
    return S.window_distances(f.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "a"), f.withColumnRenamed("vec_id", "b"))


def q_window_matches(spark, d):
    """All pairs of fingerprints with windows under a threshold."""
    return S.window_matches(_frames(spark, d).withColumnRenamed("vec_id", "id"), CLOSE).withColumn("mse", F.round("mse", 6))


def q_visual_dedup(spark, d):
    """Fingerprints of seven frames; every eleventh has too few, and every thirteenth none."""
    i = F.col("vec_id")
    f = _frames(spark, d).select(i.alias("id"), (i % 17).cast("double").alias("highlight_score"), (i % 5).cast("double").alias("start_time"), F.when(i % 13 == 0, None).when(i % 11 == 0, F.slice("frames", 1, 3)).otherwise(F.col("frames")).alias("frames"))
    return S.visual_dedup(f, CLOSE)


def q_select_distinct(spark, d):
    """Highlights without shots that look like a better one; the first shots have fingerprints."""
    return S.select_distinct(scored(spark, d), _frames(spark, d).withColumnRenamed("vec_id", "shot_id"), CLOSE)


CLOSE = 120.0
_WINDOWS = """f as (select vec_id, list_transform(range(7), lambda i: list_transform(embedding[1 + i * 8:8 + i * 8], lambda x: x::double * 100)) as fr from embeddings),
wa as (select vec_id as a, flatten(fr[i + 1:i + 4]) as w from f, range(0, 4, 2) r(i)), wb as (select vec_id as b, flatten(fr[j + 1:j + 4]) as w from f, range(4) r(j)),
m as (select a, b, min(list_sum(list_transform(list_zip(wa.w, wb.w), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) / 32) as mse from wa, wb where a <> b and sqrt(greatest(list_avg(list_transform(wa.w, lambda x: x * x)) - pow(list_avg(wa.w), 2), 0)) >= 2 group by a, b)"""
_DISTINCT = f"""{SHOTS}, all_scored as (select *, {SCORE} as highlight_score from shots), {_WINDOWS},
ed as (select a, list(b) as near from m where mse < {CLOSE} group by a), od as (select list([{{'id': shot_id, 'near': coalesce(near, [])}}] order by highlight_score desc, start_time, shot_id) as l from all_scored join embeddings on vec_id = shot_id left join ed on a = shot_id),
kd as (select list_reduce(l, lambda t, x: case when len(list_filter(t, lambda y: list_contains(x[1].near, y.id))) > 0 then t else list_concat(t, x) end) as k from od),
scored as (select * from all_scored where shot_id not in (select vec_id from embeddings) or shot_id in (select unnest(list_transform(k, lambda x: x.id)) from kd))"""
MSE = """with f as (select vec_id, list_transform(range(7), lambda i: list_transform(embedding[1 + i * 8:8 + i * 8], lambda x: x::double * 100)) as fr from embeddings),
wa as (select vec_id as a, i, flatten(fr[i + 1:i + 4]) as w from f, range(0, 4, 2) r(i) where vec_id % 50 = 0), wb as (select vec_id as b, j, flatten(fr[j + 1:j + 4]) as w from f, range(4) r(j)),
m as (select a, b, case when sqrt(greatest(list_avg(list_transform(wa.w, lambda x: x * x)) - pow(list_avg(wa.w), 2), 0)) < 2 then 'infinity'::double else list_avg(list_transform(list_zip(wa.w, wb.w), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) end as mse from wa, wb)
select a, b, min(mse) as mse from m group by a, b"""


def q_crop_expression(spark, d):
    keys = F.array(*[F.struct((F.col("id") % 5 + 2 * i).cast("int").alias("t"), (F.col("id") % 7 + 3 * i).cast("int").alias("v")) for i in range(3)])
    return samples(spark, d).select("id", V.lerp_expression(keys).alias("expr"))


def q_fingerprint(spark, d):
    return table(spark, d, "pages").select("page_id", F.substring(F.sha1("url"), 1, 16).alias("key"), F.substring(F.md5("url"), 1, 10).alias("short"))


def q_suggest_transition(spark, d):
    w = Window.partitionBy("track").orderBy("t", "id")
    s = samples(spark, d).select("track", "id", "v", "kind", F.lag("v").over(w).alias("pv"), F.lag("kind").over(w).alias("pk")).where("pv is not null")
    fast, differ = (F.col("v") > 80) & (F.col("pv") > 80), F.col("kind") != F.col("pk")
    kind = F.when(fast, F.lit("motion_blur")).when(differ, F.lit("dissolve")).otherwise(F.lit("fade"))
    return s.select("track", "id", kind.alias("transition"), F.when(fast, 0.2).when(differ, 0.5).otherwise(0.3).alias("duration"))


_S = "s as (select user_id as track, event_id as id, value as v, event_type as kind, ts from events)"
QUERIES = {
    "scene_cut_log": (q_scene_cuts, f"with {_S} select distinct track, id + 0.5::double as t from s"),
    "black_range_log": (q_black_ranges, f"with {_S}, i as (select track, id::double as a, (id + id % 90)::double as b from s), m as (select *, coalesce((a - max(b) over (partition by track order by a, b rows between unbounded preceding and 1 preceding) > 0.02)::int, 1) as new from i), g as (select *, sum(new) over (partition by track order by a, b rows unbounded preceding) as g from m) select track, min(a) as a, max(b) as b from g group by track, g"),
    "silence_log": (q_silences, f"with {_S} select track, id::double as a, (case when id % 7 > 0 then id + 1 else id + 2 end)::double as b from s where kind = 'view'"),
    "volume_stats": (q_volume_stats, f"with {_S} select id, -(id % 60) - 0.5::double as mean_db, -(id % 9)::double as max_db from s"),
    "mix_spec": (q_mix_spec, f"with {_S} select id, i::int as i, id || '.wav' as path, case i when 0 then 'bgm' else 'other' end as role, case when id % 2 = 0 then -3.5 else 0.0 end::double as gain_db, case when id % 2 = 0 then 0.0 else 2.0 end::double as start, id % 2 = 1 as loop, null::double as duck_db from s, range(2) r(i) where id % 10 <> 9"),
    "json_repair": (q_json_repair, f"with {_S} select id, id as back, 'b' as tag, 2::bigint as n from s"),
    "source_fallback_first_nonempty": (q_source_fallback, f"with {_S}, r as (select track, id, id % 4 as priority from s where (track + id % 4) % 3 > 0) select * from r qualify priority = min(priority) over (partition by track)"),
    "best_format": (q_best_format, "select l_orderkey as video, arg_max(l_linenumber, {'f': (l_quantity * 30)::int <= 720, 'h': (l_quantity * 30)::int, 'b': l_partkey, 'i': l_linenumber}) as id, arg_max((l_quantity * 30)::int, {'f': (l_quantity * 30)::int <= 720, 'h': (l_quantity * 30)::int, 'b': l_partkey, 'i': l_linenumber}) as height, arg_max(l_partkey, {'f': (l_quantity * 30)::int <= 720, 'h': (l_quantity * 30)::int, 'b': l_partkey, 'i': l_linenumber}) as bandwidth from lineitem group by l_orderkey"),
    "text_query_vector": (q_text_query_vector, _vector_sql()),
    "value_histogram": (q_histogram, f"with {_S}, b as (select track, least(floor(v / (select max(v) from s) * 8), 7)::int as bin from s), n as (select track, bin, count(*) as n from b group by all) select *, n / sum(n) over (partition by track) as share from n"),
    "similarity_dedup": (q_similarity_dedup, "with o as (select list([{'id': vec_id, 'v': list_transform(embedding, lambda x: x::double)}] order by vec_id % 17 desc, vec_id) as l from embeddings), k as (select list_reduce(l, lambda a, x: case when len(list_filter(a, lambda y: 1 - list_sum(list_transform(list_zip(x[1].v, y.v), lambda z: z[1] * z[2])) < 0.25)) > 0 then a else list_concat(a, x) end) as k from o), s as (select unnest(list_transform(k, lambda x: x.id)) as id from k) select vec_id as id, vec_id not in (select id from s) as dropped from embeddings"),
    "window_min_mse": (q_window_min_mse, MSE),
    "window_matches": (q_window_matches, f"with {_WINDOWS} select a, b, round(mse, 6) as mse from m where mse < {CLOSE}"),
    "visual_dedup": (q_visual_dedup, f"with {_WINDOWS}, e as (select a, list(b) as near from m where mse < {CLOSE} and a % 13 > 0 and a % 11 > 0 and b % 13 > 0 and b % 11 > 0 group by a), o as (select list([{{'id': vec_id, 'near': coalesce(near, [])}}] order by vec_id % 17 desc, vec_id % 5, vec_id) as l from embeddings left join e on a = vec_id), k as (select list_reduce(l, lambda t, x: case when len(list_filter(t, lambda y: list_contains(x[1].near, y.id))) > 0 then t else list_concat(t, x) end) as k from o), s as (select unnest(list_transform(k, lambda x: x.id)) as id from k) select vec_id as id, vec_id not in (select id from s) as dropped from embeddings"),
    "select_distinct_highlights": (q_select_distinct, f"with recursive {SELECTED.replace(SCORED, _DISTINCT)} select * from picked"),
    "crop_expression": (q_crop_expression, f"with {_S}, k as (select id, (id % 5)::int as t, (id % 7)::int as v from s) select id, 'if(lt(t,' || t + 2 || '),' || v || '+(3)*(t-' || t || ')/2,if(lt(t,' || t + 4 || '),' || v + 3 || '+(3)*(t-' || t + 2 || ')/2,' || v + 6 || '))' as expr from k"),
    "content_fingerprint": (q_fingerprint, "select page_id, left(sha1(url), 16) as key, left(md5(url), 10) as short from pages"),
    "suggest_transition": (q_suggest_transition, f"with {_S}, p as (select *, lag(v) over w as pv, lag(kind) over w as pk from s window w as (partition by track order by ts, id)) select track, id, case when v > 80 and pv > 80 then 'motion_blur' when kind <> pk then 'dissolve' else 'fade' end as transition, case when v > 80 and pv > 80 then 0.2 when kind <> pk then 0.5 else 0.3 end::double as duration from p where pv is not null"),
}
