"""The vector index, landed search results, and the choice of sources."""

from __future__ import annotations

import pyspark.sql.functions as F

from ..operators import index as X
from ..sources import search as W
from ..tables import samples, shared_folder, table

DAY = 86400.0
_S = "s as (select user_id as track, event_id as id, value as v, event_type as kind from events)"


def _pick(values: list, by) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))


def _sql(values: list, by: str) -> str:
    return "([" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + f"])[({by} % {len(values)}) + 1]"


def _index(spark, d):
    """A shot for each vector, saved as an index of its first thirty values and loaded again."""
    e = table(spark, d, "embeddings")
    path = f"{shared_folder(spark, 'index')}/shots"
    records = e.select("vec_id", F.concat(F.lit("video"), (F.col("vec_id") % 7).cast("string")).alias("source_video"))
    X.save_index(records, e.select("vec_id", F.slice("embedding", 1, 30).alias("embedding")), "vec_id", path)
    return X.load_index(spark, path)


def q_index_describe(spark, d):
    return X.describe(_index(spark, d))


QUERIES_TEXT = ["bright red flat", "dark blue night", "white", "soft golden light", "nothing of that kind"]


def q_text_search(spark, d):
    queries = spark.range(1).select(F.posexplode(F.array(*map(F.lit, QUERIES_TEXT))).alias("query_id", "query"))
    return X.search(_index(spark, d), 10, 0.0, texts=queries).select("query_id", "vec_id", F.round("score", 9).alias("score"), "rank")


def _text_search_sql() -> str:
    from ..functions import features as V

    has = lambda words: "(" + " or ".join(f"contains(t, '{w}')" for w in words) + ")"
    dims = ", ".join("coalesce(" + ", ".join(f"case when {has(w)} then {v} end" for w, v in rules) + ", 0.5)::double - 0.5" if rules else "0.0::double" for rules in V.rules_by_dimension().values())
    queries = ", ".join(f"({i}, '{t}')" for i, t in enumerate(QUERIES_TEXT))
    return f"""with q(query_id, t) as (values {queries}), r as (select query_id, [{dims}] as v from q), u as (select query_id, list_transform(v, lambda x: x / case when n = 0 then 1 else n end) as q from (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from r)),
e as (select vec_id, list_transform(w, lambda x: x / n) as e from (select vec_id, w, sqrt(list_sum(list_transform(w, lambda x: x * x))) as n from (select vec_id, list_transform(embedding[1:30], lambda x: x::double) as w from embeddings))),
s as (select query_id, vec_id, list_sum(list_transform(list_zip(e, q), lambda x: x[1] * x[2])) as score from e, u)
select query_id, vec_id, round(score, 9) as score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where score >= 0 qualify rank <= 10"""


def q_pair_by_position(spark, d):
    s = samples(spark, d).select("track", "id", "v", "kind")
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("track").orderBy("id")) - 1
    left = s.select("track", pos.alias("pos"), "kind")
    right = s.select("track", pos.alias("pos"), F.concat(F.lit("say "), F.col("kind")).alias("translated"))
    return X.pair_by_position(left, right, "track", "pos").select("track", "pos", "kind", "translated")


def _pixels():
    """Twenty pixels of three values from each vector."""
    unit = lambda i: F.abs(F.get("embedding", i).cast("double"))
    return F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.struct(unit(i * 3).alias("r"), unit(i * 3 + 1).alias("g"), unit(i * 3 + 2).alias("b")))


def q_image_features(spark, d):
    return table(spark, d, "embeddings").select("vec_id", X.image_features(_pixels()).alias("f")).select("vec_id", "f.*")


def _image_index(spark, d):
    e = table(spark, d, "embeddings")
    path = f"{shared_folder(spark, 'index')}/images"
    X.save_index(e.select("vec_id"), e.select("vec_id", X.image_vector(_pixels()).alias("embedding")), "vec_id", path, "pixels", supports_text=False)
    return path


def q_image_search(spark, d):
    """Every 50th image against all."""
    images = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), _pixels().alias("pixels"))
    found = X.search_image(X.load_index(spark, _image_index(spark, d), dim=4), images, 5)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"))


def q_index_header(spark, d):
    return X.header(spark, _image_index(spark, d)).select("embedder", "dim", "supports_text", "count")


def _landed(spark, d):
    """A page of results for each user and hundred events, as JSON."""
    i = F.col("id")
    r = F.struct(F.when(i % 11 > 0, F.concat(F.lit("BV"), i.cast("string"))).otherwise(F.lit("")).alias("bvid"), F.concat(F.lit("<em>"), F.col("kind"), F.lit("</em> &amp; more")).alias("title"), F.concat((i % 14).cast("string"), F.lit(":"), F.lpad((i % 60).cast("string"), 2, "0")).alias("duration"), F.lit("me").alias("author"), F.repeat(F.lit("d"), (i % 300).cast("int")).alias("description"))
    s = samples(spark, d).select("track", F.floor(i / 100).alias("page"), F.struct("id", r.alias("r")).alias("x"))
    pages = s.groupBy("track", "page").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("result"))).alias("body"))
    return pages.withColumn("body", F.when(F.col("page") % 13 == 5, F.lit("{broken")).otherwise(F.col("body")))


def q_search_pages(spark, d):
    found = W.paged_results(_landed(spark, d), "track", "page", "body")
    return found.select("track", "place", "bvid", "title", "seconds", F.length("description").alias("n"))


def q_search_json_lines(spark, d):
    i = F.col("id")
    address = F.when(i % 3 == 0, F.concat(F.lit(',"url":"u'), i.cast("string"), F.lit('"'))).when(i % 3 == 1, F.concat(F.lit(',"webpage_url":"w'), i.cast("string"), F.lit('"'))).otherwise(F.lit(""))
    line = F.when(i % 7 == 0, F.lit('{"id": "cut off')).otherwise(F.concat(F.lit('{"id":"'), i.cast("string"), F.lit('","duration":'), (i % 90).cast("string"), address, F.lit("}")))
    return W.json_lines(samples(spark, d).select(line.alias("line")), "line")


def q_page_blocks(spark, d):
    i = F.col("id")
    block = F.concat(F.lit('x bvid:"BV'), (i % 40).cast("string"), F.lit('",title:"'), F.col("kind"), F.when(i % 6 == 0, F.lit(" 教程")).otherwise(F.lit("")), F.lit('",duration:"'), (i % 12).cast("string"), F.lit(':05"'))
    pages = samples(spark, d).groupBy("track").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", block.alias("b")))), lambda x: x["b"]), "\n").alias("text"))
    return W.page_blocks(pages, "track", "text")


MOODS = ["calm piano", "lofi bgm", "热血音乐", ""]


def q_keyword_variants(spark, d):
    return samples(spark, d).select("id", F.posexplode(W.keyword_variants(_pick(MOODS, F.col("id")))).alias("variant", "keyword"))


def q_music_results(spark, d):
    s = samples(spark, d).select("track", (F.col("id") % 3).alias("variant"), "id", (F.col("id") % 900).cast("double").alias("seconds")).where("(track + variant) % 4 > 0 and (track % 5 > 0 or seconds > 600)")
    return W.music_results(s, "track")


ASKED = ["funny cat", "搞笑 猫", ""]


def q_source_order(spark, d):
    i = F.col("id")
    sources = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.get(F.array(*map(F.lit, [*W.KNOWN, "nowhere"])), ((k * k + i) % 6).cast("int")))
    return samples(spark, d).select("id", F.array_join(W.source_order(_pick(ASKED, i), sources), ",").alias("sources"))


def q_merged_settings(spark, d):
    given = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("style"), F.col("kind"))).otherwise(F.create_map(F.lit("speed"), F.lit("2")))
    merged = W.merged_settings(F.create_map(F.lit("style"), F.lit("dynamic"), F.lit("source"), F.lit("any")), given)
    return samples(spark, d).select("id", F.explode(merged).alias("name", "value"))


def q_weighted_emotion(spark, d):
    """The mean emotion score of each track, weighted by confidence."""
    weight = (F.col("id") % 10) / 10
    from ..functions.scoring import EMOTIONS

    score = F.element_at(F.array(*map(F.lit, EMOTIONS.values())), (F.col("id") % len(EMOTIONS) + 1).cast("int"))
    return samples(spark, d).groupBy("track").agg((F.sum(score * weight) / F.sum(weight)).alias("emotion")).where("emotion is not null")


def q_best_frame(spark, d):
    """Of each track's samples, as frames, the one with the best score; the earliest of equals."""
    from ..functions.scoring import frame_score

    s = samples(spark, d).select("track", "id", "t", frame_score(F.round("v") % 30, (F.col("id") % 100) / 100).alias("score"))
    return s.groupBy("track").agg(F.max(F.struct("score", (-F.col("t")).alias("t"), (-F.col("id")).alias("id"))).alias("x")).select("track", (-F.col("x.id")).alias("id"), "x.score")


_items = "i as (select track, id, id // 100 as page, case when id % 11 > 0 then 'BV' || id else '' end as bvid, kind || ' & more' as title, (id % 14) * 60.0 + id % 60 as seconds, least(id % 300, 200) as n from s)"
IMAGES = "with p as (select vec_id, list_transform(range(20), lambda i: {'r': abs(embedding[i * 3 + 1]::double), 'g': abs(embedding[i * 3 + 2]::double), 'b': abs(embedding[i * 3 + 3]::double)}) as p from embeddings), g as (select *, list_transform(p, lambda x: x.r * 0.299::double + x.g * 0.587::double + x.b * 0.114::double) as g from p) select vec_id, list_avg(g) as brightness, least(1.0, sqrt(greatest(list_avg(list_transform(g, lambda x: x * x)) - pow(list_avg(g), 2), 0)) / 0.35::double) as contrast, list_avg(list_transform(p, lambda x: case when greatest(x.r, x.g, x.b) > 1e-6 then (greatest(x.r, x.g, x.b) - least(x.r, x.g, x.b)) / greatest(x.r, x.g, x.b) else 0 end)) as saturation, (list_avg(list_transform(p, lambda x: x.r)) - list_avg(list_transform(p, lambda x: x.b)) + 1) / 2 as warmth from g"
_FEATURES = f"f as ({IMAGES}), v as (select vec_id, [brightness - 0.5, contrast - 0.5, saturation - 0.5, warmth - 0.5] as v from f), u as (select vec_id, list_transform(v, lambda x: x / case when n = 0 then 1 else n end) as u from (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from v))"
QUERIES = {
    "index_describe": (q_index_describe, "select count(*) as shots, max(len(embedding[1:30]))::int as dim, count(distinct vec_id % 7) as videos from embeddings"),
    "text_search": (q_text_search, _text_search_sql()),
    "pair_by_position": (q_pair_by_position, f"with {_S} select track, row_number() over (partition by track order by id) - 1 as pos, kind, 'say ' || kind as translated from s"),
    "image_features": (q_image_features, IMAGES),
    "image_search": (q_image_search, f"with {_FEATURES}, s as (select q.vec_id as query_id, e.vec_id, list_sum(list_transform(list_zip(e.u, q.u), lambda x: x[1] * x[2])) as score from u e, u q where q.vec_id % 50 = 0) select query_id, vec_id, round(score, 6) as score from s where score >= 0 qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5"),
    "index_header": (q_index_header, "select 'pixels' as embedder, case when count(*) > 0 then 4 else 0 end::int as dim, false as supports_text, count(*) as count from embeddings"),
    "search_pages": (q_search_pages, f"with {_S}, {_items} select track, row_number() over (partition by track order by page, id) as place, bvid, title, seconds::double as seconds, n::int as n from i where page % 13 <> 5 and seconds between 10 and 600 and bvid <> '' qualify place <= 20"),
    "search_json_lines": (q_search_json_lines, f"with {_S} select id::varchar as id, '' as title, (id % 90)::double as seconds, case id % 3 when 0 then 'u' else 'w' end || id as url, '' as uploader from s where id % 7 <> 0 and id % 3 < 2"),
    "page_blocks": (q_page_blocks, f"with {_S}, g as (select track, id, 'BV' || id % 40 as bvid, kind as title, (id % 12) * 60.0 + 5 as seconds from s where id % 6 <> 0 and (id % 12) * 60 + 5 between 10 and 600), f as (select * from g qualify row_number() over (partition by track, bvid order by id) = 1) select track, row_number() over (partition by track order by id) as place, bvid, title, seconds::double as seconds from f qualify place <= 20"),
    "keyword_variants": (q_keyword_variants, f"with {_S}, k as (select id, {_sql(MOODS, 'id')} as k from s), l as (select id, case when contains(lower(k), 'bgm') or contains(k, '音乐') then [k] else [k || ' BGM', k || ' 纯音乐', k] end as l from k) select id, unnest(range(len(l)))::int as variant, unnest(l) as keyword from l"),
    "music_results": (q_music_results, f"with {_S}, r as (select track, id % 3 as variant, id, (id % 900)::double as seconds from s where (track + id % 3) % 4 > 0 and (track % 5 > 0 or id % 900 > 600)), o as (select * from r qualify variant = min(variant) over (partition by track)), f as (select *, seconds between 15 and 600 as fits, max((seconds between 15 and 600)::int) over (partition by track) as fitting from o) select track, row_number() over (partition by track order by seconds, id) as place, id, seconds from f where fits or fitting = 0 qualify place <= 10"),
    "source_order": (q_source_order, f"with {_S}, l as (select id, {_sql(ASKED, 'id')} as q, list_transform(range(5), lambda k: ({[*W.KNOWN, 'nowhere']!r})[((k * k + id) % 6) + 1]) as l from s), k as (select id, q, list_filter(l, lambda x, i: x <> 'nowhere' and not list_contains(l[1:i - 1], x)) as l from l) select id, array_to_string(case when q like '搞笑%' then list_concat(list_filter(l, lambda x: x = 'bilibili'), list_filter(l, lambda x: x not in ('bilibili', 'playphrase', 'quodb'))) else list_filter(l, lambda x: x <> 'quodb') end, ',') as sources from k"),
    "merged_settings": (q_merged_settings, f"with {_S} select id, 'source' as name, 'any' as value from s union all select id, 'style', case when id % 2 = 0 then kind else 'dynamic' end from s union all select id, 'speed', '2' from s where id % 2 = 1"),
    "weighted_emotion": (q_weighted_emotion, f"with {_S}, e as (select track, ([0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.1])[(id % 7) + 1]::double as x, (id % 10) / 10.0::double as w from s) select track, sum(x * w) / sum(w) as emotion from e group by track having sum(w) > 0"),
    "best_frame": (q_best_frame, f"with s as (select user_id as track, event_id as id, ts, value as v from events), m as (select track, id, ts, round(v) % 30 as q, (id % 100) / 100.0::double as b from s), f as (select track, id, ts, 0.7 * ln(1 + q) + 0.3 * greatest(case when b between 0.35 and 0.65 then 1.0 when b < 0.35 then b / 0.35 else (1 - b) / 0.35 end, 0.0) * ln(1 + q) as score from m) select track, id, score from f qualify row_number() over (partition by track order by score desc, ts, id) = 1"),
}
