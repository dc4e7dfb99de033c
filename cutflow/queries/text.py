"""Captions, prompts and scraped pages."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Window

from ..functions import text as T
from ..tables import table

PROMPTS = ["做一个30秒的漫威高燃混剪", "平静的纪录片风格", "复古怀旧的视频", "好莱坞大片风格", "卡点AMV 15s 竖屏 只留BGM", "多一点镜头 去黑场 4:5 保留原声", "Make a warm cinematic look, 400 sec", "dramatic suspense 2.5 秒 TikTok", ""]


def prompts(spark, d):
    pick = F.get(F.array(*map(F.lit, PROMPTS)), (F.col("conv_id") % len(PROMPTS)).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", pick.alias("prompt"))


_list = "[" + ", ".join(f"'{p}'" for p in PROMPTS) + "]"
PROMPT_SQL = f"prompts as (select conv_id, turn, ({_list})[(conv_id % {len(PROMPTS)}) + 1] as prompt, lower(trim(({_list})[(conv_id % {len(PROMPTS)}) + 1])) as t from conversations)"


def _any(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(t, '{w}')" for w in words) + ")"


def _first(rules) -> str:
    return "case " + " ".join(f"when {_any(w)} then '{label}'" for label, w in rules) + " end"


def q_effect_prompt_params(spark, d):
    return prompts(spark, d).select("conv_id", "turn", *T.effect_params(F.col("prompt")))


EFFECT_SQL = f"""with {PROMPT_SQL}, x as (select *, try_cast(nullif(regexp_extract(t, '(\\d+(?:\\.\\d+)?)\\s*(?:秒|s\\b|sec)', 1), '') as double) as sec from prompts)
select conv_id, turn, {_first(T.STYLE_RULES)} as style, case when {_any(T.SOUND_WORDS)} then true end as enable_sfx, {_first(T.DENSITY_RULES)} as shot_density, case when {_any(T.ANIME_WORDS)} then 0.5::double end as threshold,
case when sec between 2 and 300 then sec end as target_duration, ({_first(T.MUTE_RULES)})::boolean as mute_source_audio, case when {_any(T.BLACK_WORDS)} then true end as clean_black, {_first(T.ASPECT_RULES)} as aspect_ratio from x"""


def q_style_infer(spark, d):
    t = F.lower(F.col("prompt"))
    return prompts(spark, d).select("conv_id", "turn", F.coalesce(T.first_match(t, T.STYLE_WORDS), T.first_match(t, T.MOOD_STYLES)).alias("style"), F.coalesce(T.first_match(t, T.COLOR_WORDS), F.lit("neutral")).alias("color"))


def captions(spark, d):
    """Sentences of each conversation one after the other in time: conv_id, turn, i, text, a, b."""
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("i", "text"))
    timed = lines.withColumn("len", T.read_seconds(F.col("text")))
    end = F.sum(F.round(F.col("len") * 100).cast("bigint")).over(Window.partitionBy("conv_id").orderBy("turn", "i")) / 100
    return timed.select("conv_id", "turn", "i", "text", (end - F.col("len")).alias("a"), end.alias("b"))


_strip = "regexp_replace(trim(trim(x), '\"''“”‘’'), '^\\d+[.、)]\\s*', '')"
CAPTIONS = f"""lines as (select conv_id, turn, list_filter(list_transform(flatten(list_transform(string_split(text, chr(10)), lambda x: string_split(regexp_replace({_strip}, '([。！？!?])', '\\1' || chr(1), 'g'), chr(1)))), lambda y: trim(y)), lambda y: y <> '') as s from conversations),
ex as (select conv_id, turn, unnest(range(len(s))) as i, unnest(s) as text from lines), ln as (select *, floor(len(regexp_replace(text, '\\s', '', 'g')) / 4.5::double * 100 + 0.5) / 100 as len from ex),
cap as (select conv_id, turn, i, text, (sum(round(len * 100)::bigint) over w / 100.0::double - len) as a, sum(round(len * 100)::bigint) over w / 100.0::double as b from ln window w as (partition by conv_id order by turn, i))"""


def q_script_sentences(spark, d):
    return captions(spark, d)


def q_caption_times(spark, d):
    c = captions(spark, d)
    a = F.col("b")
    return c.select("conv_id", "turn", "i", T.srt_time(a).alias("srt"), T.srt_time(a, ".").alias("vtt"), T.ass_time(a).alias("ass"), T.timecode(a).alias("smpte"))


_h = "lpad(floor(floor(b) / 3600)::bigint::varchar, 2, '0') || ':' || lpad(floor((floor(b) % 3600) / 60)::bigint::varchar, 2, '0') || ':' || lpad((floor(b) % 60)::bigint::varchar, 2, '0')"
TIMES_SQL = f"""with {CAPTIONS}, k as (select *, round_even(b * 100, 0)::bigint as cs from cap)
select conv_id, turn, i, {_h} || ',' || lpad(floor((b - floor(b)) * 1000)::bigint::varchar, 3, '0') as srt, {_h} || '.' || lpad(floor((b - floor(b)) * 1000)::bigint::varchar, 3, '0') as vtt,
(cs // 360000)::varchar || ':' || lpad(((cs % 360000) // 6000)::varchar, 2, '0') || ':' || lpad(((cs % 6000) // 100)::varchar, 2, '0') || '.' || lpad((cs % 100)::varchar, 2, '0') as ass,
{_h} || ':' || lpad(floor((b - floor(b)) * 30)::bigint::varchar, 2, '0') as smpte from k"""


def srt_files(spark, d):
    """conv_id, srt: a whole caption file for each conversation of bounded length."""
    c = captions(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "i")))
    cue = F.concat(F.col("n").cast("string"), F.lit("\n"), T.srt_time(F.col("a")), F.lit(" --> "), T.srt_time(F.col("b")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", cue.alias("cue")))), lambda x: x["cue"]), "\n").alias("srt"))


def q_srt_parse(spark, d):
    """Caption files read back into cues."""
    from ..sources.captions import parse_srt

    return parse_srt(srt_files(spark, d), "srt").select("conv_id", "n", "text")


def q_caption_layout(spark, d):
    """The font size at which the longest caption of each conversation fits nine tenths of 1280 pixels."""
    order = F.struct(F.char_length("text").alias("n"), (-F.col("turn")).alias("turn"), (-F.col("i")).alias("i"))
    longest = captions(spark, d).groupBy("conv_id").agg(F.max_by(T.text_width(F.col("text")), order).alias("w"))
    return longest.select("conv_id", "w", T.fitting_font(F.col("w"), 1280).alias("font"))


def q_html_scrape(spark, d):
    p = table(spark, d, "pages")
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return p.select("page_id", F.trim(T.strip_html(title)).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r"<a href=\"([^\"]*)\""), F.lit(1))).alias("links"), F.regexp_extract("url", r"/(\d+)", 1).alias("id"))


def q_id_dedup_first(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"/(\d+)", 1).alias("id"))
    return p.groupBy("id").agg(F.min("page_id").alias("page_id")).where("id <> ''")


STOP_WORDS = ["idiot", "stupid", "moron", "pathetic", "clown", "hate"]


def q_stopword_filter(spark, d):
    p = table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("t"))
    return p.where(~T.has_any(F.col("t"), STOP_WORDS)).select("page_id")


def q_duration_parse(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    text = F.when(i % 3 == 0, F.concat((i % 60).cast("string"), F.lit(":"), F.lpad((i % 59).cast("string"), 2, "0"))).when(i % 3 == 1, F.concat((i % 3).cast("string"), F.lit(":"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit(":07"))).otherwise(F.lit("soon"))
    return e.select("event_id", text.alias("text"), T.clock_seconds(text).alias("seconds")).where("seconds >= 10 and seconds <= 6000")


QUERIES = {
    "effect_prompt_params": (q_effect_prompt_params, EFFECT_SQL),
    "style_infer": (q_style_infer, f"with {PROMPT_SQL} select conv_id, turn, coalesce({_first(T.STYLE_WORDS)}, {_first(T.MOOD_STYLES)}) as style, coalesce({_first(T.COLOR_WORDS)}, 'neutral') as color from prompts"),
    "script_sentences": (q_script_sentences, f"with {CAPTIONS} select * from cap"),
    "caption_times": (q_caption_times, TIMES_SQL),
    "srt_parse": (q_srt_parse, f"with {CAPTIONS} select conv_id, row_number() over (partition by conv_id order by turn, i) as n, text from cap"),
    "caption_layout": (q_caption_layout, f"with {CAPTIONS}, w as (select conv_id, arg_max(len(regexp_replace(text, '[\\x{{0}}-\\x{{2E80}}]', '', 'g')) * 0.5 + len(text) * 0.5, {{'n': len(text), 't': -turn, 'i': -i}})::double as w from cap group by conv_id) select conv_id, w, (case when w * 48 > 1152 then greatest(16, floor(48 * (1152 / (w * 48)))) else 48 end)::int as font from w"),
    "html_scrape": (q_html_scrape, "select page_id, trim(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')) as title, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))::int as links, regexp_extract(url, '/(\\d+)', 1) as id from pages"),
    "id_dedup_first": (q_id_dedup_first, "select regexp_extract(url, '/(\\d+)', 1) as id, min(page_id) as page_id from pages group by 1 having id <> ''"),
    "stopword_filter": (q_stopword_filter, "with p as (select page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) as t from pages) select page_id from p where not " + _any(STOP_WORDS)),
    "duration_parse": (q_duration_parse, "with e as (select event_id, event_id as i from events), t as (select event_id, case when i % 3 = 0 then (i % 60)::varchar || ':' || lpad((i % 59)::varchar, 2, '0') when i % 3 = 1 then (i % 3)::varchar || ':' || lpad((i % 60)::varchar, 2, '0') || ':07' else 'soon' end as text, case when i % 3 = 0 then (i % 60) * 60.0 + i % 59 when i % 3 = 1 then (i % 3) * 3600.0 + (i % 60) * 60 + 7 else 0.0 end::double as seconds from e) select * from t where seconds >= 10 and seconds <= 6000"),
}
