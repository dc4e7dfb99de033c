"""Single values: ratios, names, stamps, filters, and settings that a prompt changes."""

from __future__ import annotations

import pyspark.sql.functions as F

from ..functions import text as T
from ..functions import values as V
from ..tables import samples, table
from .text import PROMPT_SQL, prompts

RATIOS = ["9:16", "bad", "0.5625", "4:0", "", "2.35", "-1", " 16:9 ", "1:1", "21:9", "5:7", "x:2"]
FLOATS = ["-inf", "nan", "-14.25", "", "12", "1e3", "loud"]
TITLES = ['a<b>c:"d"/e', "What? No! It's mine", "plain name", "x" * 70]
LINES = ["01:02:39 hello there", "no stamp", "00:00:07  spaced  text", "12:34:56"]
CHAINS = ["eq=saturation=1.25:contrast=1.1,unsharp=3:3:0.4", "eq=contrast=1.05:brightness=-0.05:saturation=1.1", "eq=contrast=1.3:brightness=0.02", "none"]
PATHS = ["/var/cache/a.mp4", "/var/output/x/y.mp4", "/var/cache/../etc/passwd", "/etc/passwd", "/var/cached/a.mp4"]
ROOTS = ["/var/cache", "/var/upload/", "/var/output"]


def _pick(values: list, by) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))


def _sql(values: list, by: str) -> str:
    return "([" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + f"])[({by} % {len(values)}) + 1]"


def q_ratio(spark, d):
    text = _pick(RATIOS, F.col("id"))
    s = samples(spark, d).select("id", V.parse_ratio(text).alias("ratio"))
    return s.select("id", "ratio", V.ratio_suffix(F.col("ratio")).alias("suffix"))


def q_safe_float(spark, d):
    return samples(spark, d).select("id", V.safe_float(_pick(FLOATS, F.col("id")), -14.0).alias("value"))


def q_safe_name(spark, d):
    t = _pick(TITLES, F.col("id"))
    return samples(spark, d).select("id", V.safe_name(t).alias("title"), V.safe_name(t, "quote").alias("quote"), V.safe_name(t, "address").alias("address"))


def q_stamped(spark, d):
    return samples(spark, d).select("id", *V.stamped_text(_pick(LINES, F.col("id"))))


def q_language(spark, d):
    return table(spark, d, "documents").select("doc_id", V.language_name(F.upper("lang")).alias("name"))


def q_clock(spark, d):
    return samples(spark, d).select("id", V.minutes_seconds(F.col("v") * 7).alias("clock"), V.stamp_text(F.when(F.col("id") % 5 > 0, F.col("id") * 3701.0)).alias("stamp"))


def q_gain(spark, d):
    return samples(spark, d).select("id", V.linear_gain(-(F.col("id") % 40)).alias("gain"), V.task_progress(F.col("id") % 130).alias("progress"))


def q_enhance(spark, d):
    i = F.col("id")
    tenth = lambda n: (i % n) / 10
    return samples(spark, d).select("id", V.denoise_filter(tenth(3) * 2 + 0.1, tenth(7), tenth(5)).alias("denoise"), V.sharpen_filter(tenth(9), (i % 30) / 2).alias("sharpen"), V.grain_filter(_pick([*V.GRAINS, "other"], i), (i % 4) / 4).alias("grain"))


def q_eq(spark, d):
    return samples(spark, d).select("id", V.scale_eq(_pick(CHAINS, F.col("id")), (F.col("id") % 3) * 0.4).alias("chain"))


def q_density(spark, d):
    x = V.density_gap(_pick(["standard", "dense", "max", "odd"], F.col("id")))
    return samples(spark, d).select("id", x.alias("x")).select("id", "x.gap", "x.most")


def q_overlay(spark, d):
    p = prompts(spark, d)
    found = p.select("conv_id", "turn", *T.effect_params(F.col("prompt")))
    style = _pick(["dynamic", "calm"], F.col("turn"))
    length = F.when(F.col("turn") % 3 == 0, F.lit(45.0)).otherwise(F.lit(0.0))
    return found.select("conv_id", "turn", V.overlay(style, F.col("style"), "dynamic").alias("style"), V.overlay(F.lit("standard"), F.col("shot_density"), "standard").alias("shot_density"), V.overlay(F.lit(0.2), F.col("threshold"), 0.2).alias("threshold"), V.overlay(length, F.col("target_duration"), 0.0).alias("target_duration"), F.coalesce("enable_sfx", F.lit(False)).alias("enable_sfx"), F.coalesce("mute_source_audio", F.lit(False)).alias("mute_source"), V.overlay(F.lit("16/9"), F.col("aspect_ratio"), "16/9").alias("aspect_ratio"))


def q_instructions(spark, d):
    return prompts(spark, d).select("conv_id", "turn", V.default_instructions(F.col("prompt")).alias("x")).select("conv_id", "turn", "x.pacing.speed", "x.effects.color_grading", "x.style.name", "x.pacing.intro_duration_beats", "x.constraints.max_clip_duration_sec")


def q_guard(spark, d):
    return samples(spark, d).select("id", V.under_roots(_pick(PATHS, F.col("id")), ROOTS).alias("allowed"))


def q_wrap(spark, d):
    text = F.concat(F.repeat(F.col("kind"), 6), F.lit("\n\n今天聊聊"), F.repeat(F.lit("细节"), (F.col("id") % 9).cast("int")))
    return samples(spark, d).select("id", F.posexplode(V.wrapped(text, 10.0, 100.0)).alias("i", "line"))


def _first(rules) -> str:
    return "case " + " ".join("when (" + " or ".join(f"contains(t, '{w}')" for w in words) + f") then '{label}'" for label, words in rules) + " end"


_S = "s as (select user_id as track, event_id as id, value as v, event_type as kind from events)"
_names = "coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in V.LANGUAGES.items()) + "}[lower(lang)], upper(lang), '')"
_suffix = "case " + " ".join(f"when abs(ratio - {a!r}::double) < 0.001 then '{label}'" for a, label in V.SUFFIXES) + " else replace(regexp_replace(regexp_replace(printf('%.4f', ratio), '0+$', ''), '\\.$', ''), '.', 'p') end"
_eq = lambda name, form: f"case when regexp_matches(c, '{name}=[0-9.]+') then regexp_replace(c, '{name}=[0-9.]+', '{name}=' || {form}) else c end"
_value = lambda name: f"regexp_extract(c, '{name}=([0-9.]+)', 1)::double"
_effects = "select conv_id, turn, t, try_cast(nullif(regexp_extract(t, '(\\d+(?:\\.\\d+)?)\\s*(?:秒|s\\b|sec)', 1), '') as double) as sec from prompts"
_grains = "coalesce(map {" + ", ".join(f"'{k}': {v}" for k, v in V.GRAINS.items()) + "}[g], 8)"
QUERIES = {
    "ratio_parse": (q_ratio, f"with {_S}, t as (select id, trim({_sql(RATIOS, 'id')}) as t from s), r as (select id, coalesce(case when contains(t, ':') then case when try_cast(split_part(t, ':', 2) as double) <> 0 then try_cast(split_part(t, ':', 1) as double) / try_cast(split_part(t, ':', 2) as double) end when try_cast(t as double) > 0 then try_cast(t as double) end, 0.5625::double) as ratio from t) select id, ratio, '_' || {_suffix} as suffix from r"),
    "safe_float": (q_safe_float, f"with {_S}, t as (select id, try_cast({_sql(FLOATS, 'id')} as double) as x from s) select id, case when x is null or not isfinite(x) then -14.0::double else x end as value from t"),
    "safe_name": (q_safe_name, f"with {_S}, t as (select id, {_sql(TITLES, 'id')} as t from s) select id, left(regexp_replace(t, '[<>:\"/\\\\|?*]', '_', 'g'), 60) as title, replace(trim(regexp_replace(left(t, 30), '[^\\w\\s-]', '', 'g')), ' ', '_') as quote, left(regexp_replace(string_split(t, '/')[-1], '[^\\w]', '_', 'g'), 40) as address from t"),
    "stamped_text": (q_stamped, f"with {_S}, t as (select id, {_sql(LINES, 'id')} as t from s), p as (select id, t, regexp_matches(t, '\\d{{2}}:\\d{{2}}:\\d{{2}}\\s+') as ok from t) select id, case when ok then left(t, 2)::int * 3600.0 + substr(t, 4, 2)::int * 60 + substr(t, 7, 2)::int end::double as seconds, case when ok then regexp_extract(t, '\\d{{2}}:\\d{{2}}:\\d{{2}}\\s+(.*)', 1) end as text from p"),
    "language_name": (q_language, f"select doc_id, {_names} as name from documents"),
    "clock_text": (q_clock, f"with {_S} select id, floor(floor(v * 7) / 60)::bigint || ':' || lpad((floor(v * 7)::bigint % 60)::varchar, 2, '0') as clock, case when id % 5 > 0 then strftime(make_timestamp((id * 3701000000)::bigint), '%m-%d %H:%M:%S') else '-' end as stamp from s"),
    "gain_and_progress": (q_gain, f"with {_S} select id, pow(10.0::double, -(id % 40) / 20.0::double) as gain, greatest(30, least(85, trunc(30 + (id % 130) * 0.55::double)::int)) as progress from s"),
    "enhance_filters": (q_enhance, f"with {_S}, x as (select id, (id % 3) / 10.0::double * 2 + 0.1 as t, (id % 7) / 10.0::double as sp, (id % 5) / 10.0::double as c, (id % 9) / 10.0::double as a, greatest(3, least(23, (id % 30)::int * 2 + 1)) as n, {_sql([*V.GRAINS, 'other'], 'id')} as g from s) select id, printf('hqdn3d=%.1f:%.1f:%.1f:%.1f', sp * 8, c * 6, t * 6, c * t * 4) as denoise, printf('unsharp=%d:%d:%.2f:%d:%d:%.2f', n, n, a * 2, n, n, a) as sharpen, 'noise=c0s=' || trunc({_grains} * (id % 4) / 4.0::double)::int || ':c0f=t+u:allf=t+u' as grain from x"),
    "eq_scale": (q_eq, f"with {_S}, a as (select id, (id % 3) * 0.4::double as k, {_sql(CHAINS, 'id')} as c from s), b as (select id, k, {_eq('saturation', 'printf(' + chr(39) + '%.2f' + chr(39) + ', 1 + (' + _value('saturation') + ' - 1) * k)')} as c from a), e as (select id, k, {_eq('contrast', 'printf(' + chr(39) + '%.2f' + chr(39) + ', 1 + (' + _value('contrast') + ' - 1) * k)')} as c from b) select id, {_eq('brightness', 'printf(' + chr(39) + '%.3f' + chr(39) + ', ' + _value('brightness') + ' * k)')} as chain from e"),
    "shot_density": (q_density, f"with {_S} select id, ([1.0, 0.5, 0.0, 1.0])[(id % 4) + 1]::double as gap, ([15, 25, 40, 15])[(id % 4) + 1] as most from s"),
    "prompt_overlay": (q_overlay, f"with {PROMPT_SQL}, x as ({_effects}), y as (select *, {_first(T.STYLE_RULES)} as st, {_first(T.DENSITY_RULES)} as de, {_first(T.ASPECT_RULES)} as asp, {_first(T.MUTE_RULES)} as mute, {_first([('1', T.SOUND_WORDS)])} as sfx, {_first([('1', T.ANIME_WORDS)])} as anime from x) select conv_id, turn, case when turn % 2 = 0 then coalesce(st, 'dynamic') else 'calm' end as style, coalesce(de, 'standard') as shot_density, case when anime = '1' then 0.5 else 0.2 end::double as threshold, case when turn % 3 = 0 then 45.0 when sec between 2 and 300 then sec else 0.0 end::double as target_duration, sfx is not null as enable_sfx, coalesce(mute, 'false') = 'true' as mute_source, coalesce(asp, '16/9') as aspect_ratio from y"),
    "default_instructions": (q_instructions, f"with {PROMPT_SQL}, x as (select conv_id, turn, lower(prompt) as t from prompts) select conv_id, turn, coalesce({_first(V.TEMPO_WORDS)}, 'dynamic') as speed, coalesce({_first(T.COLOR_WORDS)}, 'neutral') as color_grading, 'documentary' as name, 8 as intro_duration_beats, 8.0::double as max_clip_duration_sec from x"),
    "media_guard": (q_guard, f"with {_S} select id, id % 5 < 2 as allowed from s"),
    "wrap_text": (q_wrap, f"""with recursive {_S}, p as (select id, k, string_split(repeat(kind, 6) || chr(10) || chr(10) || '今天聊聊' || repeat('细节', (id % 9)::int), chr(10))[k] as p from s, range(1, 4) r(k)),
f(id, k, rest, cur, n, done) as (select id, k, p, '', 0, []::varchar[] from p union all
  select id, k, substr(rest, 2), case when wide then left(rest, 1) else cur || left(rest, 1) end, n + 1, case when wide then list_append(done, cur) else done end
  from (select *, cur <> '' and (len(cur || left(rest, 1)) * 0.5 + len(regexp_replace(cur || left(rest, 1), '[\\x{{0}}-\\x{{2E80}}]', '', 'g')) * 0.5) * 10 > 100 as wide from f where rest <> '')),
l as (select id, k, list_append(done, cur) as lines from f where rest = ''), x as (select id, flatten(list(lines order by k)) as lines from l group by id) select id, unnest(range(len(lines)))::int as i, unnest(lines) as line from x"""),
}
