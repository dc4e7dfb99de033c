"""Filter text and command lines."""

from __future__ import annotations

import pyspark.sql.functions as F

from ..plans import filters as P
from ..plans import render as R
from ..tables import samples
from .plan import CLIPS, clips

_S = "s as (select user_id as track, event_id as id, value as v, event_type as kind from events)"
KINDS = ["cut", "fade", "wipe", "flash", "shake", "diagtl", "circlecrop", "what", "fadewhite"]


def _pick(values: list, by) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))


def _sql(values: list, by: str) -> str:
    return "([" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + f"])[({by} % {len(values)}) + 1]"


def q_xfade_name(spark, d):
    return samples(spark, d).select("id", P.xfade_name(_pick(KINDS, F.col("id"))).alias("xfade"))


def q_demoted(spark, d):
    c = clips(spark, d).withColumn("transition_duration", (F.col("i") % 5) * 0.02 - 0.01)
    return P.demoted(c, "video", "i").select("video", "i", "transition_type", "transition_duration", "tail")


def q_existing(spark, d):
    files = clips(spark, d).where("i % 3 > 0").select(F.col("source_path").alias("path"))
    entries = clips(spark, d).select("i", F.when(F.col("i") % 5 > 0, F.col("source_path")).otherwise(F.lit("")).alias("source_path"))
    return P.existing(entries, files, "source_path").select("i")


def q_clip_filter(spark, d):
    i = F.col("i")
    return clips(spark, d).select("i", P.clip_filter((i % 8) / 4, (i % 6) / 4, F.when(i % 2 == 0, F.lit(1.0)).otherwise(F.lit(1.25))).alias("vf"))


def q_cut_command(spark, d):
    return clips(spark, d).select("i", P.cut_command(F.col("source_path"), F.col("start_time"), F.col("start_time") + F.col("i") % 50, F.concat(F.lit("shot_"), F.col("i").cast("string"), F.lit(".mp4"))).alias("command"))


def q_keep_parts(spark, d):
    r = samples(spark, d).where("kind = 'view'").select("track", (F.col("id") * 2).cast("double").alias("a"), (F.col("id") * 2 + 1.5).alias("b"))
    return P.keep_parts(r, "track", "/media/")


def q_next_margin(spark, d):
    return samples(spark, d).select("id", P.next_margin(F.col("id") % 2 == 0, (F.col("id") % 5) / 10).alias("margin"))


def q_loudness(spark, d):
    i = F.col("id")
    stats = F.when(i % 5 == 0, F.lit("no numbers")).when(i % 5 == 1, F.lit('{"input_i": "-inf"}')).when(i % 5 == 2, F.lit('{"input_i": "-80.5"}')).otherwise(F.concat(F.lit('{"input_i": "-'), (i % 40).cast("string"), F.lit('.25", "input_tp": "-2.5", "target_offset": "0.5"}')))
    return samples(spark, d).select("id", P.loudness_filter(stats).alias("af"))


def q_cue_mix(spark, d):
    c = samples(spark, d).where("kind = 'view'").select("track", (F.col("id") / 4).alias("t"), (-(F.col("id") % 3) - 5.5).alias("gain_db"))
    return P.cue_mix(c, "track")


def q_narration(spark, d):
    return samples(spark, d).select("id", P.narration_mix((F.col("id") % 9) / 4, F.lit(0.5), -(F.col("id") % 4) - 0.5).alias("filter"))


def q_duck_expression(spark, d):
    w = samples(spark, d).where("kind = 'click'").select("track", (F.col("id") * 3).cast("double").alias("a"), (F.col("id") * 3 + 1.25).alias("b"))
    return P.duck_expression(w, "track", -12.0)


def q_caption_filter(spark, d):
    return samples(spark, d).select("id", P.caption_filter(F.concat(F.lit("it's 5:"), F.col("kind"), F.lit("%")), F.col("id") / 8, F.col("id") / 8 + 2, F.col("id") % 30 + 16).alias("vf"))


def q_static_crop(spark, d):
    w, h = 1280 + F.col("id") % 640, 720 + F.col("id") % 360
    return samples(spark, d).select("id", P.static_crop(w, h, R.crop_window(w, h, F.lit(9 / 16))).alias("vf"))


def q_pixel_track(spark, d):
    p = samples(spark, d).select("id", ((F.col("id") % 17) / 16).alias("cx"), ((F.col("id") % 9) / 8).alias("cy"))
    return P.pixel_track(p, 608, 1080, 1920, 1080).select("id", "x", "y")


def q_increasing(spark, d):
    p = samples(spark, d).select("track", "id", ((F.col("id") * 7919) % 1000 + F.col("id")).alias("t"))
    return P.increasing(p, "track", "id", "t")


def q_key_frames(spark, d):
    return P.key_frames(samples(spark, d).select("kind", "id"), "kind", "id")


def q_steady_grade(spark, d):
    return samples(spark, d).select("id", P.steady_filter(_pick([*P.STEADY, "other"], F.col("id"))).alias("steady"), P.grade_filter(_pick([*P.GRADES, "none"], F.col("id"))).alias("grade"))


def q_speed_filter(spark, d):
    c = clips(spark, d).select("i", F.lit(8.0).alias("duration"))
    s = R.speed_segments(c, "duration", "punch")
    return P.speed_filter(s.withColumn("speed", F.when(F.col("speed") > 1, F.lit(2.5)).otherwise(F.lit(1.0))), "i")


def q_proxy(spark, d):
    return clips(spark, d).select("i", P.proxy_command(F.col("source_path"), (F.col("i") % 3) * 1.5).alias("command"))


_f = lambda x, n: f"printf('%.{n}f', ({x})::double)"
_scale = "scale=1280:720:force_original_aspect_ratio=decrease,pad=1280:720:(ow-iw)/2:(oh-ih)/2:color=black"
_steps = "select i, k, k / 20.0::double * 8.0 as a, (k + 1) / 20.0::double * 8.0 as b, case when (u > 0.18 and u < 0.30) or (u > 0.55 and u < 0.67) then 2.5 else 1.0 end::double as sp from (select i, k, (k / 20.0::double + (k + 1) / 20.0::double) / 2 as u from clips, range(20) r(k))"
QUERIES = {
    "xfade_name": (q_xfade_name, f"with {_S} select id, ([{', '.join(repr(x) for x in ['fade', 'fade', 'wipeleft', 'fade', 'fade', 'diagtl', 'fade', 'fade', 'fadewhite'])}])[(id % 9) + 1] as xfade from s"),
    "transition_demotion": (q_demoted, f"with {CLIPS}, c as (select video, i, transition_type as y, (i % 5) * 0.02::double - 0.01 as x, row_number() over (partition by video order by i) as n from clips), m as (select video, i, case when n > 1 and y <> 'cut' and least(greatest(x, 0), 0.08) < 0.03 then 'cut' else y end as transition_type, case when n > 1 and y <> 'cut' and least(greatest(x, 0), 0.08) < 0.03 then 0.0 else x end as transition_duration from c) select *, coalesce(lead(case when transition_type <> 'cut' then transition_duration else 0.0 end) over (partition by video order by i), 0.0) as tail from m"),
    "existing_files": (q_existing, f"with {CLIPS} select i from clips where i % 5 > 0 and i % 3 > 0"),
    "clip_filter": (q_clip_filter, f"with {CLIPS}, x as (select i, (i % 8) / 4.0::double as du, (i % 6) / 4.0::double as p, case when i % 2 = 0 then 1.0 else 1.25 end::double as sp from clips) select i, 'fps=30,' || case when sp <> 1 then 'setpts=' || {_f('1 / sp', 6)} || '*PTS,' else '' end || '{_scale}' || case when du - p / sp > 0.02 then ',tpad=stop_mode=clone:stop_duration=' || {_f('du - p / sp + 0.10', 3)} else '' end as vf from x"),
    "cut_command": (q_cut_command, f"with {CLIPS} select i, 'ffmpeg -y -ss ' || {_f('start_time', 3)} || ' -i ' || source_path || ' -t ' || {_f('i % 50', 3)} || ' -c:v libx264 -crf 18 -preset veryfast -pix_fmt yuv420p -c:a aac -b:a 192k -avoid_negative_ts make_zero shot_' || i || '.mp4' as command from clips"),
    "keep_parts": (q_keep_parts, f"with {_S}, r as (select track, id * 2 as a, row_number() over (partition by track order by id) - 1 as i from s where kind = 'view') select track, i, 'ffmpeg -y -v error -ss ' || {_f('a', 3)} || ' -i /media/' || track || '.mp4 -t 1.500 -c:v libx264 -crf 18 -preset fast -pix_fmt yuv420p -c:a aac -b:a 192k -ar 44100 -ac 2 part_' || i || '.mp4' as command from r"),
    "clean_margin": (q_next_margin, f"with {_S} select id, case when id % 2 = 0 and (id % 5) / 10.0::double < 0.3::double then (id % 5) / 10.0::double + 0.1::double end as margin from s"),
    "loudness_filter": (q_loudness, f"with {_S} select id, 'loudnorm=I=-14.0:TP=-1.5:LRA=11' || case id % 5 when 0 then ':measured_I=-14.0:measured_TP=-1.5:measured_LRA=11.0:measured_thresh=-24.0:offset=0.0:linear=true' when 1 then ':measured_I=-14.0:measured_TP=-1.5:measured_LRA=11.0:measured_thresh=-24.0:offset=0.0:linear=true' when 2 then '' else ':measured_I=-' || id % 40 || '.25:measured_TP=-2.5:measured_LRA=11.0:measured_thresh=-24.0:offset=0.5:linear=true' end || ',afade=t=in:st=0:d=0.03' as af from s"),
    "cue_mix": (q_cue_mix, f"with {_S}, c as (select track, id, -(id % 3) - 5.5::double as g, row_number() over (partition by track order by id) - 1 as i from s where kind = 'view') select track, string_agg('[' || (i + 1) || ':a]adelay=' || id * 250 || ':all=1,volume=' || g || 'dB[sfx' || i || ']', ';' order by i) || ';[0:a]' || string_agg('[sfx' || i || ']', '' order by i) || 'amix=inputs=' || (count(*) + 1) || ':duration=first:normalize=0[aout]' as filter from c group by track"),
    "narration_mix": (q_narration, f"with {_S} select id, '[0:a]volume=' || (-(id % 4) - 0.5::double) || 'dB' || case when id % 9 > 0 then ',volume=enable=''between(t,0,' || {_f('(id % 9) / 4.0', 3)} || ')'':volume=-9.0dB' else '' end || '[bgm];[1:a]volume=0.5dB[vo];[bgm][vo]amix=inputs=2:duration=first:normalize=0[aout]' as filter from s"),
    "duck_expression": (q_duck_expression, f"with {_S} select track, 'volume=''if(' || string_agg('between(t,' || {_f('id * 3', 3)} || ',' || {_f('id * 3 + 1.25', 3)} || ')', '+' order by id) || ',0.2512,1)'':eval=frame' as expression from s where kind = 'click' group by track"),
    "caption_filter": (q_caption_filter, f"with {_S} select id, 'drawtext=text=''it\\''s 5\\:' || kind || '\\%'':fontsize=' || (id % 30 + 16) || ':fontcolor=white:borderw=2:bordercolor=black:x=(w-text_w)/2:y=h-80:enable=''between(t,' || {_f('id / 8.0', 3)} || ',' || {_f('id / 8.0 + 2', 3)} || ')''' as vf from s"),
    "static_crop": (q_static_crop, f"with {_S}, x as (select id, 1280 + id % 640 as w, 720 + id % 360 as h from s), c as (select *, greatest(2, round_even(h * 0.5625, 0)::bigint - round_even(h * 0.5625, 0)::bigint % 2) as cw, greatest(2, h - h % 2) as ch from x) select id, 'crop=' || cw || ':' || ch || ':' || (w - cw) // 2 || ':' || (h - ch) // 2 as vf from c"),
    "pixel_track": (q_pixel_track, f"with {_S} select id, least(1312.0, greatest(0.0, (id % 17) / 16.0::double * 1920 - 304))::double as x, least(0.0, greatest(0.0, (id % 9) / 8.0::double * 1080 - 540))::double as y from s"),
    "increasing_times": (q_increasing, f"with {_S}, p as (select track, id, (id * 7919) % 1000 + id as t from s), b as (select *, max(t) over (partition by track order by id rows between unbounded preceding and 1 preceding) as b from p) select track, id, t from b where b is null or t > b"),
    "key_frames": (q_key_frames, f"with {_S}, r as (select kind, id, row_number() over (partition by kind order by id) - 1 as i, count(*) over (partition by kind) as n from s), k as (select distinct kind, round_even(k * (n - 1) / 59::double, 0)::bigint as i from (select distinct kind, n from r), range(60) t(k)) select kind, id from r where n <= 60 or exists (select 1 from k where k.kind = r.kind and k.i = r.i)"),
    "steady_and_grade": (q_steady_grade, f"with {_S} select id, {_sql([f'vidstabdetect=shakiness={a}:accuracy={b}|smoothing={c}:zoom=5:interpol=bicubic' for a, b, c in [*P.STEADY.values(), P.STEADY['documentary']]], 'id')} as steady, {_sql([*P.GRADES.values(), ''], 'id')} as grade from s"),
    "speed_filter": (q_speed_filter, f"with {CLIPS}, x as ({_steps}) select i, string_agg('[0:v]trim=start=' || {_f('a', 4)} || ':end=' || {_f('b', 4)} || ',setpts=(PTS-STARTPTS)/' || {_f('sp', 6)} || '[v' || k || '];[0:a]atrim=start=' || {_f('a', 4)} || ':end=' || {_f('b', 4)} || ',asetpts=PTS-STARTPTS,' || case when sp > 1 then 'atempo=2.0000,atempo=1.2500' else 'atempo=1.0000' end || '[a' || k || ']', ';' order by k) || ';' || string_agg('[v' || k || '][a' || k || ']', '' order by k) || 'concat=n=20:v=1:a=1[outv][outa]' as filter from x group by i"),
    "proxy_command": (q_proxy, f"with {CLIPS} select i, 'ffmpeg -y' || case when i % 3 > 0 then ' -ss ' || {_f('(i % 3) * 1.5', 3)} else '' end || ' -i ' || source_path || ' -vf scale=''min(480,iw)'':-2 -c:v libx264 -crf 32 -preset veryfast -pix_fmt yuv420p -c:a aac -b:a 64k' as command from clips"),
}
