"""Operators with no SQL equivalent against plain Python, and published fixtures."""

import json
import math
import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from cutflow.functions import features
from cutflow.functions import text as T
from cutflow.functions.scoring import highlight_score
from cutflow.operators import beats as B
from cutflow.operators import intervals as I
from cutflow.operators import nearest as N
from cutflow.operators import scan as X
from cutflow.operators import selection as S
from cutflow.operators import series as R
from cutflow.operators import similar as V
from cutflow.operators import tasks as Q
from cutflow.operators import vector_index as K
from cutflow.plans import documents as D
from cutflow.plans import render as P
from cutflow.queries import QUERIES
from cutflow.sources import captions as C


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_highlight_score_fixtures(spark):
    none = F.array().cast("array<string>")
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, highlight_score(*lit(3, 5, 0.5, 1.2, 0, 0), none)) == pytest.approx(0.6631992694944706)
    assert one(spark, highlight_score(*lit(3, 5, 0, 0, 0, 0), none)) == pytest.approx(0.6801992694944706)


def shots(spark, rows):
    return spark.createDataFrame(rows, "source_video string, shot_id long, start_time double, end_time double, highlight_score double")


def test_selection_fixture(spark):
    rows = [("a", 2, 1.0, 2.0, 0.5), ("a", 40, 9.27, 10.63, 0.49), ("a", 4, 2.13, 3.0, 0.45), ("a", 61, 26.4, 28.43, 0.48), ("a", 62, 28.43, 29.63, 0.48), ("a", 7, 40.0, 41.0, 0.3)]
    order = lambda gap: [r["shot_id"] for r in S.select_highlights(shots(spark, rows), 15, gap).orderBy("rank").collect()]
    assert order(1.0) == [2, 40, 61, 7]
    assert order(0) == [2, 40, 61, 62, 4, 7]


def test_selection_goes_on_beyond_a_round(spark, monkeypatch):
    monkeypatch.setattr(S, "BEST", 4)
    rows = [("s", i, i * 0.5, i * 0.5 + 0.4, 0.5 + (i % 11) * 0.03) for i in range(120)]
    found = [(r["start_time"], r["end_time"]) for r in S.select_highlights(shots(spark, rows), 15, 1.0).orderBy("rank").collect()]
    sep = max(1.0, (rows[-1][3] - rows[0][2]) / 37.5)
    chosen = []
    for _, _, a, b, _ in sorted(rows, key=lambda r: (-r[4], r[2], r[1])):
        if len(chosen) < 15 and all(max(a, c) - min(b, d) >= sep for c, d in chosen):
            chosen.append((a, b))
    assert found == chosen


def music(spark, beats):
    return spark.createDataFrame([("m", i, *x) for i, x in enumerate(beats)], "track string, idx long, t double, beat_type string")


def clips(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], "version int, place int, shot_id long, duration double, highlight_score double")


def test_sync_fixture(spark):
    beats = music(spark, [(0.5 * i, "strong" if i % 2 == 0 else "normal") for i in range(40)])
    shots = clips(spark, [(0, 1, 1.0, 0.9), (1, 2, 0.2, 0.9), (2, 3, 1.05, 0.5)])
    got = [tuple(r) for r in B.sync(shots, beats, "track", "calm").select("shot_id", "start_time", "duration", "speed").collect()]
    assert got == [(1, 0.0, 1.0, 1.0), (3, 1.0, 1.0, pytest.approx(0.95))]
    assert B.sync(shots, beats.limit(0), "track").count() == 0 and B.sync(shots.limit(0), beats, "track").count() == 0


@pytest.mark.parametrize("style", ["dynamic", "calm", "intense"])
def test_sync_keeps_its_promises(spark, style):
    """Shots start on beats one after the other, fill their time, and end on a beat or after the last one."""
    beats = [(0.4 * i + (i * 7 % 5) * 0.05, ("strong", "normal", "weak", "normal")[i * 5 % 4]) for i in range(60)]
    rows = [(i, i, 0.2 + (i * 13 % 17) / 8, (i * 29 % 100) / 100) for i in range(50)]
    found = B.sync(clips(spark, rows), music(spark, beats), "track", style).orderBy("start_time").collect()
    times, slow, at, last = [t for t, _ in beats], B.STYLES[style]["range"][0], 0, -1
    assert len(found) > 5
    for r in found:
        available = rows[r["shot_id"]][2]
        assert r["start_time"] == times[at] and r["shot_id"] > last and r["beats"] >= 1
        assert available / r["duration"] >= slow - 1e-4 and r["speed"] >= slow
        assert at + r["beats"] >= 59 or r["end_time"] == pytest.approx(times[at + r["beats"]])
        assert r["transition_type"] not in B.DARKENING and (r["transition_duration"] == 0) == (r["transition_type"] == "cut") and r["transition_duration"] <= 0.08
        at, last = at + r["beats"], r["shot_id"]
    # What was skipped before the music ended has no picture for one beat of the usual length at the slowest speed, or
    # none for the beat it would have lain on.
    gaps = [b - a for a, b in zip(times, times[1:], strict=False)]
    skipped = set(range(last)) - {r["shot_id"] for r in found}
    assert all(rows[i][2] / slow < max(gaps) for i in skipped)


def test_closest_version(spark):
    lengths = {"a": [5.0, 3.0, 7.0, 9.0, 8.0], "b": [8.0, 8.0], "c": [1.0, 2.0, 3.0]}
    rows = [(k, v, x) for k, xs in lengths.items() for v, x in enumerate(xs)] + [("d", 1, 8.0)]
    got = B.closest_version(spark.createDataFrame(rows, "track string, version int, duration double"), "track", 8.0).collect()
    assert {r["track"]: (r["version"], r["total"], r["clips"]) for r in got} == {"a": (2, 7.0, 1), "b": (0, 8.0, 1), "c": (2, 3.0, 1)}


def test_closest_version_sums_in_order(spark):
    """0.1, 0.2 and 0.3 sum to a bit more than the other way round; versions of the same shots are equal."""
    rows = [("a", v, t, x) for v, order in enumerate(([2, 1, 0], [0, 1, 2], [1, 2, 0])) for t, x in [list(enumerate([0.1, 0.2, 0.3]))[k] for k in order]]
    for one_task in (True, False):
        frame = spark.createDataFrame(rows, "track string, version int, start_time int, duration double")
        frame = frame.coalesce(1) if one_task else frame.repartition(9, "start_time", "version")
        (got,) = B.closest_version(frame, "track", 1.0).collect()
        assert (got["version"], got["total"], got["clips"]) == (0, (0.1 + 0.2) + 0.3, 3)


def test_similarity_dedup(spark):
    rows = [(i, s, [float(x) for x in v]) for i, s, v in [(1, 0.9, [1, 0]), (2, 0.8, [0.999, 0.04]), (3, 0.7, [0, 1]), (4, 0.1, [0.02, 0.9998])]]
    v = spark.createDataFrame(rows, "id long, score double, embedding array<double>")
    assert {r["id"] for r in V.similarity_dedup(v, 0.05).where("dropped").collect()} == {2, 4}


def test_nearest_takes_the_earlier_on_a_tie(spark):
    probes = spark.createDataFrame([("k", 1, 1.5), ("k", 2, 0.0), ("k", 3, 9.0), ("q", 4, 1.0)], "k string, id long, t double")
    points = spark.createDataFrame([("k", 1.0, 10.0), ("k", 2.0, 20.0)], "k string, t double, v double")
    got = {r["id"]: r["near"] and r["near"]["t"] for r in N.nearest(N.neighbours(probes, points, "k", "id")).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 2.0, 4: None}


def test_smoothing(spark):
    rows = [("k", i, float(x)) for i, x in enumerate((1, 4, 2))] + [("j", i, float(i * 7 % 13)) for i in range(400)]
    got = R.smoothed(spark.createDataFrame(rows, "k string, i long, v double"), "k", ["i"], "v", 0.5).orderBy("k", "i").collect()
    assert [(r["ema"], r["ma"]) for r in got if r["k"] == "k"] == [(1.0, 1.5), (2.5, pytest.approx(5.75 / 3)), (2.25, pytest.approx(7 / 3))]
    want = [0.0]
    for i in range(1, 400):
        want.append(0.5 * (i * 7 % 13) + 0.5 * want[-1])
    assert [r["ema"] for r in got if r["k"] == "j"] == want


def test_backoff_and_atempo(spark):
    assert [one(spark, Q.backoff(F.lit(n), 1.0, 8.0)) for n in range(1, 6)] == [1, 2, 4, 8, 8]
    assert one(spark, P.atempo(F.lit(8.0))) == [2.0, 2.0, 2.0]
    assert one(spark, P.atempo(F.lit(0.1))) == [0.5, 0.5, 0.5, 0.8]
    for s in (0.25, 0.5, 1, 2, 3, 40):
        f = one(spark, P.atempo(F.lit(float(s))))
        assert math.prod(f) == pytest.approx(s) and all(0.5 <= x <= 2 for x in f)


def test_speed_curve_fixtures(spark):
    clip = spark.createDataFrame([(4.0,)], "d double")
    out = lambda p: P.speed_segments(clip, "d", p).select(F.sum((F.col("b") - F.col("a")) / F.col("speed"))).first()[0]
    assert [out(p) for p in ("rush", "slowmo", "hero", "punch")] == pytest.approx([2.463795983059949, 4.418584835685498, 4.8007373731374926, 3.5076923076923077])


def test_crop_sizes(spark):
    for a, size in ((9 / 16, (1080, 1920)), (16 / 9, (1920, 1080)), (1.0, (1080, 1080)), (4 / 5, (1080, 1350)), (3 / 4, (1080, 1440))):
        crop = P.crop_window(F.lit(1920), F.lit(1080), F.lit(a))
        assert tuple(one(spark, P.output_size(crop, F.lit(a)))) == size


def test_text(spark):
    assert one(spark, T.timecode(F.lit(65.5))) == "00:01:05:15"
    assert one(spark, T.clock_seconds(F.lit("1:02:03"))) == 3723 and one(spark, T.clock_seconds(F.lit("7:22"))) == 442 and one(spark, T.clock_seconds(F.lit("soon"))) == 0
    assert one(spark, T.sentences(F.lit("1. 第一句。第二句！\n2. 第三句？"))) == ["第一句。", "第二句！", "第三句？"]
    p = spark.range(1).select(*T.effect_params(F.lit("做一个30秒的漫威高燃混剪"))).first()
    assert (p["style"], p["shot_density"], p["target_duration"], p["enable_sfx"]) == ("intense", "max", 30.0, None)


def test_caption_readers(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:00,200 --> 00:00:01,200\nhello\nworld\n\n2\n00:00:01,200 --> 00:00:02,200\nbye\n")
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n00:00:00.200 --> 00:00:01.200\nhello\n\n00:00:01.200 --> 00:00:02.200 align:left\nbye\n")
    (tmp_path / "a.json").write_text('{"segments": [{"start": 0.2, "end": 1.2, "text": " hello", "words": []}]}')
    read = lambda x: [tuple(r) for r in C.load_captions(spark, str(tmp_path / x)).select("a", "b", "text").orderBy("a").collect()]
    assert read("a.srt") == [(0.2, 1.2, "hello world"), (1.2, 2.2, "bye")]
    assert read("a.vtt") == [(0.2, 1.2, "hello"), (1.2, 2.2, "bye")]
    assert read("a.json") == [(0.2, 1.2, "hello")]
    with pytest.raises(ValueError):
        C.load_captions(spark, "x.txt")


def test_similarity_dedup_judges_all_vectors(spark, data, monkeypatch):
    from cutflow.queries import QUERIES

    monkeypatch.setattr(V, "BATCH", 90)
    monkeypatch.setattr(V, "TILE", 50)
    got = {r["id"]: r["dropped"] for r in QUERIES["similarity_dedup"](spark, data).collect()}
    vectors = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    assert got == plain_dedup([(i, float(i % 17), v) for i, v in vectors.items()], 0.25)


def test_similarity_dedup_groups_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(V, "BATCH", 16)
    monkeypatch.setattr(V, "MOVE", 0)
    turn = lambda i: [math.cos(i * 0.37), math.sin(i * 0.37)]
    rows = [(i, float(i * 7 % 5), turn(i)) for i in range(60)] + [(100 + i, 2.0, [1.0, 0.0]) for i in range(40)]
    rows += [(200, 9.0, None), (201, 9.0, [None, 1.0]), (202, 9.0, [1.0]), (203, None, [-0.5, 0.5]), (204, 1.0, [0.5, 0.0]), (205, 0.5, [0.5, 0.0])]
    frame = spark.createDataFrame(rows, "id long, score double, embedding array<double>")
    for threshold in (0.05, 0.5, 1.0):
        assert {r["id"]: r["dropped"] for r in V.similarity_dedup(frame, threshold).collect()} == plain_dedup(rows, threshold)
    assert V.similarity_dedup(frame.limit(0), 0.5).count() == 0


def plain_dedup(rows, threshold):
    def near(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return False
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += x * y
        return 1 - total < threshold

    kept = []
    for r in sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0.0), r[0])):
        if not any(near(r[2], k[2]) for k in kept):
            kept.append(r)
    ids = {k[0] for k in kept}
    return {r[0]: r[0] not in ids for r in rows}


def test_first_independent(spark):
    rng = random.Random(2)
    edges = [(b, a) for a, b in {tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)}] + [(i + 1, i) for i in range(100, 120)]
    dropped = set()
    for x in sorted({e[0] for e in edges}):
        if any(w == x and b not in dropped for w, b in edges):
            dropped.add(x)
    frame = spark.createDataFrame(edges + edges[:9], "worse long, better long")
    assert {r["dropped"] for r in V.first_independent(frame).collect()} == dropped
    assert V.first_independent(frame.limit(0)).count() == 0


def fingerprints(spark, rows):
    return spark.createDataFrame(rows, "id long, highlight_score double, start_time double, frames array<array<double>>")


def plain_mse(a, b, size=4, flat=2.0):
    flatten = lambda f, i: np.array(f[i : i + size]).ravel()
    best = math.inf
    for i in range(0, len(a or ()) - size + 1, size // 2):
        w = flatten(a, i)
        if w.std() >= flat:
            best = min([best, *(((w - flatten(b, j)) ** 2).mean() for j in range(len(b or ()) - size + 1))])
    return best


def clips_of(seed, n=70, size=16):
    """Scenes of which parts stand in several shots, black ones, short ones, and none."""
    rng = np.random.default_rng(seed)
    scenes = [rng.uniform(0, 255, (12, size)) for _ in range(9)]
    rows = []
    for i in range(n):
        s, at = scenes[rng.integers(9)], rng.integers(0, 7)
        frames = s[at : at + rng.integers(3, 9)] + rng.normal(0, rng.choice([0, 4, 20]), size)
        rows.append((i, float(rng.integers(5)), float(rng.integers(3)), frames.tolist()))
    return rows + [(900, 9.0, 0.0, [[3.0] * size] * 6), (901, 8.0, 0.0, [[3.0] * size] * 6), (902, 1.0, 0.0, None), (903, 1.0, 0.0, []), (904, None, 0.0, rows[0][3]), (905, 1.0, 0.0, [[None] * size] * 5)]


@pytest.mark.parametrize(("batch", "tile", "move"), [(4096, 4096, 300), (8, 5, 0)])
def test_visual_dedup(spark, monkeypatch, batch, tile, move):
    for name, value in (("BATCH", batch), ("TILE", tile), ("MOVE", move)):
        monkeypatch.setattr(V, name, value)
    rows = clips_of(batch)
    kept = []
    for r in sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[2], r[0])):
        if r[0] == 905 or not any(k[0] != 905 and plain_mse(r[3], k[3]) < 200 for k in kept):
            kept.append(r)
    want = {r[0]: r[0] not in {k[0] for k in kept} for r in rows}
    assert {r["id"]: r["dropped"] for r in V.visual_dedup(fingerprints(spark, rows)).collect()} == want and 5 < sum(want.values()) < 70
    assert V.visual_dedup(fingerprints(spark, rows), 0).where("dropped").count() == 0


def test_visual_dedup_fixture(spark):
    """Six blocks of which the first comes again: the worse of the two goes."""
    rng = np.random.default_rng(3)
    blocks = [rng.uniform(0, 255, (8, 256)).tolist() for _ in range(5)]
    rows = [(i, s, float(i), blocks[b]) for i, (b, s) in enumerate(zip([0, 1, 2, 3, 4, 0], [0.9, 0.5, 0.5, 0.5, 0.5, 0.3], strict=True))]
    assert {r["id"] for r in V.visual_dedup(fingerprints(spark, rows)).where("dropped").collect()} == {5}


@pytest.mark.parametrize("move", [0, 300])
def test_window_matches(spark, monkeypatch, move):
    monkeypatch.setattr(V, "MOVE", move)
    rows = clips_of(5)[:-1]
    want = {(a[0], b[0]): plain_mse(a[3], b[3]) for a in rows for b in rows if a[0] != b[0]}
    got = {(r["a"], r["b"]): r["mse"] for r in V.window_matches(fingerprints(spark, rows).select("id", "frames"), 200.0).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v < 200} and len(got) > 50


@pytest.mark.parametrize("tile", [1024, 7])
def test_window_distances_of_any_rows(spark, data, monkeypatch, tile):
    """Every pair has the value that window_mse tells, rows that are no vectors of the common shape as well."""
    monkeypatch.setattr(V, "ALL", tile)
    rng = random.Random(3)
    frames = lambda n, length: [[rng.choice([0.0, 1.0, rng.uniform(-9, 90)]) for _ in range(length)] for _ in range(n)]
    even = [(i, frames(7, 3)) for i in range(40)] + [(40, [[5.0] * 3] * 7), (41, [[5.0] * 3] * 4 + frames(3, 3)), (41, frames(7, 3))]
    odd = [(50, None), (51, []), (52, frames(3, 3)), (53, frames(4, 3)), (54, frames(7, 2)), (55, [*frames(6, 3), None]), (56, [*frames(6, 3), [1.0, None, 2.0]]), (57, [*frames(6, 3), [float("nan")] * 3]), (58, [*frames(6, 3), [1.0]]), (None, frames(7, 3)), (59, [*frames(6, 3), [float("inf")] * 3])]
    for rows in (even, even + odd):
        f = spark.createDataFrame(rows, "id long, frames array<array<double>>").repartition(3)
        a, b = f.where("id is null or id % 3 > 0").withColumnRenamed("id", "a"), f.withColumnRenamed("id", "b")
        want = a.withColumnRenamed("frames", "fa").crossJoin(b.withColumnRenamed("frames", "fb")).select("a", "b", features.window_mse(F.col("fa"), F.col("fb")).alias("mse"))
        key = lambda df: sorted(str(tuple(r)) for r in df.select("a", "b", "mse").collect())
        got = V.window_distances(a, b)
        assert key(got) == key(want) and V.window_distances(a, b.limit(0)).count() == 0
    plan = QUERIES["window_min_mse"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner, (" in plan and "Join Inner\n" not in plan


@pytest.fixture(params=[10**6, 40, 7])
def chunk(request, monkeypatch):
    """Rows of a key in a chunk: keys are cut into many, into a few, or not at all."""
    monkeypatch.setattr(X, "CHUNK", request.param)
    monkeypatch.setattr(R, "BLOCK", 16)
    return request.param


def one_key(seed, n=300):
    """Rows (key, id, t, v) of a hot key with ties, some of a small one, and a single one."""
    rng = random.Random(seed)
    rows = [("hot", i, rng.randrange(0, 400) / 4, float(rng.randrange(0, 100))) for i in range(n)]
    return rows + [("small", n + i, rng.randrange(0, 40) / 4, float(i % 3)) for i in range(9)] + [("single", n + 99, 5.0, 1.0)]


def series(spark, rows):
    return spark.createDataFrame(rows, "k string, id long, t double, v double").repartition(5)


def by_key(rows):
    return {k: sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])) for k in sorted({r[0] for r in rows})}


def test_chunks_spread_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(X, "CHUNK", 40)
    c = X.Chunks(series(spark, one_key(1)), "k", "t")
    sizes = {tuple(r[:2]): r["count"] for r in c.df.groupBy("k", "_chunk").count().collect()}
    assert c.hot and max(sizes.values()) < 90 and len(sizes) >= 7 and {k for k, n in sizes if n > 0} == {"hot"}


def test_intervals_of_any_size(spark, chunk):
    rows = by_key(one_key(chunk))
    merged, left = [], []
    for k, xs in rows.items():
        ends = []
        for a, b in sorted((t, t + v / 90) for _, _, t, v in xs):
            if ends and a - ends[-1][1] <= 0.1:
                ends[-1][1] = max(b, ends[-1][1])
            else:
                ends.append([a, b])
        merged += [(k, a, b) for a, b in ends]
        left += [(k, a, b) for a, b in zip([0.0] + [e[1] for e in ends], [e[0] for e in ends] + [120.0], strict=True) if b - a > 0]
    frame = series(spark, [r for xs in rows.values() for r in xs]).select("k", F.col("t").alias("a"), (F.col("t") + F.col("v") / 90).alias("b"))
    got = I.merge(frame, "k", gap=0.1)
    assert sorted(tuple(r) for r in got.collect()) == sorted(merged)
    assert sorted(tuple(r) for r in I.complement(got, "k", F.lit(120.0)).collect()) == sorted(left)


def test_islands_and_cuts_of_any_size(spark, chunk):
    rows = by_key(one_key(chunk + 1))
    want, cuts = [], []
    for k, xs in rows.items():
        start = None
        for _, _, t, v in xs:
            if v > 50 and start is None:
                start = t
            elif v <= 50 and start is not None:
                want += [(k, start, t)] * (t - start > 0.3)
                start = None
        ts = sorted(x[2] for x in xs)
        pairs = ([(0.0, ts[0])] if ts[0] > 0 else []) + [*zip(ts, ts[1:] + [200.0], strict=True)]
        cuts += [(k, i, a, b) for i, (a, b) in enumerate(sorted(pairs)) if b - a >= 0.4]
    frame = series(spark, [r for xs in rows.values() for r in xs])
    assert sorted(tuple(r) for r in I.islands(frame, "k", "t", F.col("v") > 50, "id", 0.3).collect()) == sorted(want)
    assert sorted(tuple(r) for r in I.pair_cuts(frame, "k", "t", F.lit(200.0), 0.4).collect()) == sorted(cuts)


def test_neighbours_of_any_size(spark, chunk):
    rows = one_key(chunk + 2)
    probes, points = [r for r in rows if r[1] % 3 == 0], [r for r in rows if r[1] % 3 == 1]
    want = {}
    for k, i, t, _ in probes:
        mine = [(p[2], p[3]) for p in points if p[0] == k]
        before, after = ({x for x in mine if sign * (t - x[0]) >= 0} for sign in (1, -1))
        near = lambda xs, pick: min(x for x in xs if x[0] == pick(y[0] for y in xs)) if xs else None
        want[i] = near(before, max), near(after, min)
    found = N.neighbours(series(spark, probes).select("k", "id", "t"), series(spark, points).select("k", "t", "v"), "k", "id").collect()
    assert {r["id"]: (r["before"] and tuple(r["before"]), r["after"] and tuple(r["after"])) for r in found} == want


@pytest.mark.parametrize("alpha", [0.01, 0.35, 0.9, 1.0])
def test_averages_of_any_size(spark, chunk, alpha):
    rows = [(k, i, t, None if i % 17 == 5 else v) for k, i, t, v in one_key(chunk + 3)]
    want = {}
    for xs in by_key(rows).values():
        s, ema = None, []
        for _, _, _, v in xs:
            s = s if v is None else v if s is None else alpha * v + (1 - alpha) * s
            ema.append(s)
        for i, x in enumerate(xs):
            near = [ema[min(max(i + d, 0), len(xs) - 1)] for d in (-1, 0, 1)]
            want[x[1]] = ema[i], None if None in near else sum(near) / 3
    got = {r["id"]: (r["ema"], r["ma"]) for r in R.smoothed(series(spark, rows), "k", ["t", "id"], "v", alpha).collect()}
    assert got.keys() == want.keys()
    for i, (e, m) in want.items():
        assert got[i][0] == pytest.approx(e, abs=1e-9) and (m is None or got[i][1] == pytest.approx(m, abs=1e-9))


def test_segments_of_any_size(spark, data, chunk):
    """A source is one video, whose segments are counted through all its shots."""
    events = spark.read.parquet(f"{data}/events.parquet").select("event_type", "event_id").collect()
    want = {}
    for kind in {r["event_type"] for r in events}:
        n = 0
        for i in sorted(r["event_id"] for r in events if r["event_type"] == kind):
            n += i % 4 == 0
            want[kind, i + 1] = n
    assert {tuple(r)[:2]: r["segment"] for r in QUERIES["render_segments"](spark, data).collect()} == want


def test_otio_document_of_a_whole_source(spark, data, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 16)
    events = spark.read.parquet(f"{data}/events.parquet").select("event_type", "event_id").collect()
    got = {r["video"]: json.loads(r["document"])["tracks"][0]["children"] for r in QUERIES["export_otio"](spark, data).collect()}
    for kind in {r["event_type"] for r in events}:
        want = []
        for i in sorted(r["event_id"] for r in events if r["event_type"] == kind):
            want += [f"Transition_{i}"] * (i % 4 > 0 and i > 0) + [f"clip_{i}"]
        assert [x["name"] for x in got.pop(kind)] == want
    assert not got


def test_documents_join_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 3)
    rows = [("a", i, None if i in (4, 6, 7, 8) else f"x{i}") for i in range(11)] + [("none", i, None) for i in range(5)] + [("one", -2, "y"), ("one", None, "first")]
    frame = spark.createDataFrame(rows, "k string, n long, t string").repartition(4)
    want = {"a": "x0,x1,x2,x3,x5,x9,x10", "none": "", "one": "first,y"}
    assert {r["k"]: r["body"] for r in D._joined(frame, "k", ["n"], "t", ",").collect()} == want


def test_windows_of_any_length(spark):
    rng = random.Random(4)
    windows = [("k", a, a + rng.choice([0.0, 0.5, 3, 40, 3000, 1e6])) for a in (rng.uniform(0, 5000) for _ in range(25))] + [("j", 0.0, 2_592_000.0), ("j", 5.0, 4.0)]
    points = [(rng.choice("jkq"), i % 40, rng.choice([rng.uniform(-10, 9000), 0.0, 2_592_000.0])) for i in range(300)] * 2
    want = sorted(p for p in points if any(k == p[0] and a <= p[2] <= b for k, a, b in windows))
    w = spark.createDataFrame(windows, "k string, a double, b double")
    got = I.in_windows(spark.createDataFrame(points, "k string, id long, t double"), w, "k", "t", 60.0)
    assert sorted(tuple(r) for r in got.select("k", "id", "t").collect()) == want


@pytest.mark.parametrize(("cell", "members", "tile"), [(4096, 64, 4096), (20, 4, 4096), (20, 4, 7)])
@pytest.mark.parametrize("per", [None, "label"])
def test_top_k_by_cells(spark, monkeypatch, cell, members, tile, per):
    """One cell, and many; clusters, ties, equal vectors, other lengths, nulls; against all scores."""
    monkeypatch.setattr(K, "CELL", cell)
    monkeypatch.setattr(K, "MEMBERS", members)
    monkeypatch.setattr(V, "TILE", tile)
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(6, 5))
    rows = [(i, None if i % 9 == 0 else int(i % 3), (middles[i % 6] + rng.normal(scale=0.1, size=5)).round(3).tolist()) for i in range(240)]
    rows += [(300 + i, 1, [0.5, 0.25, 0.0, 1.0, -1.0]) for i in range(30)] + [(400, 1, None), (401, 1, [None, 1.0]), (402, 2, [1.0, 2.0]), (403, 2, [float("nan")] * 5)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    asked = [(1, rows[7][2]), (2, [0.5, 0.25, 0.0, 1.0, -1.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0] * 5), (6, [1.0])]
    queries = spark.createDataFrame(asked, "query_id long, q array<double>")
    want = set()
    for query, q in asked:
        found = [(sum(a * b for a, b in zip(q, v, strict=True)), i, label) for i, label, v in rows if q and v and len(q) == len(v) and None not in v and v[0] == v[0]]
        for group in {x[2] for x in found} if per else [None]:
            mine = sorted((x for x in found if (x[2] == group or not per) and x[0] >= -0.5), key=lambda x: (-round(x[0], 9), x[1]))
            want |= {(query, *([group] if per else []), i, k + 1) for k, (_, i, _) in enumerate(mine[:7])}
    got = K.top_k(vectors, queries, 7, -0.5, per).collect()
    assert {(r["query_id"], *([r["label"]] if per else []), r["vec_id"], r["rank"]) for r in got} == want and len(got) == len(want)
