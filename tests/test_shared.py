"""The task log under concurrent workers, plug-ins, preview cache and file formats: odd cases against plain Python."""

import threading

import pyspark.sql.functions as F
import pytest

from cutflow.operators import plugins as M
from cutflow.operators import previews as V
from cutflow.operators import scan as X
from cutflow.operators.claims import TaskLog, put_if_absent
from cutflow.sources import files as D

TASK = "id long, status string, priority int, seq long, attempts int, max_attempts int, next_retry_at double, updated_at double"


def queue(spark, folder, n, most=3):
    rows = [(i, "queued", i % 3, i, 0, most, None, 0.0) for i in range(n)]
    return TaskLog(spark, str(folder)).create(spark.createDataFrame(rows, TASK))


def test_six_workers_never_claim_a_task_twice(spark, tmp_path):
    log, found, errors = queue(spark, tmp_path, 14), {}, []

    def work(who):
        try:
            while ids := log.claim(who, 1.0, 1):
                found.setdefault(who, []).extend(ids)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=(f"w{k}",)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(i for ids in found.values() for i in ids) == [*range(14)]
    state = {r["id"]: r for r in log.state().collect()}
    assert all(state[i]["who"] == who and state[i]["claims"] == [who] and state[i]["attempts"] == 1 for who, ids in found.items() for i in ids)


def test_put_if_absent_lets_one_through(spark, tmp_path):
    path, won = str(tmp_path / "entry"), []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if put_if_absent(spark, path, str(k)) else None) for k in range(20)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and open(path).read() == str(won[0]) and [p.name for p in tmp_path.iterdir()] == ["entry"]


def test_claims_come_by_priority_and_wait_for_retries(spark, tmp_path):
    log = queue(spark, tmp_path, 4, most=2)
    assert log.claim("a", 100.0) == [2] and log.claim("b", 100.0, 5) == [1, 0, 3]
    log.finish("b", [2], 100.0)  # not b's
    log.finish("a", [2], 100.0, "fail")
    assert log.claim("a", 101.9) == [] and log.claim("b", 102.0) == [2]
    log.finish("b", [2], 103.0, "fail")
    got = {r["id"]: (r["status"], r["attempts"], r["claims"]) for r in log.state().collect()}
    assert got[2] == ("error", 2, ["a", "b"]) and got[0] == ("running", 1, ["b"])
    log.finish("b", [0, 1], 104.0)
    assert TaskLog(spark, f"{tmp_path}/compact-{log.compact():012d}").state().where("status = 'done'").count() == 2
    with pytest.raises(ValueError):
        log.finish("b", [3], 1.0, "lost")


def test_a_worker_retries_and_waits(spark, tmp_path):
    log, tries, now, slept = queue(spark, tmp_path, 3), {}, [0.0], []

    def handler(i):
        tries[i] = tries.get(i, 0) + 1
        if i == 1 and tries[i] < 3:
            raise RuntimeError("not yet")
        if i == 2:
            e = RuntimeError("never")
            e.retryable = False
            raise e

    def sleep(s):
        slept.append(s)
        now[0] += s

    assert log.work("w", handler, lambda: now[0], sleep) == 5
    assert {r["id"]: (r["status"], r["attempts"]) for r in log.state().collect()} == {0: ("done", 1), 1: ("done", 3), 2: ("error", 1)}
    assert tries == {0: 1, 1: 3, 2: 1} and sum(slept) >= 6


class Short:
    name, dim, supports_text = "short", 2, True

    def encode_texts(self, texts):
        return [[1.0, 2.0]] * (len(texts) - 1)

    def encode_images(self, images):
        return [[3.0, 4.0] for _ in images]


class Wide(Short):
    def encode_texts(self, texts):
        return [[1.0, 2.0, 3.0] for _ in texts]


class Pictures(Short):
    supports_text = False


def short():
    return lambda texts: texts[1:]


def odd():
    return lambda texts: [" hallo " if t == "hello" else None if t == "none" else "" for t in texts]


def test_plug_ins_are_held_to_their_word(spark):
    texts = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "b", "z")], "id long, text string, embedding string").coalesce(1)
    for model, said in ((Short, "results"), (Wide, "values")):
        with pytest.raises(Exception, match=said):
            M.embed(texts, "text", model).collect()
    with pytest.raises(ValueError, match="takes no texts"):
        M.embed(texts, "text", Pictures)
    images = texts.select("id", F.col("text").cast("binary").alias("image"))
    assert {r["id"]: r["embedding"] for r in M.embed(images, "image", Pictures, "images").collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: [0.6, 0.8]}
    assert M.embed(images.limit(0), "image", Pictures, "images").count() == 0
    with pytest.raises(Exception, match="results"):
        M.translate(texts.drop("embedding"), short).collect()
    said = spark.createDataFrame([(1, "hello", "old"), (2, "none", "old"), (3, None, "old"), (4, "other", "old")], "id long, text string, text2 string")
    assert {r["id"]: (r["text"], r["text2"]) for r in M.translate(said, odd).collect()} == {1: ("hello", "hallo"), 2: ("none", ""), 3: (None, ""), 4: ("other", "")}
    assert {r["id"]: r["text"] for r in M.translate(said, odd, keep_source=False).collect()} == {1: "hallo", 2: "none", 3: None, 4: "other"}


def test_the_second_run_makes_no_previews(spark, tmp_path):
    asked = V.keyed(spark.createDataFrame([("a", "1:9", {"w": "1", "h": "2"}), ("a", "1:9", {"h": "2", "w": "1"}), ("a", "2:9", {"w": "1", "h": "2"}), ("b", "1:9", {})], "source string, stamp string, params map<string,string>"))
    folder = str(tmp_path / "cache")
    first = V.to_make(asked, V.read_cache(spark, folder))
    assert first.count() == 3
    V.remember(first.select("key", "source", F.lit(5).alias("bytes"), F.lit(1.0).alias("made_at")), folder)
    cache = V.read_cache(spark, folder)
    assert V.to_make(asked, cache).count() == 0
    assert V.evict(cache, 10.0, 5.0, 100).where("kept").count() == 0 and V.evict(cache, 10.0, 50.0, 10).where("kept").count() == 2


def test_a_cache_of_several_chunks_is_evicted(spark, monkeypatch):
    monkeypatch.setattr(X, "CHUNK", 7)
    rows = [(f"k{i:02}", "a", 3 + i % 4, float(i % 30)) for i in range(60)]
    got = V.evict(spark.createDataFrame(rows, V.CACHE).repartition(4), 30.0, 25.0, 120)
    want, total = {}, 0
    for key, _, size, at in sorted(rows, key=lambda r: (-r[3], r[0])):
        total += size if 30.0 - at <= 25.0 else 0
        want[key] = 30.0 - at <= 25.0 and total <= 120
    assert got.columns == ["key", "source", "bytes", "made_at", "kept"] and 0 < sum(want.values()) < 50
    assert {r["key"]: r["kept"] for r in got.collect()} == want


@pytest.mark.parametrize("form", sorted(D.FORMATS))
def test_files_hold_odd_names(spark, tmp_path, form):
    D.register(spark)
    names = ["plain", "a <b> & \"c\"", "naïve – 漢字", "x: 1 --", "[{}]"]
    rows = [(f"k{k}", i, i * 2.0, i * 2.0 + 1.5, n) for k in range(3) for i, n in enumerate(names)]
    frame = spark.createDataFrame(rows, D.SCHEMA).repartition(4)
    path = str(tmp_path / "out")
    for _ in range(2):  # the second time in place of the first
        D.for_files(frame).write.format(form).mode("overwrite").save(path)
    assert len([*(tmp_path / "out").iterdir()]) == 3
    assert sorted(tuple(r) for r in spark.read.format(form).load(path).collect()) == rows
    assert spark.read.format(form).load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="no name of a file"):
        D.for_files(spark.createDataFrame([("a/b", 0, 0.0, 1.0, "n")], D.SCHEMA)).write.format(form).mode("append").save(path)
    assert len([*(tmp_path / "out").iterdir()]) == 3
