"""Quality rules, decontamination, licenses, personal data: against plain versions, and odd rows."""

import hashlib
import math
import random
import re
import time
import struct
from collections import Counter

import numpy as np
import pyspark.sql.functions as F
import pytest
import xxhash

from cutflow.llm import decontaminate, licenses, pii, quality
from cutflow.llm.common import running
from cutflow.llm.registry import ORACLE_SQL, QUERIES

from ..oracle import same

DOCS = "doc_id long, text string, lang string, kept string, score string, spans string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "released under the MIT license"), (5, "same words here"), (5, "same words here"), (6, "long " * 30_000)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(name, spark, data):
    same(QUERIES[name], ORACLE_SQL[name], spark, data)


# ---- quality rules


def plain_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen: dict = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeated = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), n < 10 or 100 * len(repeated) > 20 * n


def test_quality_base(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in quality.op5_quality(spark, data).collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == plain_quality(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    out = quality.quality_rules(docs(spark, ODD), labels).collect()
    assert len(out) == len(ODD) and all(not r["kept"] for r in out)
    assert {r["n_words"] for r in out if r["doc_id"] in (1, 2, 3)} == {0}
    assert quality.quality_rules(docs(spark, []), labels.limit(0)).count() == 0


def test_quality_hashes_words_once(spark):
    """Windows are told by the hashes that the n-grams have, two more a window, and repeated ones as in plain Python."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("abcdefgh"[: rng.randrange(2, 9)], k=rng.randrange(0, 120)))) for i in range(300)]
    out = quality.quality_rules(docs(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["doc_id"]: r["n_repeat_words"] for r in out.collect()} == {i: plain_quality(t)[4] for i, t in rows}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") == 5


def test_quality_plan_is_short(spark, data):
    """The ratios of all buckets don't stand in the plan, whose texts the driver keeps for each query."""
    out = quality.op5_quality(spark, data)
    assert len(out._jdf.queryExecution().toString()) < 200_000


def test_quality_ratio_matches_plain(spark):
    """llr of a small corpus from plain counts of the hashed words, pairs and endings."""
    rng = random.Random(6)
    good, raw = [f"gut{i}" for i in range(30)], [f"raw{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(good if i % 3 == 0 else raw, k=rng.randrange(1, 40)))) for i in range(90)] + [(500, "über ßa"), (501, None)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i == 9)) for i in range(60)], "doc_id long, quality int, toxic int")

    def h(*words, end=None):
        x = 42
        for w in words:
            x = xxhash.xxh64_intdigest(w.encode(), seed=x)
        return (x if end is None else xxhash.xxh64_intdigest(struct.pack("<i", end), seed=x)) % quality.BUCKETS

    grams = {i: [*(h(x) for x in w), *(h(a, b) for a, b in zip(w, w[1:], strict=False)), *(h(x[-3:], end=3) for x in w)] for i, t in rows for w in [(t or "").split()]}
    target, whole = Counter(), Counter()
    for i, g in grams.items():
        whole.update(g)
        if i < 60 and i % 3 == 0 and i != 9:
            target.update(g)
    log = lambda c, x: math.log((c[x] + 1) / (sum(c.values()) + quality.BUCKETS))
    want = {i: sum(log(target, x) - log(whole, x) for x in g) / len(g) if g else 0.0 for i, g in grams.items()}
    out = {r["doc_id"]: r for r in quality.quality_rules(docs(spark, rows), labels).collect()}
    assert {i: r["llr"] for i, r in out.items()} == pytest.approx(want, abs=1e-9)
    assert all(r["kept"] == (not r["base_failed"] and want[i] >= quality.THRESHOLD) for i, r in out.items())


# ---- decontamination

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


def test_decontamination_tolerates_substitutions(spark):
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short here"), (10, ITEM.upper())], "item_id long, text string")
    w = ITEM.split()
    swapped = " ".join("x" if i in (4, 9) else x for i, x in enumerate(w))
    rows = [(10, f"before it {ITEM}, after"), (11, f"say: {swapped} end"), (12, " ".join(w[:6]) + " and nothing else of it"), (13, "unrelated words " * 50), *ODD]
    out = {r["doc_id"]: r for r in decontaminate.decontaminate(docs(spark, rows), bench).collect()}
    assert {k for k, r in out.items() if not r["kept"]} == {10, 11}
    assert out[10]["items"] == "7,10" and out[10]["score"] == 16 and out[11]["score"] == 10
    assert decontaminate.decontaminate(docs(spark, rows), bench).count() == len(rows)
    assert decontaminate.decontaminate(docs(spark, rows), bench.limit(0)).where("not kept").count() == 0


def test_decontamination_in_blocks(spark, data):
    read = lambda t: spark.read.parquet(f"{data}/{t}.parquet")
    whole = {tuple(r) for r in decontaminate.contaminated(read("documents"), read("benchmark")).collect()}
    parts = {tuple(r) for r in decontaminate.contaminated(read("documents"), read("benchmark"), block=900, sieve=1500).collect()}
    norm = lambda t: " " + " ".join(w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w) + " "
    items = [norm(r["text"]) for r in read("benchmark").collect()]
    exact = {r["doc_id"] for r in read("documents").collect() if any(x in norm(r["text"]) for x in items)}
    assert whole == parts and exact <= {r[0] for r in whole}


def test_decontamination_of_phrases(spark):
    bench = spark.createDataFrame([(1, "one"), (2, "Two words!"), (3, "now three words"), (4, "this has six words in it"), (5, "seven words are in this item here"), (6, "...")], "item_id long, text string")
    rows = [(1, "one"), (2, " ONE. "), (3, "one more"), (4, "two words"), (5, "two words more"), (6, "and now three words"), (7, "now four words"), (8, "This has six words, in it; and more"), (9, "this has six words in that"), (10, "seven words were in this item here"), (11, "..."), *ODD]
    for options in ({}, {"block": 1, "sieve": 3}):
        found = decontaminate.contaminated(docs(spark, rows), bench, **options).collect()
        assert {r["doc_id"]: r["items"] for r in found} == {1: "1", 2: "1", 4: "2", 6: "3", 8: "4", 10: "5"}


def test_decontamination_of_short_items(spark):
    rng = random.Random(5)
    known = [f"word{i}" for i in range(60)]
    items = {n * 10 + k: rng.choices(known, k=n) for n in [7, 10, 12, *range(15, 25)] for k in range(3)}
    items[1], spread = ITEM.split(), [3, 7, 11]  # every fourth word: no spaced seed is left
    texts = [["x" if i in (4, 9) else w for i, w in enumerate(items[151])], ["x" if i in spread else w for i, w in enumerate(items[1])]]
    for item in items.values():
        for many in (0, len(item) // 5, len(item) // 5, len(item) // 5 + 1, len(item) // 2):
            gone = rng.sample(range(len(item)), many)
            texts.append(rng.choices(known, k=9) + [rng.choice(known) if i in gone else w for i, w in enumerate(item)] + rng.choices(known, k=9))
        texts.append(item[len(item) // 5 :] + rng.choices(known, k=9))  # cut off: the first words stand outside the document
    texts += [rng.choices(known, k=300) for _ in range(40)]

    def counts(text, item):
        """Whether some place has the item with one word in five replaced at most."""
        return any(sum(0 <= s + i < len(text) and text[s + i] == w for i, w in enumerate(item)) >= len(item) - len(item) // 5 for s in range(-len(item), len(text)))

    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    out = decontaminate.decontaminate(docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]), bench).collect()
    got = {r["doc_id"]: {int(x) for x in r["items"].split(",") if x} for r in out}
    scores = {r["doc_id"]: r["score"] for r in out}
    for i, text in enumerate(texts):
        want = {k for k, item in items.items() if counts(text, item)}
        assert want <= got[i] and (got[i] == want or scores[i] >= 7)
        assert {k for k in got[i] - want if len(items[k]) < 10} == set()
    assert 151 in got[0] and 1 in got[1]


@pytest.mark.parametrize("options", [{}, {"block": 1, "sieve": 3000}])
def test_decontamination_of_long_items(spark, options):
    """Items of 25 words and more against brute force along all diagonals, where seven words in a row are equal."""
    rng = random.Random(8)
    known = [f"word{i}" for i in range(400)]
    items = {n: rng.choices(known, k=n) for n in (25, 40, 90, 300, 1000)}
    texts = []
    for item in items.values():
        for size in (7, 9, 10, 12, 20, 25):
            at = rng.randrange(len(item) - size + 1)
            part = item[at : at + size]
            texts.append(rng.choices(known, k=rng.randrange(30)) + part + rng.choices(known, k=rng.randrange(30)))
            texts.append(["x" if i % 8 == 7 else w for i, w in enumerate(part)] + rng.choices(known, k=5))
        texts.append(item)

    def best(text, item):
        top, seven = 0, False
        for s in range(-len(item), len(text)):
            now = row = 0
            for i in range(max(0, -s), min(len(item), len(text) - s)):
                equal = text[s + i] == item[i]
                now, row = max(0, now + (1 if equal else -2)), row + 1 if equal else 0
                top, seven = max(top, now), seven or row >= 7
        return top if seven else 0

    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontaminate.decontaminate(docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]), bench, **options).collect()}
    for i, text in enumerate(texts):
        scores = {k: best(text, item) for k, item in items.items()}
        assert {int(x) for x in out[i]["items"].split(",") if x} == {k for k, v in scores.items() if v >= 10}, (i, scores)
        assert out[i]["score"] == max([v for v in scores.values() if v >= 10], default=0)


def test_decontamination_of_a_very_long_item(spark):
    """The work is in proportion to the item's length: tens of thousands of words in a document take seconds."""
    rng = random.Random(9)
    long = [f"w{rng.randrange(20_000)}" for _ in range(50_000)]
    bench = spark.createDataFrame([(1, " ".join(long))], "item_id long, text string")
    rows = [(1, " ".join(long)), (2, " ".join(long[20_000:20_040])), (3, " ".join(rng.sample(long, 3000)))]
    began = time.monotonic()
    out = {r["doc_id"]: (r["kept"], r["score"]) for r in decontaminate.decontaminate(docs(spark, rows), bench).collect()}
    assert out == {1: (False, 50_000), 2: (False, 40), 3: (True, 0)} and time.monotonic() - began < 90


# ---- licenses


def test_licenses(spark):
    rows = [(10, "cc by nc, CC-BY-NC!"), (11, "This work is licensed under the GNU General Public License, version 3."), (12, "Licensed under the Apache License, Version 2.0. Under the MIT License"), (13, "words " * 200 + "permission is hereby granted free of charge to any person obtaining a copy of this software" + " words" * 200), *ODD]
    out = {r["doc_id"]: r for r in licenses.license_scan(docs(spark, rows)).collect()}
    assert (out[10]["n_base"], out[10]["first_word"], out[10]["last_word"], out[10]["labels"]) == (2, 0, 3, "cc-by-nc")
    assert (out[11]["base_labels"], out[11]["labels"], out[11]["n_base"], out[11]["first_word"]) == ("", "gpl-3", 0, None)
    assert out[12]["base_labels"] == "apache-2,mit" and out[13]["labels"] == "mit" and out[13]["n_base"] == 0
    assert out[None]["labels"] == "mit" and out[1]["n_words"] == 0 and out[1]["labels"] == "" and out[1]["score"] == 0
    assert licenses.license_scan(docs(spark, rows)).count() == len(rows)
    assert licenses.license_scan(docs(spark, [])).count() == 0


def test_licenses_in_wrapped_notices(spark):
    notices = {"mit": licenses.TEMPLATES[1][1], "bsd": licenses.TEMPLATES[3][1], "gpl-3": licenses.TEMPLATES[4][1], "all-rights-reserved": "All rights reserved."}
    rows = []
    for label, notice in notices.items():
        w = notice.split()
        for i in range(1, len(w)):
            for j in (i, len(w) - 1):
                rows.append((label, "some title\n" + " ".join(w[:i]) + "\n  * " + " ".join(w[i:j]) + "\r\n" + " ".join(w[j:]) + "\nmore text"))
    whole = {text.split()[0]: (label, text) for label, text in licenses.TEMPLATES if len(text.split()) > 32}
    rows += [(label, "filler " * n + "\n# ".join(text.split("\n")) + " filler" * 300) for label, text in whole.values() for n in (0, 77, 200, 301, 515)]
    found = {r["doc_id"]: r["labels"].split(",") for r in licenses.license_scan(docs(spark, [(i, t) for i, (_, t) in enumerate(rows)])).collect()}
    assert all(label in found[i] for i, (label, _) in enumerate(rows))
    half = docs(spark, [(1, notices["mit"][: len(notices["mit"]) // 2] + " words" * 100 + notices["mit"][len(notices["mit"]) // 2 :])])
    assert licenses.license_scan(half).first()["labels"] == ""
    assert {r["labels"] for r in licenses.license_scan(docs(spark, ODD), []).collect() if r["doc_id"]} == {""}


# ---- personal data

def test_licenses_side_by_side_and_long_ones(spark):
    """A notice of its own has its label beside one that holds all its words; alone within that one it has none."""
    gpl, lgpl = "Licensed under the GNU General Public License version 3.", "Licensed under the GNU Lesser General Public License version 3."
    nc, by = "licensed under CC BY NC 4.0", "licensed under CC BY 4.0"
    rows = [f"{gpl} {lgpl}", f"{lgpl} {gpl}", lgpl, f"{lgpl} {lgpl}", gpl, f"{nc} but the pictures are {by}", nc, f"{nc}; {nc}", by, f"some words {gpl} and more words {lgpl} and {gpl}"]
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.license_scan(docs(spark, [*enumerate(rows)])).collect()}
    gpls, ccs = {"gpl-3", "lgpl-3"}, {"cc-by", "cc-by-nc"}
    want = [gpls, gpls, {"lgpl-3"}, {"lgpl-3"}, {"gpl-3"}, ccs, {"cc-by-nc"}, {"cc-by-nc"}, {"cc-by"}, gpls]
    assert [got[i] & (gpls | ccs) for i in range(len(rows))] == want
    rng = random.Random(3)
    long = [f"t{rng.randrange(900)}" for _ in range(1600)]
    other = [w if rng.random() > 0.03 else "changed" for w in long]
    texts = [" ".join(["before"] * 700 + other + ["after"] * 300), " ".join(long[:1300]), " ".join(long)]
    found = {r["doc_id"]: (r["label"], r["containment"] >= 0.9) for r in licenses.license_matches(docs(spark, [*enumerate(texts)]), [("long", " ".join(long)), *licenses.TEMPLATES]).collect()}
    assert {i: found.get(i) for i in (0, 2)} == {0: ("long", True), 2: ("long", True)}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v if i % 2 == 0 else 2 * v - (9 if v > 4 else 0) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = ["😀 a@b.c%x@d.e and a.b@c-d.example.org.", "1.2.3.4.5.6.7.8 999.1.1.1 001.2.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (650) 555-1234 or +12345678 or +1+2", "x" * 50_000 + "@", "9" * 50_000, "a@b", "😀😀 +44 20 7946 0958 a@b.co", "\x1ea@b.co\x1e 1.2.3.4 \x1e c@d.org", "a@b.co\x1e", "\x1e\x1ea@b.co"]


def test_pii_base_matches_plain(spark, data):
    rows = [*enumerate(TEXTS), *((100 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect())]
    for r in pii.find_spans(docs(spark, rows)).collect():
        assert [tuple(s) for s in r["spans"] if s["kind"] in pii.BASE] == plain_spans(r["text"])
        assert all(0 <= s["start"] < s["end"] <= len(r["text"]) for s in r["spans"])


def test_pii_query_digest(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in pii.op8_pii(spark, data).collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"].startswith(base)


def test_pii_learns_secrets_and_redacts(spark):
    rows = [(100 + i, f"word {i} key AKIAIOSFODNN7EXAMP{i % 10}A and password=deadbeef00{i % 10}f12 then version 4.0 mail u{i}@example.com") for i in range(60)]
    out = pii.redact(docs(spark, rows + ODD)).collect()
    assert all("<SECRET>" in r["text"] and "<EMAIL>" in r["text"] and "AKIA" not in r["text"] and "deadbeef" not in r["text"] and "version 4.0" in r["text"] for r in out if r["text"] and r["text"].startswith("word"))
    assert len(out) == len(rows) + len(ODD) and {r["text"] for r in out if r["doc_id"] == 1} == {None}
    assert pii.redact(docs(spark, [])).count() == 0


def test_pii_names_streets_and_letter_only_secrets(spark):
    told = ["Ask Dr. Anna Schmidt about it", "(Maria Lopez) wrote", "he lives at 221B Baker Street now", "password: correcthorse then", "token = abcdefgh", "see 12 Old Mill Rd."]
    plain = ["the Anna of old", "Kalo Miru wrote", "in 12 streets of Rome", "the password is lost", "version 4.0 of 2024", "page 12 of 300", "it costs 25%"]
    rows = [(i, t) for i, t in enumerate(told * 5 + plain * 20)]
    out = {r["doc_id"]: [(s["kind"], t[s["start"] : s["end"]]) for s in r["spans"]] for r in pii.find_spans(docs(spark, rows)).collect() for t in [r["text"]]}
    assert [out[i] for i in range(len(told))] == [[("name", "Dr. Anna Schmidt")], [("name", "Maria Lopez")], [("address", "221B Baker Street")], [("secret", "correcthorse")], [("secret", "abcdefgh")], [("address", "12 Old Mill Rd")]]
    assert all(not out[i] for i in range(5 * len(told), len(rows)))


PERSONAL = [
    ("ssn on file 078-05-1120 today", "078-05-1120"),
    ("his passport is X1234567 now", "X1234567"),
    ("the password is hunter2 there", "hunter2"),
    ("she was born on 12 March 1984 here", "12 March 1984"),
    ("date of birth: 03/12/1984 noted", "03/12/1984"),
    ("my name is Priya Raghunathan and", "Priya Raghunathan"),
    ("Contact Wei Zhang for more", "Wei Zhang"),
    ("then Keiko Tanaka lives nearby", "Keiko Tanaka"),
    ("at Hauptstraße 12 in town", "Hauptstraße 12"),
    ("Yesterday Maria Lopez came", "Maria Lopez"),
]
HARMLESS = [
    "as Virginia Woolf said", "Charlotte Bronte came later", "in Adam Smith we read", "a novel by Helen Marrow again", "see ISBN 978-3-16-148410-0 there",
    "ISBN:0-306-40615-X", "on 12 March 1984 it rained", "from 03/12/1984 on", "The Great Barrier of ice", "New Model Army marched", "the password is lost", "page 12 of 300", "in 12 ways", "at 10:30 or 25%",
]


def test_pii_beyond_lists(spark):
    """Names of any words, births, national ids, house numbers; authors, ISBN and other dates are none. Each is found
    to the character, and nothing else is."""
    rows = [(i, t) for i, t in enumerate([t for t, _ in PERSONAL] * 3 + HARMLESS * 5)]
    out = {r["doc_id"]: [t[s["start"] : s["end"]] for s in r["spans"]] for r in pii.find_spans(docs(spark, rows)).collect() for t in [r["text"]]}
    told = [want for _, want in PERSONAL] * 3
    wrong = [(rows[i][1], out[i]) for i in range(len(rows)) if out[i] != ([told[i]] if i < len(told) else [])]
    assert not wrong
    named = pii.find_spans(docs(spark, rows), public=["Wei Zhang"]).where("doc_id = 6").first()
    assert not named["spans"]


def test_pii_estimate_matches_plain():
    """EM candidate by candidate, in plain loops."""
    rng = random.Random(8)
    patterns = sorted({tuple(rng.choice((-1, -1, 0, 1)) if j < 4 else -1 for j in range(len(pii.LABELERS))) for _ in range(12)})
    counts, known = [rng.randrange(1, 30) for _ in patterns], [k % 4 == 0 for k in range(len(patterns))]
    got, right = pii.estimate(np.array(patterns), np.array(counts, float), np.array(known), rounds=7)
    items = [(v, k) for v, n, k in zip(patterns, counts, known, strict=True) for _ in range(n)]
    p = [1.0 if k else (sum(x == 1 for x in v) + 0.5) / (sum(x >= 0 for x in v) + 1) for v, k in items]
    alpha = [pii.TRUSTED] * len(pii.LABELERS)
    for _ in range(7):
        for j in range(len(alpha)):
            voted = [(x, v[j]) for x, (v, k) in zip(p, items, strict=True) if v[j] >= 0 and (k or sum(y >= 0 for y in v) > 1)]
            w = pii.PRIOR * len(voted) + 10
            alpha[j] = min(max((sum(x if y else 1 - x for x, y in voted) + pii.TRUSTED * w) / (len(voted) + w), 0.5), 0.999)
        for i, (v, k) in enumerate(items):
            one, zero = 0.5, 0.5
            for j, x in enumerate(v):
                if x >= 0:
                    one, zero = one * (alpha[j] if x else 1 - alpha[j]), zero * (1 - alpha[j] if x else alpha[j])
            p[i] = 1.0 if k else one / (one + zero)
    assert right == pytest.approx(alpha) and [x for x, n in zip(got, counts, strict=True) for _ in range(n)] == pytest.approx(p)


def test_pii_of_very_many_matches(spark):
    """A text with a hundred thousand candidates and some thousand base spans is judged and redacted whole."""
    text = " ".join(f"n{i} a{i}@b.co" if i % 20 == 0 else f"{i}x" for i in range(100_000))
    frame = docs(spark, [(1, text), (2, None)])
    r = pii.find_spans(frame).where("doc_id = 1").first()
    assert [tuple(s) for s in r["spans"] if s["kind"] in pii.BASE] == plain_spans(text)
    out = pii.redact(frame).where("doc_id = 1").first()["text"]
    assert out.count("<EMAIL>") == 5000 and re.sub("<EMAIL>", "", out) == re.sub(PATTERNS["email"], "", text)


def test_running_fold(spark):
    for n in (0, 1, 63, 64, 65, 200):
        xs = [i * 7 % 11 for i in range(n)]
        got = spark.createDataFrame([(xs,)], "xs array<int>").select(running(F.col("xs"), F.lit(0), lambda a, b: a + b).alias("s"), running(F.col("xs"), F.lit(0), lambda a, b: F.greatest(a, b)).alias("m")).first()
        assert got["s"] == [sum(xs[:i]) for i in range(n)] and got["m"] == [max([0, *xs[:i]]) for i in range(n)]
