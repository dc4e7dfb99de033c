"""Near-duplicates, components, packing, urls, pages, scores, pipeline: against plain versions, and odd rows."""

import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest

import corpus_pipeline
from cutflow.llm import classifier, components, hpylm, html_text, neardup, packing, urls

from ..oracle import same

WORDS = [f"w{i}" for i in range(4000)]
ODD = [(9001, None), (9002, ""), (9003, " \n "), (None, "no id here at all"), (9005, "short one"), (9005, "short one")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, component_id string, n int")


def classes(ids, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {i: root(i) for i in ids}


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain_components(rows, size):
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return classes(ids, links), sets


def corpus(seed):
    """Originals, copies with more or fewer edits, and a passage that unrelated texts share."""
    rng, out = random.Random(seed), []
    passage = rng.choices(WORDS, k=60)
    for g in range(6):
        base = rng.choices(WORDS, k=120)
        for _ in range(25 if g else 70):
            t = list(base)
            for _ in range(rng.randrange(0, 14)):
                t[rng.randrange(len(t))] = rng.choice(WORDS)
            out.append(t)
    out += [rng.choices(WORDS, k=30) + passage + rng.choices(WORDS, k=10) for _ in range(60)]
    out += [rng.choices(WORDS, k=rng.randrange(1, 8)) for _ in range(20)]
    rng.shuffle(out)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize(("long_list", "hot"), [(neardup.LIST, neardup.HOT), (2, 8)])
def test_near_duplicates(spark, monkeypatch, long_list, hot):
    monkeypatch.setattr(neardup, "LIST", long_list)
    monkeypatch.setattr(neardup, "HOT", hot)
    rows = corpus(3) + [(1000, "same text twice"), (1001, "same text TWICE")]
    want, sets = plain_components(rows, 2)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs(spark, rows), 2).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_near_duplicates_of_reused_ids(spark):
    a, b = "one text of a few words here", "quite another text with other words"
    rows = [(3, b), (5, a), (5, b), (9, a), (11, a + " z"), (12, "c c c d"), (12, "c c c d"), (None, b), (None, b), (14, "x"), (15, "long " * 2 + "word " * 40_000 + "end")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(spark, rows), 2).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (11, 3, False), (12, 12, True), (None, None, True), (14, 14, True), (15, 15, True)}
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in neardup.distinct_documents(docs(spark, rows), 2).collect())
    assert kept == sorted([(3, b), (5, a), (12, "c c c d"), (14, "x"), rows[-1]])
    assert neardup.distinct_documents(docs(spark, [(1, None), (1, None), (2, "")]), 2).count() == 3
    assert neardup.distinct_documents(docs(spark, []), 2).columns == docs(spark, []).columns


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_near_duplicates_of_all_pairs(spark, folder):
    """No link of any two texts is lost: recall over all pairs, by an index of every shingle."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    sets, at, linked = {i: frozenset(shingles(t, 2)) for i, t in rows}, {}, []
    for i, s in sets.items():
        shared = Counter(j for x in s for j in at.get(x, ()))
        linked += [(i, j) for j, n in shared.items() if 5 * n >= 4 * (len(s) + len(sets[j]) - n)]
        for x in s:
            at.setdefault(x, []).append(i)
    want = classes(list(sets), linked)
    got = {r["doc_id"]: r["component_id"] for r in neardup.op1_minhash(spark, folder).collect()}
    assert len(linked) > 50 and got == want


def test_near_duplicates_odd_rows(spark):
    got = neardup.near_duplicates(docs(spark, ODD), 2).collect()
    assert len(got) == len(ODD) and all(r["kept"] for r in got)
    assert {r["n_shingles"] for r in got if r["doc_id"] in (9001, 9002, 9003)} == {0}
    assert neardup.near_duplicates(docs(spark, []), 2).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_small_tables_are_written_in_few_files(spark, tmp_path, monkeypatch):
    """However many shuffle partitions there are, and though Spark doesn't join small ones."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(WORDS, k=40))) for i in range(150)]
    rows += [(i + 1000, f"{t} more") for i, t in rows]
    monkeypatch.setattr("cutflow.llm.common.shared_dir", lambda spark: str(tmp_path))
    options = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        found = neardup.near_duplicates(docs(spark, rows), size=2).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["doc_id"]: r["component_id"] for r in found} == plain_components(rows, 2)[0]
    files = {d.name.split("-")[0]: len(list(d.glob("*.parquet"))) for d in tmp_path.iterdir()}
    assert {"classes", "one", "lists", "pairs", "near", "links"} <= set(files)
    assert max(n for k, n in files.items() if k in ("classes", "one", "lists", "pairs", "near", "links")) <= 12


# ---- packing


def test_packing_known_chunks_take_no_python_steps():
    """Chunks whose ids are known are looked up in C; Python runs a few steps for a text, whatever its length."""
    encoder, texts, steps = packing.ChunkEncoder(packing.tokenizer_file()), ["alpha beta gamma " * 2000], 0
    want = encoder.encode(texts)

    def trace(frame, event, arg):
        nonlocal steps
        frame.f_trace_opcodes = True
        steps += event == "opcode"
        return trace

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        got = encoder.encode(texts)
    finally:
        sys.settrace(before)
    assert got == want and steps < 2000


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_file()
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = False
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["Hello,", "wörld", "don't", "1234", "x.y", "ÄÖ!", "<|x"], k=rng.choice([3, 50, 900, 9000])))) for i in range(60)] + ODD
    got = packing.packed_documents(docs(spark, rows), path).collect()
    pieces = {(r["doc_id"], r["piece"]): r for r in got if r["doc_id"] is not None and r["doc_id"] != 9005}
    for i, t in rows:
        if i is None or i == 9005:
            continue
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            cut, r = ids[at : at + 4096], pieces.pop((i, k))
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))
    assert not pieces
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 4096
    assert len(bins) <= 1.03 * sum(r["length"] for r in got) / 4096 + 1
    assert packing.packed_documents(docs(spark, []), path).count() == 0


@pytest.mark.parametrize(("limits", "rule"), [({"max_docs": 3}, "norm"), ({"max_cost": 4096.0**2 / 4}, "norm"), ({"max_docs": 5, "max_cost": 4096.0**2 / 3, "weights": (1.0, 1.0, 1.0)}, "dot")])
def test_packing_keeps_every_limit(spark, limits, rule):
    rng = random.Random(7)
    sizes = [rng.choice([5, 60, 700, 1500, 3000]) for _ in range(400)]
    pieces = spark.createDataFrame([(i, 0, n, i) for i, n in enumerate(sizes)], "doc_id long, piece int, length long, ids_crc32 long")
    bins = {}
    for r in packing.pack(pieces, rule=rule, group=150, **limits).collect():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    most = limits.get("max_cost", 4096.0**2)
    for b in bins.values():
        b.sort()
        lengths = [n for _, n in b]
        assert [o for o, _ in b] == [sum(lengths[:k]) for k in range(len(b))] and sum(lengths) <= 4096
        assert len(b) <= limits.get("max_docs", 1024) and (len(b) == 1 or sum(n * n for n in lengths) <= most * (1 + 1e-9))
    alone = sum(n * n > most for n in sizes)
    least = max(sum(sizes) / 4096, len(sizes) / limits.get("max_docs", 1024), alone + sum(n * n for n in sizes if n * n <= most) / most)
    assert sum(map(len, bins.values())) == len(sizes) and len(bins) <= 1.25 * least + 4
    if "max_docs" in limits:
        assert any(len(b) == limits["max_docs"] for b in bins.values())


def test_packing_of_equal_rows(spark):
    """Rows that are equal in everything are dealt into groups like others."""
    rows = docs(spark, [(None, "same")] * 4000).repartition(4)
    got = packing.pack(packing.staged(packing.token_pieces(rows, packing.tokenizer_file()), "pieces"), group=500).collect()
    groups = Counter(r["sequence_id"] >> 32 for r in got)
    assert len(got) == 4000 and len(groups) == 8 and max(groups.values()) < 700


# ---- urls


def test_url_aliases(spark):
    page = lambda i, url, html="": (i, url, html, "x")
    link = lambda to: f'<head><LINK href="{to}" rel="canonical"></head>'
    rows = [
        page(1, "https://safe.example.edu/a", link("https://bad.net/x")),
        page(2, "https://other.example.edu/b", '<meta http-equiv="refresh" content="0; url=http://safe.example.edu/a/#top">'),
        page(3, "https://fr.example.org/fr/1", link("https://c.example.edu/")),
        page(4, "https://c.example.edu?utm_source=x", link("https://bad.net/y")),
        page(5, "https://Example.NET/en/1"),
        page(6, "https://sub.example.com/de/1"),
        page(7, "no scheme"),
        page(8, None, None),
        page(9, "https://net"),
        page(9, "https://net"),
    ]
    got = [tuple(r) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string, rule string")).select("page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()]
    assert [(r[0], r[3], r[4]) for r in got] == [(1, None, "block"), (2, None, "block"), (3, "org/fr/", "allow"), (4, None, "allow"), (5, "example.net/en/", "allow"), (6, "example.com/de/", "block"), (7, None, "allow"), (8, None, "allow"), (9, None, "allow"), (9, None, "allow")]
    assert got[6][1:3] == ("", "") and got[7][1:3] == ("", "") and got[4][1] == "example.net" and got[8][1:3] == ("net", "")


def test_url_aliases_by_every_kind_of_link(spark, tmp_path):
    link = lambda *to: "<head>" + "".join(f"<link rel='canonical' href='{t}'>" for t in to) + "</head>"
    site = "https://a.example.edu/x/y/page?q=1#top"
    rows = [
        (1, site, link("../c")),
        (2, "https://a.example.edu/x/c/", link("//b.net/z")),
        (3, "http://d.example.edu", link("c2")),
        (4, "https://d.example.edu/c2", link("?p=1&amp;ref=r", "https://www.bad.net/&#x71;&#63;k=2")),
        (5, "https://d.example.edu/c2?p=1", None),
        (6, "https://bad.net/q?k=2", ""),
        (7, "https://e.example.edu/1/2", "<base href='/other/'>" + link("./../f/./g/..")),
        (8, "https://e.example.edu/f/", "<META HTTP-EQUIV=refresh content='5;URL=https://sub.example.com/de/1'>"),
        (9, "https://f.example.edu/1", link("mailto:x@bad.net", "#top", "javascript:void(0)", "")),
        (10, "https://g.example.edu/1", link("https://www.h.example.org/fr/2/", "https://bad.net/w")),
        (11, "no scheme", link("../up")),
        (12, None, link("https://bad.net/")),
        (13, "https://i.example.edu/" + "a/" * 3000 + "b", link("../" * 20 + "c", "https://j.example.edu/" + "../" * 2000)),
        (14, "https://i.example.edu/" + "long" * 20_000, "<p>"),
        (15, "https://k.example.edu/alias", "<p>"),
        (16, "https://l.example.edu/1", "<!-- " + link("https://bad.net/") + " --><p>a <!-- open" + link("https://bad.net/")),
        (17, "https://l.example.edu/2", f'<SCRIPT>x = "{link("https://bad.net/")}"</SCRIPT ><template>{link("https://bad.net/")}</template>' + "<script>" + link("https://bad.net/")),
        (18, "https://bad.net/deep", link("https://m.example.edu/" + "s/" * 601 + "../" * 601 + "k")),
        (19, "https://m.example.edu/k", ""),
        (20, "https://bad.net/dash", link("https://n.example.edu/a&#8211;b&#x1F600;&#xD800;c")),
        (21, "https://n.example.edu/a–b😀&#xD800;c", ""),
        (22, "https://bad.net/port", link("http://o.example.edu:80/p")),
        (23, "https://o.example.edu:443/p/", "<textarea>" + link("https://p.example.org/fr/") + "</textarea>"),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, node string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/t/pages.parquet")
    Path(f"{tmp_path}/d").mkdir()
    next(Path(f"{tmp_path}/t/pages.parquet").glob("part-*")).rename(f"{tmp_path}/d/pages.parquet")
    same(urls.op2_urls, urls.OP2_SQL, spark, f"{tmp_path}/d")
    redirects = spark.createDataFrame([("https://k.example.edu/alias", "http://x.net/1"), (None, "http://x.net/1"), ("https://f.example.edu/1", None)], "from_url string, to_url string")
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(pages, redirects=redirects).collect()}
    assert got == {**{i: "allow" for i in range(1, 24)}, **{i: "block" for i in (1, 2, 3, 4, 5, 6, 7, 8, 15, 18, 19, 20, 21, 22, 23)}}
    assert urls.filter_urls(pages.limit(0), redirects=redirects).count() == 0
    assert {r["verdict"] for r in urls.filter_urls(pages, rules=[]).collect()} == {"allow"}


# ---- pages

SITE = '<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></ul></nav><div class="box"><p>About this site</p></div>{}<div id="x7"><b>Follow us</b></div></body></html>'


def test_page_text(spark):
    body = "<article><header><h1>Head &amp; line</h1></header><p>One <b>two<br>three\n four<p>Five &lt;six&gt;<div class='comments'><p>nice</p></div><aside>ad</aside><script>x = '</p>';</script></article>"
    plain = "<div><h1>Plain {0}</h1><p>text number {0}</p></div>"
    rows = [(i, f"https://site.example.org/{i}", SITE.format(plain.format(i))) for i in range(30)] + [(50, "https://other.example.org/1", SITE.format(body)), (51, None, None), (52, "https://a.example.org", ""), (53, "https://a.example.org", "<p>broken <b>page <i>without end"), (53, "https://a.example.org", "<p>broken <b>page <i>without end"), (54, "u://b", "plain & simple"), (55, "u://c", "<div>" * 5000 + "deep" + "<" * 5000)]
    got = html_text.extract_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert all(text[i] == f"Plain {i}\ntext number {i}" for i in range(30))
    assert text[50] == "Head & line\nOne two three four\nFive <six>"
    assert (text[51], text[52], text[53], text[54]) == ("", "", "broken page without end", "plain & simple") and text[55].startswith("deep")


ROTATING = "<div class='k1'><p>Offer number {} ends soon</p></div>"
PLAIN = "<html><body><div class='a'><ul><li>Start<li>Topics {}</ul></div>{}<main><article><h1>Story {}</h1><p>All about {}.</p><p>Shared quote.</p></article></main><div class='z'><p>Imprint</p></div></body></html>"


@pytest.mark.parametrize("pages", [30, 600])
def test_templates_with_untelling_names(spark, pages):
    """Menus and boxes whose names tell nothing go by their recurrence alone, on a small host and on a large one; a
    box that rotates through 20 texts too. What all articles quote stays, and so do equal pages."""
    rotate = 7 if pages == 30 else 20
    rows = [(i, f"https://big.example.org/{i}", PLAIN.format(i % 3, ROTATING.format(i % rotate), i, i)) for i in range(pages)]
    rows += [(10_000 + i, "https://small.example.org/", "<div><p>Only this</p></div>") for i in range(50)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in html_text.extract_text(frame).collect()}
    assert all(text[i] == f"Story {i}\nAll about {i}.\nShared quote." for i in range(pages)) and all(text[10_000 + i] == "Only this" for i in range(50))
    # Without an article element only the method tells the menu from the text.
    bare = [(i, u, h.replace("<article>", "").replace("</article>", "").replace("main>", "div>")) for i, u, h in rows[:pages]]
    frame = spark.createDataFrame(bare, "page_id long, url string, html string")
    with_method = {r["page_id"]: r["text"] for r in html_text.extract_text(frame).collect()}
    without = {r["page_id"]: r["text"] for r in html_text.extract_text(frame, min_pages=10**9).collect()}
    assert all("Imprint" not in t and "Topics" not in t and t.startswith("Story") == (rotate <= 20) for t in with_method.values())
    assert all("Imprint" in t and "Topics" in t for t in without.values())


def test_template_counts_match_plain(spark, data):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    rows += [(5000 + i, f"https://x.example.org/{i % 3}", PLAIN.format(i % 2, ROTATING.format(i % 2), i // 2, i)) for i in range(24)] + [(6000, None, None), (6001, "https://x.example.org", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen, pages = {}, Counter()
    for _, url, page in rows:
        host = (url or "").split("://", 1)[1].split("/")[0].lower() if "://" in (url or "") else ""
        pages[host] += 1
        around, within, main = html_text.candidates(page)
        for near, hashes in ((True, around), (False, within)):
            for h in hashes:
                seen.setdefault((host, h, near), []).append(main)
    want = {k for k, mains in seen.items() if len(set(mains)) >= 4 and (k[2] or len(mains) >= 0.05 * pages[k[0]])}
    found = frame.select("page_id", urls.host_path(F.col("url"))["host"].alias("host"), "html").mapInArrow(html_text._candidates, "key long, host string, around array<long>, within array<long>, main long")
    got = {tuple(r) for r in html_text.template_subtrees(found).collect()}
    assert got == want and len(want) > 3
    assert html_text.extract_text(frame.limit(0)).count() == 0


# ---- scores


def test_dense_ridge_and_ties(spark):
    """Partition sums solve the same ridge regression as one dense system; equal texts have equal scores."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(300, classifier.N_STATS)), rng.integers(0, 2, 300).astype(float)
    project = classifier.Projection(x.mean(0), x.std(0))
    frame = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)], "x array<double>, y double").repartition(5)
    sums = np.zeros((classifier.WIDTH + 1) * (classifier.WIDTH + 2))
    for r in frame.mapInArrow(classifier._normal_equations(project), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        sums[r["k"]] = r["v"]
    z = project(x)
    assert sums.reshape(classifier.WIDTH + 1, -1) == pytest.approx(z.T @ np.hstack([z, y[:, None]]), abs=1e-8)
    rows = [(i, "same text again" if i % 2 else "word " * (200_000 if i == 40 else 5)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in classifier.quality_scores(docs(spark, rows), labels).collect()}
    assert len({got[i] for i in range(1, 60, 2)}) == 1 and len({got[i] for i in range(0, 60, 2) if i != 40}) == 1 and got[1] > got[0] and 0 <= got[40] <= 1


def test_classifier_held_out_accuracy(spark):
    rng = random.Random(2)
    rows = [(i, (" ".join(rng.choices(WORDS, k=80)).capitalize() + ".") if i % 3 else " ".join(w.upper() + "!!" for w in rng.choices(WORDS, k=60))) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(900)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = classifier.quality_scores(docs(spark, rows + ODD), labels).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert {r["doc_id"] for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["predicted"] == (r["doc_id"] % 3 > 0) for r in held) >= 0.97 * len(held)
    assert {r["score"] for r in classifier.quality_scores(docs(spark, ODD), labels.limit(0)).collect()} == {0.5}
    assert classifier.quality_scores(docs(spark, []), labels).count() == 0


def test_isotonic():
    x, y = classifier.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert list(y) == [0, 0.5, 1] and list(x) == [0, 1.5, 3]


def plain_base(rows):
    tok = lambda t: [*(t or "").encode().lower().split(), b" "]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    return n, lambda i, t: (held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)))


@pytest.mark.parametrize("bucket", [hpylm.BUCKET, 500])
def test_language_model(spark, bucket):
    rng = random.Random(4)
    follow = {w: rng.choices(WORDS[:300], k=3) for w in WORDS[:300]}
    rows = []
    for i in range(400):
        w = [rng.choice(WORDS[:300])]
        while len(w) < 60:
            w.append(rng.choice(follow[w[-1]]) if rng.random() < 0.9 else "the")
            if w[-1] == "the":
                w.append(rng.choice(WORDS[:300]))
        rows.append((i, " ".join(w)))
    rows += ODD
    n, base = plain_base(rows)
    got = hpylm.score_documents(docs(spark, rows), bucket).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t in rows}
    for r in got:
        want = base(r["doc_id"], text[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (*want[:3], n)
        assert r["base_score"] == pytest.approx(want[3], rel=1e-9) and r["score"] < 0
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 5]
    assert sum(r["score"] for r in held) > 0.85 * sum(r["base_score"] for r in held)
    assert hpylm.score_documents(docs(spark, []), bucket).count() == 0


def test_language_model_odd_rows(spark):
    """Rows without an id are told apart by their texts; equal rows have equal scores; a very long text is one row."""
    rows = [(None, f"no id {i % 7} here") for i in range(40)] + [(5, "twice"), (5, "twice"), (5, "other"), (9, "long words " * 60_000)]
    got = hpylm.score_documents(docs(spark, rows)).collect()
    _, base = plain_base(rows)
    assert len(got) == len(rows)
    want = Counter((i, *base(i, t)[1:3], round(base(i, t)[3], 4)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert len({r["score"] for r in got if r["doc_id"] is None}) <= 7 and len({r["score"] for r in got if r["doc_id"] == 5}) == 2


def test_language_model_hands_over_little_at_a_time(spark, monkeypatch):
    """Dealt tokens go to Spark in small batches, all of them; packed tables aren't compressed again beside the heap."""
    monkeypatch.setattr(hpylm, "SENT", 20_000)
    rng = random.Random(8)
    texts = pa.array([" ".join(str(rng.randrange(5000)) for _ in range(200)) for _ in range(300)])
    rows = pa.record_batch([texts, pa.array([False] * 300), pa.array(range(300), pa.int64()), pa.array(range(300), pa.int64())], ["text", "held", "id", "salt"])
    parts = [b.select(["part", "packed"]) for b in hpylm._tokenize([rows])]
    dealt = list(hpylm._deal(hpylm.Hot(np.zeros(0, np.uint64), np.zeros(0, np.uint64)), 30)(parts))
    sizes = [[len(x) for x in b.column("packed").to_pylist()] for b in dealt]
    assert len(sizes) > 3 and all(sum(x[:-1]) < hpylm.SENT for x in sizes)
    assert sum(len(hpylm.unpack(x)[0]) for b in dealt for x in b.column("packed").to_pylist()) == 300 * 201
    assert sorted(k for b in dealt for k in b.column("bucket").to_pylist()) == list(range(30))
    hpylm.score_documents(docs(spark, [(1, "a b c")])).collect()
    files = [x.name for name in ("tokens", "buckets") for x in Path(spark.conf.get("spark.checkpoint.dir")).glob(f"{name}-*/part-*")]
    assert files and not any("snappy" in x or "gz" in x for x in files)


def test_language_model_tells_contexts_apart(spark):
    """Each of 3000 words has a successor of its own: a model of classes of them mixes those."""
    rng = random.Random(7)
    rows = [(i, " ".join(f"a{k} b{k}" for k in rng.choices(range(3000), k=60))) for i in range(400)]
    held = [r for r in hpylm.score_documents(docs(spark, rows), 20_000).collect() if r["held_out"]]
    assert len(held) > 30 and sum(r["score"] for r in held) > -4.0 * 60 * len(held)


def test_contexts_of_their_own_sum_to_one():
    rng = np.random.default_rng(3)
    per, words = np.full(30, 40, np.int32), 40
    word, count = np.tile(np.arange(words, dtype=np.int32), 30), rng.poisson(0.6, 1200).astype(np.int32)
    none = np.zeros(0, np.int64)
    leaves = hpylm.Leaves(hpylm.pack(per, word, count, none, none, none, none), count > 0, None)
    root = None
    for _ in range(4):
        c = leaves.sums(words)
        t = root.seat(c, rng) if root else (c > 0).astype(int)
        root = hpylm.Root(float(c.sum()), float(t.sum()), float(words), (0.4, 0.7))
        assert (leaves.fine <= count).all() and (leaves.fine >= (count > 0)).all() and (t <= c).all()
        p, new = leaves.probabilities(root, c, t), root.probability(np.zeros(1), np.zeros(1))
        unseen = (1 + 0.7 * leaves.tables()) / (1 + leaves.customers) * new
        assert np.bincount(leaves.context, weights=p) + unseen == pytest.approx(np.ones(30), abs=1e-9)
        leaves.sweep(root, c, t, rng)


def test_a_chain_is_repeated_as_it_was():
    """Repeating the sweeps of all rounds gives the state they left."""
    rng = np.random.default_rng(2)
    word, ctx = np.repeat(np.arange(40), hpylm.CONTEXTS), np.tile(np.arange(hpylm.CONTEXTS), 40)
    count = rng.poisson(0.4, len(word))
    s = [hpylm.Totals(hpylm.Seating(word, ctx, count).totals())]
    once = hpylm.Seating(word, ctx, count)
    steps = once.run(s, 11)
    for _ in range(2):
        s.append(hpylm.Totals(once.totals()))
        once.sweep(s[-1], steps)
    again = hpylm.Seating(word, ctx, count)
    again.run(s, 11)
    assert (again.fine == once.fine).all() and (again.mid_t == once.mid_t).all() and (again.root_t == once.root_t).all()
    assert (once.fine <= count).all() and (once.fine >= (count > 0)).all()


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    word, ctx = np.repeat(np.arange(50), hpylm.CONTEXTS), np.tile(np.arange(hpylm.CONTEXTS), 50)
    s = hpylm.Seating(word, ctx, rng.poisson(0.3, len(word)))
    for _ in range(4):
        s.sweep(hpylm.Totals(s.totals()), rng)
    t = hpylm.Totals(s.totals())
    _, _, fine = s.probabilities(t)
    unseen = (1 + t.discounts[0] * t.root_tables) / (t.words + 1) / (1 + t.root_customers)
    d, h = t.discounts, hpylm.STRENGTH
    mid = (h[1] + d[1] * t.coarse_tables) / (h[1] + t.coarse_customers) * unseen
    rest = (h[2] + d[2] * t.tables) / (h[2] + t.customers) * np.repeat(mid, hpylm.CONTEXTS // hpylm.COARSE)
    assert np.bincount(ctx, weights=fine) + rest == pytest.approx(np.ones(hpylm.CONTEXTS), abs=1e-9)


# ---- pipeline


def test_pipeline_stages(spark, data):
    found = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in found.collect()]
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, found, data).select("doc_id").collect()}
    some = found.where(found.doc_id.isin(sorted(kept)))
    want, _ = plain_components([x for x in rows if x[0] in kept], 5)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, some, data).collect()} == {i for i, c in want.items() if i == c}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, found, data).columns == found.columns, name
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_pipeline_of_odd_rows(spark, data, tmp_path):
    """Equal rows become one, an id with two texts keeps both, rows without an id stay, and columns may have any name."""
    some = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").where("length(text) > 300 and lang = 'en'").orderBy("doc_id").collect()]
    texts = [t for t in some if not re.search("[0-9@]", t)][:4]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[1]), (2, texts[1] + " more"), (3, texts[2]), (None, texts[3]), (None, texts[3]), (4, None), (5, "")]
    names = ["kept", "spans", "items", "llr", "id", "h", "m", "component_id", "_extra", "n_chars"]
    frame = spark.createDataFrame([(i, t, *["x"] * 9, 1) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names[:-1]) + ", n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    docs_ = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = corpus_pipeline.staged(stage(spark, docs_, str(tmp_path)), name)
        assert docs_.columns == frame.columns, name
        kept[name] = sorted((r["doc_id"] or 0, r["text"]) for r in docs_.collect())
    assert kept["personal_data"] == sorted([(1, texts[0]), (1, texts[1]), (3, texts[2]), (0, texts[3])])
    assert len(kept["quality"]) == 7 and corpus_pipeline.run(spark, str(tmp_path)).count() == 4


def test_pipeline_of_nothing(spark, data, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
