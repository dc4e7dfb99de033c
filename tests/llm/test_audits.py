"""Source divergence, suffixes and tokenizer alignment: against plain versions, and odd rows."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pyspark.sql.functions as F
import pytest

from cutflow.llm import alignment, divergence, suffixes

from ..oracle import same

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, h1 string, term string, n int"
PARTS = ["a", "b", "The", "ing", " ", "  ", "\n", "\r\n", "\t", "\xa0", "　", "▁", "é", "漢字", "😀", "'s", "123", "!!", "\x00", "<s>", "<|endoftext|>", "<0x0A>", "ﬁ", "x" * 30, " The"]


def frame(spark, rows):
    """rows (doc_id, text, lang, source), with columns whose names clash."""
    return spark.createDataFrame([(*r, "c", "c", 1) for r in rows], SCHEMA).repartition(3)


# --- source divergence


def plain_divergence(rows, least=3, top=200):
    docs = [((lang or ""), (source or ""), [w.decode() for w in (text or "").encode().translate(divergence.TERM_BYTES).split()]) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, w in here for t in set(w))
        kept = sorted(t for t, n in seen.items() if n >= least)
        counts = defaultdict(Counter)
        for _, source, w in here:
            counts[source].update(t for t in w if seen[t] >= least)
        whole = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        q, ps = p(whole), {s: p(c) for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in ps:
            pairs = [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in ps if o != s]
            terms = [(t, f(ps[s][t], q[t])) for t in kept if counts[s][t] > 0 and ps[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def got_divergence(spark, rows, **options):
    return sorted(tuple(r) for r in divergence.divergence(frame(spark, rows), **options).select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_of_odd_rows(spark):
    rows = [(1, "Apple pear, apple", "x", "s"), (2, "apple PEAR plum", "x", "t"), (2, "apple PEAR plum", "x", "t"), (None, "pear-apple\x00fig", "x", None), (4, None, "x", "empty"), (5, "!!", None, None), (6, "only one", None, "z"), (7, "ñandú Ñandú É é apple", "x", "s"), (8, None, "y", "alone")]
    assert got_divergence(spark, rows) == plain_divergence(rows)
    assert got_divergence(spark, []) == []


@pytest.mark.parametrize("top", [1, 7, 200])
def test_best_first_terms(spark, top):
    """Many ties, a source with a third of all rows, and a text of many words."""
    rng = random.Random(top)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1 + i % 7) for k in range(300)], k=rng.randrange(1, 60))), "ab"[i % 2], f"s{0 if i % 3 == 0 else i % 5}") for i in range(150)]
    rows.append((999, " ".join(rng.choices(words, k=60_000)), "a", "s1"))
    assert got_divergence(spark, rows, top=top) == plain_divergence(rows, top=top)


def test_divergence_sql(spark, data):
    same(divergence.op11_divergence, divergence.OP11_SQL, spark, data)


# --- suffixes


def plain_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got_repeats(spark, texts, **options):
    found = suffixes.remove_repeats(frame(spark, [(i, t, "", "") for i, t in enumerate(texts)]), **options)
    return sorted(tuple(r) for r in found.select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def repeating(seed, n=120):
    rng = random.Random(seed)
    letters = "abé" if seed % 2 else "abcdefgh"
    passages = ["".join(rng.choices(letters, k=k)) for k in (18, 25, 40, 90, 300)]
    texts = [None, "", "a", "ab" * 200, "a" * 333, "a" * 24, "a" * 23]
    for _ in range(n):
        text = "".join(rng.choices(letters, k=rng.randrange(0, 60)))
        for p in rng.choices(passages, k=rng.randrange(0, 3)):
            lo = rng.randrange(0, len(p) // 2)
            text += p[lo : rng.randrange(lo, len(p) + 1)] + "".join(rng.choices(letters, k=rng.randrange(0, 9)))
        texts.append(text)
    base = "".join(rng.choices(letters, k=150))
    for _ in range(40):  # near copies
        t = [*base]
        t[rng.randrange(150)] = "#"
        texts.append("".join(t))
    return texts + ["copy " * 9] * 30


@pytest.mark.parametrize(("seed", "few", "ranges", "run"), [(1, 6, 10**9, 10**9), (2, 6, 2000, 3000), (3, 2, 500, 800), (4, 0, 10**9, 500)])
def test_repeats(spark, monkeypatch, seed, few, ranges, run):
    for name, value in (("FEW", few), ("RANGE", ranges), ("RUN", run), ("SLICE", 97 if seed == 3 else 1 << 20)):
        monkeypatch.setattr(suffixes, name, value)
    texts = repeating(seed)
    assert got_repeats(spark, texts, length=24, window=8, gram=8) == plain_repeats(texts, 24)


def test_repeats_of_the_tables(spark, data):
    texts = [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    want = plain_repeats(texts, 400)
    assert got_repeats(spark, texts) == want and sum(w[1] for w in want) > 0


def test_long_texts_repeat(spark):
    rng = random.Random(5)
    text = rng.randbytes(1_600_000).hex()
    texts = [text + "end", "x" + text[1_000_000:1_000_900], "a" * 300_000]
    got = {r["n_bytes"]: r for r in suffixes.remove_repeats(frame(spark, [(i, t, "", "") for i, t in enumerate(texts)])).collect()}
    assert (got[len(text) + 3]["n_removed"], got[len(text) + 3]["n_spans"]) == (900, 1)
    assert bytes(got[901]["kept"]) == b"x" and got[300_000]["n_removed"] == 300_000


def test_no_documents_repeat(spark):
    assert got_repeats(spark, []) == [] and got_repeats(spark, [None, "short"]) == plain_repeats([None, "short"], 400)


def test_merge_runs():
    rng = random.Random(7)
    for k in (0, 1, 2, 5, 9):
        runs = [sorted(bytes(rng.choices(b"ab", k=rng.randrange(0, 12))) for _ in range(rng.randrange(0, 40))) for _ in range(k)]
        coded = [[(suffixes.shared(r[i - 1], s) if i else 0, s, None) for i, s in enumerate(r)] for r in runs]
        merged = [*suffixes.merge_runs(coded)]
        want = sorted(s for r in runs for s in r)
        assert [m[1] for m in merged] == want
        assert [m[0] for m in merged] == [suffixes.shared(want[i - 1], s) if i else 0 for i, s in enumerate(want)]
        for r in runs:
            entries = [(s, b"left", 4, 0, 1, bytes(16)) for s in r]
            assert [(s, more) for _, s, more in suffixes.decode_run(suffixes.encode_run(entries))] == [(e[0], e[1:]) for e in entries]


# --- alignment


def plain_alignments(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    known = alignment.Aligner(BYTES, PIECES)
    a_of, b_of = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_of.encode_special_tokens = True
    each, counts = [], Counter()
    for text in texts:
        a, b = (a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)) if text else ([], [])
        parts = [known.a_bytes[i] for i in a], [known.b_bytes[i] for i in b]
        if not text or any(b"".join(p) != f" {text}".encode() for p in parts):
            each.append(([], [], [], ""))
            continue
        ends = [[*accumulate(map(len, p))] for p in parts]
        spans = [[*zip([0, *e[:-1]], e, strict=True)] for e in ends]
        links = [(a[i], b[j]) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if max(x[0], y[0]) < min(x[1], y[1])]
        counts.update(links)
        groups, at = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            ids = []
            for k, tokens in enumerate((a, b)):
                n = sum(e <= cut for e in ends[k])
                ids.append(",".join(map(str, tokens[at[k] : n])))
                at[k] = n
            groups.append("|".join(ids))
        each.append((a, b, links, ";".join(groups)))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    return sorted((len(a), len(b), g.count("|"), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), digest(g)) for a, b, links, g in each)


@pytest.mark.parametrize(("pairs", "units", "block", "sums"), [(10**6, 300_000, 100_000, 10**6), (10**6, 5, 3, 3), (0, 300_000, 7, 10**6)])
def test_alignments(spark, monkeypatch, pairs, units, block, sums):
    rng = random.Random(11)
    texts = [None, "", " ", "  ", "\n", "word ", "same text", "same text", "\n\nTwo lines\n and\tmore", "unbroken" * 40, "\0after, a zero", "two\n\nlines\n\n\nthree"]
    texts += ["".join(rng.choices(PARTS, k=rng.randrange(1, 30))) for _ in range(60)] + ["The quick brown foxes' antidisestablishmentarianism"] * 5
    texts += [" ".join(rng.choices(["plain,", "words;", "of", "all\nkinds", "¿ñandú?", "x²."], k=30)) for _ in range(20)]
    for name, value in (("UNITS", units), ("BLOCK", block), ("SUMS", sums)):
        monkeypatch.setattr(alignment, name, value)
    rows = [(i if i % 7 else None, t, "", "") for i, t in enumerate(texts)]
    found = alignment.alignments(frame(spark, rows), BYTES, PIECES, pairs)
    assert sorted(tuple(r) for r in found.drop("doc_id").collect()) == plain_alignments(texts)
    assert found.select("doc_id").where("doc_id is null").count() == sum(r[0] is None for r in rows)


def test_alignment_of_a_long_text_and_of_none(spark):
    text = "Lengthy documents are aligned whole, " * 20_000
    r = alignment.alignments(frame(spark, [(1, text, "", "")]), BYTES, PIECES).first()
    assert r["n_links"] >= max(r["n_a"], r["n_b"]) >= r["n_groups"] > 100_000
    assert alignment.alignments(frame(spark, []), BYTES, PIECES).where(F.lit(True)).count() == 0
