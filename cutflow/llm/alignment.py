"""Alignment of two tokenizers' tokens, and how often their ids are linked in the whole corpus.

A text is cut into units where white space follows another character: neither tokenizer has a token across such a place,
so units are encoded apart, and a worker remembers what it aligned. In a unit the tokens of both tokenizers are the nodes
of a bipartite graph whose edges join tokens with overlapping byte ranges. Union-find gives its connected components,
which are the minimal groups between common ends, and the members of each expand its links.

The texts are read once. A document's row holds its distinct links and how many it has of each, and each task sums the
links of all it reads. Spark adds the sums up, and the counts come back to the documents' rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import staged, table

UNITS = 300_000  # units a worker remembers
TOKENS = 4_000_000  # of them
BLOCK = 100_000  # units that are aligned at a time; a longer text is aligned piece by piece
PAIRS = 2_000_000  # pairs of ids, 16 bytes each, that are sent to all tasks; more are joined
SUMS = 1_000_000  # sums of links that a task holds before it hands them on
MARKS = ".,;:!?%&*#$|)\""  # that may end a word


def _byte_of_character() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def components(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """For each edge (a, b) of a bipartite graph, the least node of A in its connected component.

    Union-find for all edges at once: the roots of both ends of an edge are hooked to the smaller one, and paths are
    halved, until nothing changes. a and b must not decrease, as along a text."""
    up_a, up_b = np.arange(n_a), np.zeros(n_b, np.int64)
    first_a, first_b = (np.flatnonzero(np.concatenate([[True], np.diff(x) != 0])) for x in (a, b))
    while True:
        up_b[b[first_b]] = np.minimum.reduceat(up_a[a], first_b)
        new = up_a.copy()
        new[a[first_a]] = np.minimum(new[a[first_a]], np.minimum.reduceat(up_b[b], first_a))
        new = new[new]
        if (new == up_a).all():
            return up_a[a]
        up_a = new


class Aligner:
    """Units by number: what both tokenizers make of them, their groups and their links."""

    def __init__(self, byte_bpe: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        codes, vocab = _byte_of_character(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(codes[c] for c in t) if all(c in codes for c in t) else t.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([*map(len, x)]) for x in (self.a_bytes, self.b_bytes))
        self.prefix = self.b.piece_to_id("▁")
        text = [p.replace("▁", " ") for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        inside = lambda c: any(re.search(rf"\S{c}", p) or c != " " and c in p and (c + p.split(c)[1])[1:2] for p in text)
        # White space before which a unit may begin: no piece holds it beside another character.
        cut = "".join(c for c in " \t\n" if not inside(c))
        self.unit = re.compile(rf"\s*\S+(?:[^\S{cut}]\s*\S*)*|\s+" if " " in cut else r"(?s).+")
        self.plain = " " in cut and "\n" in cut
        self.newline = self.b.encode("\n")
        self.marks = "".join(c for c in MARKS if not any(re.search(rf"[^\W\d_]{re.escape(c)}", p) for p in text)) if "\n" in cut else ""
        self.base = len(pieces)  # a pair of ids is A's times this, and B's
        texts = [*map(str, range(max(len(self.a_bytes), self.base)))]
        self.digits = np.array([*map(len, texts)])
        self.written = np.array([t.ljust(int(self.digits.max())) for t in texts]).astype("S").view(np.uint8).reshape(len(texts), -1)
        self.parts: dict[str, tuple | None] = {}
        self.index: dict[str, int] = {}
        self.flat, self.starts = [array("q"), array("q")], [array("q", [0]), array("q", [0])]

    def forget(self) -> None:
        """When too much is known, keeps what was known first, which is what is frequent."""
        if len(self.index) <= UNITS and max(s[-1] for s in self.starts) <= TOKENS:
            return
        keep = UNITS // 2 if max(s[min(UNITS // 2, len(s) - 1)] for s in self.starts) <= TOKENS // 2 else 0
        self.index = dict(islice(self.index.items(), keep))
        self.parts = dict(islice(self.parts.items(), keep))
        for flat, starts in zip(self.flat, self.starts, strict=True):
            del starts[keep + 1 :], flat[starts[-1] :]

    #: White space that is more than one character, but for one empty line, and at the end.
    ODD = re.compile(r"\s\s(?<!\n\n)|\s\s\s|\s$")

    def units(self, text: str) -> list[str]:
        """The units of a space and the text: without their first space, those that don't begin with one after a newline,
        or after a zero character where they might be taken for the others."""
        if self.plain and text and not text[0].isspace() and "\0" not in text and not self.ODD.search(text):
            return text.replace("\n", " \n").split(" ")
        return ["\0" + u for u in self.unit.findall(" " + text)]

    def numbered(self, units: list[str]) -> np.ndarray:
        if missing := set(units).difference(self.index):
            self._learn([*missing])
        return np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))

    def tokens(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each tokenizer: how many ids each of the units has, and all ids. No ids stand for what isn't given back."""
        out = []
        for flat, starts in zip(self.flat, self.starts, strict=True):
            first = np.frombuffer(starts, np.int64)
            n = first[rows + 1] - first[rows]
            at = np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((n, np.frombuffer(flat, np.int64)[at] if len(at) else at))
        return out

    def _encode(self, parts: list[str]) -> None:
        """ids of both tokenizers for parts of units, or None if they don't give the bytes back."""
        a_all = [e.ids for e in self.a.encode_batch(parts, add_special_tokens=False)]
        # The model puts a space before what it encodes, unless that is nothing; other parts stand after a newline.
        b_all = self.b.encode([p[1:] if p[0] == " " else "\n" + p for p in parts], num_threads=1)
        for p, a, b in zip(parts, a_all, b_all, strict=True):
            b = b[len(self.newline) :] if p[0] != " " else b or [self.prefix]
            raw = p.encode()
            fits = b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b])
            self.parts[p] = (a, b) if fits else None

    def _learn(self, keys: list[str]) -> None:
        units = [k[1:] if k[:1] == "\0" else k if k[:1] == "\n" else " " + k for k in keys]
        split = []
        for u in units:
            stem = u.rstrip(self.marks)
            split.append((stem, u[len(stem) :]) if len(stem) < len(u) and stem[-1:].isalpha() and stem[-1] < "\u0250" else (u,))
        if new := {p for parts in split for p in parts}.difference(self.parts):
            self._encode([*new])
        for key, parts in zip(keys, split, strict=True):
            self.index[key] = len(self.index)
            known = [self.parts[p] for p in parts]
            for k, (flat, starts) in enumerate(zip(self.flat, self.starts, strict=True)):
                if None not in known:
                    for x in known:
                        flat.extend(x[k])
                starts.append(len(flat))

    def align(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Units of several texts, sizes of each: n_a, n_b, n_groups and n_links of each text, its groups as text, and the
        distinct links of all: text, pair, how many. Texts with a unit that isn't given back have nothing."""
        (n_a, a), (n_b, b) = self.tokens(rows)
        text = np.repeat(np.arange(len(sizes)), sizes)
        lost = np.zeros(len(sizes), bool)
        lost[text[n_a == 0]] = True
        a, b = a[np.repeat(~lost[text], n_a)], b[np.repeat(~lost[text], n_b)]
        count = lambda n: np.bincount(text, np.where(lost[text], 0, n), len(sizes)).astype(np.int64)
        per_a, per_b = count(n_a), count(n_b)
        if not len(a):
            return np.zeros((len(sizes), 4), np.int64), [b""] * len(sizes), *[np.zeros(0, np.int64)] * 3
        ends_a, ends_b = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        # Between two ends next to each other lie one token of each, which is an edge of the graph.
        marks = np.zeros(ends_a[-1] + 1, np.uint8)
        marks[ends_a] = 1
        marks[ends_b] += 2
        ends = marks[np.flatnonzero(marks)].astype(np.int64)
        i, j = np.cumsum(ends & 1) - (ends & 1), np.cumsum(ends >> 1) - (ends >> 1)
        group = components(i, j, len(a), len(b))
        first = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
        lo_a, lo_b = np.append(i[first], len(a)), np.append(j[first], len(b))
        own = np.repeat(np.arange(len(sizes)), per_a)  # text of each of A's tokens
        per_group, per_link = np.bincount(own[i[first]], minlength=len(sizes)), np.bincount(own[i], minlength=len(sizes))
        # All ids as they are written: A's of a group, then B's.
        of_a, of_b = np.repeat(np.arange(len(first)), np.diff(lo_a)), np.repeat(np.arange(len(first)), np.diff(lo_b))
        ids, after = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[np.arange(len(a)) + lo_b[of_a]] = a
        ids[np.arange(len(b)) + lo_a[of_b + 1]] = b
        after[lo_a[1:] + lo_b[:-1] - 1] = ord("|")
        after[lo_a[1:] + lo_b[1:] - 1] = ord(";")
        digits = self.digits[ids]
        at = np.cumsum(digits + 1) - digits - 1
        said = np.empty(at[-1] + digits[-1] + 1, np.uint8)
        for k in range(int(digits.max())):
            on = np.flatnonzero(digits > k)
            said[at[on] + k] = self.written[ids[on], k]
        said[at + digits] = after
        cut = np.append(at, len(said))[np.cumsum(np.append(0, per_a + per_b))]
        raw = said.tobytes()
        texts = [raw[p : q - 1] if q > p else b"" for p, q in zip(cut.tolist(), cut[1:].tolist(), strict=False)]
        span = len(self.a_bytes) * self.base
        each, n = np.unique(own[i] * span + a[i] * self.base + b[j], return_counts=True)
        return np.stack([per_a, per_b, per_group, per_link], 1), texts, each // span, each % span, n


_aligners: dict[tuple, Aligner] = {}


def aligner_of(paths: tuple[str, str]) -> Aligner:
    """The worker's own, which it keeps for its later tasks."""
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


LISTS = pa.list_(pa.int64())
ROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", LISTS), ("n", LISTS)])
ROW_SQL = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, n array<long>"


def _pieces(texts, aligner: Aligner):
    """(row, units, whether it is the row's last piece) of every text, in pieces of at most BLOCK units."""
    for row, text in enumerate(texts):
        units = aligner.units(text) if text else []
        for k in range(0, max(1, len(units)), BLOCK):
            yield row, units[k : k + BLOCK], k + BLOCK >= len(units)


def _blocks(pieces):
    """Pieces, of about BLOCK units together."""
    block, size = [], 0
    for p in pieces:
        block.append(p)
        size += len(p[1])
        if size >= BLOCK or len(block) >= 2000:
            yield block
            block, size = [], 0
    if block:
        yield block


class Document:
    """What the pieces of a text add up to."""

    def __init__(self):
        self.numbers, self.hash, self.lost, self.links = np.zeros(4, np.int64), hashlib.sha256(), False, []

    def add(self, units: int, numbers: np.ndarray, said: bytes, pairs: np.ndarray, n: np.ndarray) -> None:
        self.lost |= units > 0 and not said
        if said:
            self.hash.update(b";" + said if self.numbers.any() else said)
        self.numbers = self.numbers + numbers
        self.links.append((pairs, n))

    def row(self) -> tuple:
        if self.lost or not self.numbers.any():
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        return *self.numbers.tolist(), self.hash.hexdigest(), *summed(self.links)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and their numbers, each pair once."""
    if len(parts) == 1:
        return parts[0]
    pairs, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return pairs, np.bincount(where, np.concatenate([n for _, n in parts]), len(pairs)).astype(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(rows) if rows else [], pa.int64())).cast(LISTS)


def _read(paths: tuple[str, str]):
    """A row for each document, with its distinct links; and, without a row number, rows of what the task has of each link."""

    def run(batches):
        from pyspark import TaskContext

        aligner, number = aligner_of(paths), TaskContext.get().partitionId() << 40
        sums: list[tuple] = []

        def spread():
            pairs, n = summed([*sums, (np.zeros(0, np.int64), np.zeros(0, np.int64))])
            sums.clear()
            for k in range(0, len(pairs), 50_000):
                yield pa.record_batch([*(pa.nulls(1, f.type) for f in list(ROW)[:7]), _lists([pairs[k : k + 50_000]]), _lists([n[k : k + 50_000]])], schema=ROW)

        for batch in batches:
            ids, held = batch.column(0), {}
            for block in _blocks(_pieces(batch.column(1).to_pylist(), aligner)):
                aligner.forget()
                rows = aligner.numbered([u for _, units, _ in block for u in units])
                numbers, texts, of, pairs, n = aligner.align(rows, np.array([len(units) for _, units, _ in block]))
                cut = np.searchsorted(of, np.arange(len(block) + 1))
                done, docs = [], []
                for k, (row, units, last) in enumerate(block):
                    doc = held.setdefault(row, Document())
                    doc.add(len(units), numbers[k], texts[k], pairs[cut[k] : cut[k + 1]], n[cut[k] : cut[k + 1]])
                    if last:
                        done.append(row)
                        docs.append(held.pop(row).row())
                if docs:
                    *plain, links, times = zip(*docs, strict=True)
                    columns = [pa.array(np.arange(number, number + len(docs))), ids.take(pa.array(done)), *(pa.array(c, f.type) for c, f in zip(plain, list(ROW)[2:], strict=False))]
                    yield pa.record_batch([*columns, _lists(links), _lists(times)], schema=ROW)
                    number += len(docs)
                    sums.append(summed([*zip(links, times, strict=True)]))
                if sum(len(p) for p, _ in sums) > SUMS:
                    sums[:] = [summed(sums)]
                    if len(sums[0][0]) > SUMS // 2:
                        yield from spread()
        yield from spread()

    return run


SCORED = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def _score(held):
    """Adds up the counts of each row's links, by the pairs held."""

    def run(batches):
        pairs, counts, best = held.value
        for b in batches:
            links, n = b.column("pairs"), b.column("n").flatten().to_numpy()
            at = np.searchsorted(pairs, links.flatten().to_numpy())
            edges = links.offsets.to_numpy() - links.offsets[0].as_py()
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (n * best[at], n * counts[at])]
            more = [pa.array(s[edges[1:]] - s[edges[:-1]], pa.int64()) for s in sums]
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *more, b.column("groups_sha256")], schema=SCORED)

    return run


def alignments(docs: DataFrame, byte_bpe: str, piece_model: str, most_pairs: int = PAIRS) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, a row each.

    Null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have zeros and ''. Repeated rows
    count as often as they stand there, and each has its row; an empty table gives none. Of pairs of equal count all are
    a B id's best. The table of pairs is counted first: up to most_pairs go to all tasks, and the links of a larger one
    are joined to it."""
    spark = docs.sparkSession
    read = staged(docs.select("doc_id", "text").mapInArrow(_read((byte_bpe, piece_model)), ROW_SQL), "links")
    sums = read.where("row is null").select(F.explode(F.arrays_zip("pairs", "n")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.n").alias("n"))
    counted = staged(sums, "pairs")
    b = F.col("pair") % Aligner(byte_bpe, piece_model).base
    highest = counted.groupBy(b.alias("b")).agg(F.max("n").alias("top"))
    known = counted.withColumn("b", b).join(highest, "b").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    rows = read.where("row is not null")
    if counted.count() <= most_pairs:
        t = known.toArrow().sort_by("pair")
        held = spark.sparkContext.broadcast(tuple(t[c].to_numpy() for c in ("pair", "n", "best")))
        return rows.drop("row").mapInArrow(_score(held), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "n")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.n").alias("times"))
    sums = each.join(known, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = rows.drop("pairs", "n").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return out.select([f.name for f in SCORED])


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
