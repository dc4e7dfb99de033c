"""Document scoring by a hierarchical Pitman-Yor language model.

Words are dishes. The restaurant of a context, the word before, gets its customers from the training text; its tables are
customers of the restaurant of the shorter context, which is the one root restaurant over a uniform base. Seatings are
sampled by blocked Gibbs sweeps: all customers of a word in a restaurant leave and are seated again one after the other,
at an old or a new table, by what the rest of the hierarchy predicts. Predictive probabilities are averaged over the last
sweeps.

Texts are split into words once; what follows reads packed numbers. A bucket is a task's share of the contexts, and has
all pairs (context, word) of them. A shard is a task's share of the words at the root; there are fewer of those. In a
round, buckets send to shards how many tables serve each word, shards seat the root's customers and send back customers
and tables, and buckets seat theirs. A context that makes up more than HOT_SHARE of the tokens is dealt over all buckets
by word: there are fewer than 1 / HOT_SHARE of those, so buckets exchange their totals through the driver. Scores of a
pair that makes up as much are broadcast and its tokens don't travel; all other tokens travel to their pair's bucket, and
sums by document come back.
"""

from __future__ import annotations

import gc
import json
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import remove_staged, staged, table

HOT_SHARE = 1 / 2048
BUCKET = 2_000_000  # tokens
PER_SHARD = 4  # buckets for each shard
SENT = 4_000_000  # bytes of packed tokens that a task hands to Spark at a time, about
PART = 5_000_000  # tokens of documents that are kept together, about
SORT = 1_000_000  # tokens that are sorted at a time, to hold less
ROUNDS, SAMPLES = 3, 4  # sweeps with an exchange before each, and sweeps whose probabilities are averaged
STRENGTH = (1.0, 1.0, 1.0)  # of the root, of classes (see Seating), and of contexts
EXACT = 64  # customers of a word seated one by one; later ones in blocks that double

END = b" "  # no word: words hold no space


def pack(*arrays: np.ndarray) -> bytes:
    """Flat arrays, compressed; the first bytes of all numbers, then the second ones, and so on, as these are alike."""
    head = json.dumps([(a.dtype.str, len(a)) for a in arrays]).encode()
    to = zstandard.ZstdCompressor(level=3).compressobj()
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1)[:, k] for a in arrays if len(a) for k in range(a.itemsize))
    return b"".join([len(head).to_bytes(4, "little"), head, *(to.compress(p.tobytes()) for p in planes), to.flush()])


def unpack(data: bytes) -> list[np.ndarray]:
    at, out = 4 + int.from_bytes(data[:4], "little"), []
    raw, lo = zstandard.ZstdDecompressor().decompressobj().decompress(data[at:]), 0
    for kind, n in json.loads(data[4:at]):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, lo).reshape(size, n).T).view(kind).ravel() if n else np.zeros(0, kind))
        lo += n * size
    return [a if a.flags.writeable else a.copy() for a in out]


def counted(a: np.ndarray, n: int) -> np.ndarray:
    """How often each number below n occurs."""
    total = np.zeros(n, np.int64)
    for lo in range(0, len(a), SORT):
        total += np.bincount(a[lo : lo + SORT], minlength=n)
    return total


def narrow(a: np.ndarray) -> np.ndarray:
    """Numbers from 0 in as few bytes as hold them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


# ---- tokens


TOKENS = "part long, packed binary, n long, train long, often array<struct<u:bigint,w:bigint,n:bigint>>"


def contexts(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The word before each of the words of documents one after the other; the end, which is 0, before the first ones."""
    before = np.roll(words, 1)
    before[np.cumsum(sizes) - sizes] = 0
    return before


def _tokenize(batches):
    """text, held, id, salt -> rows of TOKENS. packed: id, salt, held and number of tokens of each document, hashes of
    the distinct words (A-Z lower-cased, split at ASCII white space; first the end), and the tokens as places there.
    often: contexts (w null) and pairs with a quarter of HOT_SHARE of these tokens."""

    def out(rows, each, index):
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index))
        sizes, words = np.array([len(x) for x in each], np.int32), np.concatenate(each)
        each.clear()
        before, least = contexts(words, sizes), HOT_SHARE / 4 * len(words)
        held, ids, salts = (rows.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        n = counted(before, len(hashes))
        some, name = np.flatnonzero(n >= least), hashes.view(np.int64)
        often = [{"u": int(name[u]), "w": None, "n": int(n[u])} for u in some]
        also = (n >= least)[before] & (counted(words, len(hashes)) >= least)[words]
        pairs, m = np.unique(before[also].astype(np.int64) * len(hashes) + words[also], return_counts=True)
        often += [{"u": int(name[x // len(hashes)]), "w": int(name[x % len(hashes)]), "n": int(k)} for x, k in zip(pairs, m, strict=True) if k >= least]
        packed = pack(ids, salts, held, sizes, hashes, words)
        part = xxhash.xxh3_64_intdigest(pack(ids, salts)) >> 1
        return pa.record_batch([pa.array([part]), pa.array([packed], pa.binary()), pa.array([len(words)]), pa.array([int(sizes[~held].sum())]), pa.array([often], SOME)], ["part", "packed", "n", "train", "often"])

    def fresh():
        index: dict[bytes, int] = defaultdict()
        index.default_factory = index.__len__
        index[END]
        return index

    for b in batches:
        index, each, size, lo = fresh(), [], 0, 0
        texts = b.column(0).cast(pa.binary())
        for k in range(b.num_rows):
            words = (texts[k].as_py() or b"").lower().split()
            words.append(END)
            each.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
            size += len(words)
            if size >= PART or k == b.num_rows - 1:
                yield out(b.slice(lo, k + 1 - lo), each, index)
                index, each, size, lo = fresh(), [], 0, k + 1


SOME = pa.list_(pa.struct([("u", pa.int64()), ("w", pa.int64()), ("n", pa.int64())]))


def grouped(keys: np.ndarray, order: np.ndarray):
    """Each key that occurs, with the places that have it; order sorts keys."""
    at = keys[order]
    cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1), len(at)] if len(at) else [0]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield int(at[lo]), order[lo:hi]


def share(hashes: np.ndarray, n: int) -> np.ndarray:
    """Of n buckets or shards, the one of each hash."""
    return ((hashes * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % np.uint64(n)).astype(np.int32)


def mixed(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes."""
    return (u * np.uint64(0x9E3779B97F4A7C15) ^ w) * np.uint64(0xBF58476D1CE4E5B9)


class Hot(NamedTuple):
    """Hashes of the frequent contexts, and of the frequent pairs, both sorted."""

    contexts: np.ndarray
    pairs: np.ndarray


def among(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is among sorted ones, and its place there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


def hot_tokens(hot: Hot, hashes: np.ndarray, before: np.ndarray, words: np.ndarray):
    """Places of the tokens of frequent contexts, their pairs' hashes, which of them are frequent pairs, and of those
    the places in hot.pairs."""
    at = np.flatnonzero(among(hot.contexts, hashes)[0][before])
    pair = mixed(hashes[before[at]], hashes[words[at]])
    is_hot, place = among(hot.pairs, pair)
    return at, pair, is_hot, place[is_hot]


def _deal(hot: Hot, buckets: int):
    """Tokens, packed by bucket of their context: a row (bucket, part, packed) for each part and bucket. packed: row and
    pair of each token, distinct hashes of words, both words of a pair; and frequent pairs with their training counts."""

    def run(batches):
        for b in batches:
            for part, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, _, held, sizes, hashes, words = unpack(packed)
                row, before = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), contexts(words, sizes)
                bucket = share(hashes, buckets)[before]
                at, pair, is_hot, place = hot_tokens(hot, hashes, before, words)
                bucket[at] = share(pair, buckets)
                often = at[is_hot]
                more: dict[int, list] = defaultdict(list)
                first, n = np.full(len(hot.pairs), -1), np.bincount(place, weights=~held[row[often]], minlength=len(hot.pairs)).astype(np.int64)
                first[place] = often
                for k in np.flatnonzero(first >= 0):
                    f = first[k]
                    more[int(bucket[f])].append((hashes[before[f]], hashes[words[f]], np.uint64(n[k])))
                bucket[often] = buckets  # these don't travel
                del at, pair, is_hot, place, often, first
                out: list[list] = [[], []]
                seen = set()
                for k, o in grouped(bucket, np.argsort(bucket.astype(np.int16) if buckets < 32_000 else bucket, kind="stable")):
                    if k == buckets:
                        continue
                    seen.add(k)
                    w, at_w = np.unique(np.concatenate([before[o], words[o]]), return_inverse=True)
                    at_w = at_w.astype(np.int32)
                    out[0].append(k)
                    out[1].append(pack(narrow(row[o]), ~held[row[o]], hashes[w], narrow(at_w[: len(o)]), narrow(at_w[len(o) :]), np.array(more.get(k, []), np.uint64).ravel()))
                    if sum(map(len, out[1])) >= SENT:
                        yield sent(part, *out)
                        out = [[], []]
                none = np.zeros(0, np.int32)
                for k in more.keys() - seen:
                    out[0].append(k)
                    out[1].append(pack(none, none.astype(bool), none.astype(np.uint64), none, none, np.array(more[k], np.uint64).ravel()))
                yield sent(part, *out)

    def sent(part: int, bucket: list, packed: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(bucket, pa.int32()), pa.array([part] * len(bucket), pa.int64()), pa.array(packed, pa.binary())], ["bucket", "part", "packed"])

    return run


SENDS = "sends array<struct<shard:int,c:binary>>, totals array<double>"
_SENDS = pa.list_(pa.struct([("shard", pa.int32()), ("c", pa.binary())]))


def sends(sums: np.ndarray, cuts: np.ndarray) -> list[dict]:
    """What a bucket has for each shard, of numbers of its words, which are in order of their shards."""
    return [{"shard": k, "c": pack(sums[lo:hi])} for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if hi > lo]


def _gather(hot: Hot, shards: int):
    """A bucket's rows -> one row. occurrences: parts, tokens of each, row of every token and step from pair to pair; words: by shard;
    pairs: of each context their number, words, counts, and places of frequent contexts and pairs; and a first seating."""
    schema = pa.schema([("bucket", pa.int32()), ("occurrences", pa.binary()), ("words", _SENDS), ("pairs", pa.binary()), ("tables", pa.binary()), ("sends", _SENDS), ("totals", pa.list_(pa.float64()))])

    def run(group: pa.Table) -> pa.Table:
        parts = np.array(group.column("part").to_pylist(), np.int64)
        found = [unpack(x.as_py()) for x in group.column("packed")]
        n, more = np.cumsum([0, *[len(x[2]) for x in found]]), np.concatenate([x[5] for x in found]).reshape(-1, 3)
        names = np.concatenate([*[x[2] for x in found], more[:, :2].ravel()])
        every = np.unique(names)
        every = every[np.argsort(share(every, shards), kind="stable")]  # by shard, then by hash
        by_hash = np.argsort(every)
        at = by_hash[np.searchsorted(every[by_hash], names)].astype(np.int32)
        del names
        context, word = (np.concatenate([*[at[x[k] + n[i]] for i, x in enumerate(found)], at[n[-1] + k - 3 :: 2]]) for k in (3, 4))
        row, train, sizes = np.concatenate([x[0] for x in found]), np.concatenate([*[x[1] for x in found], more[:, 2].astype(float)]), np.array([len(x[0]) for x in found], np.int64)
        del found, at
        occ, pairs, counts, met = np.zeros(len(context), np.int32), [], [], 0
        filled = np.cumsum(np.bincount(context, minlength=len(every)))
        for lo, hi in zip(range(0, len(context), SORT), range(SORT, len(context) + SORT, SORT), strict=True):  # contexts whose tokens end there
            o = np.flatnonzero((filled[context] > lo) & (filled[context] <= hi))
            pair, which = np.unique(context[o].astype(np.int64) * len(every) + word[o], return_inverse=True)
            occ[o] = which + met
            pairs.append(pair)
            counts.append(np.bincount(which, weights=train[o], minlength=len(pair)).astype(np.int32))
            met += len(pair)
        occ, pair, count = occ[: len(row)], np.concatenate(pairs), np.concatenate(counts)
        del context, word, train, pairs, counts
        # A part's tokens in order of their pairs, of which the steps are small.
        for lo, hi in zip(cuts := np.cumsum([0, *sizes]), cuts[1:], strict=False):
            o = lo + np.argsort(occ[lo:hi])
            row[lo:hi], occ[lo:hi] = row[o], np.diff(occ[o], prepend=np.int32(0))
        u, w = (pair // len(every)).astype(np.int32), (pair % len(every)).astype(np.int32)
        del pair
        distinct, per = np.unique(u, return_counts=True)
        is_hot, place = among(hot.contexts, every[distinct])
        shared = np.flatnonzero(is_hot)
        often = np.flatnonzero(np.isin(u, distinct[shared]))
        found_pair, which = among(hot.pairs, mixed(every[u[often]], every[w[often]]))
        static = pack(per.astype(np.int32), w, count, shared, place[shared], often[found_pair], which[found_pair])
        cuts = np.searchsorted(share(every, shards), np.arange(shards + 1))
        used = np.bincount(w, weights=count, minlength=len(every)).astype(np.int64)
        words = [{"shard": k, "c": pack(every[lo:hi], used[lo:hi])} for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if hi > lo]
        leaves = Leaves(static, (count > 0).astype(np.int32), None)
        row = {"bucket": group.column("bucket")[0].as_py(), "occurrences": pack(parts, sizes, narrow(row), narrow(occ)), "words": words, "pairs": static, "tables": pack(cuts, leaves.fine), "sends": sends(leaves.sums(len(every)), cuts), "totals": leaves.totals(len(hot.contexts))}
        return pa.Table.from_pylist([row], schema=schema)

    return run


# ---- the model


def seat(c: np.ndarray, a: np.ndarray, d: float, rng) -> np.ndarray:
    """Tables after c customers of a word sit down, where a new table has weight a and an old one its customers less d."""
    order = np.argsort(-c, kind="stable")
    c, a = c[order].astype(np.int64), a[order]
    t = (c > 0).astype(np.float64)
    i = 1
    while len(c) and i < c[0]:
        m = np.searchsorted(-c, -i, side="left")  # customers that are left: c > i
        if i < EXACT:
            t[:m] += rng.random(m) < a[:m] / (a[:m] + i - d * t[:m])
            i += 1
        else:
            n = np.minimum(c[:m], 2 * i) - i
            t[:m] += rng.binomial(n, np.clip(a[:m] / (a[:m] + i + n / 2 - d * t[:m]), 0, 1))
            i *= 2
    out = np.empty_like(t)
    out[order] = t
    return out


class Root(NamedTuple):
    """What all tasks know of the root restaurant."""

    customers: float
    tables: float
    words: float  # distinct ones in training
    discounts: tuple[float, float]  # of the root and of contexts

    def probability(self, c: np.ndarray, t: np.ndarray, less=0) -> np.ndarray:
        """Of words with c customers and t tables at the root, when some of the customers are left out."""
        d, rest = self.discounts[0], c - less
        return (np.maximum(rest - d * np.minimum(t, rest), 0) + (STRENGTH[0] + d * self.tables) / (self.words + 1)) / (STRENGTH[0] + self.customers)

    def seat(self, c: np.ndarray, rng) -> np.ndarray:
        """Tables of words with c customers."""
        t, many = (c > 0).astype(np.int64), np.flatnonzero(c > 1)
        t[many] = seat(c[many], np.full(len(many), (STRENGTH[0] + self.discounts[0] * self.tables) / (self.words + 1)), self.discounts[0], rng)
        return t


def discount(ones: float, twos: float) -> float:
    return min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5


class Leaves:
    """The restaurants of a bucket's contexts: customers (count) and tables (fine) of each pair. totals: customers and
    tables of the frequent contexts in all buckets, at the beginning."""

    def __init__(self, static: bytes, fine: np.ndarray, totals: np.ndarray | None):
        per, self.word, self.count, self.shared, self.place, self.often, self.which = unpack(static)
        self.n, self.fine = len(per), fine.astype(np.int32)
        self.context = np.repeat(np.arange(self.n, dtype=np.int32), per)
        self.many = np.flatnonzero(self.count > 1)  # others have as many tables as customers
        self.customers = np.bincount(self.context, weights=self.count, minlength=self.n)
        self.others = np.zeros(self.n)
        if totals is not None:
            self.others[self.shared] = totals[1][self.place] - self.tables()[self.shared]
            self.customers[self.shared] = totals[0][self.place]

    def tables(self) -> np.ndarray:
        return np.bincount(self.context, weights=self.fine, minlength=self.n) + self.others

    def sums(self, words: int) -> np.ndarray:
        """Tables that serve each word; these are customers of the root."""
        return np.bincount(self.word, weights=self.fine, minlength=words).astype(np.int32)

    def totals(self, hot: int) -> list[float]:
        """Pairs of one and of two customers, root customers, customers and tables of frequent contexts."""
        tables, both = self.tables() - self.others, np.zeros((2, hot))
        both[0][self.place] = np.bincount(self.context, weights=self.count, minlength=self.n)[self.shared]
        both[1][self.place] = tables[self.shared]
        return [float((self.count == 1).sum()), float((self.count == 2).sum()), float(tables.sum()), *both.ravel().tolist()]

    def sweep(self, root: Root, c: np.ndarray, t: np.ndarray, rng, at: np.ndarray | None = None) -> None:
        """Seats the customers of all pairs (or of those at some places) anew; c and t are the root's. Its prediction
        leaves out what the restaurant itself has sent there."""
        at = self.many if at is None else at
        d, fine, word = root.discounts[1], self.fine[at], self.word[at]
        weight = (STRENGTH[2] + d * np.maximum(self.tables()[self.context[at]] - fine, 0)) * root.probability(c[word], t[word], fine)
        self.fine[at] = seat(self.count[at], weight, d, rng)

    def probabilities(self, root: Root, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Predictive probability of each pair."""
        d, h = root.discounts[1], STRENGTH[2]
        first, back = 1 / (h + self.customers), (h + d * self.tables()) / (h + self.customers)
        return np.maximum(self.count - d * self.fine, 0) * first[self.context] + back[self.context] * root.probability(c, t)[self.word]


def _meet(group: pa.Table) -> pa.Table:
    """A shard's words from all buckets -> one row: buckets, words of each, place of every one among the shard's distinct
    words, and their training counts."""
    buckets = np.array(group.column("bucket").to_pylist(), np.int32)
    found = [unpack(x) for x in group.column("c").to_pylist()]
    every, at = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
    used = np.bincount(at, weights=np.concatenate([x[1] for x in found])).astype(np.int64)
    known = pack(buckets, np.array([len(x[0]) for x in found], np.int32), at.astype(np.int32), used)
    return pa.table({"shard": group.column("shard")[:1], "known": pa.array([known], pa.binary()), "words": pa.array([float((used > 0).sum())])})


def _root(step: int, root: Root | None, counts: bool):
    """A shard's row of _meet and what the buckets sent -> for each bucket customers and tables of its words, and, if asked
    for, their training counts; and the root's tables, and words of one and of two customers."""

    def run(group: pa.Table) -> pa.Table:
        shard, known, c = (group.column(k).to_pylist() for k in ("shard", "known", "c"))
        buckets, sizes, at, used = unpack(next(x for x in known if x is not None))
        sent = {b: unpack(x)[0] for b, x in zip(group.column("bucket").to_pylist(), c, strict=True) if x is not None}
        total = np.bincount(at, weights=np.concatenate([sent[b] for b in buckets.tolist()]), minlength=len(used)).astype(np.int64)
        tables = root.seat(total, np.random.default_rng([step, shard[0]])) if root else (total > 0).astype(np.int64)
        cuts = np.cumsum([0, *sizes])
        each = [total.astype(np.int32), tables.astype(np.int32)] + [used.astype(np.int32)] * counts
        packed = [pack(*[x[at[lo:hi]] for x in each]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        stats = [[float(tables.sum()), float((total == 1).sum()), float((total == 2).sum())], *[[0.0] * 3] * (len(packed) - 1)]
        return pa.table({"bucket": pa.array(buckets), "shard": pa.array(shard[:1] * len(packed), pa.int32()), "back": pa.array(packed, pa.binary()), "stats": pa.array(stats, pa.list_(pa.float64()))})

    return run


def _bucket(group: pa.Table, totals: np.ndarray):
    """Of a bucket's rows: its number, restaurants, the cuts of its words by shard, and what the root sent for its words."""
    column = lambda k: [x for x in group.column(k).to_pylist() if x is not None]
    cuts, fine = unpack(column("tables")[0])
    back = sorted((s, x) for s, x in zip(group.column("shard").to_pylist(), group.column("back").to_pylist(), strict=True) if x is not None)
    sent = [np.concatenate(x) for x in zip(*(unpack(x) for _, x in back), strict=True)]
    return group.column("bucket")[0].as_py(), Leaves(column("pairs")[0], fine, totals), cuts, sent


def _sweep(step: int, root: Root, totals: np.ndarray, last: bool):
    """A bucket's rows -> its tables after a sweep; after the last one, the scores of frequent pairs too."""
    schema = pa.schema([("bucket", pa.int32()), ("tables", pa.binary()), ("sends", _SENDS), ("totals", pa.list_(pa.float64())), ("hot", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        bucket, leaves, cuts, (c, t, *used) = _bucket(group, totals)
        rng, hot = np.random.default_rng([step, bucket, 1]), None
        leaves.sweep(root, c, t, rng)
        row = {"bucket": bucket, "tables": pack(cuts, leaves.fine.astype(np.int32)), "sends": sends(leaves.sums(len(c)), cuts), "totals": leaves.totals(totals.shape[1])}
        if last and len(leaves.often):
            at, total = leaves.often, 0.0
            for _ in range(SAMPLES):
                leaves.sweep(root, c, t, rng, at[leaves.count[at] > 1])
                total = total + leaves.probabilities(root, c, t)[at]
            hot = pack(leaves.which, np.log10(total / SAMPLES), used[0][leaves.word[at]])
        return pa.Table.from_pylist([row | {"hot": hot}], schema=schema)

    return run


def _scores(step: int, root: Root, totals: np.ndarray):
    """A bucket's rows -> for each part (part, packed): rows, and sums over their tokens of known words, base and score."""

    def run(group: pa.Table) -> pa.Table:
        bucket, leaves, _, (c, t, used) = _bucket(group, totals)
        rng, total = np.random.default_rng([step, bucket, 1]), np.zeros(len(leaves.word))
        for _ in range(SAMPLES):
            leaves.sweep(root, c, t, rng)
            total += leaves.probabilities(root, c, t)
        parts, sizes, row, pair = unpack(next(x for x in group.column("occurrences").to_pylist() if x is not None))
        each, cuts, packed = [(used > 0)[leaves.word], np.log10(used + 1.0)[leaves.word], np.log10(total / SAMPLES)], np.cumsum([0, *sizes]), []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            r, at = np.unique(row[lo:hi], return_inverse=True)
            p = np.cumsum(pair[lo:hi], dtype=np.int64)
            packed.append(pack(r, *[np.bincount(at, weights=x[p], minlength=len(r)).astype(k) for x, k in zip(each, (np.int32, float, float), strict=True)]))
        return pa.table({"part": pa.array(parts), "packed": pa.array(packed, pa.binary())})

    return run


#: Of the rows that documents' scores are summed from.
PARTS = "id long, salt long, m long, n_tokens long, n_known long, base double, score double"


def _documents(hot: Hot, logs):
    """Of each part, its documents with the sums over their tokens of frequent pairs. logs: broadcast, score and training
    count of the word of each frequent pair."""

    def run(batches):
        for b in batches:
            for part, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, salts, _, sizes, hashes, words = unpack(packed)
                at, _, is_hot, place = hot_tokens(hot, hashes, contexts(words, sizes), words)
                row = np.searchsorted(np.cumsum(sizes), at[is_hot], side="right")
                score, used = logs.value
                sums = [np.bincount(row, weights=x[place], minlength=len(ids)).astype(float) for x in (used > 0, np.log10(used + 1.0), score)]
                yield pa.record_batch([pa.array([part]), pa.array([pack(ids, salts, sizes, *sums)], pa.binary())], ["part", "documents"])

    return run


def _part_sums(group: pa.Table) -> pa.Table:
    """A part's documents and the sums from all buckets -> rows of PARTS. Parts of equal documents are one."""
    documents = [unpack(x) for x in group.column("documents").to_pylist() if x is not None]
    ids, salts, sizes, _, _, _ = documents[0]
    known, base, score = (sum(x[k] for x in documents) for k in (3, 4, 5))
    for x in group.column("packed").to_pylist():
        if x is not None:
            row, *more = unpack(x)
            known[row] += more[0]
            base[row] += more[1]
            score[row] += more[2]
    m = np.full(len(ids), len(documents), np.int64)
    return pa.table([ids, salts, m, sizes.astype(np.int64) * len(documents), known.astype(np.int64), base, score], names=[x.split()[0] for x in PARTS.split(", ")])


def held_out(doc_id) -> F.Column:
    """Rows whose crc32(doc_id as text) mod 7 is 2; never learnt from. A null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _forget(spark: SparkSession) -> None:
    """Spark deletes what it has shuffled for tables that are gone when the driver collects its garbage: so that this
    isn't kept till the end."""
    gc.collect()
    spark._jvm.System.gc()


def _sum(df: DataFrame, column: str) -> np.ndarray:
    """The sums of arrays of as many numbers."""
    found = df.select(F.posexplode(column).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    return np.array([r["v"] for r in found])


def score_documents(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    score is the model's log10 probability of the text; perplexity is 10 ** (-score / n_tokens). Null and blank texts
    have one token, their end. An empty table gives an empty one. Rows with equal doc_id and text get one score each;
    rows without doc_id are learnt from and scored, told apart by two hashes of their texts. Other columns are ignored."""
    spark = docs.sparkSession
    rows = docs.select("text", held_out(F.col("doc_id")).alias("held"), F.coalesce("doc_id", F.xxhash64("text")).cast("long").alias("id"), (F.hash("text").cast("long") * 2 + F.col("doc_id").isNull().cast("long")).alias("salt"))
    tokens = staged(rows.mapInArrow(_tokenize, TOKENS), "tokens", "none")  # what is packed is compressed
    n, train = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("train"), F.lit(0))).first()
    often = tokens.select(F.explode("often").alias("x")).groupBy("x.u", "x.w").agg(F.sum("x.n").alias("n")).where(F.col("n") >= HOT_SHARE * n).collect()
    key = lambda k, some: np.array([r[k] for r in some], np.int64).view(np.uint64)
    pairs = [r for r in often if r["w"] is not None]
    hot = Hot(np.sort(key("u", [r for r in often if r["w"] is None])), np.sort(mixed(key("u", pairs), key("w", pairs))))
    buckets = 1 + (n - sum(r["n"] for r in pairs)) // bucket
    n_shards = 1 + buckets // PER_SHARD

    dealt = tokens.select("part", "packed").mapInArrow(_deal(hot, buckets), "bucket int, part long, packed binary")
    state = staged(dealt.groupBy("bucket").applyInArrow(_gather(hot, n_shards), f"bucket int, occurrences binary, words array<struct<shard:int,c:binary>>, pairs binary, tables binary, {SENDS}"), "buckets", "none")
    del dealt
    tables, root = state.select("bucket", "tables", "sends", "totals"), None
    sums = _sum(tables, "totals") if n else np.zeros(3)
    _forget(spark)  # of the tokens dealt; right after they are gathered Spark still holds that plan
    out = lambda df, column: df.select("bucket", F.explode(column).alias("x")).select("bucket", "x.shard", "x.c")
    shards = staged(out(state, "words").groupBy("shard").applyInArrow(_meet, "shard int, known binary, words double"), "shards", "none")
    words = shards.agg(F.coalesce(F.sum("words"), F.lit(0.0))).first()[0]

    for step in range(ROUNDS + 1):
        met = shards.select("shard", "known").unionByName(out(tables, "sends"), allowMissingColumns=True)
        back = staged(met.groupBy("shard").applyInArrow(_root(step, root, step >= ROUNDS - 1), "bucket int, shard int, back binary, stats array<double>"), "root", "none")
        stats = _sum(back, "stats") if n else np.zeros(3)
        root = Root(float(sums[2]), float(stats[0]), words, root.discounts if root else (discount(*stats[1:]), discount(*sums[:2])))
        both = sums[3:].reshape(2, -1)
        needed = state.select("bucket", "pairs", *["occurrences"] * (step == ROUNDS)).unionByName(tables.select("bucket", "tables"), allowMissingColumns=True).unionByName(back.drop("stats"), allowMissingColumns=True).groupBy("bucket")
        if step < ROUNDS:
            before, tables = tables, staged(needed.applyInArrow(_sweep(step, root, both, step == ROUNDS - 1), f"bucket int, tables binary, {SENDS}, hot binary"), "tables", "none")
            sums = _sum(tables, "totals") if n else sums
            for t in [back] + [before] * (step > 0):
                remove_staged(t)
            del needed, met, back, before
            _forget(spark)

    scored = needed.applyInArrow(_scores(ROUNDS, root, both), "part long, packed binary")
    score, used = np.zeros(len(hot.pairs)), np.zeros(len(hot.pairs), np.int64)
    for r in tables.where("hot is not null").select("hot").collect():
        at, x, k = unpack(r["hot"])
        score[at], used[at] = x, k
    logs = spark.sparkContext.broadcast((score, used))
    found = tokens.select("part", "packed").mapInArrow(_documents(hot, logs), "part long, documents binary")
    parts = found.unionByName(scored, allowMissingColumns=True).groupBy("part").applyInArrow(_part_sums, PARTS)
    sums = parts.groupBy("id", "salt").agg(*[F.sum(x).alias(x) for x in ("m", "n_tokens", "n_known", "base", "score")])
    per = lambda x: F.col(x) / F.col("m")  # noqa: E731  equal rows have been summed
    doc_id = F.when(F.col("salt") % 2 == 0, F.col("id"))
    unseen = F.log10(F.lit(float(train)) + words + 1)
    out = sums.select(
        doc_id.alias("doc_id"),
        held_out(doc_id).alias("held_out"),
        per("n_tokens").cast("long").alias("n_tokens"),
        per("n_known").cast("long").alias("n_known"),
        F.lit(train).cast("long").alias("train_tokens"),
        (per("base") - per("n_tokens") * unseen).alias("base_score"),
        per("score").alias("score"),
        "m",
    )
    return out.withColumn("m", F.explode(F.array_repeat(F.lit(1), F.col("m").cast("int")))).drop("m")


def op3_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


# ---- the same sampler for a fixed set of classes of contexts, whose seatings fit a task; the query doesn't use it

CONTEXTS = 512
COARSE = 16  # their parents
LAYOUT = {"tables": CONTEXTS, "customers": CONTEXTS, "coarse_tables": COARSE, "root_tables": 1, "words": 1, "ones": 1, "twos": 1}


class Totals:
    """What restaurants know of each other: a number or two for each."""

    def __init__(self, vector: np.ndarray, discounts=None):
        at = 0
        for name, n in LAYOUT.items():
            setattr(self, name, vector[at : at + n] if n > 1 else float(vector[at]))
            at += n
        self.coarse_customers = self.tables.reshape(COARSE, -1).sum(1)
        self.root_customers = float(self.coarse_tables.sum())
        d = self.ones / (self.ones + 2 * self.twos) if self.ones else 0.5
        self.discounts = discounts or (0.5, 0.7, min(max(d, 0.1), 0.95))


class Seating:
    """The customers and tables of some words in all restaurants. word, context, count: of pairs, sorted."""

    def __init__(self, word: np.ndarray, context: np.ndarray, count: np.ndarray):
        self.word, self.context, self.count = word.astype(np.int64), context.astype(np.int64), count
        self.n = int(self.word[-1]) + 1 if len(word) else 0
        key, self.up = np.unique(self.word * COARSE + self.context // (CONTEXTS // COARSE), return_inverse=True)
        self.mid_word, self.mid = key // COARSE, key % COARSE
        self.fine = (count > 0).astype(float)
        self._lift(lambda c, *_: (c > 0).astype(float))

    def _lift(self, tables) -> None:
        self.mid_c = np.bincount(self.up, weights=self.fine, minlength=len(self.mid))
        self.mid_t = tables(self.mid_c, 1)
        self.root_c = np.bincount(self.mid_word, weights=self.mid_t, minlength=self.n)
        self.root_t = tables(self.root_c, 0)

    def probabilities(self, s: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predictive probabilities of each word at the root, and of each pair in its coarse and fine restaurant."""
        d, h = s.discounts, STRENGTH
        root = (np.maximum(self.root_c - d[0] * self.root_t, 0) + (h[0] + d[0] * s.root_tables) / (s.words + 1)) / (h[0] + s.root_customers)
        mid = (np.maximum(self.mid_c - d[1] * self.mid_t, 0) + (h[1] + d[1] * s.coarse_tables[self.mid]) * root[self.mid_word]) / (h[1] + s.coarse_customers[self.mid])
        fine = (np.maximum(self.count - d[2] * self.fine, 0) + (h[2] + d[2] * s.tables[self.context]) * mid[self.up]) / (h[2] + s.customers[self.context])
        return root, mid, fine

    def sweep(self, s: Totals, rng) -> None:
        """Seats the customers of every word anew, restaurant by restaurant from the leaves to the root. A parent's
        prediction leaves out what the restaurant itself has sent there."""
        d, h = s.discounts, STRENGTH
        root, _, _ = self.probabilities(s)
        others = self.mid_c[self.up] - self.fine
        mid = (np.maximum(others - d[1] * np.minimum(self.mid_t[self.up], others), 0) + (h[1] + d[1] * s.coarse_tables[self.mid[self.up]]) * root[self.word]) / (h[1] + s.coarse_customers[self.mid[self.up]])
        self.fine = seat(self.count, (h[2] + d[2] * np.maximum(s.tables[self.context] - self.fine, 0)) * mid, d[2], rng)

        def tables(c: np.ndarray, level: int) -> np.ndarray:
            if level == 0:
                return seat(c, np.full(len(c), (h[0] + d[0] * s.root_tables) / (s.words + 1)), d[0], rng)
            rest = self.root_c[self.mid_word] - self.mid_t
            base = (np.maximum(rest - d[0] * np.minimum(self.root_t[self.mid_word], rest), 0) + (h[0] + d[0] * s.root_tables) / (s.words + 1)) / (h[0] + s.root_customers)
            return seat(c, (h[1] + d[1] * np.maximum(s.coarse_tables[self.mid] - self.mid_t, 0)) * base, d[1], rng)

        self._lift(tables)

    def totals(self) -> np.ndarray:
        per_word = np.bincount(self.word, weights=self.count, minlength=self.n)
        return np.concatenate([
            np.bincount(self.context, weights=self.fine, minlength=CONTEXTS),
            np.bincount(self.context, weights=self.count, minlength=CONTEXTS),
            np.bincount(self.mid, weights=self.mid_t, minlength=COARSE),
            [self.root_t.sum(), (per_word > 0).sum(), (self.count == 1).sum(), (self.count == 2).sum()],
        ])

    def run(self, history: list[Totals], seed: int):
        """The chain's sweeps so far, one for the totals of each round; gives the random numbers to go on with."""
        rng = np.random.default_rng(seed)
        for s in history:
            self.sweep(s, rng)
        return rng

    def averaged(self, history: list[Totals], seed: int) -> np.ndarray:
        """log10 of each pair's predictive probability, averaged over SAMPLES sweeps after those of history."""
        rng, s, total = self.run(history[:-1], seed), history[-1], np.zeros(len(self.word))
        for _ in range(SAMPLES):
            self.sweep(s, rng)
            total += self.probabilities(s)[2]
        return np.log10(total / SAMPLES)
