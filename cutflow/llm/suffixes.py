"""Removal of long byte strings that stand elsewhere too, by a distributed merge sort of suffixes.

Any string of LENGTH bytes that stands at two places has the same anchor at both: the least hash of GRAM bytes among
those that start in its first WINDOW bytes. So only the suffixes that start at anchors are sorted, one in about a
hundred, and each stands for all strings that have it as their anchor. An anchor whose next PREFIX bytes stand nowhere
else is left out first: no string of it is repeated.

A task sorts the suffixes of the texts it reads, cut after what their strings need, merges equal ones, and hands each
range of them on as a front-coded run: for each suffix how many bytes it shares with the one before, and the rest. A
reading task merges its runs by a loser tree that knows of every suffix how much it shares with the last one put out,
and compares bytes only beyond that. Suffixes that share PREFIX bytes come out side by side with their common prefixes;
by those, and by what they share to the left of the anchor, the repeated strings of each are told.

Matches are exact: hashes of 64 bits choose anchors and candidates, bytes decide. Texts and suffixes are known by 128
bits of hash where results are joined back.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import join_checked, remove_staged, staged, table

LENGTH = 400  # bytes of a string
WINDOW = 256  # starts of a string among which its anchor is, a power of two
GRAM = 32  # bytes that are hashed to choose it, a power of two
SLICE = 1 << 20  # bytes that are searched for anchors at a time
RUN = 32_000_000  # bytes of suffixes that a task sorts at a time
RANGE = 32_000_000  # bytes of suffixes that a reading task merges, about
SAMPLE = 32  # suffixes for each range from which the ranges' ends are taken
SPANS = 500_000  # texts that lose something, a few numbers each, that are sent to all tasks; more are joined
FEW = 6  # suffixes whose pairs are compared one by one
BITS = 20  # of an anchor's place, its greatest and least distance from the starts of its strings, 10 bits each


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of size bytes from each place on; size is a power of two."""
    h, width = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    while width < size:
        h = h[:-width] * np.uint64((0xC2B2AE3D27D4EB4F + 2 * width) & (2**64 - 1)) + (h[width:] ^ (h[width:] >> np.uint64(29)))
        width *= 2
    h ^= h >> np.uint64(32)
    return h * np.uint64(0x165667B19E3779F9)


def anchors(data: np.ndarray, ends: np.ndarray, length: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after the other in data: an anchor's place, and the first and the last start of its strings."""
    starts = np.concatenate([[0], ends[:-1]])
    fits = ends - starts >= length
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[fits]] += 1
    edge[ends[fits] - length + 1] -= 1
    here = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    low, out = np.uint64((1 << 24) - 1), []
    for base in range(0, len(data) - length + 1, SLICE):
        h = _grams(data[base : base + SLICE + window + gram - 2], gram)
        v = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first place
        width = 1
        while width < window:
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        at = np.flatnonzero(here[base : base + len(v)])
        if not len(at):
            continue
        a = (v[at] & low).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 0) | (np.diff(at) != 1)]))
        last = np.concatenate([new[1:], [len(a)]]) - 1
        out.append((a[new] + base, at[new] + base, at[last] + base))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    a, i, j = map(np.concatenate, zip(*out, strict=True))
    # One that goes on in the next slice.
    new = np.concatenate([[True], (np.diff(a) != 0) | (i[1:] != j[:-1] + 1)])
    ends_at = np.concatenate([np.flatnonzero(new)[1:], [len(a)]]) - 1
    return a[new], i[new], j[ends_at]


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of binaries without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


LONGS, ANCHORS = pa.list_(pa.int64()), "h1 long, h2 long, at array<long>, hash array<long>, sample array<binary>"


def _find(length: int, window: int, gram: int, one_in: int):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("at", LONGS), ("hash", LONGS), ("sample", pa.list_(pa.binary()))])
    prefix = length - window + 1

    def run(batches):
        import xxhash

        for b in batches:
            offsets, data = _buffers(b.column(2))
            lo = 0
            while lo < len(b):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE)) - 1)
                part, ends = data[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo]
                a, i, j = anchors(part, ends, length, window, gram)
                row = np.searchsorted(ends, a, side="right")
                starts = np.concatenate([[0], ends])[row]
                packed = ((a - starts) << BITS) | ((a - i) << (BITS // 2)) | (a - j)
                raw = part.tobytes()
                hashes = np.array([xxhash.xxh3_64_intdigest(raw[p : p + prefix]) for p in a.tolist()], np.uint64).astype(np.int64)
                rows, first = np.unique(row, return_index=True)
                cut = [*first.tolist(), len(a)]
                sample = [[raw[p : p + prefix] for p in a[s:e][hashes[s:e] % one_in == 0].tolist()] for s, e in zip(cut, cut[1:], strict=False)]
                at = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(packed, pa.int64()))
                hashed = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(hashes, pa.int64()))
                if len(rows):
                    ids = pa.array(rows + lo, pa.int64())
                    yield pa.record_batch([b.column(0).take(ids), b.column(1).take(ids), at, hashed, pa.array(sample, pa.list_(pa.binary()))], schema=schema)
                lo = hi

    return run


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """How many bytes two strings share at their beginning; they share known at least."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8


def merge_runs(runs: list):
    """Sorted runs of (shared with the one before in its run, string, more) -> the same of all, in order.

    A loser tree. A waiting string knows how much it shares with the last one put out. Of two, the one that shares more
    comes first, and their common prefix is what the other shares; only if both share as much are bytes compared, from
    there on."""
    size = 1
    while size < len(runs):
        size *= 2
    runs = [iter(r) for r in runs] + [iter(())] * (size - len(runs))

    def play(x, y):
        if y[1] is None or x[1] is not None and x[0] > y[0]:
            return x, y
        if x[1] is None or y[0] > x[0]:
            return y, x
        n = shared(x[1], y[1], x[0])
        if x[1][n:] <= y[1][n:] if n == min(len(x[1]), len(y[1])) else x[1][n] < y[1][n]:
            y[0] = n
            return x, y
        x[0] = n
        return y, x

    def next_of(k):
        found = next(runs[k], None)
        return [0, None, None, k] if found is None else [*found, k]

    losers, front = [None] * size, [next_of(k) for k in range(size)]
    for x in front:
        x[0] = 0  # nothing was put out yet
    level, nodes = size // 2, front
    while level:
        played = [play(nodes[2 * k], nodes[2 * k + 1]) for k in range(level)]
        losers[level : 2 * level] = [p[1] for p in played]
        nodes, level = [p[0] for p in played], level // 2
    winner = nodes[0]
    while winner[1] is not None:
        yield winner[0], winner[1], winner[2]
        k = winner[3]
        winner, node = next_of(k), (size + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


HEAD = np.dtype([("shared", "<u2"), ("rest", "<u2"), ("far", "<u2"), ("near", "<u2"), ("many", "u1"), ("key", "V16")])


def encode_run(entries: list[tuple]) -> bytes:
    """Front-coded: entries of (right, left, far, near, many, key) in order of right."""
    head, rest, last = np.zeros(len(entries), HEAD), [], b""
    for k, (right, left, far, near, many, key) in enumerate(entries):
        n = shared(last, right)
        head[k] = (n, len(right) - n, far, near, many, key)
        rest += [left, right[n:]]
        last = right
    return len(entries).to_bytes(4, "little") + head.tobytes() + b"".join(rest)


def decode_run(blob: bytes):
    n = int.from_bytes(blob[:4], "little")
    head, at, last = np.frombuffer(blob, HEAD, n, 4), 4 + n * HEAD.itemsize, b""
    for same, rest, far, near, many, key in head.tolist():
        left, at = blob[at : at + far], at + far
        last, at = last[:same] + blob[at : at + rest], at + rest
        yield same, last, (left, far, near, many, bytes(key))


RUNS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("at", LONGS), ("k1", LONGS), ("k2", LONGS), ("range", pa.int32()), ("run", pa.binary())])


def _runs(length: int, cuts: list[bytes], prefix: int):
    """Rows of texts with the keys of their suffixes, and rows of runs."""

    def run(batches):
        import xxhash

        entries: dict[bytes, list] = {}
        size = 0

        def out():
            ranges: dict[int, list] = {}
            for e in sorted((right, left, far, near, many, key) for key, (right, left, far, near, many) in entries.items()):
                ranges.setdefault(bisect_right(cuts, e[0][:prefix]), []).append(e)
            entries.clear()
            for r, some in ranges.items():
                yield pa.record_batch([*(pa.nulls(1, t) for t in RUNS.types[:5]), pa.array([r], pa.int32()), pa.array([encode_run(some)], pa.binary())], schema=RUNS)

        for b in batches:
            ids, known = [b.column(0).to_pylist(), b.column(1).to_pylist()], []
            for text, places, copies in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                keys = []
                for packed in places:
                    a, far, near = packed >> BITS, packed >> (BITS // 2) & 1023, packed & 1023
                    whole = text[a - far : a + length - near]
                    key = xxhash.xxh3_128_digest(whole + (packed & (1 << BITS) - 1).to_bytes(3, "little"))
                    keys.append(key)
                    if (held := entries.get(key)) is not None:
                        held[4] = 1
                    else:
                        entries[key] = [whole[far:], whole[:far][::-1], far, near, int(copies > 1)]
                        size += len(whole)
                    if copies > 1:
                        entries[key][4] = 1
                known.append(keys)
            numbers = [np.frombuffer(b"".join(k), "<i8").reshape(-1, 2) for k in known]
            n = len(known)
            yield pa.record_batch([pa.array(ids[0], pa.int64()), pa.array(ids[1], pa.int64()), b.column(3), pa.array([x[:, 0] for x in numbers], LONGS), pa.array([x[:, 1] for x in numbers], LONGS), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=RUNS)
            if size > RUN:
                yield from out()
                size = 0
        yield from out()

    return run


def _pairs(rows: list[tuple], length: int) -> list[set]:
    """Of a few suffixes in order, the distances of their repeated strings' starts, as intervals."""
    found: list[set] = [set() for _ in rows]
    for y in range(1, len(rows)):
        right, (_, _, (left, far, near, _, _)) = length, rows[y]
        for x in range(y - 1, -1, -1):
            right = min(right, rows[x + 1][0])
            other, far_x, near_x = rows[x][2][:3]
            lo, most = max(length - right, near, near_x), min(far, far_x)
            if lo <= most:
                hi = min(shared(left, other), most)
                if lo <= hi:
                    found[x].add((lo, hi))
                    found[y].add((lo, hi))
    return found


def _many(rows: list[tuple], length: int) -> list[set]:
    """As _pairs, for any number of suffixes: two share a string that starts d bytes before the anchor if they agree in
    length - d bytes to the right and in d to the left. Both orders fall into blocks that agree, and blocks change at a
    few d only."""
    m = len(rows)
    right = np.array([length, *(r[0] for r in rows[1:])])
    lefts = [r[2][0] for r in rows]
    order = np.array(sorted(range(m), key=lefts.__getitem__))
    left = np.array([0, *(shared(lefts[p], lefts[q]) for p, q in zip(order, order[1:], strict=False))])
    far, near = np.array([r[2][1] for r in rows]), np.array([r[2][2] for r in rows])
    steps = np.unique(np.concatenate([length - right, left + 1, near, far + 1]))
    steps = steps[(steps >= near.min()) & (steps <= far.max() + 1)]
    found: list[set] = [set() for _ in rows]
    for lo, hi in zip(steps, steps[1:], strict=False):
        on = np.flatnonzero((near <= lo) & (far >= lo))
        by_left = np.empty(m, np.int64)
        by_left[order] = np.cumsum(left < lo)
        both = np.cumsum(right < length - lo)[on] * (m + 1) + by_left[on]
        _, which, n = np.unique(both, return_inverse=True, return_counts=True)
        for k in on[n[which] > 1].tolist():
            found[k].add((int(lo), int(hi) - 1))
    return found


def repeated(runs: list, length: int, prefix: int):
    """Runs -> (key, nearest, farthest start of repeated strings before the anchor), for suffixes that have such."""

    def told(group: list[tuple]):
        rows, seen, least = [], {}, length
        for n, right, more in group:
            least = min(least, n)
            if (same := seen.get(more[4])) is not None:  # the same suffix from another run
                rows[same][2][3] = 1
                continue
            seen[more[4]] = len(rows)
            rows.append((least, right, [*more]))
            least = length
        found = [set()] if len(rows) == 1 else _pairs(rows, length) if len(rows) <= FEW else _many(rows, length)
        for (_, _, (_, far, near, many, key)), own in zip(rows, found, strict=True):
            for lo, hi in [(near, far)] if many else own:
                yield key, lo, hi

    group: list[tuple] = []
    for x in merge_runs(runs):
        if group and x[0] < prefix:
            yield from told(group)
            group = []
        group.append(x)
    yield from told(group) if group else ()


def _merge(length: int, prefix: int):
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def run(group: pa.Table) -> pa.Table:
        found = [*repeated([decode_run(b) for b in group["run"].to_pylist()], length, prefix)]
        keys = np.frombuffer(b"".join(f[0] for f in found), "<i8").reshape(-1, 2)
        return pa.table([keys[:, 0], keys[:, 1], [f[1] for f in found], [f[2] for f in found]], schema=schema)

    return run


def _cut(batches):
    """doc_id, text, spans -> what is left of the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    for b in batches:
        rows = []
        for d, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
            at, removed, n, kept = 0, 0, 0, []
            for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                if lo > at or n == 0:
                    kept.append(text[at:lo])
                    n += 1
                    at = lo
                removed += max(0, hi - at)
                at = max(at, hi)
            kept = b"".join([*kept, text[at:]])
            rows.append((d, len(text), removed, n, hashlib.sha256(kept).hexdigest(), kept))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, schema, strict=True)], schema=schema)


def _merged(spans: Column) -> Column:
    """Spans in order of their starts, with those that touch made one."""

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.array_append(F.slice(out, 1, F.size(out) - 1), F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi")))
        return F.when((F.size(out) > 0) & (x["lo"] <= last["hi"]), joined).otherwise(F.array_append(out, x))

    return F.aggregate(spans, F.array().cast("array<struct<lo:bigint,hi:bigint>>"), step)


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (bytes).

    Every byte covered by a string of `length` bytes that also starts anywhere else goes. Null texts are empty, and
    texts shorter than length lose nothing; repeated rows repeat each other. window and gram are powers of two that
    together are at most length. Rows without doc_id are treated as others; an empty table gives none."""
    if window + gram > length or window >= 1024 or window & (window - 1) or gram & (gram - 1):
        raise ValueError("window (under 1024) and gram must be powers of two that together are at most length")
    spark, prefix = docs.sparkSession, length - window + 1
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.cast("binary").alias("text"))
    long = rows.where(F.octet_length("text") >= length).select("h1", "h2", "text")
    found = long.mapInArrow(_find(length, window, gram, 512), ANCHORS).groupBy("h1", "h2").agg(F.first(F.struct("at", "hash", "sample")).alias("x"), F.count("*").alias("copies"))
    found = staged(found.select("h1", "h2", "copies", "x.*"), "anchors")
    each = found.select("h1", "h2", "copies", F.explode(F.arrays_zip("at", "hash")).alias("x")).select("h1", "h2", "copies", "x.at", "x.hash")
    twice = each.groupBy("hash").agg(F.sum("copies").alias("n")).where("n > 1").select("hash")
    near = staged(each.join(staged(twice, "twice"), "hash", "left_semi").groupBy("h1", "h2").agg(F.sort_array(F.collect_list("at")).alias("at"), F.first("copies").alias("copies")), "candidates")
    size = near.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0] * (length + window // 2)
    ranges = max(1, -(-size // RANGE))
    sample = found.select(F.explode("sample").alias("s")).distinct()
    part = max(1, sample.count() // (SAMPLE * ranges))
    some = sorted(bytes(r["s"]) for r in sample.where(F.pmod(F.xxhash64("s"), F.lit(part)) == 0).collect())  # about SAMPLE for each range
    cuts = sorted({some[k * len(some) // ranges] for k in range(1, ranges)} if some else ())
    schema = "h1 long, h2 long, at array<long>, k1 array<long>, k2 array<long>, range int, run binary"
    runs = staged(long.join(near, ["h1", "h2"]).select("h1", "h2", "text", "at", "copies").mapInArrow(_runs(length, cuts, prefix), schema), "runs")
    told = runs.where("run is not null").select("range", "run").groupBy("range").applyInArrow(_merge(length, prefix), "k1 long, k2 long, lo int, hi int")
    told = staged(told, "repeated")
    at = runs.where("run is null").select("h1", "h2", F.explode(F.arrays_zip("at", "k1", "k2")).alias("x")).select("h1", "h2", "x.*")
    place = F.shiftright("at", BITS)
    spans = at.join(told, ["k1", "k2"]).select("h1", "h2", F.struct((place - F.col("hi")).alias("lo"), (place - F.col("lo") + length).alias("hi")).alias("span"))
    spans = staged(spans.groupBy("h1", "h2").agg(_merged(F.array_sort(F.collect_set("span"))).alias("spans")), "spans")
    for t in (found, near, runs, told):
        remove_staged(t)
    return join_checked(rows, spans, ["h1", "h2"], "left", SPANS).select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
