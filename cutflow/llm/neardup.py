"""Near-duplicate documents by bottom-k sketches of one hash function.

Every document's distinct shingles are hashed once; its k smallest hashes are its sketch. Inverted lists over the
retained values give candidates, a union-sketch estimate filters them, and the full sets confirm every link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from .common import join_checked, parts_for, staged, table
from .components import connected_components

K = 48  # retained values per document
SHARED = 24  # of K: a pair at Jaccard 0.8 shares fewer with probability 7.8e-7
SHORT = 30  # sets below this size are retained whole, and the needed overlap is exact
LIST = 32  # lists up to this length give all their pairs; the members of longer ones are joined by their whole sets
WORDS = 32  # of parity bits: a power of two
HOT = 512  # rows of a value that meet in one task at most; those of a more frequent one are dealt into blocks
BEFORE = 24  # values before a place that are looked at, so that a pair comes out once
ROWS = 1000  # texts that a worker holds shingles of at a time
BITS = 23  # log2 of the bits of the candidate filter that is broadcast: 1 MB, whatever the input

_cache: dict[bytes, int] = {}


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the shingles of a text (A-Z lower-cased).

    A text with fewer than `size` words has one shingle, the whole sequence; one without words has none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # splits at space, \t, \n, \v, \f and \r only
    if not found:
        return np.empty(0, np.int64)
    if len(_cache) > 300_000:  # bounds a worker's memory
        _cache.clear()
    get = _cache.get
    hashes = [get(w) for w in found]
    if None in hashes:
        for i, h in enumerate(hashes):
            if h is None:
                hashes[i] = _cache[found[i]] = xxhash.xxh3_64_intdigest(found[i])
    w = np.array(hashes, np.uint64)
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ w[i : len(w) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique((h ^ (h >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def _sketches(size: int):
    def run(batches):
        for b in _sliced(batches):
            hashes = [shingle_hashes(t, size) for t in b.column(1).to_pylist()]
            prints = np.array([np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64) for h in hashes], np.int64).reshape(-1, 2)
            n = pa.array([len(h) for h in hashes], pa.int64())
            yield pa.record_batch([b.column(0), n, *map(pa.array, prints.T), pa.array([h[:K] for h in hashes], pa.list_(pa.int64()))], ["doc_id", "n", "f1", "f2", "sketch"])

    return run


def _sliced(batches):
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            yield b.slice(lo, ROWS)


def _sets(size: int, bits):
    names = ["doc_id", "full", *[f"bits{i}" for i in range(WORDS)]]

    def run(batches):
        table = bits.value
        for b in _sliced(batches):
            at = b.column(2).to_numpy(zero_copy_only=False)
            keep = (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            b = b.filter(pa.array(keep))
            full = [shingle_hashes(t, size) for t in b.column(1).to_pylist()]
            odd = np.array([np.packbits(np.bincount(h & (64 * WORDS - 1), minlength=64 * WORDS) & 1).view(np.int64) for h in full], np.int64).reshape(-1, WORDS)
            yield pa.record_batch([b.column(0), pa.array(full, pa.list_(pa.int64())), *map(pa.array, odd.T)], names)

    return run


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _slot(doc_id) -> F.Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << BITS))


def _full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """doc_id, full, bits0 and so on: whole shingle sets of the documents in ids(doc_id), and of a few more, and of each
    the parities of its values' counts in 64 * WORDS hash slots.

    A bitmap of fixed size tells which documents are meant; false positives and repeated ids only cost time. Spark counts the 4 KB
    buckets from 1 and the values from 1."""
    rows = ids.select((_slot("doc_id") + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bits = np.zeros((1 << BITS) // 8, np.uint8)
    for r in rows:
        start = (r["k"] - 1) * 4096
        bits[start : start + 4096] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    full = docs.where("doc_id is not null").select("doc_id", "text", _slot("doc_id").alias("at")).mapInArrow(_sets(size, sent), f"doc_id {_id_type(docs)}, full array<long>, " + ", ".join(f"bits{i} long" for i in range(WORDS)))
    return staged(full, "full")


def _confirmed(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, size: int, percent: int, parts: int) -> DataFrame:
    """Of the candidate pairs (a, b), those whose full sets reach the threshold; some may come out more than once."""
    sk = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("sketch").alias(f"s{x}"))
    near = pairs.join(sk("a"), "a").coalesce(parts).join(sk("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    near = staged(near.where(shared * K >= F.size(union) * SHARED).select("a", "b"), "near", parts=parts)
    full = _full_sets(docs, near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))), size)
    side = lambda x: full.select(F.col("doc_id").alias(x), F.col("full").alias(f"f{x}"))
    both = near.join(side("a"), "a").coalesce(parts).join(side("b"), "b")
    common = F.size(F.array_intersect("fa", "fb"))
    return both.where(100 * common >= percent * (F.size("fa") + F.size("fb") - common)).select("a", "b").coalesce(parts)


def _prefix_pairs(sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """sets(doc_id, sid, c, full) -> pairs (a, b) of different c that can reach the threshold: exact prefix filtering.

    All sets are put in one order, values rarest among them first. With an overlap of percent / (100 + percent) of both
    sizes together, the smaller set has one of its first few values in common with a slightly longer prefix of the
    larger, and at no place where too few values follow. A value that no other set has takes up a place of the prefix,
    so a copy with many edits of its own meets few others, however large its group is. Slots whose parities differ
    count values that only one of two sets has: a lower bound of their difference, and so an upper one of the overlap.

    A pair with several such values in common counts at the first of them: later ones are left out if they have one
    of the BEFORE first values before them in common.

    The rows of a value that more than HOT sets have are dealt into blocks on either side, and every block of one side
    meets every block of the other in a task of its own."""
    bits = [f"bits{i}" for i in range(WORDS)]
    rows = sets.select("sid", F.explode("full").alias("value"))
    often = rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    ranked = rows.join(often, "value").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    n, v = F.col("n"), F.col("v")
    probe = n - F.ceil(n * (percent / 100) - 1e-9) + 1
    index = n - F.ceil(n * (2 * percent / (100 + percent)) - 1e-9) + 1
    # Values that only this set has come first in the order; they take up n - size(v) places.
    kept = sets.select("doc_id", "sid", "c", F.size("full").alias("n"), *bits).join(ranked, "sid").where(probe > n - F.size(v))
    kept = kept.select("doc_id", "c", "n", *bits, (n - F.size(v)).alias("own"), (index - n + F.size(v)).alias("few"), F.slice(v, F.lit(1), F.greatest(probe - n + F.size(v), F.lit(0)).cast("int")).alias("v"))
    placed = kept.select("doc_id", "c", "n", *bits, "own", "few", F.col("v.value").alias("v"), F.posexplode("v.value").alias("i", "value"))
    placed = staged(placed.withColumn("before", F.slice("v", F.lit(1), F.least("i", F.lit(BEFORE)))).drop("v"), "prefixes", parts=parts)
    hot = staged(placed.groupBy("value").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")).where("parts > 1"), "hot", parts=parts)
    dealt = join_checked(placed, hot, "value", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own, other = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    sides = {"x": dealt.withColumn("p", own).withColumn("q", other), "y": dealt.withColumn("q", own).withColumn("p", other)}
    side = lambda d: sides[d].select("value", "p", "q", F.col("doc_id").alias(d), F.col("c").alias(f"c{d}"), F.col("n").alias(f"n{d}"), (F.col("own") + F.col("i")).alias(f"i{d}"), (F.col("i") < F.col("few")).alias(f"few{d}"), F.col("before").alias(f"before{d}"), *[F.col(b).alias(f"{b}{d}") for b in bits])
    smaller = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    need = F.ceil((F.col("nx") + F.col("ny")) * (percent / (100 + percent)) - 1e-9)
    room = F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) >= need
    differ = sum((F.bit_count(F.col(f"{b}x").bitwiseXOR(F.col(f"{b}y"))) for b in bits), F.lit(0))
    room = room & (F.col("nx") + F.col("ny") - differ >= 2 * need)
    room = room & ~F.arrays_overlap("beforex", "beforey")
    pairs = side("x").where("fewx").join(side("y"), ["value", "p", "q"]).where(smaller & (F.col("cx") != F.col("cy")) & (100 * F.col("nx") >= percent * F.col("ny")) & room)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, reps: int = 3) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of distinct `size`-word
    shingles; component_id is the smallest doc_id reachable over links, kept says whether that is the document itself.
    Null and wordless texts have an empty set and no links. Rows with equal sets are one class from the start, so
    copies are never paired. Rows that share a doc_id count as one document, which has the links of all its texts;
    repeated rows come out repeated. Rows without doc_id are kept, with null component_id, and link nothing. doc_id may be
    of any type with an order. Other columns are ignored.

    Candidates come from inverted lists of sketch values, rarest values first: of a sketch of m values only those up to
    the (m - t + 1)-th rarest can be needed to share t. Each list first links its members to a few of its own members;
    what those links join is not compared again. Lists that are then still mixed give all pairs if they are short; the
    documents of the long ones are joined by exact prefix filtering of their whole sets. So large groups of near copies cost a few comparisons a member, and no pair is left
    out for a list's length. The lists are split by skew joins.
    """
    docs = docs.select("doc_id", "text")
    meta = staged(docs.mapInArrow(_sketches(size), f"doc_id {_id_type(docs)}, n long, f1 long, f2 long, sketch array<long>"), "sketches")
    some = meta.where("n > 0 and doc_id is not null")
    classes = some.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    parts = parts_for(meta)
    classes = staged(classes, "classes", parts=parts)
    member = some.join(classes, ["f1", "f2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()
    several = staged(member.groupBy("u").agg(F.count("*").alias("m")).where("m > 1").select("u"), "several", parts=parts)
    shared = staged(join_checked(member.where("u <> v"), several, "u", "left_semi"), "shared", parts=parts)
    one = some.join(classes, ["f1", "f2"]).where("doc_id = rep").select("doc_id", "n", "sketch").dropDuplicates(["doc_id", "sketch"])
    one = staged(one, "one", parts=parts)

    need = F.when(F.col("n") < SHORT, F.ceil(F.col("n") * (percent / 100) - 1e-9).cast("int")).otherwise(SHARED)
    rows = one.select("doc_id", "n", F.explode("sketch").alias("value"))
    often = rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    ranked = rows.join(often, "value").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    lists = ranked.withColumn("need", need).where("size(v) >= need").select("doc_id", "n", F.explode(F.expr("slice(v, 1, size(v) - need + 1).value")).alias("value"))
    lists = staged(lists, "lists", parts=parts)

    alike = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    order = [F.min(F.struct(F.xxhash64("doc_id", F.lit(i)).alias("o"), "doc_id", "n")).alias(f"r{i}") for i in range(reps)]
    heads = lists.groupBy("value").agg(*order, F.count("*").alias("df")).where("df > 1").select("value", F.explode(F.array_distinct(F.array(*[f"r{i}" for i in range(reps)]))).alias("r"))
    first = lists.join(heads, "value").where((F.col("doc_id") != F.col("r.doc_id")) & alike(F.col("n"), F.col("r.n")))
    first = staged(first.select(F.least("doc_id", "r.doc_id").alias("a"), F.greatest("doc_id", "r.doc_id").alias("b")).distinct(), "pairs", parts=parts)
    sure = staged(_confirmed(docs, first, one, size, percent, parts), "links")
    joined = staged(connected_components(sure.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components", parts=parts)

    # Second pass: lists with members that are neither joined nor all compared. Short ones give their pairs; for long
    # ones whole sets tell which pairs are left.
    left = lists.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("value", "doc_id", "n", F.coalesce("component", "doc_id").alias("c"))
    mixed = left.groupBy("value").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("df")).where("lo <> hi and df > 2").select("value", "df")
    left = staged(left.join(mixed, "value"), "left", parts=parts)
    x, y = (left.where(F.col("df") <= LIST).select("value", F.col("doc_id").alias(d), F.col("n").alias(f"n{d}"), F.col("c").alias(f"c{d}")) for d in "ab")
    few = x.join(y, "value").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & alike(F.col("na"), F.col("nb"))).select("a", "b").distinct()
    some = left.where(F.col("df") > LIST).select("doc_id", "c")
    sets = staged(some.distinct().join(_full_sets(docs, some.select("doc_id"), size), "doc_id").withColumn("sid", F.xxhash64("doc_id", "full")), "sets", parts=parts)
    rest = few.unionByName(_prefix_pairs(sets, percent, parts)).distinct().join(first, ["a", "b"], "left_anti")
    more = _confirmed(docs, staged(rest, "pairs", parts=parts), one, size, percent, parts)
    links = sure.unionByName(more)
    final = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(shared))

    named = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    out = meta.drop("sketch").join(named, ["f1", "f2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    own = F.when(F.col("doc_id").isNotNull(), own)
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text, ...) -> the rows that stay: one of each group of near-duplicate texts, with all its columns.

    A text is told apart by its doc_id and itself, so an id that occurs with two texts joins nothing, and no text is lost
    for its id. Of a group stays the text with the smallest id (then hash of the text), of its equal rows any one; rows
    without doc_id come last. Null and wordless texts are in no group, and all their rows stay."""
    key = lambda d: F.struct(d["doc_id"].isNull().alias("none"), d["doc_id"].alias("id"), F.xxhash64(d["text"]).alias("h"))
    judged = staged(near_duplicates(docs.select(key(docs).alias("doc_id"), "text"), size, percent), "judged")
    counts = judged.groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count_if(F.col("n_shingles") > 0).alias("m")).select("doc_id.id", "doc_id.h", "kept", "m")
    gone, twice = staged(counts.where("not kept"), "dropped"), staged(counts.where("kept and m > 1"), "twice")
    same = lambda k: docs["doc_id"].eqNullSafe(k["id"]) & (F.xxhash64(docs["text"]) == k["h"])
    kept = join_checked(docs, gone, same(gone), "left_anti")
    repeated = join_checked(docs, twice, same(twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return join_checked(kept, twice, same(twice), "left_anti").unionByName(repeated)


def op1_minhash(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)
