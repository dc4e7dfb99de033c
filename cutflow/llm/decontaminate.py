"""Benchmark decontamination by spaced seeds; built-in functions only.

A seed is a fixed mask over consecutive words that ignores some positions. Documents and benchmark items are joined on
the hashes of their masked words, and around every hit the two texts are compared word by word along its diagonal. An
overlap scores 1 for an equal word and -2 for a different one; its best run must reach `least`, so about one word in
five may be replaced, and a run of fewer equal words, as prose shares by chance, does not count.

A short item whose words are replaced to that share does not reach `least`. It counts too if the whole of it stands in
the document with no more than one word in five replaced, wherever those are: it is cut into one part more than words
may be replaced, one of the parts must be intact, and its first three words are a seed. Items of three to six words
count where they stand word for word; one or two words stand in prose by chance, so such an item counts if it is the
whole document.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import NOT_ALNUM, ascii_lower, join_checked, let, staged, table

#: Masks, as starts of pairs of adjacent words: 1111011, 1101111 and 11011011. Each hits any run in which every fifth
#: word is replaced.
MASKS = ((0, 2, 5), (0, 3, 5), (0, 3, 6))
LEAST = 10  # score of an overlap, or the item's length if that is smaller
SHORTEST = 7  # items of fewer words must stand word for word
PHRASE = 3  # those of fewer than these must be the whole document
SHARE = 5  # one word in so many may be replaced
FEW = "^[{0}]*+[^{0}]++(?:[{0}]++[^{0}]++)?+[{0}]*+$".format(r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F")  # a text of one or two words
LONG = 25  # items of fewer words also have seeds of three words
SEEDS = 50_000  # benchmark seeds that are broadcast with their items; those of a larger benchmark are shuffled
SIEVE = 4_000_000  # seeds broadcast as bare numbers at a time, to sieve the documents' seeds before that shuffle


def words(text: Column) -> Column:
    """Lower-case words without punctuation; one empty string may stand at either end, or alone."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_ALNUM)


def seeds(w: Column) -> Column:
    """array<array<long>>: for each mask the hashes at every place where it fits."""

    def pairs(h: Column) -> Column:
        return F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda a, b: F.xxhash64(a, b))

    def masked(p: Column, mask: tuple, number: int) -> Column:
        n = F.size(p) - mask[2]
        first = F.zip_with(F.slice(p, 1, n), F.slice(p, mask[1] + 1, n), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(first, F.slice(p, mask[2] + 1, n), lambda a, b: F.xxhash64(a, b, F.lit(number)))

    def triples(p: Column) -> Column:
        n = F.greatest(F.size(p) - 1, F.lit(0))
        return F.zip_with(F.slice(p, 1, n), F.slice(p, 2, n), lambda a, b: F.xxhash64(a, b, F.lit(len(MASKS))))

    empty = F.array().cast("array<long>")
    each = lambda p: F.array(*[F.when(F.size(p) > m[2], masked(p, m, k)).otherwise(empty) for k, m in enumerate(MASKS)], triples(p))
    return F.when(F.size(w) >= PHRASE, let(pairs(F.transform(w, lambda x: F.xxhash64(x))), each)).otherwise(F.array().cast("array<array<long>>"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (its words), key (their hash): items of equal words are one."""
    items = benchmark.select(F.filter(words(F.col("text")), lambda x: x != "").alias("item")).where(F.size("item") > 0)
    return items.select("item", F.xxhash64("item").alias("key")).dropDuplicates(["key"])


def item_seeds(items: DataFrame) -> DataFrame:
    """item (its words, or null from LONG words on), key, place, seed: a seed stands once for each place."""
    n, parts = F.col("n"), replaced(F.col("n")) + 1
    starts = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.floor(k * n / parts).cast("int"))
    few = F.when(F.size("item") < LONG, F.col("item")).alias("few")
    each = items.select(few, "key", F.size("item").alias("n"), F.posexplode(seeds(F.col("item"))).alias("mask", "s")).select("few", "key", "n", "mask", F.posexplode("s").alias("place", "seed"))
    return each.where((F.col("mask") < len(MASKS)) | ((n < LONG) & F.array_contains(starts, F.col("place")))).select(F.col("few").alias("item"), "key", "place", "seed")


def replaced(n: Column) -> Column:
    """How many words of an item of n words may be replaced, wherever they stand."""
    return F.when(n < SHORTEST, F.lit(0)).otherwise(F.floor(n / SHARE).cast("int"))


def whole(found: Column, item: Column) -> Column:
    """Whether two arrays differ in no more words than may be replaced."""
    differ = F.filter(F.zip_with(found, item, lambda a, b: F.coalesce(a != b, F.lit(True))), lambda x: x)
    return F.size(differ) <= replaced(F.size(item))


def score(found: Column, item: Column) -> Column:
    """Best run of equal words (1 each) and different words (-2 each) of two arrays of one length."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    steps = F.zip_with(found, item, lambda a, b: F.when(a == b, F.lit(1)).otherwise(F.lit(-2)))

    def step(s: Column, x: Column) -> Column:
        now = F.greatest(s["now"] + F.coalesce(x, F.lit(-2)), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(steps, start, step)["best"]


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, block: int = SEEDS, sieve: int = SIEVE) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text) -> doc_id, h (hash of the text), key (of the item), score.

    A row for each document and benchmark text whose best overlap reaches `least`. The documents' seeds are made where
    the document is read. A benchmark of at most `block` seeds, which are counted first, is broadcast. A larger one is
    too large for that: its seeds are broadcast as bare numbers, `sieve` at a time, and only the documents' seeds that
    are among them are shuffled to the items. Seeds of items of fewer than LONG words bring those words along, and the
    words around a hit are cut out where the document is read. A longer item's seeds bring its key and place only: hits
    become distinct diagonals first, and then the words of the documents and items that have such are fetched, so that
    the work is in proportion to an item's length."""
    items = staged(items_of(benchmark), "items")
    known = staged(item_seeds(items), "seeds")
    n_seeds = known.count()
    w = docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    hashed = w.select("doc_id", "h", "w", F.flatten(seeds(F.col("w"))).alias("s"), F.size("w").alias("n"))
    probes = hashed.select("doc_id", "h", "w", "n", F.posexplode_outer("s").alias("i", "seed"))
    # The masks' seeds stand one after the other: n - 1 - span of them each.
    sizes = [F.greatest(F.col("n") - 1 - m[2], F.lit(0)) for m in MASKS]
    first, second, third = sizes[0], sizes[0] + sizes[1], sizes[0] + sizes[1] + sizes[2]
    at = F.when(F.col("i") < first, F.col("i")).when(F.col("i") < second, F.col("i") - first).when(F.col("i") < third, F.col("i") - second).otherwise(F.col("i") - third)
    short = F.col("i") >= third
    if n_seeds <= block:
        hits = probes.join(F.broadcast(known), "seed").select("doc_id", "h", "item", "key", (at - F.col("place")).alias("shift"), short.alias("short"), F.col("w").alias("part"), F.lit(0).alias("from"))
    else:
        parts = -(-n_seeds // sieve)
        numbers = known.select("seed").distinct()
        blocks = [numbers.where(F.pmod(F.xxhash64("seed"), F.lit(parts)) == k) for k in range(parts)]
        left = None
        for b in blocks:
            one = probes.join(F.broadcast(b), "seed", "left_semi").select("doc_id", "h", "seed", at.alias("at"), short.alias("short"), F.greatest(at - LONG, F.lit(0)).alias("from"), "w")
            one = one.withColumn("part", F.slice("w", F.col("from") + 1, F.lit(2 * LONG))).drop("w")
            left = one if left is None else left.unionByName(one)
        hits = left.join(known.hint("shuffle_hash"), "seed").withColumn("shift", F.col("at") - F.col("place"))
    def along(shift: Column, part: Column, begin: Column, item: Column) -> Column:
        """The document's words beside an item's; what stands outside the document counts as different."""
        lo, size = F.greatest(shift, F.lit(0)), F.size(item)
        return F.concat(F.array_repeat(F.lit(""), F.least(lo - shift, size)), F.slice(part, lo - begin + 1, F.greatest(shift + size - lo, F.lit(0))))

    # Three words stand in prose by chance, so their hits are verified before they leave the task; by a generator, as
    # a filter would go into the join and have it handle a copy of the document for each of its seeds.
    there = F.when(F.col("item").isNull(), F.array().cast("array<string>")).otherwise(along(F.col("shift"), F.col("part"), F.col("from"), F.col("item")))
    hits = hits.select("doc_id", "h", "item", "key", "shift", "short", there.alias("there"))
    hits = hits.select("doc_id", "h", "item", "key", "shift", F.explode_outer(F.when(~F.col("short") | whole(F.col("there"), F.col("item")), F.array("there"))).alias("there")).where("there is not null")
    lines = staged(hits.groupBy("doc_id", "h", "key", "shift").agg(F.first("there").alias("there"), F.first("item").alias("item")), "diagonals")
    near = lines.where("item is not null").select("doc_id", "h", "key", "there", "item")
    far = lines.where("item is null").select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "key", "shift")
    if not far.isEmpty():
        texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").dropDuplicates(["doc_id", "h"])
        found = join_checked(texts, staged(far, "far"), texts["doc_id"].eqNullSafe(F.col("d")) & (texts["h"] == F.col("g")), "inner")
        found = found.select("doc_id", "h", words(F.col("text")).alias("w"), "key", "shift").join(items, "key")
        near = near.unionByName(found.select("doc_id", "h", "key", along(F.col("shift"), F.col("w"), F.lit(0), F.col("item")).alias("there"), "item"))
    near = near.withColumn("score", score(F.col("there"), F.col("item"))).where((F.col("score") >= F.least(F.lit(least), F.size("item"))) | whole(F.col("there"), F.col("item")))
    # Items too short for a seed: the document is no more than that.
    bare = F.filter(words(F.col("text")), lambda x: x != "")
    tiny = docs.where(F.regexp_like("text", F.lit(FEW))).select("doc_id", F.xxhash64("text").alias("h"), bare.alias("b")).where(F.size("b").between(1, PHRASE - 1)).select("doc_id", "h", F.xxhash64("b").alias("key"))
    tiny = tiny.join(items.where(F.size("item") < PHRASE), "key").select("doc_id", "h", "key", F.size("item").alias("score"))
    return near.select("doc_id", "h", "key", "score").unionByName(tiny).groupBy("doc_id", "h", "key").agg(F.max("score").alias("score"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, h, items (ids in order, comma-joined), n_items, score (longest overlap) of the documents that overlap."""
    named = benchmark.select(F.xxhash64(F.filter(words(F.col("text")), lambda x: x != "")).alias("key"), "item_id")
    found = overlaps(docs, benchmark, **options).join(named, "key")
    per = found.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item_id")).alias("ids"), F.max("score").alias("score"))
    return per.select("doc_id", "h", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("items"), F.size("ids").cast("long").alias("n_items"), F.col("score").cast("long").alias("score"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs with items, n_items, score and kept (false: the document overlaps a benchmark item).

    Null and blank texts are kept. Rows with equal doc_id and text get the same verdict; rows without doc_id are judged
    too. Items without words match nothing; an empty benchmark keeps everything. Other columns pass through; columns of docs with the names above are replaced."""
    return _judged(docs.withColumn("_h", F.xxhash64("text")), contaminated(docs, benchmark, **options))


def _judged(docs: DataFrame, found: DataFrame) -> DataFrame:
    found = staged(found.select(F.col("doc_id").alias("_d"), F.col("h").alias("_g"), F.col("items").alias("_i"), F.col("n_items").alias("_n"), F.col("score").alias("_s")), "contaminated")
    out = join_checked(docs, found, docs["doc_id"].eqNullSafe(found["_d"]) & (docs["_h"] == found["_g"]), "left")
    out = out.withColumns({"items": F.coalesce("_i", F.lit("")), "n_items": F.coalesce("_n", F.lit(0).cast("long")), "score": F.coalesce("_s", F.lit(0).cast("long")), "kept": F.col("_n").isNull()})
    return out.drop("_d", "_h", "_g", "_i", "_n", "_s")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _judged(docs.select("doc_id", F.xxhash64("text").alias("_h")), contaminated(docs, table(spark, sf_dir, "benchmark")))
