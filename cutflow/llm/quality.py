"""Quality rules by hashed n-gram log-likelihood ratio between a trusted target and the raw corpus; built-in functions only."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import SPACE, let, staged, table

BUCKETS = 1 << 15  # a power of two
WINDOW = 5  # words
TRUSTED = 20_000  # the target is learnt from at most so many labelled documents, those with the smallest hash of their id
THRESHOLD = -0.5  # nats an n-gram
WHITE = " \t\n\x0b\x0c\r"


def word_array(text: Column) -> Column:
    """Words of a text; none if it is null or blank."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def hashes(words: Column) -> Column:
    """64-bit hashes of a document's n-grams: each word, each pair of neighbouring words, and each word's last three
    characters; 3 n - 1 of them for n words."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))
    ends = F.transform(words, lambda w: F.xxhash64(F.substring(w, -3, 3), F.lit(3)))
    return F.struct(F.transform(words, lambda w: F.xxhash64(w)).alias("words"), pairs.alias("pairs"), ends.alias("ends"))


def bucket(x: Column) -> Column:
    return x.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def windows(h: Column) -> Column:
    """A hash of each window of WINDOW words, from the hashes of words and of pairs: one pair, the next, and a word."""
    fours = F.zip_with(F.slice(h["pairs"], 1, F.size(h["pairs"]) - 2), F.slice(h["pairs"], 3, F.size(h["pairs"]) - 2), lambda a, b: F.xxhash64(a, b))
    fives = let(fours, lambda x: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(h["words"], WINDOW, F.size(x) - 1), lambda a, b: F.xxhash64(a, b)))
    return F.when(F.size(h["words"]) < WINDOW, F.array().cast("array<bigint>")).otherwise(fives)


def repeated_words(found: Column) -> Column:
    """How many words stand in a window that occurs twice or more in the text, by the hashes of its windows.

    Only a text that repeats one sorts its windows: equal ones become neighbours, and the words covered are counted
    along the sorted positions."""

    def covered(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        equal = lambda x, s, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
        marked = lambda s: F.transform(s, lambda x, i: F.when(equal(x, s, i - 1) | equal(x, s, i + 1), x["i"]))
        places = let(ordered, lambda s: F.sort_array(F.array_compact(marked(s))))
        steps = lambda p: F.zip_with(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, F.size(p) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return let(places, lambda p: F.aggregate(steps(p), F.lit(WINDOW), lambda total, x: total + x))

    return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(covered(found))


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """Ids of at most `most` documents labelled good and not toxic; bounded, so that it can be broadcast."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def bucket_ratios(docs: DataFrame, labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """One row, ratios array<double>: the log ratio of each bucket's share in the trusted documents to its share in all
    documents, add-one smoothed; zeros if no document is trusted.

    Every n-gram of every document is counted; the counts are pre-aggregated to at most BUCKETS rows a task."""
    mark = F.broadcast(trusted_ids(labels, most)).select(F.col("doc_id"), F.lit(1).alias("good"))
    every = let(word_array(F.col("text")), lambda w: let(hashes(w), lambda h: F.concat(h["words"], h["pairs"], h["ends"])))
    grams = docs.select("doc_id", "text").join(mark, "doc_id", "left").select("good", F.explode(every).alias("h"))
    counts = grams.groupBy(bucket(F.col("h")).alias("b")).agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    buckets = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    one = lambda x: F.coalesce(x, F.lit(0).cast("long")) + 1
    whole = buckets.select("b", one("raw").alias("raw"), one("target").alias("target")).agg(F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("x"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    ratio = lambda x: F.when(F.col("n_target") == BUCKETS, F.lit(0.0)).otherwise(F.ln(x["target"] / F.col("n_target")) - F.ln(x["raw"] / F.col("n_raw")))
    return whole.select(F.transform("x", ratio).alias("ratios"))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = TRUSTED) -> DataFrame:
    """docs(doc_id, text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept.

    llr is the mean over the document's n-grams of log P(n-gram | trusted) - log P(n-gram | raw corpus). kept is false
    for base_failed documents and where llr < threshold. A null or blank text has no words, llr 0, and fails the base.
    Rows are judged alone: repeated rows and null ids keep their columns, other columns pass through; columns of docs
    with the names above are replaced. Without trusted documents nothing is told apart, and every llr is 0.
    """
    # A scalar subquery over a written table: as a literal, the ratios would stand in each of the plan's texts, which the
    # driver keeps.
    ratios = staged(bucket_ratios(docs, labels, most), "ratios").scalar()
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    add = lambda table: lambda total, x: total + F.get(table, bucket(x))
    total = lambda h: let(F.col("_r"), lambda r: F.aggregate(h["ends"], F.aggregate(h["pairs"], F.aggregate(h["words"], F.lit(0.0), add(r)), add(r)), add(r)))
    stats = let(
        word_array(F.col("text")),
        lambda w: let(
            hashes(w),
            lambda h: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                windows(h).alias("windows"),
                F.when(F.size(w) == 0, F.lit(0.0)).otherwise(total(h) / (3 * F.size(w) - 1)).alias("llr"),
            ),
        ),
    )
    symbols = F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))
    out = docs.withColumn("_r", ratios).withColumn("_s", stats).drop("_r")
    out = out.withColumns({"n_words": F.col("_s.n_words"), "word_chars": F.col("_s.word_chars"), "n_symbols": symbols.cast("long"), "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"), "n_repeat_words": repeated_words(F.col("_s.windows")).cast("long"), "llr": F.col("_s.llr")}).drop("_s")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
