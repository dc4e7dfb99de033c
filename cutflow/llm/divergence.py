"""How far the sources of a language are from each other, and the terms that set each one apart.

Every (lang, source) group and every lang gives each kept term a whole-number probability with one added to its count,
p = 1 + floor(10^9 (count + 1) / (N + V)), and f(p, q) = floor((p - q)^2 / q) is what a term adds to the divergence.

Terms: a group's terms of one count share their p, so the least probability q that the lang gives to any of them bounds
f for the whole bucket. Buckets are opened best bound first until they hold k terms; the k-th value found so far leaves
out every bucket whose bound is strictly below it, and only the others are opened after that.

Pairs: what a pair of groups gives if no term were common follows from how many terms each has of each count. Postings
(the groups of a term) then correct that for the terms that both have.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from .common import importable, join_checked, staged, table

SCALE = 1_000_000_000
LEAST_DOCUMENTS = 3
TOP = 200
FLUSH = 300_000  # counts that a task holds before it hands them on
#: Bytes that don't belong to terms become spaces, A-Z become a-z.
TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(batches):
    """lang, source, term, n, docs: summed over what a task has read, FLUSH counts at a time."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def out():
        for (lang, source), (n, docs) in held.items():
            terms = [*n]
            yield pa.record_batch([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array([t.decode() for t in terms], pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], schema=COUNTS)
        held.clear()

    size = 0
    for b in batches:
        for lang, source, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, terms = len(n), text.translate(TERM_BYTES).split()
            n.update(terms)
            docs.update(set(terms))
            size += len(n) - before
            if size > FLUSH:
                yield from out()
                size = 0
    yield from out()


def _groups(docs: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))


def term_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """docs(text, lang, source, ...) -> lang, source, term, n, and n_lang: a row for each kept term of a group."""
    each = _groups(docs).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    per = each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # a row for each source of the lang at most
    both = per.select("lang", "source", "term", "n", F.sum("n").over(term).alias("n_lang"), F.sum("docs").over(term).alias("docs"))
    return both.where(F.col("docs") >= least).drop("docs")


def probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), exactly."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    whole = F.call_function("div", wide(n + 1, 19) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + kept, 19))
    return F.lit(1).cast("long") + whole


def gain(p: Column, q: Column) -> Column:
    """f: floor((p - q)^2 / q); probabilities have ten digits at most, so that squares fit a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def top_terms(counts: DataFrame, sizes: DataFrame, top: int = TOP) -> DataFrame:
    """counts of term_counts, sizes(lang, source, total, total_lang, kept) -> lang, source, item, value, rank."""
    known = join_checked(counts, sizes, ["lang", "source"], "inner").withColumns({"p": probability(F.col("n"), F.col("total"), F.col("kept")), "q": probability(F.col("n_lang"), F.col("total_lang"), F.col("kept"))}).where("p > q").select("lang", "source", "term", "p", "q")
    group = Window.partitionBy("lang", "source")
    # Buckets: terms of a group that share p, that is, their count. The running number of terms is that of better buckets.
    buckets = known.groupBy("lang", "source", "p").agg(F.min("q").alias("least"), F.count("*").alias("terms")).withColumn("bound", gain(F.col("p"), F.col("least")))
    before = F.coalesce(F.sum("terms").over(group.orderBy(F.desc("bound"), F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = staged(buckets.select("lang", "source", "p", "bound", (before < top).alias("first")), "buckets")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "term"))).where(F.col("rank") <= top)
    value = gain(F.col("p"), F.col("q")).alias("value")
    opened = join_checked(known, buckets.where("first"), ["lang", "source", "p"], "inner").select("lang", "source", "term", value)
    kth = ranked(opened).groupBy("lang", "source").agg(F.when(F.count("*") >= top, F.min("value")).otherwise(F.lit(0)).alias("kth"))
    worth = buckets.join(kth, ["lang", "source"]).where("bound >= kth").select("lang", "source", "p")
    found = join_checked(known, staged(worth, "worth"), ["lang", "source", "p"], "inner").select("lang", "source", F.col("term"), value)
    return ranked(found).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def source_pairs(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """As top_terms, but the items are the other sources of the lang, all of them, by the divergence from them."""
    p = lambda n: probability(n, F.col("total"), F.col("kept"))
    s = sizes.withColumn("p0", p(F.lit(0).cast("long"))).select("lang", "source", "kept", "p0", "total")
    at = join_checked(counts, staged(s, "sizes"), ["lang", "source"], "inner").select("lang", "source", "term", p(F.col("n")).alias("p"), "p0")
    shares = at.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms"))
    other = s.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    apart = F.col("source") != F.col("item")
    # Terms that only the group has, only the other has, and neither has.
    sides = shares.join(other, "lang").where(apart)
    ours = sides.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * gain(F.col("p"), F.col("q0"))).alias("v"), F.sum("terms").alias("terms"))
    theirs = sides.groupBy("lang", F.col("item").alias("source"), F.col("source").alias("item")).agg(F.sum(F.col("terms") * gain(F.col("q0"), F.col("p"))).alias("v"), F.sum("terms").alias("terms"))
    neither = s.join(other, "lang").where(apart).select("lang", "source", "item", "kept", gain(F.col("p0"), F.col("q0")).alias("none"))
    base = ours.unionByName(theirs).groupBy("lang", "source", "item").agg(F.sum("v").alias("v"), F.sum("terms").alias("terms"))
    base = neither.join(base, ["lang", "source", "item"], "left").select("lang", "source", "item", (F.coalesce("v", F.lit(0)) + (F.col("kept") - F.coalesce("terms", F.lit(0))) * F.col("none")).alias("value"))
    # Terms that both have stand in both sums above.
    listed = at.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    change = gain(F.col("p"), F.col("q")) - gain(F.col("p"), F.col("q0")) - gain(F.col("p0"), F.col("q")) + gain(F.col("p0"), F.col("q0"))
    common = at.join(listed, ["lang", "term"]).where(apart).groupBy("lang", "source", "item").agg(F.sum(change).alias("value"))
    total = base.unionByName(common).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return total.select("lang", "source", "item", "value", rank.alias("rank"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """docs(text, lang, source, ...) -> lang, source, part (pair or term), item, value, rank.

    Nulls are ''. Groups without terms have pairs too; a lang with one source has none, and one without kept terms has
    zeros. Repeated rows are documents of their own; equal values rank by the item's bytes; an empty table gives none."""
    importable(docs.sparkSession)
    counts = staged(term_counts(docs, least), "counts")
    terms = counts.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total_lang"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = _groups(docs).select("lang", "source").distinct().join(terms, "lang", "left").join(own, ["lang", "source"], "left").fillna(0, ["kept", "total_lang", "total"])
    # Without kept terms there is nothing to give a probability to.
    sizes = staged(sizes, "sizes")
    some, none = sizes.where("kept > 0"), sizes.where("kept = 0")
    empty = none.select("lang", "source").join(none.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    empty = empty.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy("item")))
    pairs = source_pairs(counts, some).unionByName(empty)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(top_terms(counts, some, top), "term"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*) as n from w group by all having count(distinct r) >= 3),
v as (select lang, count(*) as v, sum(n) as n from k group by lang),
g as (select distinct lang, source from d),
c as (select w.lang, w.source, w.term, count(*) as n from w join k using (lang, term) group by all),
t as (select lang, source, sum(n) as n from c group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as c, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (coalesce(t.n, 0) + v.v) as p, 1 + (1000000000::hugeint * (k.n + 1)) // (v.n + v.v) as q
  from g join k using (lang) join v using (lang) left join c using (lang, source, term) left join t using (lang, source)),
s as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select g.lang, g.source, h.source as item, coalesce(s.value, 0)::bigint as value from g join g h on g.lang = h.lang and g.source <> h.source left join s on s.lang = g.lang and s.source = g.source and s.item = h.source),
terms as (select lang, source, term as item, (((p - q) * (p - q)) // q)::bigint as value from p where c > 0 and p > q),
u as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', item, value from terms),
o as (select *, (row_number() over (partition by lang, source, part order by value desc, encode(item)))::int as rank from u)
select * from o where part = 'pair' or rank <= 200"""
