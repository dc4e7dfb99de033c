"""License scan: exact set-similarity join of text blocks with license texts and notices; built-in functions only.

Blocks are overlapping windows over all words of a text, whatever its lines, and templates are sets of tokens in one
global order, rarest in the corpus first. A template is contained in a block if the block holds at least threshold *
|template| of its tokens. Only tokens of some template can count, so a block's set is cut to those without loss; prefix,
length and positional filters then find the pairs to compare. Short notices are sought in short blocks and whole license
texts in long ones; two blocks overlap by the longest template of their kind, so one block holds it whole.
"""

from __future__ import annotations

import math
import re
from itertools import count
from typing import NamedTuple

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import alnum_text, let, staged, table, values

#: Phrases whose consecutive words make a base label (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice templates: label and text.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law all copyright and related rights have been waived cc0"),
    ("proprietary", "all rights reserved no part may be reproduced without written permission of the publisher"),
    ("all-rights-reserved", "all rights reserved"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
        IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    ),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    ),
    (
        "gpl-3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    ),
]
THRESHOLD = 0.9
#: Words of the step from a block to the next one of the first kind, and how many times as many the next kind has. Blocks
#: have two steps' words. A template belongs to the first kind of which a step has as many words as it.
STEP, GROWTH = 32, 8


def block_words(kind: int) -> tuple[int, int]:
    """Words of a block of a kind, and of a step."""
    return 2 * STEP * GROWTH**kind, STEP * GROWTH**kind


class Template(NamedTuple):
    label: str
    kind: int
    words: int
    tokens: list[str]  # distinct


def template_sets(templates) -> list[Template]:
    """Templates of any length, as they are sought; one without words is an error."""
    out = []
    for label, text in templates:
        words = [w for w in re.split("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
        if not words:
            raise ValueError(f"a template without words: {text[:60]!r}")
        kind = next(k for k in count() if len(words) <= block_words(k)[1])
        out.append(Template(label, kind, len(words), sorted(set(words))))
    return out


BLOCKS = "array<struct<kind:int,at:int,tokens:array<string>,words:array<int>>>"


def blocks(w: Column, kind: int, known: list[str], least: int) -> Column:
    """array<struct<kind, at, tokens, words>> of the blocks of a word array that hold `least` or more of the known tokens.
    words has for each word of the block its place among tokens, from 1, or 0."""
    size, step = block_words(kind)
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (size - step), F.lit(1)), F.lit(step))
    some = F.array(*map(F.lit, known))
    each = F.transform(starts, lambda at: F.struct(F.lit(kind).alias("kind"), at.alias("at"), F.array_intersect(F.slice(w, at, F.lit(size)), some).alias("tokens")))
    none = F.array().cast(BLOCKS)
    held = F.filter(each, lambda x: F.size(x["tokens"]) >= least)
    words = lambda x: F.transform(F.slice(w, x["at"], F.lit(size)), lambda v: F.array_position(x["tokens"], v).cast("int"))
    whole = F.transform(held, lambda x: F.struct(x["kind"].alias("kind"), x["at"].alias("at"), x["tokens"].alias("tokens"), words(x).alias("words")))
    return F.when(F.size(F.array_intersect(w, some)) >= least, whole).otherwise(none)


def parsed(docs: DataFrame, sets: list[Template], threshold: float) -> DataFrame:
    """doc_id, h (hash of the text), n_words, p0 and so on (places of PHRASES) and blocks(kind, at, tokens, words) of every row.

    The only pass over the texts. tokens are numbers of the templates' distinct tokens, in their order from 1; words the
    places in tokens of all words of the block, 0 for those that no template has."""
    vocabulary = sorted({t for x in sets for t in x.tokens})
    t, space = F.col("t"), F.lit(" ")
    base = docs.select("doc_id", F.xxhash64("text").alias("h"), alnum_text(F.col("text")).alias("t"))
    kinds = {k: ([w for x in sets if x.kind == k for w in x.tokens], min(needed(x.tokens, threshold) for x in sets if x.kind == k)) for k in sorted({x.kind for x in sets})}
    found = F.array().cast(BLOCKS)
    if kinds:
        found = let(F.split(F.trim(t), " "), lambda w: F.concat(*[blocks(w, k, sorted(set(known)), least) for k, (known, least) in kinds.items()]))
    names = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    number = lambda x: F.array_position(names, x).cast("int")
    numbered = F.transform(found, lambda b: F.struct(b["kind"].alias("kind"), b["at"].alias("at"), F.transform(b["tokens"], number).alias("tokens"), b["words"].alias("words")))
    n_words = F.when(t == "  ", F.lit(0)).otherwise(F.greatest(F.char_length(t) - F.char_length(F.replace(t, space, F.lit(""))) - 1, F.lit(0)))
    return base.select("doc_id", "h", n_words.cast("long").alias("n_words"), *[phrase_places(t, p).alias(f"p{i}") for i, p in enumerate(PHRASES)], numbered.alias("blocks"))


def needed(tokens: list[str], threshold: float) -> int:
    """How many of a template's distinct tokens a block must hold."""
    return math.ceil(threshold * len(tokens) - 1e-9)


def places(words: Column, template: Column) -> Column:
    """Starts in a block's words, from 1, of the runs of as many words as the template has that hold most of its tokens."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - template["words"] + 1, F.lit(1)))
    counts = F.transform(starts, lambda p: F.size(F.array_intersect(F.slice(words, p, template["words"]), template["t"])))
    return let(counts, lambda n: let(F.array_max(n), lambda top: F.filter(starts, lambda p: F.element_at(n, p) == top)))


def covered(words: Column, inner: Column, outer: Column) -> Column:
    """Whether the best runs of outer cover all of inner's tokens in all its best runs."""
    within = lambda q, p, template: (q >= p) & (q < p + template["words"])

    def bare(runs: Column) -> Column:
        every = F.sequence(F.lit(1), F.size(words))
        return F.filter(every, lambda q: F.array_contains(inner["t"], F.element_at(words, q)) & ~F.exists(runs, lambda p: within(q, p, outer)))

    free = let(places(words, outer), bare)
    return let(free, lambda f: ~F.exists(places(words, inner), lambda p: F.exists(f, lambda q: within(q, p, inner))))


def matches(found: DataFrame, sets: list[Template], threshold: float) -> DataFrame:
    """Of parsed rows: doc_id, h, label, containment, the greatest of a label in a document.

    The blocks are counted first: in how many each template token stands gives the order; one row for each such token
    reaches the driver. The templates are a parameter of fixed size, and their prefixes are broadcast."""
    vocabulary = sorted({t for x in sets for t in x.tokens})
    each = found.select("doc_id", "h", F.explode("blocks").alias("b")).select("doc_id", "h", "b.kind", "b.at", "b.tokens", "b.words")
    often = {r["w"]: r["n"] for r in each.select(F.explode("tokens").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = sorted(range(len(vocabulary)), key=lambda i: (often.get(i + 1, 0), vocabulary[i]))
    rank = {vocabulary[i]: r for r, i in enumerate(order)}
    index = []
    for label, kind, words, tokens in sets:
        t, need = sorted(rank[w] for w in tokens), needed(tokens, threshold)
        # Some of the first |T| - need + 1 tokens of T must be in a block that holds `need` of them.
        index += [(r, kind, i, len(t), need, label, words, ",".join(map(str, t))) for i, r in enumerate(t[: len(t) - need + 1])]
    index = values(found.sparkSession, "r int, kind int, i int, size int, need int, label string, n int, t string", index)
    index = F.broadcast(index.withColumn("t", F.split("t", ",").cast("array<int>")))
    ranks = F.array(*[F.lit(rank[w]) for w in vocabulary]) if vocabulary else F.array().cast("array<int>")
    key = ["doc_id", "h", "kind", "at"]
    numbered = each.select(*key, F.transform("tokens", lambda i: F.element_at(ranks, i)).alias("t"), "words")
    held = numbered.select(*key, F.sort_array("t").alias("b"), F.transform("words", lambda i: F.coalesce(F.get("t", i - 1), F.lit(-1))).alias("words"))
    pairs = held.select(*key, "b", "words", F.posexplode_outer("b").alias("j", "r")).join(index, ["r", "kind"])
    pairs = pairs.where((F.size("b") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("i") - 1, F.size("b") - F.col("j") - 1) >= F.col("need")))
    pairs = pairs.withColumn("m", F.array_intersect("b", "t")).where(F.size("m") >= F.col("need"))
    # A template gives way in a block to one that explains the same tokens better, if it does so wherever the template
    # stands best: cc-by to cc-by-nc, gpl-3 to lgpl-3, but not where a notice of its own stands beside the other one.
    match = F.struct("label", "m", (F.size("m") / F.col("size")).alias("c"), "t", F.col("n").alias("words"))
    grouped = pairs.groupBy(*key).agg(F.collect_set(match).alias("all"), F.first("words").alias("words"))
    fuller = lambda x, o: (F.size(F.array_except(x["m"], o["m"])) == 0) & ((F.size(o["m"]) > F.size(x["m"])) | (o["c"] > x["c"]))
    better = lambda x, o: F.when(fuller(x, o), covered(F.col("words"), x, o)).otherwise(False)
    best = grouped.select("doc_id", "h", F.explode(F.filter("all", lambda x: ~F.exists("all", lambda o: better(x, o)))).alias("x"))
    return best.groupBy("doc_id", "h", F.col("x.label").alias("label")).agg(F.max("x.c").alias("containment"))


def license_matches(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, h (hash of the text), label, containment.

    Rows of docs with equal doc_id and text are one; null and blank texts have no blocks; without templates there are
    no matches."""
    sets = template_sets(templates)
    return matches(staged(parsed(docs, sets, threshold), "blocks"), sets, threshold)


def phrase_places(text: Column, phrase: str) -> Column:
    """struct(n, first, last): how often a phrase stands in the words of alnum_text, and the first and last start."""
    size, n_words = len(phrase.split()), F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit(""))) - 1
    spaces = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit("")))
    places = lambda p: F.struct((F.size(p) - 1).cast("long").alias("n"), spaces(p[0]).cast("long").alias("first"), (n_words - spaces(F.element_at(p, -1)) + 1 - size).cast("long").alias("last"))
    return F.when(F.contains(text, F.lit(f" {phrase} ")), let(F.split(text, f" {phrase}(?= )"), places))


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels come from phrases, wherever they stand; labels adds those of the templates that a block contains.
    score is the greatest containment found, 1 for base labels, else 0. Null and blank texts have no words, no labels
    and score 0; rows without doc_id and repeated rows each keep their row; other columns are ignored."""
    sets = template_sets(templates)
    base = staged(parsed(docs, sets, threshold), "blocks")
    found = matches(base, sets, threshold).groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("c"))
    each = [f"p{i}" for i in range(len(PHRASES))]
    labels = F.array_compact(F.array(*[F.when(F.col(p).isNotNull(), F.lit(label)) for p, label in zip(each, PHRASES.values(), strict=True)]))
    joined = base.join(found, base["doc_id"].eqNullSafe(found["d"]) & (base["h"] == found["g"]), "left")
    text = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return joined.select(
        "doc_id",
        "n_words",
        sum(F.coalesce(F.col(f"{p}.n"), F.lit(0)) for p in each).cast("long").alias("n_base"),
        F.least(*[F.col(f"{p}.first") for p in each]).alias("first_word"),
        F.greatest(*[F.col(f"{p}.last") for p in each]).alias("last_word"),
        text(labels).alias("base_labels"),
        text(F.concat(labels, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size(labels) > 0, F.lit(1.0)).otherwise(F.coalesce("c", F.lit(0.0))).alias("score"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    words = r"regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    sets = template_sets(TEMPLATES)
    templates = ", ".join(f"({i}, '{x.label}', {x.kind}, {x.words}, {x.tokens!r}, {needed(x.tokens, THRESHOLD)})" for i, x in enumerate(sets))
    kinds = ", ".join(f"({k}, {size}, {step})" for k in sorted({x.kind for x in sets}) for size, step in [block_words(k)])
    return f"""
with d as (select row_number() over () as rid, doc_id, text, list_filter({words}, lambda w: w <> '') as w from documents),
p(phrase, label, size) as (values {phrases}),
t(tid, label, kind, n, toks, need) as (values {templates}),
k(kind, size, step) as (values {kinds}),
hit as (select rid, label, pos from (select rid, label, size, phrase, w, unnest(range(len(w))) as pos from d, p where contains(' ' || array_to_string(w, ' ') || ' ', ' ' || phrase || ' ')) where array_to_string(w[pos + 1:pos + size], ' ') = phrase),
base as (select rid, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list(distinct label) as l from hit group by rid),
block as (select rid, kind, pos, w[pos + 1:pos + size] as b from (select rid, w, kind, size, unnest(range(0, greatest(len(w) - (size - step), 1), step)) as pos from d, k)),
near as (select rid, kind, pos, tid, label, n, toks, b, list_intersect(list_distinct(b), toks) as m, len(list_intersect(list_distinct(b), toks)) / len(toks) as c from block join t using (kind) where len(list_intersect(list_distinct(b), toks)) >= need),
runs as (select *, list_transform(range(1, greatest(len(b) - n + 1, 1) + 1), lambda p: len(list_intersect(list_distinct(b[p:p + n - 1]), toks))) as held from near),
stand as (select *, list_filter(range(1, len(held) + 1), lambda p: held[p] = list_max(held)) as spots from runs),
over as (select x.rid, x.kind, x.pos, x.tid, x.n, x.spots, list_filter(range(1, len(x.b) + 1), lambda q: list_contains(x.toks, x.b[q]) and len(list_filter(o.spots, lambda p: p <= q and q < p + o.n)) = 0) as free
  from stand x join stand o using (rid, kind, pos) where len(list_filter(x.m, lambda w: not list_contains(o.m, w))) = 0 and (len(o.m) > len(x.m) or o.c > x.c)),
worse as (select rid, kind, pos, tid from over where len(list_filter(spots, lambda p: len(list_filter(free, lambda q: p <= q and q < p + n)) > 0)) = 0),
best as (select rid, list(distinct label) as l, max(c) as c from near anti join worse using (rid, kind, pos, tid) group by rid)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.l), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.l, []), coalesce(best.l, [])))), ','), '') as labels,
  case when n_base > 0 then 1.0 else coalesce(best.c, 0.0) end::double as score
from d left join base using (rid) left join best using (rid)"""


OP10_SQL = _oracle()
