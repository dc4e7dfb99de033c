"""URL filter: host and path rules, and redirect equivalence that carries decisions to aliases.

Redirects and canonical links are edges between urls. Connected components over them are found by Spark; a component
with a blocked member blocks the members that no rule decides, unless one of its members is explicitly allowed.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import ascii_lower, let, running, staged, table
from .components import connected_components

#: Verdict, host and path of each rule (fixed values).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT = "allow"
TRACKING = "^(utm_[^=]*|fbclid|gclid|ref)="
#: Parts of a page whose tags aren't its own: comments, and elements whose text isn't shown as markup.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{tag}\b.*?(?:</{tag}\s*>|\z)" for tag in ("script", "style", "template", "textarea"))
REFERENCES = {"&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}  # the last one is decoded last


def host_path(url: Column) -> Column:
    """struct(host, path): after the first :// up to /, ? or #, A-Z lower-cased; then up to ? or #. Else both empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return let(rest, lambda r: F.struct(ascii_lower(F.regexp_extract(r, r"^[^/?#]*", 0)).alias("host"), F.regexp_extract(r, r"^[^/?#]*([^?#]*)", 1).alias("path")))


def rule_of(host: Column, path: Column, rules) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, or null. rules: a list of a few hundred at most."""
    none = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")

    def one(verdict: str, h: str, p: str) -> Column:
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        return F.when(fits, F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))

    each = [one(*r) for r in rules]
    return F.greatest(*each) if len(each) > 1 else each[0] if each else none


def canonical(url: Column) -> Column:
    """The form by which urls are the same: no scheme, its port, www., fragment, tracking parameter or trailing slash."""
    rest = F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1), r"(?s)#.*$", "")
    params = F.filter(F.split(F.regexp_extract(rest, r"(?s)\?(.*)$", 1), "&"), lambda x: ~F.regexp_like(x, F.lit(TRACKING)))
    query = F.regexp_replace(F.array_join(params, "&"), "&$", "")
    hp = host_path(url)
    form = F.concat(F.regexp_replace(F.regexp_replace(hp["host"], r"^www\.", ""), ":(80|443)$", ""), F.regexp_replace(hp["path"], r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(hp["host"] != "", form)


def decoded(text: Column) -> Column:
    """text without character references: all numeric ones, and those that attributes need."""

    def one(x: Column) -> Column:
        decimal, hexa = F.regexp_extract(x, "^0*([0-9]{1,7});", 1).try_cast("int"), F.conv(F.regexp_extract(x, "^[xX]0*([0-9a-fA-F]{1,6});", 1), 16, 10).try_cast("int")
        code = F.coalesce(decimal, F.when(F.regexp_like(x, F.lit("^[xX]0*[1-9a-fA-F]")), hexa))
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(known, F.concat(char, F.regexp_replace(x, "^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), x))

    out = let(F.split(text, "&#"), lambda p: F.array_join(F.concat(F.slice(p, 1, 1), F.transform(F.slice(p, F.lit(2), F.size(p)), one)), ""))
    for name, char in REFERENCES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def resolved(base: Column, ref: Column) -> Column:
    """The absolute url of a link on a page; null for links into the page itself and for schemes without //."""
    part = lambda regex, k=0: F.regexp_extract(base, regex, k)
    root, path = part("^[^:/?#]*://[^/?#]*"), part("^[^:/?#]*://[^/?#]*([^?#]*)", 1)
    has = lambda regex: F.regexp_like(ref, F.lit(regex))
    whole = (
        F.when(has("^[A-Za-z][A-Za-z0-9+.-]*://"), ref)
        .when(has("^[A-Za-z][A-Za-z0-9+.-]*:|^#|^$"), F.lit(None).cast("string"))
        .when(has("^//"), F.concat(part("^([^:/?#]*:)", 1), ref))
        .when(root == "", F.lit(None).cast("string"))
        .when(has("^/"), F.concat(root, ref))
        .when(has(r"^\?"), F.concat(root, path, ref))
        .otherwise(F.concat(root, F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", "")), ref))
    )
    return let(whole, without_dots)


def without_dots(url: Column) -> Column:
    """url with the segments . and .. of its path carried out."""
    part = lambda k: F.regexp_extract(url, r"(?s)^([^:/?#]*://[^/?#]*)([^?#]*)(.*)$", k)
    # From the end, a segment stands unless more .. than segments have come since. Some segments together take `need`
    # pending .. away, if there are so many, and leave `more` of their own.
    pair = lambda need, more: F.struct(need, more).cast("struct<need:int,more:int>")
    one = lambda x: pair(F.when(x.isin(".", ".."), 0).otherwise(1), F.when(x == "..", 1).otherwise(0))
    both = lambda a, b: pair(a["need"] + F.greatest(b["need"] - a["more"], F.lit(0)), F.greatest(a["more"] - b["need"], F.lit(0)) + b["more"])

    def fold(p: Column) -> Column:
        pending = running(F.transform(p, one), pair(F.lit(0), F.lit(0)), both)
        stands = F.zip_with(p, pending, lambda x, n: F.when((n["more"] == 0) & ~x.isin(".", ".."), F.concat(F.lit("/"), x)))
        return F.array_join(F.reverse(F.array_compact(stands)), "")

    segments = F.split(part(2), "/")
    path = F.concat(let(F.reverse(F.slice(segments, F.lit(2), F.size(segments))), fold), F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit("")))
    return F.when(F.regexp_like(part(2), F.lit(r"/\.\.?(/|$)")), F.concat(part(1), path, part(3))).otherwise(url)


def page_links(pages: DataFrame) -> DataFrame:
    """from_url, to_url: every canonical link and refresh redirect of each page, absolute, relative to its base."""

    def attr(tag: Column, name: str) -> Column:
        of = lambda value: F.nullif(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*{value}", 1), F.lit(""))
        return F.coalesce(of("\"([^\"]*)\""), of("'([^']*)'"), of("([^\\s\"'>]+)"), F.lit(""))

    def tags(name: str, test: str) -> Column:
        found = F.regexp_extract_all("html", F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))
        return F.filter(found, lambda x: F.regexp_like(x, F.lit(test)))

    canonicals = F.transform(tags("link", r"(?is)\brel\s*=\s*([\"'][^\"']*|)\bcanonical\b"), lambda x: attr(x, "href"))
    refresh = r"(?is)url\s*=\s*['\"]?([^'\"\s]+)"
    redirects = F.transform(tags("meta", r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"), lambda x: F.regexp_extract(decoded(attr(x, "content")), refresh, 1))
    some = pages.where(F.col("url").isNotNull() & F.regexp_like("html", F.lit(r"(?i)canonical|http-equiv\s*=\s*[\"']?refresh")))
    some = some.withColumn("html", F.regexp_replace("html", HIDDEN, " "))
    own_base = decoded(attr(F.get(tags("base", "(?i)href"), F.lit(0)), "href"))
    base = F.when(own_base != "", F.coalesce(resolved(F.col("url"), F.trim(own_base)), F.col("url"))).otherwise(F.col("url"))
    found = some.select(F.col("url").alias("from_url"), base.alias("base"), F.explode(F.concat(F.transform(canonicals, decoded), redirects)).alias("ref"))
    return found.select("from_url", resolved(F.col("base"), F.trim("ref")).alias("to_url")).where("to_url is not null")


def component_verdicts(links: DataFrame, rules) -> DataFrame:
    """links(from_url, to_url) -> node (canonical form), passed (verdict that the rules of its component's urls give)."""
    ends = links.select(canonical(F.col("from_url")).alias("u"), canonical(F.col("to_url")).alias("v"))
    groups = connected_components(ends)
    urls = links.select(F.explode(F.array("from_url", "to_url")).alias("url")).select(canonical(F.col("url")).alias("node"), host_path(F.col("url")).alias("hp"))
    ruled = urls.select("node", rule_of(F.col("hp.host"), F.col("hp.path"), rules)["verdict"].alias("verdict")).where("verdict is not null").distinct()
    decided = groups.join(ruled, "node").groupBy("component").agg(F.min("verdict").alias("passed"))  # allow comes before block
    return groups.join(decided, "component").select("node", "passed")


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """pages(page_id, url, html, ...), redirects(from_url, to_url) -> page_id, url, host, path, rule, verdict.

    A page's own rule decides; else an explicit allow of its component, then a block of it, then DEFAULT. Urls of one
    canonical form are one node. Null urls and urls without :// have an empty host and path and no component; repeated
    rows come out repeated; other columns are ignored."""
    links = page_links(pages.select("url", "html"))
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url").where("from_url is not null and to_url is not null"))
    passed = component_verdicts(staged(links, "links"), rules)
    own = pages.select("page_id", "url", host_path(F.col("url")).alias("hp")).select("page_id", "url", "hp.host", "hp.path")
    own = own.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("node", canonical(F.col("url")))
    out = own.join(passed, "node", "left")
    return out.select("page_id", "url", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "passed", F.lit(DEFAULT)).alias("verdict"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("url")


def _oracle() -> str:
    """The method in SQL: links of the html, their components by recursion, rules of the members."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def host_path_sql(u: str) -> tuple[str, str]:
        rest = f"(case when contains({u}, '://') then substring({u}, strpos({u}, '://') + 3) else '' end)"
        return f"translate(regexp_extract({rest}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"

    def node(u: str) -> str:
        host, path = host_path_sql(u)
        query = f"regexp_replace(array_to_string(list_filter(string_split(regexp_extract(regexp_replace({u}, '#.*$', '', 's'), '\\?(.*)$', 1, 's'), '&'), lambda x: not regexp_matches(x, '{TRACKING}')), '&'), '&$', '')"
        return f"case when {host} <> '' then regexp_replace(regexp_replace({host}, '^www\\.', ''), ':(80|443)$', '') || regexp_replace({path}, '/+$', '') || case when {query} <> '' then '?' || {query} else '' end end"

    def attr(name: str) -> str:
        of = lambda v: f"nullif(regexp_extract(tag, {quote(rf'(?is)\b{name}\s*=\s*' + v)}, 1), '')"
        return f"""coalesce({of('"([^"]*)"')}, {of("'([^']*)'")}, {of("([^\\s\"'>]+)")}, '')"""

    def refs(x: str) -> str:
        code = "case when regexp_matches(y, '^0*[0-9]{1,7};') then regexp_extract(y, '^0*([0-9]{1,7});', 1)::int when regexp_matches(y, '^[xX]0*[1-9a-fA-F][0-9a-fA-F]{0,5};') then ('0x' || regexp_extract(y, '^[xX]0*([0-9a-fA-F]{1,6});', 1))::int end"
        piece = f"case when {code} between 1 and 55295 or {code} between 57344 and 1114111 then chr({code}) || regexp_replace(y, '^[^;]*;', '') else '&#' || y end"
        out = f"(string_split({x}, '&#')[1] || array_to_string(list_transform(string_split({x}, '&#')[2:], lambda y: {piece}), ''))"
        for name, char in REFERENCES.items():
            out = f"replace({out}, '{name}', {quote(char)})"
        return out

    def resolve(base: str, ref: str) -> str:
        root, path = f"regexp_extract({base}, '^[^:/?#]*://[^/?#]*')", f"regexp_extract({base}, '^[^:/?#]*://[^/?#]*([^?#]*)', 1)"
        return f"case when regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.-]*://') then {ref} when regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.-]*:|^#|^$') then null when starts_with({ref}, '//') then regexp_extract({base}, '^([^:/?#]*:)', 1) || {ref} when {root} = '' then null when starts_with({ref}, '/') then {root} || {ref} when starts_with({ref}, '?') then {root} || {path} || {ref} else {root} || case when {path} = '' then '/' else regexp_replace({path}, '[^/]*$', '') end || {ref} end"

    def dots(u: str) -> str:
        part = lambda k: f"regexp_extract({u}, '^([^:/?#]*://[^/?#]*)([^?#]*)(.*)$', {k}, 's')"
        step = "case when x = '.' then a when x = '..' then regexp_replace(a, '/[^/]*$', '') else a || '/' || x end"
        return f"case when regexp_matches({part(2)}, '/\\.\\.?(/|$)') then {part(1)} || list_reduce(list_concat([''], string_split({part(2)}, '/')[2:]), lambda a, x: {step}) || case when string_split({part(2)}, '/')[-1] in ('.', '..') then '/' else '' end || {part(3)} else {u} end"

    host, path = host_path_sql("url")
    ends = {x: node(x) for x in ("f", "t")}
    return f"""
with recursive p as (select row_number() over () as rid, page_id, url, html, coalesce({host}, '') as host, coalesce({path}, '') as path from (select page_id, url, regexp_replace(html, {quote(HIDDEN)}, ' ', 'g') as html from pages)),
b as (select rid, tag, {refs(attr("href"))} as href from (select rid, regexp_extract_all(html, '(?is)<base\\b[^>]*>') as all_tags, list_filter(all_tags, lambda x: regexp_matches(x, '(?i)href'))[1] as tag from p) where tag is not null),
pb as (select p.*, coalesce(case when href <> '' then {dots("(" + resolve("url", "trim(href)") + ")")} end, url) as base from p left join b using (rid) where url is not null and html is not null),
tags as (select url, base, 'link' as kind, unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*>')) as tag from pb union all select url, base, 'meta', unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*>')) from pb),
found as (select url as f, base, trim(case kind when 'link' then {refs(attr("href"))} else regexp_extract({refs(attr("content"))}, {quote(r"(?is)url\s*=\s*['\"]?([^'\"\s]+)")}, 1) end) as ref from tags
  where case kind when 'link' then regexp_matches(tag, {quote(r"(?is)\brel\s*=\s*([\"'][^\"']*|)\bcanonical\b")}) else regexp_matches(tag, {quote(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b")}) end),
whole as (select f, {resolve("base", "ref")} as u from found),
links as (select f, {dots("u")} as t from whole where u is not null),
ends as (select {ends["f"]} as u, {ends["t"]} as v from links),
e as (select u, v from ends where u is not null and v is not null union select v, u from ends where u is not null and v is not null),
reach(a, b) as (select u, u from e union select reach.a, e.v from reach join e on reach.b = e.u),
r(verdict, rhost, rpath) as (values {rules}),
urls as (select f as url from links union select t from links),
ruled as (select {node("url")} as node, max_by(verdict, len(rhost || rpath)) as verdict from (select url, {host} as host, {path} as path from urls), r where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by url),
passed as (select reach.a as node, min(verdict) as passed from reach join ruled on ruled.node = reach.b group by reach.a),
fit as (select rid, max_by(rhost || rpath, len(rhost || rpath)) as rule, max_by(verdict, len(rhost || rpath)) as verdict from p, r where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by rid)
select page_id, host, path, rule, coalesce(verdict, passed, '{DEFAULT}') as verdict from p left join fit using (rid) left join passed on passed.node = {node("p.url")}"""


OP2_SQL = _oracle()
