"""Main text of web pages: subtrees that recur on many pages of a host are site template and go.

A small parser turns a page into elements and text blocks and hashes every element's subtree. Spark counts the hashes
per host; those found on many of its pages are deleted from every page that has them. Around an article a subtree is
template if it stands by a few different articles of its host, however large that is; inside one, and on pages that mark
none, copies of the text itself recur too, so there it must stand on a share of the host's pages. What can't recur, as
comments, and what a page of a small host has of navigation, forms and adverts is told by its tags and names.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import join_checked, staged, table
from .urls import host_path

MIN_PAGES = 4  # a template subtree stands by so many different texts of its host at least;
MIN_SHARE = 0.05  # inside articles, and on pages without one, also on this share of the host's pages

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "noscript", "template", "iframe", "svg")}
#: Elements that are never main text.
AWAY = frozenset("head nav footer aside form button select dialog menu".split())
#: Parts of class, id or role that tell the same.
AWAY_NAMES = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|newsletter|subscri\w*|signup|side-?bar|complementary|menu|nav\w*|breadcrumbs?|footer|contentinfo|site-?header|masthead|comment\w*|disqus\w*|repl(?:y|ies)|respond|share|sharing|social\w*|related|recommend\w*|pop-?up|modal|overlay|widget|pag(?:er|ination)|toolbar|search|log-?in)(?:[^a-z]|$)", re.I)
CLOSES_P = BLOCK - {"body", "html", "head"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table select article section div main body".split())


@dataclass
class Node:
    tag: str
    names: str
    parent: int
    away: bool
    holds_main: bool = False
    parts: list = field(default_factory=list)  # hashes of blocks and of elements inside, in order
    hash: int = 0


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements in page order, and text blocks as (innermost element, text), white space turned into single spaces."""
    page = page or ""
    nodes, blocks, stack, opened, buffer = [Node("", "", -1, False)], [], [0], {}, []
    end = page.rfind(">") + 1

    def flush():
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                blocks.append((stack[-1], text))
                nodes[stack[-1]].parts.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))

    def pop():
        k = stack.pop()
        n = nodes[k]
        opened[n.tag] -= 1
        n.hash = xxhash.xxh3_64_intdigest(f"{n.tag} {n.names} {n.parts}")
        nodes[n.parent].parts.append(n.hash)

    def close(tags: frozenset | set, scope: frozenset) -> None:
        """Ends the innermost open element of tags, with all inside it, unless an element of scope is in between."""
        if any(opened.get(t) for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                tag = nodes[stack[i]].tag
                if tag in tags:
                    while len(stack) > i:
                        pop()
                    return
                if tag in scope:
                    return

    at = 0
    while at < end and (m := TOKEN.search(page, at, end)):
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in RAW and not m[1]:
            closing = None if m[3].endswith("/") else RAW[tag].search(page, at)
            at = page.find(">", closing.end()) + 1 or len(page) if closing else at if m[3].endswith("/") else len(page)
            continue
        if tag == "br":
            buffer.append(" ")
        if tag in BLOCK:
            flush()
        if m[1]:
            close({tag}, frozenset() if tag in BLOCK else BLOCK)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in SELF_CLOSING:
            close(SELF_CLOSING[tag], SCOPE)
        names = " ".join(filter(None, (x for g in NAMES.findall(m[3]) for x in g))) if m[3] else ""
        around = nodes[stack[-1]]
        away = tag in AWAY or bool(names) and tag not in ("body", "html", "main") and AWAY_NAMES.search(names) is not None
        away = away or tag == "header" and not any(nodes[k].tag in ("article", "main") for k in stack)
        nodes.append(Node(tag, names, stack[-1], away or around.away))
        stack.append(len(nodes) - 1)
        opened[tag] = opened.get(tag, 0) + 1
    buffer.append(page[max(at, end) :] if at <= len(page) else "")
    flush()
    while len(stack) > 1:
        pop()
    return nodes, blocks


def roots(nodes: list[Node], blocks: list[tuple[int, str]]) -> set[int]:
    """The elements that hold the main text: the outermost articles with text, else main, else the whole page."""
    filled = {0}
    for k, _ in blocks:
        while k > 0 and k not in filled:
            filled.add(k)
            k = nodes[k].parent
    for tag in ("article", "main"):
        found = {i for i, n in enumerate(nodes) if n.tag == tag and i in filled and not n.away}
        if found:
            return found
    return {0}


def inside(nodes: list[Node], marked: set[int]) -> list[bool]:
    """Of each element, whether it is one of marked or inside one."""
    out = []
    for i, n in enumerate(nodes):
        out.append(i in marked or (n.parent >= 0 and out[n.parent]))
    return out


def candidates(page: str | None) -> tuple[list[int], list[int], int]:
    """Hashes of the subtrees that may be site template, around the article and elsewhere, and of the main text.

    They are block elements, but not those that hold the main text, and in it only boxes, not its paragraphs and
    headings: articles are copied too."""
    nodes, blocks = parse(page)
    top = roots(nodes, blocks)
    article, holds = inside(nodes, top), set()
    dropped = inside(nodes, {i for i, n in enumerate(nodes) if n.away})
    text = "\n".join(t for k, t in blocks if article[k] and not dropped[k])
    for k in top:
        while k >= 0:
            holds.add(k)
            k = nodes[k].parent
    boxes = {"div", "section", "ul", "ol", "dl", "table", "aside", "nav", "figure"}
    none = top == {0}
    if none:  # no article: the page's paragraphs may be template, but not what holds its headline
        article = [False] * len(nodes)
        for i, n in enumerate(nodes):
            k = i
            while n.tag == "h1" and k >= 0:
                holds.add(k)
                k = nodes[k].parent
    found = [(i, n.hash - (1 << 63)) for i, n in enumerate(nodes) if n.parts and i not in holds and n.tag in (boxes if article[i] else BLOCK)]
    around = {h for i, h in found if not none and not article[i]}
    return sorted(around), sorted({h for _, h in found} - around), xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def main_text(page: str | None, templates: list[int] | None) -> str:
    """Text blocks outside of template subtrees and of what is never main text, inside the roots, one a line."""
    nodes, blocks = parse(page)
    gone = {h + (1 << 63) for h in templates or ()}
    top = roots(nodes, blocks)
    dropped = inside(nodes, {i for i, n in enumerate(nodes) if n.away or n.hash in gone})
    keep = inside(nodes, top)
    return "\n".join(t for k, t in blocks if keep[k] and not dropped[k])


def _candidates(batches):
    schema = pa.schema([("key", pa.int64()), ("host", pa.string()), ("around", pa.list_(pa.int64())), ("within", pa.list_(pa.int64())), ("main", pa.int64())])
    for b in batches:
        found = [candidates(x) for x in b.column(2).to_pylist()]
        yield pa.record_batch([b.column(0), b.column(1), *(pa.array([f[k] for f in found], schema.field(k + 2).type) for k in range(3))], schema=schema)


def _packed(batches):
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        packed = [None if x is None else pack(x) for x in b.column(3).cast(pa.binary()).to_pylist()]
        yield pa.record_batch([*b.columns[:3], pa.array(packed, pa.binary())], ["key", "page_id", "url", "packed"])


def _extracted(batches):
    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        pages = [None if x is None else unpack(x).decode("utf-8") for x in b.column(2).to_pylist()]
        text = [main_text(*x) for x in zip(pages, b.column(3).to_pylist(), strict=True)]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])


def template_subtrees(found: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """found(key, host, around, within, main) -> host, subtree, around: those that stand by at least min_pages different
    texts of their host; if not around an article, also on min_share of its pages. Counted text by text first, so a
    subtree of very many pages is spread over tasks."""
    pages = found.groupBy("host").agg(F.count("*").alias("pages"))
    rows = found.select("host", "main", F.explode("around").alias("subtree"), F.lit(True).alias("around")).unionByName(found.select("host", "main", F.explode("within").alias("subtree"), F.lit(False).alias("around")))
    texts = rows.groupBy("host", "subtree", "around", "main").agg(F.count("*").alias("n"))
    counts = texts.groupBy("host", "subtree", "around").agg(F.count("*").alias("texts"), F.sum("n").alias("n")).where(F.col("texts") >= min_pages)
    return counts.join(pages, "host").where(F.col("around") | (F.col("n") >= min_share * F.col("pages"))).select("host", "subtree", "around")


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """pages(page_id, url, html, ...) -> page_id, url, text, n_chars (code points).

    Null, empty and broken html give what text can be found, else an empty one. Pages without a url share an empty
    host. Repeated rows count as pages of their own and come out repeated; other columns are ignored. Each page's few
    template hashes are joined to it by its own key, so pages of one large host don't meet."""
    pages = pages.select("page_id", "url", "html")
    keyed = pages.select(F.xxhash64("page_id", "url", "html").alias("key"), "page_id", "url", "html")
    found = staged(keyed.select("key", host_path(F.col("url"))["host"].alias("host"), "html").mapInArrow(_candidates, "key long, host string, around array<long>, within array<long>, main long"), "subtrees")
    templates = staged(template_subtrees(found, min_pages, min_share), "templates")
    each = found.select("key", "host", F.explode("around").alias("subtree"), F.lit(True).alias("around")).unionByName(found.select("key", "host", F.explode("within").alias("subtree"), F.lit(False).alias("around")))
    gone = join_checked(each, templates, ["host", "subtree", "around"], "inner").groupBy("key").agg(F.collect_set("subtree").alias("templates"))
    ids = dict(pages.dtypes)
    packed = keyed.mapInArrow(_packed, f"key long, page_id {ids['page_id']}, url string, packed binary")
    out = packed.join(gone, "key", "left").select("page_id", "url", "packed", "templates").mapInArrow(_extracted, f"page_id {ids['page_id']}, url string, text string")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
