"""Personal data by weak supervision; built-in functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. Candidates beyond those are words with a digit
or an at sign, words after a credential and its sign, names after a title or a known given name, two or three capitalised
words, dates with the name of a month, and street addresses. Regex, gazetteer and context labelers vote on each candidate or abstain; expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is and how likely each pattern is personal data; those probabilities train a
logistic span classifier, whose verdict adds spans. Streets without a number and a street word are no candidates; two
capitalised words are a name only by what stands before or after them, a date personal only after a word of birth.
"""

from __future__ import annotations

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import let, running, table

#: Patterns in the order of the kinds. A run of characters of a local part, or of digits, is tried from its start only
#: (or from where the last match ended), and nothing that can't help is tried again, so long runs cost linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Gazetteers (fixed values): titles before a name, given names, street words.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Monsieur Madame"
GIVEN = """
Adam Alan Albert Alice Amanda Amy Andrea Andrew Angela Anna Anne Anthony Antonio Barbara Benjamin Brian Carlos Carol
Caroline Catherine Charles Charlotte Christian Christine Christopher Claire Claudia Daniel David Deborah Diana Dorothy
Edward Elena Elizabeth Emily Emma Eric Eva Francisco Frank Gary George Hannah Hans Heather Helen Henry Isabella Jack
Jacob James Jane Janet Jason Javier Jean Jennifer Jessica Joan John Jonathan Jorge Jose Joseph Joshua Juan Judith Julia
Julie Karen Karl Katherine Kevin Klaus Larry Laura Linda Lisa Lucas Luis Manuel Marco Margaret Maria Marie Mark Martha
Martin Mary Matthew Megan Michael Michelle Miguel Nancy Natalie Nicholas Nicole Olivia Pamela Patricia Patrick Paul Pedro
Peter Philip Pierre Rachel Rebecca Richard Robert Rosa Ruth Samuel Sandra Sarah Scott Sophia Sophie Stefan Stephanie
Stephen Steven Susan Teresa Thomas Timothy Victoria Virginia William
"""
STREETS = "Street St Road Rd Avenue Ave Lane Ln Drive Dr Boulevard Blvd Court Ct Square Way Place Terrace"
#: Names that are no personal data (fixed values); find_spans takes another list.
PUBLIC = [
    "Abraham Lincoln", "Adam Smith", "Agatha Christie", "Albert Camus", "Albert Einstein", "Alexandre Dumas", "Anton Chekhov",
    "Charles Darwin", "Charles Dickens", "Charlotte Bronte", "Charlotte Brontë", "Edgar Poe", "Emily Bronte", "Emily Brontë",
    "Emily Dickinson", "Franz Kafka", "George Eliot", "George Orwell", "George Washington", "Henry James", "Isaac Newton",
    "Jane Austen", "Johann Bach", "John Keats", "John Locke", "Jules Verne", "Karl Marx", "Leo Tolstoy", "Mark Twain",
    "Mary Shelley", "Oscar Wilde", "Robert Frost", "Thomas Hardy", "Thomas Jefferson", "Victor Hugo", "Virginia Woolf",
    "Walt Whitman", "William Blake", "William Shakespeare", "William Wordsworth",
]
#: Capitalised words that open a sentence or an entry and are no part of a name; months (fixed values).
OPENERS = """
A After All An And As Ask At Because Before But By Call Client Contact Customer Dear Employee For From He Her His How I If
In It Its Meet My Name On Our Patient Please Regards She Since Sincerely So Tell Tenant That The Their Then There These
They This Those To We What When Where While Who Why With You Your
"""
MONTHS = "January February March April May June July August September October November December"
EDGE = "\"'`()[]{}<>,;:!?.#*$%&|"
CREDENTIAL = "password|passwd|pwd|secret|token|api_?key|credential"
CONTEXT = "password|passwd|pwd|secret|token|key|login|account|passport|iban|ssn|tel|phone|call|card|email|mail|contact|name|address|street|lives?|born"


def _any_of(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


WORD_START = r"(?<![^\x20\x09-\x0D(\"'])"
CAPITAL = r"[A-Z][a-z\x{C0}-\x{24F}'-]++"
NAME = rf"(?=[A-Z])(?:{_any_of(TITLES)}\.?|{_any_of(GIVEN)})\x20{CAPITAL}(?:\x20{CAPITAL})?+"
ADDRESS = rf"[0-9]{{1,5}}[A-Za-z]?\x20(?:{CAPITAL}\x20){{1,3}}{_any_of(STREETS)}\b\.?"
NUMBERED = r"[A-Z][a-z\x{C0}-\x{24F}]{1,30}?(?:stra(?:ß|ss)e|weg|platz|gasse|allee)\x20[0-9]{1,4}[a-z]?\b"
DATE = rf"(?:[0-9]{{1,2}}\.?\x20{_any_of(MONTHS)}|{_any_of(MONTHS)}\x20[0-9]{{1,2}},?)\x20[0-9]{{4}}\b"
PAIR = rf"(?!{_any_of(OPENERS)}\x20){CAPITAL}(?:\x20(?!{_any_of(GIVEN)}\x20|{_any_of(TITLES)}\b){CAPITAL}){{1,2}}+"
AFTER = rf"(?<=[:=\x20])(?<=[:=]\x20?)(?<=(?:{CREDENTIAL})\x20?[:=]\x20?)[^\x20\x09-\x0D:=][^\x20\x09-\x0D]{{3,}}"
PLAIN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
CANDIDATE = f"(?=[A-Z0-9]){WORD_START}(?:{NAME}|{ADDRESS}|{NUMBERED}|{DATE}|{PAIR})|(?:(?i){AFTER})|{PLAIN}"
STRETCH = 256
MARK = "\x1e"
BEFORE, BEHIND = 48, 24  # characters before and behind a candidate that are its context
#: Context of persons, of births, of works and their authors, of numbers that name a publication.
PERSON_BEFORE = r"(^|[^a-z])(names?|named|(my|his|her|their)\x20name\x20(is|was)|called|call|contact|ask|dear|regards|sincerely|signed|patient|client|customer|employee|tenant|applicant|i\x20am|i'm)[:,]?[\x20\x09-\x0D]+$"
PERSON_BEHIND = r"^,?\x20(lives|lived|resides|phoned|emailed|signed|applied|aged|can\x20be\x20reached|was\x20born)\b"
BIRTH_BEFORE = r"(^|[^a-z])(born|birth|birthday|birthdate|dob|d\.o\.b\.)(\x20(on|is|was|in))?[^a-z0-9]*$"
WORK_BEFORE = r"((novels?|plays?|poems?|essays?|works?|books?|written)\x20(by|of)|novelist|poet|philosopher|economist|composer|painter)\x20$"
WORK_BEHIND = r"^['’]s\x20(novels?|plays?|poems?|essays?|theory|works?|symphony|paintings?)\b|^\x20\(1[0-8][0-9]{2}"
PUBLICATION = r"(^|[^a-z])(isbn|issn|doi|rfc|arxiv)([^a-z]*$|[^a-z]*[0-9])"

#: Facts about a candidate, one bit each; labelers and the classifier see nothing else.
FACTS = ["key_prefix", "hex_run", "credential_word", "assigned", "context", "plain_number", "number_suffix", "long", "upper_digit", "lower_digit", "base_span", "at_sign", "many_digits", "given_name", "title", "street", "after_credential", "national_id", "date", "birth", "publication", "person_before", "person_behind", "public"]
#: What phrases, candidates of several words, have; the others are facts of single words. So the patterns of facts are few.
PHRASE = ["base_span", "given_name", "title", "street", "date", "birth", "person_before", "person_behind", "public", "after_credential"]
WORD = [f for f in FACTS if f not in ("given_name", "title", "street", "person_before", "person_behind", "public")]
ADDED = {"name": ["given_name", "title", "person_before", "person_behind"], "address": ["street"], "birth": ["birth"], "id": ["national_id"], "secret": []}  # kinds of added spans, by facts
#: Labelers: (facts that must hold, facts that must not, vote); otherwise they abstain.
LABELERS = {
    "regex_key": (["key_prefix"], [], 1),
    "regex_hex": (["hex_run"], [], 1),
    "regex_base": (["base_span"], [], 1),
    "regex_national": (["national_id"], [], 1),
    "regex_date": (["date"], ["birth"], 0),
    "regex_number": (["plain_number"], ["birth", "national_id"], 0),
    "regex_suffix": (["number_suffix"], [], 0),
    "regex_digits": (["many_digits"], ["base_span", "upper_digit", "lower_digit", "national_id", "birth"], 0),
    "gazetteer_credential": (["credential_word"], [], 1),
    "context_word": (["context"], ["publication"], 1),
    "context_assigned": (["assigned"], ["publication"], 1),
    "context_birth": (["birth"], [], 1),
    "context_publication": (["publication"], [], 0),
    "context_person_before": (["person_before"], ["public"], 1),
    "context_person_behind": (["person_behind"], ["public"], 1),
    "shape_mixed": (["long", "upper_digit"], ["publication"], 1),
    "shape_plain": ([], ["base_span", "key_prefix", "hex_run", "credential_word", "context", "assigned", "at_sign", "given_name", "title", "street", "after_credential", "national_id", "birth", "person_before", "person_behind"], 0),
    "gazetteer_given": (["given_name"], ["public"], 1),
    "gazetteer_public": (["public"], [], 0),
    "regex_title": (["title"], ["public"], 1),
    "gazetteer_street": (["street"], [], 1),
    "context_credential": (["after_credential"], [], 1),
}
TRUSTED, PRIOR = 0.8, 0.05  # reliability that labelers are held to have beforehand, and the weight of that, as a share of their votes
RIDGE = 0.01  # of the span classifier
#: What the classifier sees: not the base patterns, whose spans stand anyway.
FEATURES = [f for f in FACTS if f != "base_span"]


def _matches(text: Column, regex: str) -> Column:
    """array<struct<start, end, m, before, behind>> of a pattern's matches: code points, text, and what stands around it.

    Matches are set off by MARK and the text is split there, so that it is searched once; a text that holds MARK itself
    is split and searched."""

    def place(parts: Column) -> Column:
        def one(starts: Column) -> Column:
            def match(j: Column) -> Column:
                at, m = F.get(starts, 2 * j + 1), F.get(parts, 2 * j + 1)
                before = F.right(F.concat(F.coalesce(F.get(parts, 2 * j - 1), F.lit("")), F.get(parts, 2 * j)), F.lit(BEFORE))
                return F.struct(at.alias("start"), (at + F.char_length(m)).alias("end"), m.alias("m"), before.alias("before"), F.left(F.get(parts, 2 * j + 2), F.lit(BEHIND)).alias("behind"))

            return F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), match)

        return let(running(F.transform(parts, F.char_length), F.lit(0), lambda x, y: x + y), one)

    def both(found: Column) -> Column:
        return F.flatten(F.transform(F.split(text, regex, -1), lambda p, i: F.when(i < F.size(found), F.array(p, F.get(found, i))).otherwise(F.array(p))))

    none = F.array().cast("array<struct<start:int,end:int,m:string,before:string,behind:string>>")
    once = F.split(F.regexp_replace(text, F.lit(regex), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    parts = F.when(F.contains(text, F.lit(MARK)), let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), both)).otherwise(once)
    return let(parts, lambda p: F.when(F.size(p) > 1, place(p)).otherwise(none))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d * 2 - F.when(d > 4, F.lit(9)).otherwise(F.lit(0))).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.char_length(_digits(m)).between(16, 19) & F.when(F.char_length(_digits(m)).between(16, 19), let(_digits(m), _luhn)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(_digits(m)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>>, by kind as in BASE, then by start. Texts without digit or at sign have none."""

    def spans(kind: str, regex: str) -> Column:
        found = F.filter(_matches(text, regex), lambda x: _valid(kind, x["m"]))
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    kinds = [spans(*x) for x in BASE.items()]
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return F.when(F.regexp_like(text, F.lit("[0-9@]")), F.concat(*kinds)).otherwise(none)


def candidates(text: Column, base: Column, public: list[str] = PUBLIC) -> Column:
    """array<struct<start, end, facts>>: every candidate, without punctuation at its ends, unless it is but a part of a
    base span. Base spans are looked up for STRETCH candidates at a time."""

    def one(x: Column, near: Column) -> Column:
        head = F.char_length(x["m"]) - F.char_length(F.ltrim(x["m"], F.lit(EDGE)))
        bare = F.struct((x["start"] + head).alias("start"), F.btrim(x["m"], F.lit(EDGE)).alias("m"), F.lower(x["before"]).alias("before"), F.lower(x["behind"]).alias("behind"))
        return let(bare, lambda b: facts(b, near))

    def facts(x: Column, near: Column) -> Column:
        m, end = x["m"], x["start"] + F.char_length(x["m"])
        has = lambda regex: F.regexp_like(m, F.lit(regex))
        before, behind = (lambda regex, c=x[c]: F.regexp_like(c, F.lit(regex)) for c in ("before", "behind"))
        national = has(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
        date = has(rf"^([0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2,4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|{DATE})$")
        tests = {
            "key_prefix": has(r"^(AKIA|ASIA|AIza|ghp_|gho_|sk-|xox[abp]-)"),
            "hex_run": has(r"[0-9a-fA-F]{12}") & has("[0-9]") & has("[a-fA-F]"),
            "credential_word": F.regexp_like(F.lower(m), F.lit(CREDENTIAL)),
            "assigned": has(r"[A-Za-z][=:][^\s=:]{6}"),
            "context": before(rf"(^|[^a-z])({CONTEXT})(\x20(is|was|no|nr|number|code))*[^a-z]*$"),
            "plain_number": has(r"^[0-9]{1,6}([.,:/-][0-9]{1,4}){0,2}%?$"),
            "number_suffix": has(r"^[0-9]+[A-Za-z]{1,3}$"),
            "long": F.char_length(m) >= 12,
            "upper_digit": has("[A-Z]") & has("[0-9]"),
            "lower_digit": has("[a-z]") & has("[0-9]"),
            "base_span": F.exists(near, lambda b: (b["start"] < end) & (b["end"] > x["start"])),
            "at_sign": F.contains(m, F.lit("@")),
            "many_digits": F.char_length(_digits(m)) >= 8,
            "given_name": has(rf"^{_any_of(GIVEN)}\x20[A-Z]"),
            "title": has(rf"^{_any_of(TITLES)}\.?\x20[A-Z]"),
            "street": has(rf"^([0-9]{{1,5}}[A-Za-z]?\x20(?:{CAPITAL}\x20){{1,3}}{_any_of(STREETS)}|{NUMBERED})$"),
            "after_credential": before(rf"({CREDENTIAL})(\x20?[:=]\x20?|\x20(is|was)\x20)[^a-z0-9]*$"),
            "national_id": national,
            "date": date,
            "birth": date & before(BIRTH_BEFORE),
            "publication": before(PUBLICATION) | F.regexp_like(F.lower(m), F.lit(PUBLICATION)),
            "person_before": before(PERSON_BEFORE),
            "person_behind": behind(PERSON_BEHIND),
            "public": m.isin(*public) | before(WORK_BEFORE) | behind(WORK_BEHIND),
        }
        bit = lambda names: sum((F.when(tests[f], F.lit(1 << FACTS.index(f))).otherwise(F.lit(0)) for f in names), F.lit(0))
        bits = F.when(F.contains(m, F.lit(" ")), bit(PHRASE)).otherwise(bit(WORD))
        return F.struct(x["start"].alias("start"), end.alias("end"), bits.cast("int").alias("facts"))

    part = lambda x, near: F.exists(near, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]) & ((b["start"] < x["start"]) | (b["end"] > x["end"])))

    def stretch(c: Column) -> Column:
        near = F.filter(base, lambda b: (b["start"] < F.element_at(c, -1)["end"]) & (b["end"] > F.get(c, F.lit(0))["start"]))
        return let(near, lambda n: F.filter(F.transform(c, lambda x: one(x, n)), lambda x: (x["end"] > x["start"]) & ~part(x, n)))

    none = F.array().cast("array<struct<start:int,end:int,facts:int>>")
    cut = lambda found: F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / STRETCH).cast("int")), lambda j: let(F.slice(found, j * STRETCH + 1, F.lit(STRETCH)), stretch))
    return let(_matches(text, CANDIDATE), lambda found: F.when(F.size(found) > 0, F.flatten(cut(found))).otherwise(none))


def votes(facts: np.ndarray) -> np.ndarray:
    """A row for each pattern of facts, a column for each labeler: 1, 0, or -1 if it abstains."""
    bit = lambda f: (facts >> FACTS.index(f)) & 1 == 1
    out = np.full((len(facts), len(LABELERS)), -1)
    for j, (yes, no, vote) in enumerate(LABELERS.values()):
        out[np.logical_and.reduce([bit(f) for f in yes] + [~bit(f) for f in no]), j] = vote
    return out


def estimate(v: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: (probability of class 1 for each pattern, reliability of each labeler).

    A labeler that votes is right with its reliability, whatever the class, and independently of the others; abstaining
    says nothing, and before any vote both classes are as likely. EM starts from the share of votes for 1. A reliability
    is at least one half; it is learnt from candidates that another labeler votes on too, or whose class is known, and is
    held to be TRUSTED beforehand, with a weight of PRIOR of those and of ten more. Patterns in known are class 1."""
    yes, no = v == 1, v == 0
    p = np.where(known, 1.0, (yes.sum(1) + 0.5) / (yes.sum(1) + no.sum(1) + 1))
    told = counts * (known | ((yes | no).sum(1) > 1))
    cast = (told[:, None] * (yes | no)).sum(0)
    weight = PRIOR * cast + 10
    right = np.full(v.shape[1], TRUSTED)
    for _ in range(rounds if len(v) else 0):
        agreed = (told[:, None] * (yes * p[:, None] + no * (1 - p[:, None]))).sum(0)
        right = np.clip((agreed + TRUSTED * weight) / (cast + weight), 0.5, 0.999)
        odds = (yes * 1.0 - no) @ np.log(right / (1 - right))
        p = np.where(known, 1.0, 1 / (1 + np.exp(-np.clip(odds, -50, 50))))
    return p, right


def train(facts: np.ndarray, counts: np.ndarray) -> tuple[float, dict[str, float]]:
    """Bias and weights of a logistic classifier over FEATURES, fitted by Newton steps to EM's probabilities.

    It learns from the candidates that no base span covers, as it judges only those."""
    free = (facts >> FACTS.index("base_span")) & 1 == 0
    p, _ = estimate(votes(facts), counts, ~free)
    facts, counts, p = facts[free], counts[free], p[free]
    x = np.stack([np.ones(len(facts)), *[(facts >> FACTS.index(f)) & 1 for f in FEATURES]], 1).astype(float)
    w = np.zeros(x.shape[1])
    scale = np.sqrt(counts)  # so that a rare kind of candidate is learnt beside frequent ones
    for _ in range(30 if len(facts) else 0):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (scale * (p - s)) - RIDGE * w
        w = w + np.linalg.solve((x * (scale * s * (1 - s))[:, None]).T @ x + RIDGE * np.eye(len(w)), gradient)
    return float(w[0]), dict(zip(FEATURES, map(float, w[1:]), strict=True))


def find_spans(docs: DataFrame, name: str = "spans", public: list[str] = PUBLIC) -> DataFrame:
    """docs(doc_id, text, ...) with a column `name`: array<struct<kind, start, end>>, code points, end exclusive.

    Base spans come first, by kind and start; then the added ones, which never overlap a base span. The labelers learn
    from the candidates of all documents: one row for each pattern of facts that occurs, 2^18 + 2^10 at most,
    reaches the driver. Added spans are of the kinds of ADDED; names in public, a bounded list, are of none. Null and empty
    texts have no spans; rows are judged alone, so nulls and repeated rows keep their row; other columns pass through; a
    column of that name is replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn("_b", base_spans(text))
    patterns = found.select(F.explode_outer(candidates(text, F.col("_b"), public))).select("col.facts").where("facts is not null").groupBy("facts").agg(F.count("*").alias("n")).collect()
    bias, weights = train(np.array([r["facts"] for r in patterns], int), np.array([r["n"] for r in patterns], float))
    on = lambda x, f: F.shiftright(x["facts"], FACTS.index(f)).bitwiseAND(F.lit(1))
    margin = lambda x: sum((on(x, f) * F.lit(w) for f, w in weights.items()), F.lit(bias))
    more = F.filter(candidates(text, F.col("_b"), public), lambda x: (on(x, "base_span") == 0) & (margin(x) > 0))
    kind = lambda x: F.coalesce(*[F.when(sum((on(x, f) for f in facts), F.lit(0)) > 0, F.lit(k)) for k, facts in ADDED.items() if facts], F.lit("secret"))
    more = F.transform(more, lambda x: F.struct(kind(x).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return found.withColumn(name, F.concat("_b", more)).drop("_b")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets, as <EMAIL>; of spans that overlap stays the
    name of the first. Texts are put together for STRETCH spans at a time, so many spans cost no more each than a few."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sorted_ = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def stretch(c: Column) -> Column:
        begin = F.get(c, F.lit(0))["after"]
        here = F.substring(text, begin + 1, F.element_at(c, -1)["start"] - begin)
        return let(here, lambda t: F.array_join(F.transform(c, lambda x: F.concat(F.substring(t, x["after"] - begin + 1, x["start"] - x["after"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))), ""))

    def whole(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda x: x["end"]), F.lit(0), lambda x, y: F.greatest(x, y))
        kept = F.filter(F.zip_with(spans, reach, lambda x, r: F.struct(r.alias("after"), x["start"].alias("start"), x["kind"].alias("kind"))), lambda x: x["start"] >= x["after"])
        cut = lambda k: F.transform(F.sequence(F.lit(0), F.floor((F.size(k) - 1) / STRETCH).cast("int")), lambda j: let(F.slice(k, j * STRETCH + 1, F.lit(STRETCH)), stretch))
        last = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(let(kept, lambda k: F.array_join(cut(k), "")), F.substring(text, last + 1, F.char_length(text)))

    found = find_spans(docs, "_spans")
    return found.withColumn("text", F.when(F.size("_spans") > 0, let(sorted_, whole)).otherwise(F.col("text"))).drop("_spans")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    base_named = F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(F.array_join(base_named, ","), 256).alias("base_sha256"), F.array_join(named, ",").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
