"""Personal data by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns and checks and are certain.  For the other kinds wide patterns
propose spans and three labelers vote on each, for, against or not at all: a strict rule on the span itself, a gazetteer
and the words around it.  None of them has proposed the span.  Expectation-maximisation over the counts of vote patterns
estimates how often each labeler is right on personal data and on other spans, and with that how likely each vote
pattern is to mark personal data.  Those probabilities train a naive Bayes classifier on the span's shape and
surroundings, which decides.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, scratch, staged

#: Base kinds in the order of their spans, then those that the method adds.
BASE, ADDED = ("email", "ip", "card", "phone"), ("name", "secret", "ssn", "local", "account")
KINDS = BASE + ADDED
#: Hash buckets of the word before a span and of its shape; they bound the classifier.
BUCKETS = 256
#: Words around a span that count as its context.
BEFORE, AFTER = 4, 2
THRESHOLD = 0.5

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match begins at the first digit of a run: one that fails there fails at each later digit as well.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORDS = re.compile(r"[^\W\d_]+")

#: Gazetteers and cue words (fixed values).
FIRST_NAMES = frozenset(
    """
    James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa
    Daniel Nancy Matthew Betty Anthony Sandra Mark Margaret Donald Ashley Steven Kimberly Andrew Emily Paul Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Melissa
    Jean Marie Pierre Michel Philippe Nathalie Nicolas Isabelle Julien Sophie Claire Camille Hans Klaus Peter Wolfgang Ursula Monika Petra Stefan Andreas Sabine Jürgen
    Anna Maria José Juan Carlos Carmen Luis Antonio Ana Javier Manuel Francisco Lucía Pablo Sofia Lucas Marco Giulia Luca Francesca Ivan Olga Natalia Wei Li Yuki Hiroshi
    Mohammed Fatima Ahmed Ali Aisha Omar Priya Raj Sanjay Anita
    """.split()
)
#: Words that begin sentences and headings, or name months, days and places, in the languages of the names above.
COMMON_WORDS = frozenset(
    """
    the a an of and or in on at to for with by from this that these those it he she we they you i his her our their is are was were be as than but not no if when where who
    what which how all some more other new first last one two three der die das ein eine und oder im am zu mit von den dem des ist war wie nicht le la les un une et ou en au
    aux du de que qui est sont pour par sur dans el los las y o del al su se es son para por con como no más january february march april may june july august september october
    november december monday tuesday wednesday thursday friday saturday sunday street road avenue city university institute company north south east west united states
    """.split()
)
TITLES = frozenset("mr mrs ms miss dr prof herr frau monsieur madame mme señor señora sir dear".split())
SECRET_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "AKIA", "ASIA", "AIza", "ya29", "sk-", "sk_live_", "sk_test_", "rk_live_", "xoxb-", "xoxp-", "xoxa-", "xoxs-", "eyJ", "npm_", "pypi-", "hf_", "dop_v1_", "shpat_", "SG")
#: Social security numbers that were printed as samples, and area codes that belong to services.
SAMPLE_SSN = frozenset(("078-05-1120", "219-09-9999", "123-45-6789"))
SERVICE_CODES = frozenset("211 311 411 511 611 711 811 911 555 800 833 844 855 866 877 888 900".split())
#: Lengths of bank account numbers by country.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
CUES = {
    "name": "name mr mrs ms dr dear signed by sincerely regards author contact herr frau monsieur madame", "secret": "token key secret password passwd pwd auth bearer api credential",
    "ssn": "ssn social security", "local": "call phone tel fax mobile contact cell", "account": "account acct iban bank customer konto compte cuenta",
}
COUNTER_CUES = frozenset("page pages vol version isbn issn figure table section chapter total year id commit checksum sha md5 digest hash order invoice part model".split())
_CUES = {k: frozenset(v.split()) for k, v in CUES.items()}

#: What proposes spans: wide patterns, none of which uses what the labelers know.
_CAPITAL = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
_ADDED = {
    "name": re.compile(rf"(?<![^\W\d_]){_CAPITAL}(?: (?:[A-Z]\. )?{_CAPITAL})++(?![^\W\d_])"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"),
    "local": re.compile(r"(?<![0-9+)(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "account": re.compile(r"(?<![0-9A-Za-z.+-])(?:[0-9]{8,12}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their @: the part before it is the run of its characters, as far as the match before allows."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free if found else at + 1))
    return out


def valid(kind: str, found: str) -> bool:
    """The base kinds' check of a match."""
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in found.split("."))
    if kind in ("card", "phone"):
        digits = _digits(found)
        return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15
    return True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """The base spans as (kind, start, end), by kind and start: matches that pass their check."""
    out = [(0, a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(KINDS[kind], m.group())]
    return out


# -- labelers: each gives + for, - against, 0 for no vote -------------------------------------------------------


def _iban(found: str) -> bool:
    bare = found.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def strict(kind: str, found: str) -> str:
    """A rule on the span itself."""
    if kind == "name":
        words = [w for w in found.split() if not w.endswith(".")]
        return "+" if 2 <= len(words) <= 3 and len(set(words)) == len(words) and min(map(len, words)) > 2 else "-"
    if kind == "secret":
        return "+" if re.fullmatch(r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})", found) or len(set(found)) >= 14 else "-"
    digits = _digits(found)
    if kind == "ssn":
        return "-" if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else "+"
    if kind == "local":
        return "+" if digits[0] >= "2" and digits[3] >= "2" else "-"
    if found[0].isalpha():
        return "+" if _iban(found) else "-"
    return "-" if re.fullmatch(r"(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{0,4}", found) or len(set(found)) < 3 else "0"


def listed(kind: str, found: str, names: frozenset[str]) -> str:
    """What lists know of the span; `names` are first names."""
    if kind == "name":
        words = found.split()
        return "+" if words[0] in names else "-" if any(w.lower() in COMMON_WORDS for w in words) else "0"
    if kind == "secret":
        return "+" if found.startswith(SECRET_PREFIXES) else "-" if found.count("/") > 1 or re.fullmatch(r"[a-z]+(?:[-_/][a-z]+)+[-_/]?[0-9]+", found) else "0"
    if kind == "ssn":
        return "-" if found.replace(" ", "-") in SAMPLE_SSN else "+" if int(_digits(found)[:3]) <= 772 else "-"
    if kind == "local":
        return "-" if _digits(found)[:3] in SERVICE_CODES else "0"
    if found[0].isalpha():
        return "+" if IBAN_LENGTHS.get(found[:2]) == len(found.replace(" ", "")) else "-"
    return "0"


def context(kind: str, before: list[str], after: list[str]) -> str:
    """What the words around a span say."""
    near = {*before, *after}
    return "+" if near & _CUES[kind] else "-" if near & COUNTER_CUES else "0"


def traits(found: str, before: list[str]) -> list[str]:
    """What the final classifier sees of a span."""

    def bucket(text: str) -> int:
        return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % BUCKETS

    n = len(found)
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c for c in found))
    return [f"w{bucket(before[-1] if before else '')}", f"l{min(8, n.bit_length())}", f"d{10 * len(_digits(found)) // n}", f"s{bucket(shape)}", f"k{len(set(found)) * 4 // n}"]


class _Around:
    """A text's words and where they are, found once, for the context of any span."""

    def __init__(self, text: str):
        self.text = text
        found = [m.span() for m in _WORDS.finditer(text)]
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]

    def words(self, start: int, end: int) -> tuple[list[str], list[str]]:
        """The last words that end before a span, and the first ones that begin after it, in lower case."""
        i, j = bisect_right(self.ends, start), bisect_left(self.starts, end)
        cut = lambda a, b: [self.text[self.starts[k] : self.ends[k]].lower() for k in range(a, b)]
        return cut(max(0, i - BEFORE), i), cut(j, min(len(self.starts), j + AFTER))


def union(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Spans as the starts and ends of their union, both sorted."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def proposals(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the added kinds that meet no base span, as (kind, start, end)."""
    starts, ends = union((a, b) for _, a, b in base)
    out = []
    for kind, pattern in _ADDED.items():
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == "name":  # a title before a name is not part of it
                words = m.group().split(" ")
                titles = next((k for k, w in enumerate(words) if w.lower() not in TITLES), len(words))
                if len(words) - titles < 2:
                    continue
                a += sum(len(w) + 1 for w in words[:titles])
            k = bisect_right(ends, a)
            if k == len(starts) or starts[k] >= b:
                out.append((KINDS.index(kind), a, b))
    return out


def propose(text: str, names: frozenset[str] = FIRST_NAMES) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str, list[str]]]]:
    """The base spans (kind, start, end), and all spans of the added kinds with their votes and traits.  Linear in the text but for sorting."""
    base = base_spans(text)
    found = proposals(text, base)
    around, candidates = _Around(text) if found else None, []
    for kind, a, b in found:
        span, (before, after) = text[a:b], around.words(a, b)
        votes = strict(KINDS[kind], span) + listed(KINDS[kind], span, names) + context(KINDS[kind], before, after)
        candidates.append((kind, a, b, votes, traits(span, before)))
    return base, candidates


# -- expectation-maximisation and the classifier ----------------------------------------------------------------

#: What is taken to have been seen before any vote: a labeler's right and wrong votes on either class, and spans of personal data and others.
PRIOR_VOTES, PRIOR_SPANS = (6.0, 1.0), (3.0, 7.0)
#: A labeler is right more often than not, and never certain.
LEAST_RIGHT, MOST_RIGHT = 0.55, 0.99


def reliabilities(counts: dict[str, float], rounds: int = 100) -> tuple[dict[str, float], list[tuple[float, float]]]:
    """EM over vote patterns of one kind -> the probability of personal data for each pattern, and each labeler's rates.

    The rates are how often a labeler that votes is for personal data, and against other spans; given what the span is,
    labelers vote independently, and whether one abstains says nothing.  A labeler that was never both for and against
    can't be judged and keeps the rates it is taken to have.
    """
    right = PRIOR_VOTES[0] / sum(PRIOR_VOTES)
    rates = [(right, right)] * 3
    varied = [{"+", "-"} <= {p[k] for p in counts} for k in range(3)]
    share = PRIOR_SPANS[0] / sum(PRIOR_SPANS)
    posterior: dict[str, float] = {}
    total = sum(counts.values())
    for _ in range(rounds):
        for pattern in counts:
            odds = math.log(share / (1 - share))
            for (yes, no), v in zip(rates, pattern, strict=True):
                odds += math.log(yes / (1 - no)) if v == "+" else math.log((1 - yes) / no) if v == "-" else 0.0
            posterior[pattern] = 1 / (1 + math.exp(-max(-50, min(50, odds))))
        share = (sum(posterior[p] * n for p, n in counts.items()) + PRIOR_SPANS[0]) / (total + sum(PRIOR_SPANS))
        for k in range(3):
            if varied[k]:
                cast = [[sum((posterior[p] if c == 0 else 1 - posterior[p]) * n for p, n in counts.items() if p[k] == v) for v in "+-"] for c in range(2)]
                found = (cast[0][0] + PRIOR_VOTES[0]) / (sum(cast[0]) + sum(PRIOR_VOTES)), (cast[1][1] + PRIOR_VOTES[0]) / (sum(cast[1]) + sum(PRIOR_VOTES))
                rates[k] = tuple(min(MOST_RIGHT, max(LEAST_RIGHT, x)) for x in found)
    return posterior, rates


def fit(candidates: DataFrame) -> dict[int, dict[str, float]]:
    """Rows with an array `found` of candidates -> per kind the classifier's log odds of traits, and "" for its prior.

    The driver receives one count for each kind, vote pattern and trait: at most 5 * 27 times some hundreds, whatever
    the number of documents.
    """
    one = candidates.select(F.explode("found").alias("c")).select("c.kind", "c.votes", F.explode(F.concat(F.array(F.lit("")), F.col("c.traits"))).alias("trait"))
    seen: dict[int, dict[tuple[str, str], int]] = {}
    for row in one.groupBy("kind", "votes", "trait").agg(F.count("*").alias("n")).collect():
        seen.setdefault(row["kind"], {})[row["votes"], row["trait"]] = row["n"]
    return {kind: classifier(counts) for kind, counts in seen.items()}


def classifier(counts: dict[tuple[str, str], int]) -> dict[str, float]:
    """Counts of (vote pattern, trait), "" for all spans of a pattern -> naive Bayes weights, trained on the patterns' probabilities."""
    patterns = {v: n for (v, trait), n in counts.items() if trait == ""}
    likely, _ = reliabilities(patterns)
    yes = sum(likely[v] * n for v, n in patterns.items())
    no = sum(patterns.values()) - yes
    weights = {"": math.log((yes + 0.5) / (no + 0.5))}
    by_trait: dict[str, list[float]] = {}
    for (v, trait), n in counts.items():
        if trait:
            own = by_trait.setdefault(trait, [0.0, 0.0])
            own[0] += likely[v] * n
            own[1] += (1 - likely[v]) * n
    for trait, (p, q) in by_trait.items():
        weights[trait] = math.log((p + 0.5) / (yes + 1)) - math.log((q + 0.5) / (no + 1))
    return weights


def decide(model: dict[int, dict[str, float]], kind: int, found: list[str]) -> bool:
    """Whether the classifier takes a candidate of an added kind."""
    weights = model.get(kind)
    return weights is not None and weights[""] + sum(weights.get(t, 0.0) for t in found) > math.log(THRESHOLD / (1 - THRESHOLD))


# -- tables -----------------------------------------------------------------------------------------------------


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_CANDIDATE = "array<struct<kind:int,start:int,end:int,votes:string,traits:array<string>>>"
_ROW = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE], ("base", pa.string()), ("found", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string()), ("traits", pa.list_(pa.string()))])))])


def candidates(docs: DataFrame, names: frozenset[str] = FIRST_NAMES) -> DataFrame:
    """Rows (doc_id, text) -> doc_id, the base counts, the base spans as text, and all candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: dict[str, list] = {name: [] for name in _ROW.names if name != "doc_id"}
            for text in rows.column("text"):
                base, found = propose(text.as_py() or "", names)
                for k, name in enumerate(BASE):
                    out[f"n_{name}"].append(sum(x[0] == k for x in base))
                out["base"].append(written(base))
                out["found"].append([dict(zip(("kind", "start", "end", "votes", "traits"), x, strict=True)) for x in found])
            yield batch({"doc_id": rows.column("doc_id")} | out, _ROW)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {', '.join(f'n_{k} long' for k in BASE)}, base string, found {_CANDIDATE}")


def find(docs: DataFrame, names: Iterable[str] = FIRST_NAMES) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, n_spans, base_sha256, spans.

    Base spans follow fixed patterns and checks; the classifier adds spans of the kinds name, secret, ssn, local and
    account.  names: the gazetteer of first names.  Defined cases: a null or empty text has no spans; a null doc_id
    stays null; rows that share a doc_id are judged each; other columns are ignored; an empty table gives no rows.  Every
    scan is linear in the text's length.
    """
    rows = staged(candidates(docs, frozenset(names)), "spans")
    model = fit(rows)
    schema = pa.schema([*[f for f in _ROW if f.name not in ("base", "found")], ("n_spans", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            base = part.column("base").to_pylist()
            spans = []
            for own, found in zip(base, part.column("found").to_pylist(), strict=True):
                added = [(c["kind"], c["start"], c["end"]) for c in found if decide(model, c["kind"], c["traits"])]
                spans.append(",".join(x for x in (own, written(added)) if x))
            columns = {name: part.column(name) for name in schema.names if name in part.schema.names}
            yield batch(columns | {"n_spans": [x.count(",") + 1 if x else 0 for x in spans], "base_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in base], "spans": spans}, schema)

    return rows.mapInArrow(run, f"doc_id long, {', '.join(f'n_{k} long' for k in BASE)}, n_spans long, base_sha256 string, spans string")


def mask_text(text: str, model: dict[int, dict[str, float]], names: frozenset[str] = FIRST_NAMES) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    base, found = propose(text, names)
    spans = sorted([(a, b, k) for k, a, b in base] + [(a, b, k) for k, a, b, _, t in found if decide(model, k, t)])
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, names: Iterable[str] = FIRST_NAMES) -> DataFrame:
    """docs with personal data masked in `text`, all rows and columns kept; n_chars, where there is one, follows the new text.

    Defined cases: a null text stays null and an empty one empty; a null doc_id and repeated rows are masked like any
    other; columns of any name stay as they are; an empty table gives no rows.
    """
    known = frozenset(names)
    with scratch(docs.sparkSession):
        model = fit(staged(candidates(docs, known), "spans"))

    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: None if t is None else mask_text(t, model, known))

    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
