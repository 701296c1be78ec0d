"""Span extraction that needs offsets: figures, lexicon hits, sourced figures. One Arrow pass over a text."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate
from re._parser import parse as parse_pattern

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..schemas import FIGURE, SPANS
from .automaton import ODD_CASE, Finder, Led, Taken, heads, width

# Word lists, scales and patterns of the two figure definitions and the lexicons.

SCALES = {
    "thousand": 1e3, "thousands": 1e3, "million": 1e6, "millions": 1e6, "billion": 1e9, "billions": 1e9,
    "lakh": 1e5, "lakhs": 1e5, "crore": 1e7, "crores": 1e7,
}
CASUALTY_WORDS = (
    "killed", "dead", "death", "deaths", "died", "fatalities", "fatality", "casualties", "casualty",
    "injured", "injuries", "wounded", "missing", "unaccounted",
)
QUANTITY_WORDS = (
    "affected", "displaced", "evacuated", "homeless", "destroyed", "damaged", "people", "persons", "households",
    "families", "children", "beneficiaries", "in need", "food insecure", "sheltered", "reached", "cases", "admitted",
    "hectares", "shelters",
)
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
    "december", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
)
_SCALE = "|".join(sorted(SCALES, key=len, reverse=True))
_MONTH = "|".join(sorted(MONTHS, key=len, reverse=True))
#: Patterns of numbers begin with the digit, which a search finds fast, and then look behind it.
QUANTITY = (
    r"(?P<num>\d(?<![\d.,]\d)(?:\d{0,2}(?:[,\u00a0 ]\d{3})+|\d*(?:\.\d+)?))(?!\d)"
    rf"(?:[\s\u00a0]*(?P<scale>{_SCALE})\b)?(?P<pct>[\s\u00a0]*(?:%|per[\s\u00a0]?cent))?"
)
QUANTITY_DATES = (
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_MONTH})\.?(?:,?\s+\d{{4}})?",
    rf"\b(?:{_MONTH})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?",
    rf"\b(?:{_MONTH})\.?\s+\d{{4}}\b",
)
CLAUSE_BREAKS, CONTEXT = ".;\n", 80
_CAPITAL_MONTH = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
    "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"
)
_DAY = r"\d{1,2}(?:st|nd|rd|th)?"
CONVENTION_DATES = (
    r"\d{4}-\d{2}-\d{2}",
    r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
    rf"\d{{1,2}}\s*[-–]\s*{_DAY}\s+(?:{_CAPITAL_MONTH})\.?(?:,?\s+\d{{4}})?",
    rf"{_DAY}\s+(?:{_CAPITAL_MONTH})\.?(?:,?\s+\d{{4}})?",
    rf"(?:{_CAPITAL_MONTH})\.?\s+{_DAY}(?:,?\s+\d{{4}})?",
    rf"(?:{_CAPITAL_MONTH})\.?\s+\d{{4}}",
    r"\d{1,2}:\d{2}(?:\s*(?:a\.?m\.?|p\.?m\.?|hrs|hours|GMT|UTC))?",
    r"\b(?:in|since|of|for|during|from|until|by|through)\s+(?:19|20)\d{2}\b",
)
REPORT_NUMBERS = (
    r"(?:No\.|Nos\.|#)\s*\d+",
    r"(?:sitrep|situation\s+report|flash\s+update|issue|bulletin|version)\s+\d{1,3}\b",
    r"(?:page|pp?\.)\s*\d+(?:\s*(?:of|/)\s*\d+)?",
)
CONVENTION_FIGURE = r"\d(?<![\w.,\-]\d)(?:\d{0,2}(?:,\d{3})+(?:\.\d+)?|\d*(?:\.\d+)?)"
#: (label, pattern, case sensitive)
ATTRIBUTION = (
    ("according_to", r"according\s+to", False),
    ("as_per", r"\bas\s+per\b", False),
    ("reports_indicate", r"\breports?\s+(?:indicate|suggest|show|state)\w*", False),
    ("reported_by", r"\b(?:as\s+)?reported\s+by\b", False),
    ("data_from", r"\b(?:data|figures?|estimates?|information|statistics|casualty\s+figures?)\s+(?:from|released\s+by|provided\s+by|compiled\s+by|shared\s+by)\b", False),
    ("citing", r"\bcit(?:es|ed|ing)\b", False),
    ("source_label", r"\bsources?\s*:", False),
    ("sources_say", r"\bsources?\s+(?:say|said|report|reported|indicate)\w*", False),
    ("authorities_report", r"\b(?:local|national|government|district|provincial|state|municipal)\s+authorities\s+(?:report|say|estimate|indicate|confirm)\w*", False),
)
AGENCIES = (
    ("agency_acronym", r"\b(?:UN\s+)?OCHA\b", True),
    ("agency_acronym", r"\b(?:UNICEF|WFP|WHO|UNHCR|IOM|UNDP|UNFPA|FAO|UNESCO|UNRWA)\b", True),
    ("agency_acronym", r"\b(?:IFRC|ICRC|MSF|NRC|IRC|CARE)\b", True),
    ("agency_acronym", r"\b(?:INGC|NDMA|NDRRMC|BNPB|DREF)\b", True),
    ("agency_acronym", r"\b(?:ECHO|USAID|FEMA|DFID|FCDO|GDACS|WMO|IPC|ACAPS|IASC|CERF|REACH)\b", True),
    ("agency_name", r"\bunited\s+nations\b", False),
    ("agency_name", r"\bworld\s+health\s+organi[sz]ation\b", False),
    ("agency_name", r"\bworld\s+food\s+program(?:me)?\b", False),
    ("agency_name", r"\bred\s+(?:cross|crescent)\b", False),
    ("agency_name", r"\bsave\s+the\s+children\b|\bworld\s+vision\b|\boxfam\b|\bplan\s+international\b", False),
    ("agency_name", r"\bm[eé]decins\s+sans\s+fronti[eè]res\b|\bdoctors\s+without\s+borders\b", False),
    ("agency_name", r"\bministry\s+of\s+\w+", False),
    ("agency_name", r"\bgovernment\s+of\s+[A-Z]\w+", False),
    ("agency_name", r"\bnational\s+disaster\s+(?:management|risk)\s+\w+", False),
    ("agency_name", r"\bcivil\s+protection\b|\bmeteorolog\w+\s+(?:agency|service|department|institute|office)\b", False),
    ("agency_name", r"\b(?:humanitarian\s+country\s+team|cluster\s+lead)\b", False),
)
HEDGES = (
    ("unconfirmed", r"\bunconfirmed\b", False),
    ("unverified", r"\bunverified\b", False),
    ("not_yet_confirmed", r"\b(?:not\s+yet|yet\s+to\s+be)\s+(?:confirmed|verified|established)\b", False),
    ("to_be_confirmed", r"\bto\s+be\s+confirmed\b|\bTBC\b", False),
    ("subject_to_change", r"\bsubject\s+to\s+(?:change|verification|revision|confirmation)\b", False),
    ("estimated", r"\bestimat(?:e|es|ed|ing|ion|ions)\b", False),
    ("approximately", r"\bapproximately\b|\bapprox\.?(?!\w)", False),
    ("reportedly", r"\breportedly\b", False),
    ("allegedly", r"\ballegedly\b", False),
    ("apparently", r"\bapparently\b", False),
    ("preliminary", r"\bpreliminary\b", False),
    ("provisional", r"\bprovisional\w*\b", False),
    ("tentative", r"\btentative\w*\b", False),
    ("indicative", r"\bindicative\b", False),
    ("likely", r"\blikely\b", False),
    ("possibly", r"\bpossibl[ey]\b|\bpotentially\b", False),
    ("modal_may", r"(?<!\w)may(?!\w)", True),
    ("modal_could", r"(?<!\w)could(?!\w)", True),
    ("appears_to", r"\bappears?\s+to\b|\bseems?\s+to\b", False),
    ("roughly", r"\broughly\b", False),
    ("no_confirmation", r"\bno\s+(?:official\s+)?confirmation\b", False),
)
AS_OF = (
    r"\bas\s+(?:of|at)\s+(?:"
    rf"{_DAY}\s+(?:{_CAPITAL_MONTH})\.?(?:,?\s+\d{{4}})?"
    rf"|(?:{_CAPITAL_MONTH})\.?\s+{_DAY}(?:,?\s+\d{{4}})?"
    r"|\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
    r"|\d{1,2}:\d{2}(?:\s*(?:hrs|hours|GMT|UTC|a\.?m\.?|p\.?m\.?))?"
    r"|today|yesterday|this\s+(?:morning|afternoon|evening|week)"
    r"|the\s+time\s+of\s+(?:writing|reporting|publication))"
)
REVISIONS = (
    ("figures_updated", r"\b(?:figures?|numbers?|totals?|estimates?|data|casualty\s+figures?)\s+(?:have\s+been\s+|has\s+been\s+|were\s+|was\s+)?(?:revised|updated|corrected)\b", False),
    ("revised", r"\brevis(?:ed|ion|ions|es)\b", False),
    ("previously_reported", r"\bpreviously\s+(?:reported|stated|published)\b", False),
    ("compared_to_previous", r"\bcompared\s+(?:to|with)\s+(?:the\s+)?(?:previous|last|earlier)\b", False),
    ("since_last_report", r"\bsince\s+the\s+(?:last|previous)\s+(?:report|update|sitrep)\b", False),
    ("this_update", r"\bthis\s+(?:update|report|sitrep|situation\s+report)\b", False),
    ("supersedes", r"\bsupersedes?\b|\breplaces\s+the\s+previous\b", False),
    ("no_change", r"\b(?:no\s+change|unchanged)\s+(?:since|from)\b", False),
    ("new_since", r"\bnew\s+since\b", False),
    ("correction", r"\bcorrection\b", False),
    ("reporting_period", r"\breporting\s+period\b|\bcovers?\s+the\s+period\b", False),
    ("update_number", r"\b(?:update|sitrep|situation\s+report|flash\s+update)\s+(?:no\.?\s*|#)\s*\d+\b", False),
)
#: Words of the audit's terms that carry no meaning.
AUDIT_STOP = (
    "and", "are", "but", "for", "from", "has", "have", "into", "its", "not", "of", "on", "or", "that", "the", "their",
    "there", "this", "to", "was", "were", "which", "with",
)
NEGATIVE_ONLY = (
    r"(?i)^(?:no (?:information|data|details|figures|specific|relevant)|not (?:reported|mentioned|available)|"
    r"none (?:reported|mentioned)|the (?:posts|source material) (?:do|does) not)"
)

SOURCE_WINDOW = 12
_NUMBER = re.compile(QUANTITY, re.IGNORECASE)
_ANY_CASE = lambda patterns: re.compile("|".join(patterns), re.IGNORECASE)


def _digit_led(pattern: str) -> str:
    """A pattern of a date that begins with digits, beginning with one of them, so that a search looks for that first."""
    border, low, high = re.match(r"(\\b)?\\d\{(\d)(?:,(\d))?\}", pattern).groups()
    least, most = int(low) - 1, int(high or low) - 1
    return r"\d" + (r"(?<!\w\d)" if border else "") + rf"\d{{{least},{most}}}" + pattern[pattern.index("}") + 1 :]


#: What follows the first digit of every one of the dates that begin with digits; it is tested once a digit, before the patterns are.
_AFTER_DIGIT = r"(?=\d{0,3}(?:[-–/:]|(?:st|nd|rd|th)?\s+[-–jfmasond]))"


def _digit_dates(patterns) -> re.Pattern:
    return re.compile(rf"\d{_AFTER_DIGIT}(?:{'|'.join(_digit_led(p)[2:] for p in patterns)})", re.IGNORECASE)


_NUMBER_DATES = Led(_ANY_CASE(QUANTITY_DATES), _digit_dates(QUANTITY_DATES[:3]), _ANY_CASE(QUANTITY_DATES[3:]))
#: What every one of the patterns begins with; it is tested once a place, before the patterns are.
_DATE_HEAD = r"(?=\d|[jfmasond][aepuco][nbrylgptvc]|\b(?:in|since|of|for|during|from|until|by|through)\s)"
_NUMBER_HEAD = r"(?=no|#|si|fl|is|bu|ve|p)"
_BLOCKED = tuple(re.compile(f"{head}(?:{'|'.join(patterns)})", re.IGNORECASE) for head, patterns in ((_DATE_HEAD, CONVENTION_DATES), (_NUMBER_HEAD, REPORT_NUMBERS)))
#: What a date or a report number begins with, whatever its case. Words before a year are found from the year.
_MONTH_HEADS = sorted({m[:3] for m in MONTHS})
_BEFORE_YEARS, _YEAR = ("in", "since", "of", "for", "during", "from", "until", "by", "through"), re.compile(r"(?:19|20)\d{2}\b")


def _before_years(text: str) -> list[int]:
    """Where a word that makes a year a date may begin."""
    out = []
    for year in _YEAR.finditer(text):
        at = end = year.start()
        while end and text[end - 1].isspace():
            end -= 1
        if end < at:
            low = text[max(0, end - 8) : end].lower()
            out += [end - len(w) for w in _BEFORE_YEARS if low.endswith(w)]
    return out


_DATES = Led(
    _BLOCKED[0], _digit_dates(p for p in CONVENTION_DATES if p.startswith(r"\d")), _ANY_CASE(p for p in CONVENTION_DATES if not p.startswith(r"\d")), _before_years
)
_NUMBER_HEADS = ["no.", "nos.", "#", "sitrep", "situation", "flash", "issue", "bulletin", "version", "page", "p.", "pp."]
_PLAIN_FIGURE, _AS_OF, _WORD = re.compile(CONVENTION_FIGURE), re.compile(AS_OF, re.IGNORECASE), re.compile(r"\S+")
#: What an as-of date begins with in a lower-cased text.
_AS_OF_HEAD = re.compile(r"as\s+(?:of|at)\s")


def needles(parsed) -> list[str]:
    """Strings of which every match of a parsed pattern holds one; [] when no such strings are known."""
    found, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        if str(op) == "LITERAL":
            run += chr(arg)
            continue
        if run:
            found.append([run])
        run = ""
        if str(op) == "SUBPATTERN":
            found.append(needles(arg[-1]))
        elif str(op) == "BRANCH":
            parts = [needles(part) for part in arg[1]]
            found.append([n for p in parts for n in p] if all(parts) else [])
    return max(found, key=lambda n: min(map(len, n), default=0), default=[])


def lexicon(entries):
    """(label, pattern, needles in lower case) of every entry."""
    flags = [0 if exact else re.IGNORECASE for _, _, exact in entries]
    return [(label, re.compile(p, flag), [n.lower() for n in needles(parse_pattern(p))]) for (label, p, _), flag in zip(entries, flags, strict=True)]


def _findable(entries):
    """The lexicon with what matches begin with and the most characters that they have."""
    parsed = [parse_pattern(p) for _, p, _ in entries]
    return [(*entry, [h.lower() for h in heads(p)], width(p)) for entry, p in zip(lexicon(entries), parsed, strict=True)]


_LEXICONS = {"attribution": lexicon(ATTRIBUTION), "agency": lexicon(AGENCIES), "hedge": lexicon(HEDGES), "revision": lexicon(REVISIONS)}


_BLOCKED_LEXICONS = {
    name: [(name, pattern, [], begins, width(parse_pattern(whole.pattern)))]
    for name, pattern, whole, begins in zip(("dates", "numbers"), (_DATES, _BLOCKED[1]), _BLOCKED, (_MONTH_HEADS, _NUMBER_HEADS), strict=True)
}
_BLOCKED_FINDER = Finder(_BLOCKED_LEXICONS)
_TERMS = {"attribution": _findable(ATTRIBUTION), "agency": _findable(AGENCIES), "hedge": _findable(HEDGES), "revision": _findable(REVISIONS)}
#: What each count needs; a query that asks for some counts looks for no more.
_FINDER, _TERM_FINDER = Finder({**_TERMS, **_BLOCKED_LEXICONS}), Finder(_TERMS)
_CUE_FINDER = Finder({**{name: _TERMS[name] for name in ("attribution", "agency")}, **_BLOCKED_LEXICONS})
_MONTH_FINDER = Finder({"dates": [("dates", _NUMBER_DATES, [], _MONTH_HEADS, width(parse_pattern(_NUMBER_DATES.whole.pattern)))]})


def lexicon_spans(text: str, entries) -> list[tuple[str, int, int]]:
    """Hits in text order; within a lexicon an earlier entry wins an overlap."""
    taken, found = Taken(), []
    low = text.lower() if text.isascii() else None  # beyond ASCII, ignoring case is more than lower case
    for label, pattern, words in entries:
        if low is not None and words and not any(w in low for w in words):
            continue
        for hit in pattern.finditer(text):
            a, b = hit.span()
            if taken.free(a, b):
                taken.add(a, b)
                found.append((label, a, b))
    return sorted(found, key=lambda s: s[1:])


def lower_same_length(text: str) -> str:
    """Lower case character by character, so that offsets stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x.lower() if len(x.lower()) == 1 else x for x in text)


def quantities(text: str | None) -> list[dict]:
    """Quantity figures: numbers with a scale, a percent sign, a separator or a keyword in their clause.

    Dates and bare years are none. A casualty word in the clause tags every number of it.
    """
    if not text:
        return []
    low, out = lower_same_length(text), []
    dates = [span for i, places in _MONTH_FINDER.places(text, 0).items() for span in _MONTH_FINDER.matches(i, text, places)]
    first = [a for a, _ in dates]
    casualties, others = [w for w in CASUALTY_WORDS if w in low], [w for w in QUANTITY_WORDS if w in low]
    for hit in _NUMBER.finditer(text):
        a, b = hit.span("num")
        i = bisect_right(first, a)
        if i and dates[i - 1][1] >= b:
            continue
        token, scale, percent = hit["num"], (hit["scale"] or "").lower(), bool(hit["pct"])
        if not scale and not percent and len(token) == 4 and token.isdigit() and 1900 <= int(token) <= 2100:
            continue
        start, end = hit.span()
        left, right = max(0, start - CONTEXT), end + CONTEXT
        for x in CLAUSE_BREAKS:
            left = max(left, low.rfind(x, left, start) + 1)
            stop = low.find(x, end, right)
            right = stop if stop >= 0 else right
        clause = low[left:right]
        casualty = next((w for w in casualties if w in clause), None)
        keyword = casualty or next((w for w in others if w in clause), None)
        if not (scale or percent or keyword or any(s in token for s in ",\u00a0 ")):
            continue
        value = float(token.replace(",", "").replace("\u00a0", "").replace(" ", "")) * SCALES.get(scale, 1.0)
        out.append(
            {"value": value, "raw": hit[0].strip(), "unit": "percent" if percent else "count", "kind": "casualty" if casualty else "quantity",
             "keyword": keyword, "start": start, "end": end}
        )
    return out


def longest_token(text: str) -> int:
    return max(map(len, text.split()), default=0)


def convention_figures(text: str, hits: dict | None = None) -> list[tuple[int, int]]:
    """Numbers that touch no date, time or report number; ``hits`` are those of a finder that looked for these, too."""
    hits = _BLOCKED_FINDER.hits(text, longest_token(text)) if hits is None else hits
    blocked = sorted((a, b) for name in _BLOCKED_LEXICONS for _, a, b in hits[name])
    starts, reach = [a for a, _ in blocked], list(accumulate((b for _, b in blocked), max))
    out = []
    for hit in _PLAIN_FIGURE.finditer(text):
        a, b = hit.span()
        i = bisect_right(starts, b - 1)
        if not (i and reach[i - 1] > a):
            out.append((a, b))
    return out


def sourced(text: str, figures, cues, window: int = SOURCE_WINDOW) -> list[bool]:
    """For each figure whether at most ``window`` whole tokens lie between it and some cue."""
    if not figures or not cues:
        return [False] * len(figures)
    begins = [hit.start() for hit in _WORD.finditer(text)]
    token = lambda at: max(0, bisect_right(begins, at) - 1)
    places = sorted((token(a), token(max(a, b - 1))) for _, a, b in cues)
    firsts, reach = [p[0] for p in places], list(accumulate((p[1] for p in places), max))
    out = []
    for a, b in figures:
        i, j = token(a), token(max(a, b - 1))
        k = bisect_right(firsts, j)  # cues that begin at or before the figure's end
        near = bool(k) and i - reach[k - 1] - 1 <= window
        out.append(near or (k < len(firsts) and firsts[k] - j - 1 <= window))
    return out


def terms_of(hits: dict, as_of: int) -> dict[str, int]:
    """How often each term (family:label) occurs."""
    terms: dict[str, int] = {"update:as_of_date": as_of} if as_of else {}
    for family, name in (("sourcing", "attribution"), ("agency", "agency"), ("hedge", "hedge"), ("update", "revision")):
        for label, _, _ in hits[name]:
            key = f"{family}:{label}"
            terms[key] = terms.get(key, 0) + 1
    return terms


def text_stats(text: str | None, window: int = SOURCE_WINDOW) -> dict:
    """All convention counts of one text."""
    text = text or ""
    tokens = text.split()
    hits = _FINDER.hits(text, max(map(len, tokens), default=0))
    as_of = as_of_dates(text)
    figures = convention_figures(text, hits)
    cues = hits["attribution"] + hits["agency"]
    return {
        "n_chars": len(text), "n_tokens": len(tokens), "sourcing_phrases": len(hits["attribution"]), "agency_mentions": len(hits["agency"]),
        "sourcing_cues": len(cues), "hedges": len(hits["hedge"]), "hedge_types": len({s[0] for s in hits["hedge"]}), "as_of_dates": as_of,
        "revision_markers": len(hits["revision"]), "update_markers": as_of + len(hits["revision"]), "n_figures": len(figures),
        "n_figures_with_source": sum(sourced(text, figures, cues, window)), "terms": terms_of(hits, as_of),
    }


def as_of_dates(text: str) -> int:
    if not text.isascii():  # ignoring case is more than lower case
        return sum(1 for _ in _AS_OF.finditer(text))
    n = free = 0
    for head in _AS_OF_HEAD.finditer(text.lower()):
        if head.start() >= free and (hit := _AS_OF.match(text, head.start())):
            n, free = n + 1, hit.end()
    return n


def text_terms(text: str | None) -> dict[str, int]:
    """The terms of ``text_stats`` alone."""
    text = text or ""
    return terms_of(_TERM_FINDER.hits(text, longest_token(text)), as_of_dates(text))


def sourced_figures(text: str | None, window: int = SOURCE_WINDOW) -> int:
    """``n_figures_with_source`` of ``text_stats`` alone."""
    text = text or ""
    hits = _CUE_FINDER.hits(text, longest_token(text))
    return sum(sourced(text, convention_figures(text, hits), hits["attribution"] + hits["agency"], window))


COUNTS = (
    "n_chars", "n_tokens", "sourcing_phrases", "agency_mentions", "sourcing_cues", "hedges", "as_of_dates", "revision_markers",
    "update_markers", "n_figures", "n_figures_with_source",
)
STATS = ", ".join(f"{c} long" for c in (*COUNTS[:6], "hedge_types", *COUNTS[6:])) + ", terms map<string,long>"


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt to all shuffle partitions by a key. Adaptive execution merges small partitions, and then
    one task would read all texts; a number that is given stays."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def figures(text) -> Column:
    kind = to_arrow_type(T._parse_datatype_string(FIGURE))

    @F.arrow_udf(FIGURE)
    def run(s: pa.Array) -> pa.Array:
        return pa.array([quantities(t) for t in s.to_pylist()], kind)

    return run.asNondeterministic()(text)  # else a filter inferred from an explode would run it twice


def spans(text, family: str) -> Column:
    entries = _LEXICONS[family]

    @F.pandas_udf(SPANS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"label": x, "start": a, "end": b} for x, a, b in lexicon_spans(t or "", entries)])

    return run.asNondeterministic()(text)


def stats(text, window: int = SOURCE_WINDOW, *, terms: bool = True) -> Column:
    """All counts of ``text_stats``, with its terms or without."""
    declared = STATS if terms else STATS.rsplit(", ", 1)[0]
    kind = to_arrow_type(T.StructType.fromDDL(declared))

    @F.arrow_udf(declared)
    def run(s: pa.Array) -> pa.Array:
        rows = [text_stats(t, window) for t in s.to_pylist()]
        value = lambda row, f: list(row[f.name].items()) if f.name == "terms" else row[f.name]
        return pa.StructArray.from_arrays([pa.array([value(r, f) for r in rows], f.type) for f in kind], fields=list(kind))

    return run.asNondeterministic()(text)


def figure_count(text) -> Column:
    """n_figures of ``stats`` alone."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([len(convention_figures(t or "")) for t in s], dtype="int64")

    return run(text)


def sourced_count(text, window: int = SOURCE_WINDOW) -> Column:
    """n_figures_with_source of ``stats`` alone."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([sourced_figures(t, window) for t in s], dtype="int64")

    return run(text)


def batch_terms(text) -> Column:
    """(term, n) rows of a batch of texts: the terms of ``stats`` alone, added up within the batch, on its first row."""

    @F.pandas_udf("array<struct<term: string, n: long>>")
    def run(s: pd.Series) -> pd.Series:
        total: dict[str, int] = {}
        for t in s:
            for term, n in text_terms(t).items():
                total[term] = total.get(term, 0) + n
        return pd.Series([[{"term": k, "n": n} for k, n in total.items()], *([[]] * (len(s) - 1))][: len(s)])

    return run.asNondeterministic()(text)


def as_of_count(text) -> Column:
    return F.regexp_count(text, F.lit("(?i)" + AS_OF))


def token_count(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def context(text, start, end, chars: int = 180) -> Column:
    """White space collapsed text around a span."""
    a = F.greatest(F.lit(0), start - chars)
    return F.trim(F.regexp_replace(F.substr(text, a + 1, end + chars - a), r"(?U)\s+", " "))


def audit_terms(text) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9'-]{2,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*AUDIT_STOP)))


def lexical_tokens(text, stop_words=()) -> Column:
    """Words of two letters or more without stop words, then their bigrams."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: (F.char_length(w) > 1) & (~w.isin(*stop_words) if stop_words else F.lit(True)))
    with_pairs = lambda w: F.concat(w, F.slice(F.transform(w, lambda x, i: F.concat_ws("_", x, F.get(w, i + 1))), F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))))
    return F.transform(F.array(kept), with_pairs)[0]


def content_score(body) -> Column:
    """What a section's text can support: 0 without a supporting line, 1 with eight words, else a half."""
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^[\s>*-]+", "")))
    support = F.filter(bare, lambda x: ~x.rlike(NEGATIVE_ONLY))
    words = F.regexp_count(F.array_join(support, " "), F.lit(r"[A-Za-z][A-Za-z'-]*"))
    return F.when(F.size(support) == 0, 0.0).when(words >= 8, 1.0).otherwise(0.5)


def normal_heading(line) -> Column:
    t = F.trim(line)
    for pattern, by in ((r"^\s*#{1,6}\s*", ""), (r"^\s*\*\*(.*?)\*\*\s*$", "$1"), (r"^\s*\d+[.)]\s*", ""), (r"\s*\[[^\]]+\]\s*$", "")):
        t = F.regexp_replace(t, pattern, by)
    return F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))
