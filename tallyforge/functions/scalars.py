"""Column functions: verdicts, labels, dates, text clean-up, hashes. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import VERDICT_SCORE, VERDICTS

#: Python's white space, in Java's Unicode mode.
SPACE = r"(?U)\s+"
_MONTH_NAMES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normal_verdict(verdict) -> Column:
    return F.lower(F.trim(c(verdict)))


def valid_verdict(verdict) -> Column:
    return F.coalesce(normal_verdict(verdict).isin(*VERDICTS), F.lit(False))


def verdict_score(verdict, *, strict: bool = True) -> Column:
    """0, 0.5 or 1; an unknown verdict raises, or is null when not strict. Null stays null."""
    v = normal_verdict(verdict)
    out = F.when(v.isNull(), F.lit(None).cast("double"))
    for name, score in VERDICT_SCORE.items():
        out = out.when(v == name, F.lit(score))
    if not strict:
        return out
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown verdict: "), v)).cast("double"))


def usable(status, verdict) -> Column:
    return (c(status) == "ok") & valid_verdict(verdict)


def arm_label(kind, arm, model=None) -> Column:
    """'human', else model/arm, else arm, else 'machine'."""
    blank_to_null = lambda x: F.nullif(F.trim(c(x)), F.lit(""))
    label = blank_to_null(arm) if model is None else F.nullif(F.concat_ws("/", blank_to_null(model), blank_to_null(arm)), F.lit(""))
    return F.when(F.lower(c(kind)) == "human", F.lit("human")).otherwise(F.coalesce(label, F.lit("machine")))


def prefixed_arm(kind, arm, model) -> Column:
    """The label of older tables: 'human', else model/arm whatever the two hold, so an arm with its model has it twice."""
    part = lambda x: F.coalesce(c(x), F.lit(""))
    return F.when(F.lower(c(kind)) == "human", F.lit("human")).otherwise(F.concat(part(model), F.lit("/"), part(arm)))


def event_key(event) -> Column:
    return F.translate(F.lower(F.trim(c(event))), "_", "-")


def to_float(value) -> Column:
    """A double, with blank, malformed and NaN as null."""
    number = F.trim(c(value)).try_cast("double")
    return F.when(~F.isnan(number), number)


def iso_day(value) -> Column:
    """The date in the first ten characters, or null."""
    return F.try_to_date(F.substring(c(value), 1, 10), "yyyy-MM-dd")


def parse_date(value) -> Column:
    """'2015-04-25...', '25 Apr 2015', '25 April 2015' or '2015/04/25' as ISO text, else null."""
    s = F.trim(c(value))
    iso = F.nullif(F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    words = [F.date_format(F.try_to_date(s, f), "yyyy-MM-dd") for f in ("d MMM yyyy", "d MMMM yyyy", "yyyy/M/d")]
    return F.coalesce(iso, *words)


def range_bound(value, *, end_of_day: bool = False) -> Column:
    """A bare date as the start of its day, or its last second; a full timestamp unchanged."""
    v = F.trim(c(value))
    clock = "T23:59:59+00:00" if end_of_day else "T00:00:00+00:00"
    return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(v, F.lit(clock))).otherwise(v)


def slug(text, max_len: int = 60) -> Column:
    """Lower case, runs of other than letters and digits as one dash, cut, 'item' when nothing is left."""
    dashed = F.btrim(F.regexp_replace(F.lower(c(text)), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.rtrim(F.substring(dashed, 1, max_len), F.lit("-")), F.lit("")), F.lit("item"))


def safe_id(text, max_len: int = 90) -> Column:
    s = slug(text, max_len)
    return F.when(s == c(text), s).otherwise(F.concat(s, F.lit("-"), F.substring(sha256(text), 1, 8)))


def sha256(text) -> Column:
    return F.sha2(c(text), 256)


def stable_json(*names: str) -> Column:
    """JSON with sorted keys, for hashing a record."""
    return F.to_json(F.struct(*sorted(names)))


def cut_head(text, max_chars: int = 20_000, marker: str = "\n[...truncated...]") -> Column:
    t = c(text)
    return F.when(F.char_length(t) > max_chars, F.concat(F.substring(t, 1, max_chars), F.lit(marker))).otherwise(t)


def cut_middle(text, max_chars: int) -> Column:
    """Head of 80 % and tail of 20 % with the omitted count between."""
    t, head = c(text), int(max_chars * 0.8)
    n = F.char_length(t)
    middle = F.concat(F.lit("\n\n[... "), (n - max_chars).cast("string"), F.lit(" characters omitted from the middle ...]\n\n"))
    return F.when(n > max_chars, F.concat(F.substring(t, 1, head), middle, F.right(t, F.lit(max_chars - head)))).otherwise(t)


def collapse(text) -> Column:
    t = F.replace(c(text), F.lit("\r"), F.lit(""))
    t = F.regexp_replace(t, r"[ \t\f\x0B]+\n", "\n")
    t = F.regexp_replace(t, r"[ \t\f\x0B]{2,}", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def clean_title(title, site: str = "ReliefWeb") -> Column:
    """Without the site's suffix and, where it had one, without a trailing ' - Country'."""
    t = F.trim(F.regexp_replace(c(title), SPACE, " "))
    suffix = rf"\s*\|\s*{site}\s*$"
    bare = F.trim(F.regexp_replace(t, suffix, ""))
    country = F.regexp_extract(bare, r"^.*\S\s+[-–]\s+([A-Za-z][A-Za-z ,'()-]{0,40})$", 1)
    short = (country != "") & (F.size(F.split(F.trim(country), r"\s+")) <= 4)
    head = F.regexp_extract(bare, r"^(.*\S)\s+[-–]\s+[A-Za-z][A-Za-z ,'()-]{0,40}$", 1)
    return F.nullif(F.when(t.rlike(suffix) & short, F.trim(head)).otherwise(bare), F.lit(""))


def estimate_tokens(text) -> Column:
    return F.coalesce(F.ceil(F.char_length(c(text)) / F.lit(3.5)), F.lit(0)).cast("long")


def one_line(text) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c(text), F.lit("")), SPACE, " "), "^ | $", ""))


def render_post(label, text) -> Column:
    name = F.coalesce(F.nullif(c(label), F.lit("")), F.lit("unlabelled"))
    return F.concat(F.lit("- ("), F.replace(name, F.lit("_"), F.lit(" ")), F.lit(") "), one_line(text))


def event_title(event) -> Column:
    """cyclone_idai_2019 as 'Cyclone Idai 2019'."""
    part = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))
    return F.array_join(F.transform(F.split(c(event), "_"), part), " ")


def snowflake_time(post_id) -> Column:
    """The UTC timestamp inside a snowflake id; null for ids below 2**32."""
    i = c(post_id).cast("long")
    return F.when(i >= 1 << 32, F.timestamp_millis(F.shiftright(i, 22) + F.lit(1288834974657).cast("long")))


def lenient_json(text) -> Column:
    """JSON from model text as VARIANT: raw, in a fence, from { to }, from [ to ]; null when none parses."""
    t = c(text)
    fence = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    brackets = F.regexp_extract(t, r"(?s)(\[.*\])", 1)
    return F.coalesce(*(F.try_parse_json(F.trim(x)) for x in (t, fence, braces, brackets)))


def score_in_range(score, lo: float = 1.0, hi: float = 10.0) -> Column:
    s = to_float(score)
    return F.when(s.between(lo, hi), s)


def response_status(error, refused, parsed, verdict) -> Column:
    """error, refused, invalid or ok, in this order."""
    return (
        F.when(c(error).isNotNull(), "error").when(c(refused), "refused").when(c(parsed).isNull() | ~valid_verdict(verdict), "invalid").otherwise("ok")
    )


def url_alias(url) -> Column:
    """Path below the host without slashes at its ends."""
    return F.btrim(F.regexp_replace(c(url), r"^https?://[^/]+", ""), F.lit("/"))


def evidence_digest(text) -> Column:
    """Length and hash prefix: evidence never leaves as text."""
    t = F.coalesce(c(text), F.lit(""))
    return F.struct(F.char_length(t).cast("long").alias("chars"), F.when(t != "", F.substring(sha256(t), 1, 8)).otherwise("").alias("sha8"))


def viability(n_in_window, has_coverage, min_in_window: int = 5) -> Column:
    n = c(n_in_window)
    return F.when(~c(has_coverage), "excluded").when(n >= min_in_window, "usable").otherwise("marginal")


def to_epoch(value) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(c(value)))


# File names and publishers.

#: What a publisher's file names hold, in order.
FILENAME_SOURCE_HINTS = (
    ("unicef", "UNICEF"), ("who", "WHO"), ("iom", "IOM"), ("wfp", "WFP"), ("unhcr", "UNHCR"),
    ("mdr", "IFRC"), ("ifrc", "IFRC"), ("dref", "IFRC"), ("rosea", "OCHA"), ("ocha", "OCHA"),
    ("etc ", "WFP"), ("logistics", "WFP"),
)
#: Organisation names in texts, in order; in lower case, as the text is searched in lower case.
SOURCE_PATTERNS = (
    ("un office for the coordination of humanitarian affairs", "OCHA"),
    ("united nations office for the coordination of humanitarian affairs", "OCHA"),
    ("office for the coordination of humanitarian affairs", "OCHA"),
    ("ocha", "OCHA"),
    ("international federation of red cross", "IFRC"),
    ("ifrc", "IFRC"),
    ("world food programme", "WFP"),
    ("unicef", "UNICEF"),
    ("world health organization", "WHO"),
    ("international organization for migration", "IOM"),
    ("unhcr", "UNHCR"),
)


def infer_source(text, title=None, url=None, filename=None) -> Column:
    """The publisher: hints in the file name first, then names in title, url, head and tail of the text."""
    nothing = F.lit(None).cast("string")
    name = F.lower(F.element_at(F.split(c(filename), "/"), -1)) if filename is not None else nothing
    body = F.coalesce(c(text), F.lit(""))
    parts = [F.nullif(p, F.lit("")) for p in (
        c(title) if title is not None else nothing, c(url) if url is not None else nothing, F.substring(body, 1, 1200), F.right(body, F.lit(1200)))]
    hay = F.lower(F.concat_ws(" ", *parts))
    found = [F.when(F.contains(name, F.lit(n)), F.lit(s)) for n, s in FILENAME_SOURCE_HINTS]
    found += [F.when(F.contains(hay, F.lit(n)), F.lit(s)) for n, s in SOURCE_PATTERNS]
    return F.coalesce(*found, F.lit(""))


def _plausible(iso: Column) -> Column:
    y, m, d = (F.split(iso, "-")[i].try_cast("int") for i in range(3))
    return F.when(y.between(2000, 2100) & m.between(1, 12) & d.between(1, 31), iso)


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def date_from_filename(name) -> Column:
    """A date in a file name by ordered patterns; an implausible YYYYMMDD gives null at once."""
    stem = F.regexp_replace(F.element_at(F.split(c(name), "/"), -1), r"(?<=.)\.[^.]*$", "")
    return _bound(stem, lambda st: _bound(F.regexp_replace(st, r"[_\-]+", " "), lambda sp: _stem_date(st, sp)))


_MONTH3 = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
#: Dates in file names, in order. Each has a pattern, the groups of year, month and day, the century of a short
#: year, whether "_" and "-" are read as spaces, and whether the year has to lie in 2015 to 2030.
FILENAME_DATES = (
    (r"(?<!\d)(\d{2})(\d{2})(20\d{2})(?!\d)", (3, 2, 1), "", False, False),
    (r"_(\d{2})(\d{2})(\d{2})(?:[._]|$)", (1, 2, 3), "20", False, False),
    (rf"(?i)(\d{{1,2}})\s*{_MONTH3}[a-z]*\s*(20\d{{2}})", (3, 2, 1), "", True, False),
    (r"(?<!\d)(20\d{2})[ _.-](\d{2})[ _.-](\d{2})(?!\d)", (1, 2, 3), "", False, False),
    (rf"(?i){_MONTH3}[a-z]*\.?\s+(\d{{1,2}})\s*,?\s+(20\d{{2}})", (3, 1, 2), "", True, False),
    (r"(?<![\d])(\d{2})(\d{2})(\d{2})(?![\d\w])", (1, 2, 3), "20", False, True),
    (r"(?<![\d])(\d{2})(\d{2})(\d{2})(?![\d\w])", (3, 2, 1), "20", False, True),
    (r"(?<![\d])(\d{2})(\d{2})(\d{2})(?![\d\w])", (1, 2, 3), "20", False, False),
    (r"(?<![\d])(\d{2})(\d{2})(\d{2})(?![\d\w])", (3, 2, 1), "20", False, False),
)
#: A date of eight digits, which decides at once, and what a title from a file name leaves out.
FILENAME_EIGHT = r"(?<!\d)(20\d{2})(\d{2})(\d{2})(?!\d)"
FILENAME_NOISE = (
    (r"(?<!\d)(20\d{6}|\d{2}\d{2}20\d{2})(?!\d)", " "),
    (r"(?i)\b(final|for upload|compressed|v\d+)\b", " "),
    (r"[_\-]+", " "),
    (r"\s*\(\d+\)\s*$", ""),
    (r"[.\s]{2,}", " "),
)


def _named_date(text: Column, pattern: str, groups: tuple[int, int, int], century: str) -> Column:
    """year-month-day from a pattern's groups, a month by name or number; null without a match."""
    number = F.create_map(*(x for i, m in enumerate(_MONTH_NAMES, 1) for x in (F.lit(m), F.lit(f"{i:02d}"))))
    year, month, day = (F.regexp_extract(text, pattern, g) for g in groups)
    month = F.when(month.rlike("^[0-9]"), month).otherwise(F.try_element_at(number, F.lower(month)))
    return F.when(F.regexp_extract(text, pattern, 0) != "", F.concat_ws("-", F.concat(F.lit(century), year), month, F.lpad(day, 2, "0")))


def _stem_date(stem: Column, spaced: Column) -> Column:
    eight = _named_date(stem, FILENAME_EIGHT, (1, 2, 3), "")
    tries = []
    for pattern, groups, century, spaces, recent in FILENAME_DATES:
        found = _plausible(_named_date(spaced if spaces else stem, pattern, groups, century))
        tries.append(F.when(F.substring(found, 1, 4).cast("int").between(2015, 2030), found) if recent else found)
    return F.when(eight.isNotNull(), _plausible(eight)).otherwise(F.coalesce(*tries, date_in_text(stem)))


def date_in_text(text) -> Column:
    """The first '<day> <Month> <year>' in a text."""
    pattern = r"(?i)(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4})"
    return parse_date(F.initcap(F.regexp_replace(F.replace(F.regexp_extract(c(text), pattern, 1), F.lit("."), F.lit("")), r"\s+", " ")))


def publication_date(text, filename, manifest_date=None) -> Column:
    """Manifest, else file name, else 'as of' in the text (not after 'next report'), else the first date."""
    day = r"\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}"
    said = rf"(?is)(?<!next\s(?:report|update|sitrep).{{0,54}})as\s+of\s+({day})"
    first = parse_date(c(manifest_date)) if manifest_date is not None else F.lit(None).cast("string")
    as_of = F.initcap(F.regexp_replace(F.replace(F.regexp_extract(c(text), said, 1), F.lit("."), F.lit("")), r"\s+", " "))
    return F.coalesce(first, date_from_filename(filename), parse_date(as_of), date_in_text(text))


def title_from_filename(name) -> Column:
    t = F.regexp_replace(F.element_at(F.split(c(name), "/"), -1), r"(?<=.)\.[^.]*$", "")
    for pattern, by in FILENAME_NOISE:
        t = F.regexp_replace(t, pattern, by)
    return F.regexp_replace(F.btrim(t, F.lit(" .-")), r"\s{2,}", " ")


#: Words that name a report, template furniture and file endings.
REPORT_WORDS = ("sitrep", "situation", "flash", "update", "snapshot", "report", "appeal", "bulletin", "dref", "epoa", "response")
BOILERPLATE = (
    "the mission of the united nations office",
    "united nations office for the coordination of humanitarian affairs",
    "coordination saves lives",
    "www.unocha.org",
    "reliefweb.int",
    "microsoft word",
)
FILE_ENDINGS = (".ai", ".indd", ".docx", ".doc", ".pdf", ".pptx")


def informative_title(title) -> Column:
    t = c(title)
    named = F.lower(t).rlike("|".join(REPORT_WORDS))
    return (F.char_length(t) >= 12) & ((F.size(F.split(F.trim(t), SPACE)) >= 3) | named)


def is_boilerplate(line) -> Column:
    t = F.trim(c(line))
    low = F.lower(t)
    marked = low.rlike("|".join(m.replace(".", r"\.") for m in BOILERPLATE))
    return marked | t.rlike(r"^[•\-–*▪●]") | low.rlike("(" + "|".join(e.replace(".", r"\.") for e in FILE_ENDINGS) + ")$")
