"""Entities derived from the driver's tables, the same in Spark and in SQL."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import arm_label
from ..functions.textops import spread
from ..operators.judgements import population as _population
from ..session import table

JUDGES = ("j0", "j1", "j2")


def judgements(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    i, u = F.col("event_id"), F.col("user_id")
    said = F.when(F.col("value") < 20, "absent").when(F.col("value") < 50, "partial").otherwise("present")
    verdict = F.when(i % 29 == 0, "").when(i % 31 == 0, "error").when(i % 11 == 0, F.concat(F.lit(" "), F.upper(said), F.lit(" "))).otherwise(said)
    kind = F.when(u % 4 == 0, "human").otherwise("machine")
    return e.select(
        i.alias("_seq"), F.concat(F.lit("e"), F.floor((F.dayofmonth("ts") - 1) / 10).cast("string")).alias("event"), u.cast("string").alias("sitrep_id"),
        F.col("event_type").alias("slot_id"), F.concat(F.lit("j"), (i % 3).cast("string")).alias("judge"), kind.alias("kind"),
        arm_label(kind, F.concat(F.lit("m"), (u % 2).cast("string"))).alias("arm"), verdict.alias("verdict"), F.when(i % 13 == 0, "failed").otherwise("ok").alias("status"),
    )


def population(spark: SparkSession, sf: str) -> DataFrame:
    return _population(judgements(spark, sf))


#: j: all judgement rows; l: the last of each key; p: the population with its score.
J = """j AS (SELECT event_id AS _seq, 'e' || ((day(ts) - 1) // 10)::INT AS event, user_id::VARCHAR AS sitrep_id, event_type AS slot_id,
  'j' || (event_id % 3) AS judge, CASE WHEN user_id % 4 = 0 THEN 'human' ELSE 'machine' END AS kind,
  CASE WHEN user_id % 4 = 0 THEN 'human' ELSE 'm' || (user_id % 2) END AS arm,
  CASE WHEN event_id % 29 = 0 THEN '' WHEN event_id % 31 = 0 THEN 'error' WHEN event_id % 11 = 0 THEN ' ' || upper(said) || ' ' ELSE said END AS verdict,
  CASE WHEN event_id % 13 = 0 THEN 'failed' ELSE 'ok' END AS status
  FROM (SELECT *, CASE WHEN value < 20 THEN 'absent' WHEN value < 50 THEN 'partial' ELSE 'present' END AS said FROM events)),
l AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY event, judge, sitrep_id, slot_id ORDER BY _seq DESC) = 1),
p AS (SELECT * REPLACE (lower(trim(verdict)) AS verdict), CASE lower(trim(verdict)) WHEN 'absent' THEN 0.0 WHEN 'partial' THEN 0.5 ELSE 1.0 END::DOUBLE AS score
  FROM l WHERE status = 'ok' AND lower(trim(verdict)) IN ('absent', 'partial', 'present'))"""
#: Both judges j0 and j1 of every item.
PAIRS = J + """, pp AS (SELECT event, sitrep_id, slot_id, max(verdict) FILTER (WHERE judge = 'j0') AS a, max(verdict) FILTER (WHERE judge = 'j1') AS b
  FROM p WHERE judge IN ('j0', 'j1') GROUP BY ALL)"""


def posts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    text = F.concat(F.col("event_type"), F.lit(" of  "), F.col("value").cast("decimal(10,2)").cast("string"), F.lit("\n"), F.col("props"))
    return e.select(F.col("event_id").alias("post_id"), F.to_date("ts").alias("day"), F.concat(F.col("event_type"), F.lit("_kind")).alias("class_label"), text.alias("text"))


POSTS = """posts AS (SELECT event_id AS post_id, ts::DATE AS day, event_type || '_kind' AS class_label,
  event_type || ' of  ' || value::DECIMAL(10, 2)::VARCHAR || chr(10) || props AS text FROM events)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with a score and two metrics."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spent"))
    c = table(spark, sf, "customer").select(F.col("c_custkey"), F.col("c_mktsegment").alias("event"), F.col("c_acctbal").alias("completeness"))
    return c.join(o, "c_custkey").select(F.col("c_custkey").alias("sitrep_id"), "event", "completeness", F.col("n_orders").cast("double").alias("n_orders"), "spent")


SCORES = """sc AS (SELECT c_custkey AS sitrep_id, c_mktsegment AS event, c_acctbal AS completeness, n_orders::DOUBLE AS n_orders, spent
  FROM customer JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS spent FROM orders GROUP BY 1) o ON c_custkey = o_custkey)"""


def reports(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Orders as reports of their customer: those of the first two priorities are human, the others machine."""
    human = F.col("o_orderpriority") < "3"
    o = table(spark, sf, "orders").filter(human if kind == "human" else ~human)
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("event"), F.to_date("o_orderdate").alias("day"))


REPORTS = """m AS (SELECT o_orderkey AS id, o_custkey AS event, o_orderdate::DATE AS day FROM orders WHERE NOT o_orderpriority < '3'),
h AS (SELECT o_orderkey AS id, o_custkey AS event, o_orderdate::DATE AS day FROM orders WHERE o_orderpriority < '3')"""

#: A last sentence of a report and what it adds, by hand: sourcing, agency, hedge and update labels, as-of dates, figures
#: and figures near a source. Every entry of the lexicons occurs, as do overlaps, near misses in case and a far source.
_NAME, _ACRONYM = "agency_name", "agency_acronym"
VARIANTS = (
    ("All is calm", [], [], [], [], 0, 0, 0),
    ("Aid went out as per the plan", ["as_per"], [], [], [], 0, 0, 0),
    ("Reports indicate heavy loss", ["reports_indicate"], [], [], [], 0, 0, 0),
    ("More data from the field came in", ["data_from"], [], [], [], 0, 0, 0),
    ("Radio said so, citing two witnesses", ["citing"], [], [], [], 0, 0, 0),
    ("Sources: field team", ["source_label"], [], [], [], 0, 0, 0),
    ("Sources say the road is shut", ["sources_say"], [], [], [], 0, 0, 0),
    ("Local authorities report calm", ["authorities_report"], [], [], [], 0, 0, 0),
    ("ACCORDING TO rumours, as reported by witnesses, rain is near", ["according_to", "reported_by"], [], [], [], 0, 0, 0),
    ("Some estimates from the field were revised", ["data_from"], [], ["estimated"], ["revised"], 0, 0, 0),
    ("UN OCHA and UNICEF met", [], [_ACRONYM, _ACRONYM], [], [], 0, 0, 0),
    ("The IFRC, the NDMA and FEMA helped", [], [_ACRONYM, _ACRONYM, _ACRONYM], [], [], 0, 0, 0),
    ("Those who care reach far", [], [], [], [], 0, 0, 0),
    ("The United Nations sent tents", [], [_NAME], [], [], 0, 0, 0),
    ("The World Health Organisation sent kits", [], [_NAME], [], [], 0, 0, 0),
    ("The World Food Programme sent rice", [], [_NAME], [], [], 0, 0, 0),
    ("The Red Crescent sent boats", [], [_NAME], [], [], 0, 0, 0),
    ("Save the Children and Oxfam sent teams", [], [_NAME, _NAME], [], [], 0, 0, 0),
    ("Doctors Without Borders sent nurses", [], [_NAME], [], [], 0, 0, 0),
    ("The Government of Malawi sent pumps", [], [_NAME], [], [], 0, 0, 0),
    ("The National Disaster Management Authority met", [], [_NAME], [], [], 0, 0, 0),
    ("Civil protection and the meteorological service met", [], [_NAME, _NAME], [], [], 0, 0, 0),
    ("The Humanitarian Country Team met", [], [_NAME], [], [], 0, 0, 0),
    ("There is unconfirmed news", [], [], ["unconfirmed"], [], 0, 0, 0),
    ("There is unverified news", [], [], ["unverified"], [], 0, 0, 0),
    ("Losses are yet to be confirmed", [], [], ["not_yet_confirmed"], [], 0, 0, 0),
    ("Losses remain to be confirmed", [], [], ["to_be_confirmed"], [], 0, 0, 0),
    ("All is subject to revision", [], [], ["subject_to_change"], ["revised"], 0, 0, 0),
    ("The loss is approximately half, or approx. half", [], [], ["approximately", "approximately"], [], 0, 0, 0),
    ("The bridge reportedly fell", [], [], ["reportedly"], [], 0, 0, 0),
    ("The bridge allegedly fell", [], [], ["allegedly"], [], 0, 0, 0),
    ("The bridge apparently fell", [], [], ["apparently"], [], 0, 0, 0),
    ("The count is provisional", [], [], ["provisional"], [], 0, 0, 0),
    ("The count is tentative and indicative", [], [], ["tentative", "indicative"], [], 0, 0, 0),
    ("More rain is likely and more wind unlikely", [], [], ["likely"], [], 0, 0, 0),
    ("More rain is possibly near", [], [], ["possibly"], [], 0, 0, 0),
    ("The river could rise", [], [], ["modal_could"], [], 0, 0, 0),
    ("Could it rise in May", [], [], [], [], 0, 0, 0),
    ("The river appears to rise", [], [], ["appears_to"], [], 0, 0, 0),
    ("Half is roughly right", [], [], ["roughly"], [], 0, 0, 0),
    ("There is no official confirmation", [], [], ["no_confirmation"], [], 0, 0, 0),
    ("The figures were revised", [], [], [], ["figures_updated"], 0, 0, 0),
    ("It was previously reported so", [], [], [], ["previously_reported"], 0, 0, 0),
    ("Rain is weak compared to the previous week", [], [], [], ["compared_to_previous"], 0, 0, 0),
    ("This update supersedes all", [], [], [], ["this_update", "supersedes"], 0, 0, 0),
    ("There is no change since Monday", [], [], [], ["no_change"], 0, 0, 0),
    ("Much is new since Monday", [], [], [], ["new_since"], 0, 0, 0),
    ("A correction covers the period", [], [], [], ["correction", "reporting_period"], 0, 0, 0),
    ("See Flash Update No. 7", [], [], [], ["update_number"], 0, 0, 0),
    ("This holds as of today and as at 14:30 hrs", [], [], [], [], 2, 0, 0),
    ("The road to the coast is open and trucks use 4321 pumps", [], [], [], [], 0, 1, 0),
    ("On the road OCHA has 4321 pumps", [], [_ACRONYM], [], [], 0, 1, 1),
)


def report_texts(spark: SparkSession, sf: str) -> DataFrame:
    """A templated report of every order, with figures, dates, hedges and sources; the last sentence varies."""
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.concat(
        F.lit("As of "), F.date_format(d, "d MMMM yyyy"), F.lit(", at least "), F.format_number(k % 9000 + 1000, 0), F.lit(" people were affected in "), F.translate("n_name", "0123456789", "ABCDEFGHIJ"),
        F.lit(", according to OCHA. Figures are preliminary and may change; "), (k % 97).cast("string"), F.lit("% of homes were destroyed.\n"),
        (F.col("o_custkey") % 50).cast("string"), F.lit(" persons died, reported by the Ministry of Health. Some 1."), (k % 9 + 1).cast("string"), F.lit(" million were displaced since the last report. "),
        F.element_at(F.array(*(F.lit(v[0]) for v in VARIANTS)), (k % len(VARIANTS) + 1).cast("int")), F.lit("."),
    )
    return o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(  # 25 nations
        k.alias("id"), F.to_date(d).alias("day"), F.col("n_name").alias("event"), F.when(F.col("o_orderpriority") < "3", "human").otherwise("machine").alias("kind"), text.alias("text"))


def _labels(found: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in found) + "]::VARCHAR[]"


_VARIANTS = ",\n  ".join(f"({i}, '{v[0]}', {', '.join(map(_labels, v[1:5]))}, {v[5]}, {v[6]}, {v[7]})" for i, v in enumerate(VARIANTS))
#: texts with the number v of its last sentence, and variants, what that sentence adds.
TEXTS = f"""variants(v, sentence, sourcing, agencies, hedges, revisions, as_of, figures, sourced) AS (VALUES {_VARIANTS}),
texts AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, n_name AS event, CASE WHEN o_orderpriority < '3' THEN 'human' ELSE 'machine' END AS kind, o_orderkey % {len(VARIANTS)} AS v,
  'As of ' || day(o_orderdate) || ' ' || monthname(o_orderdate) || ' ' || year(o_orderdate) || ', at least ' || (o_orderkey % 9000 + 1000) // 1000 || ',' || lpad(((o_orderkey % 9000 + 1000) % 1000)::VARCHAR, 3, '0')
  || ' people were affected in ' || translate(n_name, '0123456789', 'ABCDEFGHIJ') || ', according to OCHA. Figures are preliminary and may change; ' || o_orderkey % 97 || '% of homes were destroyed.' || chr(10)
  || o_custkey % 50 || ' persons died, reported by the Ministry of Health. Some 1.' || (o_orderkey % 9 + 1) || ' million were displaced since the last report. ' || sentence || '.' AS text
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN variants ON v = o_orderkey % {len(VARIANTS)})"""
#: found: all convention counts of every text, from the fixed part and the last sentence.
FOUND = TEXTS + """, found AS (SELECT id, event, length(text) AS n_chars, len(regexp_extract_all(text, '[^ \\n]+')) AS n_tokens, ['according_to', 'reported_by'] || sourcing AS sourcing, ['agency_acronym', 'agency_name'] || agencies AS agencies,
  ['preliminary', 'modal_may'] || hedges AS hedges, ['since_last_report'] || revisions AS revisions, 1 + as_of AS as_of, 4 + figures AS n_figures, 4 + sourced AS n_sourced FROM texts JOIN variants USING (v))"""


_ASCII = {c: c for c in range(127)}


def pdf_bytes(text: str, title: str, lines_a_page: int = 40) -> bytes:
    """A PDF of a text with white space collapsed: lines of about 90 characters, characters beyond ASCII by a ToUnicode map."""
    lines, size = [[]], 0
    for word in text.split():
        if size > 90:
            lines.append([])
            size = 0
        lines[-1].append(word)
        size += len(word)
    above = sorted({c for c in set(text) if ord(c) > 126})
    other = {c: 128 + i for i, c in enumerate(above[:127])}
    codes = _ASCII | {ord(c): other.get(c, 63) for c in above}
    code = lambda line: re.sub(rb"([()\\\\])", rb"\\\1", " ".join(line).translate(codes).encode("latin-1"))
    sheets = [lines[i : i + lines_a_page] for i in range(0, len(lines), lines_a_page)]
    packed = lambda data: b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(z := zlib.compress(data)), z)
    maps = b"1 begincodespacerange <00> <FF> endcodespacerange " + b"".join(b"1 beginbfchar <%02X> <%s> endbfchar " % (n, c.encode("utf-16-be").hex().encode()) for c, n in other.items())
    found = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(sheets), b" ".join(b"%d 0 R" % (6 + 2 * i) for i in range(len(sheets)))),
             b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding /ToUnicode 4 0 R >>", packed(maps), b"<< /Title (%s) >>" % title.encode("ascii")]
    for i, sheet in enumerate(sheets):
        found.append(b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (7 + 2 * i))
        found.append(packed(b"BT /F1 10 Tf 14 TL 60 780 Td " + b" T* ".join(b"(%s) Tj" % code(line) for line in sheet) + b" ET"))
    data, places = b"%PDF-1.4\n", []
    for number, body in enumerate(found, 1):
        places.append(len(data))
        data += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    rows = b"".join(b"%010d 00000 n \n" % at for at in places)
    return data + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R /Info 5 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(found) + 1, rows, len(found) + 1, len(data))


def pdf_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a PDF file: doc_id and what a reader of files gives."""

    @F.pandas_udf("binary")
    def make(i: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([pdf_bytes(text or "", f"Document {n}") for n, text in zip(i, t, strict=True)])

    d = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))
    return d.select("doc_id", name.alias("path"), name.alias("file"), F.lit("pdf").alias("suffix"), make("doc_id", "text").alias("content"))
