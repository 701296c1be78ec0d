"""From saved files and API items to admitted reports with a reason for every one that is not."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .html import html_text, page
from .pdf import read_pdf

MIN_CHARS, SLACK_DAYS = 200, 180


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, file and content of every saved report below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    rows = rows.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), suffix.alias("suffix"), "content")
    return rows.filter(F.col("suffix").isin("html", "htm", "pdf", "txt", "md"))


def _pdf(content):
    """struct<title, text, problem> of PDF bytes: a null text has its reason; pages that could not be read are named."""

    @F.pandas_udf("title string, text string, problem string")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in s:
            try:
                title, pages, problems = read_pdf(bytes(raw))
            except Exception as problem:  # noqa: BLE001  a file that is no PDF does not end the run
                rows.append((None, None, f"unreadable PDF: {problem}"[:200]))
                continue
            rows.append((title or None, "\n\n".join(pages), "; ".join(problems)[:200] or None))
        return pd.DataFrame(rows, columns=["title", "text", "problem"])

    return run(content)


def extract_files(files: DataFrame) -> DataFrame:
    """file, title, date, url and text by suffix: HTML, PDF or plain text; problem says why a text is null."""
    text = F.decode("content", "UTF-8")
    html = files.filter(F.col("suffix").isin("html", "htm")).withColumn("p", page(text))
    html = html.select("file", "path", S.clean_title("p.title").alias("title"), S.parse_date("p.date").alias("date"), "p.url", "p.text", F.lit(None).cast("string").alias("problem"))
    none = F.lit(None).cast("string")
    pdf = files.filter("suffix = 'pdf'").withColumn("p", _pdf("content"))
    pdf = pdf.select("file", "path", "p.title", none.alias("date"), none.alias("url"), S.collapse("p.text").alias("text"), "p.problem")
    plain = files.filter(F.col("suffix").isin("txt", "md")).select("file", "path", none.alias("title"), none.alias("date"), none.alias("url"), S.collapse(text).alias("text"), none.alias("problem"))
    return html.unionByName(pdf).unionByName(plain)


def infer_manifest(extracted: DataFrame, event: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """A manifest row for each file with enough text."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.char_length(x) >= 12)
    line = F.get(lines, F.lit(0))
    from_name = S.title_from_filename("file")
    is_pdf = F.lower("file").endswith(".pdf")
    own = F.when(F.col("title").isNotNull() & ~S.is_boilerplate("title"), F.col("title"))
    title = F.when(is_pdf & S.informative_title(from_name), from_name).otherwise(F.coalesce(own, F.when(~S.is_boilerplate(line), line), from_name))
    rows = extracted.filter(F.char_length("text") >= min_chars)
    return rows.select(
        F.lit(event).alias("event"), title.alias("title"), S.infer_source("text", "title", "url", "file").alias("source"),
        F.coalesce(S.publication_date("text", "file", "date"), F.lit("")).alias("date"), F.coalesce("url", F.lit("")).alias("url"), "file",
    )


def date_windows(days: DataFrame, slack: int = SLACK_DAYS) -> DataFrame:
    """Plausible publication dates of each event, from the days of its stream."""
    return days.groupBy("event").agg(F.date_sub(F.min("day"), slack).alias("lo"), F.date_add(F.max("day"), slack).alias("hi"))


def ingest(manifest: DataFrame, extracted: DataFrame, windows: DataFrame | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every manifest row with id, date, out_file and reason ('' when admitted).

    manifest has _seq and the manifest columns; extracted has file, text and date. A date outside the
    event's window counts as none. Of rows with one id, or one date and text, the first is admitted.
    """
    problem = F.col("problem") if "problem" in extracted.columns else F.lit(None).cast("string")
    text = extracted.select("file", "text", F.col("date").alias("page_date"), F.col("title").alias("page_title"), problem.alias("problem"))
    rows = manifest.join(text, "file", "left").withColumn("event", F.when(F.trim("event") != "", S.slug("event")).otherwise(""))
    rows = rows.withColumn("date", F.coalesce(S.parse_date("date"), S.parse_date("page_date")))
    rows = rows.withColumn("id", F.concat(F.lit("manual-"), S.slug(F.coalesce(F.nullif("url", F.lit("")), F.col("file")), 80)))
    rows = rows.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "page_title", "file"))
    if windows is not None:
        rows = rows.join(windows, "event", "left")
        outside = F.col("lo").isNotNull() & ~F.to_date("date").between(F.col("lo"), F.col("hi"))
        rows = rows.withColumn("date", F.when(~F.coalesce(outside, F.lit(False)), F.col("date"))).drop("lo", "hi")
    early = (
        F.when((F.col("event") == "") | (F.trim("file") == ""), "missing event/file")
        .when(F.col("text").isNull(), F.coalesce("problem", F.lit("file not found")))
        .when(F.char_length("text") < min_chars, F.concat(F.lit("text too short ("), F.char_length("text").cast("string"), F.lit(" chars)")))
    )
    rows = rows.withColumn("early", early)
    same_id = Window.partitionBy("id", F.col("early").isNull()).orderBy("_seq")
    rows = rows.withColumn("id_at", F.row_number().over(same_id)).withColumn("early", F.when(F.col("early").isNull() & (F.col("id_at") > 1), F.concat(F.lit("duplicate id "), F.col("id"))).otherwise(F.col("early")))
    folded = F.lower(F.trim(F.regexp_replace("text", S.SPACE, " ")))
    rows = rows.withColumn("fingerprint", F.sha2(F.concat_ws("|", F.coalesce("date", F.lit("")), folded), 256))
    same_text = Window.partitionBy("fingerprint", F.col("early").isNull()).orderBy("_seq")
    rows = rows.withColumn("text_at", F.row_number().over(same_text)).withColumn("first_file", F.first("file").over(same_text))
    reason = F.when(F.col("early").isNull() & (F.col("text_at") > 1), F.concat(F.lit("duplicate content of "), F.col("first_file"))).otherwise(F.coalesce("early", F.lit("")))
    rows = rows.withColumn("reason", reason)
    stem = F.coalesce("date", F.lit("undated"))
    name = Window.partitionBy("event", stem, F.col("reason") == "").orderBy("_seq")
    rows = rows.withColumn("k", F.row_number().over(name))
    out = F.when(F.col("reason") == "", F.concat(stem, F.when(F.col("k") > 1, F.concat(F.lit("_"), F.col("k").cast("string"))).otherwise(F.lit("")), F.lit(".json")))
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))
    return rows.select("_seq", "event", "id", "title", source.alias("source"), "date", "url", "file", F.char_length("text").alias("chars"), out.alias("out_file"), "reason")


def normalise_items(items: DataFrame) -> DataFrame:
    """API items as flat reports: names joined by '/', the first glide, text from the body or else its HTML."""
    f = items.select(F.coalesce("id", "fields.id").alias("id"), "fields")
    names = lambda c, e: F.array_join(F.filter(F.transform(F.coalesce(c, F.array().cast(c_type[e][0])), c_type[e][1]), lambda x: F.coalesce(x, F.lit("")) != ""), "/")
    c_type = {
        "source": ("array<struct<name:string,shortname:string>>", lambda s: F.coalesce(s["shortname"], s["name"])),
        "format": ("array<struct<name:string>>", lambda s: s["name"]),
        "language": ("array<struct<code:string>>", lambda s: s["code"]),
    }
    body, html = F.trim("fields.body"), F.col("fields.body_html")
    text = F.when(F.coalesce(body, F.lit("")) != "", body).when(F.trim(F.coalesce(html, F.lit(""))) != "", html_text(F.coalesce(html, F.lit("")))).otherwise("")
    glides = F.filter(F.transform("fields.disaster", lambda d: d["glide"]), lambda g: F.coalesce(g, F.lit("")) != "")
    return f.select(
        "id", "fields.title", names(F.col("fields.source"), "source").alias("source"), S.parse_date(F.coalesce("fields.date.original", "fields.date.created")).alias("date"),
        "fields.url", "fields.url_alias", names(F.col("fields.format"), "format").alias("format"),
        F.transform("fields.disaster", lambda d: d["id"]).alias("disaster_ids"), F.transform("fields.disaster", lambda d: d["name"]).alias("disaster_names"),
        F.get(glides, F.lit(0)).alias("glide"), F.col("fields.primary_country.iso3").alias("country_iso3"), F.col("fields.primary_country.name").alias("country_name"),
        F.nullif(names(F.col("fields.language"), "language"), F.lit("")).alias("language"), text.alias("text"), F.col("fields.file").alias("files"), F.lit("api").alias("collection"),
    )
