"""Sections of reports under known headings, and the content gate on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.textops import content_score, normal_heading

#: The two ways a heading is written, with text that may follow on its line.
BRACKETED = r"^\s*#{1,6}\s*\[([^\]]+)\]\s*:?[ \t]*(.*)$"
BOLD = r"^\s*\*\*(.+?)\*\*\s*:?[ \t]*(.*)$"


def heading_aliases(slots: DataFrame) -> DataFrame:
    """(heading, slot_id) from the ids and names of slots; of a shared heading the first slot counts."""
    both = slots.select("slot_id", F.explode(F.array(F.col("slot_id"), F.col("name"))).alias("text"))
    named = both.select("slot_id", normal_heading(F.col("text")).alias("heading")).filter("heading <> ''")
    return named.groupBy("heading").agg(F.min("slot_id").alias("slot_id"))


def sections(reports: DataFrame, aliases: DataFrame, key=("id",), text: str = "text") -> DataFrame:
    """(key, slot_id, body): the lines from a known heading to the next one.

    Text after a heading on its own line comes first. A heading that comes again replaces what stood
    under it before. Reports without a known heading have no rows. Lines meet the aliases in an
    equi-join, and each report's lines are put in order by report.
    """
    lines = reports.select(*key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("at", "line"))
    bracketed, bold = F.regexp_extract("line", BRACKETED, 1), F.regexp_extract("line", BOLD, 1)
    name = F.when(bracketed != "", bracketed).when(bold != "", bold).otherwise(F.col("line"))
    inline = F.when(bracketed != "", F.regexp_extract("line", BRACKETED, 2)).when(bold != "", F.regexp_extract("line", BOLD, 2)).otherwise("")
    lines = lines.withColumn("heading", normal_heading(name)).withColumn("inline", inline)
    known = lines.join(aliases, "heading", "left")
    so_far = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("slot_id").isNotNull(), F.struct("at", "slot_id")), ignorenulls=True).over(so_far)
    owned = known.withColumn("s", start).filter("s IS NOT NULL")
    body = F.when(F.col("slot_id").isNull(), F.col("line")).when(F.col("inline") != "", F.col("inline"))
    parts = owned.groupBy(*key, F.col("s.at").alias("first"), F.col("s.slot_id").alias("slot_id")).agg(F.array_sort(F.collect_list(F.when(body.isNotNull(), F.struct("at", body.alias("t"))))).alias("b"))
    joined = parts.select(*key, "slot_id", "first", F.regexp_replace(F.array_join(F.transform("b", lambda x: x["t"]), "\n"), r"^\s+|\s+$", "").alias("body"))
    return joined.groupBy(*key, "slot_id").agg(F.max_by("body", "first").alias("body"))


def gated_scores(judged: DataFrame, bodies: DataFrame, key=("sitrep_id",)) -> DataFrame:
    """Judged rows with the score that their section's text can support: only full scores are lowered."""
    top = bodies.select(*key, "slot_id", content_score(F.col("body")).alias("top"))
    rows = judged.join(top, [*key, "slot_id"], "left")
    top = F.coalesce("top", F.lit(0.0))
    return rows.withColumn("gated", F.when(F.col("score") == 1.0, F.least("score", top)).otherwise(F.col("score"))).drop("top")


def gate_summary(gated: DataFrame, by=("event", "judge", "arm"), doc: str = "sitrep_id") -> DataFrame:
    docs = gated.groupBy(*by, doc).agg(F.avg("score").alias("o"), F.avg("gated").alias("g"), F.count_if(F.col("gated") < F.col("score")).alias("k"))
    return docs.groupBy(*by).agg(
        F.count("*").alias("n_documents"), F.avg("o").alias("original_completeness"), F.avg("g").alias("content_gated_completeness"), F.sum("k").alias("present_cells_downgraded")
    )
