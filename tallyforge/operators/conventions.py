"""Writing conventions of reports: counts of every text, totals, and how often each term occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import textops as J


def text_statistics(reports: DataFrame, id_col: str = "id", group: str = "event", *, terms: bool = True) -> DataFrame:
    """id, group, all convention counts and, if asked for, the terms of every text. Texts are dealt to all partitions first."""
    rows = J.spread(reports.select(id_col, group, "text"), id_col).select(id_col, group, J.stats(F.col("text"), terms=terms).alias("s"))
    return rows.select(id_col, group, "s.*")


def counted(reports: DataFrame, count: str, id_col: str = "id") -> DataFrame:
    """id and one of the counts of figures, for which the text is searched for no more than it needs."""
    of = {"n_figures": J.figure_count, "n_figures_with_source": J.sourced_count}[count]
    return J.spread(reports.select(id_col, "text"), id_col).select(id_col, of(F.col("text")).alias(count))


def corpus_terms(reports: DataFrame, id_col: str = "id") -> DataFrame:
    """``term_counts`` straight from the texts: terms are added up by batch and then by term."""
    found = J.spread(reports.select(id_col, "text"), id_col).select(F.explode(J.batch_terms(F.col("text"))).alias("t"))
    return found.select("t.term", "t.n").groupBy("term").agg(F.sum("n").alias("n"))


def totals(statistics: DataFrame, group: str = "event", total: str = "ALL") -> DataFrame:
    """Sums of the counts by group and over all, and the share of figures with a source: a ratio of sums."""
    rows = statistics.groupingSets([[group], []], group).agg(F.grouping(group).alias("__all"), *(F.sum(c).alias(c) for c in J.COUNTS))
    rows = rows.withColumn(group, F.when(F.col("__all") == 1, F.lit(total)).otherwise(F.col(group))).drop("__all")
    return rows.withColumn("figure_with_source_rate", F.col("n_figures_with_source") / F.nullif("n_figures", F.lit(0)))


def term_counts(statistics: DataFrame) -> DataFrame:
    """How often each term (family:label) occurs in all texts."""
    return statistics.select(F.explode("terms").alias("term", "c")).groupBy("term").agg(F.sum("c").alias("n"))


def convention_tables(reports: DataFrame) -> dict[str, DataFrame]:
    """The tables of a corpus of reports (id, event, text): a row a document, the totals, the terms."""
    rows = text_statistics(reports, terms=False)
    rate = F.col("n_figures_with_source") / F.nullif("n_figures", F.lit(0))
    return {
        "convention_documents": rows.withColumn("figure_with_source_rate", rate),
        "convention_stats": totals(rows),
        "convention_terms": corpus_terms(reports).select(F.split("term", ":")[0].alias("category"), F.split("term", ":")[1].alias("label"), "n"),
    }
