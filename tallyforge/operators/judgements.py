"""The judgement fact table: populations, coverage, completeness, ceilings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normal_verdict, usable, valid_verdict, verdict_score

KEY = ("event", "judge", "sitrep_id", "slot_id")


def last_wins(rows: DataFrame, keys, order: str = "_seq") -> DataFrame:
    """One row for each key, the one with the greatest order: a struct maximum, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("__m"))
    return best.select(*keys, *(F.col("__m")[c].alias(c) for c in rest))


def first_wins(rows: DataFrame, keys, order: str = "_seq") -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min(F.struct(order, *(c for c in rest if c != order))).alias("__m"))
    return best.select(*keys, *(F.col("__m")[c].alias(c) for c in rest))


def known_verdicts(rows: DataFrame) -> DataFrame:
    """Rows whose verdict is in the vocabulary, whatever their status."""
    return rows.filter(valid_verdict("verdict"))


def population(rows: DataFrame, keys=KEY) -> DataFrame:
    """The analysis population: the last row of each key, then only usable ones, with their score.

    A failed last row removes its key, so the order of the two steps matters.
    """
    good = last_wins(rows, keys).filter(usable("status", "verdict"))
    return good.withColumn("score", verdict_score("verdict")).withColumn("verdict", normal_verdict("verdict"))


def dropped_count(rows: DataFrame, keys=KEY) -> DataFrame:
    """Keys and keys whose last row is not usable."""
    last = last_wins(rows, keys)
    return last.agg(F.count("*").alias("n_keys"), F.count_if(~F.coalesce(usable("status", "verdict"), F.lit(False))).alias("n_dropped"))


def completeness(rows: DataFrame, by, weight: str | None = None) -> DataFrame:
    """Mean score, or weighted mean, by group; a weight that is missing, negative or all zero raises."""
    if weight is None:
        return rows.groupBy(*by).agg(F.avg("score").alias("completeness"))
    w = F.col(weight)
    checked = F.when(w.isNull() | (w < 0), F.raise_error(F.lit("a weight is missing or negative")).cast("double")).otherwise(w)
    total = F.sum("__w")
    return (
        rows.withColumn("__w", checked)
        .groupBy(*by)
        .agg((F.sum(F.col("__w") * F.col("score")) / F.when(total == 0, F.raise_error(F.lit("weights add up to zero")).cast("double")).otherwise(total)).alias("completeness"))
    )


def coverage(rows: DataFrame, by) -> DataFrame:
    count = lambda v: F.count_if(F.lower(F.trim("verdict")) == v)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("score").alias("coverage"),
        count("present").alias("n_present"),
        count("partial").alias("n_partial"),
        count("absent").alias("n_absent"),
    )


def arm_completeness(rows: DataFrame, by=("arm",), doc=("event", "judge", "sitrep_id")) -> DataFrame:
    """Two levels: mean by document, then by arm."""
    docs = completeness(rows, [*dict.fromkeys([*by, *doc])])
    return docs.groupBy(*by).agg(F.count("*").alias("n_documents"), F.avg("completeness").alias("completeness"))


def document_scores(rows: DataFrame, by=("event", "judge", "arm", "sitrep_id")) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n_scored"), F.avg("score").alias("completeness"))


def completeness_by_document(rows: DataFrame, weights: DataFrame, by=("event", "sitrep_id")) -> DataFrame:
    """n_slots, n_scored, n_failed, plain and weighted completeness; weights has slot_id and weight."""
    joined = rows.join(weights, "slot_id", "left").withColumn("__ok", F.coalesce(usable("status", "verdict"), F.lit(False)))
    score = F.when(F.col("__ok"), verdict_score("verdict", strict=False))
    w = F.when(F.col("__ok"), F.col("weight"))
    return joined.groupBy(*by).agg(
        F.count("*").alias("n_slots"),
        F.count_if("__ok").alias("n_scored"),
        F.count_if(~F.col("__ok")).alias("n_failed"),
        F.avg(score).alias("completeness"),
        (F.sum(w * score) / F.nullif(F.sum(w), F.lit(0.0))).alias("completeness_weighted"),
    )


def slot_matrix(rows: DataFrame) -> DataFrame:
    """One row for each slot: coverage by arm as a map, the human coverage apart."""
    cov = coverage(rows, ("slot_id", "arm"))
    arms = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("arm") != "human", F.struct("arm", "coverage")))))
    return cov.groupBy("slot_id").agg(F.max(F.when(F.col("arm") == "human", F.col("coverage"))).alias("human_coverage"), arms.alias("machine_coverage_by_arm"))


def expected_coverage(rows: DataFrame, documents: DataFrame, by=("event", "judge", "arm")) -> DataFrame:
    """Coverage by slot and arm with the documents expected and missing; documents has the by-columns and sitrep_id."""
    expected = documents.groupBy(*by).agg(F.count_distinct("sitrep_id").alias("n_expected"))
    cov = coverage(rows, (*by, "slot_id"))
    return cov.join(expected, list(by), "left").withColumn("n_missing", F.col("n_expected") - F.col("n"))


def visibility_ceiling(cov: DataFrame, *, machine_max: float = 0.1, human_min: float = 0.5, by=("slot_id",), one_sided: bool = True) -> DataFrame:
    """Slots that humans cover and no machine arm does. cov has by, arm and coverage.

    The best arm of a tie is the greatest name. One-sided slots stay with a reason, or drop.
    """
    human = F.max(F.when(F.col("arm") == "human", F.col("coverage")))
    machine = F.max(F.when(F.col("arm") != "human", F.struct("coverage", "arm")))
    flat = cov.groupBy(*by).agg(human.alias("human_coverage"), machine.alias("__m"))
    flat = flat.select(*by, "human_coverage", F.col("__m.coverage").alias("machine_coverage_max"), F.col("__m.arm").alias("machine_best_arm"))
    if not one_sided:
        flat = flat.filter("human_coverage IS NOT NULL AND machine_coverage_max IS NOT NULL")
    both = F.col("human_coverage").isNotNull() & F.col("machine_coverage_max").isNotNull()
    low, high = F.col("machine_coverage_max") <= machine_max, F.col("human_coverage") >= human_min
    return flat.withColumn("gap", F.col("human_coverage") - F.col("machine_coverage_max")).withColumn(
        "is_ceiling", F.coalesce(both & low & high, F.lit(False))
    ).withColumn(
        "reason",
        F.when(F.col("human_coverage").isNull(), "no human coverage")
        .when(F.col("machine_coverage_max").isNull(), "no machine coverage")
        .when(~low, "machine above maximum")
        .when(~high, "human below minimum")
        .otherwise("ceiling"),
    )


def gap_sensitivity(ceilings: DataFrame, by) -> DataFrame:
    return ceilings.groupBy(*by).agg(F.count_if(F.col("gap") > 0).alias("n_positive"), F.count("gap").alias("n_observed"))


def truncation_shift(cut: DataFrame, full: DataFrame) -> DataFrame:
    """Mean of full minus truncated completeness by event and over all."""
    both = cut.withColumnRenamed("completeness", "cut").join(full.withColumnRenamed("completeness", "whole"), ["event", "sitrep_id"])
    shift = F.col("whole") - F.col("cut")
    return both.groupingSets([["event"], []], "event").agg(F.count("*").alias("n_documents"), F.avg(shift).alias("shift")).withColumn(
        "event", F.coalesce("event", F.lit("ALL"))
    )


def with_totals(rows: DataFrame, column: str, total: str, aggregates: dict[str, Column]) -> DataFrame:
    """The aggregates by a column and over all rows, the latter under the name ``total``."""
    grouped = rows.groupingSets([[column], []], column).agg(F.grouping(column).alias("__all"), *(a.alias(n) for n, a in aggregates.items()))
    return grouped.withColumn(column, F.when(F.col("__all") == 1, F.lit(total)).otherwise(F.col(column))).drop("__all")
