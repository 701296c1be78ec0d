"""Agreement between raters: confusion, kappas, Fleiss, consensus, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import VERDICTS

def pair_judges(rows: DataFrame, a: str, b: str, key=("event", "sitrep_id", "slot_id")) -> DataFrame:
    """Both judges' verdicts by key from one pass; a null side was not judged."""
    pick = lambda j: F.max(F.when(F.col("judge") == j, F.col("verdict")))
    return rows.filter(F.col("judge").isin(a, b)).groupBy(*key).agg(pick(a).alias("a"), pick(b).alias("b"))


def overlap(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count_if(F.expr("a IS NOT NULL AND b IS NOT NULL")).alias("n_both"),
        F.count_if(F.expr("a IS NOT NULL AND b IS NULL")).alias("n_only_a"),
        F.count_if(F.expr("a IS NULL AND b IS NOT NULL")).alias("n_only_b"),
    )


def wide_judges(rows: DataFrame, judges, key=("event", "sitrep_id", "slot_id")) -> DataFrame:
    """One column for each judge, complete cases only."""
    wide = rows.groupBy(*key).pivot("judge", list(judges)).agg(F.max("verdict"))
    return wide.dropna(subset=list(judges))


def confusion(pairs: DataFrame, labels=VERDICTS, by=()) -> DataFrame:
    """Counts of every (a, b) cell in fixed label order, zeros included."""
    both = pairs.filter("a IS NOT NULL AND b IS NOT NULL")
    cell = lambda x, y: F.count_if((F.col("a") == x) & (F.col("b") == y))
    cells = F.array(*(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), cell(x, y).alias("n")) for x in labels for y in labels))
    return both.groupBy(*by).agg(cells.alias("c")).select(*by, F.explode("c").alias("c")).select(*by, "c.*")


def kappa(pairs: DataFrame, by=(), labels=VERDICTS) -> DataFrame:
    """n, raw agreement, Cohen's kappa and its linear and quadratic weightings; null when chance explains all."""
    place = F.create_map(*(x for v, i in zip(labels, range(len(labels)), strict=True) for x in (F.lit(v), F.lit(i))))
    both = pairs.filter(F.col("a").isin(*labels) & F.col("b").isin(*labels))
    i, j = F.element_at(place, F.col("a")), F.element_at(place, F.col("b"))
    count = lambda c: F.count_if(c)
    aggregates = [F.count("*").alias("n"), count(i == j).alias("same")]
    aggregates += [F.sum(F.abs(i - j)).alias("d1"), F.sum((i - j) * (i - j)).alias("d2")]
    aggregates += [count(i == v).alias(f"r{v}") for v in range(len(labels))] + [count(j == v).alias(f"c{v}") for v in range(len(labels))]
    stats = both.groupBy(*by).agg(*aggregates)
    n = F.col("n").cast("double")

    def expected(weight):
        return sum((F.col(f"r{v}") * F.col(f"c{w}") * float(weight(v, w)) for v in range(len(labels)) for w in range(len(labels)) if weight(v, w)), F.lit(0.0)) / (n * n)

    def coefficient(observed, weight):
        return F.lit(1.0) - observed / n / F.nullif(expected(weight), F.lit(0.0))

    return stats.select(
        *by,
        "n",
        (F.col("same") / n).alias("raw_agreement"),
        coefficient(F.col("n") - F.col("same"), lambda v, w: v != w).alias("kappa"),
        coefficient(F.col("d1"), lambda v, w: abs(v - w)).alias("kappa_linear"),
        coefficient(F.col("d2"), lambda v, w: (v - w) ** 2).alias("kappa_quadratic"),
    )


def label_agreement(pairs: DataFrame, labels=VERDICTS, by=()) -> DataFrame:
    """For each label the share of items that both gave it among those that either did; null when none did."""
    both = pairs.filter("a IS NOT NULL AND b IS NOT NULL").withColumn("label", F.explode(F.array(*map(F.lit, labels))))
    is_a, is_b = F.col("a") == F.col("label"), F.col("b") == F.col("label")
    return both.groupBy(*by, "label").agg((F.count_if(is_a & is_b) / F.nullif(F.count_if(is_a | is_b), F.lit(0))).alias("agreement"))


def fleiss(rows: DataFrame, item=("event", "sitrep_id", "slot_id"), raters: int = 2, by=(), labels=VERDICTS) -> DataFrame:
    """Fleiss' kappa over the items that all raters judged."""
    counts = [F.count_if(F.col("verdict") == v).alias(f"k{i}") for i, v in enumerate(labels)]
    items = rows.groupBy(*dict.fromkeys([*by, *item])).agg(F.count("*").alias("r"), *counts).filter(F.col("r") == raters)
    squares = sum((F.col(f"k{i}") * F.col(f"k{i}") for i in range(len(labels))), F.lit(0))
    agree = (squares - raters) / F.lit(float(raters * (raters - 1)))
    total = items.groupBy(*by).agg(F.count("*").alias("n_items"), F.avg(agree).alias("observed"), *(F.sum(f"k{i}").alias(f"s{i}") for i in range(len(labels))))
    share = lambda i: F.col(f"s{i}") / (F.col("n_items") * float(raters))
    total = total.withColumn("chance", sum((share(i) * share(i) for i in range(len(labels))), F.lit(0.0)))
    return total.select(*by, "n_items", "observed", "chance", F.when(F.col("chance") < 1, (F.col("observed") - F.col("chance")) / (1 - F.col("chance"))).alias("kappa"))


def consensus(rows: DataFrame, primary: str, item=("event", "sitrep_id", "slot_id")) -> DataFrame:
    """The verdict of a strict majority, else that of the primary judge."""
    votes = [F.count_if(F.col("verdict") == v) for v in VERDICTS]
    best = F.greatest(*(F.struct(n.alias("n"), F.lit(v).alias("v")) for n, v in zip(votes, VERDICTS, strict=True)))
    flat = rows.groupBy(*item).agg(F.count("*").alias("n"), best.alias("m"), F.max(F.when(F.col("judge") == primary, F.col("verdict"))).alias("p"))
    return flat.select(*item, "n", F.when(F.col("m.n") * 2 > F.col("n"), F.col("m.v")).otherwise(F.col("p")).alias("consensus"))


def missingness(rows: DataFrame, judges: DataFrame, item=("event", "sitrep_id", "slot_id")) -> DataFrame:
    """For each judge the items that some judge has and it lacks, with its three slots that lack most."""
    every = rows.select(*item).distinct().join(judges, how="cross")  # a handful of names; Spark broadcasts them when their size allows it
    gone = every.join(rows.select(*item, "judge"), [*item, "judge"], "left_anti")
    by_slot = gone.groupBy("judge", "slot_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("judge").orderBy(F.desc("n"), "slot_id")
    ranked = by_slot.withColumn("rn", F.row_number().over(order))
    return ranked.groupBy("judge").agg(
        F.sum("n").alias("n_missing"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", "slot_id")))), lambda x: x["slot_id"]), ",").alias("top_slots"),
    )


def label_scores(pairs: DataFrame, by=(), labels=VERDICTS) -> DataFrame:
    """Precision, recall and F1 of b against a for each label."""
    both = pairs.filter("a IS NOT NULL AND b IS NOT NULL").withColumn("label", F.explode(F.array(*map(F.lit, labels))))
    is_a, is_b = F.col("a") == F.col("label"), F.col("b") == F.col("label")
    hits, said, true = F.count_if(is_a & is_b), F.count_if(is_b), F.count_if(is_a)
    none = F.lit(0)
    return both.groupBy(*by, "label").agg(
        (hits / F.nullif(said, none)).alias("precision"), (hits / F.nullif(true, none)).alias("recall"), (2 * hits / F.nullif(said + true, none)).alias("f1")
    )


def by_scope(rows: DataFrame, column: str = "kind") -> DataFrame:
    """Every row twice: under 'all' and under its own scope."""
    return rows.withColumn("scope", F.explode(F.array(F.lit("all"), F.col(column))))


def hand_scores(scored: DataFrame, index: DataFrame, key=("sitrep_id", "slot_id")) -> DataFrame:
    """Diagnostics of a hand-scored sheet: rows, blank, unmatched and used."""
    joined = scored.join(index, list(key), "left")
    blank = F.coalesce(F.trim("human_verdict"), F.lit("")) == ""
    return joined.agg(
        F.count("*").alias("n_rows"), F.count_if(blank).alias("n_blank"),
        F.count_if(~blank & F.col("verdict").isNull()).alias("n_unmatched"), F.count_if(~blank & F.col("verdict").isNotNull()).alias("n_used"),
    )


def validate_one_to_one(left: DataFrame, right: DataFrame, key, expected: int) -> DataFrame:
    """One row of counts for a join that must match every key exactly once, and whether it does."""
    a = left.groupBy(*key).agg(F.count("*").alias("na"))
    b = right.groupBy(*key).agg(F.count("*").alias("nb"))
    flat = a.join(b, list(key), "full_outer").agg(
        F.count_if(F.expr("na IS NOT NULL")).alias("n_left"), F.count_if(F.expr("nb IS NOT NULL")).alias("n_right"),
        F.count_if(F.expr("na > 1 OR nb > 1")).alias("n_repeated"), F.count_if(F.expr("na IS NULL OR nb IS NULL")).alias("n_unmatched"),
    )
    return flat.withColumn("valid", (F.col("n_left") == expected) & (F.col("n_right") == expected) & (F.col("n_repeated") == 0) & (F.col("n_unmatched") == 0))
