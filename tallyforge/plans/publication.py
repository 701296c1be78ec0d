"""All publication tables of a judgement population in one call, their files, and the stage runner."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import agreement as A
from ..operators import judgements as G
from ..operators import sections as S
from ..operators import stats as Q
from ..sources.sinks import write_csv


def build_all(
    rows: DataFrame, *, judges: tuple[str, str], machine_max: float = 0.6, human_min: float = 0.8, n_boot: int = 200, metrics: DataFrame | None = None, metric_names: tuple[str, ...] = (),
    arms: tuple[str, str] | None = None, figures: DataFrame | None = None, validation: DataFrame | None = None, gated: DataFrame | None = None, truncation: DataFrame | None = None,
    sensitive_slot: str | None = None, weak_judge: str | None = None,
) -> dict[str, DataFrame]:
    """name -> table from raw judgement rows; every table is a lazy plan over one population.

    More tables come with more inputs: ``metrics`` (event, sitrep_id and the columns ``metric_names``) the correlations with
    Holm's adjustment and the system level, ``arms`` (a machine arm and the human one) the inversion test, ``figures`` (a row of
    figure_check each) the grounding, ``validation`` (judge, kind, a by the judge, b by hand) the human validation, ``gated``
    (gated_scores) the content gate, ``truncation`` (event, sitrep_id, shift) its summary, and ``sensitive_slot`` with ``weak_judge`` the
    gap's count without that judge.
    """
    p = G.population(rows)
    docs = G.document_scores(p)
    cov = G.coverage(p, ("event", "judge", "slot_id", "arm"))
    ceilings = G.visibility_ceiling(cov, machine_max=machine_max, human_min=human_min, by=("event", "judge", "slot_id"))
    pairs = A.pair_judges(p, *judges)
    out = {
        "corpus_manifest": p.groupBy("event", "judge").agg(F.count_distinct("sitrep_id").alias("n_documents"), F.count("*").alias("n_judgements")),
        "slot_coverage": cov,
        "structural_gaps": ceilings,
        "structural_gap_sensitivity": G.gap_sensitivity(ceilings, ("event", "judge")),
        "completeness_by_document": docs,
        "completeness_by_judge_arm": Q.bootstrap_mean(docs, "completeness", "sitrep_id", ("event", "judge", "arm"), n_boot=n_boot),
        "judge_agreement": A.fleiss(p.filter(F.col("judge").isin(*judges)), raters=2, by=("event",)),
        "pairwise_kappa": A.kappa(pairs, ("event",)),
        "label_agreement": A.label_agreement(pairs, by=("event",)),
        "missing_judgements": G.dropped_count(rows),
    }
    if sensitive_slot is not None:
        out["structural_gap_scopes"] = gap_scopes(ceilings.filter(F.col("slot_id") == sensitive_slot), weak_judge)
    if arms is not None:
        of = docs.groupBy("arm", "sitrep_id").agg(F.avg("completeness").alias("c"))
        difference = Q.bootstrap_difference(of, "c", "arm", *arms, "sitrep_id", n_boot=n_boot)
        out["inversion_test"] = difference.join(Q.permutation_test(of, "c", "arm", *arms, "sitrep_id", n_perm=n_boot), how="cross")  # one row each
    if metrics is not None:
        machine = docs.filter("arm <> 'human'").groupBy("event", "arm", "sitrep_id").agg(F.avg("completeness").alias("completeness"))
        both = machine.join(metrics, ["event", "sitrep_id"])
        tested = Q.correlation_report(both, metric_names).filter("p_value IS NOT NULL")
        out["correlations_holm"] = Q.holm(tested, "p_value", "metric", ("scope",))
        out |= system_level(both, metric_names)
    if figures is not None:
        rates = {n: F.avg(n) for n in ("precision", "recall", "casualty_recall")}
        out["figure_grounding_summary"] = G.with_totals(figures, "event", "POOLED", {"n_pairs": F.count("*")} | rates)
    if validation is not None:
        scoped = A.by_scope(validation)
        out["human_validation_pairs"] = validation
        out["human_validation_summary"] = A.kappa(scoped, ("judge", "scope"))
        out["human_validation_labels"] = A.label_scores(scoped, ("judge", "scope"))
    if gated is not None:
        out["content_gate_by_document"] = gated.groupBy("event", "judge", "arm", "sitrep_id").agg(F.count("*").alias("n_scored_slots"), F.avg("score").alias("original_completeness"), F.avg("gated").alias("content_gated_completeness"))
        out["content_gate_summary"] = S.gate_summary(gated)
    if truncation is not None:
        scoped = truncation.select(F.explode(F.array(F.lit("all"), "event")).alias("scope"), "sitrep_id", "shift")
        out["truncation_sensitivity_summary"] = Q.bootstrap_mean(scoped, "shift", "sitrep_id", ("scope",), n_boot=n_boot)
    return out


def gap_scopes(ceilings: DataFrame, weak_judge: str | None) -> DataFrame:
    """Positive and observed cells of one slot's gap, over all judges and without the one that misses most."""
    scopes = F.array(F.lit("all-observed"), *([F.when(F.col("judge") != weak_judge, "without-" + weak_judge)] if weak_judge else []))
    scoped = ceilings.select("gap", F.explode(scopes).alias("analysis")).filter("analysis IS NOT NULL")
    return G.gap_sensitivity(scoped, ("analysis",))


def system_level(both: DataFrame, metric_names) -> dict[str, DataFrame]:
    """Means and ranks of every arm, and the rank correlation of arms between a metric and completeness."""
    means = both.groupBy("event", "arm").agg(F.count("*").alias("n_documents"), *(F.avg(c).alias(c) for c in ("completeness", *metric_names)))
    place = Window.partitionBy("event")
    ranked = means.withColumns({f"{c}_rank": F.row_number().over(place.orderBy(F.desc(c), "arm")) for c in ("completeness", *metric_names)})
    return {"system_level_arm_scores": ranked, "system_level_correlations": Q.correlation_report(means, metric_names)}


def write_all(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """A CSV folder for each table, with its columns in order; nested columns as JSON."""
    for name, df in tables.items():
        flat = df.select(*(F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in df.dtypes))
        write_csv(flat, f"{folder.rstrip('/')}/{name}", flat.columns)
    return sorted(tables)


class CheckpointRequired(RuntimeError):
    """A human has to approve something before the next stage may run."""


def run_stages(stages: Iterable[tuple[str, Callable[[], object]]], *, approved: Callable[[], bool], after: str, only: str | None = None) -> dict[str, object]:
    """Runs named stages in order; the ones after ``after`` need ``approved()`` to hold."""
    done: dict[str, object] = {}
    passed = False
    for name, stage in stages:
        if passed and not approved():
            raise CheckpointRequired(f"stage {name!r} needs an approved schema")
        if only in (None, name):
            done[name] = stage()
        passed = passed or name == after
    return done
