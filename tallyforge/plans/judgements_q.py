"""Queries on the judgement table: populations, coverage, ceilings, agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import agreement as A
from ..operators import judgements as G
from ..operators import ranking as R
from ..session import table
from . import fixtures as X
from .fixtures import J, PAIRS
from .registry import query

@query("e03_completeness_by_arm", f"""WITH {J}, d AS (SELECT arm, event, judge, sitrep_id, avg(score) AS c FROM p GROUP BY ALL)
SELECT arm, count(*) AS n_documents, round(avg(c), 6) AS completeness FROM d GROUP BY arm""")
def _(spark, sf):
    return G.arm_completeness(X.population(spark, sf))


@query("a10_known_verdicts", f"WITH {J} SELECT event, judge, sitrep_id, slot_id, verdict, count(*) AS n FROM j WHERE lower(trim(verdict)) IN ('absent', 'partial', 'present') GROUP BY ALL")
def _(spark, sf):
    return G.known_verdicts(X.judgements(spark, sf)).groupBy("event", "judge", "sitrep_id", "slot_id", "verdict").agg(F.count("*").alias("n"))


@query("a11_analysis_population", f"WITH {J} SELECT event, judge, sitrep_id, slot_id, arm, verdict, score, _seq FROM p")
def _(spark, sf):
    return X.population(spark, sf).select("event", "judge", "sitrep_id", "slot_id", "arm", "verdict", "score", "_seq")


@query("a11_dropped_keys", f"WITH {J} SELECT count(*) AS n_keys, count(*) - (SELECT count(*) FROM p) AS n_dropped FROM l")
def _(spark, sf):
    return G.dropped_count(X.judgements(spark, sf))


@query("g05_last_row_wins", f"WITH {J} SELECT event, judge, sitrep_id, slot_id, _seq, verdict FROM l")
def _(spark, sf):
    return G.last_wins(X.judgements(spark, sf), G.KEY).select("event", "judge", "sitrep_id", "slot_id", "_seq", "verdict")


@query("g06_first_row_wins", f"WITH {J} SELECT sitrep_id, slot_id, min(_seq) AS _seq, arg_min(verdict, _seq) AS verdict FROM j GROUP BY ALL")
def _(spark, sf):
    return G.first_wins(X.judgements(spark, sf), ("sitrep_id", "slot_id")).select("sitrep_id", "slot_id", "_seq", "verdict")


@query("e01_weighted_completeness", f"""WITH {J}, w AS (SELECT *, length(slot_id)::DOUBLE AS weight FROM p)
SELECT event, judge, sitrep_id, round(sum(weight * score) / sum(weight), 6) AS completeness FROM w GROUP BY ALL""")
def _(spark, sf):
    return G.completeness(X.population(spark, sf).withColumn("weight", F.length("slot_id").cast("double")), ("event", "judge", "sitrep_id"), "weight")


@query("e02_coverage_by_slot", f"""WITH {J} SELECT slot_id, count(*) AS n, round(avg(score), 6) AS coverage, count(*) FILTER (WHERE verdict = 'present') AS n_present,
count(*) FILTER (WHERE verdict = 'partial') AS n_partial, count(*) FILTER (WHERE verdict = 'absent') AS n_absent FROM p GROUP BY slot_id""")
def _(spark, sf):
    return G.coverage(X.population(spark, sf), ("slot_id",))


@query("e04_slot_matrix", f"""WITH {J}, c AS (SELECT slot_id, arm, avg(score) AS v FROM p GROUP BY ALL)
SELECT slot_id, round(max(v) FILTER (WHERE arm = 'human'), 6) AS human_coverage, string_agg(arm || '=' || round(v, 4)::DECIMAL(10, 4), ';' ORDER BY arm) FILTER (WHERE arm <> 'human') AS machine
FROM c GROUP BY slot_id""")
def _(spark, sf):
    m = G.slot_matrix(X.population(spark, sf))
    text = F.transform(F.map_entries("machine_coverage_by_arm"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 4).cast("decimal(10,4)").cast("string")))
    return m.select("slot_id", "human_coverage", F.array_join(text, ";").alias("machine"))


@query("e05_document_scores", f"WITH {J} SELECT event, judge, arm, sitrep_id, count(*) AS n_scored, round(avg(score), 6) AS completeness FROM p GROUP BY ALL")
def _(spark, sf):
    return G.document_scores(X.population(spark, sf))


@query("e05_arm_summary", f"""WITH {J}, d AS (SELECT event, judge, arm, sitrep_id, avg(score) AS c FROM p GROUP BY ALL)
SELECT event, judge, arm, count(*) AS n_documents, round(avg(c), 6) AS completeness FROM d GROUP BY ALL""")
def _(spark, sf):
    return G.arm_completeness(X.population(spark, sf), ("event", "judge", "arm"), ("sitrep_id",))


@query("e06_expected_coverage", f"""WITH {J}, x AS (SELECT event, judge, arm, count(DISTINCT sitrep_id) AS n_expected FROM j GROUP BY ALL)
SELECT event, judge, arm, slot_id, count(*) AS n, round(avg(score), 6) AS coverage, any_value(n_expected) AS n_expected, any_value(n_expected) - count(*) AS n_missing
FROM p JOIN x USING (event, judge, arm) GROUP BY ALL""")
def _(spark, sf):
    rows = X.judgements(spark, sf)
    return G.expected_coverage(G.population(rows), rows.select("event", "judge", "arm", "sitrep_id")).select("event", "judge", "arm", "slot_id", "n", "coverage", "n_expected", "n_missing")


_CEILING = f"""WITH {J}, c AS (SELECT event, slot_id, arm, avg(score) AS v FROM p GROUP BY ALL),
f AS (SELECT event, slot_id, max(v) FILTER (WHERE arm = 'human') AS h, max(v) FILTER (WHERE arm <> 'human') AS m,
  max({{'v': v, 'arm': arm}}) FILTER (WHERE arm <> 'human') AS best FROM c GROUP BY ALL)"""


@query("e07_visibility_ceiling", _CEILING + """ SELECT event, slot_id, round(h, 6) AS human_coverage, round(m, 6) AS machine_coverage_max, best.arm AS machine_best_arm, round(h - m, 6) AS gap,
coalesce(h >= 0.5 AND m <= 0.52, false) AS is_ceiling FROM f""")
def _(spark, sf):
    cov = G.coverage(X.population(spark, sf), ("event", "slot_id", "arm"))
    return G.visibility_ceiling(cov, machine_max=0.52, human_min=0.5, by=("event", "slot_id")).drop("reason")


@query("e08_two_sided_ceiling", _CEILING + " SELECT event, slot_id, round(h - m, 6) AS gap, (h >= 0.5 AND m <= 0.5) AS is_ceiling FROM f WHERE h IS NOT NULL AND m IS NOT NULL")
def _(spark, sf):
    cov = G.coverage(X.population(spark, sf), ("event", "slot_id", "arm"))
    return G.visibility_ceiling(cov, machine_max=0.5, human_min=0.5, by=("event", "slot_id"), one_sided=False).select("event", "slot_id", "gap", "is_ceiling")


@query("e27_gap_sensitivity", _CEILING + " SELECT event, count(*) FILTER (WHERE h - m > 0) AS n_positive, count(h - m) AS n_observed FROM f GROUP BY event")
def _(spark, sf):
    cov = G.coverage(X.population(spark, sf), ("event", "slot_id", "arm"))
    return G.gap_sensitivity(G.visibility_ceiling(cov, by=("event", "slot_id")), ("event",))


@query("i05_slots_of_either_side", f"""WITH {J}, h AS (SELECT DISTINCT event, slot_id FROM p WHERE arm = 'human' AND judge = 'j0'), m AS (SELECT DISTINCT event, slot_id FROM p WHERE arm = 'm1' AND judge = 'j1')
SELECT coalesce(h.event, m.event) AS event, coalesce(h.slot_id, m.slot_id) AS slot_id, h.slot_id IS NOT NULL AS human, m.slot_id IS NOT NULL AS machine FROM h FULL JOIN m ON h.event = m.event AND h.slot_id = m.slot_id""")
def _(spark, sf):
    p = X.population(spark, sf)
    h = p.filter("arm = 'human' AND judge = 'j0'").select("event", "slot_id").distinct().withColumn("h", F.lit(True))
    m = p.filter("arm = 'm1' AND judge = 'j1'").select("event", "slot_id").distinct().withColumn("m", F.lit(True))
    return h.join(m, ["event", "slot_id"], "full_outer").select("event", "slot_id", F.col("h").isNotNull().alias("human"), F.col("m").isNotNull().alias("machine"))


@query("e31_completeness_table", f"""WITH {J}, w AS (SELECT *, length(slot_id)::DOUBLE AS weight, coalesce(status = 'ok' AND lower(trim(verdict)) IN ('absent', 'partial', 'present'), false) AS good,
  CASE lower(trim(verdict)) WHEN 'absent' THEN 0.0 WHEN 'partial' THEN 0.5 WHEN 'present' THEN 1.0 END::DOUBLE AS s FROM l)
SELECT event, sitrep_id, count(*) AS n_slots, count(*) FILTER (WHERE good) AS n_scored, count(*) FILTER (WHERE NOT good) AS n_failed, round(avg(s) FILTER (WHERE good), 6) AS completeness,
round(sum(weight * s) FILTER (WHERE good) / nullif(sum(weight) FILTER (WHERE good), 0), 6) AS completeness_weighted FROM w GROUP BY ALL""")
def _(spark, sf):
    weights = table(spark, sf, "events").select(F.col("event_type").alias("slot_id")).distinct().withColumn("weight", F.length("slot_id").cast("double"))
    return G.completeness_by_document(G.last_wins(X.judgements(spark, sf), G.KEY), weights)


@query("e23_corpus_counts", f"""WITH {J} SELECT event, count(DISTINCT sitrep_id) FILTER (WHERE kind = 'human') AS n_human, count(DISTINCT sitrep_id) FILTER (WHERE kind = 'machine') AS n_machine,
count(DISTINCT judge) AS n_judges, count(*) AS n_judgements FROM p GROUP BY event""")
def _(spark, sf):
    of = lambda k: F.count_distinct(F.when(F.col("kind") == k, F.col("sitrep_id")))
    return X.population(spark, sf).groupBy("event").agg(of("human").alias("n_human"), of("machine").alias("n_machine"), F.count_distinct("judge").alias("n_judges"), F.count("*").alias("n_judgements"))


@query("e28_system_level", f"""WITH {J}, d AS (SELECT event, arm, sitrep_id, avg(score) AS c, count(*)::DOUBLE AS k FROM p WHERE arm <> 'human' GROUP BY ALL)
SELECT event, arm, count(*) AS n_documents, round(avg(c), 6) AS completeness, round(avg(k), 6) AS metric, row_number() OVER (PARTITION BY event ORDER BY avg(c) DESC, arm) AS completeness_rank FROM d GROUP BY event, arm""")
def _(spark, sf):
    docs = X.population(spark, sf).filter("arm <> 'human'").groupBy("event", "arm", "sitrep_id").agg(F.avg("score").alias("c"), F.count("*").cast("double").alias("k"))
    arms = docs.groupBy("event", "arm").agg(F.count("*").alias("n_documents"), F.avg("c").alias("completeness"), F.avg("k").alias("metric"))
    return R.numbered(arms, ["event"], [F.desc("completeness"), "arm"], "completeness_rank").withColumn("completeness_rank", F.col("completeness_rank").cast("long"))


@query("e32_truncation_shift", f"""WITH {J}, a AS (SELECT event, sitrep_id, avg(score) AS c FROM p WHERE judge = 'j0' GROUP BY ALL), b AS (SELECT event, sitrep_id, avg(score) AS c FROM p WHERE judge = 'j1' GROUP BY ALL)
SELECT coalesce(event, 'ALL') AS event, count(*) AS n_documents, round(avg(b.c - a.c), 6) AS shift FROM a JOIN b USING (event, sitrep_id) GROUP BY GROUPING SETS ((event), ())""")
def _(spark, sf):
    p = X.population(spark, sf)
    of = lambda j: p.filter(F.col("judge") == j).groupBy("event", "sitrep_id").agg(F.avg("score").alias("completeness"))
    return G.truncation_shift(of("j0"), of("j1"))


def _both(spark, sf):
    return A.pair_judges(X.population(spark, sf), "j0", "j1")


@query("d02_two_judges", f"WITH {PAIRS} SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n_both, count(*) FILTER (WHERE b IS NULL) AS n_only_a, count(*) FILTER (WHERE a IS NULL) AS n_only_b FROM pp")
def _(spark, sf):
    return A.overlap(_both(spark, sf))


@query("d03_complete_cases", f"WITH {J} SELECT event, sitrep_id, slot_id, max(verdict) FILTER (WHERE judge = 'j0') AS j0, max(verdict) FILTER (WHERE judge = 'j1') AS j1, max(verdict) FILTER (WHERE judge = 'j2') AS j2 FROM p GROUP BY ALL HAVING count(DISTINCT judge) = 3")
def _(spark, sf):
    return A.wide_judges(X.population(spark, sf), X.JUDGES)


@query("e09_confusion", f"""WITH {PAIRS}, v(x) AS (VALUES ('absent'), ('partial'), ('present'))
SELECT va.x AS a, vb.x AS b, (SELECT count(*) FROM pp WHERE pp.a = va.x AND pp.b = vb.x) AS n FROM v va CROSS JOIN v vb""")
def _(spark, sf):
    return A.confusion(_both(spark, sf))


_K = """, i AS (SELECT *, CASE a WHEN 'absent' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END AS x, CASE b WHEN 'absent' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END AS y FROM pp WHERE a IS NOT NULL AND b IS NOT NULL),
t AS (SELECT {by} count(*) AS n, avg((x = y)::INT) AS raw, avg((x <> y)::INT) AS o0, avg(abs(x - y)) AS o1, avg((x - y) * (x - y)) AS o2 FROM i {group}),
rx AS (SELECT {by} x, count(*) AS c FROM i GROUP BY {by} x), ry AS (SELECT {by} y, count(*) AS c FROM i GROUP BY {by} y),
e AS (SELECT {by_rx} sum((x <> y)::INT * rx.c * ry.c) AS e0, sum(abs(x - y) * rx.c * ry.c) AS e1, sum((x - y) * (x - y) * rx.c * ry.c) AS e2 FROM rx JOIN ry ON {on} {group_rx})
SELECT {by_t} n, round(raw, 6) AS raw_agreement, round(1 - o0 / nullif(e0 / (n * n), 0), 6) AS kappa, round(1 - o1 / nullif(e1 / (n * n), 0), 6) AS kappa_linear,
round(1 - o2 / nullif(e2 / (n * n), 0), 6) AS kappa_quadratic FROM t JOIN e ON {on_te}"""


@query("e10_kappa", f"WITH {PAIRS}" + _K.format(by="", group="", by_rx="", on="true", group_rx="", by_t="", on_te="true"))
def _(spark, sf):
    return A.kappa(_both(spark, sf))


@query("e12_kappa_by_slot", f"WITH {PAIRS}" + _K.format(by="slot_id,", group="GROUP BY slot_id", by_rx="rx.slot_id,", on="rx.slot_id = ry.slot_id", group_rx="GROUP BY rx.slot_id", by_t="t.slot_id,", on_te="t.slot_id = e.slot_id"))
def _(spark, sf):
    return A.kappa(_both(spark, sf), ("slot_id",))


_LABELS = ", v(label) AS (VALUES ('absent'), ('partial'), ('present')) "


@query("e11_label_agreement", f"WITH {PAIRS}{_LABELS} SELECT label, round(count(*) FILTER (WHERE a = label AND b = label) / nullif(count(*) FILTER (WHERE a = label OR b = label), 0), 6) AS agreement FROM pp, v WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY label")
def _(spark, sf):
    return A.label_agreement(_both(spark, sf))


_FLEISS = """, t AS (SELECT {by} event, sitrep_id, slot_id, count(*) AS r, count(*) FILTER (WHERE verdict = 'absent') AS k0, count(*) FILTER (WHERE verdict = 'partial') AS k1, count(*) FILTER (WHERE verdict = 'present') AS k2
  FROM p GROUP BY ALL HAVING count(*) = 3), g AS (SELECT {by} count(*) AS n_items, avg((k0 * k0 + k1 * k1 + k2 * k2 - 3) / 6.0) AS observed,
  pow(sum(k0) / (count(*) * 3.0), 2) + pow(sum(k1) / (count(*) * 3.0), 2) + pow(sum(k2) / (count(*) * 3.0), 2) AS chance FROM t {group})
SELECT {by} n_items, round(observed, 6) AS observed, round(chance, 6) AS chance, round(CASE WHEN chance < 1 THEN (observed - chance) / (1 - chance) END, 6) AS kappa FROM g"""


@query("e13_fleiss_kappa", f"WITH {J}" + _FLEISS.format(by="", group=""))
def _(spark, sf):
    return A.fleiss(X.population(spark, sf), raters=3)


@query("e14_consensus", f"""WITH {J}, c AS (SELECT event, sitrep_id, slot_id, verdict, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT event, sitrep_id, slot_id, sum(n) AS total, max({{'n': n, 'v': verdict}}) AS m FROM c GROUP BY ALL),
q AS (SELECT event, sitrep_id, slot_id, max(verdict) AS v FROM p WHERE judge = 'j0' GROUP BY ALL)
SELECT event, sitrep_id, slot_id, total::BIGINT AS n, CASE WHEN m.n * 2 > total THEN m.v ELSE q.v END AS consensus FROM t LEFT JOIN q USING (event, sitrep_id, slot_id)""")
def _(spark, sf):
    return A.consensus(X.population(spark, sf), "j0")


@query("e15_missingness", f"""WITH {J}, i AS (SELECT DISTINCT event, sitrep_id, slot_id FROM p), g AS (SELECT v.judge, i.slot_id, count(*) AS n FROM i CROSS JOIN (VALUES ('j0'), ('j1'), ('j2')) v(judge)
  LEFT JOIN p ON p.event = i.event AND p.sitrep_id = i.sitrep_id AND p.slot_id = i.slot_id AND p.judge = v.judge WHERE p.judge IS NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY judge ORDER BY n DESC, slot_id) AS rn FROM g)
SELECT judge, sum(n)::BIGINT AS n_missing, string_agg(slot_id, ',' ORDER BY rn) FILTER (WHERE rn <= 3) AS top_slots FROM r GROUP BY judge""")
def _(spark, sf):
    judges = spark.createDataFrame([(j,) for j in X.JUDGES], "judge string")
    return A.missingness(X.population(spark, sf), judges)


@query("e25_label_scores", f"""WITH {PAIRS}{_LABELS}, k AS (SELECT DISTINCT sitrep_id, kind FROM p), s AS (SELECT pp.*, unnest(['all', k.kind]) AS scope FROM pp JOIN k USING (sitrep_id) WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT scope, label, round(count(*) FILTER (WHERE a = label AND b = label) / nullif(count(*) FILTER (WHERE b = label), 0), 6) AS precision,
round(count(*) FILTER (WHERE a = label AND b = label) / nullif(count(*) FILTER (WHERE a = label), 0), 6) AS recall,
round(2 * count(*) FILTER (WHERE a = label AND b = label) / nullif(count(*) FILTER (WHERE a = label) + count(*) FILTER (WHERE b = label), 0), 6) AS f1 FROM s, v GROUP BY ALL""")
def _(spark, sf):
    p = X.population(spark, sf)
    kinds = p.select("sitrep_id", "kind").distinct()
    return A.label_scores(A.by_scope(_both(spark, sf).join(kinds, "sitrep_id")), ("scope",))


@query("d15_hand_scores", f"""WITH {J}, s AS (SELECT sitrep_id, slot_id, CASE WHEN _seq % 7 = 0 THEN '' ELSE verdict END AS human_verdict FROM l WHERE judge = 'j0' AND event = 'e0'), i AS (SELECT sitrep_id, slot_id, verdict FROM p WHERE judge = 'j1' AND event = 'e0')
SELECT count(*) AS n_rows, count(*) FILTER (WHERE coalesce(trim(human_verdict), '') = '') AS n_blank, count(*) FILTER (WHERE trim(human_verdict) <> '' AND verdict IS NULL) AS n_unmatched,
count(*) FILTER (WHERE trim(human_verdict) <> '' AND verdict IS NOT NULL) AS n_used FROM s LEFT JOIN i USING (sitrep_id, slot_id)""")
def _(spark, sf):
    last = G.last_wins(X.judgements(spark, sf), G.KEY).filter("judge = 'j0' AND event = 'e0'")
    scored = last.select("sitrep_id", "slot_id", F.when(F.col("_seq") % 7 == 0, "").otherwise(F.col("verdict")).alias("human_verdict"))
    index = X.population(spark, sf).filter("judge = 'j1' AND event = 'e0'").select("sitrep_id", "slot_id", "verdict")
    return A.hand_scores(scored, index)


@query("d14_one_to_one", f"""WITH {J}, x AS (SELECT event, sitrep_id, slot_id, count(*) AS n FROM p WHERE judge = 'j0' GROUP BY ALL), y AS (SELECT event, sitrep_id, slot_id, count(*) AS n FROM p WHERE judge = 'j1' GROUP BY ALL),
z AS (SELECT x.n AS na, y.n AS nb FROM x FULL JOIN y ON x.event = y.event AND x.sitrep_id = y.sitrep_id AND x.slot_id = y.slot_id)
SELECT count(na) AS n_left, count(nb) AS n_right, count(*) FILTER (WHERE na > 1 OR nb > 1) AS n_repeated, count(*) FILTER (WHERE na IS NULL OR nb IS NULL) AS n_unmatched, false AS valid FROM z""")
def _(spark, sf):
    p = X.population(spark, sf)
    return A.validate_one_to_one(p.filter("judge = 'j0'"), p.filter("judge = 'j1'"), ("event", "sitrep_id", "slot_id"), 100)


@query("e26_content_gate", f"""WITH {J}, g AS (SELECT *, CASE WHEN length(slot_id) >= 6 THEN 1.0 WHEN length(slot_id) = 5 THEN 0.5 ELSE 0.0 END AS top FROM p WHERE arm = 'm1'),
d AS (SELECT event, judge, sitrep_id, avg(score) AS o, avg(CASE WHEN score = 1 THEN least(score, top) ELSE score END) AS c, sum((score = 1 AND top < 1)::INT) AS k FROM g GROUP BY ALL)
SELECT event, judge, count(*) AS n_documents, round(avg(o), 6) AS original_completeness, round(avg(c), 6) AS content_gated_completeness, sum(k)::BIGINT AS present_cells_downgraded FROM d GROUP BY ALL""")
def _(spark, sf):
    from ..functions.textops import content_score

    p = X.population(spark, sf).filter("arm = 'm1'")
    n = F.length("slot_id")
    body = F.when(n >= 6, "- eight words are enough to support this slot fully").when(n == 5, "* only a few words").otherwise("No information available\n\n> none reported")
    top = content_score(body)
    rows = p.withColumn("top", top).withColumn("gated", F.when(F.col("score") == 1, F.least("score", "top")).otherwise(F.col("score")))
    docs = rows.groupBy("event", "judge", "sitrep_id").agg(F.avg("score").alias("o"), F.avg("gated").alias("c"), F.count_if(F.col("gated") < F.col("score")).alias("k"))
    return docs.groupBy("event", "judge").agg(F.count("*").alias("n_documents"), F.avg("o").alias("original_completeness"), F.avg("c").alias("content_gated_completeness"), F.sum("k").alias("present_cells_downgraded"))


@query("c01_verdict_scores", f"WITH {J} SELECT verdict, CASE lower(trim(verdict)) WHEN 'absent' THEN 0.0 WHEN 'partial' THEN 0.5 WHEN 'present' THEN 1.0 END::DOUBLE AS score, count(*) AS n FROM j GROUP BY verdict")
def _(spark, sf):
    return X.judgements(spark, sf).groupBy("verdict").agg(F.count("*").alias("n")).select("verdict", S.verdict_score("verdict", strict=False).alias("score"), "n")


@query("c02_usable", f"WITH {J} SELECT coalesce(status = 'ok' AND lower(trim(verdict)) IN ('absent', 'partial', 'present'), false) AS usable, count(*) AS n FROM j GROUP BY 1")
def _(spark, sf):
    return X.judgements(spark, sf).groupBy(S.usable("status", "verdict").alias("usable")).agg(F.count("*").alias("n"))


@query("c04_prefixed_arms", f"""WITH {J} SELECT label, count(*) AS n FROM (SELECT CASE WHEN kind = 'human' THEN 'human' ELSE coalesce(CASE WHEN _seq % 5 > 0 THEN 'g' || _seq % 3 END, '') || '/' || CASE WHEN _seq % 2 = 0 THEN 'g' || _seq % 3 || '/' || arm ELSE arm END END AS label FROM j) GROUP BY label""")
def _(spark, sf):
    i = F.col("_seq")
    model = F.concat(F.lit("g"), (i % 3).cast("string"))
    arm = F.when(i % 2 == 0, F.concat(model, F.lit("/"), "arm")).otherwise(F.col("arm"))
    rows = X.judgements(spark, sf).select(S.prefixed_arm(F.col("kind"), arm, F.when(i % 5 > 0, model)).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


@query("c03_arm_labels", f"WITH {J} SELECT kind, arm, count(*) AS n FROM j GROUP BY ALL")
def _(spark, sf):
    return X.judgements(spark, sf).groupBy("kind", "arm").agg(F.count("*").alias("n"))


@query("b05_upsert", f"""WITH {J}, o AS (SELECT sitrep_id, slot_id, max(_seq) AS _seq FROM l WHERE event = 'e0' GROUP BY ALL), n AS (SELECT sitrep_id, slot_id, max(_seq) AS _seq FROM l WHERE event = 'e1' AND _seq % 2 = 0 GROUP BY ALL)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.sitrep_id = o.sitrep_id AND n.slot_id = o.slot_id)""")
def _(spark, sf):
    from ..sources.sinks import upsert

    last = G.last_wins(X.judgements(spark, sf), G.KEY)
    old = last.filter("event = 'e0'").groupBy("sitrep_id", "slot_id").agg(F.max("_seq").alias("_seq"))
    new = last.filter("event = 'e1' AND _seq % 2 = 0").groupBy("sitrep_id", "slot_id").agg(F.max("_seq").alias("_seq"))
    return upsert(old, new, ("sitrep_id", "slot_id"))


@query("b07_judgement_documents", f"WITH {J} SELECT event, sitrep_id, string_agg(judge || ':' || slot_id || ':' || verdict, ';' ORDER BY slot_id, verdict, judge) AS items, round(avg(score), 6) AS completeness FROM p WHERE judge = 'j0' GROUP BY event, sitrep_id")
def _(spark, sf):
    from ..sources.sinks import judgement_documents

    docs = judgement_documents(X.population(spark, sf).filter("judge = 'j0'"))
    items = F.transform("judgements", lambda x: F.concat_ws(":", F.lit("j0"), x["slot_id"], x["verdict"]))
    return docs.select("event", "sitrep_id", F.array_join(items, ";").alias("items"), "completeness")


@query("a26_judgement_index", f"WITH {J} SELECT DISTINCT sitrep_id, slot_id, verdict FROM p WHERE judge = 'j0' AND event = 'e0'")
def _(spark, sf):
    from ..sources.readers import judgement_index
    from ..sources.sinks import judgement_documents

    return judgement_index(judgement_documents(X.population(spark, sf).filter("judge = 'j0' AND event = 'e0'"))).distinct()


@query("l03_blind_sample", f"""WITH {J}, s AS (SELECT *, row_number() OVER (PARTITION BY slot_id, kind ORDER BY md5(concat_ws('|', '17', slot_id, kind, _seq::VARCHAR)), _seq) AS turn FROM p),
v AS (SELECT slot_id, kind, row_number() OVER (ORDER BY slot_id, kind) AS visit FROM (SELECT DISTINCT slot_id, kind FROM p))
SELECT event, sitrep_id, kind, slot_id, _seq FROM s JOIN v USING (slot_id, kind) ORDER BY turn, visit LIMIT 37""")
def _(spark, sf):
    return R.round_robin_sample(X.population(spark, sf), 37, ("slot_id", "kind"), "_seq").select("event", "sitrep_id", "kind", "slot_id", "_seq")


@query("l04_induction_sample", f"""WITH {J}, s AS (SELECT *, row_number() OVER (PARTITION BY event, slot_id ORDER BY md5(concat_ws('|', '5', event, slot_id, _seq::VARCHAR)), _seq) AS turn FROM p),
c AS (SELECT event, slot_id, count(*) AS n FROM p GROUP BY ALL), d AS (SELECT *, sum(n) OVER (PARTITION BY event) AS ld, row_number() OVER (PARTITION BY event ORDER BY n DESC, slot_id) AS depth FROM c),
v AS (SELECT *, row_number() OVER (ORDER BY depth, ld DESC, event) AS visit FROM d)
SELECT event, sitrep_id, slot_id, _seq FROM s JOIN v USING (event, slot_id) ORDER BY turn, visit LIMIT 41""")
def _(spark, sf):
    return R.round_robin_sample(X.population(spark, sf), 41, ("event", "slot_id"), "_seq", 5, "event").select("event", "sitrep_id", "slot_id", "_seq")


@query("l05_stratum_sample", f"""WITH {J}, s AS (SELECT *, row_number() OVER (PARTITION BY slot_id ORDER BY md5(concat_ws('|', '17', slot_id, _seq::VARCHAR)), _seq) AS rn FROM p WHERE slot_id IN ('view', 'click'))
SELECT slot_id, _seq, CASE slot_id WHEN 'view' THEN 'A' ELSE 'O' END || lpad(rn::VARCHAR, 2, '0') AS sample_id FROM s WHERE rn <= CASE slot_id WHEN 'view' THEN 50 ELSE 25 END""")
def _(spark, sf):
    return R.sample_per_stratum(X.population(spark, sf), {"view": 50, "click": 25}, "slot_id", "_seq", prefixes={"view": "A", "click": "O"}).select("slot_id", "_seq", "sample_id")


@query("e16_prevalence", f"WITH {J} SELECT slot_id AS label, round(count(DISTINCT sitrep_id) / 200.0, 6) AS prevalence FROM p WHERE verdict = 'present' AND event = 'e0' AND judge = 'j0' GROUP BY slot_id")
def _(spark, sf):
    return R.prevalence(X.population(spark, sf).filter("verdict = 'present' AND event = 'e0' AND judge = 'j0'").withColumnRenamed("slot_id", "label"), 200)


_CODES = f"""WITH {J}, m AS (SELECT _seq % 40 AS label, sitrep_id, slot_id AS name FROM p WHERE judge = 'j0'), n AS (SELECT label, name, count(*) AS n FROM m GROUP BY ALL)"""


def _codes(spark, sf):
    return X.population(spark, sf).filter("judge = 'j0'").select((F.col("_seq") % 40).alias("label"), "sitrep_id", F.upper("slot_id").alias("name"))


@query("e17_top_names", _CODES + " SELECT label, name, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, name) AS rank FROM n QUALIFY rank <= 3")
def _(spark, sf):
    return R.top_names(_codes(spark, sf), 3).withColumn("rank", F.col("rank").cast("long"))


@query("h04_cluster_order", _CODES + """, t AS (SELECT label, arg_min(name, (-n, name)) AS canonical_name FROM n GROUP BY label), s AS (SELECT label, count(DISTINCT sitrep_id) AS n_sitreps, count(*) AS n_codes FROM m GROUP BY label),
r AS (SELECT *, row_number() OVER w AS rn, (n_codes >= 40) AS large, sum((n_codes >= 40)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS k FROM s JOIN t USING (label) WINDOW w AS (ORDER BY n_sitreps DESC, n_codes DESC, canonical_name, label))
SELECT label, n_sitreps, n_codes, canonical_name, 'S' || lpad(rn::VARCHAR, 2, '0') AS slot_id, (large AND k <= 25) AS kept FROM r""")
def _(spark, sf):
    return R.order_clusters(_codes(spark, sf), 25, 40)
