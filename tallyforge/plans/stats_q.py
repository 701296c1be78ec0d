"""Queries of statistics: ranks, correlations, resampling, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judgements as G
from ..operators import stats as Q
from ..session import table
from . import fixtures as X
from .fixtures import J, SCORES
from .registry import query

_RANKS = f"""WITH {SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY event ORDER BY n_orders) + (count(*) OVER (PARTITION BY event, n_orders) - 1) / 2.0 AS rx,
rank() OVER (PARTITION BY event ORDER BY completeness) + (count(*) OVER (PARTITION BY event, completeness) - 1) / 2.0 AS ry FROM sc)"""


@query("f01_percentiles", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.025), 6) AS lo, round(quantile_cont(o_totalprice, 0.5), 6) AS mid, round(quantile_cont(o_totalprice, 0.975), 6) AS hi FROM orders GROUP BY 1")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_orderpriority")
    return o.agg(*(Q.percentile("o_totalprice", q).alias(n) for q, n in ((0.025, "lo"), (0.5, "mid"), (0.975, "hi"))))


def _draws(n_boot: int, source: str, seed: str = "17") -> str:
    """drawn(b, v): resamples of source(i, v) with count n, one group."""
    return f"""n AS (SELECT count(*) AS n FROM {source}), b AS (SELECT unnest(range({n_boot})) AS b), jj AS (SELECT b, unnest(range((SELECT n FROM n))) AS j FROM b),
drawn AS (SELECT b, v FROM (SELECT b, ('0x' || substr(md5(concat_ws('|', '{seed}', b::VARCHAR, j::VARCHAR)), 1, 8))::BIGINT % (SELECT n FROM n) AS i FROM jj) JOIN {source} USING (i))"""


@query("f02_bootstrap_mean", f"""WITH {J}, d AS (SELECT sitrep_id, avg(score) AS c FROM p WHERE arm = 'human' GROUP BY 1), s AS (SELECT c AS v, row_number() OVER (ORDER BY c, sitrep_id) - 1 AS i FROM d), {_draws(200, 's')},
m AS (SELECT b, avg(v) AS mean FROM drawn GROUP BY b) SELECT (SELECT count(*) FROM s) AS n, round((SELECT avg(v) FROM s), 6) AS point, round(quantile_cont(mean, 0.025), 6) AS ci_lo, round(quantile_cont(mean, 0.975), 6) AS ci_hi FROM m""")
def _(spark, sf):
    docs = X.population(spark, sf).filter("arm = 'human'").groupBy("sitrep_id").agg(F.avg("score").alias("c"))
    return Q.bootstrap_mean(docs, "c", "sitrep_id")


def _arm_draws(n_boot: int) -> str:
    return f"""n AS (SELECT arm, count(*) AS n FROM s GROUP BY arm), jj AS (SELECT arm, n, b, unnest(range(n)) AS j FROM (SELECT arm, n, unnest(range({n_boot})) AS b FROM n)),
drawn AS (SELECT jj.arm, b, v FROM (SELECT arm, b, ('0x' || substr(md5(concat_ws('|', '17', arm, b::VARCHAR, j::VARCHAR)), 1, 8))::BIGINT % n AS i FROM jj) jj JOIN s ON s.arm = jj.arm AND s.i = jj.i)"""


_DOCS = f"""WITH {J}, d AS (SELECT arm, sitrep_id, avg(score) AS c FROM p GROUP BY ALL), s AS (SELECT arm, sitrep_id, c AS v, row_number() OVER (PARTITION BY arm ORDER BY c, sitrep_id) - 1 AS i FROM d)"""


@query("e03_completeness_with_interval", f"""{_DOCS}, {_arm_draws(200)}, m AS (SELECT arm, b, avg(v) AS mean FROM drawn GROUP BY ALL), c AS (SELECT arm, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM m GROUP BY arm)
SELECT arm, (SELECT count(*) FROM s WHERE s.arm = c.arm) AS n, round((SELECT avg(v) FROM s WHERE s.arm = c.arm), 6) AS point, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi FROM c""")
def _(spark, sf):
    docs = X.population(spark, sf).groupBy("arm", "sitrep_id").agg(F.avg("score").alias("c"))
    return Q.bootstrap_mean(docs, "c", "sitrep_id", ("arm",))


@query("f04_bootstrap_difference", f"""{_DOCS}, {_arm_draws(200)}, m AS (SELECT b, avg(v) FILTER (WHERE arm = 'm0') - avg(v) FILTER (WHERE arm = 'human') AS d FROM drawn WHERE arm IN ('m0', 'human') GROUP BY b), r AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k FROM m)
SELECT round((SELECT avg(v) FROM s WHERE arm = 'm0') - (SELECT avg(v) FROM s WHERE arm = 'human'), 6) AS difference, round((SELECT d FROM r WHERE k = 4), 6) AS ci_lo, round((SELECT d FROM r WHERE k = 195), 6) AS ci_hi""")
def _(spark, sf):
    docs = X.population(spark, sf).groupBy("arm", "sitrep_id").agg(F.avg("score").alias("c"))
    return Q.bootstrap_difference(docs, "c", "arm", "m0", "human", "sitrep_id")


@query("f05_permutation", f"""{_DOCS}, x AS (SELECT * FROM s WHERE arm IN ('m0', 'human')), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE arm = 'm0') AS na, sum(v) AS sv, sum(v) FILTER (WHERE arm = 'm0') AS sa FROM x),
q AS (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY md5(concat_ws('|', '17', p::VARCHAR, sitrep_id)), sitrep_id) AS rn FROM x CROSS JOIN (SELECT unnest(range(200)) AS p)),
g AS (SELECT p, sum(v) FILTER (WHERE rn <= (SELECT na FROM t)) AS sp FROM q GROUP BY p)
SELECT round((count(*) FILTER (WHERE abs(sp / na - (sv - sp) / (n - na)) >= abs(sa / na - (sv - sa) / (n - na)) - 1e-9) + 1) / 201.0, 6) AS p_value, round(any_value(abs(sa / na - (sv - sa) / (n - na))), 6) AS observed FROM g, t""")
def _(spark, sf):
    docs = X.population(spark, sf).groupBy("arm", "sitrep_id").agg(F.avg("score").alias("c"))
    return Q.permutation_test(docs, "c", "arm", "m0", "human", "sitrep_id")


@query("f06_spearman", _RANKS + " SELECT event, count(*) AS n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) AS rho FROM r GROUP BY event")
def _(spark, sf):
    return Q.spearman(X.pairs(spark, sf), "n_orders", "completeness", ("event",)).drop("p_value")


#: The two tails of Student's t as an integral of cosines, by Simpson's rule over 4,000 steps.
@query("f06_spearman_p", _RANKS + """, q AS (SELECT event, count(*) AS n, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS rho FROM r GROUP BY event),
t AS (SELECT *, asin(abs(rho)) AS lo, (pi() / 2 - asin(abs(rho))) / 4000 AS h FROM q), i AS (SELECT unnest(range(4001)) AS i),
s AS (SELECT event, sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(cos(lo + i * h), 0), n - 3)) * any_value(h) / 3 AS tail FROM t CROSS JOIN i GROUP BY event)
SELECT event, n, round(rho, 6) AS rho, round(2 * tail * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt(pi()), 6) AS p_value FROM t JOIN s USING (event)""")
def _(spark, sf):
    return Q.spearman(X.pairs(spark, sf), "n_orders", "completeness", ("event",))


@query("f07_kendall", f"""WITH {SCORES}, k AS (SELECT a.event, sign(a.n_orders - b.n_orders) AS dx, sign(a.completeness - b.completeness) AS dy FROM sc a JOIN sc b ON a.event = b.event AND a.sitrep_id < b.sitrep_id)
SELECT event, (SELECT count(*) FROM sc WHERE sc.event = k.event) AS n, round(sum(dx * dy) / sqrt(sum((dx <> 0)::INT)) / sqrt(sum((dy <> 0)::INT)), 6) AS tau FROM k GROUP BY event""")
def _(spark, sf):
    return Q.kendall(X.pairs(spark, sf), "n_orders", "completeness", ("event",)).drop("p_value")


@query("f08_clean_pairs", "SELECT count(*) AS n, count(DISTINCT value) AS nx FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0")
def _(spark, sf):
    i = F.col("event_id")
    e = table(spark, sf, "events").select(F.when(i % 7 != 0, F.col("value")).alias("a"), F.when(i % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("b"))
    return Q.clean_pairs(e, "a", "b").agg(F.count("*").alias("n"), F.count_distinct("x").alias("nx"))


@query("f09_percentile_ranks", _RANKS + " SELECT sitrep_id, round(CASE WHEN count(*) OVER (PARTITION BY event) = 1 THEN 0.5 ELSE (rx - 1) / (count(*) OVER (PARTITION BY event) - 1) END, 6) AS pct FROM r")
def _(spark, sf):
    return Q.percentile_rank(X.pairs(spark, sf), "n_orders", "pct", ("event",)).select("sitrep_id", "pct")


@query("g01_average_ranks", _RANKS + " SELECT sitrep_id, round(rx, 6) AS r FROM r")
def _(spark, sf):
    return Q.average_rank(X.pairs(spark, sf), "n_orders", "r", ("event",)).select("sitrep_id", "r")


#: Both ends by bisection of the binomial tail; 50 halvings of the unit interval.
@query("f10_exact_binomial", f"""WITH RECURSIVE {J}, e AS (SELECT slot_id, count(*) FILTER (WHERE verdict = 'absent') AS errors, count(*) AS total FROM p GROUP BY 1),
b(slot_id, errors, total, side, lo, hi, step) AS (SELECT slot_id, errors, total, side, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM e CROSS JOIN (VALUES (0), (1)) s(side) UNION ALL
  SELECT slot_id, errors, total, side, CASE WHEN low THEN mid ELSE lo END, CASE WHEN low THEN hi ELSE mid END, step + 1 FROM (SELECT *, CASE side
    WHEN 0 THEN list_sum(list_transform(range(errors, total + 1), lambda k: exp(lgamma(total + 1) - lgamma(k + 1) - lgamma(total - k + 1) + k * ln(mid) + (total - k) * ln(1 - mid)))) < 0.025
    ELSE list_sum(list_transform(range(0, errors + 1), lambda k: exp(lgamma(total + 1) - lgamma(k + 1) - lgamma(total - k + 1) + k * ln(mid) + (total - k) * ln(1 - mid)))) > 0.025 END AS low
    FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE step < 50)))
SELECT slot_id, errors, total, round(CASE WHEN errors = 0 THEN 0.0 ELSE max(lo) FILTER (WHERE side = 0) END, 6) AS ci_lo, round(CASE WHEN errors = total THEN 1.0 ELSE max(lo) FILTER (WHERE side = 1) END, 6) AS ci_hi
FROM b WHERE step = 50 GROUP BY slot_id, errors, total""")
def _(spark, sf):
    rows = X.population(spark, sf).groupBy("slot_id").agg(F.count_if(F.col("verdict") == "absent").alias("errors"), F.count("*").alias("total"))
    return Q.add_exact_binomial(rows, "errors", "total")


@query("f11_holm", """WITH t AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 101) / 400.0::DOUBLE AS p_raw FROM supplier), s AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p_raw, id) + 1) * p_raw) AS st FROM t)
SELECT id, round(p_raw, 6) AS p_raw, round(max(st) OVER (ORDER BY p_raw, id ROWS UNBOUNDED PRECEDING), 6) AS p_holm, (max(st) OVER (ORDER BY p_raw, id ROWS UNBOUNDED PRECEDING) < 0.05)::INT AS significant_holm_05 FROM s""")
def _(spark, sf):
    t = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 37 % 101) / F.lit(400.0)).alias("p_raw"))
    return Q.holm(t, "p_raw", "id")


@query("f12_correlation_report", f"""WITH {SCORES}, u AS (SELECT unnest(['pooled', event]) AS scope, completeness, n_orders, spent FROM sc), v AS (SELECT scope, completeness, 'n_orders' AS metric, n_orders AS x FROM u UNION ALL SELECT scope, completeness, 'spent', spent FROM u),
r AS (SELECT *, rank() OVER (PARTITION BY scope, metric ORDER BY x) + (count(*) OVER (PARTITION BY scope, metric, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY scope, metric ORDER BY completeness) + (count(*) OVER (PARTITION BY scope, metric, completeness) - 1) / 2.0 AS ry FROM v)
SELECT scope, metric, count(*) AS n, round(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)), 6) AS rho FROM r GROUP BY ALL""")
def _(spark, sf):
    return Q.correlation_report(X.pairs(spark, sf), ("n_orders", "spent")).drop("p_value")


@query("f03_rank_interval", f"""WITH {SCORES}, s AS (SELECT n_orders AS x, completeness AS y, row_number() OVER (ORDER BY sitrep_id) - 1 AS i FROM sc), n AS (SELECT count(*) AS n FROM s), jj AS (SELECT b, unnest(range((SELECT n FROM n))) AS j FROM (SELECT unnest(range(100)) AS b)),
d AS (SELECT b, x, y FROM (SELECT b, ('0x' || substr(md5(concat_ws('|', '17', b::VARCHAR, j::VARCHAR)), 1, 8))::BIGINT % (SELECT n FROM n) AS i FROM jj) JOIN s USING (i)),
r AS (SELECT b, rank() OVER (PARTITION BY b ORDER BY x) + (count(*) OVER (PARTITION BY b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY b ORDER BY y) + (count(*) OVER (PARTITION BY b, y) - 1) / 2.0 AS ry FROM d),
k AS (SELECT b, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS rho FROM r GROUP BY b)
SELECT round(quantile_cont(rho, 0.025), 6) AS ci_lo, round(quantile_cont(rho, 0.975), 6) AS ci_hi, count(*) AS n_usable FROM k""")
def _(spark, sf):
    return Q.bootstrap_rank_correlation(X.pairs(spark, sf), "n_orders", "completeness", "sitrep_id", n_boot=100)


@query("g02_disagreements", f"""WITH {SCORES}, v AS (SELECT sitrep_id, completeness, 'n_orders' AS metric, n_orders AS x FROM sc UNION ALL SELECT sitrep_id, completeness, 'spent', spent FROM sc),
r AS (SELECT *, (rank() OVER (PARTITION BY metric ORDER BY x) + (count(*) OVER (PARTITION BY metric, x) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY metric) - 1) AS mp, (rank() OVER (PARTITION BY metric ORDER BY completeness) + (count(*) OVER (PARTITION BY metric, completeness) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY metric) - 1) AS cp FROM v),
g AS (SELECT *, mp - cp AS gap, CASE WHEN mp > cp THEN 'high_metric_low_score' ELSE 'low_metric_high_score' END AS direction FROM r WHERE mp <> cp)
SELECT metric, direction, sitrep_id, round(gap, 6) AS gap, row_number() OVER (PARTITION BY metric, direction ORDER BY abs(gap) DESC, sitrep_id::VARCHAR)::INT AS rank FROM g QUALIFY rank <= 5""")
def _(spark, sf):
    return Q.disagreements(X.pairs(spark, sf), ("n_orders", "spent")).select("metric", "direction", "sitrep_id", "gap", "rank")


@query("g04_cumulative_maximum", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM events")
def _(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").select("event_id", F.max("value").over(w).alias("running"))


@query("e20_arm_means_pooled", f"WITH {J} SELECT CASE WHEN grouping(arm) = 1 THEN 'POOLED' ELSE arm END AS arm, count(*) AS n, round(avg(score), 6) AS score FROM p GROUP BY GROUPING SETS ((arm), ())")
def _(spark, sf):
    return G.with_totals(X.population(spark, sf), "arm", "POOLED", {"n": F.count("*"), "score": F.avg("score")})


@query("e29_audit_summary", f"WITH {J} SELECT slot_id AS stratum, count(*) FILTER (WHERE verdict = 'absent') AS errors, count(*) AS total, round(count(*) FILTER (WHERE verdict = 'absent') / count(*), 6) AS rate FROM p GROUP BY 1")
def _(spark, sf):
    rows = X.population(spark, sf).groupBy(F.col("slot_id").alias("stratum")).agg(F.count_if(F.col("verdict") == "absent").alias("errors"), F.count("*").alias("total"))
    return rows.withColumn("rate", F.col("errors") / F.col("total"))


@query("f02_seeded_bootstrap")
def _(spark, sf):
    docs = X.population(spark, sf).groupBy("arm", "sitrep_id").agg(F.avg("score").alias("c"))
    return Q.grouped_bootstrap(docs, "c", "sitrep_id", ("arm",), n_boot=200)


@query("f13_inversion", f"""{_DOCS}, {_arm_draws(400)}, m AS (SELECT b, avg(v) FILTER (WHERE arm = 'm1') - avg(v) FILTER (WHERE arm = 'human') AS d FROM drawn WHERE arm IN ('m1', 'human') GROUP BY b), r AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k FROM m),
x AS (SELECT * FROM s WHERE arm IN ('m1', 'human')), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE arm = 'm1') AS na, sum(v) AS sv, sum(v) FILTER (WHERE arm = 'm1') AS sa FROM x),
q AS (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY md5(concat_ws('|', '17', p::VARCHAR, sitrep_id)), sitrep_id) AS rn FROM x CROSS JOIN (SELECT unnest(range(400)) AS p)),
g AS (SELECT p, sum(v) FILTER (WHERE rn <= (SELECT na FROM t)) AS sp FROM q GROUP BY p)
SELECT round((SELECT avg(v) FROM s WHERE arm = 'm1') - (SELECT avg(v) FROM s WHERE arm = 'human'), 6) AS difference, round((SELECT d FROM r WHERE k = 9), 6) AS ci_lo, round((SELECT d FROM r WHERE k = 390), 6) AS ci_hi,
round((count(*) FILTER (WHERE abs(sp / na - (sv - sp) / (n - na)) >= abs(sa / na - (sv - sa) / (n - na)) - 1e-9) + 1) / 401.0, 6) AS p_value, round(any_value(abs(sa / na - (sv - sa) / (n - na))), 6) AS observed FROM g, t""")
def _(spark, sf):
    docs = X.population(spark, sf).groupBy("arm", "sitrep_id").agg(F.avg("score").alias("c"))
    a = Q.bootstrap_difference(docs, "c", "arm", "m1", "human", "sitrep_id", n_boot=400)
    return a.join(Q.permutation_test(docs, "c", "arm", "m1", "human", "sitrep_id", n_perm=400), how="cross")  # one row each


@query("q_label_kappa", """WITH x AS (SELECT CASE quality WHEN 1 THEN 'present' ELSE 'absent' END AS a, CASE toxic WHEN 0 THEN 'present' ELSE 'absent' END AS b FROM labels), t AS (SELECT count(*)::DOUBLE AS n, avg((a = b)::INT) AS po,
avg((a = 'present')::INT) AS pa, avg((b = 'present')::INT) AS pb FROM x) SELECT n::BIGINT AS n, round(po, 6) AS raw_agreement, round(1 - (1 - po) / nullif(1 - (pa * pb + (1 - pa) * (1 - pb)), 0), 6) AS kappa FROM t""")
def _(spark, sf):
    from ..operators.agreement import kappa

    said = lambda c: F.when(c, "present").otherwise("absent")
    rows = table(spark, sf, "labels").select(said(F.col("quality") == 1).alias("a"), said(F.col("toxic") == 0).alias("b"))
    return kappa(rows).select("n", "raw_agreement", "kappa")
