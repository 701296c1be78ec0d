"""Rank statistics, resampling, multiplicity and exact intervals."""

from __future__ import annotations

import functools
import hashlib
import math
import random
from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import least_sums, number_rows, written

SEED = 17
#: Pairs of a group up to which one task counts them for Kendall's tau; a larger group is counted over ranges.
WHOLE_GROUP = 1 << 18
#: Ranges of a large group: their grid, this number squared, is summed in one task.
RANGES = 512
#: Pairs of a range at least.
LEAST_RANGE = 1 << 17


def percentile(column, q: float) -> Column:
    """Linear interpolation between order statistics."""
    return F.percentile(column, F.lit(q))


def average_rank(rows: DataFrame, column: str, name: str, by=()) -> DataFrame:
    """Ranks from 1 in which ties share their mean rank."""
    order = Window.partitionBy(*by).orderBy(column)
    ties = F.count("*").over(Window.partitionBy(*by, column))
    return rows.withColumn(name, F.rank().over(order) + (ties - 1) / 2.0)


def percentile_rank(rows: DataFrame, column: str, name: str, by=()) -> DataFrame:
    """Average ranks scaled to 0..1; a single value is 0.5."""
    n = F.count("*").over(Window.partitionBy(*by))
    ranked = average_rank(rows, column, "__r", by)
    return ranked.withColumn(name, F.when(n == 1, 0.5).otherwise((F.col("__r") - 1) / (n - 1))).drop("__r")


def clean_pairs(rows: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Pairs without null or NaN."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))
    return rows.filter(ok).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def spearman(rows: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """n, rho and its two-sided p by t; null under three pairs or with a constant side."""
    pairs = average_rank(average_rank(clean_pairs(rows, x, y, by), "x", "rx", by), "y", "ry", by)
    spread = F.stddev_pop("rx") * F.stddev_pop("ry")
    stats = pairs.groupBy(*by).agg(F.count("*").alias("n"), (F.covar_pop("rx", "ry") / F.nullif(spread, F.lit(0.0))).alias("rho"))
    defined = (F.col("n") >= 3) & F.col("rho").isNotNull()  # greatest and least would skip a null
    stats = stats.withColumn("rho", F.when(defined, F.greatest(F.least("rho", F.lit(1.0)), F.lit(-1.0))))
    return stats.withColumn("p_value", _t_p(F.col("rho"), F.col("n")))


def kendall(rows: DataFrame, x: str, y: str, by=(), *, whole: int = WHOLE_GROUP) -> DataFrame:
    """n, tau-b and its two-sided p of every group, in O(n log n).

    Groups of up to ``whole`` pairs are counted in one task each, larger ones over ranges, with the same result.
    """
    by = list(by)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean_pairs(rows, x, y, by).schema.fields if f.name in by)
    out = f"{types + ', ' if types else ''}n long, tau double, p_value double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tau, p = kendall_tau_b(pdf["x"].to_numpy(), pdf["y"].to_numpy())
        return pd.DataFrame({b: [pdf[b].iloc[0]] for b in by} | {"n": [len(pdf)], "tau": [tau], "p_value": [p]})

    pairs = clean_pairs(rows, x, y, by)
    large = pairs.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > whole)
    if large.limit(1).count() == 0:
        return pairs.groupBy(*by).applyInPandas(one, out)
    if not by:
        return _kendall_by_ranges(pairs, by).select("n", "tau", "p_value")
    # A null key is a group like any other, so the two sides are told apart by a null-safe join.
    names = [F.col(b).alias(f"__l{i}") for i, b in enumerate(by)]
    of = functools.reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"__l{i}")) for i, b in enumerate(by)))
    large = F.broadcast(large.select(*names))  # fewer than a row for each `whole` pairs
    small = pairs.join(large, of, "left_anti").groupBy(*by).applyInPandas(one, out)
    return small.union(_kendall_by_ranges(pairs.join(large, of, "left_semi"), by).select(*by, "n", "tau", "p_value"))


def inversions(ranks: np.ndarray) -> int:
    """Pairs out of order among distinct integers: at each bit from the highest, the ones before each zero of equal higher bits."""
    r = np.argsort(np.argsort(ranks, kind="stable"), kind="stable")
    total = 0
    for bit in range(int(len(r)).bit_length() - 1, -1, -1):
        ones = (r >> bit) & 1
        head = r >> (bit + 1)  # rows of one head are contiguous, in their order
        before = np.cumsum(ones) - ones
        new = np.ones(len(r), bool)
        new[1:] = head[1:] != head[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
        total += int((before - before[start])[ones == 0].sum())
        r = r[np.lexsort((np.arange(len(r)), ones, head))]
    return total


def _kendall_by_ranges(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Tau-b of groups of any size.

    Rows are numbered in the order of x and in that of y, each with the other and then the first number behind ties,
    so that pairs out of order are exactly the discordant ones. Both orders are cut into ranges. Two rows out of
    order lie in one x-range, or in one y-range, or in two of each: the first two are counted inside the ranges, a
    task each, and the last by sums over the grid of counts by x-range and y-range, which a group has once.
    """
    px = number_rows(pairs, [*by, "x", "y"], "px")
    both = number_rows(px, [*by, "y", "px"], "py")
    size = F.lit(max(LEAST_RANGE, -(-px.count() // RANGES)))
    ranks = [*by, "px", "py", "a", "b"]
    both = written(both.withColumn("a", F.expr("px") - F.expr("px") % size).withColumn("b", F.expr("py") - F.expr("py") % size).select(*ranks), "ranges")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields if f.name in by)
    out = f"{types + ', ' if types else ''}swaps decimal(38,0)"

    def swaps(pdf: pd.DataFrame, count) -> pd.DataFrame:
        return pd.DataFrame({b: [pdf[b].iloc[0]] for b in by} | {"swaps": [Decimal(count)]})

    def in_x(pdf: pd.DataFrame) -> pd.DataFrame:
        return swaps(pdf, inversions(pdf["py"].to_numpy()[np.argsort(pdf["px"].to_numpy())]))

    def in_y(pdf: pd.DataFrame) -> pd.DataFrame:  # rows of one x-range are in order here, so only those of two count
        return swaps(pdf, inversions(pdf["py"].to_numpy()[np.lexsort((pdf["py"].to_numpy(), pdf["a"].to_numpy()))]))

    def in_grid(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.unique(pdf[c].to_numpy(), return_inverse=True)[1] for c in ("a", "b"))
        grid = np.zeros((a.max() + 1, b.max() + 1))
        grid[a, b] = pdf["n"].to_numpy()
        above = np.cumsum(grid[:, ::-1], axis=1)[:, ::-1] - grid  # of each x-range, in later y-ranges
        earlier = np.cumsum(above, axis=0) - above
        return swaps(pdf, sum(int(p) * int(q) for p, q in zip(grid.ravel(), earlier.ravel(), strict=True)))

    found = both.groupBy(*by, "a").applyInPandas(in_x, out).union(both.groupBy(*by, "b").applyInPandas(in_y, out))
    found = found.union(both.groupBy(*by, "a", "b").agg(F.count("*").alias("n")).groupBy(*by).applyInPandas(in_grid, out))
    stats = found.groupBy(*by).agg(F.sum("swaps").alias("swaps"))
    t = F.col("t").cast("decimal(38,0)")
    for name, columns in (("x", ["x"]), ("y", ["y"]), ("xy", ["x", "y"])):
        ties = pairs.groupBy(*by, *columns).agg(F.count("*").alias("t"))
        total = lambda c: F.sum(c.cast("decimal(38,0)"))
        ties = ties.groupBy(*by).agg(
            F.sum("t").alias(f"n{name}"), total(t * (t - 1) / 2).alias(f"t{name}"), total(t * (t - 1) * (t - 2)).alias(f"{name}0"), total(t * (t - 1) * (2 * t + 5)).alias(f"{name}1"), F.count("*").alias(f"d{name}")
        )
        if by:
            named = ties.select(*(F.col(b).alias(f"__{name}{i}") for i, b in enumerate(by)), *(c for c in ties.columns if c not in by))
            stats = stats.join(named, functools.reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"__{name}{i}")) for i, b in enumerate(by))))
        else:
            stats = stats.join(ties, how="cross")  # one row each

    @F.pandas_udf("tau double, p_value double")
    def tau(*columns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tau_from_counts(*map(int, row)) for row in zip(*columns, strict=True)], columns=["tau", "p_value"])

    numbers = ["nx", "swaps", "tx", "x0", "x1", "dx", "ty", "y0", "y1", "dy", "txy"]
    return stats.select(*by, F.col("nx").alias("n"), tau(*(F.col(c).cast("string") for c in numbers)).alias("k")).select(*by, "n", "k.tau", "k.p_value")


def _pairs_equal(values: np.ndarray) -> tuple[int, int, int]:
    """Sums over tie groups: t(t-1)/2, t(t-1)(t-2) and t(t-1)(2t+5)."""
    t = np.unique(values, return_counts=True, axis=0)[1].astype(object)
    return int((t * (t - 1)).sum() // 2), int((t * (t - 1) * (t - 2)).sum()), int((t * (t - 1) * (2 * t + 5)).sum())


def kendall_tau_b(x: np.ndarray, y: np.ndarray) -> tuple[float | None, float | None]:
    """Tau-b and its p: exact without ties for small samples, else normal; (None, None) when undefined."""
    order = np.lexsort((y, x))
    y = np.unique(y, return_inverse=True)[1][order]
    x = np.unique(x, return_inverse=True)[1][order]
    swaps = inversions(np.argsort(np.lexsort((np.arange(len(y)), y))))  # equal values keep their order
    tx, x0, x1 = _pairs_equal(x)
    ty, y0, y1 = _pairs_equal(y)
    txy = _pairs_equal(np.stack([x, y], axis=1))[0]
    return tau_from_counts(len(x), swaps, tx, x0, x1, len(np.unique(x)), ty, y0, y1, len(np.unique(y)), txy)


def tau_from_counts(n, swaps, tx, x0, x1, dx, ty, y0, y1, dy, txy) -> tuple[float | None, float | None]:
    """Tau-b and its p from the discordant pairs, the sums over tie groups and the numbers of different values."""
    if n < 3 or dx < 2 or dy < 2:
        return None, None
    total = n * (n - 1) // 2
    score = total - tx - ty + txy - 2 * swaps
    tau = max(-1.0, min(1.0, score / math.sqrt(total - tx) / math.sqrt(total - ty)))
    if tx == 0 and ty == 0 and (n <= 33 or min(swaps, total - swaps) <= 1):
        return tau, _kendall_exact(n, min(swaps, total - swaps))
    m = n * (n - 1.0)
    var = (m * (2 * n + 5) - x1 - y1) / 18 + 2.0 * tx * ty / m + x0 * y0 / (9 * m * (n - 2))
    return tau, math.erfc(abs(score) / math.sqrt(var) / math.sqrt(2))


def _kendall_exact(n: int, c: int) -> float:
    """Two-sided p from the number of permutations with at most c inversions."""
    if n * (n - 1) == 4 * c:
        return 1.0
    ways = [1]
    for i in range(2, n + 1):  # permutations of i by inversions up to c
        ways = [sum(ways[max(0, k - i + 1) : k + 1]) for k in range(min(c, i * (i - 1) // 2) + 1)]
    return min(1.0, 2.0 * sum(ways[: c + 1]) / math.factorial(n))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    f = 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            k = 1.0
        elif i % 2 == 0:
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + k * d or tiny)
        c = 1.0 + k / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1.0)


def beta_quantile(q: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if incomplete_beta(a, b, mid) < q else (lo, mid)
    return (lo + hi) / 2


def exact_binomial(errors: int, total: int, alpha: float = 0.05) -> tuple[float, float]:
    """Clopper-Pearson interval."""
    lo = 0.0 if errors == 0 else beta_quantile(alpha / 2, errors, total - errors + 1)
    hi = 1.0 if errors == total else beta_quantile(1 - alpha / 2, errors + 1, total - errors)
    return lo, hi


def add_exact_binomial(rows: DataFrame, errors: str, total: str, alpha: float = 0.05) -> DataFrame:
    @F.pandas_udf("lo double, hi double")
    def interval(e: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([exact_binomial(int(a), int(b), alpha) for a, b in zip(e, n, strict=True)], columns=["lo", "hi"])

    return rows.withColumn("__ci", interval(errors, total)).withColumn("ci_lo", F.col("__ci.lo")).withColumn("ci_hi", F.col("__ci.hi")).drop("__ci")


def _t_p(rho: Column, n: Column) -> Column:
    @F.pandas_udf("double")
    def p(r: pd.Series, m: pd.Series) -> pd.Series:
        def one(a, k):
            if a is None or math.isnan(a) or k < 3:
                return None
            df = k - 2
            return incomplete_beta(df / 2, 0.5, 1 - a * a)  # two tails of t at r * sqrt(df / (1 - r^2))

        return pd.Series([one(a, k) for a, k in zip(r, m, strict=True)], dtype="float64")

    return p(rho, n)


def holm(rows: DataFrame, p: str, id_col: str, by=()) -> DataFrame:
    """Step-down adjustment: the running maximum of (m - rank) * p, at most 1."""
    order = Window.partitionBy(*by).orderBy(p, id_col)
    m, rank = F.count("*").over(Window.partitionBy(*by)), F.row_number().over(order)
    stepped = rows.withColumn("__s", F.least(F.lit(1.0), (m - rank + 1) * F.col(p)))
    out = stepped.withColumn("p_holm", F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")
    return out.withColumn("significant_holm_05", (F.col("p_holm") < 0.05).cast("int"))


# Resampling. Draws are md5 of seed, resample and place, so any engine and any partitioning agrees.


def _draw(n: Column, *parts) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") % n


#: Draws of a row that is dealt to tasks before its draws are made.
STRETCH = 1 << 16


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows over all shuffle partitions; what follows makes many of each, and few rows would lie in one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _places(sizes: DataFrame, n_boot: int) -> DataFrame:
    """The rows of sizes(.., n) with every resample b and place j below n, made in stretches that are dealt to all tasks."""
    stretches = sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("__at", F.explode(F.expr(f"sequence(0L, (n - 1) div {STRETCH})")))
    return _dealt(stretches.filter("n > 0")).withColumn("j", F.explode(F.expr(f"sequence(__at * {STRETCH}, least(n, (__at + 1) * {STRETCH}) - 1)"))).drop("__at")


def resampled_means(rows: DataFrame, value: str, order: str, by=(), *, n_boot: int = 200, seed: int = SEED, tag: str = "") -> DataFrame:
    """(by, b, mean): the mean of each resample with replacement.

    Values are numbered in a total order; resample b's draw i is looked up by an equi-join.
    """
    at = Window.partitionBy(*by).orderBy(value, order)
    numbered = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"), (F.row_number().over(at) - 1).alias("i"))
    sizes = numbered.groupBy(*by).agg(F.count("*").alias("n"))
    places = _places(sizes, n_boot)
    label = [F.lit(str(seed) + tag), *(F.col(c).cast("string") for c in by), F.col("b").cast("string"), F.col("j").cast("string")]
    drawn = places.withColumn("i", _draw(F.col("n"), *label)).select(*by, "b", "i")
    return drawn.join(numbered, [*by, "i"]).groupBy(*by, "b").agg(F.avg("v").alias("mean"))


def bootstrap_mean(rows: DataFrame, value: str, order: str, by=(), *, n_boot: int = 200, alpha: float = 0.05, seed: int = SEED) -> DataFrame:
    """Point and percentile interval of the mean by group."""
    means = resampled_means(rows, value, order, by, n_boot=n_boot, seed=seed)
    interval = means.groupBy(*by).agg(percentile("mean", alpha / 2).alias("ci_lo"), percentile("mean", 1 - alpha / 2).alias("ci_hi"))
    point = rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("point"))
    return point.join(interval, list(by)) if by else point.join(F.broadcast(interval), how="cross")


def bootstrap_difference(rows: DataFrame, value: str, group: str, a: str, b: str, order: str, *, n_boot: int = 200, seed: int = SEED) -> DataFrame:
    """Difference of two groups' means with an interval of order statistics (floor below, ceiling above)."""
    means = resampled_means(rows.filter(F.col(group).isin(a, b)), value, order, (group,), n_boot=n_boot, seed=seed)
    side = lambda g: F.max(F.when(F.col(group) == g, F.col("mean")))
    diffs = means.groupBy("b").agg((side(a) - side(b)).alias("d"))
    ranked = diffs.withColumn("rn", F.row_number().over(Window.orderBy("d")) - 1)  # n_boot rows
    lo, hi = math.floor(0.025 * (n_boot - 1)), math.ceil(0.975 * (n_boot - 1))
    mean = lambda g: F.avg(F.when(F.col(group) == g, F.col(value)))
    point = rows.agg((mean(a) - mean(b)).alias("difference"))
    at = lambda k, n: F.max(F.when(F.col("rn") == k, F.col("d"))).alias(n)
    return point.join(ranked.agg(at(lo, "ci_lo"), at(hi, "ci_hi")), how="cross")  # one row each


def permutation_test(rows: DataFrame, value: str, group: str, a: str, b: str, order: str, *, n_perm: int = 200, seed: int = SEED) -> DataFrame:
    """Two-sided p of the difference of means: (as extreme + 1) / (permutations + 1).

    A permutation gives group a the rows with the smallest hashes; their sum is found by selection, not by sorting.
    """
    pool = rows.filter(F.col(group).isin(a, b)).select(F.col(value).cast("double").alias("v"), (F.col(group) == a).alias("in_a"), F.col(order).cast("string").alias("o"))
    sums = pool.agg(F.count("*").alias("n"), F.count_if("in_a").alias("na"), F.sum("v").alias("sv"), F.sum(F.when(F.col("in_a"), F.col("v"))).alias("sa"))
    perms = _dealt(pool).join(F.broadcast(sums.select("na")), how="cross").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))  # one row
    keyed = perms.select("p", "v", "na", F.concat(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("p").cast("string"), "o")), "o").alias("key"))
    drawn = least_sums(keyed, "p", "key", "v", "na").join(F.broadcast(sums), how="cross")  # one row
    gap = lambda s: F.abs(F.col(s) / F.col("na") - (F.col("sv") - F.col(s)) / (F.col("n") - F.col("na")))
    return drawn.agg(((F.count_if(gap("s") >= gap("sa") - 1e-9) + 1) / F.lit(float(n_perm + 1))).alias("p_value"), F.first(gap("sa")).alias("observed"))


#: Draws that a task makes of a resample at once, and rows of the table that are drawn from together, whose places are two bytes.
DRAWS, DRAWN_FROM = 1 << 20, 1 << 14


def _draw_blocks(seed: int, size: int):
    """Of stretches (b, at, n) of draws: the places drawn from each block of ``size`` rows, as one value of two bytes a draw."""

    def run(batches):
        for batch in batches:
            for b, at, n in zip(*(batch.column(c).to_pylist() for c in ("b", "at", "n")), strict=True):
                head, md5 = f"{seed}|{b}|".encode(), hashlib.md5
                drawn = b"".join([md5(head + b"%d" % j).digest()[:4] for j in range(at * DRAWS, min(n, (at + 1) * DRAWS))])
                i = np.frombuffer(drawn, ">u4").astype(np.int64) % n
                block, first = np.unique(np.sort(i) // size, return_index=True)
                places = np.split((np.sort(i) % size).astype(np.uint16), first[1:])
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(np.full(len(block), b), pa.int32()), pa.array([p.tobytes() for p in places], pa.binary())], names=["block", "b", "places"])

    return run


def _drawn_ranks(size: int):
    """Of a block of rows (i, x, y) and what was drawn from it: for each resample the rows drawn, with how often."""

    def run(key, drawn: pa.Table, rows: pa.Table) -> pa.Table:
        at = rows.column("i").to_numpy() % size
        x, y = np.zeros(size, np.int32), np.zeros(size, np.int32)
        x[at], y[at] = rows.column("x").to_numpy(), rows.column("y").to_numpy()
        out, of = [], drawn.column("b").to_numpy()
        order, places = np.argsort(of, kind="stable"), drawn.column("places")
        for mine in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else ():
            times = np.bincount(np.frombuffer(b"".join(places[int(k)].as_py() for k in mine), np.uint16), minlength=size)
            hit = np.flatnonzero(times)
            out.append((int(of[mine[0]]), x[hit].tobytes(), y[hit].tobytes(), times[hit].astype(np.int32).tobytes()))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        columns = zip(*out, strict=True) if out else ((),) * 4
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["b", "x", "y", "times"])

    return run


def _rank_correlation(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Spearman's rho of a resample by counts of its values; ranks are doubled and from their mean, so they are whole numbers."""
    x, y, times = (np.frombuffer(b"".join(v.as_py() for v in table.column(c)), np.int32) for c in ("x", "y", "times"))
    n = int(times.sum())

    def ranks(values):
        count = np.bincount(values, weights=times)
        return (2 * np.cumsum(count) - count - n)[values]  # twice the rows below, and the ties, less n

    rx, ry = ranks(x), ranks(y)
    xx, yy, xy = (float(np.sum(times * a * b)) for a, b in ((rx, rx), (ry, ry), (rx, ry)))
    rho = xy / math.sqrt(xx) / math.sqrt(yy) if xx and yy else None
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([rho], pa.float64())], names=["b", "rho"])


def _numbered_values(rows: DataFrame, column: str) -> DataFrame:
    """The column as the place of its value among its different values."""
    values = number_rows(rows.select(column).distinct(), [column], "__place")
    return rows.join(values, column).withColumn(column, F.col("__place").cast("int")).drop("__place")


def bootstrap_rank_correlation(rows: DataFrame, x: str, y: str, order: str, *, n_boot: int = 200, alpha: float = 0.05, seed: int = SEED) -> DataFrame:
    """Percentile interval of Spearman's rho over resampled pairs; degenerate resamples drop out.

    A draw is never a row. Draws go to the block of rows they are from, as two bytes each; there they are counted by resample
    and given the places of their values, and a task counts a resample by value, which gives the ranks without a sort.
    """
    pairs = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = pairs.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(order).alias("o"))
    numbered = number_rows(pairs, ["o", "x", "y"]).drop("o")
    n = numbered.count()
    numbered = _numbered_values(_numbered_values(numbered, "x"), "y").withColumn("block", F.expr(f"i div {DRAWN_FROM}"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretches = rows.sparkSession.range(n_boot * -(-n // DRAWS)).select((F.col("id") % n_boot).cast("int").alias("b"), F.expr(f"id div {n_boot}").alias("at"), F.lit(n).alias("n"))
    drawn = _dealt(stretches).mapInArrow(_draw_blocks(seed, DRAWN_FROM), "block long, b int, places binary")
    sides = (side.repartition(parts, "block").groupBy("block") for side in (drawn, numbered.select("block", "i", "x", "y")))
    counted = functools.reduce(lambda a, b: a.cogroup(b), sides).applyInArrow(_drawn_ranks(DRAWN_FROM), "b int, x binary, y binary, times binary")
    rhos = counted.repartition(parts, "b").groupBy("b").applyInArrow(_rank_correlation, "b int, rho double").filter("rho IS NOT NULL")
    enough = F.count("*") >= max(2, n_boot // 10)
    return rhos.agg(F.when(enough, percentile("rho", alpha / 2)).alias("ci_lo"), F.when(enough, percentile("rho", 1 - alpha / 2)).alias("ci_hi"), F.count("*").alias("n_usable"))


def seeded_bootstrap(values: list[float], *, n_boot: int = 1000, alpha: float = 0.05, seed: int = SEED, statistic: Callable | None = None):
    """Mersenne Twister bootstrap of one sample, for parity with published intervals: (point, lo, hi)."""
    draw, stat = random.Random(seed), statistic or (lambda v: math.fsum(v) / len(v))
    n = len(values)
    stats = np.sort([stat([values[draw.randrange(n)] for _ in range(n)]) for _ in range(n_boot)])
    return stat(values), float(np.quantile(stats, alpha / 2)), float(np.quantile(stats, 1 - alpha / 2))


def grouped_bootstrap(rows: DataFrame, value: str, order: str, by, **how) -> DataFrame:
    """seeded_bootstrap of each group, as one grouped task a group; for golden parity on small groups."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[value].dropna().tolist()
        point, lo, hi = seeded_bootstrap(v, **how) if v else (None, None, None)
        return pd.DataFrame({b: [pdf[b].iloc[0]] for b in by} | {"n": [len(v)], "point": [point], "ci_lo": [lo], "ci_hi": [hi]})

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in by)
    return rows.groupBy(*by).applyInPandas(one, f"{types}, n long, point double, ci_lo double, ci_hi double")


def correlation_report(rows: DataFrame, metrics, score: str = "completeness", event: str = "event") -> DataFrame:
    """Spearman of every metric with the score, pooled and by event."""
    long = rows.select(event, F.col(score).alias("score"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m"))
    long = long.select(event, "score", "m.metric", "m.value")
    scoped = long.withColumn("scope", F.explode(F.array(F.lit("pooled"), F.col(event))))
    return spearman(scoped, "value", "score", ("scope", "metric"))


def disagreements(rows: DataFrame, metrics, score: str = "completeness", key: str = "sitrep_id", top_k: int = 5) -> DataFrame:
    """The largest percentile-rank gaps between a metric and the score, by metric and direction."""
    long = rows.select(key, F.col(score).cast("double").alias("score"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m"))
    long = long.select(key, "score", "m.metric", "m.value").filter("score IS NOT NULL AND value IS NOT NULL")
    ranked = percentile_rank(percentile_rank(long, "value", "m_pct", ("metric",)), "score", "c_pct", ("metric",))
    gap = ranked.withColumn("gap", F.col("m_pct") - F.col("c_pct")).filter("gap <> 0")
    gap = gap.withColumn("direction", F.when(F.col("gap") > 0, "high_metric_low_score").otherwise("low_metric_high_score"))
    order = Window.partitionBy("metric", "direction").orderBy(F.desc(F.abs("gap")), F.col(key).cast("string"))
    return gap.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
