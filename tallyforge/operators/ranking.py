"""Phases, packing, stratified samples and orderings."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .ranges import written

PHASES = ("early", "mid", "late")


def assign_phase(rows: DataFrame, day: str = "day", event: str = "event") -> DataFrame:
    """Third of the event's date range; undated rows are 'unknown'. Two aggregates by event, joined back."""
    spans = rows.groupBy(event).agg(F.min(day).alias("__lo"), F.max(day).alias("__hi"))
    third = F.least(F.lit(2), F.floor(F.datediff(day, "__lo") * 3 / (F.datediff("__hi", "__lo") + 1))).cast("int")
    phase = F.when(F.col(day).isNull(), "unknown").otherwise(F.element_at(F.array(*map(F.lit, PHASES)), third + 1))
    return rows.join(spans, event, "left").withColumn("phase", phase).drop("__lo", "__hi")


def numbered(rows: DataFrame, by, order, name: str = "k") -> DataFrame:
    """Place of a row among those of its group, from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def file_names(rows: DataFrame, by=("event", "date"), order="_seq") -> DataFrame:
    """<date>, <date>_2, ... for repeated dates of an event; no date is 'undated'."""
    date = F.coalesce(F.nullif("date", F.lit("")), F.lit("undated"))
    return numbered(rows, by, [order]).withColumn("stem", F.when(F.col("k") == 1, date).otherwise(F.concat_ws("_", date, "k"))).drop("k")


def spread_duplicates(rows: DataFrame, x: str, y: str, order: str, x_step: float = 0.08, y_step: float = 0.012) -> DataFrame:
    """Moves points that coincide into short rows of up to five, never below their value."""
    same = Window.partitionBy(x, y)
    n, at = F.count("*").over(same), F.row_number().over(same.orderBy(order)) - 1
    flat = rows.withColumn("__n", n).withColumn("__at", at)
    columns = F.least(F.lit(5), F.ceil(F.sqrt("__n"))).cast("int")
    row, column = F.floor(F.col("__at") / columns), F.col("__at") % columns
    size = F.least(columns, F.col("__n") - row * columns)
    return (
        flat.withColumn("spread_x", F.when(F.col("__n") > 1, F.col(x) + (column - (size - 1) / 2) * x_step).otherwise(F.col(x)))
        .withColumn("spread_y", F.when(F.col("__n") > 1, F.col(y) + row * y_step).otherwise(F.col(y)))
        .drop("__n", "__at")
    )


def quotas(counts: DataFrame, cap: int, label: str = "label", by=()) -> DataFrame:
    """Largest-remainder quota of each label; every label gets one when the cap allows. counts has by, label, n."""
    group = Window.partitionBy(*by)
    flat = counts.withColumn("__total", F.sum("n").over(group)).withColumn("__labels", F.count("*").over(group))
    base = F.when(F.lit(cap) >= F.col("__labels"), 1).otherwise(0)
    flat = flat.withColumn("__base", base).withColumn("__rest", F.col("n") - F.col("__base"))
    flat = flat.withColumn("__left", cap - F.col("__base") * F.col("__labels")).withColumn("__pool", F.sum("__rest").over(group))
    flat = flat.withColumn("__exact", F.coalesce(F.col("__rest") * F.col("__left") / F.nullif("__pool", F.lit(0)), F.lit(0.0)))
    flat = flat.withColumn("__take", F.least(F.floor("__exact"), F.col("__rest"))).withColumn("__q", F.col("__base") + F.col("__take"))
    flat = flat.withColumn("__more", F.col("__left") - F.sum("__take").over(group)).withColumn("__room", F.col("n") > F.col("__q"))
    order = Window.partitionBy(*by, "__room").orderBy(F.desc(F.col("__exact") - F.floor("__exact")), F.desc("n"), label)
    extra = F.when(F.col("__room") & (F.row_number().over(order) <= F.col("__more")), 1).otherwise(0)
    quota = F.when(F.col("__total") <= cap, F.col("n")).otherwise(F.col("__q") + extra)
    return flat.withColumn("quota", quota.cast("long")).select(*by, label, "n", "quota")


def hash_order(seed, *parts) -> Column:
    """A draw order that does not depend on partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)))


def stratified_sample(rows: DataFrame, cap: int, label: str, id_col: str, by=(), seed: int = 17) -> DataFrame:
    """A capped sample by label quota; the draw within a label is by hash of seed, group and id."""
    counts = rows.groupBy(*by, label).agg(F.count("*").alias("n"))
    share = quotas(counts, cap, label, by).drop("n")
    order = Window.partitionBy(*by, label).orderBy(hash_order(seed, *by, id_col), id_col)
    drawn = rows.withColumn("__rn", F.row_number().over(order)).join(share, [*by, label])
    return drawn.filter("__rn <= quota").drop("__rn", "quota")


def round_robin_sample(rows: DataFrame, n: int, strata, id_col: str, seed: int = 17, lead: str | None = None) -> DataFrame:
    """n rows taken one from each stratum in turn.

    With ``lead`` the strata are visited interleaved by that field, the largest first; without, in the
    order of their keys. The draw within a stratum is by hash. One row for each stratum is ordered on
    a single task, the rows themselves are ranked by stratum.
    """
    key = F.struct(*strata)
    counts = rows.groupBy(*strata).agg(F.count("*").alias("__size"))
    if lead is None:
        visit = counts.withColumn("__visit", F.row_number().over(Window.orderBy(*strata)))
    else:
        lead_size = F.sum("__size").over(Window.partitionBy(lead))
        depth = F.row_number().over(Window.partitionBy(lead).orderBy(F.desc("__size"), key))
        visit = counts.withColumn("__lead", lead_size).withColumn("__depth", depth)
        visit = visit.withColumn("__visit", F.row_number().over(Window.orderBy("__depth", F.desc("__lead"), lead)))
    order = Window.partitionBy(*strata).orderBy(hash_order(seed, *strata, id_col), id_col)
    ranked = rows.withColumn("__turn", F.row_number().over(order)).filter(F.col("__turn") <= n)
    placed = ranked.join(visit.select(*strata, "__visit"), list(strata))
    return placed.orderBy("__turn", "__visit").limit(n).drop("__turn", "__visit")


def sample_per_stratum(rows: DataFrame, sizes: dict[str, int], stratum: str, id_col: str, seed: int = 17, prefixes: dict[str, str] | None = None) -> DataFrame:
    """A fixed number from each stratum, with sample ids like A01 in draw order."""
    order = Window.partitionBy(stratum).orderBy(hash_order(seed, stratum, id_col), id_col)
    pairs = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    ranked = rows.filter(F.col(stratum).isin(*sizes)).withColumn("__rn", F.row_number().over(order))
    kept = ranked.filter(F.col("__rn") <= F.element_at(pairs(sizes), F.col(stratum)))
    prefix = F.element_at(pairs(prefixes or {s: s for s in sizes}), F.col(stratum))
    return kept.withColumn("sample_id", F.concat(prefix, F.lpad(F.col("__rn").cast("string"), 2, "0"))).drop("__rn")


def _schema(**kinds: str) -> tuple[str, pa.Schema]:
    """A schema in Spark's words and in Arrow's."""
    arrow = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return ", ".join(f"{name} {kind}" for name, kind in kinds.items()), pa.schema([(name, arrow[kind]) for name, kind in kinds.items()])


_SUMMARY = _schema(
    range="long", first="string", last="string", n_first="long", n_last="long", several="boolean", sums="array<long>", closed="array<long>", used="array<long>", total="long",
    end_used="long", end_chunk="long",
)
_STARTS = _schema(range="long", place="long", used="long", chunk="long")


def _breaks(costs: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of costs before each row, and for a chunk begun at a row the row that begins the next one (the number of rows: none)."""
    before = np.concatenate([[0], np.cumsum(costs)])
    over = np.searchsorted(before, before[:-1] + budget, "right") - 1  # the first row that would exceed the budget
    alone = (over < len(costs)) & (before[np.minimum(over, len(costs))] == before[:-1])  # a row that is too large by itself stays
    return before, np.minimum(over + alone, len(costs))


def _summary(budget: int):
    """What a range of rows does to the chunk that is open where it begins, as far as its first group goes; and how its last group ends.

    ``sums``, ``closed`` and ``used`` have an entry for each row at which the open chunk can first be closed.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__at")
        costs, keys = pc.fill_null(table.column("__cost"), 0).to_numpy(), table.column("__key").to_pylist()
        if len(costs) and costs.min() < 0:
            raise ValueError("a cost below zero")
        n = len(keys)
        first = bisect_left(range(n), True, key=lambda i: keys[i] != keys[0])
        last = bisect_left(range(n), True, key=lambda i: keys[i] == keys[-1])
        before, after = _breaks(costs[:first], budget)
        closed, used = np.zeros(first + 1, np.int64), np.zeros(first + 1, np.int64)
        for i in range(first - 1, -1, -1):
            j = after[i]
            closed[i], used[i] = (closed[j] + 1, used[j]) if j < first else (0, before[-1] - before[i])
        reach = min(int(after[0]), first) + 1
        end = _Open()
        for c in costs[last:].tolist() if last else []:
            end.add(c, budget)
        arrays = [[table.column("__range")[0].as_py()], [keys[0]], [keys[-1]], [first], [n - last], [bool(last)], [before[: reach + 1].tolist()], [closed[:reach].tolist()], [used[:reach].tolist()], [int(before[-1])], [end.used], [end.chunk]]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(arrays, _SUMMARY[1], strict=True)], schema=_SUMMARY[1])

    return run


class _Open:
    """The chunk that is open: its number and the budget it has used."""

    def __init__(self, used: int = 0, chunk: int = 0):
        self.used, self.chunk = used, chunk

    def add(self, cost: int, budget: int) -> int:
        if self.used > 0 and self.used + cost > budget:
            self.used, self.chunk = 0, self.chunk + 1
        self.used += cost
        return self.chunk


def _compose(budget: int):
    """What is open where each range begins, from the summaries in order: a row each."""

    def run(batches):
        key, place, used, chunk = None, 0, 0, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["first"] != key:
                    key, place, used, chunk = row["first"], 0, 0, 0
                out.append({"range": row["range"], "place": place, "used": used, "chunk": chunk})
                if row["several"]:
                    key, place, used, chunk = row["last"], row["n_last"], row["end_used"], row["end_chunk"]
                    continue
                sums, place = row["sums"], place + row["n_first"]
                at = max(0, bisect_right(sums, budget - used) - 1)  # the first row that would exceed the budget
                if at < row["n_first"] and at < len(sums) - 1 and used + sums[at] == 0:
                    at += 1  # a row too large by itself does not close an empty chunk
                if at < row["n_first"]:
                    used, chunk = row["used"][at], chunk + 1 + row["closed"][at]
                else:
                    used += row["total"]
            yield pa.RecordBatch.from_pylist(out, schema=_STARTS[1])

    return run


def chunk_posts(rows: DataFrame, by, order, cost: str, budget: int) -> DataFrame:
    """Greedy in-order chunks of each group, as (by, place, order, chunk): a chunk closes before it would exceed the budget.

    What a chunk holds depends on all before it, but a range of rows needs only the budget that is used where it begins: from
    sums, every row knows where a chunk begun at it ends, so a range is summed up by what follows each row at which the
    open chunk can first close. The summaries, a row for each range, are joined in order; then all ranges are numbered at once,
    and a group of any size is dealt over tasks. Costs are at least 0 (null: 0).
    """
    by, order = list(by), list(order)
    key = F.to_json(F.struct(*by)).alias("__key") if by else F.lit("").alias("__key")
    keyed = rows.select(*by, *order, F.col(cost).cast("long").alias("__cost"), key)
    ranged = keyed.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__at", F.monotonically_increasing_id())
    ranged = written(ranged, "ordered").withColumn("__range", F.shiftright("__at", 33))
    parts = ranged.select("__range", "__at", "__cost", "__key").groupBy("__range").applyInArrow(_summary(budget), _SUMMARY[0])
    starts = parts.repartition(1).sortWithinPartitions("range").mapInArrow(_compose(budget), _STARTS[0])
    starts = written(starts, "starts")
    n_by, n = len(by), len(by) + len(order)
    schema = keyed.select(*by).schema.add("place", "integer")
    for field in keyed.select(*order).schema.fields:
        schema = schema.add(field)
    schema = schema.add("chunk", "integer")
    out = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__at")
        place, opened, group = table.column("place")[0].as_py(), _Open(table.column("used")[0].as_py(), table.column("chunk")[0].as_py()), None
        places, chunks = [], []
        for this, size in zip(table.column("__key").to_pylist(), table.column("__cost").to_pylist(), strict=True):
            if group is not None and this != group:
                place, opened = 0, _Open()
            group = this
            places.append(place)
            chunks.append(opened.add(size or 0, budget))
            place += 1
        columns = [*(table.column(i) for i in range(n_by)), pa.array(places, pa.int32()), *(table.column(i) for i in range(n_by, n)), pa.array(chunks, pa.int32())]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    placed = ranged.join(F.broadcast(starts), F.col("__range") == F.col("range"))  # a row for each range
    return placed.select(*(ranged[c] for c in (*by, *order)), "__cost", "__key", "__at", "__range", "place", "used", "chunk").groupBy("__range").applyInArrow(run, schema)


def upper_median(column: str) -> Column:
    """The middle value of a column, the upper of two, from counts of its distinct values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")


def event_days(rows: DataFrame, day: str, min_posts: int) -> DataFrame:
    return rows.groupBy(day).agg(F.count("*").alias("n_posts")).filter(F.col("n_posts") >= min_posts)


def order_clusters(members: DataFrame, max_candidates: int = 25, min_codes: int = 1) -> DataFrame:
    """Clusters by documents, then members, then name; slot ids S01...; the first max_candidates large enough are kept.

    members has label, sitrep_id and name. Clusters, a row each, are ordered on one task.
    """
    names = members.groupBy("label", F.lower(F.trim("name")).alias("name")).agg(F.count("*").alias("n"))
    top = names.groupBy("label").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("canonical_name"))
    sizes = members.groupBy("label").agg(F.count_distinct("sitrep_id").alias("n_sitreps"), F.count("*").alias("n_codes"))
    order = Window.orderBy(F.desc("n_sitreps"), F.desc("n_codes"), "canonical_name", "label")
    ranked = sizes.join(top, "label").withColumn("rn", F.row_number().over(order))
    large = F.col("n_codes") >= min_codes
    kept = large & (F.sum(large.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) <= max_candidates)
    return ranked.withColumn("slot_id", F.concat(F.lit("S"), F.lpad(F.col("rn").cast("string"), 2, "0"))).withColumn("kept", kept).drop("rn")


def top_names(members: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent names of each label, ties alphabetical."""
    counts = members.groupBy("label", F.lower(F.trim("name")).alias("name")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("label").orderBy(F.desc("n"), "name")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def prevalence(members: DataFrame, n_documents: int) -> DataFrame:
    return members.groupBy("label").agg((F.count_distinct("sitrep_id") / F.lit(float(n_documents)) if n_documents else F.lit(0.0)).alias("prevalence"))


