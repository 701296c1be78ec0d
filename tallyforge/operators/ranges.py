"""Numbers of rows in a total order and exact selection, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch


def written(df: DataFrame, label: str) -> DataFrame:
    """The table written in the shared folder and read again, which cuts the lineage and fixes its rows."""
    path, schema = scratch(df.sparkSession, label), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def number_rows(df: DataFrame, order, name: str = "i") -> DataFrame:
    """The rows with their place from 0 in the order, which has to be total for reruns to agree.

    Rows are sorted by ranges; a range's first place is the total of the ranges before it, of which there is a
    row each.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = written(ranged, "ranged").withColumn("__range", F.shiftright("__at", 33))
    sizes = ranged.groupBy(F.col("__range").alias("__of")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    firsts = sizes.select("__of", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    placed = ranged.join(F.broadcast(firsts), F.col("__range") == F.col("__of"))
    return placed.withColumn(name, F.col("__first") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__range", "__of", "__first")


def _cut(rows: DataFrame, by: str, digits, value: str, need: str) -> DataFrame:
    """(of, cut, left, before): by group the bin of ``digits`` in which the needed row falls, how many of its rows
    are needed, and the sum over the bins before it."""
    bins = rows.groupBy(by, digits.alias("cut")).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.first(need).alias("need"))
    run = Window.partitionBy(by).orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
    bins = bins.withColumn("upto", F.coalesce(F.sum("n").over(run), F.lit(0))).withColumn("before", F.coalesce(F.sum("s").over(run), F.lit(0.0)))
    found = bins.filter("upto < need AND need <= upto + n")
    return written(found.select(F.col(by).alias("of"), "cut", (F.col("need") - F.col("upto")).alias("left"), "before").coalesce(1), "cut-bins")


def least_sums(rows: DataFrame, by: str, key: str, value: str, need: str, *, digits: int = 3) -> DataFrame:
    """(by, s): the sum of the values of the ``need`` rows with the smallest keys of each group; groups are few.

    Keys are hexadecimal digits of even spread, ties by any order are the caller's to avoid; all rows of a group share
    ``need``. Rows are counted and summed by their leading digits, which combines before the shuffle; the bin in which the last needed row falls is
    refined by the next digits, and only the rows of that finer bin, one in 16^(2 * digits), are ordered.
    """
    lead, then = F.substring(key, 1, digits), F.substring(key, 1 + digits, digits)
    first = _cut(rows, by, lead, value, need)
    inner = rows.select(by, key, value).join(F.broadcast(first), (F.col(by) == F.col("of")) & (lead == F.col("cut")))
    inner = written(inner.select(by, key, value, "left"), "cut-rows")
    second = _cut(inner, by, then, value, "left")
    last = inner.drop("left").join(F.broadcast(second), (F.col(by) == F.col("of")) & (then == F.col("cut")))
    last = last.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(key))).filter("rn <= left")
    parts = first.select(F.col("of").alias(by), "before").union(second.select("of", "before")).union(last.select(by, F.col(value).alias("before")))
    return parts.groupBy(by).agg(F.sum("before").alias("s"))
