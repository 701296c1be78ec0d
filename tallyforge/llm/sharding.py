"""Balanced contiguous shards from a global byte prefix sum.

Rows are put in id order by one range shuffle of (id, size, checksum); the text itself never moves.
Each partition sums its own bytes, the totals of the partitions (one row each) give every partition
its global offset, and equal targets cut the byte line into shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .staging import col, stage

_RUNNING = "doc_id long, size long, text_crc32 long, part int, local_bytes long, local_rows long"


def _running(batches):
    """Adds to each row the bytes and the rows before it in its partition."""
    part, bytes_before, rows_before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        size = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(size)
        ends = np.cumsum(size) + bytes_before
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(size),
                batch.column("text_crc32"),
                pa.array(np.full(n, part, np.int32)),
                pa.array(ends - size),
                pa.array(np.arange(rows_before, rows_before + n, dtype=np.int64)),
            ],
            names=["doc_id", "size", "text_crc32", "part", "local_bytes", "local_rows"],
        )
        rows_before += n
        bytes_before = int(ends[-1]) if n else bytes_before


def shard_by_bytes(
    docs: DataFrame, n_shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8
) -> DataFrame:
    """Assign every row to one of ``n_shards`` contiguous shards of near-equal bytes.

    A row weighs the UTF-8 bytes of its text plus ``overhead``; it goes to the shard in which its
    middle byte falls, so a shard is off its target by at most half a row at either end.

    Null ids come first, null texts weigh ``overhead`` and have checksum 0, rows that repeat an id
    keep their input order, an empty table gives no rows, and other columns are not read.
    Returns doc_id, size, text_crc32, shard, slot (place in the shard, from 0), start (global byte).
    """
    ship_package(docs.sparkSession)
    text = F.coalesce(col(text_col), F.lit(""))
    keyed = docs.select(
        col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    ordered = stage(
        keyed.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("tie"))
        .select("doc_id", "size", "text_crc32")
        .mapInArrow(_running, _RUNNING),
        "byte-line",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = (  # a row for each partition
        ordered.groupBy("part")
        .agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
        .select(
            "part",
            F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("part_bytes").over(everything).alias("all_bytes"),
        )
    )
    placed = ordered.join(F.broadcast(totals), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("bytes_before") + F.col("local_bytes")).alias("start"),
        (F.col("rows_before") + F.col("local_rows")).alias("place"),
        F.expr(f"((bytes_before + local_bytes) * 2 + size) * {n_shards} div (all_bytes * 2)").cast("int").alias("shard"),
    )
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first_place"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first_place")).alias("slot"), "start"
    )
