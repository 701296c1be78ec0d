"""Best-two-fit packing of documents into sequences, planned on the histogram of lengths.

A sequence is filled greedily, longest first; then its smallest document gives way to two unpacked ones
that fit the widened gap more tightly. Short documents wait until the others are packed, so that replacements
do not use up what fills small gaps best, and then go into the tightest gap.

Only lengths matter to a packing, and there are at most ``capacity`` of them. The driver therefore packs
the histogram (one count a length) into patterns with repeats, and every piece finds its sequence
from its rank among the pieces of its length. Ranks come from counts by partition, so no task gathers
the pieces of a common length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .staging import col, lean, merge_tiny, stage
from .tokens import encoder

CAPACITY = 1024
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


#: Documents shorter than this share of a sequence wait, and two that replace one leave at most this share of the gap;
#: of the packings with the fewest sequences that with the most replacements counts.
WAITING, TIGHTNESS = (0.0, 1 / 10, 1 / 8, 1 / 6, 1 / 5, 1 / 4), (1.0, 0.0)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int, bool]]:
    """Patterns [(length, uses), ...] with the number of sequences that follow each, and whether it holds a replacement.

    A pattern is repeated while the counts last, which is what packing sequence by sequence would do.
    """
    for length in counts:
        if not 1 <= length <= capacity:
            raise ValueError(f"a length of {length}")
    plans = (_pack_histogram(counts, capacity, max(1, round(share * capacity)), tight) for share in WAITING for tight in TIGHTNESS)
    return min(plans, key=lambda plan: (sum(times for _, times, _ in plan), -sum(times for _, times, replaced in plan if replaced)))


def _pack_histogram(counts: dict[int, int], capacity: int, least: int, tight: float) -> list[tuple[list[tuple[int, int]], int, bool]]:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    waiting = left[:least].copy()
    left[:least] = 0
    plan = []
    while True:
        lengths = np.flatnonzero(left)
        if not len(lengths):
            break
        gap, use = capacity, {}
        for length in lengths[::-1].tolist():
            if n := min(int(left[length]), gap // length):
                use[length] = n
                gap -= n * length
            if gap < lengths[0]:
                break
        pair = None
        if gap and sum(use.values()) > 1:
            short = min(use)
            pair = _closest_pair(left, use, gap + short)
            if pair and sum(pair) > short and gap + short - sum(pair) <= tight * gap:
                use[short] -= 1
                for length in pair:
                    use[length] = use.get(length, 0) + 1
                use = {k: v for k, v in use.items() if v}
            else:
                pair = None
        times = min(int(left[k]) // v for k, v in use.items())
        for k, v in use.items():
            left[k] -= v * times
        plan.append((use, times, pair is not None))
    return [(sorted(use.items(), reverse=True), times, replaced) for use, times, replaced in _fill_gaps(plan, waiting, capacity)]


def _closest_pair(left, use, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum of at most room, by two pointers; the most even of such pairs."""
    free = left[: room + 1].copy()
    for k, v in use.items():
        if k <= room:
            free[k] -= v
    lengths = np.flatnonzero(free > 0).tolist()
    i, j, best = 0, len(lengths) - 1, None
    while i <= j:
        total = lengths[i] + lengths[j]
        if total > room or (i == j and free[lengths[i]] < 2):
            j -= 1
            continue
        if best is None or total >= sum(best):
            best = (lengths[i], lengths[j])
        i += 1
    return best


def _fill_gaps(plan, waiting: np.ndarray, capacity: int):
    """The plan with the documents that waited, longest first, each in the tightest gap that holds it."""
    by_gap: list[list] = [[] for _ in range(capacity + 1)]
    for use, times, replaced in plan:
        by_gap[capacity - sum(k * v for k, v in use.items())].append((use, times, replaced))
    for length in range(len(waiting) - 1, 0, -1):
        n, gap = int(waiting[length]), length
        while n:
            while gap < capacity and not by_gap[gap]:
                gap += 1
            if gap == capacity:  # new sequences, of as many as fit
                fit = min(n, capacity // length)
                times = n // fit
                by_gap[capacity - fit * length].append(({length: fit}, times, False))
                n, gap = n - fit * times, length
                continue
            use, times, replaced = by_gap[gap].pop()
            some = min(n, times)
            if some < times:
                by_gap[gap].append((use, times - some, replaced))
            by_gap[gap - length].append((use | {length: use.get(length, 0) + 1}, some, replaced))
            n, gap = n - some, length if gap >= 2 * length else gap
    return [one for held in by_gap for one in held]


def _cut(path: str, end_id: int, capacity: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        coder, part, seen = encoder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for did, ids in zip(batch.column(0).to_pylist(), coder.encode_batch(batch.column(1)), strict=True):
                n, at = len(ids) + 1, 0
                piece, length = 0, (n - 1) % capacity + 1
                while at < n:
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    crc = zlib.crc32(ids[at : at + length])
                    crc = zlib.crc32(end, crc) if at + length == n else crc
                    rows.append((did, piece, at, length, crc, part, nth))
                    at, piece, length = at + length, piece + 1, capacity
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return run


def _place(keys: np.ndarray, table: np.ndarray):
    """keys: length and first rank of every use of a length in the plan, as one sorted integer."""

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            lo, uses, first, offset, replaced = (table[at, i] for i in range(5))
            k = rank - lo
            columns = [batch.column(i) for i in range(5)]
            columns += [pa.array(first + k // uses), pa.array(offset + k % uses * length), pa.array(replaced.astype(bool))]
            columns[3] = pa.array(length)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "replaced"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = CAPACITY,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    A document is its ids and the end id; longer ones than ``capacity`` are cut into full pieces,
    of which the first may be shorter. Null and empty texts are the end id alone. Rows that repeat an
    id are packed each on its own, null ids stay null, other columns are not read, and an empty table
    gives no rows. ``replaced`` says whether the piece's sequence holds two documents that replaced one.
    """
    ship_package(docs.sparkSession)
    slim = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    pieces = stage(merge_tiny(slim).mapInArrow(lean(_cut(tokenizer, end_id, capacity)), _PIECES), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    rows, first, used = [], 0, {}
    for pattern, times, replaced in best_two_fit(histogram, capacity):
        offset = 0
        for length, uses in pattern:
            lo = used.get(length, 0)
            rows.append((length << 48 | lo, lo, uses, first, offset, replaced))
            used[length] = lo + uses * times
            offset += length * uses
        first += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(ranks, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )
    return ranked.mapInArrow(
        _place(table[:, 0].copy(), table[:, 1:].copy()),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, replaced boolean",
    )
