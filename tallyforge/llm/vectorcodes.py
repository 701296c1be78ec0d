"""Product codes of vectors by Lloyd's rounds with heap-ordered bounds.

A vector is cut into equal parts, and the parts at one position share a codebook. A block of vectors is one row of a
staged table, which also holds, for every position and entry, a heap of the parts that the entry has. A part's key is its
slack, the distance to the second nearest entry minus that to its own, plus the drift that its entry had when the
key was made. An entry's drift grows each round by its own move and the largest move of the others, so by the
triangle inequality only parts whose key does not exceed the drift now can have changed: these are popped and compared
with every entry exactly, all others are not looked at. A heap is kept as an array in ascending order, so what a round
pops is a prefix of it and what it pushes is a merge. Sums of parts by entry change by the parts that moved.

Components are integers and distances, sums and means exact; bounds are floats with a margin beyond their rounding.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .staging import col, drop_path, fresh_path, frugal, if_small, lean, stage

#: Vectors of a block: one row holds a block with its heaps, about 3 MB at 64 components.
BLOCK = 8192
#: Labels up to which their totals are broadcast; beyond, the rows are shuffled to them.
BROADCAST_LABELS = 1_000_000
_EXACT = float(1 << 53)
_HELD = 1 << 62


@dataclass(frozen=True)
class Codebooks:
    """The entries by position as integers, the drift of every entry since the start, and how many parts the rounds scanned."""

    entries: list[list[list[int]]]
    drift: list[list[float]]
    scanned: int = 0

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position within the part, in decimal with commas between."""
        return hashlib.sha256(",".join(str(c) for book in self.entries for entry in book for c in entry).encode()).hexdigest()

    def moved(self, sums: dict[tuple[int, int], list[int]], counts: dict[tuple[int, int], int], scanned: int) -> Codebooks:
        """The books after an update: floored means, with unused entries left where they are."""
        entries, drift = [], []
        for p, book in enumerate(self.entries):
            new = [[s // counts[p, e] for s in sums[p, e]] if counts.get((p, e)) else entry for e, entry in enumerate(book)]
            way = [math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) * (1 + 1e-12) for x, y in zip(book, new, strict=True)]
            other = [max((w for o, w in enumerate(way) if o != e), default=0.0) for e in range(len(way))]
            drift.append([d + w + o for d, w, o in zip(self.drift[p], way, other, strict=True)])
            entries.append(new)
        return Codebooks(entries, drift, self.scanned + scanned)


def _floored(scale: float):
    """vec_id, label, dim, v: floor(scale * x) as little-endian 64-bit integers; rows that take no part are left out."""

    def run(batches):
        for batch in batches:
            keep, dims, blobs = [], [], []
            for row, v in enumerate(batch.column(2)):
                if not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    keep.append(row)
                    dims.append(len(x))
                    with np.errstate(over="ignore"):
                        blobs.append(np.clip(np.floor(x * scale), -float(_HELD), float(_HELD)).astype("<i8").tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], names=["vec_id", "label", "dim", "v"]
            )

    return run


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries: by floats where they hold all integers in question, else Python's."""
    if not x.size or not book.size:
        return np.zeros((len(x), len(book)))
    most = max(float(np.abs(x).max()), float(np.abs(book).max()))
    if 4 * most * most * x.shape[1] < _EXACT:
        x, book = x.astype(np.float64), book.astype(np.float64)
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None, :]
    gap = x.astype(object)[:, None, :] - book.astype(object)[None, :, :]
    return (gap * gap).sum(axis=2)


def _scan(x: np.ndarray, book: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every part its nearest entry (ties to the lower index) and its key."""
    d = _distances(x, book)
    near = np.argmin(d, axis=1)
    rows = np.arange(len(x))
    upper = np.sqrt(d[rows, near].astype(np.float64))
    if len(book) == 1:
        return near, np.full(len(x), np.inf)
    d[rows, near] = np.inf
    lower = np.sqrt(d.min(axis=1).astype(np.float64))
    return near, lower - upper - 1e-9 * (lower + upper) - 1e-6 + drift[near]


class _Block:
    """The state of a block: parts by position, the entry of each, and the heaps of every position, entry by entry."""

    def __init__(self, parts: np.ndarray, assigned: np.ndarray, members: np.ndarray, keys: np.ndarray, ends: np.ndarray, sums: list, counts: np.ndarray):
        self.parts, self.assigned, self.members, self.keys, self.ends, self.sums, self.counts = parts, assigned, members, keys, ends, sums, counts

    @staticmethod
    def first(vectors: np.ndarray, n_parts: int, books: Codebooks) -> _Block:
        """A block with every part to be scanned: it lies in its heap of entry 0 below any drift."""
        n, width = vectors.shape[0], -(-vectors.shape[1] // n_parts)
        wide = np.zeros((n, n_parts * width), np.int64)
        wide[:, : vectors.shape[1]] = vectors
        parts = np.ascontiguousarray(wide.reshape(n, n_parts, width).transpose(1, 0, 2))
        k = len(books.entries[0])
        ends = np.zeros((n_parts, k), np.int32)
        ends[:] = n
        members = np.tile(np.arange(n, dtype=np.int32), (n_parts, 1))
        return _Block(parts, np.full((n_parts, n), 255, np.uint8), members, np.full((n_parts, n), -np.inf), ends, [[[0] * width for _ in range(k)] for _ in range(n_parts)], np.zeros((n_parts, k), np.int64))

    def step(self, books: Codebooks) -> int:
        """Pop and rescan what the drift has reached; the number of parts scanned."""
        scanned = 0
        for p, (entries, drift) in enumerate(zip(books.entries, books.drift, strict=True)):
            book, drift, x = np.array(entries, dtype=np.int64).reshape(len(entries), -1), np.array(drift), self.parts[p]
            starts = np.concatenate([[0], self.ends[p][:-1]])
            heaps = [(self.keys[p][a:b], self.members[p][a:b]) for a, b in zip(starts, self.ends[p], strict=True)]
            cuts = [int(np.searchsorted(keys, drift[e], "right")) for e, (keys, _) in enumerate(heaps)]
            popped = np.concatenate([members[:cut] for cut, (_, members) in zip(cuts, heaps, strict=True)])
            if not len(popped):
                continue
            scanned += len(popped)
            near, keys = _scan(x[popped], book, drift)
            before = self.assigned[p][popped]
            moved = before != near
            self._shift(p, x[popped[moved]], before[moved], near[moved])
            self.assigned[p][popped] = near
            by_entry = np.lexsort((keys, near))
            popped, near, keys = popped[by_entry], near[by_entry], keys[by_entry]
            bounds = np.searchsorted(near, np.arange(len(entries) + 1))
            new_keys, new_members = [], []
            for e, (cut, (old_keys, old_members)) in enumerate(zip(cuts, heaps, strict=True)):
                a, b = bounds[e], bounds[e + 1]
                at = np.searchsorted(old_keys[cut:], keys[a:b])
                new_keys.append(np.insert(old_keys[cut:], at, keys[a:b]))
                new_members.append(np.insert(old_members[cut:], at, popped[a:b]))
            self.ends[p] = np.cumsum([len(k) for k in new_keys])
            self.keys[p], self.members[p] = np.concatenate(new_keys), np.concatenate(new_members)
        return scanned

    def _shift(self, p: int, x: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        """Take moved parts from the sums of one entry to those of another."""
        for side, sign in ((before, -1), (after, 1)):
            for e in np.unique(side).tolist():
                if e == 255:  # not assigned before
                    continue
                rows = x[side == e]
                exact = rows if not rows.size or len(rows) * float(np.abs(rows).max()) < float(_HELD) else rows.astype(object)
                self.sums[p][e] = [s + sign * int(t) for s, t in zip(self.sums[p][e], exact.sum(axis=0).tolist(), strict=True)]
                self.counts[p, e] += sign * len(rows)

    def errors(self, books: Codebooks) -> list[int]:
        """The squared distances to the assigned entries, summed over the parts of each vector."""
        total = [0] * self.parts.shape[1]
        for p, entries in enumerate(books.entries):
            book = np.array(entries, dtype=np.int64).reshape(len(entries), -1)
            most = max(float(np.abs(self.parts[p]).max(initial=0)), float(np.abs(book).max(initial=0)))
            fits = 4 * most * most * max(book.shape[1], 1) < float(_HELD)
            gap = self.parts[p] - book[self.assigned[p]] if fits else self.parts[p].astype(object) - book.astype(object)[self.assigned[p]]
            total = [t + int(d) for t, d in zip(total, (gap * gap).sum(axis=1).tolist(), strict=True)]
        return [min(t, 2**63 - 1) for t in total]

    # Rows of the staged table. Sums travel as hi * 2^32 + lo, so that blocks add up within decimals.

    def row(self, scanned: int) -> list:
        narrow = next(t for t in ("<i2", "<i4", "<i8") if not self.parts.size or np.abs(self.parts).max() < 2 ** (8 * int(t[2]) - 1))
        flat = [s for book in self.sums for entry in book for s in entry]
        blobs = [self.parts.astype(narrow), self.assigned, self.members, self.keys, self.ends]
        return [int(narrow[2]), *(b.tobytes() for b in blobs), [s >> 32 for s in flat], [s & 0xFFFFFFFF for s in flat], self.counts.ravel().tolist(), scanned]

    @staticmethod
    def read(row: dict, n_parts: int, k: int) -> _Block:
        n = len(row["assigned"]) // n_parts
        parts = np.frombuffer(row["parts"], f"<i{row['width']}").astype(np.int64).reshape(n_parts, n, -1)
        shaped = lambda name, kind, m: np.frombuffer(row[name], kind).reshape(n_parts, m).copy()
        flat = [(h << 32) + low for h, low in zip(row["hi"], row["lo"], strict=True)]
        w = parts.shape[2]
        sums = [[flat[(p * k + e) * w : (p * k + e + 1) * w] for e in range(k)] for p in range(n_parts)]
        return _Block(parts, shaped("assigned", np.uint8, n), shaped("members", np.int32, n), shaped("keys", np.float64, n), shaped("ends", np.int32, k), sums, np.array(row["counts"], np.int64).reshape(n_parts, k))


_STATE = [
    ("width", T.IntegerType(), pa.int32()),
    *((name, T.BinaryType(), pa.binary()) for name in ("parts", "assigned", "members", "keys", "ends")),
    *((name, T.ArrayType(T.LongType()), pa.list_(pa.int64())) for name in ("hi", "lo", "counts")),
    ("scanned", T.LongType(), pa.int64()),
]


def _states(blocks, kept: list[pa.Array]) -> pa.RecordBatch:
    """A row for the block with the ids and labels of its vectors."""
    arrays = [pa.array([value], kind) for value, (_, _, kind) in zip(blocks, _STATE, strict=True)]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(k)], pa.int32()), k) for k in kept]
    return pa.RecordBatch.from_arrays([*lists, *arrays], names=["ids", "labels", *(name for name, _, _ in _STATE)])


def _begin(n_parts: int, books: Codebooks, block: int):
    """Rows are gathered into blocks as they come, and every block has its first assignment."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        n, dim = table.num_rows, table.column("dim")[0].as_py()
        vectors = np.frombuffer(b"".join(table.column("v").to_pylist()), "<i8").reshape(n, dim).astype(np.int64)
        state = _Block.first(vectors, n_parts, books)
        whole = lambda c: c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)
        return _states(state.row(state.step(books)), [whole(table.column("vec_id")), whole(table.column("label"))])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block - rows)
                held.append(part)
                rows += part.num_rows
                batch = batch.slice(part.num_rows)
                if rows == block:
                    yield flush(held)
                    held, rows = [], 0
        if rows:
            yield flush(held)

    return run


def _again(n_parts: int, k: int, books: Codebooks):
    def run(batches):
        for batch in batches:
            kept = [batch.column(i) for i in range(2)]
            for at, row in enumerate(batch.select(range(2, batch.num_columns)).to_pylist()):
                state = _Block.read(row, n_parts, k)
                yield _states(state.row(state.step(books)), [c.slice(at, 1).flatten() for c in kept])

    return run


def _finish(n_parts: int, k: int, books: Codebooks):
    def run(batches):
        for batch in batches:
            kept = [batch.column(i) for i in range(2)]
            for at, row in enumerate(batch.select(range(2, batch.num_columns)).to_pylist()):
                state = _Block.read(row, n_parts, k)
                state.step(books)
                codes = [bytes(c).hex() for c in np.ascontiguousarray(state.assigned.T)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(at, 1).flatten() for c in kept), pa.array(codes, pa.string()), pa.array(state.errors(books), pa.int64())], names=["vec_id", "label", "code", "error"]
                )

    return run


def _updated(state: DataFrame, books: Codebooks) -> Codebooks:
    """The next books; what comes to the driver is a number for each component of a codebook."""
    p, k = len(books.entries), len(books.entries[0])
    w = len(books.entries[0][0])
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    parts = state.select(F.posexplode(F.arrays_zip("hi", "lo")).alias("at", "s")).groupBy("at").agg(total("s.hi").alias("hi"), total("s.lo").alias("lo"))
    sums = {r["at"]: (int(r["hi"]) << 32) + int(r["lo"]) for r in parts.collect()}
    counted = state.select(F.posexplode(F.concat("counts", F.array("scanned"))).alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = {r["at"]: r["n"] for r in counted}
    return books.moved(
        {(i, e): [sums.get((i * k + e) * w + c, 0) for c in range(w)] for i in range(p) for e in range(k)}, {(i, e): counts[i * k + e] for i in range(p) for e in range(k)}, counts[p * k]
    )


def product_codes(
    vectors: DataFrame,
    *,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: float = 4096.0,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str | None = "label",
    block: int = BLOCK,
) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of every vector that takes part, and the codebooks.

    Components become floor(scale * x), held within 62 bits. Rows whose vector is null or holds null or non-finite
    components are left out; a null id or label stays null. Codebooks start as the parts of the ``entries`` smallest ids (nulls
    last, rows of one id by their bytes; fewer rows give fewer entries) and are updated ``rounds`` times. All vectors have
    the length of the smallest id's; those of another length come out with a null code and error. A length that parts do not
    divide is filled up with zeros. An error beyond 64 bits is held at their largest number. Repeated rows count as often as they come. An empty table gives no rows and no
    codebooks. Entries are at most 255.
    """
    if not 1 <= entries <= 255 or parts < 1:
        raise ValueError("entries has to be 1 to 255 and parts at least 1")
    spark = vectors.sparkSession
    ship_package(spark)
    label = col(label_col) if label_col else F.lit(None).cast("int")
    slim = vectors.select(col(id_col).cast("long").alias("vec_id"), label.alias("label"), col(vec_col).alias("v"))
    kind = slim.schema["label"].dataType
    coded = T.StructType().add("vec_id", "long").add("label", kind).add("dim", T.IntegerType()).add("v", "binary")
    rows = stage(slim.mapInArrow(lean(_floored(scale)), coded), "vectors")
    order = [F.col("vec_id").asc_nulls_last(), "dim", "v"]
    least = rows.orderBy(*order).limit(1).collect()
    out = T.StructType().add("vec_id", "long").add("label", kind).add("code", "string").add("error", "long")
    if not least:
        return spark.createDataFrame([], out), None
    dim = least[0]["dim"]
    width = -(-dim // parts)
    start = np.zeros((entries, parts * width), np.int64)
    first = rows.filter(F.col("dim") == dim).orderBy(*order).limit(entries).collect()
    for e, row in enumerate(first):
        start[e, :dim] = np.frombuffer(row["v"], "<i8")
    start = start[: len(first)].reshape(len(first), parts, width)
    books = Codebooks([[start[e, p].tolist() for e in range(len(first))] for p in range(parts)], [[0.0] * len(first) for _ in range(parts)])
    state_type = T.StructType().add("ids", T.ArrayType(T.LongType())).add("labels", T.ArrayType(kind))
    for name, spark_type, _ in _STATE:
        state_type = state_type.add(name, spark_type)

    path = None
    state = rows.filter(F.col("dim") == dim).mapInArrow(lean(_begin(parts, books, block)), state_type)
    for number in range(rounds):
        if number:
            state = state.mapInArrow(lean(_again(parts, len(first), books)), state_type)
        before, path = path, fresh_path(spark, "heaps")
        with frugal(spark):
            state.write.parquet(path)
        state = spark.read.schema(state_type).parquet(path)
        if before is not None:
            drop_path(spark, before)
        books = _updated(state, books)
    if not rounds:
        state = stage(state, "heaps")
    found = state.mapInArrow(lean(_finish(parts, len(first), books)), out)
    others = rows.filter(F.col("dim") != dim).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return found.union(others), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """The staged codes with label_error, the error summed over equal labels (nulls together)."""
    codes = stage(codes, "codes")
    totals = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(if_small(stage(totals, "label-errors", files=4), BROADCAST_LABELS), F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
