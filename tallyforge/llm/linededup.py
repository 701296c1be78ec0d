"""Line dedup over levelled sorted runs.

A run is a sorted array of entries (line hash, document). A key needs at most ``min_docs`` entries, those of
its largest documents: they tell whether it is frequent and which document keeps it. Every map task sorts
the keys of a stretch of documents, thins them to that and cuts them by hash range, so a line that all
documents share sends a few entries a stretch. The task of a range takes these batches in turn: a batch
merge-anti-joins the runs, which drops the entries that can change nothing, and adds its rest as a run
of level 0. When a level holds ``fanout`` runs they are merged into one run of the next. The runs of all ranges
are written in the shared folder, from where a later batch of documents goes on.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .staging import col, drop_path, files_for, lean, scanned_bytes, stage

_STRIP = b" \t\n\x0b\x0c\r"
_KEY = np.dtype("S16")
_RUNS = "range int, level int, seq long, entries binary"
#: Levels of rows that are no run: a batch that is still to be added, and the frequent keys of a range.
_BATCH, _FREQUENT = -1, -2
#: Entries of a batch before thinning.
BATCH_LINES = 1 << 18
#: Bytes of files for which there is a hash range at least: some 2 million keys of 24 bytes.
RANGE_BYTES = 64 << 20
#: Frequent lines (24 bytes each) up to which they are broadcast; beyond, documents are shuffled to them.
BROADCAST_LINES = 1_000_000
#: The place of a null doc_id in the order of documents: before all others.
NULL_ID = -(1 << 63)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the stripped, A-Z lower-cased line; None when it has too few code points."""
    key = line.strip(_STRIP)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return blake2b(key.lower(), digest_size=16).digest()


class Run:
    """Sorted distinct entries, the ``min_docs`` largest documents of each key, and the keys that have as many."""

    def __init__(self, keys: np.ndarray, docs: np.ndarray, min_docs: int):
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
        keys, docs = keys[new], docs[new]
        last = np.append(np.flatnonzero(keys[1:] != keys[:-1]), len(keys) - 1) if len(keys) else np.empty(0, np.int64)
        sizes = np.diff(last, prepend=-1)
        kept = np.repeat(last, sizes) - np.arange(len(keys)) < min_docs
        self.keys, self.docs = keys[kept], docs[kept]
        enough = last[sizes >= min_docs]
        self.frequent, self.largest = keys[enough], docs[enough]

    def settles(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which of the sorted entries can change nothing: their key is frequent here, with a document as large."""
        at = np.minimum(np.searchsorted(self.frequent, keys), max(len(self.frequent) - 1, 0))
        return (self.frequent[at] == keys) & (self.largest[at] >= docs) if len(self.frequent) else np.zeros(len(keys), bool)


def merged(runs: list[Run], min_docs: int) -> Run:
    return Run(np.concatenate([r.keys for r in runs]), np.concatenate([r.docs for r in runs]), min_docs)


class Levels:
    """The levelled runs of one hash range."""

    def __init__(self, min_docs: int, fanout: int):
        self.min_docs, self.fanout, self.levels = min_docs, fanout, []

    def put(self, run: Run, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def add(self, run: Run) -> None:
        gone = np.zeros(len(run.keys), bool)
        for old in (r for level in self.levels for r in level):
            gone |= old.settles(run.keys, run.docs)
        if gone.all():
            return
        self.put(Run(run.keys[~gone], run.docs[~gone], self.min_docs), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self.put(merged(old, self.min_docs), level + 1)
            level += 1


def _pack(keys: np.ndarray, docs: np.ndarray) -> bytes:
    return keys.tobytes() + docs.astype("<i8").tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 24
    return np.frombuffer(raw, _KEY, n), np.frombuffer(raw, "<i8", n, 16 * n)


def _range_of(keys: np.ndarray, n_ranges: int) -> np.ndarray:
    """Ranges of equal width, in the order of the keys."""
    high = np.frombuffer(keys.tobytes(), ">u4").reshape(-1, 4)[:, 0].astype(np.uint64)
    return ((high * np.uint64(n_ranges)) >> np.uint64(32)).astype(np.int64)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["range", "level", "seq", "entries"])


def _line_keys(text: bytes, min_chars: int) -> set[bytes]:
    return {k for line in text.split(b"\n") if (k := line_key(line, min_chars)) is not None}


def _batches(n_ranges: int, min_chars: int, min_docs: int, batch_lines: int):
    """The sorted batches of (did, text) rows, a row for each range."""

    def run(batches):
        part, number, keys, docs = TaskContext.get().partitionId(), 0, [], []

        def flush():
            batch = Run(np.array(keys, _KEY), np.array(docs, np.int64), min_docs)
            cuts = np.searchsorted(_range_of(batch.keys, n_ranges), np.arange(n_ranges + 1))
            held = [(r, a, b) for r, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)) if a < b]
            return _rows([(r, _BATCH, part << 32 | number, _pack(batch.keys[a:b], batch.docs[a:b])) for r, a, b in held])

        for batch in batches:
            for did, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                found = _line_keys(text.as_py(), min_chars) if text.is_valid else ()
                keys.extend(found)
                docs.extend([did] * len(found))
                if len(keys) >= batch_lines:
                    yield flush()
                    number, keys, docs = number + 1, [], []
        if keys:
            yield flush()

    return run


def _levels(min_docs: int, fanout: int):
    """The runs of each range after its batches. Rows come sorted by range, runs before batches."""

    def close(at, levels):
        rows = [(at, level, seq, _pack(r.keys, r.docs)) for level, runs in enumerate(levels.levels) for seq, r in enumerate(runs)]
        every = [r for runs in levels.levels for r in runs]
        if every:
            whole = merged(every, min_docs)
            rows.append((at, _FREQUENT, 0, _pack(whole.frequent, whole.largest)))
        return _rows(rows)

    def run(batches):
        at, levels = None, Levels(min_docs, fanout)
        for batch in batches:
            for r, level, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if r != at:
                    if at is not None:
                        yield close(at, levels)
                    at, levels = r, Levels(min_docs, fanout)
                one = Run(*_unpack(raw.as_py()), min_docs)
                if level == _BATCH:
                    levels.add(one)
                else:
                    levels.put(one, level)
        if at is not None:
            yield close(at, levels)

    return run


def _frequent(batches):
    for batch in batches:
        for raw in batch.column(0):
            keys, docs = _unpack(raw.as_py())
            halves = np.frombuffer(keys.tobytes(), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(docs)], names=["h1", "h2", "max_doc"])


def ranges_for(docs: DataFrame) -> int:
    """Hash ranges that grow with the input, so that what a task holds of keys does not: one for RANGE_BYTES of files at most."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(scanned_bytes(docs) // RANGE_BYTES, 1 << 20))


class LineRuns:
    """The runs of a growing corpus, in the shared folder. ``n_ranges`` stays as it is: choose it for the size that the
    corpus will have (``ranges_for``)."""

    def __init__(self, spark: SparkSession, *, min_chars: int = 40, min_docs: int = 5, fanout: int = 4, n_ranges: int | None = None, batch_lines: int = BATCH_LINES):
        self.spark, self.min_chars, self.min_docs, self.fanout, self.batch_lines = spark, min_chars, min_docs, fanout, batch_lines
        self.n_ranges = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: DataFrame | None = None

    def add(self, docs: DataFrame) -> None:
        """Add documents (did, text) to the runs. A document may come in several calls."""
        rows = docs.select("did", "text").mapInArrow(lean(_batches(self.n_ranges, self.min_chars, self.min_docs, self.batch_lines)), _RUNS)
        old = self.runs
        if old is not None:
            rows = rows.union(old.filter(f"level <> {_FREQUENT}"))
        # Runs and batches of a range meet in one task, as whole sorted arrays.
        rows = rows.repartitionById(self.n_ranges, "range").sortWithinPartitions("range", F.desc("level"), "seq")
        few = max(4, self.spark.sparkContext.defaultParallelism)
        self.runs = stage(rows.mapInArrow(lean(_levels(self.min_docs, self.fanout)), _RUNS), "line-runs", files=min(self.n_ranges, few))
        if old is not None:
            drop_path(self.spark, old.inputFiles()[0].rsplit("/", 1)[0])

    def frequent(self) -> DataFrame:
        """(h1, h2, max_doc) of the keys found in at least ``min_docs`` documents."""
        return self.runs.filter(f"level = {_FREQUENT}").select("entries").mapInArrow(lean(_frequent), "h1 long, h2 long, max_doc long")


def _drop_known(text_at: int, id_at: int, min_chars: int, known):
    """Rewrites texts by the frequent lines of a broadcast (sorted keys, largest documents)."""

    def run(batches):
        frequent, largest = known.value

        def gone(text: bytes, did: int | None) -> tuple[bytes, int, int]:
            parts = text.split(b"\n")
            keyed = [(i, k) for i, line in enumerate(parts) if (k := line_key(line, min_chars)) is not None]
            if not keyed or not len(frequent):
                return text, len(parts), 0
            keys = np.array([k for _, k in keyed], _KEY)
            at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
            drop = (frequent[at] == keys) & (largest[at] != (NULL_ID if did is None else did))
            lost = {keyed[j][0] for j in np.flatnonzero(drop).tolist()}
            return b"\n".join(x for i, x in enumerate(parts) if i not in lost), len(parts), len(lost)

        return _rewritten(batches, text_at, lambda batch: [gone(t or b"", d) for t, d in zip(batch.column(text_at).cast(pa.binary()).to_pylist(), batch.column(id_at).cast(pa.int64()).to_pylist(), strict=True)])

    return run


def _drop_listed(text_at: int, min_chars: int):
    """Rewrites texts by the list of dropped keys in the last column."""

    def gone(text: bytes, drops) -> tuple[bytes, int, int]:
        lost, parts = set(drops or ()), text.split(b"\n")
        stay = [x for x in parts if line_key(x, min_chars) not in lost] if lost else parts
        return b"\n".join(stay), len(parts), len(parts) - len(stay)

    def run(batches):
        return _rewritten(batches, text_at, lambda batch: [gone(t or b"", d) for t, d in zip(batch.column(text_at).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)], extra=1)

    return run


def _rewritten(batches, text_at: int, judge, extra: int = 0):
    for batch in batches:
        done = judge(batch)
        columns = [batch.column(i) for i in range(batch.num_columns - extra)]
        columns[text_at] = pa.array([d[0] for d in done], pa.binary()).cast(pa.string())
        columns += [pa.array([d[i] for d in done], pa.int64()) for i in (1, 2)]
        yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])


def _key_rows(min_chars: int):
    def run(batches):
        for batch in batches:
            for did, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = list(_line_keys(text or b"", min_chars))
                halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), did, np.int64)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(found, pa.binary())],
                    names=["did", "k1", "k2", "line"],
                )

    return run


def dedup_lines(
    docs: DataFrame,
    *,
    min_chars: int = 40,
    min_docs: int = 5,
    fanout: int = 4,
    batch_lines: int = BATCH_LINES,
    n_ranges: int | None = None,
    broadcast_lines: int = BROADCAST_LINES,
    id_col: str = "doc_id",
    text_col: str = "text",
    counts: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """The documents with their frequent lines gone, and the columns n_lines and n_dropped (``counts``).

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents loses all its
    lines except those of the largest doc_id that holds it. The text of a document that loses
    nothing is unchanged, except that null becomes empty (one empty line).

    Rows that share a doc_id are one document where documents are counted. A null doc_id is one
    document, smaller than all others. An empty table gives no rows. Columns that are named
    like ``counts`` give way to the results; all others pass through.

    Up to ``broadcast_lines`` counted frequent lines go to every task; beyond, documents are shuffled to the
    lists of the lines that they lose.
    """
    spark = docs.sparkSession
    ship_package(spark)
    names = [c for c in docs.columns if c not in counts]
    did = F.coalesce(col(id_col).cast("long"), F.lit(NULL_ID))
    slim = docs.select(did.alias("did"), col(text_col).cast("string").alias("text"))
    runs = LineRuns(spark, min_chars=min_chars, min_docs=min_docs, fanout=fanout, batch_lines=batch_lines, n_ranges=n_ranges or ranges_for(slim))
    runs.add(slim)
    frequent = runs.frequent()
    found = frequent.count()
    schema = docs.select(*map(col, names)).schema
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)]
    at, n = names.index(text_col), len(names)
    fields[at] = T.StructField(f"c{at}", T.StringType())
    out = T.StructType([*fields, T.StructField(f"c{n}", T.LongType()), T.StructField(f"c{n + 1}", T.LongType())])
    if found <= broadcast_lines:
        held = frequent.toArrow()
        keys = np.stack([held.column("h1").to_numpy(), held.column("h2").to_numpy()], axis=1).astype("<i8").tobytes()
        keys, largest = np.frombuffer(keys, _KEY), held.column("max_doc").to_numpy()
        order = np.argsort(keys)
        known = spark.sparkContext.broadcast((keys[order], largest[order]))
        flat = docs.select(*(col(c).alias(f"c{i}") for i, c in enumerate(names)), col(id_col).cast("long").alias(f"c{n}"))
        out.add(f"c{n + 2}", T.LongType())  # the id that was added is rewritten like any column
        return flat.mapInArrow(lean(_drop_known(at, n, min_chars, known)), out).drop(f"c{n}").toDF(*names, *counts)
    rows = slim.mapInArrow(lean(_key_rows(min_chars)), "did long, k1 long, k2 long, line binary")
    drops = rows.join(frequent, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))).filter("did <> max_doc")
    drops = drops.groupBy(F.col("did").alias("__did")).agg(F.collect_set("line").alias("__drops"))  # at most the lines of a document
    drops = stage(drops, "line-drops", files=files_for(found, 100_000))
    wide = docs.select(did.alias("__key"), F.struct(*map(col, names)).alias("__row"))
    joined = wide.join(drops, F.col("__key") == F.col("__did"), "left")
    flat = joined.select(*(F.col("__row")[c].alias(f"c{i}") for i, c in enumerate(names)), "__drops")
    return flat.mapInArrow(lean(_drop_listed(at, min_chars)), out).toDF(*names, *counts)
