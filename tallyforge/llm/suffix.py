"""Removal of repeated 200-byte strings by a distributed difference cover over suffixes.

The classic difference-cover construction sorts tuples at sampled suffixes, names them, recurses on
the names and merges the remaining suffixes. Here the order of suffixes is wanted only to depth 200,
to find those that share a prefix of 200 bytes with a neighbour, and most suffixes share none. So:

1.  Sample. The cover has period 133 (12 residues, every difference mod 133 once) instead of 3. For any
    two equal 200-byte strings some shift below 133 lands both on samples, 68 equal bytes remain.
2.  Sort and name. The 68-byte tuples of all samples are dealt by fingerprint range, sorted and
    named; a name held once is discarded with all suffixes that lean on it. This level only rules out.
3.  Recurse. The samples left are sorted and named at 332 bytes: a shared name settles the 133 suffixes
    that start at it. All holders of a name but the first then have nothing to add as evidence.
4.  Merge and compare adjacent. The other suffixes that lean on a sample left are named at 200 bytes;
    in the sorted names a suffix equal to its neighbour is repeated.

Inside a block equal strings are one class, confirmed byte by byte, and a block sends a class once,
however often it holds it. Between blocks the names of steps 3 and 4 are 96-bit BLAKE2b digests of the
bytes under a key drawn for the run, so neither chance nor a prepared text makes two strings equal.

Texts travel as compressed blocks, names as packed arrays with one row for each block and fingerprint
range, and answers as bits in the order of the classes, so no suffix is a row of its own. Names
are ordered by fingerprint, not alphabetically: only equality to a fixed depth is asked for.
Equal texts are collapsed first; a text with a copy is removed whole when it has 200 bytes.
"""

from __future__ import annotations

import os
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .staging import col, files_for, if_small, lean, stage

#: A perfect difference set, every difference mod 133 exactly once.
PERIOD, COVER = 133, (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
#: Bytes of text in a block, and of text for each range of fingerprints.
BLOCK_BYTES, RANGE_BYTES = 2 << 20, 8 << 20
#: Rows with a copy up to which their list is broadcast; beyond, the texts are shuffled to it.
BROADCAST_COPIES = 1_000_000
#: Bytes of a name that only rules out, and of one that decides.
HINT_BYTES, NAME_BYTES = 5, 12
_STEP = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out, known = np.ones(n, np.uint64), 1
    while known < n:
        more = min(known, n - known)
        out[known : known + more] = out[:more] * np.uint64(pow(base, known, 1 << 64))
        known += more
    return out


def fingerprints(text: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """64-bit fingerprints of the strings of ``length`` bytes at sorted places, a stretch at a time."""
    out = np.empty(len(places), np.uint64)
    up, down = _powers(_BASE, _STEP + 4096), _powers(_INVERSE, _STEP + 4096)
    if length > 4096:
        raise ValueError("strings of more than 4096 bytes")
    cuts = np.searchsorted(places, np.arange(0, len(text) + _STEP, _STEP))
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if lo == hi:
            continue
        part = text[k * _STEP : (k + 1) * _STEP + length]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        at = places[lo:hi] - k * _STEP
        x = (sums[at + length] - sums[at]) * down[at]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out[lo:hi] = x ^ (x >> np.uint64(32))
    return out


def sample_places(lengths: np.ndarray, width: int, tuple_bytes: int) -> np.ndarray:
    """Cover places of every document of at least ``width`` bytes whose tuple lies in the document."""
    out, start = [], 0
    for n in lengths.tolist():
        if n >= width:
            grid = _grid(1 << max(16, (n - 1).bit_length()))
            out.append(grid[: np.searchsorted(grid, n - tuple_bytes, side="right")] + start)
        start += n
    return np.concatenate(out) if out else np.empty(0, np.int64)


@lru_cache(maxsize=4)
def _grid(n: int) -> np.ndarray:
    return (np.arange(0, n + PERIOD, PERIOD, dtype=np.int64)[:, None] + np.array(COVER)).reshape(-1)


def candidate_starts(samples: np.ndarray, shared: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Starts of strings of ``width`` bytes that hold a sample with a shared name in their first PERIOD bytes."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    places = samples[shared]
    doc = np.searchsorted(ends, places, side="right")
    first, last = (ends - lengths)[doc], ends[doc] - width
    lo, hi = np.maximum(places - (PERIOD - 1), first), np.minimum(places, last)
    ok = lo <= hi
    return np.flatnonzero(_mask(lo[ok], hi[ok] + 1, total))


def _mask(lo: np.ndarray, hi: np.ndarray, total: int) -> np.ndarray:
    """Which of ``total`` places lie in a stretch from lo to hi; both ends ascend from stretch to stretch."""
    marks = np.zeros(total + 1, np.int8)
    if len(lo):
        new = np.ones(len(lo), bool)
        new[1:] = lo[1:] > hi[:-1]  # a stretch that touches the one before goes on with it
        head = np.flatnonzero(new)
        marks[lo[head]] = 1
        marks[np.minimum(hi[np.append(head[1:], len(lo)) - 1], total)] = -1
    return np.cumsum(marks[:total], dtype=np.int8).view(bool)


def covered_spans(starts: np.ndarray, lengths: np.ndarray, width: int) -> list[list[tuple[int, int]]]:
    """For each document the maximal runs of bytes covered by strings at the starts."""
    spans: list[list[tuple[int, int]]] = [[] for _ in lengths]
    if not len(starts):
        return spans
    ends = np.cumsum(lengths)
    doc = np.searchsorted(ends, starts, side="right")
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] > starts[:-1] + width) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1
    base = ends - lengths
    for d, a, b in zip(doc[head].tolist(), starts[head].tolist(), (starts[tail] + width).tolist(), strict=True):
        spans[d].append((a - int(base[d]), b - int(base[d])))
    return spans


def _differ(text: np.ndarray, one: np.ndarray, other: np.ndarray, length: int) -> np.ndarray:
    """Which pairs of places begin different strings of ``length`` bytes."""
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    parts = [(windows[one[i : i + 4096]] != windows[other[i : i + 4096]]).any(axis=1) for i in range(0, len(one), 4096)]
    return np.concatenate(parts) if parts else np.empty(0, bool)


class Classes:
    """The distinct strings of ``length`` bytes at sorted places of a block, in the order of their fingerprints.

    ``names`` are the fingerprints of the classes, ``of`` the class of every place, ``first`` its first place.
    With ``exact``, strings of one fingerprint are held against each other byte by byte.
    """

    def __init__(self, text: np.ndarray, places: np.ndarray, length: int, exact: bool = True):
        marks = fingerprints(text, places, length)
        order = np.argsort(marks, kind="stable")
        ranked = marks[order]
        new = np.ones(len(places), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        again = np.flatnonzero(~new)
        if exact and len(again):
            odd = again[_differ(text, places[order[again - 1]], places[order[again]], length)]
            heads = np.append(np.flatnonzero(new), len(places))
            for g in np.unique(np.searchsorted(heads, odd, side="right") - 1).tolist():
                a, b = heads[g], heads[g + 1]  # one fingerprint, several strings
                strings = {i: text[places[i] : places[i] + length].tobytes() for i in order[a:b].tolist()}
                order[a:b] = sorted(strings, key=lambda i: (strings[i], i))
                new[a + 1 : b] = [strings[x] != strings[y] for x, y in zip(order[a : b - 1].tolist(), order[a + 1 : b].tolist(), strict=True)]
        self.names, self.first = ranked[new], order[new]
        self.of = np.empty(len(places), np.int64)
        self.of[order] = np.cumsum(new) - 1

    def answered(self, elsewhere: np.ndarray) -> np.ndarray:
        """The places whose string is anywhere else, given the classes that another block has."""
        return (elsewhere | (np.bincount(self.of, minlength=len(self.names)) > 1))[self.of]

    def followers(self, earlier: np.ndarray) -> np.ndarray:
        """The places whose string is in an earlier block or at an earlier place."""
        out = np.ones(len(self.of), bool)
        out[self.first] = False
        return out | earlier[self.of]


def _cuts(names: np.ndarray, n_ranges: int) -> np.ndarray:
    """Where each range of fingerprints begins in the sorted names."""
    which = ((names >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)
    return np.searchsorted(which, np.arange(n_ranges + 1, dtype=np.uint64))


def _in_order(names: np.ndarray, n_ranges: int, answers: dict[int, bytes], planes: int = 1) -> list[np.ndarray]:
    """The planes of answer bits of all ranges, in the order of the sorted names."""
    counts = np.diff(_cuts(names, n_ranges))
    out = []
    for plane in range(planes):
        parts = [np.empty(0, np.uint8)]
        for r in np.flatnonzero(counts).tolist():
            size = len(answers[r]) // planes
            parts.append(np.unpackbits(np.frombuffer(answers[r], "u1", size, plane * size), count=int(counts[r])))
        out.append(np.concatenate(parts).view(bool))
    return out


def _under(places: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of ``total`` places lie in a stretch of ``length`` from one of the sorted places."""
    return _mask(places, places + length, total)


_SLIM = "rid long, doc_id long, d1 long, d2 long, n_bytes long"
_BLOCK = "block long, doc_ids array<long>, lengths array<long>, evidence array<boolean>, body binary"
_OUT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _digest(batches):
    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        digests = b"".join(blake2b(t or b"", digest_size=16).digest() for t in texts)
        halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
        columns = [batch.column(0), batch.column(1), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())]
        columns.append(pa.array([len(t or b"") for t in texts], pa.int64()))
        yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "d1", "d2", "n_bytes"])


def _blocks(block_bytes: int):
    def run(batches):
        part, number, packer = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        ids, texts, proof, size = [], [], [], 0

        def block():
            body = packer.compress(b"".join(texts))
            columns = [pa.array([part << 32 | number], pa.int64()), pa.array([ids], pa.list_(pa.int64()))]
            columns += [pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([proof], pa.list_(pa.bool_()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([body], pa.binary())], names=["block", "doc_ids", "lengths", "evidence", "body"])

        for batch in batches:
            for did, text, evidence in zip(*(batch.column(i) for i in range(3)), strict=True):
                raw = (text.as_py() or "").encode() if text.is_valid else b""
                ids.append(did.as_py())
                texts.append(raw)
                proof.append(evidence.as_py())
                size += len(raw)
                if size >= block_bytes:
                    yield block()
                    ids, texts, proof, size, number = [], [], [], 0, number + 1
        if ids:
            yield block()

    return run


def _rows_of(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}


def _open(row):
    text = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]), "u1") if row["lengths"] else np.empty(0, "u1")
    return text, np.array(row["lengths"], np.int64)


def _answers(row, name):
    return {a["range"]: a["bits"] for a in row[name] or []}


def _named(level: int, n_ranges: int, width: int, key: bytes):
    """The names that a level sends to be sorted, given the answers of the levels before it."""

    def run(batches):
        for row in _rows_of(batches):
            text, lengths = _open(row)
            places, classes = _level(row, text, lengths, level, n_ranges, width)
            if level == 1:
                size, raw = HINT_BYTES, classes.names.astype("<u8").view("u1").reshape(-1, 8)[:, :HINT_BYTES].tobytes()
            else:
                size, length, body = NAME_BYTES, width + PERIOD - 1 if level == 2 else width, memoryview(text.tobytes())
                raw = b"".join(blake2b(body[p : p + length], digest_size=NAME_BYTES, key=key).digest() for p in places[classes.first].tolist())
            cuts = _cuts(classes.names, n_ranges)
            ranges = np.flatnonzero(np.diff(cuts)).tolist()
            blobs = [raw[size * cuts[r] : size * cuts[r + 1]] for r in ranges]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ranges, pa.int32()), pa.array([row["block"]] * len(ranges), pa.int64()), pa.array(blobs, pa.binary())],
                names=["range", "block", "names"],
            )

    return run


def _level(row, text, lengths, level, n_ranges, width):
    """(places, their classes) of level 1 to 3; at level 4 (all repeated starts, None)."""
    tuple_bytes, wide, total = width - PERIOD + 1, width + PERIOD - 1, len(text)
    samples = sample_places(lengths, width, tuple_bytes)
    classes = Classes(text, samples, tuple_bytes, exact=False)
    if level == 1:
        return samples, classes
    shared = classes.answered(_in_order(classes.names, n_ranges, _answers(row, "answers1"))[0])
    left = samples[shared]
    ends = np.cumsum(lengths)
    left = left[ends[np.searchsorted(ends, left, side="right")] - left >= wide]
    classes = Classes(text, left, wide)
    if level == 2:
        return left, classes
    elsewhere, earlier = _in_order(classes.names, n_ranges, _answers(row, "answers2"), 2)
    settled, later = classes.answered(elsewhere), classes.followers(earlier)
    starts = candidate_starts(samples, shared, lengths, width)
    sent = starts[~_under(left[later], PERIOD, total)[starts]]
    classes = Classes(text, sent, width)
    if level == 3:
        return sent, classes
    repeated = _under(left[settled], PERIOD, total)
    repeated[sent[classes.answered(_in_order(classes.names, n_ranges, _answers(row, "answers3"))[0])]] = True
    return np.flatnonzero(repeated), None


def _sorted_names(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the names and, in it, which equal the one before."""
    flat = np.frombuffer(raw, "u1").reshape(-1, size)
    high = np.zeros((len(flat), 8), "u1")
    high[:, : min(size, 8)] = flat[:, :8]
    high = high.view("<u8").reshape(-1)
    order = np.argsort(high, kind="stable")
    same = high[order[1:]] == high[order[:-1]]
    if size > 8:
        low = np.ascontiguousarray(flat[:, 8:]).view("<u4").reshape(-1)
        if (same & (low[order[1:]] != low[order[:-1]])).any():
            order = np.lexsort((low, high))
            same = high[order[1:]] == high[order[:-1]]
        same &= low[order[1:]] == low[order[:-1]]
    return order, same


def _resolve(size: int, planes: int):
    """Sorts the names of a range. A name's first answer bit says that another block has it too, the
    second that an earlier one has. A block sends a name once, so a frequent one costs a row a block."""

    def answer(key, blocks, blobs):
        counts = [len(b) // size for b in blobs]
        order, same = _sorted_names(b"".join(blobs), size)
        later = np.zeros(len(order), bool)
        later[order[1:][same]] = True
        shared = later.copy()
        shared[order[:-1][same]] = True
        at = np.cumsum([0, *counts])
        bits = [b"".join(np.packbits(p[a:b]).tobytes() for p in (shared, later)[:planes]) for a, b in zip(at, at[1:], strict=False)]
        columns = [pa.array(blocks, pa.int64()), pa.array([key] * len(blocks), pa.int32()), pa.array(bits, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["block", "range", "bits"])

    def run(batches):
        key, blocks, blobs = None, [], []
        for batch in batches:
            for r, b, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if r != key and blocks:
                    yield answer(key, blocks, blobs)
                    blocks, blobs = [], []
                key = r
                blocks.append(b)
                blobs.append(names.as_py())
        if blocks:
            yield answer(key, blocks, blobs)

    return run


def _cut(n_ranges: int, width: int):
    def run(batches):
        for row in _rows_of(batches):
            text, lengths = _open(row)
            starts, _ = _level(row, text, lengths, 4, n_ranges, width)
            ids, sizes, found, kept, at, raw = [], [], [], [], 0, text.tobytes()
            for did, n, proof, spans in zip(row["doc_ids"], row["lengths"], row["evidence"], covered_spans(starts, lengths, width), strict=True):
                if not proof:
                    edges = [0, *(x for s in spans for x in s), n]
                    ids.append(did)
                    sizes.append(n)
                    found.append([{"start": a, "end": b} for a, b in spans])
                    kept.append(b"".join(raw[at + a : at + b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                at += n
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    return run


def remove_repeats(
    docs: DataFrame,
    *,
    width: int = 200,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of the removed runs) and kept (the other bytes) of every row.

    A byte goes when a string of ``width`` bytes that covers it starts anywhere else too, in this or
    another document; strings do not cross documents and are judged on the input. Null texts are
    empty. Texts shorter than ``width`` lose nothing. Rows that repeat a text are all judged, whatever their
    ids; null ids stay null, other columns are not read, and an empty table gives no rows.
    """
    if width < PERIOD + 8:
        raise ValueError(f"a width of {width}; at least {PERIOD + 8} is needed")
    spark = docs.sparkSession
    ship_package(spark)
    slim = docs.select(
        F.monotonically_increasing_id().alias("rid"), col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")
    )
    digests = stage(slim.mapInArrow(lean(_digest), _SLIM), "digests")
    same = digests.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("rid").alias("first")).filter("n > 1")
    files = files_for(digests.count(), 200_000)
    same = stage(same.select(F.col("d1").alias("s1"), F.col("d2").alias("s2"), "first"), "same-texts", files=files)
    copies = digests.join(same, (F.col("d1") == F.col("s1")) & (F.col("d2") == F.col("s2")))
    copies = copies.select(F.col("rid").alias("c_rid"), (F.col("rid") == F.col("first")).alias("evidence"), "n_bytes")
    copies = stage(copies, "copies", files=files)
    listed = if_small(copies, BROADCAST_COPIES)
    # A text with copies stands for them as evidence, under one row; short texts are settled at once.
    roles = slim.join(listed.select("c_rid", "evidence"), F.col("rid") == F.col("c_rid"), "left")
    options = {"compression": "none", "parquet.block.size": 32 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4}
    blocks = stage(
        roles.filter("evidence IS NULL OR evidence")
        .select("doc_id", "text", F.coalesce("evidence", F.lit(False)).alias("evidence"))
        .mapInArrow(lean(_blocks(block_bytes)), _BLOCK),
        "blocks",
        **options,
    )
    total = digests.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    n_ranges = max(48, -(-total // range_bytes))
    answered = blocks
    key = os.urandom(16)
    for level, n_bytes, planes in ((1, HINT_BYTES, 1), (2, NAME_BYTES, 2), (3, NAME_BYTES, 1)):
        names = answered.mapInArrow(lean(_named(level, n_ranges, width, key)), "range int, block long, names binary")
        answers = (
            names.repartitionById(n_ranges, "range")
            .sortWithinPartitions("range", "block")
            .mapInArrow(lean(_resolve(n_bytes, planes)), "block long, range int, bits binary")
        )
        replies = stage(answers, f"answers-{level}", files=min(n_ranges, files_for(total, 256 << 20, 2 * spark.sparkContext.defaultParallelism))).groupBy(F.col("block").alias(f"b{level}")).agg(
            F.collect_list(F.struct("range", "bits")).alias(f"answers{level}")  # a few bits for each suffix of a block
        )
        answered = answered.join(replies, F.col("block") == F.col(f"b{level}"), "left").drop(f"b{level}")
    cut = answered.mapInArrow(lean(_cut(n_ranges, width)), _OUT)
    texts = slim.join(listed.filter(f"n_bytes < {width}").select("c_rid"), F.col("rid") == F.col("c_rid"), "left_semi")
    short = texts.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("kept"),
    )
    whole = digests.join(listed.filter(f"n_bytes >= {width}").select("c_rid"), F.col("rid") == F.col("c_rid"), "left_semi").select(
        "doc_id",
        "n_bytes",
        F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).alias("spans"),
        F.lit(b"").alias("kept"),
    )
    return cut.unionByName(short).unionByName(whole)
