"""Token shards as wavelet matrices: bit planes with rank and select, compressed in blocks.

A shard holds the ids of a run of documents. Plane 0 has the highest bit of every id in order; each
further plane has the next bit after a stable partition by the planes above. Planes are packed into
blocks that are compressed each on its own. A directory counts the ones before every 4096 bits, so a rank
reads an entry and counts the set bits of at most 512 bytes of one block; select finds its stretch by
bisection in the directory. Access, counting and occurrence lookup read a few blocks of each plane.
"""

from __future__ import annotations

import struct
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .staging import col, fresh_path, lean
from .tokens import encoder

_MAGIC = b"TFWM"
_HEAD = struct.Struct("<4sIQQI")
#: Bytes of a block of a plane, and of a stretch between two entries of the directory.
BLOCK, STRETCH = 1 << 15, 1 << 9
#: Decompressed blocks that a reader keeps.
CACHED_BLOCKS = 256


class WaveletShard:
    """One shard, read from its bytes."""

    def __init__(self, blob: bytes):
        magic, self.levels, self.n, n_docs, n_blocks = _HEAD.unpack_from(blob)
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size
        self.zeros = np.frombuffer(blob, "<u8", self.levels, at).astype(np.int64)
        at += 8 * self.levels
        n_entries = -(-self.n // (8 * STRETCH)) + 1
        self._ones = np.frombuffer(blob, "<u4", self.levels * n_entries, at).reshape(self.levels, n_entries)
        at += 4 * self.levels * n_entries
        self._ends = np.frombuffer(blob, "<u8", self.levels * n_blocks, at).reshape(self.levels, n_blocks)
        at += 8 * self.levels * n_blocks
        size = struct.unpack_from("<Q", blob, at)[0]
        docs = zstandard.ZstdDecompressor().decompress(blob[at + 8 : at + 8 + size])
        self._base = at + 8 + size
        self._blob, self._cache = blob, OrderedDict()
        self.lengths = np.frombuffer(docs, "<u8", n_docs).astype(np.int64)
        self.has_id = np.frombuffer(docs, "u1", n_docs, 8 * n_docs).astype(bool)
        self.doc_ids = np.frombuffer(docs, "<i8", n_docs, 9 * n_docs)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)

    @staticmethod
    def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
        n, levels = len(ids), max(1, int(ids.max()).bit_length() if len(ids) else 1)
        value = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        n_blocks, n_entries = max(1, -(-n // (8 * BLOCK))), -(-n // (8 * STRETCH)) + 1
        packer = zstandard.ZstdCompressor(level=1)
        zeros, ones, ends, blocks, end = [], np.zeros((levels, n_entries), "<u4"), [], [], 0
        for level in range(levels):
            bit = (value & value.dtype.type(1 << (levels - 1 - level))) != 0
            plane = np.packbits(bit)
            whole = np.zeros((n_entries - 1) * STRETCH, "u1")
            whole[: len(plane)] = plane
            ones[level, 1:] = np.cumsum(np.bitwise_count(whole.view("<u8")).reshape(-1, STRETCH // 8).sum(axis=1, dtype=np.int64))
            for b in range(n_blocks):
                blocks.append(packer.compress(plane[b * BLOCK : (b + 1) * BLOCK].tobytes()))
                end += len(blocks[-1])
                ends.append(end)
            zeros.append(n - int(ones[level, -1]))
            if level + 1 < levels:
                value = np.concatenate([np.compress(~bit, value), np.compress(bit, value)])
        docs = packer.compress(
            np.array(lengths, "<u8").tobytes()
            + np.array([d is not None for d in doc_ids], "u1").tobytes()
            + np.array([d or 0 for d in doc_ids], "<i8").tobytes()
        )
        return b"".join(
            [
                _HEAD.pack(_MAGIC, levels, n, len(doc_ids), n_blocks),
                np.array(zeros, "<u8").tobytes(),
                ones.tobytes(),
                np.array(ends, "<u8").tobytes(),
                struct.pack("<Q", len(docs)),
                docs,
                *blocks,
            ]
        )

    def _block(self, level: int, b: int) -> np.ndarray:
        """The packed bits of a block."""
        if (level, b) in self._cache:
            self._cache.move_to_end((level, b))
        else:
            flat = level * self._ends.shape[1] + b
            ends = self._ends.reshape(-1)
            lo, hi = self._base + (int(ends[flat - 1]) if flat else 0), self._base + int(ends[flat])
            raw = zstandard.ZstdDecompressor().decompress(self._blob[lo:hi])
            self._cache[level, b] = np.frombuffer(raw, "u1")
            if len(self._cache) > CACHED_BLOCKS:
                self._cache.popitem(last=False)
        return self._cache[level, b]

    def _stretch(self, level: int, e: int) -> np.ndarray:
        """The packed bits between entries e and e + 1 of the directory."""
        b, r = divmod(e * STRETCH, BLOCK)
        return self._block(level, b)[r : r + STRETCH]

    def _bit(self, level: int, i: int) -> int:
        return int(self._stretch(level, i // (8 * STRETCH))[i // 8 % STRETCH]) >> (7 - i % 8) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones of the plane before place i."""
        e, r = divmod(i, 8 * STRETCH)
        ones = int(self._ones[level, e])
        if r:
            part = self._stretch(level, e)
            ones += int(np.bitwise_count(part[: r // 8]).sum())
            if r % 8:
                ones += (int(part[r // 8]) >> (8 - r % 8)).bit_count()
        return ones

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) one or zero of the plane."""
        entries = self._ones[level] if bit else np.minimum(np.arange(self._ones.shape[1]) * (8 * STRETCH), self.n) - self._ones[level]
        e = int(np.searchsorted(entries, k, side="right")) - 1
        bits = np.unpackbits(self._stretch(level, e))
        return e * 8 * STRETCH + int(np.flatnonzero(bits == bit)[k - int(entries[e])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = int(self.zeros[level]) + ones if bit else i - ones
        return value

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the id before place i."""
        if token >> self.levels:
            return 0
        lo, hi = 0, i
        for level in range(self.levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if token >> (self.levels - 1 - level) & 1:
                lo, hi = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                lo, hi = lo - a, hi - b
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of the id."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = 0  # down to where the occurrences of the id begin in the last plane's order, and up again
        for level in range(self.levels):
            ones = self._rank1(level, i)
            i = int(self.zeros[level]) + ones if token >> (self.levels - 1 - level) & 1 else i - ones
        i += k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids, by undoing the partitions from the last plane to the first."""
        dtype = np.uint16 if self.levels <= 16 else np.uint32
        value = np.zeros(self.n, dtype)
        unpack = zstandard.ZstdDecompressor()
        ends = np.concatenate([[0], self._ends.reshape(-1)]).astype(np.int64) + self._base
        n_blocks = self._ends.shape[1]
        for level in range(self.levels - 1, -1, -1):
            raw = b"".join(
                unpack.decompress(self._blob[ends[f] : ends[f + 1]]) for f in range(level * n_blocks, (level + 1) * n_blocks)
            )
            bit = np.unpackbits(np.frombuffer(raw, "u1"), count=self.n).view(bool)
            zeros, out = int(self.zeros[level]), np.empty(self.n, dtype)
            out[np.flatnonzero(~bit)] = value[:zeros]
            out[np.flatnonzero(bit)] = value[zeros:] | dtype(1 << (self.levels - 1 - level))
            value = out
        return value

    def crcs(self) -> list[int]:
        """The unsigned crc32 of every document's ids as little-endian unsigned 32-bit integers."""
        raw, at = memoryview(self.tokens().astype("<u4").tobytes()), (self.starts * 4).tolist()
        return [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]


_FILE = "part int, chunk int, n_docs long, n_tokens long, blob binary"


def _write(path: str, end_id: int, chunk_tokens: int):
    end = np.array([end_id], "<u4")

    def run(batches):
        coder, part, chunk = encoder(path), TaskContext.get().partitionId(), 0
        ids, raw, lengths, size = [], [], [], 0

        def shard():
            tokens = np.concatenate(raw)
            blob = WaveletShard.build(tokens, ids, lengths)
            columns = [pa.array([part], pa.int32()), pa.array([chunk], pa.int32())]
            columns += [pa.array([len(ids)], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([blob], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "n_docs", "n_tokens", "blob"])

        for batch in batches:
            for did, code in zip(batch.column(0).to_pylist(), coder.encode_batch(batch.column(1)), strict=True):
                ids.append(did)
                raw += [code, end]
                lengths.append(len(code) + 1)
                size += len(code) + 1
                if size >= chunk_tokens:
                    yield shard()
                    ids, raw, lengths, size, chunk = [], [], [], 0, chunk + 1
        if ids:
            yield shard()

    return run


def write_shards(
    docs: DataFrame,
    tokenizer: str,
    path: str | None = None,
    *,
    end_id: int = 2,
    chunk_tokens: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> str:
    """Encode all documents in ascending id order and write their shards; returns the folder.

    A row of the written Parquet files is one shard of at least ``chunk_tokens`` ids (but for the last of
    a partition), whole documents each. Null ids come first, null and empty texts are the end id
    alone, rows that share an id keep their input order, other columns are not read, and an empty
    table writes no shard. Spark's committer writes the files, so a lost executor leaves none in half.
    """
    ship_package(docs.sparkSession)
    path = path or fresh_path(docs.sparkSession, "token-shards")
    slim = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"), F.monotonically_increasing_id().alias("tie"))
    ordered = slim.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "tie"
    )
    shards = ordered.select("doc_id", "text").mapInArrow(lean(_write(tokenizer, end_id, chunk_tokens)), _FILE)
    options = {"parquet.block.size": 32 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4}
    shards.write.options(**options).option("compression", "none").parquet(path)
    return path


def _read(batches):
    for batch in batches:
        for part, chunk, blob in zip(*(batch.column(i) for i in range(3)), strict=True):
            shard = WaveletShard(blob.as_py())
            n = len(shard.doc_ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part.as_py(), np.int32)),
                    pa.array(np.full(n, chunk.as_py(), np.int32)),
                    pa.array(shard.doc_ids, mask=~shard.has_id),
                    pa.array(shard.starts[:-1]),
                    pa.array(shard.lengths),
                    pa.array(shard.crcs(), pa.int64()),
                ],
                names=["part", "chunk", "doc_id", "local_start", "n_tokens", "ids_crc32"],
            )


def read_shards(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files alone."""
    ship_package(spark)
    files = spark.read.schema(_FILE).parquet(path)
    docs = files.select("part", "chunk", "blob").mapInArrow(
        lean(_read), "part int, chunk int, doc_id long, local_start long, n_tokens long, ids_crc32 long"
    )
    sizes = files.select("part", "chunk", "n_tokens")
    in_part = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    over_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(over_parts), F.lit(0)).alias("part_start")
    )
    chunks = sizes.withColumn("chunk_start", F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0))).drop("n_tokens")
    offsets = chunks.join(parts, "part").select("part", "chunk", (F.col("part_start") + F.col("chunk_start")).alias("before"))
    return docs.join(offsets, ["part", "chunk"]).select(
        "doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )
