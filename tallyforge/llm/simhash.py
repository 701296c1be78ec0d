"""Near-duplicates by SimHash fingerprints, found by anchor points of a covering code.

A linear code whose balls of the covering radius R fill a space is a set of anchors: every fingerprint has an anchor
within R, its home. If two fingerprints differ in at most d bits, either lies within R + d of the other's home. So each distinct
fingerprint is sent to every anchor within the covering radius plus the threshold, and is compared there with those whose home
the anchor is. The code is a product of two perfect binary Golay codes (23 bits, radius 3) over 46 of the 64 bits; in a
product a word may exceed the radius of each factor by bits that sum to d at most. That gives 2^24 anchors and on average
60 rows for a fingerprint at d = 2, whatever the data. An anchor is cut by salt: its homes go to all salts, the
others to one, and what a task holds of an anchor are its homes. Where an anchor has more homes than a fingerprint has neighbours
within d bits, the neighbours are looked up instead of compared. Links of a task leave it as a spanning forest.
"""

from __future__ import annotations

from functools import cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .components import components
from .staging import col, files_for, if_small, lean, stage

BITS = 64
#: Parts of an anchor.
SALTS = 8
#: Pairs of a comparison that are in memory at a time.
PAIRS = 1 << 21
#: Components up to which their smallest ids are broadcast.
BROADCAST_COMPONENTS = 1_000_000
#: Fingerprints with more than a share of 1 / OFTEN of all rows are joined by broadcast; there are at most OFTEN.
OFTEN = 50_000
#: The generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the binary Golay code of length 23.
_GOLAY = 0b101011100011
_NO_LINKS = np.empty(0, np.int64)


# Fingerprints


def shingles(text: bytes | None, k: int = 3) -> list[bytes]:
    """The k-word shingles of the A-Z lower-cased words, repeats included; all words as one shingle when fewer."""
    words = text.lower().split() if text else []
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-k]]).tolist()
    return [joined[a:b] for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)]


_digest = partial(xxhash.xxh64_digest, seed=42)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(parts: list[bytes]) -> int:
    """The bits that more than half of the shingles' hashes have; zero without shingles."""
    if not parts:
        return 0
    octets = np.frombuffer(b"".join(map(_digest, parts)), np.uint8).reshape(-1, 8)
    if len(octets) < 256:
        ones = np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(octets)).tobytes(), "big")


def _fingerprints(k: int):
    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(shingles(t, k)) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


# Anchors


class Covering:
    """A perfect linear code: for every syndrome the error patterns of up to radius + extra bits, lightest first.

    ``columns`` are the syndromes of the single bits. A word's codewords within its radius plus e bits are the word
    with each pattern of its syndrome taken off.
    """

    def __init__(self, columns: list[int], radius: int, extra: int):
        n, self.rank = len(columns), max(columns).bit_length()
        by_syndrome: list[list[tuple[int, int]]] = [[] for _ in range(1 << self.rank)]
        for weight in range(radius + extra + 1):
            for bits in combinations(range(n), weight):
                syndrome = 0
                for b in bits:
                    syndrome ^= columns[b]
                by_syndrome[syndrome].append((max(0, weight - radius), sum(1 << b for b in bits)))
        self.bits, self.patterns = n, np.array([p for s in by_syndrome for _, p in s], np.uint64)
        self.excess = np.array([e for s in by_syndrome for e, _ in s], np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(s) for s in by_syndrome])[:-1]])
        #: Patterns by syndrome with an excess of at most e.
        self.upto = np.array([[sum(x <= e for x, _ in s) for e in range(extra + 1)] for s in by_syndrome])
        self.low, self.high = (self._table(columns[at : at + 12]) for at in (0, 12))

    @staticmethod
    def _table(columns: list[int]) -> np.ndarray:
        table = np.zeros(1, np.int64)
        for c in columns:
            table = np.concatenate([table, table ^ c])
        return table

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        return self.low[(words & np.uint64(0xFFF)).astype(np.int64)] ^ self.high[(words >> np.uint64(12)).astype(np.int64)]


@cache
def golay(extra: int) -> Covering:
    columns, x = [], 1
    for _ in range(23):
        columns.append(x)
        x <<= 1
        x ^= _GOLAY if x >> 11 else 0
    return Covering(columns, 3, extra)


def anchors(fps: np.ndarray, extra: int, blocks: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, excess) of every anchor within the covering radius plus ``extra`` bits of each fingerprint."""
    code = golay(extra)
    row, anchor, excess = np.arange(len(fps)), np.zeros(len(fps), np.uint64), np.zeros(len(fps), np.int64)
    for b in range(blocks):
        words = (fps >> np.uint64(b * code.bits)) & np.uint64((1 << code.bits) - 1)
        syndrome = code.syndromes(words)[row]
        n = code.upto[syndrome, extra - excess]
        at = np.repeat(code.first[syndrome] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        row, anchor, excess = np.repeat(row, n), np.repeat(anchor, n), np.repeat(excess, n) + code.excess[at]
        anchor |= (words[row] ^ code.patterns[at]) << np.uint64(b * code.bits)
    return row, anchor, excess


def _replicas(extra: int, salts: int):
    """anchor, salt, role, fp: homes (role 0) in all salts, and every fingerprint (role 1) in one."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                fps = batch.column(0).slice(at, 1024).to_numpy().view(np.uint64)
                row, anchor, excess = anchors(fps, extra)
                home = np.repeat(np.flatnonzero(excess == 0), salts)
                salt = np.concatenate([np.tile(np.arange(salts), len(home) // salts), (fps * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40))[row].astype(np.int64) % salts])
                role = np.repeat(np.array([0, 1], np.int8), [len(home), len(row)])
                every = np.concatenate([home, np.arange(len(row))])
                columns = [anchor[every].view(np.int64), salt.astype(np.int8), role, fps[row[every]].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "salt", "role", "fp"])

    return run


# Links


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of a graph that are not the smallest of their component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


@cache
def _masks(extra: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for w in range(1, extra + 1) for bits in combinations(range(BITS), w)], np.uint64)


def _compared(fps: np.ndarray, first: np.ndarray, n: np.ndarray, homes: np.ndarray, extra: int):
    """The links of each fingerprint with its n homes from first on, some pairs at a time."""
    before = np.cumsum(n) - n
    cuts = np.searchsorted(before, np.arange(0, int(n.sum()) + 1, PAIRS)).tolist()
    for lo, hi in zip(cuts, [*cuts[1:], len(fps)], strict=True):
        if lo == hi:
            continue
        row = np.repeat(np.arange(lo, hi), n[lo:hi])
        place = np.repeat(first[lo:hi] - (before[lo:hi] - before[lo]), n[lo:hi]) + np.arange(len(row))
        gap = np.bitwise_count(fps[row] ^ homes[place])
        near = (gap > 0) & (gap <= extra)
        if near.any():
            yield forest(fps[row[near]].view(np.int64), homes[place[near]].view(np.int64))


def _looked_up(fps: np.ndarray, homes: np.ndarray, extra: int):
    """The links of fingerprints with homes of one anchor, by the fingerprints' neighbours."""
    homes = np.sort(homes)
    for mask in _masks(extra):
        wanted = fps ^ mask
        at = np.minimum(np.searchsorted(homes, wanted), len(homes) - 1)
        hit = homes[at] == wanted
        if hit.any():
            yield fps[hit].view(np.int64), wanted[hit].view(np.int64)


def _links(extra: int):
    """A spanning forest of the links of each batch. Rows come sorted by anchor, salt and role, homes first."""

    def run(batches):
        last, carried = None, np.empty(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, salt, role = (batch.column(i).to_numpy() for i in range(3))
            fp = batch.column(3).to_numpy().view(np.uint64)
            new = np.ones(len(fp), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])
            group = np.cumsum(new) - 1
            if last != (anchor[0], salt[0]):
                carried = carried[:0]
            is_home = role == 0
            homes = np.concatenate([carried, fp[is_home]])
            counts = np.bincount(group[is_home], minlength=group[-1] + 1)
            counts[0] += len(carried)
            firsts = np.cumsum(counts) - counts
            asked, g = fp[~is_home], group[~is_home]
            many = counts[g] > 2 * len(_masks(extra))
            found = list(_compared(asked[~many], firsts[g[~many]], counts[g[~many]], homes, extra))
            for one in np.unique(g[many]):
                found.extend(_looked_up(asked[g == one], homes[firsts[one] : firsts[one] + counts[one]], extra))
            if found:
                node, root = forest(*(np.concatenate(side) for side in zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])
            last, carried = (anchor[-1], salt[-1]), homes[firsts[-1] :]

    return run


def link_fingerprints(distinct: DataFrame, *, bits: int = 2, salts: int = SALTS, files: int = 12) -> DataFrame:
    """(a, b) pairs of fp values that connect exactly what links of at most ``bits`` differing bits connect."""
    rows = distinct.select("fp").mapInArrow(lean(_replicas(bits, salts)), "anchor long, salt byte, role byte, fp long")
    rows = rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "role")
    return stage(rows.mapInArrow(lean(_links(bits)), "a long, b long").distinct(), "fingerprint-links", files=files)


def simhash_groups(docs: DataFrame, *, k: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (64 bits as a long) and component_id of every row.

    A fingerprint bit is set when more than half of the k-word shingles' XXH64 hashes (seed 42) have it. Rows are
    linked when their fingerprints differ in at most ``bits`` bits; the component is the smallest id reachable. Null, empty and blank texts
    have the fingerprint zero and are linked like any other. Rows are linked by fingerprint only: rows that share an id
    stay apart if their fingerprints do. A null id never is a component; a group of null ids only has a null one. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    slim = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    fps = stage(slim.mapInArrow(lean(_fingerprints(k)), "doc_id long, fp long"), "fingerprints")
    total = fps.count()
    files = files_for(total, 200_000)
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints", files=files)
    links = link_fingerprints(distinct, bits=bits, files=files)
    shared = distinct.filter("n > 1").select("fp", "n", F.col("least").alias("component_id"))
    if links.limit(1).count():
        groups = components(links, files=files).join(distinct, F.col("node") == F.col("fp")).select("fp", "n", "least", "component")
        groups = stage(groups, "linked-fingerprints", files=files)
        least = stage(groups.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id")), "least-ids", files=files)
        groups = groups.join(if_small(least, BROADCAST_COMPONENTS), F.col("component") == F.col("c")).select("fp", "n", "component_id")
        shared = groups.union(shared.join(groups.select("fp"), "fp", "left_anti"))
    shared = stage(shared, "groups", files=files).withColumnRenamed("fp", "of")
    often = F.col("n") > total // OFTEN
    rest = fps.join(F.broadcast(shared.filter(often)), F.col("fp") == F.col("of"), "left")
    rare = rest.filter("of IS NULL").select("doc_id", "fp").join(shared.filter(~often), F.col("fp") == F.col("of"), "left")
    known = rest.filter("of IS NOT NULL")
    out = lambda df: df.select("doc_id", "fp", F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out(known).union(out(rare))


def hex_digits(fp: str = "fp"):
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
