"""Exact top-k inner products, pruned by segment means and deviations from coarse to fine.

For vectors cut into segments, the squared distance is at least the sum over segments of
m * ((mean difference)^2 + (deviation difference)^2). As |q - x|^2 = |q|^2 + |x|^2 - 2 q.x, that is an
upper bound of the inner product: the sum of m * (mean_q * mean_x + dev_q * dev_x). Queries and
candidates meet in a grid of blocks. A first pass searches one block of candidates and gives every query a
floor, its k-th best score there, which goes with it to all other cells. In a cell the components are
ordered by their energy, so that segments hold components of one size, and the bounds go from one segment
to segments of two components; a candidate whose bound falls below the floor, or below the k-th best exact
score of the cell's most promising candidates, is out, and the survivors are scored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .staging import col, stage

#: Rows of a block of queries or candidates at most; a cell of the grid holds one of each.
BLOCK = 1 << 16
#: Queries scored at a time in a cell, which bounds its bound matrices.
CHUNK = 64
_EXACT = float(1 << 53)


def _encode(scale: float):
    """vec_id, dim, v: the floored integers as little-endian 64-bit bytes; invalid vectors are left out."""

    def run(batches):
        for batch in batches:
            ids, dims, blobs = [], [], []
            for i, v in zip(batch.column(0), batch.column(1), strict=True):
                if not i.is_valid or not v.is_valid or v.values.null_count:
                    continue
                x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if np.isfinite(x).all():
                    ids.append(i.as_py())
                    dims.append(len(x))
                    blobs.append(np.clip(x, -(2.0**62), 2.0**62).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], names=["vec_id", "dim", "v"]
            )

    return run


def segment_bounds(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(m) * mean and sqrt(m) * deviation by segment: their product bounds the inner product."""
    parts = np.array_split(x, segments, axis=1)
    means = np.stack([p.mean(axis=1) * np.sqrt(p.shape[1]) for p in parts], axis=1)
    devs = np.stack([p.std(axis=1) * np.sqrt(p.shape[1]) for p in parts], axis=1)
    return np.concatenate([means, devs], axis=1)


def resolutions(dim: int) -> list[int]:
    """1, 4, 16, ... segments, and at last segments of two components."""
    return sorted({*(4**i for i in range(12) if 4**i * 4 <= dim), max(1, dim // 2)})


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as integers; beyond 2^53 with Python's integers, held within 64 bits."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < _EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    full = q.astype(object) @ x.astype(object).T
    return np.clip(full, -(2**63), 2**63 - 1).astype(np.int64)


def search_cell(q_ids, q, x_ids, x, k: int, floors=None):
    """(query_id, vec_id, score, scored) of the k best of x for each query, ties to smaller ids.

    ``floors`` has a score for each query that k candidates elsewhere reach. ``scored`` says in the first row of a
    query how many candidates were scored exactly, and is 0 in the others.
    """
    levels, found = resolutions(q.shape[1]) if q.shape[1] else [], []
    by_energy = np.argsort(-(x.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    order = np.argsort(x_ids, kind="stable")
    q, x_ids, x = q[:, by_energy], x_ids[order], x[order][:, by_energy]
    x_bounds = [segment_bounds(x.astype(np.float64), s) for s in levels]
    for at in range(0, len(q_ids), CHUNK):
        ids, rows = q_ids[at : at + CHUNK], q[at : at + CHUNK]
        alive = np.ones((len(ids), len(x_ids)), bool)
        place = np.searchsorted(x_ids, ids)
        inside = np.flatnonzero((place < len(x_ids)) & (x_ids[np.minimum(place, len(x_ids) - 1)] == ids))
        alive[inside, place[inside]] = False
        floor = np.full(len(ids), -np.inf) if floors is None else floors[at : at + CHUNK].copy()
        for s, xb in zip(levels, x_bounds, strict=True):
            qb = segment_bounds(rows.astype(np.float64), s)
            bound = qb @ xb.T
            bound += 1e-9 * (np.linalg.norm(qb, axis=1)[:, None] * np.linalg.norm(xb, axis=1)[None, :]) + 1e-6
            if len(x_ids) > 4 * k:  # the exact scores of the most promising candidates raise the floor
                bound[~alive] = -np.inf
                top = np.argpartition(-bound, 4 * k - 1, axis=1)[:, : 4 * k]
                for i, js in enumerate(top):
                    js = js[alive[i, js]]
                    if len(js) >= k:
                        floor[i] = max(floor[i], float(np.partition(_exact(rows[i : i + 1], x[js])[0], -k)[-k]))
            alive &= bound >= floor[:, None]
            if alive.mean() < 0.02:
                break
        dense = alive.mean() > 0.25
        scores = _exact(rows, x) if dense else None
        for i, one in enumerate(ids):
            js = np.flatnonzero(alive[i])
            if not len(js):
                continue
            n = len(js)
            got = scores[i, js] if dense else _exact(rows[i : i + 1], x[js])[0]
            if len(js) > k:
                keep = got >= np.partition(got, -k)[-k]
                js, got = js[keep], got[keep]
            best = np.lexsort((js, -got))[:k]
            found.extend((one, x_ids[js[b]], got[b], 0 if rank else n) for rank, b in enumerate(best))
    return found


_FOUND = "query_id long, vec_id long, score long, scored long"


def _cell(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            dim = int(right["dim"].iloc[0])
            q, x = (np.frombuffer(b"".join(v), "<i8").reshape(len(v), dim) for v in (left["q_v"], right["v"]))
            floors = left["q_floor"].astype("float64").fillna(-np.inf).to_numpy()  # a float holds a score up to 2^53 exactly; beyond, the bounds' slack is far larger
            found = search_cell(left["q_vec_id"].to_numpy(), q, right["vec_id"].to_numpy(), x, k, floors)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score", "scored"]).astype("int64")

    return run


def top_k(
    vectors: DataFrame, *, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, counted: bool = False
) -> DataFrame:
    """The k best other rows of every row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Components become floor(scale * x) and scores are exact integers, held within 64 bits. Rows with
    a null id, a null vector or a null or non-finite component take no part. Rows that repeat an id
    are one row, that of the smallest vector; vectors of different lengths are not compared. A query
    with fewer than k others gets them all. An empty table gives no rows. With ``counted``, the column
    scored says how many candidates of the query passed all bounds and were scored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    coded = vectors.select(col(id_col).cast("long").alias("i"), col(vec_col).alias("v")).mapInArrow(
        _encode(scale), "vec_id long, dim int, v binary"
    )
    rows = coded.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("m")).select("vec_id", "m.dim", "m.v")
    rows = stage(rows, "vectors")
    is_query = F.col("vec_id") % every == 0
    total, asked = rows.agg(F.count("*"), F.count_if(is_query)).first()
    cores = spark.sparkContext.defaultParallelism
    n_x = max(1, -(-total // block), min(2 * cores, total // 2048))
    n_q = max(1, -(-asked // block))
    block_of = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    queries = rows.filter(is_query).withColumn("qb", block_of(n_q))
    others = rows.withColumn("xb", block_of(n_x))
    key = ["dim", "qb", "xb"]

    def cells(left: DataFrame, right: DataFrame, from_x: int) -> DataFrame:
        """The cells of the candidate blocks from ``from_x`` on."""
        right = right.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
        left = left.withColumn("xb", F.explode(F.sequence(F.lit(from_x), F.lit(n_x - 1 if from_x else 0))))
        left = left.select(*(F.col(c).alias(f"q_{c}") for c in ("vec_id", "dim", "v", "floor", "qb", "xb")))
        return left.groupBy(*(f"q_{c}" for c in key)).cogroup(right.groupBy(*key)).applyInPandas(_cell(k), _FOUND)

    found = cells(queries.withColumn("floor", F.lit(None).cast("long")), others.filter("xb = 0"), 0)
    if n_x > 1:
        found = stage(found, "first-block", files=max(4, n_q // 16))
        floors = found.groupBy(F.col("query_id").alias("f_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        floored = queries.join(floors, F.col("vec_id") == F.col("f_id"), "left").drop("f_id")
        found = found.union(cells(floored, others.filter("xb > 0"), 1))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = ["query_id", "rank", "vec_id", "score"]
    if counted:
        found, out = found.withColumn("scored", F.sum("scored").over(Window.partitionBy("query_id"))), [*out, "scored"]
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(*out)
