"""Connected components of an edge table, without gathering neighbours or leaving the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def components(edges: DataFrame, *, max_rounds: int = 60, files: int = 12) -> DataFrame:
    """(node, component) for every node of edges(a, b): the component is its smallest node.

    Alternates two contractions until nothing changes: every node hands its larger neighbours to its
    smallest neighbour (large star), then its smaller neighbours (small star). Each round is a minimum
    by node, which combines before the shuffle, and a join; the number of rounds grows with the
    logarithm of the longest path. Every round is written in the shared folder.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    links = stage(links, "links", files=files)
    before = None
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("v"), F.col("u")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.col("n")).alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.filter("u <> v").distinct(), "large-star", files=files)
        least = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("n"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        links = stage(small.filter("u <> v").distinct(), "small-star", files=files)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    own = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.union(links.select(F.col("v"), F.col("v"))).distinct()


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of a task's links that are not the smallest of their component: what connects the same
    nodes in fewer pairs."""
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
