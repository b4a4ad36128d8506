"""Connected components by alternating stars: joins and aggregations only, a number of rounds logarithmic in the size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.storage import discard, materialize

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node gets an edge to the node's least neighbour (or the node itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")))
    out = materialize(both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    discard(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and all its smaller neighbours get an edge to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"))
    moved = down.join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = materialize(moved.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
    discard(least)
    return out


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """``node, component`` for every node of an edge between different ends; ``component`` is the least node reachable.

    Edges with a null end, loops and repeated edges change nothing; without edges the result is empty. A node with very
    many edges is never gathered: its least neighbour is a partial aggregate, written before it is joined back, so that
    adaptive execution can split the join (right above an aggregation it could not). Tables of earlier rounds are removed.
    """
    e = materialize(edges.select(edges[left].alias("u"), edges[right].alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(MOST_ROUNDS):
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if now == state or not now[0]:
            break
        state = now
        star = _large_star(e)
        after = _small_star(star)
        discard(e, star)
        e = after
    else:
        raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def local_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node reachable from each of the nodes 0 .. n-1 over the edges i-j: for a small graph within one task."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label
