"""Connected components of an edge table, by rounds of large-star and small-star on Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import forget, written


def local_roots(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of n numbers the smallest one that the pairs of ``left`` and ``right`` lead to, within one task."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _with_least(rows: DataFrame, node: str, neighbour: str) -> DataFrame:
    """Each row with the least of its node and the node's neighbours.

    The second join key makes both sides shuffle for the join, so adaptive execution can split a node of very many edges.
    """
    least = rows.groupBy(F.col(node).alias("_k")).agg(F.min(neighbour).alias("_m"))
    least = least.select("_k", F.least("_k", "_m").alias("_m"), F.xxhash64("_k").alias("_h"))
    return rows.join(least, (F.col(node) == F.col("_k")) & (F.xxhash64(node) == F.col("_h")))


def _state(edges: DataFrame) -> tuple:
    mark: Column = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(mark.bitwiseAND(0x7FFFFFFF)), F.sum(F.shiftrightunsigned(mark, 32))).first())


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """``node, component`` for every node that has an edge to another; the component is its smallest node.

    Edges may repeat, run either way or join a node to itself; rows with a null end are ignored. An empty table gives
    none. Each round is written to the shared folder, so the lineage stays short.
    """
    edges = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"), F.col(left).alias("_l"), F.col(right).alias("_r"))
    edges = edges.where(F.col("_l").isNotNull() & F.col("_r").isNotNull() & (F.col("u") != F.col("v"))).select("u", "v").distinct()
    edges = written(edges, "edges")
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        joined = _with_least(large, "u", "v")
        small = joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("_m").alias("v")), F.struct(F.col("v").alias("u"), F.col("_m").alias("v")))).alias("e"))
        last, edges = edges, written(small.select("e.u", "e.v").where("u != v").distinct(), "edges")
        forget(last)
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
