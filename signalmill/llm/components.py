"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.llm.common import release, stored


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node) with the same components as the edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = label != np.arange(len(nodes))
    return nodes[out], nodes[label[out]]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest node.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows.
    Every round is a pair of aggregations and joins whose results go to the shared
    folder, so lineage stays short, and the tables of the round before are deleted. Stars
    are joined with stored minima, which leaves both sides of the join plain exchanges that
    adaptive execution can split when one centre has very many neighbours. The rounds end
    when no edge changes, which makes every component one star; sets of edges are compared
    by their number and two 64-bit hashes of every edge, summed without overflow.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e, before = stored(e.distinct(), "edges"), None
    sums = [F.sum(F.xxhash64(*c).cast("decimal(20,0)")) for c in (("u", "v"), ("v", "u"))]
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        release(low, large, least, e)
        e, now = new, tuple(new.agg(F.count("*"), *sums).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
