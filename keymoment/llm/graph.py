"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, written


#: A hub has more than HUB ends and more than one in HUBS of all, so there are fewer than HUBS of them.
HUB, HUBS = 1000, 500


def _with_lowest(e: DataFrame, ends: int, itself: bool, hub: int) -> DataFrame:
    """e(u, v), of so many rows at most, with m, the smallest v of each u (or u, with itself). The rows of hubs get theirs from a map of
    under HUBS entries where they are, the others by a join."""
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if itself:
        low = low.withColumn("m", F.least("m", "u"))
    most = max(hub, ends // HUBS)
    hubs = {r["u"]: r["m"] for r in low.where(F.col("n") > most).collect()} if ends > most else {}  # under HUBS rows, as their n add up to ends
    if not hubs:
        return e.join(low.select("u", "m"), "u")
    known = F.create_map(*(F.lit(x) for pair in hubs.items() for x in pair))
    of_hub = F.col("u").isin(list(hubs))
    return e.where(~of_hub).join(low.where(F.col("n") <= most).select("u", "m"), "u").select("u", "v", "m").unionAll(e.where(of_hub).select("u", "v", known[F.col("u")].alias("m")))


def components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(node, component) for the nodes of edges (u, v), both long; component is the smallest reachable node.

    Each step is a grouped minimum, which map tasks combine, and an equi-join with it; the rows of hubs get theirs from a
    map of under HUBS entries without a shuffle, so no task gets a hub's edges. Rounds grow with the logarithm of the
    longest path; each ends in a written table. The result reads one such table, which drop() deletes.
    An empty edge table gives an empty result; null ends and loops are ignored.
    """
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    last, ends = None, 2 * e.count()
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_lowest(both, ends, True, hub).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        wide = ends > hub
        if wide:
            large = written(large.distinct(), "edges")
        small = _with_lowest(large, ends, False, hub) if wide else large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        new = written(small.select(pairs.alias("e")).select("e.*").where("u > v").distinct(), "edges")
        state = new.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        drop(e)
        if wide:
            drop(large)
        e, ends = new, 2 * state[0]
        if state == last:
            break
        last = state
    out = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._keymoment_path = e._keymoment_path
    return out


class Forest:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a < b:
            self.up[b] = a
        else:
            self.up[a] = b
        return True


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a star for each component of the edges (u, v): fewer edges, same components."""
    nodes, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = both[: len(u)], both[len(u) :]
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, old, label)
        label = label[label]
        if (label == old).all():
            break
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]
