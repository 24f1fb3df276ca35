"""Connected components of an undirected graph, as DataFrame rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.session import cut

#: Edges of one node that meet in one task, at most, unless no node can have so many.
HUB_EDGES = 1 << 22


def local_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Component of each of ``n`` nodes under the links (u, v): the least node number in it."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours; one partial aggregate."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _beside_min(edges: DataFrame, total: int, hub_edges: int) -> DataFrame:
    """``edges``, of which there are at most ``total``, each with the ``m`` of its ``u``.

    Of more edges than a hub has, those of hubs stay where they are: at most 1024 nodes can
    be hubs, and their least neighbours are broadcast. Fewer edges simply meet by ``u``.
    """
    if total < hub_edges:
        return edges.join(_min_neighbour(edges), "u")
    bar = max(hub_edges, -(-total // 1024))
    least = cut(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("k")))
    hubs = F.broadcast(least.where(F.col("k") >= bar).drop("k"))
    rest = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.where(F.col("k") < bar).drop("k"), "u")
    return edges.join(hubs, "u").unionByName(rest)


def _state(e: DataFrame):
    return e.agg(F.count("*").alias("n"), F.sum("v").cast("string").alias("s"), F.sum(F.xxhash64("u", "v") % 1000003).alias("h")).first()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60, hub_edges: int = HUB_EDGES) -> DataFrame:
    """Component (least node id reached) of every node that has an edge.

    ``edges`` holds 64-bit ids in two columns; direction, repeats and self loops
    don't matter, null ends are ignored. Returns ``(node, component)``. Alternating
    large-star and small-star rounds: each is two shuffles of the edge list, whose
    length never grows, and the number of rounds grows with the logarithm of the
    component size, not with its diameter. In a giant component nearly every edge comes
    to have the same end: edges of nodes with ``hub_edges`` or more are not brought together.
    Isolated nodes belong to the caller: left-join and coalesce with the node itself.
    Raises after ``max_rounds``.
    """
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = _state(e)
    for _ in range(max_rounds):
        both = e.where("u <> v")
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _beside_min(both, 2 * last.n, hub_edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        loops = e.where("u = v")
        large = large.unionByName(loops).distinct()
        down = large.where("u <> v")
        small = _beside_min(down, 2 * last.n, hub_edges).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).unionByName(loops)
        e = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = _state(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
