"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def forest(pairs) -> list[tuple[int, int]]:
    """Of some links those that join what the earlier ones have not joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def _least(edges: DataFrame) -> DataFrame:
    """Each ``u``'s links with ``m``, the least of u and the nodes it links to.

    The least are written first, so that the join stands between two plain
    shuffles and Spark may split a root's links.
    """
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hit = _least(down)
    return hit.select("u", F.col("m").alias("v")).unionByName(hit.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every linked node; the root is the component's smallest node.

    Links are turned to ever smaller neighbours, in alternating large and
    small star steps, until nothing changes.  A node's links are only
    counted and joined, never gathered, and each round is written to the
    shared folder.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if tuple(now) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = tuple(now)
        edges = materialize(_small_star(_large_star(edges)))
