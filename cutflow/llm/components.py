"""Connected components over an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import parts_for, remove_staged, staged

EDGES = 16384  # edges for a task; rounds over few of them don't deal them out to all shuffle partitions


def _star(both: DataFrame) -> DataFrame:
    """Adds to every (u, v) the smallest of u and its neighbours. The minimum is pre-aggregated before the shuffle,
    and the join back leaves a hub's rows to skew-join splitting, so no node's neighbours meet in one task."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) -> (node, component): component is the smallest node reachable.

    Nodes may be of any type with an order. Nodes without an edge do not appear. Self loops, repeated and reversed edges and nulls are harmless. Every round is
    written to the shared folder, so lineage stays short and a lost executor costs one round; the round before it is
    deleted then. Rounds grow with the logarithm of the longest path; only one number per round reaches the driver. Raises if max_rounds don't settle it.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u"))
    e = staged(e.distinct(), "edges")
    parts, before = parts_for(e, EDGES), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(parts).distinct().coalesce(parts)
        # Every row of large points from a node down to a smaller one.
        small = _star(large).coalesce(parts)
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        last, e = e, staged(after.where("u <> v").distinct(), "edges", parts=parts)
        remove_staged(last)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = now
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
