"""Connected components with DataFrame operations only.

Large-star and small-star rounds (Kiveris et al., 2014) hang every node directly
under the smallest node of its component in a logarithmic number of rounds.  A
round groups by node with map-side minima, so that a hub of a third of all edges
becomes one row per task before the shuffle; the join that hands the minimum back
to the hub's edges is a plain equi-join of two written tables, which adaptive
execution splits where a hub is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b), any order and repeats allowed -> (node, component), component the smallest node; nodes with no edge to another node are absent.

    Null ends and loops are ignored; no edges give no rows.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # Large star: each neighbour above u goes under the smallest of u's neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = scratch.save(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # Small star: u and its smaller neighbours go under the smallest of them.
        least2 = scratch.save(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")))
        moved = large.join(least2.where("k > 1"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.save(moved.unionByName(least2.select("u", F.col("m").alias("v"))).distinct())
        # Stars already: every u has one v, and no v is itself a u.
        left = least2.where("k > 1").limit(1).count() or small.join(small.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        scratch.drop(now, least, large, least2)
        now = small
        if not left:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
