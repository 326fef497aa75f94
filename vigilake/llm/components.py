"""Connected components of a graph whose nodes are longs, by rounds of joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): node, component (its smallest reachable node) of every node that has an edge.

    Alternates large-star and small-star: each round hangs neighbours on the smallest one they know, until nothing
    changes. Edges are pre-aggregated; a star's centre is a key of a minimum only, never of a list.
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # larger neighbours to the smallest
        large = large.where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))  # smaller neighbours to the smallest
        new = settle(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "edges")
        sums = lambda d: tuple(d.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
        done = sums(new) == sums(edges)
        edges = new
        if done:
            break
    else:
        raise RuntimeError("the components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
