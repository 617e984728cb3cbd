"""Keyed lookups without hot tasks, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import discard, materialise


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, salts: int = 16) -> DataFrame:
    """left LEFT JOIN right on keys, where right has one row per key and one key may hold any share of left.

    Each row of left goes to one of `salts` copies of its key, chosen by a hash of `spread` (so a retried task makes the
    same choice), and right is repeated once per salt.  right should hold small rows.
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


def _are_stars(edges: DataFrame) -> bool:
    """Whether of different edges (u, v), u > v, each u has one and is no other's v."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    found = ends.agg(F.max((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()[0]
    return not found


def components(edges: DataFrame, salts: int = 8, most_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (u long, v long): rows (node, component), component the least node,
    which has no row itself.

    Alternates large-star and small-star steps; each step takes a least neighbour per node (pre-aggregated before its
    shuffle) and joins it back under salts, so a hub may hold any share of the edges.  Each round is written to the shared
    folder.  Nodes without an edge to another node are absent; null ends are ignored.  Raises if it hasn't settled in
    `most_rounds` rounds (each round at least halves the distance to the least node in practice).  Edges that are stars around
    their least nodes are settled, so they cost no round.
    """
    edges = materialise(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    for _ in range(most_rounds):
        if _are_stars(edges):
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out.written = edges.written
            return out
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            salted_left_join(both.where("v > u"), least, ["u"], F.col("v"), salts)
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .unionByName(least.select("u", F.col("m").alias("v")).where("u != v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            salted_left_join(large, least, ["u"], F.col("v"), salts)
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        last, edges = edges, materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        discard(last)
    raise RuntimeError("the components have not settled")
