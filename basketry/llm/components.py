"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import materialize


def _with_least(pairs: DataFrame) -> DataFrame:
    """Every (u, v) with the least of u and all its v. The minima are pre-aggregated; a hot u is one row on that side."""
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _with_least(down)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(moved.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the least node of its component.

    Null ends, loops and repeated edges are ignored. Each round is a written table, so a lost executor costs one round.
    """
    edges = materialize(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    state = None
    while state != (now := _state(edges)):
        state = now
        edges = materialize(_small_star(_large_star(edges).distinct()).filter("u <> v").distinct(), "edges")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
