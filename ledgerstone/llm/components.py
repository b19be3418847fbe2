"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.llm.shared import materialize


def connected_components(links: DataFrame, most: int = 60) -> DataFrame:
    """``node``, ``root`` (least node reachable) for every node of ``links`` (u, v: long) that isn't its own root.

    A hub's neighbours are never gathered: its minimum is an aggregate with
    partial sums, and the join back may be split by AQE. Null ends, loops and
    repeated links are ignored; no links give an empty result.
    """
    edges = materialize(_down(links), "links")
    seen = _mark(edges)
    for _ in range(most):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _down(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = materialize(_down(small), "links")
        now = _mark(edges)
        if now == seen:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {most} steps")


def _down(links: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller end."""
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and hash sum of a set of links: equal marks mean that a step changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
