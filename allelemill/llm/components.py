"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over `edges` (u, v): links to each node's smallest neighbour in place of the links among neighbours."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    moved = near.join(least, near["u"] == least["w"])
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (u, v): root is the smallest node that it reaches.

    Both steps keep at most as many links as there were; the loop ends when they change nothing.
    """
    now, before = stored(edges.where("u != v").select("u", "v").distinct(), "links"), None
    for _ in range(most):
        last, now = now, stored(_stars(_stars(now, True), False), "links")
        dropped(last)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
