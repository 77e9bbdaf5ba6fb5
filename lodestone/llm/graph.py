"""Connected components of a link table, by star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.storage import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for every id in links(a, b); links without nulls, in any direction.

    Every round hangs each node's larger neighbours under the smallest one (large star), then its smaller ones
    (small star), until nothing changes. Minima are pre-aggregated; the joins back to the links may be split when skewed.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = materialise(edges, "edges", free=False)
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(lowest, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small, "edges", free=False)
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one edge and no v is a u."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()
