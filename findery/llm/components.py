"""Connected components of an edge table by alternating large and small stars.

Each round points every node to the smallest node it can see; the edges stay a table in the shared folder
and never reach the driver. Stars of any size are aggregated with map-side combine and joined by
sort-merge joins, which AQE may split at a hot node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v): u's neighbours point to the smallest of them and u."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.col("c")).alias("m"))
    near = both.where("v > u") if large else both
    moved = near.join(least.hint("merge"), F.col("u") == F.col("c")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.union(least.select(F.col("c").alias("a"), F.col("m").alias("b")))
    moved = moved.where("a <> b")
    return moved.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge that is not its component's smallest."""
    spark = edges.sparkSession
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        after = materialise(_star(_star(now, True), False), "edges")
        print_of = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        discard(now)
        now = after
        if tuple(print_of) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(print_of)
