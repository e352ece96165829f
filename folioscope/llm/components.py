"""Connected components of an undirected graph held as a DataFrame of links.

Alternating large-star and small-star steps.  Every step is two aggregations
and a join on the node column; no neighbour list is ever gathered, so a hub is
only a skewed join side, which adaptive execution splits.  Each round is
written to the shared folder, and what reaches the driver is three numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(lowest.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame, left: str, right: str, label: str = "components") -> DataFrame:
    """Rows (node, component): component is the smallest node that can be reached.

    Only nodes with a link to another node appear.  Links to itself, repeated
    links and links with a null end are ignored; no links give no rows.
    """
    spark, written = links.sparkSession, []
    edges = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct()
    edges = materialize(edges, label, written)
    before = None
    while True:
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("u")).first()
        if row[0] == 0 or tuple(row) == before:
            break
        before = tuple(row)
        edges = materialize(_small_star(_large_star(edges).where("u <> v").distinct()).where("u <> v").distinct(), label, written)
        discard(spark, written.pop(0))  # the round before
    # at the fixed point every node points at its component's smallest node
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionAll(roots)
