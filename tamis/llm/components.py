"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: distinct (u, v) with u > v. Large: each node gives its larger neighbours to its smallest one; small: its smaller or equal ones."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = both.join(least, "u")
    if large:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of edges (u, v: long); root is the smallest node that can be reached.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one round at most.
    """
    spark = edges.sparkSession
    now = table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        after = table(_star(_star(now, True), False))
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(spark, now)
        now = after
        if sums == before:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
        before = sums
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
