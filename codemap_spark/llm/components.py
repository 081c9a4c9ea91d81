"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codemap_spark.llm.scratch import materialize

#: Rounds double the distance that labels travel, so this limits nothing in practice.
MOST_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step on edges (u > v)."""
    near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # The minimum is aggregated before the shuffle; the join back lets AQE split a hub's rows.
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m") if large else F.col("m"))
    joined = near.join(low, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with the smallest reachable node, for every node of an edge.

    Alternates large-star and small-star steps until the edges stay the same;
    each step's edges are a table in the shared folder.
    """
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialize(spark, edges, "edges")
    mark = None
    for _ in range(MOST_ROUNDS):
        edges = materialize(spark, _stars(_stars(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
