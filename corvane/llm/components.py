"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation and one join on the edge table; edges never meet
in one task, and every round is settled in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.llm.store import discard, settle_at


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).select("u", F.least("low", "u").alias("low"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; a component is named by its smallest node.

    Self-links and repeated links are harmless; null ends are ignored. The
    number of rounds grows with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    now, uri = settle_at(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        after, after_uri = settle_at(_small_star(_large_star(now)), "edges")
        discard(spark, uri)
        now, uri = after, after_uri
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
