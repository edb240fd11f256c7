"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so a vertex of any degree is one
aggregate row and its edges stay spread over tasks.  Every round is written to
the checkpoint folder, which cuts the lineage.
"""

from __future__ import annotations

import gc
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.session import cut_lineage


#: Edges of a task: a round is dealt to as many tasks as its edges ask for.
EDGES_PER_TASK = 100_000


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more:
    its cleaner acts when the driver collects garbage, which a driver with
    little to do may put off for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """``pairs`` (u, v): link u's neighbours to the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = pairs.join(least, "u")
    if large:
        return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
    own = least.select("u", F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).filter("u != v").distinct()


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """Return (node, root) for every vertex of ``edges`` that isn't its component's least vertex.

    Nulls and self-links are ignored; an empty edge table gives an empty result.
    The rounds end when a round changes no edge: every vertex then points at
    its root.
    """
    state = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    e = cut_lineage(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u != v").distinct())
    before = state(e)
    while before.n:
        tasks = math.ceil(before.n / EDGES_PER_TASK)
        e = _star(_both(e.coalesce(tasks)), True).coalesce(tasks)
        e = cut_lineage(_star(e, False).coalesce(tasks))
        now = state(e)
        if now == before:
            break
        before = now
    release_shuffles(e.sparkSession)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
