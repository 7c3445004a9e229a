"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import dropped, released, saved


def _star(edges: DataFrame) -> DataFrame:
    """Each node's neighbours with the smallest among them and itself; minima are summed up before the join."""
    low = edges.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "of")
    return edges.join(low, F.col("a") == F.col("of")).select("a", "b", F.least("low", "a").alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node of an edge (a, b: long, not null).

    Rounds of large star and small star: links move to ever smaller nodes until each node hangs
    on its component's smallest. No round gathers a node's neighbours in one place; each is written
    to the shared folder, so a lost executor costs one round.
    """
    spark = edges.sparkSession
    edges = saved(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", few="coalesce")
    state = lambda e: e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        low = _star(large.distinct())  # every edge points down
        small = low.select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        after_edges = saved(small, "edges", 2 * before[0])
        after = state(after_edges)
        dropped(spark, edges)
        released(spark)
        edges = after_edges
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
