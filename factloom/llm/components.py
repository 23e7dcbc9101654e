"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import attach, written

#: If no node has more edges, a round is two windows over the edges by node: its plan stays small, and the driver with it.
MOST_EDGES = 100_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = _both(edges)
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("held")), "least")
    return attach(both.where("v > u"), least, ["u"], "held", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("held")), "least")
    linked = attach(down, least, ["u"], "held", total).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(linked).distinct()


def _both_stars(edges: DataFrame) -> DataFrame:
    """A large star, then a small one, of edges with u > v: each node has its edges in one task. The first makes no node's edges down more."""
    least = F.min("v").over(Window.partitionBy("u"))
    large = _both(edges).withColumn("m", F.least(least, F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return large.withColumn("m", least).select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple[int, int, int]:
    """The number of edges, their hash and the most edges of one node."""
    u, v = F.col("u"), F.col("v")
    ends = edges.select(F.inline(F.array(F.struct(u.alias("node"), F.pmod(F.xxhash64(u, v), F.lit(2**31)).alias("hash")), F.struct(v.alias("node"), F.lit(0).cast("long").alias("hash")))))
    nodes = ends.groupBy("node").agg(F.count("*").alias("held"), F.sum("hash").alias("hash"))
    row = nodes.agg(F.sum("held"), F.sum("hash"), F.max("held")).first()
    return (row[0] or 0) // 2, row[1] or 0, row[2] or 0


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges between long ids to (node, component): the least id that can be reached.

    Nodes without an edge to another are not listed; loops and repeated edges are ignored. The edges of each
    round are a table in the shared folder, so no lineage builds up and lost executors cost one round.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        total, _, most = mark
        stars = _both_stars(now) if most <= MOST_EDGES else _small_star(written(_large_star(now, total), "large"), total)
        now = written(stars, "edges")
        after = _mark(now)
        if after == mark:
            break
        mark = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
