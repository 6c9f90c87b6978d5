"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, meet, passing


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("many")).select("u", F.least("u", "m").alias("m"), "many"))
    return meet(both, least, "u", "many").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = cut(down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("many")))
    moved = meet(down, least, "u", "many").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) -> (node, component): the smallest node reachable, for all nodes that have an edge.

    Every round is written to the shared folder; edges shrink to stars, after which a round changes nothing.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        with passing() as stay:
            before, now = now, cut(_small_star(cut(_large_star(now))))
            stay.append(now)
        discard(before)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def roots(forest: DataFrame) -> DataFrame:
    """(node, parent), one parent a node -> (node, root) for all nodes that have a parent, by pointer jumping: a join a round."""
    now, written = forest, None
    while True:
        up = now.select(F.col("node").alias("p"), F.col("parent").alias("above"))
        before, written = written, cut(now.join(up, now["parent"] == up["p"], "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
        if before is not None:
            discard(before)
        if written.filter("moved").isEmpty():
            return written.select("node", F.col("parent").alias("root"))
        now = written.select("node", "parent")
