"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
    return joined.select("e.u", "e.v").where("u <> v").distinct()


def connected_components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v), a component being named by its least node.

    Self-loops and repeated edges are harmless; no edges give no rows.  Each round ends in a table of the shared folder; hub
    nodes only pass minima and pairs, never lists of their neighbours.
    """

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = tables.write(edges.where("u <> v").select("u", "v").distinct(), "edges")
    mark = sign(now)
    while mark[0]:
        after = tables.write(_small_star(_large_star(now)), "edges")
        tables.drop(now)
        now, before, mark = after, mark, sign(after)
        if mark == before:
            break
    least = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return least.unionByName(least.select(F.col("component").alias("node"), "component").distinct())
