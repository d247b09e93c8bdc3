"""Connected components by contraction: every vertex joins the first of its neighbourhood, edges between the joined ones are all that is left.

In a round each vertex takes, of itself and its neighbours, the one that a hash of the round puts first, and what that one takes in turn.  Edges are
renamed to what their ends took; loops and repeats go.  A component keeps its connection and loses a constant share of its vertices every round, so rounds follow the
logarithm of the longest path, edges only ever get fewer, and no number of rounds is set.  Each round's choices stay in a table; composed from the last
round back to the first they lead every vertex to its component.

Hubs cost nothing special: choices are least values, combined before they are shuffled, and names are looked up by broadcast for the few keys that hold
a thousandth of the rows or more (a thousand at most), in a shuffled join for all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.scratch import kept, removed

#: A key is hot from 1/HOT_SHARE of all rows on; by counting, at most HOT_SHARE keys are.
HOT_SHARE = 1000
#: Up to so many rows no key is looked for that holds a large share of them; their join is small either way.
FEW = 200_000


def looked_up(rows: DataFrame, key: str, table: DataFrame, name: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of the row of ``table`` whose ``name`` equals ``key``, null where there is none; ``table`` has one row a name."""
    total = rows.count()
    named = table.select(F.col(name).alias(key), F.col(value).alias(value))
    if total <= FEW:
        return rows.join(named, key, "left")
    hot = kept(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= max(2, -(-total // HOT_SHARE))).select(key), "hot")
    few = F.broadcast(named.join(F.broadcast(hot), key, "left_semi"))  # HOT_SHARE rows at most
    cold = rows.join(F.broadcast(hot), key, "left_anti").join(named, key, "left")
    return rows.join(F.broadcast(hot), key, "left_semi").join(few, key, "left").unionByName(cold)


def _choices(edges: DataFrame, number: int) -> DataFrame:
    """(v, to) for every vertex of both directions of ``edges`` (a, b)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    place = lambda x: F.struct(F.xxhash64(F.lit(number), x).alias("h"), F.col(x).alias("v"))
    first = kept(both.groupBy(F.col("a").alias("v")).agg(F.min(place("b")).alias("near")).select("v", F.least(place("v"), "near")["v"].alias("to")), "first")
    again = looked_up(first, "to", first.select(F.col("v").alias("w"), F.col("to").alias("next")), "w", "next")
    return again.select("v", F.col("next").alias("to"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) for every distinct id of ``nodes``, named by the component's least id; ``links`` (a, b) go either way."""
    edges = kept(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        to = kept(_choices(edges, len(rounds)), "choices")
        rounds.append(to)
        renamed = looked_up(looked_up(edges, "a", to.withColumnRenamed("to", "x"), "v", "x"), "b", to.withColumnRenamed("to", "y"), "v", "y")
        left = kept(renamed.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        removed(edges)
        edges = left
    if not rounds:
        return nodes.select("id", F.col("id").alias("component")).distinct()
    ends = rounds.pop()
    while rounds:
        earlier = rounds.pop()
        ends = kept(looked_up(earlier, "to", ends.select(F.col("v").alias("w"), F.col("to").alias("end")), "w", "end").select("v", F.coalesce("end", "to").alias("to")), "ends")
    least = ends.groupBy("to").agg(F.min("v").alias("least"))
    named = kept(looked_up(ends, "to", least.withColumnRenamed("to", "w"), "w", "least").select(F.col("v").alias("id"), "least"), "named")
    return nodes.select("id").distinct().join(named, "id", "left").select("id", F.coalesce("least", "id").alias("component"))
