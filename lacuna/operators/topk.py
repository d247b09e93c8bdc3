"""Top-k set-similarity join: for each set on the left, the k sets on the right with the largest Jaccard similarity plus a bounded bonus.

Tokens are ordered rarest first.  A pair whose first common token stands at place p of n and s of m has o = min(n - p, m - s) common tokens at most, so
its similarity is o / (n + m - o) at most.  Pairs are met level by level, from high bounds to low ones: a level joins only tokens whose places
allow it, and only for sets that do not have k pairs above it yet.  The k-th score of a set rises from level to level, and once it reaches the level
no unseen pair can be among its k.  A token that all sets have stands last in all of them and is met only by sets so short that it alone may suffice.

Hot tokens are dealt out: the right side's rows of a token are split into shares, each met by a copy of the left side's few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.scratch import kept

#: Rows of one token on the right that meet in one share.
SHARE = 20_000


def places(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, n, p, t, shares) and (b, m, s, t, share) of rows (a, tokens) and (b, tokens): sizes, places from 0 rarest first; tokens of one side only take the first places."""
    one = kept(left.select("a", F.size("tokens").alias("n"), F.explode(F.transform("tokens", lambda t: F.xxhash64(t))).alias("t")), "left")
    two = kept(right.select("b", F.size("tokens").alias("m"), F.explode(F.transform("tokens", lambda t: F.xxhash64(t))).alias("t")), "right")
    df = kept(two.groupBy("t").agg(F.count(F.lit(1)).alias("df")).join(one.select("t").distinct(), "t"), "df")

    def placed(rows: DataFrame, key: str, size: str, place: str) -> DataFrame:
        lists = rows.join(df, "t").groupBy(key, size).agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("o"))
        return lists.select(key, size, F.posexplode("o").alias("i", "x"), F.size("o").alias("met")).select(key, size, (F.col(size) - F.col("met") + F.col("i")).alias(place), "x.t", "x.df")

    shares = F.ceil(F.col("df") / SHARE).cast("int")
    a = placed(one, "a", "n", "p").withColumn("shares", shares).drop("df")
    b = placed(two, "b", "m", "s").withColumn("share", F.pmod(F.xxhash64("b"), shares).cast("int")).drop("df")
    return kept(a, "places"), kept(b, "places")


def rising(left: DataFrame, right: DataFrame, score: Callable[[DataFrame], DataFrame], bonus: Callable[[Column], Column], levels: tuple[float, ...], k: int, start: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Scored pairs (a, b, score, ...) that hold the best ``k`` of every a among those with at least the last level's score.

    ``left`` and ``right`` come from :func:`places`; ``score`` scores pairs (a, b); ``bonus`` bounds what a score adds to the similarity of a pair with so many common
    tokens at most; ``start`` holds pairs that are scored already, among them all whose score may exceed that bound; ``weights`` (b, w) says for how many sets a b stands.
    """
    found, above = start, None
    o = F.least(F.col("n") - F.col("p"), F.col("m") - F.col("s"))
    bound = o / (F.col("n") + F.col("m") - o) + bonus(o)
    for level in levels:
        active = left
        if found is not None and above is not None:
            enough = found.where(F.col("score") >= above).select("a", "b")
            enough = enough.withColumn("w", F.lit(1)) if weights is None else enough.join(weights, "b")
            done = enough.groupBy("a").agg(F.sum("w").alias("w")).where(F.col("w") >= k).select("a")
            active = left.join(done, "a", "left_anti")
        near = active.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        met = near.join(right, ["t", "share"]).where(bound >= level - 1e-9).select("a", "b").distinct()
        if found is not None:
            met = met.join(found.select("a", "b"), ["a", "b"], "left_anti")
        scored = score(met)
        found = kept(scored if found is None else found.unionByName(scored), "scored")
        above = level
    return found
