"""Exact set-similarity joins and entity resolution.

Pairs come from the prefix filter: tokens are ordered, rare ones first, and two sets with a Jaccard similarity of t or more share one of their first
n - ceil(t n) + 1 tokens, behind which either has enough tokens left.  Those whose shapes allow the similarity are then checked on the full sets,
which travel to groups of like sets and not to every pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.contraction import components  # noqa: F401  (part of this module's interface)
from lacuna.operators.vectors import nearest  # noqa: F401  (likewise)
from lacuna.scratch import kept

#: Earlier tokens that a place of a prefix knows; sets of a side of a block of pairs, about; tokens counted at once; cells in which tokens are counted for their order, and cells
#: by which a set's shape counts its own.
WINDOW, SIDE, TOKENS, CELLS, SHAPE = 4, 256, 4096, 1 << 22, 64


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens any two of the sets have in common."""
    own = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    tokens, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    met = df[at] > 1  # the others are in one set only
    own, at = own[met], np.unique(at[met], return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    own, at = own[order], at[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, TOKENS):
        i, j = np.searchsorted(at, (low, low + TOKENS))
        seen = np.zeros((len(sets), min(TOKENS, int(at[-1]) + 1 - low)), np.float32)
        seen[own[i:j], at[i:j] - low] = 1
        out += np.rint(seen @ seen.T).astype(np.int64)
    return out


def _checked(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b), a < b, that reach the threshold on their full sets (id, t).

    A pair is checked in the group of the least id that its lesser end meets, so sets that all resemble one another go to one group, once.  A group of many pairs is
    dealt into blocks of about SIDE sets by SIDE sets, whose number follows the number of its pairs.
    """
    pairs = kept(pairs, "pairs")
    lead = pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("lead"))
    led = kept(pairs.join(lead, "a", "left").select("a", "b", F.coalesce("lead", "a").alias("g")), "led")
    large = led.groupBy("g").agg(F.ceil(F.sqrt(2.0 * F.count(F.lit(1))) / SIDE).cast("int").alias("sides")).where("sides > 1")
    side = lambda x: F.pmod(F.xxhash64(x), F.coalesce("sides", F.lit(1))).cast("int")
    dealt = led.join(large, "g", "left").select("g", F.least(side("a"), side("b")).alias("i"), F.greatest(side("a"), side("b")).alias("j"), "a", "b")
    # groups are small; some of them travel together
    bundles = max(1, classes.count() // SIDE)
    dealt = dealt.withColumn("bundle", F.pmod(F.xxhash64("g", "i", "j"), F.lit(bundles)).cast("int"))
    named = [F.col(k).alias(f"own_{k}") for k in ("bundle", "g", "i", "j")]
    needed = dealt.select(*named, F.explode(F.array("a", "b")).alias("id")).distinct().join(classes.select("id", "t"), "id")
    kind = dict(pairs.dtypes)["a"]

    def check(p: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        rows, own = [], sets.groupby(["own_g", "own_i", "own_j"]).indices
        ids, tokens, ends = sets["id"].to_numpy(), sets["t"].to_numpy(), p[["a", "b"]].to_numpy()
        for key, at in p.groupby(["g", "i", "j"]).indices.items():
            mine = own[key]
            place = {x: i for i, x in enumerate(ids[mine])}
            n, common = np.array([len(t) for t in tokens[mine]]), _overlaps(list(tokens[mine]))
            a, b = (np.array([place[x] for x in side]) for side in ends[at].T)
            found = common[a, b] / (n[a] + n[b] - common[a, b])
            rows += [(*ends[at[k]], found[k]) for k in np.flatnonzero(found >= threshold)]
        return pd.DataFrame(rows, columns=["a", "b", "similarity"])

    return dealt.groupBy("bundle").cogroup(needed.groupBy("own_bundle")).applyInPandas(check, f"a {kind}, b {kind}, similarity double")


def _prefixes(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, n, left, before, t): the prefix tokens of sets (id, n, t), with how many tokens stand from each on, and the WINDOW tokens before it.

    The prefix filter holds for any order of all tokens.  This one follows how many tokens fall into a token's cell, of CELLS: a table of fixed size, so that a set is
    ordered where it lies.  Rare tokens come first but for those that share a cell with a frequent one; a token that has its cell to itself meets no other set.
    """
    counted = rows.select(F.explode("t").alias("t")).groupBy(F.pmod("t", F.lit(CELLS)).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    table = np.zeros(CELLS, np.int32)
    table[counted["cell"].to_numpy()] = np.minimum(counted["n"].to_numpy(), 2**31 - 1)
    shared = rows.sparkSession.sparkContext.broadcast(table)
    cells, window = CELLS, WINDOW

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = shared.value
        for p in batches:
            out = []
            for own, n, t in zip(p["id"], p["n"], p["t"], strict=True):
                t = np.asarray(t)
                c = often[t % cells]
                order = np.lexsort((t, c))[: n - math.ceil(threshold * n - 1e-9) + 1]
                first = t[order]
                out += [(own, n, n - i, first[max(0, i - window) : i], first[i]) for i in np.flatnonzero(c[order] > 1).tolist()]
            yield pd.DataFrame(out, columns=["id", "n", "left", "before", "t"])

    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "n", "t").mapInPandas(run, f"id {kind}, n int, left int, before array<bigint>, t bigint")


def _shapes(rows: DataFrame) -> DataFrame:
    """(id, n, shape) of sets (id, n, t): how many tokens fall into each of SHAPE cells; null where a byte does not hold that."""
    cells = SHAPE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            counts = [np.bincount((np.asarray(t) >> 32) % cells, minlength=cells) for t in p["t"]]
            yield pd.DataFrame({"id": p["id"], "n": p["n"], "shape": [c.astype(np.int8) if c.max() < 128 else None for c in counts]})

    return rows.select("id", "n", "t").mapInPandas(run, f"id {dict(rows.dtypes)['id']}, n int, shape array<tinyint>")


def _may_reach(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shapes allow the threshold: two sets have no more of a cell in common than the one with fewer holds."""
    shapes = kept(_shapes(rows), "shapes")
    for k in "ab":
        pairs = pairs.join(shapes.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("shape").alias(f"s{k}")), k)
    most = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda total, x: total + x)
    return pairs.where(F.coalesce(most >= _least_common(threshold), F.lit(True))).select("a", "b")


def _least_common(threshold: float) -> Column:
    """Tokens that sets of ``na`` and ``nb`` tokens need to have in common."""
    return F.ceil(F.lit(threshold) / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9)


def similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of rows (id, tokens) with a < b; equal sets are one class, whose least id stands for it.

    Rows of one class are linked to that id instead of to one another, so links stay linear in a class's size.  Tokens are compared as 64-bit hashes; the sets are
    read once and written, and no token travels but those of prefixes.
    """
    hashed = F.array_sort(F.transform(F.array_distinct("tokens"), lambda t: F.xxhash64(t)))
    rows = kept(sets.select("id", hashed.alias("t")).where(F.size("tokens") > 0).withColumns({"n": F.size("t"), "digest": F.sha2(F.array_join(F.transform("t", lambda x: x.cast("string")), ","), 256)}), "sets")
    least = rows.groupBy("digest").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("copies"))
    copies = kept(rows.select("id", "digest").join(least.where("copies > 1"), "digest").where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("similarity")), "copies")
    prefix = kept(_prefixes(rows, threshold).join(copies.select(F.col("b").alias("id")), "id", "left_anti"), "prefix")
    a, b = (prefix.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("left").alias(f"l{k}"), F.col("before").alias(f"b{k}"), "t") for k in "ab")
    # at a pair's first common token, as many tokens must be left on either side as they need to have in common
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.ceil(F.lit(threshold) * F.greatest("na", "nb") - 1e-9)) & (F.least("la", "lb") >= _least_common(threshold))
    pairs = a.join(b, "t").where(fits & ~F.arrays_overlap("ba", "bb")).select("a", "b").distinct()
    near = _checked(_may_reach(pairs, rows, threshold), rows, threshold)
    return near.unionByName(copies)


def key_links(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Links (a, b) between rows that share a non-empty key of the same kind; each links to the least id of its key."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in keys.items()])
    flat = rows.select("id", F.explode(pairs).alias("p")).where("p.key IS NOT NULL AND p.key <> ''").select("id", "p.kind", "p.key")
    least = flat.groupBy("kind", "key").agg(F.min("id").alias("a"))
    return flat.join(least, ["kind", "key"]).where("id <> a").select("a", F.col("id").alias("b")).distinct()


def merged(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each component of (id, title, abstract, doi, source, citations): unions, longest text, first id, largest count."""
    return rows.join(labels, "id").groupBy("component").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("title", "id").alias("title"),
        F.max_by("abstract", F.struct(F.length("abstract"), (-F.col("id")).alias("first"))).alias("abstract"),
        F.min_by("doi", F.when(F.col("doi") != "", F.col("id"))).alias("doi"),
        F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"),
        F.max(F.coalesce("citations", F.lit(0))).alias("citations"),
    )
