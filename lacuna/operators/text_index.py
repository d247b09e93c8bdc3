"""BM25 for many queries over a partitioned inverted index with block maxima.

The index is written once, for all terms or those of the queries to come: postings (term, chunk, impact) sorted by term and falling impact over ranges of rows, so a term that stands in every chunk is spread over
tasks like any other, and blocks of up to ``BLOCK`` postings with the largest impact of each.  Impacts are what a term adds to a chunk's score but for
its weight in the query.  Postings and blocks are partitioned by the term's hash; a search reads only its terms' partitions.

A search goes in three joins.  The first block of each of a query's terms gives partial scores, and the k-th of them a score that the answer's last
place cannot fall below.  Of the query's terms, those that together stay below it cannot bring a chunk into the answer alone; the blocks of the others
are read if their largest impact, with the most that the other terms may add, reaches it.  The chunks found there, and no others, are scored in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.scratch import kept

#: Postings in a block; partitions of the index by term.
BLOCK, PARTS = 128, 32


def _words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{3,})"), F.lit(1))


def _blocks(parts: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Blocks of neighbouring postings of one term, whose impacts fall; ``first`` marks a term's first block in its task."""
    last = None
    for p in parts:
        terms, cuts = p["term"].to_numpy(), []
        edges = np.append(np.flatnonzero(np.append(True, terms[1:] != terms[:-1])), len(terms))
        for i, j in zip(edges, edges[1:], strict=False):
            cuts += [(k, min(k + size, j)) for k in range(i, j, size)]
        papers, chunks, impacts, part = (p[c].tolist() for c in ("paper_id", "chunk_id", "impact", "part"))
        rows = []
        for i, j in cuts:
            rows.append((part[i], terms[i], impacts[i], terms[i] != last, papers[i:j], chunks[i:j], impacts[i:j]))
            last = terms[i]
        yield pd.DataFrame(rows, columns=["part", "term", "most", "first", "paper_ids", "chunk_ids", "impacts"])


@dataclass
class Index:
    """Tables of an index: postings, blocks, terms (df, most, first block), and the chunks' number and order."""

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    chunks: DataFrame
    n: int

    @classmethod
    def build(cls, chunks: DataFrame, k1: float = 1.5, b: float = 0.75, block: int = BLOCK, asked: DataFrame | None = None) -> Index:
        """The index of chunks (paper_id, chunk_id, text).

        For one set of queries ``asked`` (text), only their terms are posted: a search for them reads no others, and number and mean length are those of all chunks.
        """
        kinds = dict(chunks.dtypes)
        split = chunks.select("paper_id", "chunk_id", F.coalesce(_words(), F.array().cast("array<string>")).alias("w"))
        split = kept(split.withColumn("dl", F.size("w").cast("long")), "words")
        sizes = split.select("paper_id", "chunk_id", "dl")
        n, mean = sizes.agg(F.count(F.lit(1)), F.avg("dl")).first()
        each = split.select("paper_id", "chunk_id", "dl", F.explode("w").alias("term"))
        if asked is not None:
            each = each.join(kept(asked.select(F.explode(_words()).alias("term")).distinct(), "asked_terms"), "term", "left_semi")
        counts = each.groupBy("paper_id", "chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
        impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / max(mean or 0.0, 1.0)))
        rows = counts.select(F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int").alias("part"), "term", "paper_id", "chunk_id", impact.alias("impact"))
        postings = kept(rows, "postings", "part")
        order = ["part", "term", F.desc("impact"), "paper_id", "chunk_id"]
        cut = postings.repartitionByRange(*order).sortWithinPartitions(*order)
        lists = f"paper_ids array<{kinds['paper_id']}>, chunk_ids array<{kinds['chunk_id']}>, impacts array<double>"
        blocks = kept(cut.mapInPandas(lambda parts: _blocks(parts, block), f"part int, term string, most double, first boolean, {lists}"), "blocks", "part")
        df = postings.groupBy("part", "term").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("most"))
        return cls(postings, blocks, kept(df, "terms", "part"), sizes.select("paper_id", "chunk_id"), n)

    def weighted(self, queries: DataFrame) -> DataFrame:
        """(qid, term, part, w, top, rest): a query's terms that the index has, their weights, the most each may add, and the most the others may."""
        asked = queries.select("qid", F.explode(_words()).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("q"))
        asked = asked.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")).join(self.terms, ["part", "term"])
        w = F.col("q") * F.log(1 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        own = asked.withColumn("w", w).withColumn("top", F.col("w") * F.col("most"))
        return own.withColumn("rest", F.sum("top").over(Window.partitionBy("qid")) - F.col("top")).select("qid", "term", "part", "w", "top", "rest")

    def floors(self, asked: DataFrame, k: int, per_paper: int) -> DataFrame:
        """(qid, floor): the k-th partial score by the terms' first blocks; 0 where there are fewer."""
        seen = asked.join(self.blocks.where("first"), ["part", "term"])
        flat = seen.select("qid", "w", F.explode(F.arrays_zip("paper_ids", "chunk_ids", "impacts")).alias("e"))
        some = flat.groupBy("qid", F.col("e.paper_ids").alias("paper_id"), F.col("e.chunk_ids").alias("chunk_id")).agg(F.sum(F.col("w") * F.col("e.impacts")).alias("score"))
        kth = capped(some, k, per_paper).where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
        return asked.select("qid").distinct().join(kth, "qid", "left").select("qid", F.coalesce("floor", F.lit(0.0)).alias("floor"))

    def candidates(self, asked: DataFrame, floors: DataFrame) -> DataFrame:
        """Blocks (qid, ...) in which a chunk of the answer may stand: of terms that are not among the least ones, which stay below the floor together."""
        together = F.sum("top").over(Window.partitionBy("qid").orderBy("top", "term"))
        able = asked.withColumn("together", together).join(floors, "qid").where(F.col("together") >= F.col("floor") - 1e-8)
        return able.join(self.blocks.withColumnRenamed("most", "here"), ["part", "term"]).where(F.col("w") * F.col("here") + F.col("rest") >= F.col("floor") - 1e-8)

    def search(self, queries: DataFrame, k: int, per_paper: int = 3) -> DataFrame:
        """(qid, paper_id, chunk_id, score): the k best chunks of every query (qid, text), ``per_paper`` of a paper at most; the first k chunks for queries that match nothing."""
        asked = kept(self.weighted(queries), "asked")
        found = self.candidates(asked, kept(self.floors(asked, k, per_paper), "floors"))
        pairs = found.select("qid", F.explode(F.arrays_zip("paper_ids", "chunk_ids")).alias("e")).select("qid", F.col("e.paper_ids").alias("paper_id"), F.col("e.chunk_ids").alias("chunk_id")).distinct()
        each = pairs.join(asked.select("qid", "part", "term", "w"), "qid")
        scored = each.join(self.postings, ["part", "term", "paper_id", "chunk_id"]).groupBy("qid", "paper_id", "chunk_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))
        best = capped(scored.where("score > 0"), k, per_paper).drop("rank")
        first = self.chunks.orderBy("paper_id", "chunk_id").limit(k)
        plain = first.withColumn("score", 1.0 / F.row_number().over(Window.orderBy("paper_id", "chunk_id")))  # k rows
        unmatched = queries.select("qid").distinct().join(asked.select("qid").distinct(), "qid", "left_anti")
        out = best.unionByName(unmatched.crossJoin(F.broadcast(plain)))
        return out.withColumn("score", F.round("score", 6))


def capped(scored: DataFrame, k: int, per_paper: int) -> DataFrame:
    """The best ``k`` rows of every query with their rank, ``per_paper`` of a paper at most."""
    order: list[Column] = [F.desc("score"), F.asc("chunk_id")]
    scored = scored.withColumn("score", F.round("score", 9))  # sums in another order may differ in the last places
    few = scored.withColumn("_p", F.row_number().over(Window.partitionBy("qid", "paper_id").orderBy(*order))).where(F.col("_p") <= per_paper).drop("_p")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "paper_id", "chunk_id"))
    return few.withColumn("rank", rank).where(F.col("rank") <= k)
