"""Profile-conditioned corpora: seeds merged with retrieved records, and how well a gap is backed by seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.text import bounded
from lacuna.scratch import ranked


def merged_corpus(seeds: DataFrame, retrieved: DataFrame, key: str, total: int) -> DataFrame:
    """All seeds, then retrieved rows by rank up to ``total`` rows; rows in both carry both provenances.

    The cap ranks within the top ``total`` retrieved rows only, which a limit cuts before any window.
    """
    both = seeds.select(key, F.lit(0).alias("rank"), F.lit("seed").alias("p")).unionByName(retrieved.select(key, "rank", F.lit("retrieved").alias("p")))
    by = both.groupBy(key).agg(F.min("rank").alias("rank"), F.sort_array(F.collect_set("p"), asc=False).alias("provenance"))
    kept = by.where(F.array_contains("provenance", "seed"))
    n = kept.count()
    more = by.where(~F.array_contains("provenance", "seed")).orderBy("rank", key).limit(max(0, total - n))
    return kept.unionByName(more)


def alignment(gaps: DataFrame, seeds: DataFrame) -> DataFrame:
    """Share of every gap's papers (gap_id, paper_ids) that are seeds (paper_id)."""
    rows = gaps.select("gap_id", F.explode_outer("paper_ids").alias("paper_id"))
    known = seeds.select("paper_id").distinct().withColumn("hit", F.lit(1))
    return rows.join(known, "paper_id", "left").groupBy("gap_id").agg(
        F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.greatest(F.count("paper_id"), F.lit(1)), 6).alias("alignment")
    )


def blended(rows: DataFrame) -> DataFrame:
    """Personalised score and both ranks of (id, overall, alignment, survival, novelty)."""
    c = F.col
    score = bounded(0.35 * c("overall") + 0.30 * c("alignment") + 0.20 * c("survival") + 0.15 * c("novelty"))
    rows = ranked(rows.withColumn("personal", F.round(score, 6)), [F.desc("overall"), F.col("id")], "original_rank")
    return ranked(rows, [F.desc("personal"), F.col("id")], "personal_rank")
