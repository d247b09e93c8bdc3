"""Counterevidence: pairs of gaps and resolution records, scored and ranked; corpus status and novelty deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.text import bounded, jaccard
from lacuna.operators import topk

# Change of the novelty score by class, and the classes kept.
NOVELTY_DELTA = {"novel": 0.15, "known_open": 0.05, "known_solved": -0.20, "trivial": -0.30, "solved_in_corpus": -0.30, "partially_addressed": -0.05}
NOVELTY_KEPT = ("novel", "known_open", "partially_addressed")

#: Frequent tokens that are broadcast at most; more are joined by a shuffle.
FREQUENT = 100_000
#: Scores at which the search for pairs pauses, to see which gaps have enough.
LEVELS = (0.7, 0.45, 0.3)


def candidates(gaps: DataFrame, records: DataFrame, frequent: DataFrame, minimum: float = 0.20, per_gap: int = 20) -> DataFrame:
    """(gap_id, record_id, score, rank) over gaps (gap_id, paper_id, tokens) and records (record_id, paper_id, tokens).

    Score: Jaccard similarity, 0.1 for another paper and -0.1 for the same, 0.1 if two common tokens are among the frequent ones (a bounded
    table of (t)).  Pairs need a shared token, as without one the score stays under the minimum; a top-k join meets them, bounds first.
    """
    if minimum <= 0.2 - 1e-9:
        raise ValueError("pairs that share no token may score up to 0.2")
    g = gaps.select("gap_id", F.col("paper_id").alias("gp"), F.col("tokens").alias("gt"))
    r = records.select("record_id", F.col("paper_id").alias("rp"), F.col("tokens").alias("rt"))
    few = frequent.limit(FREQUENT + 1).count() <= FREQUENT
    marked = frequent.select("t", F.lit(1).alias("hot"))

    def scores(pairs: DataFrame) -> DataFrame:
        both = pairs.join(g, F.col("a") == F.col("gap_id")).join(r, F.col("b") == F.col("record_id"))
        common = both.select("a", "b", F.explode(F.array_intersect("gt", "rt")).alias("t")).join(F.broadcast(marked) if few else marked, "t")
        hot = common.groupBy("a", "b").agg(F.sum("hot").alias("hot"))
        score = jaccard("gt", "rt") + F.when(F.col("gp") == F.col("rp"), -0.1).otherwise(0.1) + F.when(F.col("hot") >= 2, 0.1).otherwise(0.0)
        return both.join(hot, ["a", "b"], "left").select("a", "b", F.round(F.least(F.lit(1.0), score), 6).alias("score"))

    left, right = topk.places(g.select(F.col("gap_id").alias("a"), F.array_distinct("gt").alias("tokens")), r.select(F.col("record_id").alias("b"), F.array_distinct("rt").alias("tokens")))
    levels = tuple(x for x in LEVELS if x > minimum) + (minimum,)
    found = topk.rising(left, right, scores, lambda o: F.when(o >= 2, 0.2).otherwise(0.1), levels, per_gap)
    scored = found.select(F.col("a").alias("gap_id"), F.col("b").alias("record_id"), "score").where(F.col("score") >= minimum)
    by = Window.partitionBy("gap_id").orderBy(F.desc("score"), "record_id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= per_gap)


def corpus_status(verdicts: DataFrame) -> DataFrame:
    """Per gap over (gap_id, label, relation, scope, confidence): solved, partial or open."""
    c, full = F.col("confidence"), F.col("scope") == "full"
    solved = ((F.col("label") == "fully_addresses") | (F.col("relation") == "counterevidence_for")) & full & (c >= 0.80)
    partial = (c >= 0.60) & ((F.col("label") == "partially_addresses") | ((F.col("label") == "fully_addresses") & ~full) | F.col("scope").isin("partial", "mismatch"))
    best = F.max(F.when(solved, 2).when(partial, 1).otherwise(0))
    return verdicts.groupBy("gap_id").agg(F.when(best == 2, "solved_in_corpus").when(best == 1, "partially_addressed").otherwise("open").alias("status"))


def novelty_filtered(gaps: DataFrame, classes: DataFrame) -> DataFrame:
    """Gaps of the kept classes with their novelty score moved by the class; gaps without a class count as novel."""
    table = F.create_map(*[F.lit(x) for kv in NOVELTY_DELTA.items() for x in kv])
    rows = gaps.join(classes, "gap_id", "left").withColumn("novelty_class", F.coalesce("novelty_class", F.lit("novel")))
    moved = bounded(F.col("novelty_score") + F.coalesce(F.try_element_at(table, F.col("novelty_class")), F.lit(0.0)))
    return rows.withColumn("novelty_score", F.round(moved, 6)).where(F.col("novelty_class").isin(*NOVELTY_KEPT))
