"""Blinded judging: sanitising, validation, cap rules, unblinding and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def group_stats(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean, sample deviation and standard error of each value, to four places, and the group's size; blank for groups of one."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for v in values:
        sd = F.stddev_samp(v)
        aggs += [F.round(F.avg(v), 4).alias(f"{v}_mean"), F.round(sd, 4).alias(f"{v}_std"), F.round(sd / F.sqrt(F.count(v)), 4).alias(f"{v}_stderr")]
    return rows.groupBy(*keys).agg(*aggs)


def action_counts(rows: DataFrame, key: str, actions: list[str]) -> DataFrame:
    """A column of counts for every action, in the given order, and their sum."""
    return rows.groupBy(key).agg(*[F.count_if(F.col("action") == a).alias(a.lower()) for a in actions], F.count(F.lit(1)).alias("total"))


def unblinded(scores: DataFrame, key: DataFrame) -> DataFrame:
    """Scores with the hidden method of their candidate; unknown candidates get UNKNOWN."""
    return scores.join(key, "candidate_id", "left").withColumn("method", F.coalesce("method", F.lit("UNKNOWN")))


def win_rates(rows: DataFrame) -> DataFrame:
    """Per pool, over rows (pool_a, pool_b, winner): wins, losses, ties, both rates (ties left out; ties as halves).

    CANNOT_JUDGE counts as a comparison only; each side of a pair is a row, so one pass aggregates both.
    """
    sides = rows.select(F.explode(F.array(
        F.struct(F.col("pool_a").alias("pool"), F.lit("A").alias("side"), "winner"), F.struct(F.col("pool_b").alias("pool"), F.lit("B").alias("side"), "winner"),
    )).alias("s")).select("s.*")
    decided = F.col("winner").isin("A", "B")
    by = sides.groupBy("pool").agg(
        F.count(F.lit(1)).alias("comparisons"),
        F.count_if(decided & (F.col("winner") == F.col("side"))).alias("wins"),
        F.count_if(decided & (F.col("winner") != F.col("side"))).alias("losses"),
        F.count_if(F.col("winner") == "TIE").alias("ties"),
        F.count_if(F.col("winner") == "CANNOT_JUDGE").alias("cannot_judge"),
    )
    decisive, scorable = F.col("wins") + F.col("losses"), F.col("wins") + F.col("losses") + F.col("ties")
    return by.withColumns({
        "rate_excluding_ties": F.round(F.try_divide("wins", F.nullif(decisive, F.lit(0))), 4),
        "rate_half_ties": F.round(F.try_divide(F.col("wins") + 0.5 * F.col("ties"), F.nullif(scorable, F.lit(0))), 4),
    })


def mean_ranks(rows: DataFrame) -> DataFrame:
    """Per method and criterion over (domain, criterion, method, rank): n, mean rank, first places, domains."""
    return rows.groupBy("method", "criterion").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("rank"), 4).alias("mean_rank"), F.count_if(F.col("rank") == 1).alias("first_places"),
        F.countDistinct("domain").alias("domains"),
    )


def domain_totals(rows: DataFrame, domain: str, category: str, order: list[str]) -> DataFrame:
    """Counts by domain and category with a TOTAL row; columns in the given order."""
    cols = [F.count_if(F.col(category) == c).alias(c) for c in order]
    return rows.rollup(domain).agg(*cols, F.count(F.lit(1)).alias("total"), F.grouping(domain).alias("_g")).select(
        F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(domain)).alias("domain"), *order, "total"
    )


def ordered_pairs(rows: DataFrame, by: str, order: Column) -> DataFrame:
    """Rows 2i and 2i+1 of every group as a pair (first, second); an odd last row has no second."""
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
    return numbered.groupBy(by, F.floor(F.col("_n") / 2).alias("pair")).agg(
        F.max(F.when(F.col("_n") % 2 == 0, F.col("id"))).alias("first"), F.max(F.when(F.col("_n") % 2 == 1, F.col("id"))).alias("second")
    )


def complete_ranking(rows: DataFrame) -> DataFrame:
    """Per batch (batch, candidate_id, rank, position): whether ranks are 1..n without ties, and not just the input's order."""
    return rows.groupBy("batch").agg(
        ((F.count(F.lit(1)) == F.countDistinct("rank")) & (F.min("rank") == 1) & (F.max("rank") == F.count(F.lit(1)))).alias("complete"),
        F.bool_and(F.col("rank") == F.col("position")).alias("input_order"),
    )


def extraction_quality(rows: DataFrame, expected: int, malformed: int) -> DataFrame:
    """One row over tuples (paper_id, relation): coverage, mean tuples, skew and status PASS, LOW or FAIL."""
    by = rows.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    skew = by.agg(F.count(F.lit(1)).alias("types"), F.max("n").alias("most"), F.sum("n").alias("tuples"))
    papers = rows.agg(F.countDistinct("paper_id").alias("papers"))
    one = skew.crossJoin(F.broadcast(papers))  # one row each
    hard = (
        (F.col("papers") < int(0.9 * expected)) | F.lit(malformed / max(1, expected) > 0.30) | (F.col("types") < 3) | (F.col("most") / F.col("tuples") > 0.95)
    )
    low = ~((F.col("tuples") / F.col("papers") >= 2.0) | (F.col("tuples") >= 400))
    return one.select(
        "papers", "tuples", "types", F.round(F.col("tuples") / F.col("papers"), 4).alias("mean_tuples"), F.round(F.col("most") / F.col("tuples"), 4).alias("largest_share"),
        F.when(hard, "FAIL").when(low, "LOW").otherwise("PASS").alias("status"),
    )


def plateaus(rows: DataFrame, key: str, epsilon: float = 0.001) -> DataFrame:
    """Per key over (key, step, best): steps whose best changed by less than epsilon."""
    w = Window.partitionBy(key).orderBy("step")
    moved = rows.withColumn("d", F.abs(F.col("best") - F.lag("best").over(w)))
    return moved.groupBy(key).agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("d") < epsilon).alias("flat"))


def audit(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Referential integrity: ids of ``child`` unknown to ``parent`` (invented), and of ``parent`` without or with several children."""
    counts = child.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    all_ = parent.select(key).distinct().withColumn("known", F.lit(True)).join(counts, key, "full")
    status = F.when(F.col("known").isNull(), "invented").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").otherwise("once")
    return all_.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
