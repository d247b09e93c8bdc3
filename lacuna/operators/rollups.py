"""Rollups of judged rows: win rates by method and criterion, ranks, special winners, calibration, pools and packets."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.text import ascii_words
from lacuna.operators.rubrics import FIELDS, NOT_PROVIDED, provided


def _rates(rows: DataFrame, first: str = "wins", second: str = "losses", prefix: str = "") -> DataFrame:
    """Adds the rate without ties and the one that counts a tie as half; null where there is nothing to divide by."""
    w, n, t = F.col(first), F.col(first) + F.col(second), F.col("ties")
    return rows.withColumns({
        f"{prefix}win_rate_excluding_ties": F.round(F.try_divide(w, F.nullif(n, F.lit(0))), 4),
        f"{prefix}win_rate_tie_half": F.round(F.try_divide(w + 0.5 * t, F.nullif(n + t, F.lit(0))), 4),
    })


def win_rates_by_method(rows: DataFrame, family: dict[str, str]) -> DataFrame:
    """Win rates of methods, pools mapped to their method; a pair within one method counts once, as a win if it was decided.

    ``rows`` has pool_a, pool_b and winner; every pair gives one row for each method in it, so one aggregation serves all methods.
    """
    table = F.create_map(*[F.lit(x) for kv in family.items() for x in kv])
    of = lambda c: F.coalesce(F.try_element_at(table, F.col(c)), F.col(c))
    pairs = rows.select(of("pool_a").alias("a"), of("pool_b").alias("b"), "winner")
    sides = pairs.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("method"), "a", "b", "winner")
    won = ((F.col("winner") == "A") & (F.col("a") == F.col("method"))) | ((F.col("winner") == "B") & (F.col("b") == F.col("method")))
    decided = F.col("winner").isin("A", "B")
    by = sides.groupBy("method").agg(
        F.count(F.lit(1)).alias("comparisons"), F.count_if(won).alias("wins"), F.count_if(decided & ~won).alias("losses"),
        F.count_if(F.col("winner") == "TIE").alias("ties"), F.count_if(F.col("winner") == "CANNOT_JUDGE").alias("cannot_judge"),
    )
    return _rates(by)


def criterion_win_rates(rows: DataFrame, criteria: tuple[str, ...]) -> DataFrame:
    """Per comparison group (first_vs_second) and criterion: wins of either pool, ties, rates of the first.

    ``rows`` has comparison_group, pool_a, winner and the map criterion_winners; a reply that could not judge counts as that for every criterion.
    """
    each = rows.select("comparison_group", "pool_a", "winner", F.explode(F.array(*[F.lit(c) for c in criteria])).alias("criterion"), "criterion_winners")
    side = F.when(F.col("winner") != "CANNOT_JUDGE", F.try_element_at("criterion_winners", F.col("criterion")))
    first, second = F.split_part("comparison_group", F.lit("_vs_"), F.lit(1)), F.split_part("comparison_group", F.lit("_vs_"), F.lit(2))
    a_first = F.col("pool_a") == first
    by = each.withColumn("side", side).groupBy("comparison_group", "criterion").agg(
        F.count_if(((F.col("side") == "A") & a_first) | ((F.col("side") == "B") & ~a_first)).alias("first_wins"),
        F.count_if(((F.col("side") == "A") & ~a_first) | ((F.col("side") == "B") & a_first)).alias("second_wins"),
        F.count_if(F.col("side") == "TIE").alias("ties"), F.count_if(F.col("winner") == "CANNOT_JUDGE").alias("cannot_judge"),
    )
    return _rates(by.withColumns({"first_pool": first, "second_pool": second}), "first_wins", "second_wins", "first_")


def candidate_wins(rows: DataFrame) -> DataFrame:
    """Wins, losses and ties of every candidate over (pool_a, id_a, pool_b, id_b, winner)."""
    side = lambda s: F.struct(F.lit(s.upper()).alias("side"), F.col(f"pool_{s}").alias("pool"), F.col(f"id_{s}").alias("candidate_id"))
    each = rows.select(F.explode(F.array(side("a"), side("b"))).alias("s"), "winner").select("s.*", "winner")
    return each.groupBy("pool", "candidate_id").agg(
        F.count_if(F.col("winner") == F.col("side")).alias("wins"),
        F.count_if(F.col("winner").isin("A", "B") & (F.col("winner") != F.col("side"))).alias("losses"), F.count_if(F.col("winner") == "TIE").alias("ties"),
    )


def pair_unblinded(rows: DataFrame, key: DataFrame) -> DataFrame:
    """Methods of both sides of a pair from the key (candidate_id, method); unknown ones are UNKNOWN."""
    for side in ("a", "b"):
        names = key.select(F.col("candidate_id").alias(f"candidate_{side}_id"), F.col("method").alias(f"candidate_{side}_method"))
        rows = rows.join(names, f"candidate_{side}_id", "left").fillna("UNKNOWN", [f"candidate_{side}_method"])
    return rows


def preferred(preference: Column, a: Column, b: Column) -> Column:
    """The method that a preference names; other preferences stay as they are."""
    return F.when(preference == "CANDIDATE_A", a).when(preference == "CANDIDATE_B", b).otherwise(preference)


def rank_rows(rows: DataFrame, criteria: tuple[str, ...]) -> DataFrame:
    """One row per (domain, candidate_id) with a column of ranks for every criterion, over (domain, candidate_id, criterion, rank)."""
    return rows.groupBy("domain", "candidate_id").agg(*[F.max(F.when(F.col("criterion") == c, F.col("rank"))).alias(c) for c in criteria])


def special_winners(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """How often each method won each special title, over (kind, method)."""
    return rows.groupBy("method").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in kinds])


def domain_winners(rows: DataFrame, key: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """One row per domain with method and candidate of every special title, over (domain, kind, candidate_id) and the key (candidate_id, method)."""
    named = rows.join(key, "candidate_id", "left").withColumn("method", F.coalesce("method", F.lit("UNKNOWN")))
    pick = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}")
    return named.groupBy("domain").agg(*[pick(k, c) for k in kinds for c in ("method", "candidate_id")])


def calibration_checks(scores: DataFrame, ranges: DataFrame) -> DataFrame:
    """Observed scores (candidate_id, criterion, score) against expected bounds (candidate_id, criterion, check min or max, expected); missing ones fail."""
    seen = ranges.join(scores.withColumnRenamed("score", "observed"), ["candidate_id", "criterion"], "left")
    holds = F.when(F.col("check") == "min", F.col("observed") >= F.col("expected")).otherwise(F.col("observed") <= F.col("expected"))
    return seen.select("candidate_id", "criterion", "check", "expected", "observed", F.coalesce(holds, F.lit(False)).alias("passed"))


def ceiling_check(scores: DataFrame, high: int = 9) -> DataFrame:
    """One row: whether some candidate stays under ``high`` in some criterion."""
    by = scores.groupBy("candidate_id").agg(F.bool_and(F.col("score") >= high).alias("all_high"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.count_if("all_high").alias("all_high")).withColumn("passed", F.col("all_high") < F.col("n"))


# Weights of the fields and the words that count for or against a candidate.
FIELD_WEIGHTS = {
    "problem_statement": 4.0, "evaluation_plan": 3.0, "source_context_or_grounding": 3.0, "formal_problem_statement": 2.0,
    "assumptions_or_problem_setup": 1.5, "risks_or_caveats": 1.0,
}
GRAND = r"\b(fundamental|phase transition|impossibility|boundary|robust|causal|unified|framework)\b"
NUMERIC = ("coherence_score", "specificity_score", "feasibility_score", "ambition_score")


def selection_score(text: Column, columns: list[str]) -> Column:
    """Completeness of a candidate, its labels and numeric scores, less grand words and length; ``text`` is the whole row as lower-case text."""
    score = functools.reduce(operator.add, [F.when(provided(k), w).otherwise(0.0) for k, w in FIELD_WEIGHTS.items()])
    score = score + F.when(F.contains(text, F.lit("read_first")) | F.contains(text, F.lit("strong_candidate")), 4.0).otherwise(0.0)
    score = score - F.when(F.contains(text, F.lit("drop")) | F.contains(text, F.lit("deprioritize")), 5.0).otherwise(0.0)
    for k in NUMERIC:
        if k in columns:
            score = score + F.coalesce(F.col(k).cast("string").try_cast("double"), F.lit(0.0))
    score = score - F.when(F.regexp_count(text, F.lit(ascii_words(GRAND))) > 14, 1.5).otherwise(0.0)
    return score - F.when(F.length(text) > 16_000, 1.0).otherwise(0.0)


def pool_selection(rows: DataFrame, limit: int = 3) -> DataFrame:
    """The best ``limit`` candidates of every pool (pool, title, score, place), by score, title and place.

    Titles whose first 80 letters and digits agree count once, unless the pool has fewer than ``limit`` different ones.
    """
    root = F.substring(F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " ")), 1, 80)
    rows = rows.withColumn("root", F.when(root == "", F.concat(F.lit(" "), F.col("place").cast("string"))).otherwise(root))
    order = (F.desc("score"), F.col("title"), F.col("place"))
    first = rows.withColumn("again", F.row_number().over(Window.partitionBy("pool", "root").orderBy(*order)))
    roots = rows.groupBy("pool").agg(F.countDistinct("root").alias("roots"))
    open_ = first.where(F.col("again") <= limit).join(roots, "pool").where((F.col("again") == 1) | (F.col("roots") < limit))
    place = F.row_number().over(Window.partitionBy("pool").orderBy(*order))
    return open_.withColumn("rank", place).where(F.col("rank") <= limit).drop("again", "root", "roots")


def pool_pairs(rows: DataFrame, groups: list[tuple[str, str]]) -> DataFrame:
    """Pairs of selected candidates (pool, candidate_id) of the compared pools, in a blinded order that the ids decide.

    Selected pools hold a fixed few candidates, so the pairs of a group are bounded.
    """
    spark = rows.sparkSession
    asked = spark.createDataFrame([(f"{a}_vs_{b}", a, b) for a, b in groups], "comparison_group string, first string, second string")
    x = rows.select(F.col("pool").alias("first"), F.col("candidate_id").alias("x"))
    y = rows.select(F.col("pool").alias("second"), F.col("candidate_id").alias("y"))
    pairs = asked.join(x, "first").join(y, "second")
    swap = F.sha1(F.concat_ws("|", "comparison_group", "x", "y")).substr(1, 1).isin(*"01234567")
    side = lambda a, b: F.when(swap, F.col(a)).otherwise(F.col(b))
    return pairs.select(
        "comparison_group", side("first", "second").alias("pool_a"), side("x", "y").alias("id_a"), side("second", "first").alias("pool_b"), side("y", "x").alias("id_b"),
    )


def labelled(fields: dict[str, Column]) -> Column:
    """``label: value`` lines of the fields that say anything, else "not provided"."""
    line = lambda k, c: F.when(F.trim(F.coalesce(c, F.lit(""))).isin("", NOT_PROVIDED), F.lit(None)).otherwise(F.concat(F.lit(f"{k}: "), c))
    return F.coalesce(F.nullif(F.concat_ws("\n", *[line(k, c) for k, c in fields.items()]), F.lit("")), F.lit(NOT_PROVIDED))


# For every kind of row the columns that each field of the common schema is joined from; a single one stands for itself.
COMMON: dict[str, dict[str, tuple[str, ...]]] = {
    "family": {
        "candidate_id": ("family_id",), "title": ("family_title",), "problem_statement": ("family_problem_statement",), "motivation_or_abstract": ("proposal_style_abstract",),
        "proposed_direction": ("research_object", "problem_class", "assumption_shift", "failure_boundary_or_mechanism"),
        "expected_contribution": ("theorem_target", "algorithmic_target", "empirical_target", "constructive_or_evaluation_target"),
        "evaluation_plan": ("theorem_target", "algorithmic_target", "empirical_target", "evaluation_protocol", "falsification_condition"),
        "risks_or_caveats": ("main_risk", "main_risks", "downgrade_reasons", "formalization_risk"),
        "source_context_or_grounding": ("supporting_papers", "source_verified_gaps", "source_direct_formulations"),
        "formal_problem_statement": ("formal_problem_statement",), "assumptions_or_problem_setup": ("objective", "constraints", "success_criterion", "assumptions"),
        "ambiguity_or_missing_definitions": ("ambiguity_flags",),
    },
    "direct": {
        "candidate_id": ("formulation_id",), "title": ("direct_title",), "problem_statement": ("direct_problem_statement",), "motivation_or_abstract": ("proposal_style_abstract",),
        "proposed_direction": ("core_setting", "core_assumption_or_failure", "core_objective"),
        "expected_contribution": ("possible_theorem_target", "possible_algorithmic_target", "possible_empirical_target"),
        "evaluation_plan": ("possible_theorem_target", "possible_algorithmic_target", "possible_empirical_target", "falsification_condition", "recommendation"),
        "risks_or_caveats": ("main_risk",), "source_context_or_grounding": ("supporting_papers", "source_verified_gap_id", "verification_provenance"),
        "formal_problem_statement": (), "assumptions_or_problem_setup": ("core_setting", "core_assumption_or_failure", "core_objective", "verification_summary"),
        "ambiguity_or_missing_definitions": (),
    },
}


def common_schema(rows: DataFrame, kind: str, domain: Column) -> DataFrame:
    """Rows of a kind in the fields that all judged candidates share; what a row does not have is "not provided"."""
    has = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    blank = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(NOT_PROVIDED))
    table = COMMON[kind]
    one = {f: blank(has(cols[0])) if len(cols) == 1 else labelled({c: has(c) for c in cols}) if cols else F.lit(NOT_PROVIDED) for f, cols in table.items()}
    return rows.select(*[(domain if f == "domain" else one[f]).alias(f) for f in FIELDS])


#: Keys of a source context that a blinded packet may show.
CONTEXT_KEYS = (
    "context_mode", "corpus_context_mode", "paper_count_available", "chunk_count", "retrieved_context_ids", "paper_ids_shown", "input_files_read_count",
    "prompt_context_sha256", "context_sha256",
)


def safe_context(x: Column | str) -> Column:
    """The allowed keys of a map."""
    return F.map_filter(x, lambda k, _: k.isin(*CONTEXT_KEYS))


def packet_counts(rows: DataFrame) -> DataFrame:
    """One row: for every field how many candidates provide it."""
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(provided(f)).alias(f) for f in FIELDS if f not in ("candidate_id", "domain")])


def progress(rows: DataFrame) -> DataFrame:
    """(generation, ok, fitness) to calls, successes, failures and the best fitness of every generation."""
    ok = F.coalesce("ok", F.lit(False))
    return rows.groupBy("generation").agg(F.count(F.lit(1)).alias("calls"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.round(F.max("fitness"), 6).alias("best_fitness"))
