"""Gap rows, verification scores, gates and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.text import bounded, stable_id
from lacuna.operators.selection import soft_capped  # noqa: F401

#: Motifs whose hits carry text spans.
WITH_SPANS = (
    "shared_failure_condition", "repeated_unaddressed_limitation", "conflicting_claims", "sparse_evaluation", "assumption_mismatch",
    "unrealistic_assumption", "theory_practice_gap", "unresolved_tradeoff",
)
# Weights of the survival score.
SURVIVAL_WEIGHTS = {
    "evidence_diversity": 0.20,
    "failure_recurrence": 0.20,
    "novelty_after_counterevidence": 0.20,
    "experimentability": 0.15,
    "mechanism_plausibility": 0.15,
    "traceability": 0.10,
    "already_solved_score": -0.25,
    "extraction_uncertainty": -0.10,
}
# Weights of an agent's sub-scores.
SUB_SCORES = (0.30, 0.20, 0.20, 0.15, 0.15)
#: Agents whose verdict a reviewed gap needs.
AGENTS = ("evidence_agent", "skeptic_agent", "mechanism_agent", "feasibility_agent", "critic_agent")


def gap_rows(hits: DataFrame) -> DataFrame:
    """Motif hits as candidate gaps with novelty, feasibility, impact and overall scores."""
    n = F.size("paper_ids").cast("long")
    mentioned = (F.col("motif_type") == "shared_failure_condition") & (F.size("node_ids") == 1)
    spans = F.col("motif_type").isin(*WITH_SPANS) & ~mentioned
    rows = hits.select(
        stable_id("gap", "motif_id").alias("gap_id"),
        "motif_type", "motif_id", "label", "node_ids", "paper_ids", n.alias("n_papers"), "score",
        F.round(F.least(F.lit(1.0), 0.45 + 0.35 * F.col("score")), 6).alias("novelty_score"),
        F.when(spans, 0.65).otherwise(0.45).alias("feasibility_score"),
        F.round(F.least(F.lit(1.0), 0.45 + 0.1 * n), 6).alias("impact_score"),
        F.greatest(F.lit(0.0), 1 - F.col("score")).alias("extraction_uncertainty"),
    )
    overall = 0.30 * F.col("novelty_score") + 0.25 * F.col("feasibility_score") + 0.30 * F.col("impact_score") + 0.15 * F.col("score")
    return rows.withColumn("overall_score", F.round(bounded(overall), 6))


def diverse_slots(gaps: DataFrame, k: int) -> DataFrame:
    """The k gaps to verify: an even share for every motif, the remainder to those with most gaps.

    Ranks within a motif are pruned to k before the shuffle; the motifs themselves are a handful of rows.
    """
    by = Window.partitionBy("motif_type").orderBy(F.desc("n_papers"), F.desc("overall_score"), "gap_id")
    first = gaps.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= k)
    sizes = gaps.groupBy("motif_type").agg(F.count(F.lit(1)).alias("size"))
    order = Window.orderBy(F.desc("size"), "motif_type")
    ranked = sizes.withColumns({"mr": F.row_number().over(order), "mm": F.count(F.lit(1)).over(Window.partitionBy())})
    base = F.greatest(F.lit(1), F.floor(F.lit(k) / F.col("mm")))
    quota = base + F.when(F.col("mr") <= k - base * F.col("mm"), 1).otherwise(0)
    # a row for each motif: thirteen at most
    chosen = first.join(F.broadcast(ranked.withColumn("quota", quota)), "motif_type").where("rn <= quota")
    return chosen.withColumn("slot", F.row_number().over(Window.orderBy("mr", "rn"))).where(F.col("slot") <= k)


def blended_confidence(scores: list[Column], raw: Column) -> Column:
    """Weighted mean of the sub-scores present, blended with the raw confidence where that is positive."""
    weight = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in zip(scores[1:], SUB_SCORES[1:], strict=True)), F.when(scores[0].isNotNull(), SUB_SCORES[0]).otherwise(0.0))
    total = sum((F.coalesce(bounded(s) * w, F.lit(0.0)) for s, w in zip(scores[1:], SUB_SCORES[1:], strict=True)), F.coalesce(bounded(scores[0]) * SUB_SCORES[0], F.lit(0.0)))
    mean = total / F.nullif(weight, F.lit(0.0))
    return bounded(F.when(weight < 0.1, raw).when(raw > 0, 0.7 * mean + 0.3 * raw).otherwise(mean))


def survival_scores(gaps: DataFrame, results: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Survival score of every gap from its verification results (gap_id, agent_name, key, value); absent parts take defaults."""
    weights = weights or SURVIVAL_WEIGHTS

    def mean(agent: str, key: str) -> Column:
        return F.avg(F.when((F.col("agent_name") == agent) & (F.col("key") == key), F.col("value")))

    by = results.groupBy("gap_id").agg(
        mean("skeptic_agent", "already_solved_score").alias("solved"),
        mean("feasibility_agent", "experimentability").alias("experiment"),
        mean("mechanism_agent", "mechanism_plausibility").alias("mechanism"),
    )
    parts = {
        "evidence_diversity": F.least(F.lit(1.0), F.col("n_papers") / 3),
        "failure_recurrence": F.least(F.lit(1.0), F.col("n_papers") / 3),
        "novelty_after_counterevidence": 1 - bounded(F.coalesce("solved", F.lit(0.2))),
        "experimentability": bounded(F.coalesce("experiment", "feasibility_score")),
        "mechanism_plausibility": bounded(F.coalesce("mechanism", F.lit(0.5))),
        "traceability": F.least(F.lit(1.0), F.size("node_ids") / 4),
        "already_solved_score": bounded(F.coalesce("solved", F.lit(0.0))),
        "extraction_uncertainty": F.col("extraction_uncertainty"),
    }
    rows = gaps.join(by, "gap_id", "left").withColumns(parts)
    total = sum((F.col(k) * weights.get(k, 0.0) for k in list(parts)[1:]), F.col("evidence_diversity") * weights.get("evidence_diversity", 0.0))
    return rows.withColumn("gap_survival_score", F.round(bounded(total), 6))


def verification_gate(gaps: DataFrame, agents: DataFrame, scores: DataFrame, threshold: float = 0.60, min_critic: float = 0.50) -> DataFrame:
    """Status and reasons of every gap from its agents' rows (gap_id, agent_name, parsed, label, confidence) and survival scores.

    Reasons come in the order missing agents, parse failures, survival score, critic.
    """
    by = agents.groupBy("gap_id").agg(
        F.collect_set("agent_name").alias("seen"),
        F.count_if(~F.col("parsed")).alias("failures"),
        F.max(F.when(F.col("agent_name") == "critic_agent", F.upper("label"))).alias("label"),
        F.max(F.when(F.col("agent_name") == "critic_agent", F.col("confidence"))).alias("confidence"),
    )
    rows = gaps.join(by, "gap_id", "left").join(scores, "gap_id", "left")
    missing = F.size(F.array_except(F.array(*[F.lit(a) for a in AGENTS]), F.coalesce("seen", F.array().cast("array<string>")))) > 0
    rejected = F.coalesce(F.col("label").startswith("DROP") | F.col("label").startswith("REJECT"), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(missing, "missing_agents"),
        F.when(F.coalesce("failures", F.lit(0)) > 0, "parse_failures"),
        F.when(F.col("gap_survival_score").isNull(), "missing_survival_score").when(F.col("gap_survival_score") < threshold, "low_survival_score"),
        F.when(rejected, "critic_reject").when(F.coalesce("confidence", F.lit(0.0)) < min_critic, "low_critic_confidence"),
    ))
    return rows.select("gap_id", (F.size(reasons) == 0).alias("passed"), F.array_join(reasons, ";").alias("reasons"), (~missing).alias("reviewed"))


def quality_label(coherence: Column, specificity: Column, soup: Column, recommendation: Column) -> Column:
    rec = F.upper(recommendation)
    return (
        F.when((rec == "DROP") | (coherence < 0.4) | (soup > 0.6), "DROP")
        .when((coherence >= 0.7) & (specificity >= 0.6) & (soup <= 0.3) & (rec == "KEEP"), "STRONG")
        .when((coherence >= 0.5) & rec.isin("KEEP", "MAYBE"), "USABLE")
        .otherwise("WEAK")
    )
