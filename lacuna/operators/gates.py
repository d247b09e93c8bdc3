"""The verification gate: agents' rows of several shapes, reviewed gaps, reasons by mode, decisions, and the gaps that go on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The agents that review a gap, the gate's modes, labels with which the critic rejects, fields in which it may say so.
AGENTS = ("support", "skeptic", "feasibility", "mechanism", "critic")
MODES = ("survival_score", "critic_label", "reviewed_only")
REJECT_LABELS = (
    "DROP", "REJECT", "REJECTED", "UNSUPPORTED", "DROP_GENERIC", "DROP_ALREADY_SOLVED", "DROP_IMPOSSIBLE", "DROP_ARTIFICIAL_SCOPE", "DROP_OFF_DOMAIN",
    "DROP_DUPLICATE", "DROP_TOO_SINGLE_PAPER_FRAGILE",
)
LABEL_FIELDS = ("critic_label", "review_label", "quality_label", "recommendation", "verdict")
ROW = "gap_id string, agent_name string, summary string, confidence string, failure_modes array<string>, critic_label string, review_label string, quality_label string, recommendation string, verdict string"


class GateError(ValueError):
    """The outputs cannot support the configured gate."""


@dataclass(frozen=True)
class Gate:
    """Settings of the gate."""

    mode: str = "survival_score"
    enabled: bool = True
    require_all_agents: bool = True
    require_critic_non_reject: bool = True
    fail_on_agent_parse_failure: bool = True
    allow_reviewed_only_fallback: bool = False
    min_survival_score: float = 0.60
    min_critic_confidence: float = 0.50

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise GateError(f"the mode must be one of {MODES}, not {self.mode!r}")


def agent_rows(summaries: DataFrame, results: DataFrame) -> DataFrame:
    """One row per gap and agent from summary records (gap_id, body: JSON object or list of rows) and agents' result lines (gap_id, agent, body).

    A summary row without an agent's name may hold one object per agent; a later source replaces an earlier one, results replace summaries.
    """
    row = ROW.replace("gap_id string, ", "")
    nested = "struct<" + ", ".join(f"{a}:struct<{', '.join(f.replace(' ', ':', 1) for f in row.split(', '))}>" for a in AGENTS) + ">"
    parts = F.when(F.trim("body").startswith("["), F.from_json("body", f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in row.split(', '))}>>"))
    flat = summaries.withColumn("rows", F.coalesce(parts, F.array(F.from_json("body", row))))
    direct = flat.select("gap_id", F.posexplode("rows").alias("at", "r")).where("r.agent_name IS NOT NULL").select("gap_id", F.lit(0).alias("source"), "at", "r.*")
    objects = summaries.withColumn("o", F.from_json("body", nested))
    inner = objects.select("gap_id", F.explode(F.array(*[F.struct(F.lit(a).alias("agent"), F.col(f"o.{a}").alias("r")) for a in AGENTS])).alias("e")).where("e.r IS NOT NULL")
    spread = inner.select("gap_id", F.lit(0).alias("source"), F.lit(0).alias("at"), "e.agent", "e.r.*").withColumn("agent_name", F.coalesce("agent_name", "agent")).drop("agent")
    lines = results.withColumn("r", F.from_json("body", row)).select("gap_id", F.lit(1).alias("source"), F.lit(0).alias("at"), "agent", "r.*")
    lines = lines.withColumn("agent_name", F.coalesce("agent_name", "agent")).drop("agent")
    every = direct.unionByName(spread).unionByName(lines).where("gap_id IS NOT NULL AND gap_id <> ''")
    cols = [c for c in every.columns if c not in ("gap_id", "agent_name", "source", "at")]
    return every.groupBy("gap_id", "agent_name").agg(F.max_by(F.struct(*cols), F.struct("source", "at")).alias("r")).select("gap_id", "agent_name", "r.*")


def parse_failed() -> Column:
    """An agent's row that tells of a reply that could not be read."""
    modes = F.coalesce(F.exists("failure_modes", lambda m: F.contains(F.lower(m), F.lit("parse_failure"))), F.lit(False))
    return modes | F.contains(F.lower(F.coalesce("summary", F.lit(""))), F.lit("failed after retries"))


def critic_rejects() -> Column:
    """A label of rejection in any of the fields."""
    out = F.lit(False)
    for f in LABEL_FIELDS:
        v = F.replace(F.upper(F.trim(F.coalesce(F.col(f), F.lit("")))), F.lit(" "), F.lit("_"))
        out = out | v.isin(*REJECT_LABELS) | v.startswith("DROP") | v.startswith("REJECT")
    return out


def assessed(rows: DataFrame, scores: DataFrame, summary: DataFrame, gate: Gate = Gate()) -> DataFrame:  # noqa: B008
    """One decision per reviewed gap: gap_id, gate_mode, passed, survival_score, critic_confidence, agents_present, parse_failure_count, failure_reasons.

    ``rows`` are agents' rows, ``scores`` (gap_id, gap_survival_score), ``summary`` (gap_id, parse_failures).  Raises where the mode needs scores that
    are missing, unless falling back to reviewed gaps is allowed.
    """
    critic = F.col("agent_name") == "critic"
    sound = critic & ~parse_failed() & ~critic_rejects() & (F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)) >= gate.min_critic_confidence)
    by = rows.groupBy("gap_id").agg(
        F.array_sort(F.collect_set("agent_name")).alias("agents"), F.count_if(parse_failed()).alias("failed"), F.bool_or(sound).alias("sound"),
        F.max(F.when(critic, F.col("confidence").try_cast("double"))).alias("critic_confidence"),
    )
    needed = F.array(*[F.lit(a) for a in AGENTS])
    missing = F.array_sort(F.array_except(needed, "agents"))
    if gate.require_all_agents:
        by = by.where(F.size(missing) == 0)
    told = summary.select("gap_id", F.coalesce(F.col("parse_failures").cast("string").try_cast("double"), F.lit(0.0)).cast("long").alias("told"))
    marks = scores.select("gap_id", F.col("gap_survival_score").cast("string").try_cast("double").alias("survival_score")).where("survival_score IS NOT NULL")
    both = by.join(marks, "gap_id", "left").join(told, "gap_id", "left")
    both = both.withColumn("parse_failure_count", F.greatest("failed", F.coalesce("told", F.lit(0))))
    mode = gate.mode
    if mode == "survival_score" and both.where("survival_score IS NULL").limit(1).count():
        if not gate.allow_reviewed_only_fallback:
            raise GateError("the mode survival_score needs a score for every reviewed gap")
        mode = "reviewed_only"
    score, least = F.col("survival_score"), gate.min_survival_score
    if not gate.enabled or mode == "reviewed_only":
        mode, reasons = "reviewed_only", F.array(F.lit("reviewed_only_mode_no_pass_gate"))
    else:
        rejected = ~F.coalesce("sound", F.lit(False))
        reasons = F.array_compact(F.array(
            F.when(F.lit(gate.fail_on_agent_parse_failure) & (F.col("parse_failure_count") > 0), F.concat(F.lit("agent_parse_failures:"), "parse_failure_count")),
            F.when(F.lit(mode == "survival_score") & (score < least), F.concat(F.lit("survival_score_below_threshold:"), F.format_string("%.3f", score), F.lit(f"<{least:.3f}"))),
            F.when(F.lit(gate.require_critic_non_reject) & rejected, "critic_reject_or_low_confidence"),
            F.when(F.lit(mode == "critic_label") & rejected, "critic_label_gate_failed"),
        ))
    return both.select(
        "gap_id", F.lit(mode).alias("gate_mode"), (F.size(reasons) == 0).alias("passed"), "survival_score", "critic_confidence",
        F.array_intersect("agents", F.array_sort(needed)).alias("agents_present"), "parse_failure_count", reasons.alias("failure_reasons"),
    )


def decision_table(decisions: DataFrame) -> DataFrame:
    """Decisions as flat rows for CSV, lists joined by semicolons."""
    return decisions.withColumns({c: F.array_join(c, ";") for c in ("agents_present", "failure_reasons")})


def direct_inputs(gaps: DataFrame, decisions: DataFrame, source: str) -> DataFrame:
    """The gaps that are formulated next and where they come from: verification_passed_gaps, verification_reviewed_gaps or novelty_survivors."""
    if source == "novelty_survivors":
        return gaps.withColumn("verification_provenance", F.lit("NOVELTY_ONLY"))
    passed = decisions.where("passed") if source == "verification_passed_gaps" else decisions
    if source not in ("verification_passed_gaps", "verification_reviewed_gaps"):
        raise GateError(f"unknown input source {source!r}")
    label = "VERIFICATION_PASSED" if source == "verification_passed_gaps" else "VERIFICATION_REVIEWED"
    return gaps.join(passed.select("gap_id").distinct(), "gap_id", "left_semi").withColumn("verification_provenance", F.lit(label))


def by_agent(rows: DataFrame, column: str) -> DataFrame:
    """One row per gap with a column for every agent."""
    return rows.groupBy("gap_id").agg(*[F.max(F.when(F.col("agent_name") == a, F.col(column))).alias(a) for a in AGENTS])


def verification_summary(rows: DataFrame) -> DataFrame:
    """Per gap: parse failures and the mean of the positive confidences (null without any)."""
    c = F.col("confidence").try_cast("double")
    return rows.groupBy("gap_id").agg(F.count_if(parse_failed()).alias("parse_failures"), F.round(F.avg(F.when(c > 0, c)), 6).alias("mean_confidence"))
