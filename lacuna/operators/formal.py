"""Formal problem statements: replies brought into one shape, source-grounded variables and entities, fallbacks, ambiguity flags and the audit.

Rows are families with text columns (family_id, family_title, representative_problem_statement, research_object, problem_class, ...) and a JSON column
``reply``.  Replies are parsed by a schema in which everything may be absent, so no reply fails a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.normalise import first_text
from lacuna.functions.text import squash

# Enumerations, words that hide several meanings, and placeholders that describe the record instead of the problem.
VARIABLE_TYPES = ("scalar", "vector", "set", "distribution", "process", "function", "other")
CONFIDENCES, STATUSES = ("high", "medium", "low"), ("kept", "relaxed", "removed", "questioned")
AMBIGUOUS = ("unknown", "unclear", "ambiguous", "mismatch", "boundary", "dynamic", "robust", "trust", "aware", "general", "failure")
PLACEHOLDER_SYMBOLS = ("R", "C", "A", "B")
PLACEHOLDER_HINTS = ("research object", "problem class", "assumption shift", "questioned condition", "failure boundary", "boundary or mechanism", "source assumption", "project family")
INFERRED = "inferred from family problem statement / abstract"
# Variables by the words that call for them: symbol, meaning before the setting, type, words.
VARIABLES: tuple[tuple[str, str, str, tuple[str, ...]], ...] = (
    ("a_t", "action, arm, intervention, attack, or decision chosen at step t in", "other", ("arm", "action", "decision", "policy", "control", "controller", "intervention", "choice", "attack")),
    ("o_t", "observation, feedback, measurement, query response, or signal available at step t in", "other", ("observation", "observe", "feedback", "measurement", "signal", "data", "sample", "query", "noise")),
    ("y_t", "reward, outcome, loss, cost, success indicator, or response observed after decisions in", "other", ("reward", "outcome", "loss", "cost", "success", "regret", "payoff", "response", "performance")),
    ("z", "latent, hidden, prior, trust, confounding, or unknown factor affecting", "other", ("latent", "hidden", "unobserved", "confound", "trust", "reliability", "unknown", "prior", "posterior")),
    ("pi", "policy, strategy, estimator, attack rule, controller, or method selected for", "function", ("policy", "strategy", "algorithm", "controller", "method", "estimator", "oracle", "attack", "learner")),
    ("P", "environment, data-generating process, prior, geometry, metric, model, or distribution for", "distribution", ("environment", "distribution", "population", "process", "dynamics", "model", "prior", "geometry", "metric")),
    ("g", "constraint, regime indicator, failure condition, mismatch measure, or robustness boundary in", "function", ("constraint", "boundary", "condition", "assumption", "regime", "limit", "failure", "mismatch", "robust")),
    ("J", "objective, risk, regret, identification criterion, performance measure, or success criterion for", "function", ("objective", "criterion", "target", "regret", "risk", "performance", "success", "identification", "optimality")),
    ("f", "problem function, response surface, reward function, mapping, or structural relation in", "function", ("function", "mapping", "lipschitz", "curve", "kernel")),
    ("q_hat", "estimated quantity, inferred ranking, learned parameter, prediction, or identified structure for", "other", ("estimate", "estimator", "infer", "inference", "identify", "identification", "learn", "predict", "rank")),
    ("t", "time index, interaction round, horizon, trajectory position, or process step in", "scalar", ("time", "sequential", "dynamic", "round", "horizon", "trajectory", "process")),
)
ENTITIES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("decision-maker, learner, controller, estimator, or analyst", ("policy", "algorithm", "controller", "estimator", "learner", "decision", "action", "arm", "attack")),
    ("observation, measurement, or feedback source", ("observation", "observe", "feedback", "measurement", "signal", "data", "sample", "reward")),
    ("latent factor, hidden state, confounder, prior, or unknown quantity", ("latent", "hidden", "unobserved", "confound", "prior", "unknown", "trust")),
    ("constraint, failure regime, or boundary condition", ("constraint", "boundary", "condition", "assumption", "failure", "mismatch", "regime")),
)
#: Texts from which variables and entities are inferred.
GROUNDS = (
    "family_title", "representative_problem_statement", "proposal_style_abstract", "research_object", "problem_class", "assumption_shift",
    "failure_boundary_or_mechanism", "theorem_target", "algorithmic_target", "empirical_target",
)
_VARIABLE = "struct<symbol:string,meaning:string,type:string,source:string>"
REPLY = (
    "plain_language_problem string, formal_problem_statement string, mathematical_setup struct<entities:array<string>,variables:array<" + _VARIABLE + ">,"
    "data_or_observations:string,feedback_or_measurement_model:string,objective:string,constraints:string,success_criterion:string>, "
    "assumptions array<struct<name:string,description:string,status:string>>, ambiguity_flags array<struct<term:string,why_ambiguous:string>>, open_question string, "
    "possible_result_types struct<theorem:string,algorithm:string,empirical_or_benchmark:string>, formalization_confidence string, requires_human_definition boolean"
)


def _t(x: str) -> Column:
    return F.coalesce(F.col(x).cast("string"), F.lit(""))


def _any(x: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def ground_text() -> Column:
    return F.lower(F.concat_ws(" ", *[F.nullif(squash(_t(g)), F.lit("")) for g in GROUNDS]))


def _struct(symbol: Column, meaning: Column, kind: Column, source: Column) -> Column:
    return F.struct(symbol.alias("symbol"), meaning.alias("meaning"), kind.alias("type"), source.alias("source"))


def grounded_variables() -> Column:
    """Variables that the family's own words call for; every setting has observations."""
    text, setting = ground_text(), first_text("research_object", "family_title")
    one = lambda s, m, k: _struct(F.lit(s), F.rtrim(F.concat(F.lit(f"{m} "), setting)), F.lit(k), F.lit(INFERRED))
    called = lambda s, words: _any(text, words) | ((setting != "") if s == "o_t" else F.lit(False))
    return F.array_compact(F.array(*[F.when((text != "") & called(s, words), one(s, m, k)) for s, m, k, words in VARIABLES]))


def grounded_entities() -> Column:
    text, setting = ground_text(), first_text("research_object", "family_title")
    found = [F.nullif(setting, F.lit("")), *[F.when(_any(text, words), e) for e, words in ENTITIES], F.lit("candidate method or analysis procedure")]
    return F.array_distinct(F.array_compact(F.array(*found)))


def _or(x: Column, default: str | Column) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default) if isinstance(default, str) else default)


def _variable(v: Column) -> Column:
    kind = F.lower(_or(v["type"], "other"))
    return _struct(
        _or(v["symbol"], "X"), _or(v["meaning"], "quantity introduced for formalization"), F.when(kind.isin(*VARIABLE_TYPES), kind).otherwise("other"),
        _or(v["source"], "introduced for formalization"),
    )


def placeholder(v: Column) -> Column:
    """A variable that stands for a part of the record."""
    return F.trim(v["symbol"]).isin(*PLACEHOLDER_SYMBOLS) & (_any(F.lower(v["meaning"]), PLACEHOLDER_HINTS) | _any(F.lower(v["source"]), PLACEHOLDER_HINTS))


def heuristic_flags(given: Column, feedback: Column) -> Column:
    """The first ambiguous hint of the family's words that is not flagged yet, and a measurement model that is absent or unclear."""
    text = F.lower(F.concat_ws(" ", *[_t(x) for x in ("family_title", "failure_boundary_or_mechanism", "assumption_shift", "problem_class", "research_object")]))
    hints = F.filter(F.array(*[F.lit(h) for h in AMBIGUOUS]), lambda h: F.contains(text, h) & ~F.array_contains(given, h))
    unclear = ((feedback == "") | F.contains(F.lower(feedback), F.lit("unclear"))) & ~F.array_contains(given, "feedback_or_measurement_model")
    return F.array_compact(F.array(F.get(hints, F.lit(0)), F.when(unclear, "feedback_or_measurement_model")))


def normalised(rows: DataFrame) -> DataFrame:
    """One record per family: texts with defaults, valid variables (placeholders dropped, inferred ones if none is left), assumptions, flags, confidence."""
    r = rows.withColumn("r", F.from_json("reply", REPLY))
    empty = lambda t: F.array().cast(f"array<{t}>")
    setup = lambda f: F.coalesce(F.col(f"r.mathematical_setup.{f}"), F.lit(""))
    given = F.filter(F.transform(F.coalesce("r.mathematical_setup.variables", empty(_VARIABLE)), _variable), lambda v: ~placeholder(v))
    status = lambda a: F.when(F.lower(a["status"]).isin(*STATUSES), F.lower(a["status"])).otherwise("questioned")
    assumptions = F.transform(
        F.coalesce("r.assumptions", empty("struct<name:string,description:string,status:string>")),
        lambda a: F.struct(_or(a["name"], "assumption").alias("name"), _or(a["description"], "Assumption requires source-paper confirmation.").alias("description"), status(a).alias("status")),
    )
    default = F.array(F.struct(F.lit("source-grounded setting").alias("name"), F.lit("The family relies on the setting and limitations stated in the source formulations.").alias("description"), F.lit("questioned").alias("status")))
    terms = F.transform(F.coalesce("r.ambiguity_flags", empty("struct<term:string,why_ambiguous:string>")), lambda a: _or(a["term"], "under-specified term"))
    feedback, objective = F.trim(setup("feedback_or_measurement_model")), F.trim(setup("objective"))
    said = F.lower(_or(F.col("r.formalization_confidence"), "medium"))
    valid = F.when(said.isin(*CONFIDENCES), said).otherwise("medium")
    lacking = (feedback == "") | (objective == "")
    lowered = F.when((valid == "high") & (lacking | F.contains(F.lower(feedback), F.lit("unclear"))), "medium").otherwise(valid)
    confidence = F.when(lacking & (lowered != "medium"), "low").otherwise(lowered)
    flags = F.concat(terms, heuristic_flags(F.transform(terms, lambda t: F.lower(t)), feedback))
    out = r.withColumns({"_given": given, "_assumed": assumptions, "ambiguity_flags": flags, "formalization_confidence": confidence})
    fallback = F.concat(F.lit("The question is whether "), _or(F.col("family_title"), "this project family"), F.lit(" can be stated as a precise, source-grounded problem with explicit observations, assumptions, and success criteria."))
    return out.select(
        "family_id", _or(F.col("r.plain_language_problem"), _t("representative_problem_statement")).alias("plain_language_problem"),
        _or(F.col("r.formal_problem_statement"), fallback).alias("formal_problem_statement"),
        F.when(F.size(F.coalesce("r.mathematical_setup.entities", empty("string"))) > 0, F.col("r.mathematical_setup.entities")).otherwise(grounded_entities()).alias("entities"),
        F.when(F.size("_given") > 0, F.col("_given")).otherwise(grounded_variables()).alias("variables"),
        _or(feedback, "Unclear from the source family; the feedback or measurement model requires human definition.").alias("feedback_or_measurement_model"),
        _or(objective, "The objective requires human definition from the source papers.").alias("objective"),
        F.when(F.size("_assumed") > 0, F.col("_assumed")).otherwise(default).alias("assumptions"), "ambiguity_flags",
        _or(F.col("r.possible_result_types.theorem"), _t("theorem_target")).alias("theorem"), _or(F.col("r.possible_result_types.algorithm"), _t("algorithmic_target")).alias("algorithm"),
        _or(F.col("r.possible_result_types.empirical_or_benchmark"), _t("empirical_target")).alias("empirical_or_benchmark"), "formalization_confidence",
        F.coalesce("r.requires_human_definition", (F.size("ambiguity_flags") > 0) | (F.col("formalization_confidence") == "low")).alias("requires_human_definition"),
    )


def target_summary() -> Column:
    part = lambda name, x: F.when(squash(_t(x)) != "", F.concat(F.lit(f"{name}: "), squash(_t(x))))
    listed = F.concat_ws("; ", part("theorem target", "theorem_target"), part("algorithm target", "algorithmic_target"), part("empirical or benchmark target", "empirical_target"))
    return _or(listed, "a theorem, algorithmic target, or empirical benchmark chosen from the source papers")


def fallback(rows: DataFrame, reason: str) -> DataFrame:
    """A record from the family's own texts where no reply could be read; its confidence is low and a person must define what is missing."""
    what, kind = first_text("research_object", "family_title"), F.coalesce(F.nullif(first_text("problem_class"), F.lit("")), F.lit("the source problem class"))
    shift = _or(first_text("assumption_shift"), "the source assumptions")
    edge = _or(first_text("failure_boundary_or_mechanism"), "the source failure boundary")
    goal = _or(first_text("theorem_target", "algorithmic_target", "empirical_target"), "a source-grounded success criterion")
    statement = F.concat(
        F.lit("The question is whether "), what, F.lit(" can be formulated as an instance of "), kind, F.lit(" when "), shift, F.lit(" and the relevant boundary is "), edge,
        F.lit(". A complete formulation must specify observations, admissible outputs, an objective, constraints, and a success criterion tied to "), target_summary(), F.lit("."),
    )
    variables = grounded_variables()
    flags = F.array_compact(F.array(F.lit("formalization_parse_error"), F.lit("feedback_or_measurement_model"), F.lit("objective"), F.when(F.size(variables) == 0, "problem_variables")))
    return rows.select(
        "family_id", first_text("representative_problem_statement", "proposal_style_abstract", "family_title").alias("plain_language_problem"), statement.alias("formal_problem_statement"),
        grounded_entities().alias("entities"), variables.alias("variables"), F.concat(F.lit("Make progress toward "), goal, F.lit(" under the stated assumption shift and boundary.")).alias("objective"),
        flags.alias("ambiguity_flags"), F.lit("low").alias("formalization_confidence"), F.lit(reason).alias("formalization_risk"), F.lit(True).alias("requires_human_definition"),
    )


def audit(records: DataFrame, families: DataFrame) -> DataFrame:
    """One row: families without a record, invented families, invalid variables, counts of flags and of records that need a person."""
    both = families.select("family_id").distinct().withColumn("known", F.lit(True)).join(records.select("family_id").distinct().withColumn("has", F.lit(True)), "family_id", "full")
    ids = both.agg(F.count_if(F.col("has").isNull()).alias("families_missing_formalization"), F.count_if(F.col("known").isNull()).alias("invented_families"))
    bad = F.exists("variables", lambda v: (v["symbol"] == "") | (v["meaning"] == "") | ~v["type"].isin(*VARIABLE_TYPES))
    own = records.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(bad).alias("invalid_variables"), F.sum(F.size("ambiguity_flags")).alias("ambiguity_flag_count"),
        F.count_if("requires_human_definition").alias("requires_human_definition_count"),
    )
    one = own.crossJoin(F.broadcast(ids))  # a row each
    passed = (F.col("families_missing_formalization") == 0) & (F.col("invented_families") == 0) & (F.col("invalid_variables") == 0)
    return one.withColumn("status", F.when(passed, "PASS").otherwise("FAILED"))


def families_with(families: DataFrame, direct: DataFrame, problems: DataFrame) -> DataFrame:
    """Families (family_id, representative, members) with their representative's row, their members' rows and their formal problem; what is missing is null or empty."""
    row = F.struct(*direct.columns)
    of = families.select("family_id", F.explode(F.array_distinct("members")).alias("formulation_id")).join(direct, "formulation_id").groupBy("family_id").agg(F.collect_list(row).alias("member_rows"))
    named = direct.select(F.col("formulation_id").alias("representative"), row.alias("representative_row"))
    out = families.join(named, "representative", "left").join(of, "family_id", "left").join(problems, "family_id", "left")
    return out.withColumn("member_rows", F.coalesce("member_rows", F.array().cast(of.schema["member_rows"].dataType)))
