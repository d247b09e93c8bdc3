"""From model replies to valid claim tuples and resolution records: coercion, repair, rejection with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import vectorised
from lacuna.functions.text import bounded, clamped_confidence, coerced_enum, stable_id

# The enumerations of a claim tuple, their spellings and defaults.
ENUMS: dict[str, tuple[list[str], dict[str, str], str]] = {
    "direction": (
        ["improves", "worsens", "no_change", "unknown"],
        {
            "increases": "improves", "increase": "improves", "increased": "improves", "positive": "improves", "better": "improves", "higher": "improves",
            "improve": "improves", "improved": "improves", "decreases": "worsens", "decrease": "worsens", "decreased": "worsens", "negative": "worsens",
            "worse": "worsens", "lower": "worsens", "worsen": "worsens", "worsened": "worsens", "neutral": "no_change", "unchanged": "no_change",
            "stable": "no_change", "none": "no_change", "no change": "no_change",
        },
        "unknown",
    ),
    "claim_type": (
        ["method", "result", "limitation", "assumption", "comparison", "failure", "hypothesis", "evaluation", "unknown"],
        {
            "methods": "method", "results": "result", "limitations": "limitation", "assumptions": "assumption", "comparisons": "comparison", "failures": "failure",
            "hypotheses": "hypothesis", "evaluations": "evaluation",
        },
        "unknown",
    ),
    "polarity": (["positive", "negative", "neutral", "mixed", "unknown"], {"pos": "positive", "neg": "negative", "neut": "neutral"}, "unknown"),
    "evidence_type": (
        ["empirical", "theoretical", "ablation", "qualitative", "assumption", "citation", "benchmark", "unknown"],
        {
            "experiment": "empirical", "experiments": "empirical", "experimental": "empirical", "theory": "theoretical", "ablations": "ablation",
            "assumptions": "assumption", "citations": "citation", "benchmarks": "benchmark",
        },
        "unknown",
    ),
    "strength": (
        ["strong", "moderate", "weak", "unknown"],
        {"strongly": "strong", "strongly supported": "strong", "moderately": "moderate", "weakly": "weak"},
        "unknown",
    ),
    "relation": (
        ["evaluated_on", "improves_over", "fails_under", "assumes", "contradicts", "uses_dataset", "measured_by", "limited_by", "addresses", "not_addressed_by"],
        {
            "evaluated": "evaluated_on", "evaluate": "evaluated_on", "tests": "evaluated_on", "improves": "improves_over", "improves over": "improves_over",
            "outperforms": "improves_over", "fails": "fails_under", "fails on": "fails_under", "assume": "assumes", "assumed": "assumes",
            "contradict": "contradicts", "contradicted": "contradicts", "uses": "uses_dataset", "use dataset": "uses_dataset", "measured": "measured_by",
            "measure": "measured_by", "limited": "limited_by", "limit": "limited_by", "address": "addresses", "addressed": "addresses",
            "not addressed": "not_addressed_by",
        },
        "addresses",
    ),
}
# Subjects and labels that name nothing, tasks too general to keep, phrases of assumptions and of failures.
JUNK_SUBJECTS = (
    "method", "the method", "model", "the model", "algorithm", "the algorithm", "approach", "the approach", "system", "the system", "technique",
    "the technique", "our method", "our model", "our approach", "our system", "proposed method", "proposed model", "proposed approach", "it", "this",
    "the paper", "the work", "algorithm 1", "algorithm 2", "algorithm 3", "existing algorithms", "existing methods", "existing approaches", "baseline",
    "baselines", "the baseline", "prior methods", "prior work", "previous methods", "the proposed method", "the proposed algorithm", "the proposed approach",
)
JUNK_LABELS = (
    "our algorithm", "our method", "our approach", "our model", "the algorithm", "the method", "the proposed method", "baseline", "algorithm 1",
    "algorithm 2", "algorithm 3", "algorithm 4", "algorithm 5", "algorithm 6",
)
JUNK_LABEL = r"^(algorithm|theorem|lemma|corollary|proposition|remark|claim|definition)\s*[\d.]+$"
GENERIC_TASKS = ("regret minimization", "optimization", "learning", "prediction", "classification", "regression", "bandits", "reinforcement learning")
ASSUMING = ("assumes ", "we assume", "assume that", "requires ", "require that", "assumption ", "rely on the assumption", "relies on the assumption")
FAILING = ("fail", "degrad", "break", "violat", "when", "if not", "does not hold")
# The enumerations of a resolution record, and what its confidence must reach.
RESOLUTION_RELATIONS = (
    "addresses_limitation", "relaxes_assumption", "handles_failure_condition", "resolves_failure_condition", "partially_addresses", "improves_under_condition",
)
PROBLEM_TYPES = ("assumption", "limitation", "failure_condition", "benchmark_gap", "unclear")
CLAIM_STRENGTHS = ("full", "partial", "empirical_only", "theoretical_only", "unclear")
IMPUTED_CONFIDENCE, LEAST_CONFIDENCE = 0.70, 0.65

EVALUATING, HARMING = ("evaluated_on", "uses_dataset", "measured_by"), ("fails_under", "limited_by")


def _any(x: Column, phrases: tuple[str, ...], test=F.contains) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | test(x, F.lit(p))
    return found


def coerced(rows: DataFrame) -> DataFrame:
    """Every enumeration that the rows have, by its spellings; confidence clamped; scope by its words."""
    cols = {k: coerced_enum(k, *v) for k, v in ENUMS.items() if k in rows.columns}
    if "confidence" in rows.columns:
        cols["confidence"] = clamped_confidence(F.col("confidence").cast("string"))
    if "subject_scope" in rows.columns:
        cols["subject_scope"] = subject_scope("subject_scope")
    return rows.withColumns(cols)


def subject_scope(x: Column | str) -> Column:
    """own_method, prior_work or general; other values by the words in them."""
    v = F.replace(F.lower(F.trim(F.col(x) if isinstance(x, str) else x)), F.lit(" "), F.lit("_"))
    return (
        F.when(v.isin("own_method", "prior_work", "general"), v)
        .when(_any(v, ("prior", "baseline", "existing", "previous")), "prior_work")
        .when(_any(v, ("general", "field")), "general")
        .otherwise("own_method")
    )


def junk_label(x: Column | str) -> Column:
    """Labels that would merge unrelated entities: the generic ones and numbered statements."""
    v = F.lower(F.trim(F.col(x) if isinstance(x, str) else x))
    return v.isin(*JUNK_LABELS) | v.rlike(JUNK_LABEL)


def polarity_of(relation: Column, polarity: Column) -> Column:
    """The polarity that agrees with the relation."""
    return (
        F.when((relation == "improves_over") & polarity.isin("negative", "unknown"), "positive")
        .when(relation.isin(*HARMING) & polarity.isin("positive", "unknown"), "negative")
        .when((relation == "assumes") & (polarity == "unknown"), "neutral")
        .otherwise(polarity)
    )


def validated(tuples: DataFrame, texts: DataFrame) -> DataFrame:
    """Tuples (paper_id, subject, relation, object, evidence_text, source_span, metric, dataset, polarity) with ``drop_reason``, null for valid ones.

    The first rule that fails names the reason; a valid tuple's polarity agrees with its relation, and its span or evidence stands in its paper's text
    (paper_id, text).  Only the ids and the texts of papers with tuples meet; equal spans are folded once a row.
    """
    c, empty = F.col, F.lit("")
    known = c("relation").isin(*ENUMS["relation"][0])
    blank = lambda x: F.coalesce(c(x), empty) == ""
    folded = texts.join(tuples.select("paper_id").distinct(), "paper_id", "left_semi").select("paper_id", vectorised.span_form("text").alias("_text"))
    rows = tuples.join(folded, "paper_id", "left")
    stands = lambda x: (F.length(x) >= 15) & F.contains("_text", F.nullif(vectorised.span_form(x), empty))
    found = F.coalesce(stands("source_span"), F.lit(False)) | F.coalesce(stands("evidence_text"), F.lit(False))
    reason = (
        F.when(~F.coalesce(known, F.lit(False)), "unknown_relation")
        .when(blank("object") | blank("evidence_text"), "no_object_or_evidence")
        .when(F.lower(F.trim(F.coalesce("subject", empty))).isin(*JUNK_SUBJECTS), "junk_subject")
        .when(c("relation").isin(*EVALUATING) & blank("metric") & blank("dataset"), "no_metric_or_dataset")
        .when(~found, "unverified_span")
    )
    return rows.withColumns({"polarity": polarity_of(c("relation"), c("polarity")), "drop_reason": reason}).drop("_text")


def reads_as_assumption(x: Column) -> Column:
    """Phrased as an assumption, without a word of what breaks."""
    t = F.lower(x)
    return (_any(t, ASSUMING, F.startswith) | _any(t, tuple(f" {p}" for p in ASSUMING))) & ~_any(t, FAILING)


def rerouted(rows: DataFrame) -> DataFrame:
    """Lists of a paper (tasks, assumptions, failure_conditions): assumptions among the failures move, general tasks go."""
    moved = F.filter("failure_conditions", reads_as_assumption)
    return rows.withColumns({
        "assumptions": F.concat("assumptions", F.array_distinct(F.filter(moved, lambda x: ~F.array_contains("assumptions", x)))),
        "failure_conditions": F.filter("failure_conditions", lambda x: ~reads_as_assumption(x)),
        "tasks": F.filter("tasks", lambda x: ~F.lower(F.trim(x)).isin(*GENERIC_TASKS)),
    })


def unresolved_own(scope: Column, relation: Column, resolved: Column) -> Column:
    """``resolved_by_paper``, which a failure of the paper's own method never is."""
    return F.when((scope == "own_method") & relation.isin(*HARMING), F.lit(False)).otherwise(resolved)


def needs_condition() -> Column:
    """Tuples for the second reading: an own failure or limitation that is open and has no condition."""
    c = F.col
    return c("relation").isin(*HARMING) & (c("subject_scope") == "own_method") & ~F.coalesce("resolved_by_paper", F.lit(False)) & (F.trim(F.coalesce("condition", F.lit(""))) == "")


def resolutions(rows: DataFrame) -> DataFrame:
    """Resolution records from raw ones, with ``drop_reason``: no evidence, or a confidence under the least one.

    A missing confidence is imputed where evidence, method and a target or condition are there; one that does not parse counts as none.
    """
    t = lambda x: F.trim(F.coalesce(F.col(x).cast("string"), F.lit("")))
    pick = lambda v, valid, default: F.when(v.isin(*valid), v).otherwise(F.lit(default))
    content = (t("evidence_text") != "") & (t("method") != "") & ((t("target_problem") != "") | (t("addressed_condition") != ""))
    given = F.col("confidence").isNotNull()
    number = bounded(F.col("confidence").cast("string").try_cast("double"))
    out = rows.select(
        stable_id("res", "paper_id", t("method"), t("target_problem"), t("evidence_text")).alias("record_id"),
        "paper_id", t("method").alias("method"),
        pick(F.replace(F.lower(t("resolution_relation")), F.lit(" "), F.lit("_")), RESOLUTION_RELATIONS, "addresses_limitation").alias("resolution_relation"),
        t("target_problem").alias("target_problem"), pick(F.lower(t("target_problem_type")), PROBLEM_TYPES, "unclear").alias("target_problem_type"),
        t("addressed_condition").alias("addressed_condition"), pick(F.lower(t("claim_strength")), CLAIM_STRENGTHS, "unclear").alias("claim_strength"),
        t("evidence_text").alias("evidence_text"),
        F.when(given, F.coalesce(number, F.lit(0.0))).when(content, F.lit(IMPUTED_CONFIDENCE)).otherwise(F.lit(0.0)).alias("confidence"),
        (~given & content).alias("confidence_was_imputed"),
    )
    reason = F.when(F.col("evidence_text") == "", "empty_evidence").when(F.col("confidence") < LEAST_CONFIDENCE, "low_confidence")
    return out.withColumn("drop_reason", reason)


def score_map(x: Column) -> Column:
    """Scores of any spelling (JSON object, number, text) as a map of doubles: parts that do not parse go, a lone number is the ``score``."""
    parsed = F.from_json(x, "map<string,string>")
    numbers = F.map_filter(F.transform_values(parsed, lambda _, v: F.regexp_extract(v, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")), lambda _, v: v.isNotNull())
    lone = F.regexp_extract(x, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    none = F.create_map().cast("map<string,double>")
    return F.when(F.trim(x).startswith("{"), F.coalesce(numbers, none)).when(lone.isNotNull(), F.create_map(F.lit("score"), lone)).otherwise(none)


def evidence_list(x: Column) -> Column:
    """Evidence of any spelling (JSON array of objects or texts, plain text) as an array of (paper_id, text)."""
    item = "struct<paper_id:string,text:string,evidence_text:string>"
    objects = F.filter(F.from_json(x, f"array<{item}>"), lambda e: e.isNotNull() & (e["text"].isNotNull() | e["evidence_text"].isNotNull()))
    shaped = F.transform(objects, lambda e: F.struct(e["paper_id"].alias("paper_id"), F.coalesce(e["text"], e["evidence_text"]).alias("text")))
    plain = lambda t: F.struct(F.lit(None).cast("string").alias("paper_id"), t.alias("text"))
    texts = F.transform(F.filter(F.from_json(x, "array<string>"), lambda t: ~t.startswith("{")), plain)
    listed = F.trim(x).startswith("[")
    none = F.array().cast("array<struct<paper_id:string,text:string>>")
    return F.when(listed & (F.size(F.coalesce(shaped, none)) > 0), shaped).when(listed, F.coalesce(texts, none)).when(F.trim(x) == "", none).otherwise(F.array(plain(x)))


def upper_label(x: Column, valid: tuple[str, ...], default: str) -> Column:
    """Upper case with underscores; the default where that is no label."""
    v = F.regexp_replace(F.upper(F.trim(x)), r"[\s\-]+", "_")
    return F.coalesce(F.when(v.isin(*valid), v), F.lit(default))
