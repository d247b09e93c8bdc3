"""Stages that widen, criticise, formalise and join formulations with a language model, each on :func:`lacuna.operators.model_stages.asked`.

Every row asked comes back.  What a model fails to say takes the value that counts against it, so a bad reply cannot pass a gate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators import evolution, formal, formulations, models
from lacuna.operators.model_stages import Stage, asked
from lacuna.scratch import kept

# Kinds of variants, score bonuses and the least length of a joint hypothesis, and field names of replies.
KINDS = ("conservative", "generalized", "bold")
NOVELTY_BONUS, IMPACT_BONUS, LEAST_HYPOTHESIS = 0.15, 0.10, 20
TEXTS = (
    "title", "problem_statement", "proposal_style_abstract", "core_setting", "generalized_axis", "core_assumption_or_failure", "core_objective", "contribution_type", "theorem_target",
    "algorithmic_target", "empirical_target", "broader_problem_class", "assumption_shift", "boundary_or_failure_regime", "method_class_scope", "why_not_just_validation", "why_not_incremental",
    "why_not_term_soup", "main_risk", "falsification_condition", "constructive_or_explanatory_target",
)
#: Scores with the value of a missing one.
SCORES = {"coherence_score": 0.0, "ambition_score": 0.0, "specificity_score": 0.0, "feasibility_score": 0.0, "term_soup_risk": 0.0, "non_incrementality_score": 0.0, "incrementality_risk": 1.0}
CRITIC_SCORES = {"critic_non_incrementality_score": 0.0, "critic_incrementality_risk": 1.0, "critic_fake_ambition_risk": 1.0}
CRITIC_FLAGS = ("critic_broader_problem_class_valid", "critic_contribution_type_valid")
EXPAND = Stage(
    "Restate the formulation as a {kind} variant that is no increment of one method, as JSON {\"" + "\", \"".join((*TEXTS, *SCORES, "named_method_dependency", "recommendation")) + "\"}."
    "\n\nFormulation {formulation_id}: {title}\n{problem}",
    ", ".join([*(f"{k} string" for k in TEXTS), *(f"{k} double" for k in SCORES), "named_method_dependency string", "recommendation string"]), ("title", "problem_statement"),
)
CRITIC = Stage(
    "Judge, without having written it, whether the variant goes beyond its source, as JSON {\"" + "\", \"".join((*CRITIC_SCORES, *CRITIC_FLAGS, "critic_supported_by_source", "critic_quality_label", "critic_reason")) + "\"}."
    "\n\nSource: {source}\nVariant {variant_id} ({kind}): {title}\n{problem_statement}",
    ", ".join([*(f"{k} double" for k in CRITIC_SCORES), *(f"{k} boolean" for k in CRITIC_FLAGS), "critic_supported_by_source string", "critic_quality_label string", "critic_reason string"]),
    ("critic_quality_label",),
)
FORMALISE = Stage(
    "State the family as a formal problem grounded in its sources, as one JSON object with plain_language_problem, formal_problem_statement, mathematical_setup, assumptions, ambiguity_flags, "
    "open_question, possible_result_types, formalization_confidence and requires_human_definition.\n\nFamily {family_id}: {family_title}\n{statement}",
    formal.REPLY, ("formal_problem_statement",),
)
JOIN = Stage(
    "Two gaps were found independently. State a hypothesis that follows only from both, as JSON {\"hypothesis\", \"mechanism\", \"target\"}.\n\nGaps {ids}\nFirst ({first_motif}): {first}\nSecond ({second_motif}): {second}",
    "hypothesis string, mechanism string, target string", ("hypothesis",),
)


def _text(k: str, default: str = "") -> Column:
    return F.coalesce(F.col(f"p.{k}"), F.lit(default))


def expanded(rows: DataFrame, model: models.Model, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """A variant of each kind for every row (formulation_id, title, problem, seed_alignment_score): the reply's fields, ``passes_gate``, ``variant_score`` and ``problem``.

    A variant without a usable reply is recommended to be dropped and has the scores that no gate lets pass.
    """
    each = rows.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds]))).withColumn("id", F.concat_ws(":", F.col("formulation_id").cast("string"), "kind"))
    found = asked(each, EXPAND, model, {k: F.col(k) for k in ("kind", "formulation_id", "title", "problem")})
    bad = F.col("problem").isNotNull()
    worst = {**SCORES, "term_soup_risk": 1.0}
    out = found.select(
        F.col("id").alias("variant_id"), *[F.when(bad, "").otherwise(_text(k)).alias(k) for k in TEXTS],
        *[F.when(bad, worst[k]).otherwise(F.coalesce(F.col(f"p.{k}"), F.lit(v))).alias(k) for k, v in SCORES.items()],
        F.lower(F.when(bad, "medium").otherwise(_text("named_method_dependency", "medium"))).alias("named_method_dependency"),
        F.upper(F.when(bad, "DROP").otherwise(F.coalesce(F.nullif("p.recommendation", F.lit("")), F.lit("DROP")))).alias("recommendation"), "attempts", "problem",
    )
    given = each.select(F.col("id").alias("variant_id"), "formulation_id", "kind", F.concat_ws(": ", "title", "problem").alias("source"), F.coalesce("seed_alignment_score", F.lit(0.0)).alias("seed_alignment_score"))
    return given.join(out, "variant_id").withColumns({"passes_gate": formulations.generator_gate(), "variant_score": formulations.variant_score()})


def criticised(variants: DataFrame, model: models.Model) -> DataFrame:
    """The variants of :func:`expanded` with an independent judgement, ``passes_critic``, ``passes_final`` and ``critic_problem``; without a usable judgement none passes."""
    fields = {k: F.col(k) for k in ("variant_id", "kind", "source", "title", "problem_statement")}
    found = asked(variants.withColumn("id", F.col("variant_id")), CRITIC, model, fields)
    bad = F.col("problem").isNotNull()
    told = found.select(
        F.col("id").alias("variant_id"), *[F.when(bad, v).otherwise(F.coalesce(F.col(f"p.{k}"), F.lit(v))).alias(k) for k, v in CRITIC_SCORES.items()],
        *[(~bad & F.coalesce(F.col(f"p.{k}"), F.lit(False))).alias(k) for k in CRITIC_FLAGS], F.lower(F.when(bad, "weak").otherwise(_text("critic_supported_by_source", "weak"))).alias("critic_supported_by_source"),
        F.when(bad, "DROP").otherwise(F.col("p.critic_quality_label")).alias("critic_quality_label"), F.when(bad, "").otherwise(_text("critic_reason")).alias("critic_reason"), F.col("problem").alias("critic_problem"),
    )
    passed = variants.join(told, "variant_id").withColumn("passes_critic", formulations.critic_gate())
    return passed.withColumn("passes_final", F.col("passes_gate") & F.col("passes_critic"))


def formalised(families: DataFrame, model: models.Model) -> DataFrame:
    """One formal record for each family (the columns of ``formal.GROUNDS`` and family_id): from the reply, from its repair, or from the family's own texts (``origin``)."""
    families = families.drop("id", "reply", "attempts", "problem")
    fields = {"family_id": F.col("family_id"), "family_title": F.col("family_title"), "statement": F.col("representative_problem_statement")}
    found = asked(families.withColumn("id", F.col("family_id")), FORMALISE, model, fields).select(F.col("id").alias("family_id"), F.to_json("p").alias("reply"), "attempts", "problem")
    both = kept(families.join(found, "family_id"), "formalised")
    good = formal.normalised(both.where("problem IS NULL")).join(both.select("family_id", F.when(F.col("attempts") > 1, "repaired").otherwise("reply").alias("origin")), "family_id")
    bad = formal.fallback(both.where("problem IS NOT NULL"), "no usable reply after one repair").withColumn("origin", F.lit("fallback"))
    return good.unionByName(bad, allowMissingColumns=True)


def joined(rows: DataFrame, generation: int, model: models.Model) -> DataFrame:
    """Children of partners from different motifs whose joint hypothesis is long enough: (id, parents, motifs, statement, mechanism, target, novelty, feasibility, impact, survival).

    Rows are (id, motif_type, gap_id, gap, target, novelty, feasibility, impact, survival).  Partners are those of ``evolution.partners``; a pair without a usable reply has no child.
    """
    pairs = evolution.partners(rows, generation)
    side = lambda k: rows.select(F.col("id").alias(k), F.struct(*rows.columns).alias(k + "_"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("id", F.concat_ws("+", F.col("a").cast("string"), F.col("b").cast("string")))
    found = asked(both, JOIN, model, {"ids": F.col("id"), "first_motif": F.col("a_.motif_type"), "first": F.col("a_.gap"), "second_motif": F.col("b_.motif_type"), "second": F.col("b_.gap")})
    said = found.where("problem IS NULL").select("id", F.trim("p.hypothesis", F.lit(' "')).alias("statement"), F.trim(_text("mechanism")).alias("mechanism"), F.trim(_text("target")).alias("target"))
    mean = lambda k, bonus: F.least(F.lit(1.0), (F.col(f"a_.{k}") + F.col(f"b_.{k}")) / 2 + bonus).alias(k)
    return both.join(said.where(F.length("statement") >= LEAST_HYPOTHESIS), "id").select(
        "id", F.array("a", "b").alias("parents"), F.array("a_.motif_type", "b_.motif_type").alias("motifs"), "statement",
        F.coalesce(F.nullif("mechanism", F.lit("")), F.lit("Cross-motif synthesis: mechanism connecting independent gaps")).alias("mechanism"),
        F.coalesce(F.nullif("target", F.lit("")), "a_.target").alias("target"), mean("novelty", NOVELTY_BONUS), ((F.col("a_.feasibility") + F.col("b_.feasibility")) / 2).alias("feasibility"),
        mean("impact", IMPACT_BONUS), F.greatest("a_.survival", "b_.survival").alias("survival"), F.lit("cross_gap_synthesis").alias("operator"),
    )


# Labels that keep a candidate, and scores of a review.
ACCEPTABLE = ("STRONG_CANDIDATE", "POSSIBLE_WITH_REWRITE")
REVIEW_SCORES = ("deep_review_score", "evidence_strength", "remaining_gap_realness", "counterevidence_risk", "impossibility_risk", "already_solved_risk", "specificity", "feasibility", "project_concreteness")
REVIEW_TEXTS = ("main_reason", "falsification_condition", "clean_rewrite", "recommended_next_step")
REVIEW = Stage(
    "Review the hypothesis against its evidence, as JSON {\"review_label\", \"novelty_risk\", \"" + "\", \"".join((*REVIEW_SCORES, *REVIEW_TEXTS)) + "\"}.\n\nHypothesis {id}: {problem_statement}\nEvidence: {evidence_text}",
    ", ".join(["review_label string", "novelty_risk string", *(f"{k} string" for k in (*REVIEW_SCORES, *REVIEW_TEXTS))]), ("review_label",),
)
TITLE = Stage("Name the family of formulations in a short title, as JSON {\"title\"}. Name nothing that its members do not.\n\nFamily {family_id}: {family_title}\nMembers: {members}", "title string", ("title",))


def deeply_reviewed(rows: DataFrame, model: models.Model, keywords: tuple[str, ...]) -> DataFrame:
    """Reviews of rows (id, problem_statement, evidence_text, supporting_papers), one each: label, scores between 0 and 1, texts, ``problem``.

    The impossibility risk is the larger of the reply's and that of the keywords in the evidence; a certain one, or weak evidence from one paper at most, overrides a label that keeps the
    row.  Without a usable reply the label is WEAK_AFTER_READING.
    """
    found = asked(rows, REVIEW, model, {k: F.col(k) for k in ("id", "problem_statement", "evidence_text")})
    bad = F.col("problem").isNotNull()
    score = lambda k: F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.expr(f"try_cast(p.{k} AS double)"), F.lit(0.0)))))
    said = F.when(bad, "WEAK_AFTER_READING").otherwise(F.replace(F.upper(F.trim("p.review_label")), F.lit(" "), F.lit("_")))
    told = found.select("id", said.alias("review_label"), F.lower(F.when(bad, "medium").otherwise(_text("novelty_risk", "medium"))).alias("novelty_risk"), *[score(k).alias(k) for k in REVIEW_SCORES], *[F.when(bad, "").otherwise(_text(k)).alias(k) for k in REVIEW_TEXTS], "problem")
    given = evolution.reviewed(rows.select("id", "problem_statement", "evidence_text", "supporting_papers", F.lit("").alias("review_label")), keywords)
    both = given.drop("review_label").withColumnRenamed("impossibility_risk", "seen").join(told, "id").withColumn("impossibility_risk", F.greatest("impossibility_risk", "seen")).drop("seen")
    keeps, papers = F.col("review_label").isin(*ACCEPTABLE), F.greatest(F.size(F.coalesce("supporting_papers", F.array().cast("array<string>"))), F.lit(0))
    label = F.when(keeps & (F.col("impossibility_risk") >= 1), "DROP_IMPOSSIBLE").when(keeps & (papers <= 1) & (F.col("evidence_strength") < 0.4), "DROP_TOO_SINGLE_PAPER_FRAGILE").otherwise(F.col("review_label"))
    return both.withColumn("review_label", label)


def titled(families: DataFrame, model: models.Model) -> DataFrame:
    """Families (family_id, family_title, members, ...) with the title that a model gives; the own title stays where there is no usable reply."""
    found = asked(families.withColumn("id", F.col("family_id")), TITLE, model, {k: F.col(k) for k in ("family_id", "family_title", "members")})
    named = found.where("problem IS NULL").select(F.col("id").alias("family_id"), F.trim("p.title").alias("_named"))
    return families.join(named, "family_id", "left").withColumn("family_title", F.coalesce(F.nullif("_named", F.lit("")), "family_title")).drop("_named")
