"""Stages that widen, criticise, formalise and join: bad replies, gates, defaults, ties and empty tables."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lacuna.operators import expansion, formal, models

GOOD = {
    "title": "T", "problem_statement": "P", "broader_problem_class": "c", "why_not_just_validation": "w", "recommendation": "keep", "coherence_score": 0.75, "specificity_score": 0.6,
    "term_soup_risk": 0.3, "non_incrementality_score": 0.7, "incrementality_risk": 0.4, "ambition_score": 0.5,
}
JUDGED = {
    "critic_non_incrementality_score": 0.7, "critic_incrementality_risk": 0.4, "critic_fake_ambition_risk": 0.35, "critic_broader_problem_class_valid": True, "critic_contribution_type_valid": True,
    "critic_supported_by_source": "Moderate", "critic_quality_label": "STRONG_NON_INCREMENTAL",
}
FORMULATIONS = "formulation_id long, title string, problem string, seed_alignment_score double"


def made(spark, n=3):
    return spark.createDataFrame([(i, f"t{i}" if i else None, "p", None if i == 1 else 1.0) for i in range(n)], FORMULATIONS)


def test_three_variants_at_the_gates_bounds(spark):
    rows = expansion.criticised(expansion.expanded(made(spark), lambda p: json.dumps(GOOD)), lambda p: json.dumps(JUDGED)).collect()
    assert sorted(r.variant_id for r in rows) == sorted(f"{i}:{k}" for i in range(3) for k in expansion.KINDS)
    assert all(r.passes_gate and r.passes_critic and r.passes_final and r.problem is None for r in rows)
    score = {r.formulation_id: r.variant_score for r in rows}
    assert score[0] == pytest.approx(1.5 * 0.7 + 0.5 + 0.75 + 0.6 - 0.4 + 0.5) and score[1] == pytest.approx(score[0] - 0.5)


@pytest.mark.parametrize("field,value", [("coherence_score", 0.74), ("incrementality_risk", None), ("non_incrementality_score", None), ("recommendation", None), ("why_not_just_validation", " "), ("named_method_dependency", "HIGH")])
def test_what_is_missing_counts_against_a_variant(spark, field, value):
    rows = expansion.expanded(made(spark, 1), lambda p: json.dumps({**GOOD, field: value})).collect()
    assert len(rows) == 3 and not any(r.passes_gate for r in rows)


@pytest.mark.parametrize("field,value", [("critic_fake_ambition_risk", 0.36), ("critic_incrementality_risk", None), ("critic_contribution_type_valid", None), ("critic_supported_by_source", "weak"), ("critic_quality_label", "DROP")])
def test_what_the_critic_leaves_out_counts_too(spark, field, value):
    variants = expansion.expanded(made(spark, 1), lambda p: json.dumps(GOOD))
    rows = expansion.criticised(variants, lambda p: json.dumps({**JUDGED, field: value})).collect()
    assert len(rows) == 3 and all(r.passes_gate and not r.passes_critic and not r.passes_final for r in rows)


def test_models_that_fail_lose_no_row(spark):
    def broken(prompt):
        raise RuntimeError("down")

    rows = expansion.criticised(expansion.expanded(made(spark), broken), broken).collect()
    assert len(rows) == 9 and {(r.recommendation, r.critic_quality_label, r.attempts) for r in rows} == {("DROP", "DROP", 2)}
    assert not any(r.passes_gate or r.passes_critic for r in rows) and all("down" in r.problem and "down" in r.critic_problem for r in rows)
    assert expansion.expanded(made(spark).limit(0), broken).count() == 0


def test_the_critic_does_not_see_the_writers_scores(spark):
    def judge(prompt):
        return json.dumps({**JUDGED, "critic_reason": prompt.partition("Source: ")[2]})

    for r in expansion.criticised(expansion.expanded(made(spark, 1), lambda p: json.dumps(GOOD)), judge).collect():
        assert r.critic_reason == f"p\nVariant {r.variant_id} ({r.kind}): T\nP" and "0.75" not in r.critic_reason


def test_formal_records_by_origin(spark):
    def model(prompt):
        i = int(prompt.split("Family ")[1][0])
        if i == 2 or i == 1 and "could not be used" not in prompt:
            return "none"
        return json.dumps({"formal_problem_statement": f"S{i}", "requires_human_definition": False})

    given = spark.createDataFrame([(i,) for i in range(3)], "family_id long").select("family_id", *[F.lit(None if c == "problem_class" else "a robust policy").cast("string").alias(c) for c in formal.GROUNDS], F.lit("clash").alias("reply"))
    got = {r.family_id: r for r in expansion.formalised(given, model).collect()}
    assert {i: r.origin for i, r in got.items()} == {0: "reply", 1: "repaired", 2: "fallback"}
    assert (got[0].formal_problem_statement, got[1].formal_problem_statement) == ("S0", "S1") and got[2].formal_problem_statement.startswith("The question is whether a robust policy")
    assert got[2].requires_human_definition and got[2].formalization_confidence == "low" and got[2].formalization_risk and not got[0].requires_human_definition
    assert expansion.formalised(given.limit(0), model).count() == 0


def test_joint_hypotheses(spark):
    rows = [(i, "AB"[i % 2], f"g{i}", f"gap {i}", f"t{i}", 0.9, 0.2 + i / 100, 0.95 if i else 0.1, i / 10) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, motif_type string, gap_id string, gap string, target string, novelty double, feasibility double, impact double, survival double")
    got = expansion.joined(df, 1, lambda p: json.dumps({"hypothesis": ' "twenty characters...." ', "mechanism": None, "target": ""})).collect()
    by = {r[0]: r for r in rows}
    assert sorted(r.parents[0] for r in got) == list(range(10))
    for r in got:
        a, b = (by[i] for i in r.parents)
        assert a[1] != b[1] and r.motifs == [a[1], b[1]] and r.statement == "twenty characters...." and r.target == a[4] and r.mechanism.startswith("Cross-motif")
        assert r.novelty == 1.0 and r.impact == pytest.approx(min(1.0, (a[7] + b[7]) / 2 + 0.10)) and r.feasibility == pytest.approx((a[6] + b[6]) / 2) and r.survival == max(a[8], b[8])
    assert expansion.joined(df, 1, lambda p: '{"hypothesis": "nineteen characters"}').count() == 0


def test_reviews_and_their_overrides(spark):
    rows = [(1, "p", "It is impossible; a lower bound holds.", ["a", "b"]), (2, "p", "fine", ["a"]), (3, "p", "fine", None), (4, "p", None, ["a", "b"]), (5, "p", "", ["a", "b"])]
    df = spark.createDataFrame(rows, "id long, problem_statement string, evidence_text string, supporting_papers array<string>")
    replies = {1: {}, 2: {"evidence_strength": 0.3}, 3: {"evidence_strength": "0.9"}, 4: {"impossibility_risk": 7}, 5: {"review_label": None}}

    def model(prompt):
        i = int(prompt.split("Hypothesis ")[1][0])
        return json.dumps({"review_label": "strong candidate", **replies[i]})

    got = {r.id: r for r in expansion.deeply_reviewed(df, model, ("impossible", "lower bound")).collect()}
    assert {i: r.review_label for i, r in got.items()} == {1: "DROP_IMPOSSIBLE", 2: "DROP_TOO_SINGLE_PAPER_FRAGILE", 3: "STRONG_CANDIDATE", 4: "DROP_IMPOSSIBLE", 5: "WEAK_AFTER_READING"}
    assert got[4].impossibility_risk == 1.0 and got[3].evidence_strength == 0.9 and got[5].problem and got[1].problem is None


def test_titles_stay_without_a_reply(spark):
    df = spark.createDataFrame([(1, "own", "m", 5), (2, "own", "m", 6), (3, "own", "m", 7)], "family_id long, family_title string, members string, extra int")
    model = lambda p: {"1": '{"title": " New "}', "2": '{"title": " "}'}.get(p.split("Family ")[1][0], "no")
    assert sorted(map(tuple, expansion.titled(df, model).select("family_id", "family_title", "extra").collect())) == [(1, "New", 5), (2, "own", 6), (3, "own", 7)]


def test_a_call_that_takes_too_long():
    slow = models.timed(lambda p: time.sleep(5) or "late", 0.1)
    with pytest.raises(TimeoutError):
        slow("x")
    assert models.timed(lambda p: p + "!", 5)("x") == "x!"
    with pytest.raises(ZeroDivisionError):
        models.timed(lambda p: 1 / 0, 5)("x")
