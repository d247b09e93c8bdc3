"""Queries of the stages that widen, criticise, formalise and join formulations, with stand-ins whose replies follow from the prompts' numbers."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import expansion
from lacuna.plans.formulation_queries import _families
from lacuna.plans.views import table


def _answer(prompt: str, number: int, reply: dict) -> str:
    """Numbers that 9 divides are never answered well, those that 3 divides only when asked again."""
    if number % 9 == 0 or number % 3 == 0 and "could not be used" not in prompt:
        return "I think so." if number % 2 else '{"other": 1}'
    return "Sure: " + json.dumps(reply)


def _writer(prompt: str) -> str:
    n, bold = int(re.search(r"Formulation (\d+)", prompt)[1]), " a bold " in prompt
    return _answer(prompt, n, {
        "title": f"T{n}", "problem_statement": "p", "broader_problem_class": "c", "why_not_just_validation": "w", "contribution_type": "benchmark", "method_class_scope": "all" if bold else " ",
        "named_method_dependency": "High" if n % 2 else "low", "recommendation": ["keep", "MAYBE", None, "drop"][n % 4],
        "coherence_score": (n % 5 + 6) / 10, "specificity_score": 0.6, "term_soup_risk": n % 5 / 10, "non_incrementality_score": 0.7 if n % 8 else None, "incrementality_risk": n % 6 / 10,
    })


def _judge(prompt: str) -> str:
    n = int(re.search(r"Variant (\d+):", prompt)[1])
    return _answer(prompt, n + 1, {
        "critic_non_incrementality_score": (n % 5 + 6) / 10, "critic_incrementality_risk": 0.1 if n % 10 else None, "critic_fake_ambition_risk": n % 7 / 10,
        "critic_broader_problem_class_valid": True, "critic_contribution_type_valid": True if n % 11 else None, "critic_supported_by_source": "Strong" if n % 13 else "weak",
        "critic_quality_label": "VALID_BUT_MODEST",
    })


def _formaliser(prompt: str) -> str:
    n = int(re.search(r"Family (\d+)", prompt)[1])
    return _answer(prompt, n, {"formal_problem_statement": f"S{n}", "requires_human_definition": n % 2 == 0, "formalization_confidence": "high" if n % 4 else "low"})


def _joiner(prompt: str) -> str:
    n = int(re.search(r"Gaps (\d+)", prompt)[1])
    return _answer(prompt, n, {"hypothesis": "too short" if n % 7 == 0 else f'"The problem of {n} joins both"', "mechanism": "m" if n % 2 else "", "target": None if n % 4 == 0 else f"T{n}"})


def _reviewer(prompt: str) -> str:
    n = int(re.search(r"Hypothesis (\d+)", prompt)[1])
    return _answer(prompt, n, {"review_label": ["strong candidate", "WEAK_AFTER_READING", " Possible_With_Rewrite "][n % 5 % 3], "evidence_strength": [0.39, "0.4", "weak", None][n % 4], "impossibility_risk": n % 13 / 10, "specificity": -1})


def expanded_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three variants of every part, judged by a second model: gates, attempts and what went wrong."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("formulation_id"), F.col("p_name").alias("title"), F.col("p_type").alias("problem"), F.lit(0.5).alias("seed_alignment_score"))
    found = expansion.criticised(expansion.expanded(rows, _writer), _judge)
    wrong = lambda k: F.col(k).isNotNull().alias(k)
    return found.select("variant_id", "formulation_id", "kind", "recommendation", "passes_gate", "passes_critic", "passes_final", F.round("variant_score", 6).alias("variant_score"), "critic_quality_label", wrong("problem"), wrong("critic_problem"))


def formal_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formal record for every family of the documents: from the reply, its repair, or the family's own texts."""
    found = expansion.formalised(_families(spark, sf_dir), _formaliser)
    return found.select("family_id", "origin", F.when(F.col("origin") == "fallback", F.substring("formal_problem_statement", 1, 23)).otherwise(F.col("formal_problem_statement")).alias("statement"), "requires_human_definition")


def joint_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates of five motifs: the children of partners whose joint hypothesis is long enough."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_orderpriority").alias("motif_type"), (F.col("o_custkey") % 50).cast("string").alias("gap_id"), F.concat(F.lit("gap "), k).alias("gap"), F.concat(F.lit("t"), k).alias("target"),
        *[F.lit(v).alias(c) for c, v in (("novelty", 0.5), ("feasibility", 0.25), ("impact", 0.95), ("survival", 0.75))],
    )
    found = expansion.joined(rows, 3, _joiner)
    first = F.get("parents", F.lit(0))
    return found.select(
        first.alias("first"), F.get("motifs", F.lit(0)).alias("motif"), (F.get("motifs", F.lit(0)) != F.get("motifs", F.lit(1))).alias("different"), "statement", (F.col("mechanism") == "m").alias("told"), "target",
        F.round("novelty", 6).alias("novelty"), "feasibility", "impact", "survival",
    )


def deep_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as hypotheses with their texts as evidence: reviews with both overrides."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        k.alias("id"), F.concat(F.lit("p"), k).alias("problem_statement"), F.coalesce("text", F.lit("")).alias("evidence_text"), F.slice(F.array(F.lit("a"), F.lit("b")), 1, (k % 3).cast("int")).alias("supporting_papers"),
    )
    found = expansion.deeply_reviewed(rows, _reviewer, ("license", "apache", "token"))
    return found.select("id", "review_label", "novelty_risk", F.round("impossibility_risk", 6).alias("impossibility_risk"), "evidence_strength", "specificity", F.col("problem").isNotNull().alias("problem"))


ORACLE_SQL = {
    "expanded_variants": f"""WITH v AS (SELECT p_partkey AS n, kind, p_partkey % 9 = 0 AS bad, (p_partkey + 1) % 9 = 0 AS cbad FROM part, (VALUES ('conservative'), ('generalized'), ('bold')) k(kind)),
        s AS (SELECT *, CASE WHEN bad THEN 'DROP' ELSE ['KEEP', 'MAYBE', 'DROP', 'DROP'][n % 4 + 1] END AS rec,
            NOT bad AND n % 4 < 2 AND n % 5 >= 2 AND n % 5 <= 3 AND n % 8 <> 0 AND n % 6 <= 4 AND (n % 2 = 0 OR kind = 'bold') AS g,
            NOT cbad AND n % 5 >= 1 AND n % 10 <> 0 AND n % 7 <= 3 AND n % 11 <> 0 AND n % 13 <> 0 AS c FROM v)
        SELECT n || ':' || kind AS variant_id, n AS formulation_id, kind, rec AS recommendation, g AS passes_gate, c AS passes_critic, g AND c AS passes_final,
            CASE WHEN bad THEN -0.75::DOUBLE ELSE round(1.5::DOUBLE * CASE WHEN n % 8 = 0 THEN 0.0::DOUBLE ELSE 0.7::DOUBLE END + (n % 5 + 6)::DOUBLE / 10 + 0.6::DOUBLE - (n % 6)::DOUBLE / 10 + 0.25::DOUBLE, 6) END AS variant_score,
            CASE WHEN cbad THEN 'DROP' ELSE 'VALID_BUT_MODEST' END AS critic_quality_label, bad AS problem, cbad AS critic_problem FROM s""",
    "formal_stage": """SELECT doc_id AS family_id, CASE WHEN doc_id % 9 = 0 THEN 'fallback' WHEN doc_id % 3 = 0 THEN 'repaired' ELSE 'reply' END AS origin,
        CASE WHEN doc_id % 9 = 0 THEN 'The question is whether' ELSE 'S' || doc_id END AS statement, doc_id % 9 = 0 OR doc_id % 2 = 0 AS requires_human_definition FROM documents""",
    "joint_hypotheses": """SELECT o_orderkey AS first, o_orderpriority AS motif, true AS different, 'The problem of ' || o_orderkey || ' joins both' AS statement, o_orderkey % 2 = 1 AS told,
        CASE WHEN o_orderkey % 4 = 0 THEN 't' ELSE 'T' END || o_orderkey AS target, 0.65::DOUBLE AS novelty, 0.25::DOUBLE AS feasibility, 1.0::DOUBLE AS impact, 0.75::DOUBLE AS survival
        FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 7 <> 0""",
    "deep_reviews": """WITH h AS (SELECT doc_id AS n, doc_id % 9 = 0 AS bad, doc_id % 3 AS papers, contains(lower(coalesce(text, '')), 'license')::INT + contains(lower(coalesce(text, '')), 'apache')::INT + contains(lower(coalesce(text, '')), 'token')::INT AS hits FROM documents),
        s AS (SELECT *, CASE WHEN bad THEN 'WEAK_AFTER_READING' ELSE ['STRONG_CANDIDATE', 'WEAK_AFTER_READING', 'POSSIBLE_WITH_REWRITE'][n % 5 % 3 + 1] END AS said, CASE WHEN bad THEN 0.0::DOUBLE ELSE [0.39::DOUBLE, 0.4::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE][n % 4 + 1] END AS e,
            greatest(CASE WHEN bad THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, (n % 13)::DOUBLE / 10) END, CASE WHEN hits >= 2 THEN 1.0::DOUBLE WHEN hits = 1 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END) AS r FROM h)
        SELECT n AS id, CASE WHEN said <> 'WEAK_AFTER_READING' AND r >= 1 THEN 'DROP_IMPOSSIBLE' WHEN said <> 'WEAK_AFTER_READING' AND least(papers, 2) <= 1 AND e < 0.4 THEN 'DROP_TOO_SINGLE_PAPER_FRAGILE' ELSE said END AS review_label,
            'medium' AS novelty_risk, round(r, 6) AS impossibility_risk, e AS evidence_strength, 0.0::DOUBLE AS specificity, bad AS problem FROM s""",
}

QUERIES = {f.__name__: f for f in (expanded_variants, formal_stage, joint_hypotheses, deep_reviews)}
