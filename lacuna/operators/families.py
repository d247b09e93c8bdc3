"""Formulation variants: gates, merging into families, rollups and quality grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.text import jaccard
from lacuna.operators.similarity import components


def passes_generator(r: DataFrame) -> Column:
    """Gate of a generated variant: coherence, specificity, term soup, non-incrementality, risk, and a text."""
    c = F.col
    return (c("coherence") >= 0.75) & (c("specificity") >= 0.60) & (c("soup") <= 0.30) & (c("ni") >= 0.70) & (c("risk") <= 0.40) & (F.trim(F.coalesce("text", F.lit(""))) != "")


def passes_critic() -> Column:
    return (F.col("critic_ni") >= 0.70) & (F.col("critic_risk") <= 0.40) & (F.col("fake") <= 0.35)


def variant_score() -> Column:
    return 1.5 * F.col("ni") + F.col("ambition") + F.col("coherence") + F.col("specificity") - F.col("risk") + 0.5 * F.col("seed")


def family_links(rows: DataFrame) -> DataFrame:
    """Links (a, b, rule) between variants (id, source, gap_id, papers, tokens): same source, same gap, or half of the papers and two tokens in common.

    Equal keys link to the least id of the key; papers block the third rule, so no pairs of unrelated variants are made.
    """
    out = None
    for rule, key in (("source", "source"), ("gap", "gap_id")):
        least = rows.groupBy(key).agg(F.min("id").alias("a"))
        links = rows.join(least, key).where("id <> a").select("a", F.col("id").alias("b"), F.lit(rule).alias("rule"))
        out = links if out is None else out.unionByName(links)
    x = rows.select(F.col("id").alias("a"), F.col("papers").alias("pa"), F.col("tokens").alias("ta"), F.explode("papers").alias("p"))
    y = rows.select(F.col("id").alias("b"), F.col("papers").alias("pb"), F.col("tokens").alias("tb"), F.explode("papers").alias("p"))
    near = x.join(y, "p").where((F.col("a") < F.col("b")) & (jaccard("pa", "pb") >= 0.50) & (F.size(F.array_intersect("ta", "tb")) >= 2))
    return out.unionByName(near.select("a", "b", F.lit("papers").alias("rule")).distinct())


def families(rows: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each family: representative (largest ni, least fake, least id), members, papers, best scores."""
    named = components(rows.select("id"), links.select("a", "b"))
    return rows.join(named, "id").groupBy(F.col("component").alias("family_id")).agg(
        F.max_by("id", F.struct("ni", (-F.col("fake")).alias("f"), (-F.col("id")).alias("i"))).alias("representative"),
        F.sort_array(F.collect_list("id")).alias("members"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("papers")))).alias("papers"),
        F.max("ni").alias("ni"), F.max("specificity").alias("specificity"), F.min("fake").alias("fake"), F.max("feasibility").alias("feasibility"),
        F.max("support").alias("support"), F.bool_or(F.col("label").isin("FAKE_AMBITION", "DROP", "INCREMENTAL_REPHRASING")).alias("flagged"),
        F.max("fit").alias("fit"),
    )


def level(x: Column, high: float, middle: float) -> Column:
    return F.when(x >= high, "strong").when(x >= middle, "moderate").otherwise("weak")


def graded(rows: DataFrame) -> DataFrame:
    """Adds grade A to D and the action to families (ni, specificity, feasibility, fake, support in words, fit in words, flagged)."""
    ni, spec = level(F.col("ni"), 0.85, 0.70), level(F.col("specificity"), 0.80, 0.60)
    plausible = F.when((F.col("feasibility") >= 0.70) & (F.col("fake") <= 0.20), "strong").when((F.col("fake") >= 0.35) | (F.col("feasibility") < 0.50), "weak").otherwise("moderate")
    at_least = lambda x: x.isin("strong", "moderate")
    s, fit = F.col("support"), F.col("fit")
    grade = (
        F.when((fit == "weak") | F.col("flagged") | (plausible == "weak"), "D")
        .when(at_least(s) & (ni == "strong") & at_least(spec) & at_least(plausible) & (fit == "strong"), "A")
        .when(at_least(ni) & ((spec == "weak") | (s == "weak") | (fit == "moderate")), "B")
        .otherwise("C")
    )
    action = F.create_map(*[F.lit(x) for kv in {"A": "READ_FIRST", "B": "REFRAME", "C": "READ_LATER", "D": "DROP"}.items() for x in kv])
    return rows.withColumn("grade", grade).withColumn("action", action[F.col("grade")])
