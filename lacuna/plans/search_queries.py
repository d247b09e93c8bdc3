"""Search plans and model stages over the tables in those roles, with their DuckDB equivalents."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import evolution, model_stages, reply_rules, search_plans
from lacuna.plans.views import table
from lacuna.scratch import shared_dir
from lacuna.sources import paged

_KNOWN = ["and the", "of the", "the"]
_CATEGORIES = ["cs.LG", "math.OC", "stat.ML"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of documents as search texts; every seventh speaks of robustness, every eleventh of theory."""
    d = F.col("doc_id")
    tail = F.concat(F.when(d % 7 == 0, " Robust estimation").otherwise(""), F.when(d % 11 == 0, " theory \"exact phrase\"").otherwise(""))
    return table(spark, sf_dir, "documents").select(d.alias("qid"), F.concat(F.coalesce(F.substring_index("text", "\n", 1), F.lit("")), tail).alias("text"))


def query_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("qid", F.array_join(search_plans.phrases("text"), "|").alias("phrases"))


def fielded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("qid", search_plans.fielded("text", _KNOWN).alias("fielded"))


def query_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search_plans.facets(_lines(spark, sf_dir), _CATEGORIES, 2018, ["survey"])
    joined = lambda c: F.array_join(c, " ").alias(c)
    return found.select("qid", "place", "label", joined("keywords"), joined("include"), joined("exclude"), joined("categories"), "min_year")


# --- model stages with a stand-in that follows from the prompt ---


def _stand_in(prompt: str) -> str:
    """Every third paper's first reply is no JSON, every ninth's second one neither; claims are the words beside the colon of each line."""
    number = int(re.search(r"(?:Paper|Gap:) (\d+)", prompt)[1])
    repaired = "could not be used" in prompt
    if number % 9 == 0 or number % 3 == 0 and not repaired:
        return "I think so." if number % 2 else '{"other": 1}'
    if "Gap:" in prompt:
        return "Sure: " + json.dumps({"title": f"T{number}", "problem_statement": f"Solve {number}", "recommendation": "keep" if number % 2 else None, "coherence_score": number % 13 / 10, "specificity_score": None})
    claims = [{"subject": f"m{number}", "relation": r, "object": f"o{number % 5}", "evidence_text": "e", "claim_type": "claim", "polarity": "positive", "confidence": 0.5, "subject_scope": "own_method", "condition": ""} for r in ("Outperforms", "limited_by")[: 1 + number % 2]]
    return json.dumps({"tuples": claims})


def model_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of documents through the extraction stage; papers without a usable reply with the reason."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = model_stages.extracted(texts, _stand_in)
    return found.select("paper_id", F.coalesce("t.subject", F.lit("")).alias("subject"), F.coalesce("t.relation", F.lit("")).alias("relation"), F.coalesce("t.object", F.lit("")).alias("object"), F.coalesce("problem", F.lit("")).alias("problem"))


def direct_formulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as gaps through the formulation stage; gaps without a usable reply are dropped, not lost."""
    gaps = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gap_id"), F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name").alias("gap"))
    found = model_stages.formulated(gaps, _stand_in)
    return found.select("gap_id", "title", "problem_statement", "recommendation", F.round("coherence_score", 6).alias("coherence_score"), "specificity_score", F.coalesce("error", F.lit("")).alias("error"))


# --- paged listings ---


def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents served in pages of 100 a language, from 2010 on, pages 1 and later."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(F.col("lang").alias("venue"), d.cast("string").alias("id"), F.substring_index("text", "\n", 1).alias("title"), (2000 + d % 20).cast("int").alias("year"), d.alias("place"))
    service = paged.Served.write(rows, f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}", 100)
    found = paged.listed(spark, service, sorted(service.counts), 100)
    return found.where("venue IN ('de', 'en', 'fr') AND year >= 2010 AND page >= 1").select("venue", "page", F.col("id").cast("long").alias("doc_id"), "title", "year")


# --- partners ---


def evolution_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates of motifs (priorities) and gaps (clerks): how many have a partner of another motif, how many of another gap only."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("motif_type"), (F.col("o_custkey") % 50).cast("string").alias("gap_id"))
    pairs = evolution.partners(rows, 3)
    side = lambda s: rows.select(F.col("id").alias(s), F.col("motif_type").alias(f"{s}m"), F.col("gap_id").alias(f"{s}g"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.groupBy(F.col("am").alias("motif_type")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("b").alias("partners"), F.count_if(F.col("am") != F.col("bm")).alias("other_motif"), F.count_if((F.col("am") == F.col("bm")) & (F.col("ag") == F.col("bg"))).alias("same_gap"))


# --- whole replies ---

_CRITERIA = ("evidence_grounding", "formalizability", "overall_worth_reading", "actionability")


def whole_reply_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as whole replies of three modes: what is refused in them, special winners, justifications."""
    k = F.col("o_orderkey")
    s = lambda n: F.when(k % n == 0, F.lit("x"))
    special = [F.when(k % 7 == i, F.lit(None)).otherwise(F.struct(F.when(k % 11 == i, "zz").otherwise(F.concat(F.lit("c"), k % 4)).alias("candidate_id"), F.when(k % 13 == i, " ").otherwise("why").alias("reason"))).alias(n) for i, n in enumerate(reply_rules.SPECIAL)]
    why = F.map_filter(F.create_map(*[x for i, c in enumerate(_CRITERIA) for x in (F.lit(c), F.when(k % 5 == i, "").otherwise("because"))]), lambda c, _: ~((k % 17 == 0) & (c == "formalizability")))
    reply = F.to_json(F.struct(
        s(19).alias("scores"), s(23).alias("pairwise_preference"), F.when(k % 29 == 0, "Weighted_Composite 3").alias("notes"), F.array(*[F.concat(F.lit("c"), F.lit(str(i))) for i in range(3)], F.when(k % 6 == 0, "other").otherwise("c3")).alias("candidate_ids"),
        *special, F.when(k % 10 == 0, "maybe").otherwise("HIGH").alias("confidence"), F.when(k % 31 == 0, "like the Baseline Method").otherwise("n").alias("domain_level_notes"), F.when(k % 37 != 0, why).alias("score_justification"),
    ))
    rows = table(spark, sf_dir, "orders").select(k, reply.alias("reply"))
    joined = lambda x: F.array_join(F.array_sort(x), ";")
    return rows.select(
        "o_orderkey", joined(reply_rules.refused("preference")).alias("preference"), joined(F.concat(reply_rules.refused("ranking"), reply_rules.special_winners(F.array(*[F.lit(f"c{i}") for i in range(4)])))).alias("ranking"),
        joined(F.concat(reply_rules.refused("independent"), reply_rules.justifications(_CRITERIA))).alias("independent"), joined(reply_rules.refused("batch")).alias("batch"),
    )


def _strings(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]::VARCHAR[]"


_LINES_SQL = """q AS (SELECT doc_id AS qid, coalesce(split_part(text, chr(10), 1), '') || CASE WHEN doc_id % 7 = 0 THEN ' Robust estimation' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN ' theory "exact phrase"' ELSE '' END AS text FROM documents)"""
_WORDS_SQL = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: length(w) > 2)"
_FIRSTS = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def _fielded_sql() -> str:
    at, names = "r0", []
    steps = [f"f0 AS (SELECT *, regexp_extract_all(text, '\"([^\"]+)\"', 1) AS quoted, trim(lower(regexp_replace(text, '\"[^\"]+\"', '', 'g'))) AS r0 FROM q)"]
    for i, p in enumerate(sorted(_KNOWN, key=len, reverse=True), 1):
        steps.append(f"f{i} AS (SELECT *, CASE WHEN contains({at}, '{p}') THEN '{p}' END AS n{i}, replace({at}, '{p}', ' ') AS r{i} FROM f{i - 1})")
        at = f"r{i}"
        names.append(f"n{i}")
    return f"""WITH {_LINES_SQL}, {', '.join(steps)},
        g AS (SELECT qid, text, list_concat(quoted, list_filter([{', '.join(names)}], lambda x: x IS NOT NULL)) AS found, list_filter(regexp_split_to_array({at}, '\\s+'), lambda w: length(w) > 3 AND regexp_full_match(w, '\\p{{L}}+')) AS words FROM f{len(names)})
        SELECT qid, CASE WHEN contains(text, 'ti:') OR contains(text, 'abs:') OR contains(text, 'au:') OR contains(text, 'cat:') THEN text
          WHEN len(found) > 0 THEN array_to_string(list_transform(found, lambda p: '(ti:"' || p || '" OR abs:"' || p || '")'), ' AND ')
          WHEN len(words) > 0 THEN '(' || array_to_string(list_transform(words[:4], lambda w: '(ti:' || w || ' OR abs:' || w || ')'), ' OR ') || ')' ELSE text END AS fielded FROM g"""


def _facets_sql() -> str:
    values = ", ".join(f"({i}, '{label}', {_strings(cues)}, {_strings(search_plans.ANYWHERE.get(label, ()))}, {_strings(more)}, {_strings(needed)}, {str(narrow).upper()})" for i, (label, cues, more, needed, narrow) in enumerate(search_plans.RULES))
    few = [c for c in _CATEGORIES if c in search_plans.NARROW]
    return f"""WITH {_LINES_SQL}, r AS (SELECT * FROM (VALUES {values}) t(i, label, cues, inside, more, needed, narrow)),
        w AS (SELECT qid, lower(text) AS low, {_WORDS_SQL} AS words FROM q), w2 AS (SELECT *, list_filter(words, lambda x: NOT list_contains({_strings(search_plans.CORE_STOPS)}, x)) AS c FROM w),
        w3 AS (SELECT *, {_FIRSTS.format('c')} AS core FROM w2),
        m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY i) AS place FROM w3, r WHERE len(cues) = 0 OR list_has_any(words, cues) OR len(list_filter(inside, lambda x: contains(low, x))) > 0)
        SELECT qid, CAST(place AS INTEGER) AS place, label, array_to_string(CASE WHEN len(more) > 0 THEN list_concat(core[:3], more) ELSE core[:5] END, ' ') AS keywords,
          array_to_string(CASE WHEN len(needed) = 0 THEN core[:3] WHEN narrow THEN needed ELSE list_concat(core[:2], needed) END, ' ') AS include, 'survey' AS exclude,
          CASE WHEN narrow THEN '{' '.join(few)}' ELSE '{' '.join(_CATEGORIES)}' END AS categories, 2018::INTEGER AS min_year FROM m"""


_PROBLEM = "CASE WHEN {0} % 2 = 1 THEN 'ValueError: no JSON object in the reply' ELSE 'missing: {1}' END"



def _whole_sql() -> str:
    def listed(rules: list[tuple[str, str]]) -> str:
        return "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for test, name in rules) + "], lambda x: x IS NOT NULL)), ';')"

    scores, preference, composite = ("k % 19 = 0", "refused:scores"), ("k % 23 = 0", "refused:pairwise_preference"), ("k % 29 = 0", "refused:composite")
    special = [(f"k % 7 = {i}", f"no_object:{n}") for i, n in enumerate(reply_rules.SPECIAL)]
    special += [(f"k % 7 <> {i} AND k % 11 = {i}", f"unknown:{n}") for i, n in enumerate(reply_rules.SPECIAL)] + [(f"k % 7 <> {i} AND k % 13 = {i}", f"no_reason:{n}") for i, n in enumerate(reply_rules.SPECIAL)]
    why = [("k % 37 = 0", "no_justifications")] + [(f"k % 37 <> 0 AND (k % 5 = {i}" + (" OR k % 17 = 0)" if c == "formalizability" else ")"), f"no_justification:{c}") for i, c in enumerate(_CRITERIA)]
    ranking = [scores, preference, composite, ("k % 6 = 0", "candidate_ids"), *special, ("k % 10 = 0", "invalid_confidence"), ("k % 31 = 0", "method_label")]
    return f"""SELECT k AS o_orderkey, {listed([scores, composite])} AS preference, {listed(ranking)} AS ranking, {listed([preference, composite, *why])} AS independent, {listed([preference, composite])} AS batch FROM (SELECT o_orderkey AS k FROM orders)"""


ORACLE_SQL = {
    "paged_listing": """SELECT lang AS venue, CAST(doc_id // 100 AS INTEGER) AS page, doc_id, split_part(text, chr(10), 1) AS title, CAST(2000 + doc_id % 20 AS INTEGER) AS year FROM documents WHERE lang IN ('de', 'en', 'fr') AND doc_id % 20 >= 10 AND doc_id // 100 >= 1""",
    "evolution_partners": "SELECT o_orderpriority AS motif_type, count(*) AS n, count(*) AS partners, count(*) AS other_motif, 0::BIGINT AS same_gap FROM orders GROUP BY 1",
    "whole_reply_rules": _whole_sql(),
    "query_phrases": f"""WITH {_LINES_SQL}, w AS (SELECT qid, list_filter({_WORDS_SQL}, lambda x: NOT list_contains({_strings(search_plans.STOPS)}, x)) AS w FROM q), l AS (SELECT qid, CASE WHEN len(w) > 0 THEN list_prepend(array_to_string(w, ' '), w) ELSE [] END AS l FROM w)
        SELECT qid, array_to_string(({_FIRSTS.format('l')})[:8], '|') AS phrases FROM l""",
    "fielded_queries": _fielded_sql(),
    "query_facets": _facets_sql(),
    "model_extraction": f"""SELECT doc_id AS paper_id, 'm' || doc_id AS subject, 'improves_over' AS relation, 'o' || doc_id % 5 AS object, '' AS problem FROM documents WHERE doc_id % 9 <> 0
        UNION ALL SELECT doc_id, 'm' || doc_id, 'limited_by', 'o' || doc_id % 5, '' FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 2 = 1
        UNION ALL SELECT doc_id, '', '', '', {_PROBLEM.format('doc_id', 'tuples')} FROM documents WHERE doc_id % 9 = 0""",
    "direct_formulations": f"""SELECT p_partkey AS gap_id, CASE WHEN b THEN '' ELSE 'T' || p_partkey END AS title, CASE WHEN b THEN '' ELSE 'Solve ' || p_partkey END AS problem_statement, CASE WHEN b THEN 'DROP' WHEN p_partkey % 2 = 1 THEN 'KEEP' ELSE 'MAYBE' END AS recommendation,
        CASE WHEN b THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, (p_partkey % 13)::DOUBLE / 10), 6) END AS coherence_score, 0.0::DOUBLE AS specificity_score, CASE WHEN b THEN {_PROBLEM.format('p_partkey', 'title, problem_statement')} ELSE '' END AS error FROM (SELECT *, p_partkey % 9 = 0 AS b FROM part)""",
}

QUERIES = {f.__name__: f for f in (query_phrases, fielded_queries, query_facets, model_extraction, direct_formulations, paged_listing, evolution_partners, whole_reply_rules)}
