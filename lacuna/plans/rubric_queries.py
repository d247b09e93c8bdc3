"""Rubric and rollup queries: documents as candidates, orders as replies and comparisons, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import rollups, rubrics
from lacuna.plans.extraction_queries import _pick, _sql_list, _sql_pick
from lacuna.plans.views import table

# What the candidates' fields say, by document; the same strings stand in the SQL.
TEXTS: dict[str, list[str]] = {
    "problem_statement": [
        "Given samples under drift, identify the policy", "", "not provided", "We want many datasets and a general framework " + "for everything that anyone may ever want to have " * 2,
        "Under a budget constraint, bound the regret of a learner whose observations are delayed, noisy, partial and sometimes missing altogether for a long time", "A short one",
    ],
    "proposed_direction": [
        "Apply a known method to a graph", "Compare proofs", "not provided",
        "robust causal federated bayesian quantum diffusion conformal neural fair symbolic adversarial multimodal graph ideas", "extend the standard algorithm",
    ],
    "expected_contribution": ["a theorem", "not provided", "insight"],
    "evaluation_plan": ["Run a benchmark experiment on a dataset", "not provided", "later", "evaluate against the baseline method"],
    "risks_or_caveats": ["drop if trivial", "not provided", "read_first"],
    "source_context_or_grounding": ["Paper 12 and arXiv notes", "recent work in the literature, long enough to count as some source", "not provided", "", "our notes"],
    "formal_problem_statement": ["Let the policy minimize regret given observations", "not provided", "n/a", "A variable and an assumption"],
    "assumptions_or_problem_setup": ["We assume a reward distribution", "not provided", "None", "", "constraint set"],
    "ambiguity_or_missing_definitions": ["The horizon is undefined", "not provided"],
    "profile_context": ["", "not provided", "profile of online learning and bandits papers with regret", "robust causal discovery themes"],
    "supporting_papers": ["", "p1, p2", "not provided"],
}
_STEP = {k: i + 1 for i, k in enumerate(TEXTS)}
FIELDS = (*rubrics.FIELDS, "profile_context", "supporting_papers")
_TITLE = 60


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    texts = {name: _pick(values, F.floor(k / F.lit(_STEP[name])).cast("long")) for name, values in TEXTS.items()}
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("c"), k).alias("candidate_id"), F.concat(F.lit("d"), k % 5).alias("domain"), F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("motivation_or_abstract"), *[c.alias(n) for n, c in texts.items()],
    )


def _scores(criteria, high: int, step: int = 3, low: int = 0):
    value = lambda i: ((F.col("doc_id") * (i + step) + i) % (high + 1 - low) + low).cast("string")
    return F.create_map(*[x for i, c in enumerate(criteria) for x in (F.lit(c), value(i))])


def _joined(x) -> Column:
    return F.array_join(x, ";")


def candidate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every predicate over a candidate's texts."""
    return _candidates(spark, sf_dir).select(
        "doc_id", rubrics.concrete_evidence().alias("evidence"), rubrics.formal_structure().alias("formal"), rubrics.action_path().alias("action"), rubrics.has_variables().alias("variables"),
        rubrics.has_assumptions().alias("assumptions"), rubrics.has_objective().alias("objective"), rubrics.has_evaluation_model().alias("evaluation"), rubrics.generic_source().alias("generic"),
        rubrics.term_soup().alias("soup"), rubrics.incremental().alias("incremental"), rubrics.vague_problem().alias("vague"), rubrics.weak_profile_signal().alias("weak_profile"),
    )


def formulation_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).withColumn("scores", _scores(rubrics.FORMULATION_ONLY, 10))
    return rows.select("doc_id", _joined(rubrics.formulation_caps()).alias("violations"))


def quality_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).withColumn("scores", _scores(rubrics.FORMULATION_QUALITY, 10))
    return rows.select("doc_id", _joined(rubrics.quality_caps()).alias("violations"))


def personalized_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).withColumn("scores", _scores(rubrics.RUBRICS["personalized"].criteria, 10))
    return rows.select("doc_id", _joined(rubrics.personalized_caps(FIELDS)).alias("violations"))


def role_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggered and broken rules of the three roles."""
    rows = _candidates(spark, sf_dir)
    out = []
    for role, criteria in rubrics.ROLES.items():
        triggered, broken = rubrics.role_caps(role)
        out.append(rows.withColumn("scores", _scores(criteria, 10)).select("doc_id", F.lit(role).alias("role"), _joined(triggered).alias("triggered"), _joined(broken).alias("broken")))
    return out[0].unionByName(out[1]).unionByName(out[2])


_BATCH = ("evidence_grounding", "formalizability", "actionability", "pursuit_priority", "feasibility", "auditability_overall", "clarity_specificity", "significance", "non_incrementality")
_SAID = ["YES", "PARTIAL", "NO"]
_EXCEPT = ["Formal: sketch given", "evidence pending", "pursuit of it"]


def batch_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    check = F.create_map(*[x for i, c in enumerate(rubrics.CHECKLIST) for x in (F.lit(c), _pick(_SAID, k + i))])
    rows = _candidates(spark, sf_dir).withColumns({
        "scores": _scores(_BATCH, 5, 2, 1), "pre_score_checklist": check, "cap_exceptions": F.when(k % 4 == 0, F.array(_pick(_EXCEPT, k))).otherwise(F.array().cast("array<string>")),
    })
    return rows.select("doc_id", _joined(rubrics.batch_caps()).alias("violations"), _joined(rubrics.calibration_flags()).alias("flags"))


#: Line items that a task takes where tables and hash maps in memory hold them.
TASK_ROWS = 1 << 17
LABELS = ("baseline method", "Method-X", "ALPHA_2")
RATIONALES = ["sound", "", "better than method-x here", "like an alpha_2b", "ALPHA_2 wins", "the Baseline Method again"]


def reply_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring replies of four rubrics against their orders, by violation."""
    k = F.col("o_orderkey")
    out = None
    for step, (name, rubric) in enumerate(rubrics.RUBRICS.items()):
        value = lambda i: F.when(k % 17 == i, F.lit("7.5")).otherwise(((k * (i + 1)) % 13 - 1).cast("string"))  # noqa: B023, E731
        full = F.create_map(*[x for i, c in enumerate(rubric.criteria) for x in (F.lit(c), value(i))])
        scores = F.map_concat(F.map_filter(full, lambda c, _: ~((k % 10 == 0) & (c == rubric.criteria[0]))), F.when(k % 7 == 0, F.create_map(F.lit("bonus"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>")))  # noqa: B023
        rows = table(spark, sf_dir, "orders").where("o_orderkey IS NOT NULL").select(
            k, F.concat(F.lit("c"), F.when(k % 19 == 0, k + 1).otherwise(k)).alias("candidate_id"), F.concat(F.lit("d"), k % 5).alias(rubric.key), scores.alias("scores"),
            _pick([*rubrics.ACTIONS, "READ"], k).alias("recommended_action"), _pick([*rubrics.CONFIDENCES, "high"], k).alias("confidence"),
            F.when(k % 6 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("good"))).alias("strengths"), F.when(k % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("weak"))).alias("weaknesses"),
            _pick(RATIONALES, k).alias("rationale"),
        )
        found = rubrics.reply_violations(rubric, {"candidate_id": F.concat(F.lit("c"), k), rubric.key: F.concat(F.lit("d"), k % 5)}, LABELS)
        part = rows.select(F.lit(name).alias("rubric"), F.explode(found).alias("violation")).groupBy("rubric", "violation").agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def preference_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    winners = F.create_map(*[x for i, c in enumerate(rubrics.PREFERENCE) for x in (F.lit(c), F.when(k % 23 == i, "C").otherwise(_pick(["A", "B", "TIE"], k + i)))])
    rows = table(spark, sf_dir, "orders").select(
        k, F.concat(F.lit("p"), F.when(k % 19 == 0, k + 1).otherwise(k)).alias("pair_id"), _pick(["A", "B", "TIE", "CANNOT_JUDGE", "BOTH"], k).alias("winner"), _pick([*rubrics.CONFIDENCES, "high"], k).alias("confidence"),
        F.map_filter(winners, lambda c, _: ~((k % 10 == 0) & (c == "significance"))).alias("criterion_winners"), _pick(RATIONALES, k).alias("why_winner"),
        F.lit("x").alias("candidate_a_weakness"), F.when(k % 9 == 0, "").otherwise("y").alias("candidate_b_weakness"),
    )
    return rows.select("o_orderkey", _joined(rubrics.preference_violations(F.concat(F.lit("p"), k), LABELS)).alias("violations"))


def side_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair replies with scores of both sides, by violation."""
    k = F.col("o_orderkey")
    side = lambda s: F.create_map(*[x for i, c in enumerate(rubrics.PREFERENCE) for x in (F.lit(c), ((k * (i + s)) % 7).cast("string"))])
    rows = table(spark, sf_dir, "orders").select(
        side(1).alias("candidate_a_scores"), F.map_filter(side(2), lambda c, _: ~((k % 5 == 0) & (c == "feasibility"))).alias("candidate_b_scores"),
        _pick(["A", "B", "TIE", "x"], k).alias("pairwise_preference"), _pick([*rubrics.CONFIDENCES, "high"], k).alias("confidence"), _pick(["r", ""], k).alias("rationale"),
    )
    return rows.select(F.explode(rubrics.side_violations(rubrics.PREFERENCE)).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def ranking_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-way rankings: line items rank their order's four candidates under three criteria."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("packet_id"), _pick(["significance", "feasibility", "beauty"], F.col("l_linenumber").cast("long")).alias("criterion"),
        (F.col("l_suppkey") % 5).alias("candidate_id"), (F.col("l_partkey") % 6).alias("rank"), F.when(F.col("l_partkey") % 9 == 0, "").otherwise("r").alias("reason"),
    )
    packets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("packet_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("candidate_id"))
    found = rubrics.ranking_violations(rows, packets, ("significance", "feasibility"), 4)
    return found.select("packet_id", _joined("violations").alias("violations"))


def batch_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches: line items of an order as replies about its line numbers."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("candidate_id"), "l_partkey")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // TASK_ROWS + 1)  # the count is in the files' footers
    rows = lines.repartition(tasks, "batch", "candidate_id").groupBy("batch", "candidate_id").agg(F.min("l_partkey").alias("p"))
    given = rows.select("batch", "candidate_id", F.when(F.col("batch") % 3 == 0, F.col("candidate_id").cast("long")).otherwise(F.col("p") % 7 + 1).alias("rank"), F.create_map(*[x for i, c in enumerate(rubrics.CHECKLIST) for x in (F.lit(c), F.when(F.col("batch") % 29 == i, "MAYBE").otherwise("YES"))]).alias("checklist"))
    expected = rows.where((F.col("batch") % 11 != 0) | (F.col("candidate_id") != 1)).select("batch", "candidate_id", F.col("candidate_id").cast("long").alias("position"))
    return rubrics.batch_violations(given, expected, tasks).select("batch", _joined("violations").alias("violations"))


def merged_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("long")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("candidate_id"), F.concat(F.lit("role"), n % 3).alias("role"), _pick([*rubrics.CONFIDENCES, "none"], F.col("l_partkey")).alias("confidence"),
        F.array(_pick(["a", "b", "c"], F.col("l_suppkey"))).alias("triggered"), F.when(F.col("l_suppkey") % 7 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("broken"), (F.col("l_partkey") % 10 != 0).alias("valid"),
    )
    out = rubrics.merged_roles(rows)
    return out.select("candidate_id", "confidence", _joined("cap_rules_triggered").alias("triggered"), _joined("cap_violations").alias("broken"), _joined("invalid_roles").alias("invalid"), "valid_for_run")


# --- rollups ---

POOLS = ["FAMILY", "DIRECT", "SIMPLE", "RAG"]
METHODS = {"FAMILY": "own", "DIRECT": "own", "SIMPLE": "other"}
_WINNER = "CASE WHEN o_orderkey % 11 = 0 THEN 'CANNOT_JUDGE' WHEN o_orderkey % 5 = 0 THEN 'TIE' WHEN o_orderkey % 3 = 0 THEN 'B' ELSE 'A' END"
_CRIT3 = ("significance", "feasibility", "novelty_potential")
KINDS = ("best_overall", "most_auditable", "most_actionable", "most_novel_potential")


def _comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a, b = _pick(POOLS, k), _pick(POOLS, c)
    swap = k % 2 == 0
    winners = F.create_map(*[x for i, n in enumerate(_CRIT3) for x in (F.lit(n), _pick(["A", "B", "TIE", "none"], k + i))])
    return table(spark, sf_dir, "orders").select(
        k, F.concat_ws("_vs_", a, b).alias("comparison_group"), F.when(swap, a).otherwise(b).alias("pool_a"), F.when(swap, b).otherwise(a).alias("pool_b"),
        (c % 50).cast("string").alias("id_a"), (c % 37).cast("string").alias("id_b"), F.expr(_WINNER).alias("winner"), winners.alias("criterion_winners"),
    )


def win_rates_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.win_rates_by_method(_comparisons(spark, sf_dir), METHODS)


def criterion_win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.criterion_win_rates(_comparisons(spark, sf_dir), _CRIT3)


def candidate_win_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.candidate_wins(_comparisons(spark, sf_dir))


def pair_unblind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferred methods of pairs after unblinding both sides."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("candidate_a_id"), F.col("o_orderkey").alias("candidate_b_id"), _pick(["CANDIDATE_A", "CANDIDATE_B", "TIE"], F.col("o_orderkey")).alias("preference"))
    key = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("candidate_id"), F.col("c_mktsegment").alias("method"))
    rows = rollups.pair_unblinded(o, key)
    named = rows.withColumn("preferred_method", rollups.preferred(F.col("preference"), F.col("candidate_a_method"), F.col("candidate_b_method")))
    return named.groupBy("candidate_a_method", "candidate_b_method", "preferred_method").agg(F.count(F.lit(1)).alias("n"))


def rank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("domain"), (F.col("l_suppkey") % 4).alias("candidate_id"), _pick(list(_CRIT3), F.col("l_linenumber").cast("long")).alias("criterion"), (F.col("l_partkey") % 4 + 1).alias("rank")
    )
    return rollups.rank_rows(rows, _CRIT3)


def special_winner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(_pick(list(KINDS), F.col("o_orderkey")).alias("kind"), F.col("o_orderpriority").alias("method"))
    return rollups.special_winners(rows, KINDS)


def domain_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("domain"), F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("l_linenumber") - 1) % 4).alias("kind")).agg(F.max("l_suppkey").alias("candidate_id"))
    key = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("candidate_id"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("method"))
    return rollups.domain_winners(rows, key, KINDS)


def calibration_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("candidate_id"), _pick(list(_CRIT3), F.col("l_linenumber").cast("long")).alias("criterion")).agg((F.max("l_partkey") % 11).alias("score"))
    k = F.col("o_orderkey")
    ranges = table(spark, sf_dir, "orders").select(k.alias("candidate_id"), _pick(list(_CRIT3), k).alias("criterion"), F.when(k % 2 == 0, "min").otherwise("max").alias("check"), (k % 9).alias("expected"))
    checked = rollups.calibration_checks(scores, ranges).groupBy("criterion", "check", "passed").agg(F.count(F.lit(1)).alias("n"))
    ceiling = rollups.ceiling_check(scores, 9).select(F.lit("all").alias("criterion"), F.lit("ceiling").alias("check"), "passed", F.col("all_high").alias("n"))
    return checked.unionByName(ceiling)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).withColumn("coherence_score", (F.col("doc_id") % 10) / 10.0)
    text = F.lower(rubrics.whole_text())
    return rows.withColumn("score", F.round(rollups.selection_score(text, rows.columns), 4))


def selection_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "score")


def pool_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select(F.concat(F.lit("p"), F.col("doc_id") % 7).alias("pool"), "title", "score", F.col("doc_id").alias("place"))
    return rollups.pool_selection(rows, 3).select("pool", "place", F.col("rank").cast("long").alias("rank"))


def pool_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blinded pairs of the selected candidates of compared pools."""
    rows = _scored(spark, sf_dir).select(F.concat(F.lit("p"), F.col("doc_id") % 7).alias("pool"), "title", "score", F.col("doc_id").alias("place"))
    chosen = rollups.pool_selection(rows, 3).select("pool", F.col("place").cast("string").alias("candidate_id"))
    return rollups.pool_pairs(chosen, [("p0", "p1"), ("p0", "p2"), ("p3", "p4")])


def best_of_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("domain", F.concat(F.lit("m"), F.col("doc_id") % 4).alias("method"), "title", "score", F.col("doc_id").alias("place"))
    return rubrics.best_of_method(rows).select("domain", "method", "place")


def common_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as families and as direct formulations in the common schema, then how many provide each field."""
    k = F.col("doc_id")
    said = lambda i: F.when(k % (i + 2) == 0, F.lit(None).cast("string")).when(k % (i + 3) == 0, " ").otherwise(F.concat(F.lit("v"), k % 9))
    out = None
    for kind, fields in rollups.COMMON.items():
        names = sorted({c for cols in fields.values() for c in cols})
        rows = table(spark, sf_dir, "documents").select(k, *[said(i).alias(n) for i, n in enumerate(names)])
        part = rollups.common_schema(rows, kind, F.concat(F.lit("d"), k % 3)).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def packet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.packet_counts(common_schema(spark, sf_dir))


# --- DuckDB ---

_CAND = "cand AS (SELECT doc_id, 'c' || doc_id AS candidate_id, 'd' || doc_id % 5 AS domain, split_part(text, chr(10), 1) AS title, text AS motivation_or_abstract, " + ", ".join(
    f"{_sql_pick([v.replace(chr(10), ' ') for v in values], f'doc_id // {_STEP[n]}')} AS {n}" for n, values in TEXTS.items()
) + " FROM documents)"


def _txt(fields=rubrics.FIELDS) -> str:
    return "lower(concat_ws(chr(10), " + ", ".join(fields) + "))"


def _m(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _any(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"


def _j(*names: str) -> str:
    return "lower(concat_ws(chr(10), " + ", ".join(f"coalesce({n}, '')" for n in names) + "))"


def _p(x: str) -> str:
    return f"(trim(coalesce({x}, '')) <> '' AND lower(trim(coalesce({x}, ''))) NOT IN ('not provided', 'none', 'n/a', 'null'))"


_SRC = "lower(trim(source_context_or_grounding))"
_EVID = f"({_m('txt', rubrics.EVIDENCE)} OR ({_SRC} <> 'not provided' AND length({_SRC}) > 40))"
_FORM = f"(({_p('formal_problem_statement')} AND {_p('assumptions_or_problem_setup')}) OR (" + " + ".join(f"CAST({_m('txt', p)} AS INTEGER)" for p in rubrics.SKELETON) + ") >= 3)"
_ACT = _m(_j("evaluation_plan", "expected_contribution", "proposed_direction"), rubrics.ACTION_PATH)
_VARS = _m(_j("formal_problem_statement", "assumptions_or_problem_setup", "problem_statement"), rubrics.VARIABLES)
_ASSU = _m(_j("assumptions_or_problem_setup", "formal_problem_statement", "problem_statement"), rubrics.ASSUMPTIONS)
_OBJ = _m(_j("formal_problem_statement", "assumptions_or_problem_setup", "evaluation_plan", "expected_contribution", "problem_statement"), rubrics.OBJECTIVE)
_EVAL = _m(_j("evaluation_plan", "formal_problem_statement", "assumptions_or_problem_setup", "expected_contribution"), rubrics.EVALUATION)
_GEN = f"({_SRC} NOT IN ('', 'not provided') AND (NOT {_EVID} OR ({_any(_SRC, rubrics.GENERIC_SOURCE)} AND NOT {_m(_SRC, rubrics.NAMED_SOURCE)})))"
_SOUP = f"(len(list_distinct(regexp_extract_all(txt, '{rubrics.SOUP}'))) >= 6)"
_INC = f"({_m('txt', rubrics.KNOWN_VERBS)} AND {_m('txt', rubrics.KNOWN_NOUNS)})"
_LOOSE = f"len(regexp_extract_all(txt, '{rubrics.LOOSE}'))"
_LOW = {n: f"lower(trim({n}))" for n in ("problem_statement", "formal_problem_statement", "assumptions_or_problem_setup")}
_VAGUE = (
    f"({_LOW['problem_statement']} IN ('', 'not provided') OR (length({_LOW['problem_statement']}) < 120 AND ({_LOW['formal_problem_statement']} = 'not provided' OR {_LOW['assumptions_or_problem_setup']} = 'not provided'))"
    f" OR NOT ({' OR '.join(_any(v, rubrics.SPECIFIC) for v in _LOW.values())}) OR {_any(_LOW['problem_statement'], rubrics.GENERIC_PROBLEM)})"
)
_PTXT = _j("title", "problem_statement", "motivation_or_abstract", "formal_problem_statement", "source_context_or_grounding", "supporting_papers")
_CTX = "lower(trim(profile_context))"
_ASKED = f"list_distinct(list_filter(regexp_extract_all({_CTX}, '[a-z][a-z0-9\\-]{{4,}}'), lambda w: NOT list_contains({_sql_list(rubrics.PROFILE_STOPS)}, w)))"
_WEAK = (
    f"({_CTX} IN ('', 'not provided') OR {_any(_PTXT, rubrics.WEAK_PROFILE)} OR (len(list_filter({_ASKED}, lambda w: contains({_PTXT}, w))) < 2"
    f" AND {_SRC} IN ('', 'not provided') AND lower(trim(supporting_papers)) IN ('', 'not provided')))"
)


def _sc(criteria, name: str, high: int = 10, step: int = 3, low: int = 0) -> str:
    i = criteria.index(name)
    return f"((doc_id * {i + step} + {i}) % {high + 1 - low} + {low})"


def _viol(rules: list[tuple[str, str]]) -> str:
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for test, name in rules) + ")"


def _formulation(criteria) -> list[tuple[str, str]]:
    s = lambda n: _sc(criteria, n)
    f, p = _p("formal_problem_statement"), _p("assumptions_or_problem_setup")
    return [
        (f"{_VAGUE} AND {s('overall_formulation_quality_10')} > 6", "vague_problem_but_overall_above_6"),
        (f"NOT {f} AND {s('well_posedness_10')} > 6", "formal_problem_statement_missing_but_well_posedness_above_6"),
        (f"NOT {f} AND {s('formalizability_10')} > 6", "formal_problem_statement_missing_but_formalizability_above_6"),
        (f"NOT {p} AND {s('well_posedness_10')} > 6", "assumptions_or_problem_setup_missing_but_well_posedness_above_6"),
        (f"NOT {p} AND {s('assumption_boundary_clarity_10')} > 6", "assumptions_or_problem_setup_missing_but_assumption_boundary_above_6"),
        (f"NOT {_p('ambiguity_or_missing_definitions')} AND {s('ambiguity_hygiene_10')} > 6", "ambiguity_missing_definitions_missing_but_ambiguity_hygiene_above_6"),
        (f"NOT {_p('source_context_or_grounding')} AND {s('source_grounded_specificity_10')} > 4", "source_context_or_grounding_missing_but_source_specificity_above_4"),
        (f"{_LOOSE} >= 8 AND {s('scope_control_10')} > 4", "many_loose_concepts_but_scope_control_above_4"),
        (f"{_m('txt', rubrics.APPLY)} AND {s('nontriviality_10')} > 6", "apply_or_test_x_to_y_but_nontriviality_above_6"),
        (f"NOT {_FORM} AND {s('overall_formulation_quality_10')} > 7", "no_clear_formal_skeleton_but_overall_above_7"),
    ]


def _role_sql(role: str) -> str:
    c = rubrics.ROLES[role]
    s = lambda n: _sc(c, n)
    table_ = {
        "scientific_merit_reviewer": [
            (f"NOT {_ACT}", "no_clear_evaluation_or_next_step_path", [("actionability_10", 5, "without a clear evaluation or next-step path")]),
            (f"{s('feasibility_10') if 'feasibility_10' in c else 0} <= 4", "weak_feasibility", [("research_priority_10", 6, "despite weak feasibility")]),
            (_INC, "mostly_generic_or_known_method_application", [("novelty_potential_10", 5, "for a mostly generic/common direction")]),
        ],
        "formalization_reviewer": [
            (f"NOT {_p('formal_problem_statement')}", "formal_problem_statement_missing", [("formalizability_10", 5, "when formal_problem_statement is missing or not provided")]),
            (f"NOT {_VARS}", "variables_or_entities_missing", [("formalizability_10", 6, "without explicit variables/entities")]),
            (f"NOT {_ASSU}", "assumptions_missing", [("assumption_clarity_10", 5, "without explicit assumptions")]),
            (f"NOT {_OBJ}", "objective_missing", [("objective_clarity_10", 5, "without explicit objective/success criterion")]),
            (f"NOT {_EVAL}", "evaluation_model_missing", [("evaluation_model_clarity_10", 5, "without explicit observation/evaluation model")]),
        ],
        "evidence_auditability_reviewer": [
            (f"NOT {_EVID}", "no_concrete_source_evidence", [("evidence_grounding_10", 4, "without concrete source papers/evidence trail/context items"), ("source_traceability_10", 4, "without traceable support/context")]),
            (_GEN, "generic_source_evidence", [("evidence_grounding_10", 6, "with generic source evidence")]),
            (f"NOT {_EVID} AND NOT {_FORM}", "weak_evidence_and_formal_structure", [("auditability_10", 5, "when formal structure and evidence trail are weak")]),
            (_SOUP, "term_soup_or_overcomposed", [("low_term_soup_10", 4, "for a term-soup/over-composed candidate")]),
        ],
    }[role]
    broken = [(f"({t}) AND {s(k)} > {cap}", f"{k} exceeds {cap} {why}") for t, _, caps in table_ for k, cap, why in caps]
    return f"SELECT doc_id, '{role}' AS role, {_viol([(t, n) for t, n, _ in table_])} AS triggered, {_viol(broken)} AS broken FROM c"


def _batch_sql() -> str:
    s = lambda n: _sc(_BATCH, n, 5, 2, 1)
    said = lambda n, v: f"({_sql_pick(_SAID, f'doc_id + {rubrics.CHECKLIST.index(n)}')} = '{v}')"
    free = lambda w: f"(doc_id % 4 = 0 AND contains(lower({_sql_pick(_EXCEPT, 'doc_id')}), '{w}'))"
    f, p, a = _p("formal_problem_statement"), _p("assumptions_or_problem_setup"), _p("ambiguity_or_missing_definitions")
    g, z, r = s("evidence_grounding"), s("formalizability"), s("pursuit_priority")
    caps = [
        (f"NOT {_EVID} AND {g} > 2 AND NOT {free('evidence')}", "evidence_grounding exceeds hard cap without concrete evidence"),
        (f"{said('concrete_source_grounding', 'NO')} AND {g} > 2 AND NOT {free('evidence')}", "evidence_grounding exceeds checklist NO cap"),
        (f"{said('concrete_source_grounding', 'PARTIAL')} AND {g} > 3 AND NOT {free('evidence')}", "evidence_grounding exceeds checklist PARTIAL cap"),
        (f"NOT {_FORM} AND {z} > 3 AND NOT {free('formal')}", "formalizability exceeds hard cap without visible formal structure"),
        (f"NOT {f} AND NOT {p} AND {z} > 3 AND NOT {free('formal')}", "formalizability exceeds cap while formal_problem_statement and setup are not provided"),
        (f"{said('formal_problem_skeleton', 'NO')} AND {z} > 2 AND NOT {free('formal')}", "formalizability exceeds checklist NO skeleton cap"),
        (f"{said('formal_problem_skeleton', 'PARTIAL')} AND {z} > 3 AND NOT {free('formal')}", "formalizability exceeds checklist PARTIAL skeleton cap"),
        (f"NOT {_ACT} AND {s('actionability')} > 3 AND NOT {free('action')}", "actionability exceeds hard cap without clear evaluation/action path"),
        (f"{said('clear_evaluation_path', 'NO')} AND {s('actionability')} > 3 AND NOT {free('action')}", "actionability exceeds checklist NO evaluation path cap"),
        (f"{g} <= 2 AND {z} <= 3 AND {r} > 3 AND NOT {free('pursuit')}", "pursuit_priority exceeds cap despite weak evidence and formalizability"),
        (f"{s('feasibility')} <= 2 AND {r} > 3 AND NOT {free('pursuit')}", "pursuit_priority exceeds cap despite low feasibility"),
        (f"{s('actionability')} <= 2 AND {r} > 3 AND NOT {free('pursuit')}", "pursuit_priority exceeds cap despite low actionability"),
        (f"(({g} <= 3 AND {z} <= 3) OR (NOT {f} AND NOT {p} AND NOT {a})) AND {s('auditability_overall')} > 3 AND NOT {free('audit')}", "auditability_overall exceeds cap despite weak or missing evidence/formalization structure"),
    ]
    known = f"{_m('txt', r'\b(apply|application|extend|use)\b')} AND {_m('txt', r'\b(known|existing|standard)\b')}"
    basis = f"({s('clarity_specificity')} >= 4 AND {s('significance')} >= 4 AND {s('feasibility')} >= 4 AND ({g} >= 4 OR {z} >= 4))"
    flags = [
        (f"NOT {_EVID} AND {g} > 2", "evidence_grounding_above_2_without_concrete_source_evidence"), (f"NOT {_EVID} AND {s('auditability_overall')} > 3", "auditability_above_3_without_concrete_source_evidence"),
        (f"NOT {_FORM} AND {z} > 3", "formalizability_above_3_without_visible_formal_structure"), (f"NOT {_FORM} AND {s('auditability_overall')} > 3", "auditability_above_3_without_visible_formal_structure"),
        (f"{known} AND {s('non_incrementality')} > 3", "non_incrementality_above_3_for_apparent_known_method_application"), (f"NOT {_ACT} AND {s('actionability')} > 3", "actionability_above_3_without_evaluation_plan"),
        (f"{g} <= 2 AND {z} <= 3 AND {r} > 3", "pursuit_priority_above_3_despite_weak_evidence_and_formalizability"), (f"{s('feasibility')} <= 2 AND {r} > 3", "pursuit_priority_above_3_despite_low_feasibility"),
        (f"{r} = 5 AND NOT {basis}", "pursuit_priority_5_without_strong_specific_feasible_grounded_basis"),
    ]
    return f"SELECT doc_id, {_viol(caps)} AS violations, {_viol(flags)} AS flags FROM c"


_HEAD = f"WITH {_CAND}, c AS (SELECT *, {_txt()} AS txt FROM cand)"
_PHEAD = f"WITH {_CAND}, c AS (SELECT *, {_txt(FIELDS)} AS txt FROM cand)"
_LABEL = "regexp_matches(lower({0}), '(?:^|[^\\p{{L}}\\p{{N}}_])(?:baseline method|method-x|alpha_2)(?:$|[^\\p{{L}}\\p{{N}}_])')"


def _reply_sql(name: str, rubric: rubrics.Rubric) -> str:
    rationale = _sql_pick(RATIONALES, "k")
    parts = [
        "SELECT 'candidate_id_mismatch' AS violation FROM o WHERE k % 19 = 0", f"SELECT 'invalid_recommended_action' FROM o WHERE k % {len(rubrics.ACTIONS) + 1} = {len(rubrics.ACTIONS)}",
        f"SELECT 'invalid_confidence' FROM o WHERE k % {len(rubrics.CONFIDENCES) + 1} = {len(rubrics.CONFIDENCES)}", "SELECT 'no_strengths' FROM o WHERE k % 6 = 0", "SELECT 'no_weaknesses' FROM o WHERE k % 8 = 0",
        f"SELECT 'no_rationale' FROM o WHERE {rationale} = ''", f"SELECT 'method_label' FROM o WHERE {_LABEL.format(rationale)}", "SELECT 'unknown:bonus' FROM o WHERE k % 7 = 0",
        f"SELECT 'missing:{rubric.criteria[0]}' FROM o WHERE k % 10 = 0",
    ]
    for i, c in enumerate(rubric.criteria):
        there = "TRUE" if i else "k % 10 <> 0"
        parts.append(f"SELECT 'no_integer:{c}' FROM o WHERE {there} AND k % 17 = {i}")
        parts.append(f"SELECT 'range:{c}' FROM o WHERE {there} AND k % 17 <> {i} AND (k * {i + 1}) % 13 - 1 NOT BETWEEN {rubric.low} AND {rubric.high}")
    return f"SELECT '{name}' AS rubric, violation, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY 2"


def _side_sql() -> str:
    parts = []
    for s, n in (("a", 1), ("b", 2)):
        for i, c in enumerate(rubrics.PREFERENCE):
            there = "k % 5 <> 0" if s == "b" and c == "feasibility" else "TRUE"
            parts.append(f"SELECT '{s}.range:{c}' AS violation FROM o WHERE {there} AND (k * {i + n}) % 7 NOT BETWEEN 1 AND 5")
    parts += ["SELECT 'b.missing:feasibility' FROM o WHERE k % 5 = 0", "SELECT 'invalid_preference' FROM o WHERE k % 4 = 3", "SELECT 'invalid_confidence' FROM o WHERE k % 4 = 3", "SELECT 'no_rationale' FROM o WHERE k % 2 = 1"]
    return f"WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT violation, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY 1"


_CMP = f"""cmp AS (SELECT o_orderkey AS k, {_sql_pick(POOLS, 'o_orderkey')} AS f, {_sql_pick(POOLS, 'o_custkey')} AS s, o_custkey AS c, {_WINNER} AS winner FROM orders),
    p AS (SELECT *, f || '_vs_' || s AS g, CASE WHEN k % 2 = 0 THEN f ELSE s END AS pa, CASE WHEN k % 2 = 0 THEN s ELSE f END AS pb FROM cmp)"""
_RATE = "round({0} / nullif({0} + {1}, 0), 4) AS {2}win_rate_excluding_ties, round(({0} + 0.5::DOUBLE * ties) / nullif({0} + {1} + ties, 0), 4) AS {2}win_rate_tie_half"
_FAM = "CASE {0} WHEN 'FAMILY' THEN 'own' WHEN 'DIRECT' THEN 'own' WHEN 'SIMPLE' THEN 'other' ELSE {0} END"
_GRAND = f"len(regexp_extract_all(txt, '{rollups.GRAND}'))"
_SELSQL = (
    "round(CAST(" + " + ".join(f"CASE WHEN {_p(k)} THEN {w} ELSE 0 END" for k, w in rollups.FIELD_WEIGHTS.items())
    + f" + CASE WHEN contains(txt, 'read_first') OR contains(txt, 'strong_candidate') THEN 4 ELSE 0 END - CASE WHEN contains(txt, 'drop') OR contains(txt, 'deprioritize') THEN 5 ELSE 0 END"
    + f" + (doc_id % 10) / 10.0::DOUBLE - CASE WHEN {_GRAND} > 14 THEN 1.5 ELSE 0 END - CASE WHEN length(txt) > 16000 THEN 1 ELSE 0 END AS DOUBLE), 4)"
)
_SCORED = f"{_HEAD}, s AS (SELECT doc_id, title, domain, {_SELSQL} AS score FROM c)"
_POOL = f"""{_SCORED}, a AS (SELECT 'p' || doc_id % 7 AS pool, title, score, doc_id AS place, substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), 1, 80) AS r0 FROM s),
    b AS (SELECT *, CASE WHEN r0 = '' THEN ' ' || place ELSE r0 END AS root FROM a),
    d AS (SELECT *, row_number() OVER (PARTITION BY pool, root ORDER BY score DESC, title, place) AS again, count(DISTINCT root) OVER (PARTITION BY pool) AS roots FROM b),
    e AS (SELECT pool, place, row_number() OVER (PARTITION BY pool ORDER BY score DESC, title, place) AS rank FROM d WHERE again = 1 OR roots < 3)"""


def _common_sql() -> str:
    out = []
    for kind, fields in rollups.COMMON.items():
        names = sorted({c for cols in fields.values() for c in cols})
        said = {n: f"(CASE WHEN doc_id % {i + 2} = 0 THEN NULL WHEN doc_id % {i + 3} = 0 THEN ' ' ELSE 'v' || doc_id % 9 END)" for i, n in enumerate(names)}
        line = lambda c: f"CASE WHEN trim(coalesce({said[c]}, '')) NOT IN ('', 'not provided') THEN '{c}: ' || {said[c]} END"  # noqa: B023, E731
        cols = []
        for f in rubrics.FIELDS:
            if f == "domain":
                cols.append("'d' || doc_id % 3 AS domain")
                continue
            from_ = fields[f]
            x = "'not provided'" if not from_ else f"coalesce(nullif(trim({said[from_[0]]}), ''), 'not provided')" if len(from_) == 1 else f"coalesce(nullif(concat_ws(chr(10), {', '.join(line(c) for c in from_)}), ''), 'not provided')"
            cols.append(f"{x} AS {f}")
        out.append(f"SELECT {', '.join(cols)}, '{kind}' AS kind FROM documents")
    return " UNION ALL ".join(out)


ORACLE_SQL = {
    "candidate_flags": f"""{_HEAD} SELECT doc_id, {_EVID} AS evidence, {_FORM} AS formal, {_ACT} AS action, {_VARS} AS variables, {_ASSU} AS assumptions, {_OBJ} AS objective, {_EVAL} AS evaluation,
        {_GEN} AS generic, {_SOUP} AS soup, {_INC} AS incremental, {_VAGUE} AS vague, {_WEAK} AS weak_profile FROM c""",
    "formulation_caps": f"{_HEAD} SELECT doc_id, {_viol(_formulation(rubrics.FORMULATION_ONLY))} AS violations FROM c",
    "quality_caps": _HEAD + " SELECT doc_id, " + _viol([
        (f"NOT {_p('formal_problem_statement')} AND {_sc(rubrics.FORMULATION_QUALITY, 'well_posedness_0_to_10')} > 6", "formal_problem_statement_missing_but_well_posedness_above_6"),
        (f"NOT {_p('formal_problem_statement')} AND {_sc(rubrics.FORMULATION_QUALITY, 'overall_formulation_quality_0_to_10')} > 7", "formal_problem_statement_missing_but_overall_above_7"),
        (f"NOT {_p('assumptions_or_problem_setup')} AND {_sc(rubrics.FORMULATION_QUALITY, 'well_posedness_0_to_10')} > 6", "assumptions_or_problem_setup_missing_but_well_posedness_above_6"),
        (f"NOT {_p('source_context_or_grounding')} AND {_sc(rubrics.FORMULATION_QUALITY, 'source_grounded_specificity_0_to_10')} > 4", "source_context_or_grounding_missing_but_source_specificity_above_4"),
        (f"NOT {_p('ambiguity_or_missing_definitions')} AND {_sc(rubrics.FORMULATION_QUALITY, 'ambiguity_hygiene_0_to_10')} > 6", "ambiguity_missing_definitions_missing_but_ambiguity_hygiene_above_6"),
        (f"NOT {_p('evaluation_plan')} AND {_sc(rubrics.FORMULATION_QUALITY, 'feasibility_0_to_10')} > 6", "evaluation_plan_missing_but_feasibility_above_6"),
        (f"NOT {_FORM} AND {_sc(rubrics.FORMULATION_QUALITY, 'technical_sharpness_0_to_10')} > 5", "broad_or_underformalized_candidate_but_technical_sharpness_above_5"),
        (f"{_LOOSE} >= 8 AND {_sc(rubrics.FORMULATION_QUALITY, 'scope_control_0_to_10')} > 4", "many_loose_concepts_but_scope_control_above_4"),
        (f"(NOT {_p('source_context_or_grounding')} OR NOT {_EVID}) AND (NOT {_p('formal_problem_statement')} OR NOT {_FORM}) AND {_sc(rubrics.FORMULATION_QUALITY, 'overall_formulation_quality_0_to_10')} > 6", "source_grounding_and_formal_structure_weak_but_overall_above_6"),
    ]) + " AS violations FROM c",
    "personalized_caps": f"{_PHEAD} SELECT doc_id, " + _viol([
        *_formulation(rubrics.RUBRICS["personalized"].criteria),
        (f"{_CTX} IN ('', 'not provided') AND {_sc(rubrics.RUBRICS['personalized'].criteria, 'personalization_overall_10')} > 5", "profile_context_missing_but_personalization_overall_above_5"),
        (f"{_WEAK} AND {_sc(rubrics.RUBRICS['personalized'].criteria, 'profile_specificity_10')} > 5", "generic_or_weak_profile_signal_but_profile_specificity_above_5"),
        (f"{_any('txt', rubrics.OFF_PROFILE)} AND {_sc(rubrics.RUBRICS['personalized'].criteria, 'profile_alignment_10')} > 4", "name_dropping_or_off_profile_but_profile_alignment_above_4"),
        (f"{_sc(rubrics.RUBRICS['personalized'].criteria, 'profile_alignment_10')} <= 5 AND {_sc(rubrics.RUBRICS['personalized'].criteria, 'personalization_overall_10')} > 7", "weak_profile_alignment_but_personalization_overall_above_7"),
    ]) + " AS violations FROM c",
    "role_caps": f"{_HEAD} " + " UNION ALL ".join(_role_sql(r) for r in rubrics.ROLES),
    "batch_caps": f"{_HEAD} {_batch_sql()}",
    "reply_validation": "WITH o AS (SELECT o_orderkey AS k FROM orders) " + " UNION ALL ".join(_reply_sql(n, r) for n, r in rubrics.RUBRICS.items()),
    "preference_validation": f"WITH o AS (SELECT o_orderkey AS k, {_sql_pick(RATIONALES, 'o_orderkey')} AS why FROM orders) SELECT k AS o_orderkey, " + _viol([
        ("k % 19 = 0", "pair_id_mismatch"), ("k % 5 = 4", "invalid_winner"), ("k % 4 = 3", "invalid_confidence"), ("k % 10 = 0", "criterion_winners_keys"),
        (f"k % 23 < {len(rubrics.PREFERENCE)} AND NOT (k % 10 = 0 AND k % 23 = {rubrics.PREFERENCE.index('significance')})", "criterion_winners_values"), ("why = ''", "no_why_winner"), ("k % 9 = 0", "no_candidate_b_weakness"),
        (_LABEL.format("why"), "method_label"),
    ]) + " AS violations FROM o",
    "side_validation": _side_sql(),
    "ranking_validation": f"""WITH r AS (SELECT l_orderkey AS p, {_sql_pick(['significance', 'feasibility', 'beauty'], 'l_linenumber')} AS c, l_suppkey % 5 AS cid, l_partkey % 6 AS rank, l_partkey % 9 = 0 AS bare FROM lineitem),
        g AS (SELECT p, c, count(*) AS n, count(DISTINCT cid) AS d, bool_or(cid > 3) AS stranger, bool_or(rank NOT BETWEEN 1 AND 4) AS off, bool_or(bare) AS bare FROM r GROUP BY 1, 2),
        v AS (SELECT p, 'unknown_criterion:' || c AS x FROM g WHERE c = 'beauty' UNION ALL SELECT p, 'row_count:' || c FROM g WHERE n <> 4 UNION ALL SELECT p, 'unknown_candidate:' || c FROM g WHERE stranger
          UNION ALL SELECT p, 'rank_range:' || c FROM g WHERE off UNION ALL SELECT p, 'no_reason:' || c FROM g WHERE bare UNION ALL SELECT p, 'not_once_each:' || c FROM g WHERE d <> n OR d <> 4
          UNION ALL SELECT o_orderkey, 'missing:' || c FROM orders, (SELECT unnest(['significance', 'feasibility']) AS c) k WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.p = o_orderkey AND g.c = k.c))
        SELECT o_orderkey AS packet_id, coalesce(array_to_string(list_sort(list(x) FILTER (WHERE x IS NOT NULL)), ';'), '') AS violations FROM orders LEFT JOIN v ON p = o_orderkey GROUP BY 1""",
    "batch_validation": f"""WITH r AS (SELECT l_orderkey AS b, l_linenumber AS c, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
        s AS (SELECT b, c, CASE WHEN b % 3 = 0 THEN c ELSE p % 7 + 1 END AS rank, b % 11 = 0 AND c = 1 AS extra FROM r),
        g AS (SELECT b, count(*) AS n, count(DISTINCT rank) AS d, min(rank) AS lo, max(rank) AS hi, bool_and(rank = c) FILTER (WHERE NOT extra) AS same, bool_or(extra) AS extra FROM s GROUP BY b)
        SELECT b AS batch, concat_ws(';', CASE WHEN extra THEN 'unknown_candidates' END, CASE WHEN b % 29 < {len(rubrics.CHECKLIST)} THEN 'checklist' END,
          CASE WHEN NOT (d = n AND lo = 1 AND hi = n) THEN 'incomplete_ranking' END, CASE WHEN coalesce(same, false) AND n > 1 THEN 'mirrors_input_order' END) AS violations FROM g""",
    "merged_roles": f"""WITH r AS (SELECT l_orderkey AS candidate_id, 'role' || l_linenumber % 3 AS role, l_partkey % 4 AS q, {_sql_pick(['a', 'b', 'c'], 'l_suppkey')} AS t, l_suppkey % 7 = 0 AS broke, l_partkey % 10 <> 0 AS valid FROM lineitem),
        g AS (SELECT candidate_id, coalesce(min(q) FILTER (WHERE q < 3), 0) AS q, array_to_string(list_sort(list(DISTINCT t)), ';') AS triggered, array_to_string(list('x') FILTER (WHERE broke), ';') AS broken,
          array_to_string(list_sort(list(DISTINCT role) FILTER (WHERE NOT valid)), ';') AS invalid FROM r GROUP BY 1)
        SELECT candidate_id, ({_sql_list(rubrics.CONFIDENCES)})[q + 1] AS confidence, triggered, coalesce(broken, '') AS broken, coalesce(invalid, '') AS invalid, coalesce(broken, '') = '' AND coalesce(invalid, '') = '' AS valid_for_run FROM g""",
    "win_rates_by_method": f"""WITH {_CMP}, m AS (SELECT {_FAM.format('pa')} AS a, {_FAM.format('pb')} AS b, winner FROM p), e AS (SELECT a AS method, a, b, winner FROM m UNION ALL SELECT b, a, b, winner FROM m WHERE a <> b),
        g AS (SELECT method, count(*) AS comparisons, count(*) FILTER (WHERE (winner = 'A' AND a = method) OR (winner = 'B' AND b = method)) AS wins,
          count(*) FILTER (WHERE winner IN ('A', 'B') AND NOT ((winner = 'A' AND a = method) OR (winner = 'B' AND b = method))) AS losses, count(*) FILTER (WHERE winner = 'TIE') AS ties, count(*) FILTER (WHERE winner = 'CANNOT_JUDGE') AS cannot_judge FROM e GROUP BY 1)
        SELECT *, {_RATE.format('wins', 'losses', '')} FROM g""",
    "criterion_win_rates": f"WITH {_CMP}, e AS (" + " UNION ALL ".join(f"SELECT g, f, s, pa = f AS af, winner, '{c}' AS criterion, CASE WHEN winner <> 'CANNOT_JUDGE' THEN {_sql_pick(['A', 'B', 'TIE', 'none'], f'k + {i}')} END AS side FROM p" for i, c in enumerate(_CRIT3)) + f"""),
        h AS (SELECT g AS comparison_group, criterion, f AS first_pool, s AS second_pool, count(*) FILTER (WHERE (side = 'A' AND af) OR (side = 'B' AND NOT af)) AS first_wins, count(*) FILTER (WHERE (side = 'A' AND NOT af) OR (side = 'B' AND af)) AS second_wins,
          count(*) FILTER (WHERE side = 'TIE') AS ties, count(*) FILTER (WHERE winner = 'CANNOT_JUDGE') AS cannot_judge FROM e GROUP BY 1, 2, 3, 4) SELECT *, {_RATE.format('first_wins', 'second_wins', 'first_')} FROM h""",
    "candidate_win_counts": f"""WITH {_CMP}, e AS (SELECT pa AS pool, CAST(c % 50 AS VARCHAR) AS candidate_id, 'A' AS side, winner FROM p UNION ALL SELECT pb, CAST(c % 37 AS VARCHAR), 'B', winner FROM p)
        SELECT pool, candidate_id, count(*) FILTER (WHERE winner = side) AS wins, count(*) FILTER (WHERE winner IN ('A', 'B') AND winner <> side) AS losses, count(*) FILTER (WHERE winner = 'TIE') AS ties FROM e GROUP BY 1, 2""",
    "pair_unblind": """WITH k AS (SELECT c_custkey AS id, c_mktsegment AS m FROM customer WHERE c_custkey % 7 <> 0), r AS (SELECT coalesce(a.m, 'UNKNOWN') AS am, coalesce(b.m, 'UNKNOWN') AS bm, o_orderkey % 3 AS p
          FROM orders LEFT JOIN k a ON a.id = o_custkey LEFT JOIN k b ON b.id = o_orderkey)
        SELECT am AS candidate_a_method, bm AS candidate_b_method, CASE p WHEN 0 THEN am WHEN 1 THEN bm ELSE 'TIE' END AS preferred_method, count(*) AS n FROM r GROUP BY 1, 2, 3""",
    "rank_rows": "SELECT l_orderkey AS domain, l_suppkey % 4 AS candidate_id, " + ", ".join(f"max(l_partkey % 4 + 1) FILTER (WHERE l_linenumber % 3 = {i}) AS {c}" for i, c in enumerate(_CRIT3)) + " FROM lineitem GROUP BY 1, 2",
    "special_winner_counts": "SELECT o_orderpriority AS method, " + ", ".join(f"count(*) FILTER (WHERE o_orderkey % 4 = {i}) AS {k}_count" for i, k in enumerate(KINDS)) + " FROM orders GROUP BY 1",
    "domain_winners": "WITH r AS (SELECT l_orderkey AS domain, (l_linenumber - 1) % 4 + 1 AS n, max(l_suppkey) AS c FROM lineitem GROUP BY 1, 2), m AS (SELECT r.*, coalesce('n' || s_nationkey, 'UNKNOWN') AS m FROM r LEFT JOIN supplier ON s_suppkey = c AND s_suppkey % 3 <> 0) SELECT domain, "
        + ", ".join(f"max(m) FILTER (WHERE n = {i + 1}) AS {k}_method, max(c) FILTER (WHERE n = {i + 1}) AS {k}_candidate_id" for i, k in enumerate(KINDS)) + " FROM m GROUP BY 1",
    "calibration_checks": f"""WITH s AS (SELECT l_orderkey AS id, {_sql_pick(list(_CRIT3), 'l_linenumber')} AS c, max(l_partkey) % 11 AS score FROM lineitem GROUP BY 1, 2),
        r AS (SELECT o_orderkey AS id, {_sql_pick(list(_CRIT3), 'o_orderkey')} AS c, o_orderkey % 2 = 0 AS mn, o_orderkey % 9 AS e FROM orders),
        j AS (SELECT r.c, mn, coalesce(CASE WHEN mn THEN score >= e ELSE score <= e END, false) AS passed FROM r LEFT JOIN s ON s.id = r.id AND s.c = r.c), h AS (SELECT id, bool_and(score >= 9) AS ah FROM s GROUP BY 1)
        SELECT c AS criterion, CASE WHEN mn THEN 'min' ELSE 'max' END AS "check", passed, count(*) AS n FROM j GROUP BY 1, 2, 3
        UNION ALL SELECT 'all', 'ceiling', count(*) FILTER (WHERE ah) < count(*), count(*) FILTER (WHERE ah) FROM h""",
    "selection_scores": f"{_SCORED} SELECT doc_id, score FROM s",
    "pool_selection": f"{_POOL} SELECT pool, place, rank FROM e WHERE rank <= 3",
    "pool_pairs": f"""{_POOL}, k AS (SELECT pool, CAST(place AS VARCHAR) AS id FROM e WHERE rank <= 3), g AS (SELECT unnest([{{'f': 'p0', 's': 'p1'}}, {{'f': 'p0', 's': 'p2'}}, {{'f': 'p3', 's': 'p4'}}]) AS q),
        x AS (SELECT q.f || '_vs_' || q.s AS comparison_group, q.f AS f, q.s AS s, a.id AS x, b.id AS y FROM g JOIN k a ON a.pool = q.f JOIN k b ON b.pool = q.s),
        w AS (SELECT *, substr(sha1(comparison_group || '|' || x || '|' || y), 1, 1) BETWEEN '0' AND '7' AS swap FROM x)
        SELECT comparison_group, CASE WHEN swap THEN f ELSE s END AS pool_a, CASE WHEN swap THEN x ELSE y END AS id_a, CASE WHEN swap THEN s ELSE f END AS pool_b, CASE WHEN swap THEN y ELSE x END AS id_b FROM w""",
    "best_of_method": f"""{_SCORED}, r AS (SELECT domain, 'm' || doc_id % 4 AS method, doc_id AS place, row_number() OVER (PARTITION BY domain, doc_id % 4 ORDER BY score DESC, lower(title), doc_id) AS k FROM s)
        SELECT domain, method, place FROM r WHERE k = 1""",
    "common_schema": _common_sql(),
    "packet_counts": f"WITH c AS ({_common_sql()}) SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {_p(f)}) AS {f}" for f in rubrics.FIELDS if f not in ("candidate_id", "domain")) + " FROM c",
}

QUERIES = {
    f.__name__: f
    for f in (
        candidate_flags, formulation_caps, quality_caps, personalized_caps, role_caps, batch_caps, reply_validation, preference_validation, side_validation,
        ranking_validation, batch_validation, merged_roles, win_rates_by_method, criterion_win_rates, candidate_win_counts, pair_unblind, rank_rows,
        special_winner_counts, domain_winners, calibration_checks, selection_scores, pool_selection, pool_pairs, best_of_method, common_schema, packet_counts,
    )
}
