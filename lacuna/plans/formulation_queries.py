"""Gate, formulation, formalisation and counterevidence queries over the tables in those roles, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import formal, formulations, gates, lookup
from lacuna.plans.extraction_queries import _pick, _sql_list, _sql_pick
from lacuna.plans.views import table

# --- the gate: orders are gaps, five rows of agents each ---

_LABELS = ["keep", "drop generic", "REJECTED", "Strong", "reject: weak"]


def _agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    agents = table(spark, sf_dir, "orders").select(k, F.posexplode(F.array(*[F.lit(a) for a in gates.AGENTS])).alias("i", "agent_name"))
    return agents.where(~((k % 13 == 0) & (F.col("i") == 2))).select(
        k.alias("gap_id"), "agent_name", F.when((k + F.col("i")) % 17 == 0, "Failed after retries: x").otherwise("ok").alias("summary"),
        F.when(k % 23 == 0, "n/a").otherwise(((k + F.col("i")) % 10 / 10.0).cast("string")).alias("confidence"),
        F.when((k + F.col("i")) % 19 == 0, F.array(F.lit("agent_Parse_Failure"))).alias("failure_modes"), F.lit(None).cast("string").alias("critic_label"), F.lit("").alias("review_label"),
        F.when(k % 3 == 0, _pick(_LABELS, k)).alias("quality_label"), F.lit(None).cast("string").alias("recommendation"), F.when(k % 7 == 0, _pick(_LABELS, k + 1)).alias("verdict"),
    )


def _assess(spark: SparkSession, sf_dir: str, gate: gates.Gate) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    scores = o.select(F.col("o_orderkey").alias("gap_id"), ((F.col("o_orderkey") % 100) / 100.0).alias("gap_survival_score"))
    told = o.where("o_orderkey % 29 = 0").select(F.col("o_orderkey").alias("gap_id"), F.lit("2.0").alias("parse_failures"))
    return gates.assessed(_agents(spark, sf_dir), scores, told, gate)


def _flat(rows: DataFrame) -> DataFrame:
    return gates.decision_table(rows).select("gap_id", "gate_mode", "passed", "parse_failure_count", "agents_present", "failure_reasons", F.round(F.coalesce("critic_confidence", F.lit(-1.0)), 6).alias("critic_confidence"))


def gate_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_assess(spark, sf_dir, gates.Gate()))


def gate_critic_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_assess(spark, sf_dir, gates.Gate(mode="critic_label", require_all_agents=False, fail_on_agent_parse_failure=False)))


def gate_reviewed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_assess(spark, sf_dir, gates.Gate(mode="reviewed_only")))


def direct_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many gaps go on from each source."""
    found, gaps = _assess(spark, sf_dir, gates.Gate()), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gap_id"))
    out = None
    for source in ("verification_passed_gaps", "verification_reviewed_gaps", "novelty_survivors"):
        part = gates.direct_inputs(gaps, found, source).groupBy("verification_provenance").agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def agent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents' rows from summaries of three shapes and from result lines."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    row = lambda agent, tag: F.concat(F.lit(f'{{"agent_name": "{agent}", "summary": "{tag}'), c, F.lit('"}'))
    body = F.when(k % 3 == 0, F.concat(F.lit("["), row("support", "a"), F.lit(", "), row("critic", "b"), F.lit("]"))).when(k % 3 == 1, row("skeptic", "c")).otherwise(
        F.concat(F.lit('{"support": {"summary": "d'), c, F.lit('"}, "mechanism": {"summary": "e"}}')))
    o = table(spark, sf_dir, "orders")
    lines = o.where("o_orderkey % 4 = 0").select(k.cast("string").alias("gap_id"), F.lit("support").alias("agent"), F.concat(F.lit('{"summary": "late'), c, F.lit('"}')).alias("body"))
    return gates.agent_rows(o.select(k.cast("string").alias("gap_id"), body.alias("body")), lines).select("gap_id", "agent_name", "summary")


def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.verification_summary(_agents(spark, sf_dir)).select("gap_id", "parse_failures", F.coalesce("mean_confidence", F.lit(-1.0)).alias("mean_confidence"))


def agents_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.by_agent(_agents(spark, sf_dir), "summary")


# --- variants: orders are variants of their customers' formulations ---

_NUM = {
    "coherence_score": 5, "specificity_score": 7, "term_soup_risk": 11, "non_incrementality_score": 3, "incrementality_risk": 13, "ambition_score": 9,
    "feasibility_score": 6, "seed_alignment_score": 8, "critic_non_incrementality_score": 4, "critic_incrementality_risk": 17, "critic_fake_ambition_risk": 19,
}
_QUALITY = ["STRONG_NON_INCREMENTAL", "VALID_BUT_MODEST", "STRONG_NON_INCREMENTAL", "INCREMENTAL_REPHRASING", "VALID_BUT_MODEST", "FAKE_AMBITION", "STRONG_NON_INCREMENTAL"]
_SUPPORTED = ["strong", "moderate", "Weak", "Strong"]
TOPIC = ("alpha1", "beta2", "gamma3", "gamma4", "alpha7", "beta9")


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    third = F.floor(c / 3).cast("long")
    low = ("term_soup_risk", "incrementality_risk", "critic_incrementality_risk", "critic_fake_ambition_risk")
    number = lambda n, p: F.when(k % 31 == 0, F.lit(None).cast("double")).otherwise(F.when(F.lit(n in low), (k % p) / 25.0).otherwise(1 - (k % p) / 20.0))
    return table(spark, sf_dir, "orders").select(
        k.alias("variant_id"), F.concat(F.lit("s"), F.floor(k / 4).cast("long")).alias("source_formulation_id"), F.when(k % 5 == 0, F.concat(F.lit("g"), F.floor(k / 16).cast("long"))).otherwise("").alias("source_verified_gap_id"),
        F.array(F.concat(F.lit("p"), c), F.concat(F.lit("p"), c + 1), F.concat(F.lit("p"), c + k % 2)).alias("supporting_papers"),
        F.concat(F.lit("alpha"), third, F.lit(" beta"), third, F.lit(" of gamma"), c % 7).alias("core_setting"), F.when(k % 37 == 0, "").otherwise(F.sha1(F.concat(F.lit("k"), third))).alias("broader_problem_class"),
        F.sha1(F.concat(F.lit("t"), c, F.lit("-"), k % 3)).alias("title"), F.sha1(F.concat(F.lit("x"), F.floor(k / 2).cast("long"))).alias("problem_statement"),
        *[number(n, p).alias(n) for n, p in _NUM.items()], _pick(["KEEP", "maybe", "Drop"], k).alias("recommendation"), _pick(["low", "High", "medium"], c).alias("named_method_dependency"),
        _pick(["benchmark", "theorem", "empirical_study"], k).alias("contribution_type"), _pick(["a class", " "], F.floor(k / 3).cast("long")).alias("method_class_scope"), _pick(["because", "because", ""], c).alias("why_not_just_validation"),
        (k % 29 != 0).alias("critic_broader_problem_class_valid"), (k % 23 != 0).alias("critic_contribution_type_valid"), _pick(_QUALITY, k).alias("critic_quality_label"),
        _pick(_SUPPORTED, c).alias("critic_supported_by_source"), k.alias("expanded_rank"),
    )


def variant_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir).select("variant_id", formulations.generator_gate().alias("generator"), formulations.critic_gate().alias("critic"), F.round(formulations.variant_score(), 6).alias("score"))


def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formulations.merge_edges(_variants(spark, sf_dir), TOPIC)


def family_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of the variants that share a customer's third: the whole rubric."""
    v = _variants(spark, sf_dir)
    third = v.select("variant_id", F.col("core_setting").substr(1, 1000).alias("key")).withColumn("key", F.split_part("key", F.lit(" of "), F.lit(1)))
    least = third.groupBy("key").agg(F.min("variant_id").alias("a"))
    links = third.join(least, "key").where("variant_id <> a").select("a", F.col("variant_id").alias("b"))
    f = formulations.families(v, links, TOPIC)
    f = f.withColumn("said", formulations.caveats("downgrade_reasons"))
    return f.select(
        F.col("component").alias("family"), "representative_variant_id", "n", F.size("supporting_papers").cast("long").alias("papers"), "evidence_grounding", "non_incrementality", "specificity",
        "plausibility", "domain_fit", "quality_label", "recommended_action", F.array_join("downgrade_reasons", ";").alias("downgrade_reasons"), F.coalesce("maybe_recoverable_as", F.lit("")).alias("recover"),
        "label_inconsistency_warning", formulations.tier(F.col("quality_label")).cast("long").alias("tier"), F.sha1("said").alias("caveats"),
    )


def expansion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formulations.expansion_metrics(_variants(spark, sf_dir))


# --- formal problems: documents are families ---

_WORDS = ["policy", "observation of data", "hidden prior", "failure boundary", "", "reward curve", "estimate the rank over time", "environment process"]


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    say = lambda i: _pick(_WORDS, k * (i + 1) + F.floor(k / 8).cast("long"))
    conf = F.concat(F.lit('"formalization_confidence": "'), _pick(["high", "low", "sure", "medium"], k), F.lit('"'))
    setup = F.concat(
        F.lit('"mathematical_setup": {"feedback_or_measurement_model": "'), _pick(["", "a log", "unclear still"], F.floor(k / 2).cast("long")), F.lit('", "objective": "'), _pick(["min J", ""], F.floor(k / 3).cast("long")),
        F.lit('", "variables": [{"symbol": "'), _pick(["R", "x", ""], F.floor(k / 5).cast("long")), F.lit('", "meaning": "'), _pick(["the research object", "a price", ""], F.floor(k / 7).cast("long")), F.lit('", "type": "'), _pick(["Scalar", "tensor"], k), F.lit('"}]}'),
    )
    flags = F.when(k % 4 == 0, F.lit(', "ambiguity_flags": [{"term": "Boundary"}, {}]')).otherwise("")
    reply = F.when(k % 9 == 0, "no json").otherwise(F.concat(F.lit("{"), conf, F.lit(", "), setup, flags, F.when(k % 6 == 0, F.lit(', "requires_human_definition": false, "assumptions": [{"name": "iid", "status": "KEPT"}]')).otherwise(""), F.lit("}")))
    return table(spark, sf_dir, "documents").select(
        k.alias("family_id"), F.concat(F.lit("family "), k % 10).alias("family_title"), F.col("lang").alias("representative_problem_statement"), F.lit(None).cast("string").alias("proposal_style_abstract"),
        say(0).alias("research_object"), say(1).alias("problem_class"), say(2).alias("assumption_shift"), say(3).alias("failure_boundary_or_mechanism"), say(4).alias("theorem_target"),
        F.lit("").alias("algorithmic_target"), _pick(["a benchmark", ""], k).alias("empirical_target"), reply.alias("reply"),
    )


def formal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = formal.normalised(_families(spark, sf_dir))
    return r.select(
        "family_id", F.array_join(F.transform("variables", lambda v: F.concat_ws(":", v["symbol"], v["type"])), ";").alias("variables"), F.array_join("entities", ";").alias("entities"),
        F.array_join("ambiguity_flags", ";").alias("flags"), "formalization_confidence", "requires_human_definition", F.array_join(F.transform("assumptions", lambda a: F.concat_ws(":", a["name"], a["status"])), ";").alias("assumptions"),
        "theorem", F.sha1(F.concat_ws("|", "formal_problem_statement", "feedback_or_measurement_model", "objective")).alias("digest"),
    )


def formal_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = formal.fallback(_families(spark, sf_dir), "parse error")
    return r.select("family_id", F.sha1("formal_problem_statement").alias("statement"), F.sha1("objective").alias("objective"), F.array_join("ambiguity_flags", ";").alias("flags"), F.size("variables").cast("long").alias("n_variables"))


def formal_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = _families(spark, sf_dir)
    return formal.audit(formal.normalised(families.where("family_id % 50 <> 1")), families)


# --- counterevidence: parts name gaps, orders' customers the records ---

_TOPICS = ["convex loss under drift", "linear reward model", "known horizon oracle", "sparse graph sample", "noisy label budget", "stationary kernel arm"]
_FOUND = ["non-convex loss and heavy tail drift", "horizon-free method without oracle access", "adaptive kernel for sparse graph", "robust reward under adversarial drift", "nothing here", "un-stationary armed budget"]


def _lookup(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    gaps = table(spark, sf_dir, "part").select(
        F.concat(F.lit("g"), p).alias("node_id"), F.concat(_pick(_TOPICS, p), F.lit(" "), F.col("p_name")).alias("label"), F.array(F.concat(F.lit("q"), p % 40), F.concat(F.lit("q"), p % 7)).alias("paper_ids"),
        _pick(_TOPICS, p * 5 + 2).alias("evidence"),
    )
    records = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("r"), s).alias("record_id"), F.concat(F.lit("q"), s % 50).alias("paper_id"), _pick(_FOUND, s).alias("target_problem"), _pick(["", "noise"], s).alias("addressed_condition"), F.lit("").alias("scope"),
        F.concat(F.lit("part "), s).alias("method"), _pick(_TOPICS, s * 7 + 1).alias("evidence_text"), _pick(["", "old widget", "red plate baseline"], s).alias("prior_work_or_baseline"),
    )
    nodes = table(spark, sf_dir, "part").select(
        F.concat(F.lit("m"), p).alias("id"), F.when(p % 3 == 0, "Limitation").otherwise("Method").alias("type"), F.col("p_name").alias("label"), F.array(F.concat(F.lit("q"), p % 60)).alias("paper_ids")
    )
    edges = table(spark, sf_dir, "part").select(
        F.concat(F.lit("e"), p).alias("id"), F.concat(F.lit("m"), p).alias("source"), F.concat(F.lit("m"), (p * 7 + 3) % 200).alias("target"),
        _pick(["improves_over", "counterevidence_for", "limited_by", "partially_addresses_gap"], p).alias("relation"), F.when(p % 4 == 1, F.concat(F.lit("gap"), p % 90)).alias("linked_gap_id"),
    )
    return gaps, records, nodes, edges


def counter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps, records, nodes, edges = _lookup(spark, sf_dir)
    from lacuna.operators.retrieval import anchor_terms

    anchors = anchor_terms(nodes.select("label").unionByName(gaps.select("label")), 100)
    out = lookup.scored_pairs(gaps, records, lookup.improved_papers(nodes, edges), lookup.method_tokens(nodes), anchors)
    return out.select("node_id", "record_id", "candidate_id", F.round("score", 6).alias("score"), F.round("contrast", 6).alias("contrast"), F.round("graph", 6).alias("graph"), F.round("anchor", 6).alias("anchor"))


def counter_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counterevidence edges that gaps find by their nodes, traced edges, labels and references."""
    _, _, nodes, edges = _lookup(spark, sf_dir)
    p = F.col("p_partkey")
    gaps = table(spark, sf_dir, "part").select(
        F.concat(F.lit("gap"), p).alias("gap_id"), F.lit(None).cast("string").alias("motif_id"), F.array(F.concat(F.lit("m"), p + 5)).alias("core_ids"),
        F.array(F.concat(F.lit("m"), p), F.concat(F.lit("e"), p * 2)).alias("traceability_path"), F.upper("p_name").alias("gap"),
    )
    return lookup.found_for(gaps, nodes, edges)


def counter_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier replies and the edges that they make."""
    k = F.col("o_orderkey")
    label = _pick(["Fully_addresses", "relaxes_assumption", "unrelated", "handles_failure_condition", "solved"], k)
    reply = F.when(k % 13 == 0, "oops").otherwise(F.concat(
        F.lit('{"label": "'), label, F.lit('", "scope_match": "'), _pick(["full", "FULL", "none"], k), F.lit('", "confidence": '), F.when(k % 7 == 0, '"high"').otherwise((k % 12 / 10.0).cast("string")),
        F.lit(', "should_create_counterevidence_edge": '), F.when(k % 4 == 0, "false").otherwise("true"), F.lit("}")))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("g"), k).alias("node_id"), F.col("o_custkey").cast("string").alias("paper_id"), reply.alias("reply"))
    return lookup.counter_edges(lookup.classified(rows)).select("id", "source", "target", "relation", "scope_match", F.round("classifier_confidence", 6).alias("confidence"))


# --- DuckDB ---

_AG = f"""o AS (SELECT o_orderkey AS k FROM orders), a AS (SELECT k, unnest(range(0, 5)) AS i FROM o),
    r AS (SELECT k, i, ({_sql_list(gates.AGENTS)})[i + 1] AS agent, (k + i) % 17 = 0 OR (k + i) % 19 = 0 AS failed, CASE WHEN k % 23 <> 0 THEN ((k + i) % 10) / 10.0 END AS conf FROM a WHERE NOT (k % 13 = 0 AND i = 2))"""
_BAD = " OR ".join(f"(k % {m} = 0 AND {_sql_pick([x.upper().replace(' ', '_') for x in _LABELS], f'k + {d}')} SIMILAR TO '(DROP|REJECT).*')" for m, d in ((3, 0), (7, 1)))
_GATE = f"""WITH {_AG}, g AS (SELECT k, array_to_string(list_sort(list(agent)), ';') AS agents, count(*) AS n, count(*) FILTER (WHERE failed) AS f0, max(conf) FILTER (WHERE i = 4) AS conf,
      bool_or(i = 4 AND NOT failed AND NOT ({_BAD}) AND coalesce(conf, 0) >= 0.5) AS sound FROM r GROUP BY k),
    v AS (SELECT *, greatest(f0, CASE WHEN k % 29 = 0 THEN 2 ELSE 0 END) AS f, (k % 100) / 100.0 AS score FROM g)"""


def _gate_sql(mode: str, where: str, reasons: str) -> str:
    return f"""{_GATE} SELECT k AS gap_id, '{mode}' AS gate_mode, {reasons} = '' AS passed, f AS parse_failure_count, agents AS agents_present, {reasons} AS failure_reasons,
        round(coalesce(conf, -1), 6)::DOUBLE AS critic_confidence FROM v WHERE {where}"""


_SURVIVAL = "concat_ws(';', CASE WHEN f > 0 THEN 'agent_parse_failures:' || f END, CASE WHEN score < 0.6 THEN 'survival_score_below_threshold:' || printf('%.3f', score) || '<0.600' END, CASE WHEN NOT sound THEN 'critic_reject_or_low_confidence' END)"
_LOWNUM = ("term_soup_risk", "incrementality_risk", "critic_incrementality_risk", "critic_fake_ambition_risk")


def _num(n: str) -> str:
    p = _NUM[n]
    return f"(CASE WHEN k % 31 <> 0 THEN {f'(k % {p}) / 25.0::DOUBLE' if n in _LOWNUM else f'1 - (k % {p}) / 20.0::DOUBLE'} END)"


def _gt(table_: dict) -> str:
    return " AND ".join(f"coalesce({_num(n)}, {0.0 if op == '>=' else 1.0}) {op} {b}" for n, (op, b) in table_.items())


_VAR = f"""v AS (SELECT o_orderkey AS k, o_custkey AS c, o_custkey // 3 AS t3, {_sql_pick(['KEEP', 'MAYBE', 'DROP'], 'o_orderkey')} AS rec, o_custkey % 3 = 1 AS named, {_sql_pick(['benchmark', 'theorem', 'empirical_study'], 'o_orderkey')} AS kind,
      (o_orderkey // 3) % 2 = 0 AS scoped, o_custkey % 3 < 2 AS why, {_sql_pick(_QUALITY, 'o_orderkey')} AS ql, {_sql_pick([x.lower() for x in _SUPPORTED], 'o_custkey')} AS sup,
      CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE sha1('k' || o_custkey // 3) END AS cls, sha1('t' || o_custkey || '-' || o_orderkey % 3) AS title, sha1('x' || o_orderkey // 2) AS stmt FROM orders),
    gg AS (SELECT *, rec IN ('KEEP', 'MAYBE') AND {_gt(formulations.GENERATOR)} AND cls <> '' AND why AND (NOT named OR (kind IN ('benchmark', 'empirical_study') AND scoped)) AS gen,
      {_gt(formulations.CRITIC)} AND k % 29 <> 0 AND k % 23 <> 0 AND ql IN {formulations.KEEP_LABELS} AND sup IN {formulations.SUPPORT} AS crit FROM v)"""
_WSTOP = _sql_list(formulations.STOPS)
_NOID = _sql_list([*TOPIC, *formulations.FRAMING, *formulations.KINDS])


def _words(x: str) -> str:
    return f"list_filter(regexp_extract_all({x}, '[a-z][a-z0-9\\-]+'), lambda w: length(w) > 2 AND NOT list_contains({_WSTOP}, w))"


_OBJ = f"list_distinct(list_concat({_words(chr(39) + 'alpha' + chr(39) + ' || t3 || ' + chr(39) + ' beta' + chr(39) + ' || t3 || ' + chr(39) + ' of gamma' + chr(39) + ' || c % 7')}, {_words('cls')}, {_words('title')}))"
_CAVE = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in formulations.CAVEATS.items()) + " ELSE x END"
_REASONS = [
    ("dups", "duplicate_of_stronger_family"), ("fake >= 0.35 OR hasfake", "fake_ambition_risk"), ("plaus = 'weak'", "formal_plausibility_concern"), ("nil <> 'strong' OR hasinc", "incremental_or_validation_only"),
    ("fit IN ('weak', 'moderate')", "low_domain_fit"), ("fit = 'weak'", "off_domain"), ("spec = 'weak'", "too_broad"), ("named", "too_method_specific"), ("unclear", "unclear_problem_object"), ("ev = 'weak'", "weak_source_support"),
]
_FAMILY = f"""w AS (SELECT *, {_OBJ} AS obj, coalesce({_num('critic_non_incrementality_score')}, 0) AS ni, coalesce({_num('critic_fake_ambition_risk')}, 1) AS fk, coalesce({_num('specificity_score')}, 0) AS sp, coalesce({_num('feasibility_score')}, 0) AS fe FROM v),
    rep AS (SELECT t3, arg_min(k, (-ni, fk, k)) AS rk, arg_min(title, (-ni, fk, k)) AS rt, arg_min(stmt, (-ni, fk, k)) AS rs FROM w GROUP BY t3),
    f0 AS (SELECT w.t3, min(k) AS family, any_value(rk) AS rk, count(*) AS n, count(*) FILTER (WHERE k <> rk AND (title = rt OR stmt = rs)) AS d, max(CASE sup WHEN 'strong' THEN 2 WHEN 'moderate' THEN 1 ELSE 0 END) AS sup,
      max(ni) AS ni, max(sp) AS sp, max(fe) AS fe, min(fk) AS fake, bool_or(ql = 'FAKE_AMBITION') AS hasfake, bool_or(ql = 'INCREMENTAL_REPHRASING') AS hasinc, bool_or(named) AS named,
      list_distinct(flatten(list(obj))) AS obj, max(length(trim(CASE WHEN cls <> '' THEN cls || ' ' ELSE ' ' END || 'alpha' || w.t3 || ' beta' || w.t3 || ' of gamma' || c % 7))) AS oc, len(list_distinct(flatten(list(['p' || c, 'p' || (c + 1), 'p' || (c + k % 2)])))) AS papers
      FROM w JOIN rep USING (t3) GROUP BY w.t3),
    f1 AS (SELECT *, ['weak', 'moderate', 'strong'][sup + 1] AS ev, CASE WHEN ni >= 0.85 THEN 'strong' WHEN ni >= 0.7 THEN 'moderate' ELSE 'weak' END AS nil, CASE WHEN sp >= 0.8 THEN 'strong' WHEN sp >= 0.6 THEN 'moderate' ELSE 'weak' END AS spec,
      CASE WHEN fe >= 0.7 AND fake <= 0.2 THEN 'strong' WHEN fake >= 0.35 OR fe < 0.5 THEN 'weak' ELSE 'moderate' END AS plaus, CASE WHEN len(list_filter(obj, lambda x: list_contains({_sql_list(TOPIC)}, x))) >= 2 THEN 'strong'
        WHEN len(list_filter(obj, lambda x: list_contains({_sql_list(TOPIC)}, x))) = 1 THEN 'moderate' ELSE 'weak' END AS fit, n > 1 AND d = n - 1 AS dups, len(list_filter(obj, lambda x: NOT list_contains({_NOID}, x))) = 0 OR oc < 15 AS unclear FROM f0),
    f2 AS (SELECT *, CASE WHEN fit = 'weak' OR hasfake OR hasinc OR plaus = 'weak' OR dups THEN 'D_DROP' WHEN ev <> 'weak' AND nil = 'strong' AND spec <> 'weak' AND plaus <> 'weak' AND fit = 'strong' THEN 'A_STRONG'
        WHEN nil <> 'weak' AND (spec = 'weak' OR ev = 'weak' OR fit = 'moderate') THEN 'B_PROMISING_NEEDS_REFRAMING' ELSE 'C_LOW_PRIORITY' END AS label, list_filter([{', '.join(f"CASE WHEN {t} THEN '{n}' END" for t, n in _REASONS)}], lambda x: x IS NOT NULL) AS dr0 FROM f1),
    f3 AS (SELECT *, CASE WHEN label = 'D_DROP' AND len(dr0) = 0 THEN [CASE WHEN plaus <> 'strong' THEN 'formal_plausibility_concern' ELSE 'low_domain_fit' END] ELSE dr0 END AS dr FROM f2),
    f4 AS (SELECT *, array_to_string(list_transform(list_filter(dr, lambda x: NOT (x = 'low_domain_fit' AND list_contains(dr, 'off_domain'))), lambda x: {_CAVE}), '; ') AS cv FROM f3)"""

_FW = {i: _sql_pick(_WORDS, f"doc_id * {i + 1} + doc_id // 8") for i in range(5)}
_FAMS = f"""fam AS (SELECT doc_id, 'family ' || doc_id % 10 AS title, lang, {', '.join(f'{_FW[i]} AS w{i}' for i in range(5))}, CASE WHEN doc_id % 2 = 0 THEN 'a benchmark' ELSE '' END AS emp, doc_id % 9 = 0 AS bad,
      {_sql_pick(['high', 'low', 'medium', 'medium'], 'doc_id')} AS said, {_sql_pick(['', 'a log', 'unclear still'], 'doc_id // 2')} AS fb0, {_sql_pick(['min J', ''], 'doc_id // 3')} AS ob0, {_sql_pick(['R', 'x', ''], 'doc_id // 5')} AS sym,
      {_sql_pick(['the research object', 'a price', ''], 'doc_id // 7')} AS mean, {_sql_pick(['scalar', 'other'], 'doc_id')} AS typ FROM documents),
    e AS (SELECT *, concat_ws(' ', title, nullif(lang, ''), nullif(w0, ''), nullif(w1, ''), nullif(w2, ''), nullif(w3, ''), nullif(w4, ''), nullif(emp, '')) AS ground, CASE WHEN w0 <> '' THEN w0 ELSE title END AS setting,
      CASE WHEN bad THEN '' ELSE fb0 END AS fb, CASE WHEN bad THEN '' ELSE ob0 END AS ob, lower(concat_ws(' ', title, w3, w2, w1, w0)) AS hint FROM fam)"""
_VARS = "list_filter([" + ", ".join(
    f"CASE WHEN {' OR '.join([*(f'contains(ground, {chr(39)}{w}{chr(39)})' for w in words), *(['TRUE'] if s == 'o_t' else [])])} THEN '{s}:{k}' END" for s, _, k, words in formal.VARIABLES
) + "], lambda x: x IS NOT NULL)"
_ENTS = "list_filter([setting, " + ", ".join(f"CASE WHEN {' OR '.join(f'contains(ground, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{n}' END" for n, words in formal.ENTITIES) + ", 'candidate method or analysis procedure'], lambda x: x IS NOT NULL)"
_TARGET = "coalesce(nullif(concat_ws('; ', CASE WHEN w4 <> '' THEN 'theorem target: ' || w4 END, CASE WHEN emp <> '' THEN 'empirical or benchmark target: ' || emp END), ''), 'a theorem, algorithmic target, or empirical benchmark chosen from the source papers')"

_LK = f"""g AS (SELECT 'g' || p_partkey AS node_id, lower({_sql_pick(_TOPICS, 'p_partkey')} || ' ' || p_name || ' ' || {_sql_pick(_TOPICS, 'p_partkey * 5 + 2')}) AS txt, {_sql_pick(_TOPICS, 'p_partkey')} || ' ' || p_name AS label,
      ['q' || p_partkey % 40, 'q' || p_partkey % 7] AS papers FROM part),
    g2 AS (SELECT *, list_distinct(regexp_extract_all(txt, '[a-z0-9]{{3,}}')) AS gt FROM g),
    r AS (SELECT 'r' || s_suppkey AS record_id, 'q' || s_suppkey % 50 AS paper, {_sql_pick(_FOUND, 's_suppkey')} AS tp, {_sql_pick(['', 'noise'], 's_suppkey')} AS ac, 'part ' || s_suppkey AS m, {_sql_pick(_TOPICS, 's_suppkey * 7 + 1')} AS ev,
      {_sql_pick(['', 'old widget', 'red plate baseline'], 's_suppkey')} AS prior FROM supplier),
    r2 AS (SELECT *, list_distinct(regexp_extract_all(lower(tp || ' ' || ac || '  ' || m), '[a-z0-9]{{3,}}')) AS rt, list_distinct(regexp_extract_all(lower(ev), '[a-z0-9]{{3,}}')) AS et, lower(tp || ' ' || ac || ' ' || ev) AS txt,
      regexp_extract_all(lower(prior), '[a-z0-9]{{3,}}') AS pt FROM r),
    n AS (SELECT 'm' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'Limitation' ELSE 'Method' END AS type, p_name AS label, 'q' || p_partkey % 60 AS paper FROM part),
    ed AS (SELECT 'e' || p_partkey AS id, 'm' || p_partkey AS source, 'm' || (p_partkey * 7 + 3) % 200 AS target, {_sql_pick(['improves_over', 'counterevidence_for', 'limited_by', 'partially_addresses_gap'], 'p_partkey')} AS relation,
      CASE WHEN p_partkey % 4 = 1 THEN 'gap' || p_partkey % 90 END AS ref FROM part),
    imp AS (SELECT DISTINCT a.paper AS p, b.paper AS q FROM ed JOIN n a ON a.id = source JOIN n b ON b.id = target WHERE relation = 'improves_over'),
    mt AS (SELECT paper, list_distinct(flatten(list(regexp_extract_all(lower(label), '[a-z0-9]{{3,}}')))) AS toks FROM n WHERE type = 'Method' GROUP BY paper),
    anc AS (SELECT list(t) AS a FROM (SELECT t, count(*) AS c FROM (SELECT unnest(regexp_extract_all(lower(label), '[a-z0-9]{{5,}}')) AS t FROM (SELECT label FROM n UNION ALL SELECT label FROM g)) GROUP BY t ORDER BY c DESC, t LIMIT 100)),
    gm AS (SELECT g2.*, list_distinct(flatten(list(coalesce(toks, [])))) AS known FROM (SELECT *, unnest(list_distinct(papers)) AS p1 FROM g2) g2 LEFT JOIN mt ON mt.paper = p1 GROUP BY ALL),
    gk AS (SELECT node_id, any_value(gt) AS gt, any_value(papers) AS papers, list_distinct(flatten(list(known))) AS known FROM gm GROUP BY node_id),
    x AS (SELECT node_id, record_id, len(list_intersect(gt, rt)) / nullif(len(gt) + len(rt) - len(list_intersect(gt, rt)), 0) AS ov,
      least(0.3::DOUBLE, 0.1::DOUBLE * ({' + '.join(f"CAST(len(list_filter(gt, lambda t: length(t) >= 4 AND (contains(txt, '{p}' || t) OR contains(txt, '{p} ' || t)))) > 0 AS INTEGER)" for p in lookup.CONTRAST)})) AS co,
      CASE WHEN list_contains(papers, paper) THEN -0.1 WHEN len(list_intersect(papers, coalesce((SELECT list(q) FROM imp WHERE p = paper), []))) > 0 THEN 0.1 ELSE 0 END AS c0, len(list_intersect(pt, known)) > 0 AS pr,
      CASE WHEN len(list_intersect(list_intersect(gt, et), (SELECT a FROM anc))) >= 2 THEN 0.1 ELSE 0 END AS an FROM gk, r2),
    y AS (SELECT node_id, record_id, coalesce(ov, 0)::DOUBLE AS ov, co::DOUBLE AS co, (CASE WHEN pr THEN least(0.2, c0 + 0.15) ELSE c0 END)::DOUBLE AS gr, an::DOUBLE AS an FROM x),
    z AS (SELECT *, round(least(1.0::DOUBLE, ov + co + gr + an), 9) AS score FROM y),
    k AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, record_id) AS rn FROM z WHERE score >= 0.2)"""

ORACLE_SQL = {
    "gate_survival": _gate_sql("survival_score", "n = 5", _SURVIVAL),
    "gate_critic_label": _gate_sql("critic_label", "TRUE", "CASE WHEN NOT coalesce(sound, false) THEN 'critic_reject_or_low_confidence;critic_label_gate_failed' ELSE '' END"),
    "gate_reviewed_only": _gate_sql("reviewed_only", "n = 5", "'reviewed_only_mode_no_pass_gate'"),
    "direct_inputs": f"""{_GATE}, d AS (SELECT {_SURVIVAL} AS why FROM v WHERE n = 5) SELECT 'VERIFICATION_PASSED' AS verification_provenance, count(*) AS n FROM d WHERE why = ''
        UNION ALL SELECT 'VERIFICATION_REVIEWED', count(*) FROM d UNION ALL SELECT 'NOVELTY_ONLY', count(*) FROM orders""",
    "agent_rows": """WITH s AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS c FROM orders), r AS (SELECT k, 'support' AS a, CASE WHEN k % 4 = 0 THEN 'late' || c WHEN k % 3 = 0 THEN 'a' || c ELSE 'd' || c END AS m FROM s WHERE k % 4 = 0 OR k % 3 <> 1
          UNION ALL SELECT k, 'critic', 'b' || c FROM s WHERE k % 3 = 0 UNION ALL SELECT k, 'skeptic', 'c' || c FROM s WHERE k % 3 = 1 UNION ALL SELECT k, 'mechanism', 'e' FROM s WHERE k % 3 = 2) SELECT CAST(k AS VARCHAR) AS gap_id, a AS agent_name, m AS summary FROM r""",
    "verification_summary": f"WITH {_AG} SELECT k AS gap_id, count(*) FILTER (WHERE failed) AS parse_failures, coalesce(round(avg(conf::DOUBLE) FILTER (WHERE conf > 0), 6), -1) AS mean_confidence FROM r GROUP BY 1",
    "agents_pivot": f"WITH {_AG} SELECT k AS gap_id, " + ", ".join(f"max(CASE WHEN (k + i) % 17 = 0 THEN 'Failed after retries: x' ELSE 'ok' END) FILTER (WHERE i = {i}) AS {a}" for i, a in enumerate(gates.AGENTS)) + " FROM r GROUP BY 1",
    "variant_gates": f"""WITH {_VAR} SELECT k AS variant_id, gen AS generator, crit AS critic, round(1.5::DOUBLE * {_num('non_incrementality_score')} + {_num('ambition_score')} + {_num('coherence_score')} + {_num('specificity_score')} - {_num('incrementality_risk')}
        + 0.5::DOUBLE * {_num('seed_alignment_score')}, 6) AS score FROM gg""",
    "merge_edges": f"""WITH {_VAR}, s AS (SELECT k, 's' || k // 4 AS src, CASE WHEN k % 5 = 0 THEN 'g' || k // 16 ELSE '' END AS gap, list_distinct(['p' || c, 'p' || (c + 1), 'p' || (c + k % 2)]) AS pp, list_filter({_OBJ}, lambda w: NOT list_contains({_NOID}, w)) AS id, title, stmt, cls, c, t3 FROM v),
        a AS (SELECT m AS a, k AS b, 'A_same_source_direct_formulation' AS rule FROM s JOIN (SELECT src, min(k) AS m FROM s GROUP BY 1) USING (src) WHERE k <> m), b AS (SELECT m AS a, k AS b, 'B_same_source_verified_gap' AS rule FROM s JOIN (SELECT gap, min(k) AS m FROM s WHERE gap <> '' GROUP BY 1) USING (gap) WHERE k <> m),
        p AS (SELECT x.k AS a, y.k AS b, len(list_intersect(x.pp, y.pp)) / (len(x.pp) + len(y.pp) - len(list_intersect(x.pp, y.pp))) AS pj, len(list_intersect(x.id, y.id)) AS io, x.title = y.title OR x.stmt = y.stmt AS same, x.cls = y.cls AND x.cls <> '' AS ck
          FROM s x JOIN s y ON x.k < y.k AND (x.t3 = y.t3 OR abs(x.c - y.c) <= 2)
          UNION ALL SELECT x.k, y.k, 0, 0, TRUE, FALSE FROM s x JOIN s y ON x.stmt = y.stmt AND x.k < y.k AND x.t3 <> y.t3 AND abs(x.c - y.c) > 2),
        q AS (SELECT a, b, CASE WHEN pj >= 0.5 AND io >= 2 THEN 'C_paper_jaccard_and_identity_overlap' WHEN same THEN 'D_title_problem_similarity' WHEN ck AND io >= 3 THEN 'E_same_problem_class_and_identity_overlap' END AS rule FROM p)
        SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT a, b, rule FROM q WHERE rule IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a z WHERE z.a = q.a AND z.b = q.b) AND NOT EXISTS (SELECT 1 FROM b z WHERE z.a = q.a AND z.b = q.b)""",
    "family_rubric": f"""WITH {_VAR}, {_FAMILY} SELECT family, rk AS representative_variant_id, n, papers, ev AS evidence_grounding, nil AS non_incrementality, spec AS specificity, plaus AS plausibility, fit AS domain_fit, label AS quality_label,
        CASE label WHEN 'A_STRONG' THEN 'READ_FIRST' WHEN 'B_PROMISING_NEEDS_REFRAMING' THEN 'REFRAME' WHEN 'C_LOW_PRIORITY' THEN 'READ_LATER' ELSE 'DROP' END AS recommended_action, array_to_string(dr, ';') AS downgrade_reasons,
        CASE WHEN label NOT IN ('D_DROP', 'C_LOW_PRIORITY') THEN '' WHEN list_contains(dr, 'duplicate_of_stronger_family') THEN 'MERGE_WITH_RELATED_FAMILY' WHEN list_contains(dr, 'off_domain') THEN 'DROP_PERMANENTLY' WHEN label = 'C_LOW_PRIORITY' THEN 'READ_LATER'
          WHEN len(dr) > 0 AND len(list_filter(dr, lambda x: NOT list_contains({_sql_list(formulations.REFRAMABLE)}, x))) = 0 THEN 'REFRAME' ELSE 'DROP_PERMANENTLY' END AS recover,
        label = 'D_DROP' AND ev = 'strong' AND plaus = 'strong' AND fit = 'strong' AS label_inconsistency_warning, CASE label WHEN 'A_STRONG' THEN 1 WHEN 'B_PROMISING_NEEDS_REFRAMING' THEN 2 ELSE 3 END AS tier,
        sha1(CASE WHEN len(dr) = 0 THEN 'No major caveats were flagged.' ELSE upper(substr(cv, 1, 1)) || substr(cv, 2) || '.' END) AS caveats FROM f4""",
    "expansion_metrics": f"""WITH {_VAR} SELECT count(*) AS variants, count(*) FILTER (WHERE gen) AS passing_generator_gate, count(*) FILTER (WHERE gen AND crit) AS passing_final_gate, count(*) FILTER (WHERE coalesce({_num('non_incrementality_score')}, 0) < 0.7) AS dropped_by_non_incrementality_gate,
        count(*) FILTER (WHERE coalesce({_num('incrementality_risk')}, 1) > 0.4) AS dropped_by_incrementality_risk_gate, count(*) FILTER (WHERE gen AND coalesce({_num('critic_non_incrementality_score')}, 0) < 0.7) AS dropped_by_critic_non_incrementality,
        count(*) FILTER (WHERE gen AND coalesce({_num('critic_fake_ambition_risk')}, 1) > 0.35) AS dropped_by_critic_fake_ambition, count(*) FILTER (WHERE gen AND sup NOT IN ('strong', 'moderate')) AS dropped_by_critic_source_support,
        round(avg({_num('non_incrementality_score')}), 3) AS avg_generator_non_incrementality_all, round(avg({_num('critic_non_incrementality_score')}), 3) AS avg_critic_non_incrementality_all FROM gg""",
    "formal_records": f"""WITH {_FAMS}, h AS (SELECT *, list_filter({_sql_list(formal.AMBIGUOUS)}, lambda x: contains(hint, x) AND NOT (x = 'boundary' AND doc_id % 4 = 0 AND NOT bad)) AS hs, fb = '' OR contains(fb, 'unclear') AS uf, fb = '' OR ob = '' AS lack, CASE WHEN bad THEN 'medium' ELSE said END AS s0 FROM e),
        i AS (SELECT *, list_concat(CASE WHEN doc_id % 4 = 0 AND NOT bad THEN ['Boundary', 'under-specified term'] ELSE [] END, CASE WHEN len(hs) > 0 THEN [hs[1]] ELSE [] END, CASE WHEN uf THEN ['feedback_or_measurement_model'] ELSE [] END) AS fl,
          CASE WHEN s0 = 'high' AND (lack OR contains(fb, 'unclear')) THEN 'medium' ELSE s0 END AS s1 FROM h), j AS (SELECT *, CASE WHEN lack AND s1 <> 'medium' THEN 'low' ELSE s1 END AS conf FROM i)
        SELECT doc_id AS family_id, CASE WHEN NOT bad AND NOT (sym = 'R' AND mean = 'the research object') THEN coalesce(nullif(sym, ''), 'X') || ':' || typ ELSE array_to_string({_VARS}, ';') END AS variables, array_to_string({_ENTS}, ';') AS entities, array_to_string(fl, ';') AS flags,
          conf AS formalization_confidence, CASE WHEN NOT bad AND doc_id % 6 = 0 THEN false ELSE len(fl) > 0 OR conf = 'low' END AS requires_human_definition, CASE WHEN NOT bad AND doc_id % 6 = 0 THEN 'iid:kept' ELSE 'source-grounded setting:questioned' END AS assumptions, w4 AS theorem,
          sha1('The question is whether ' || title || ' can be stated as a precise, source-grounded problem with explicit observations, assumptions, and success criteria.|' || CASE WHEN fb = '' THEN 'Unclear from the source family; the feedback or measurement model requires human definition.' ELSE fb END
            || '|' || CASE WHEN ob = '' THEN 'The objective requires human definition from the source papers.' ELSE ob END) AS digest FROM j""",
    "formal_fallbacks": f"""WITH {_FAMS} SELECT doc_id AS family_id, sha1('The question is whether ' || setting || ' can be formulated as an instance of ' || CASE WHEN w1 = '' THEN 'the source problem class' ELSE w1 END || ' when ' || CASE WHEN w2 = '' THEN 'the source assumptions' ELSE w2 END
          || ' and the relevant boundary is ' || CASE WHEN w3 = '' THEN 'the source failure boundary' ELSE w3 END || '. A complete formulation must specify observations, admissible outputs, an objective, constraints, and a success criterion tied to ' || {_TARGET} || '.') AS statement,
        sha1('Make progress toward ' || CASE WHEN w4 <> '' THEN w4 WHEN emp <> '' THEN emp ELSE 'a source-grounded success criterion' END || ' under the stated assumption shift and boundary.') AS objective, 'formalization_parse_error;feedback_or_measurement_model;objective' AS flags, len({_VARS}) AS n_variables FROM e""",
    "formal_audit": f"""WITH {_FAMS}, h AS (SELECT *, len(list_filter({_sql_list(formal.AMBIGUOUS)}, lambda x: contains(hint, x) AND NOT (x = 'boundary' AND doc_id % 4 = 0 AND NOT bad))) > 0 AS hs, fb = '' OR contains(fb, 'unclear') AS uf, fb = '' OR ob = '' AS lack, CASE WHEN bad THEN 'medium' ELSE said END AS s0 FROM e),
        j AS (SELECT *, CASE WHEN doc_id % 4 = 0 AND NOT bad THEN 2 ELSE 0 END + CAST(hs AS INTEGER) + CAST(uf AS INTEGER) AS fl, CASE WHEN lack AND s0 NOT IN ('medium', 'high') THEN 'low' WHEN s0 = 'low' THEN 'low' ELSE 'x' END AS conf FROM h)
        SELECT count(*) FILTER (WHERE doc_id % 50 <> 1) AS records, 0 AS invalid_variables, sum(fl) FILTER (WHERE doc_id % 50 <> 1)::BIGINT AS ambiguity_flag_count,
          count(*) FILTER (WHERE doc_id % 50 <> 1 AND NOT (NOT bad AND doc_id % 6 = 0) AND (fl > 0 OR conf = 'low')) AS requires_human_definition_count, count(*) FILTER (WHERE doc_id % 50 = 1) AS families_missing_formalization, 0 AS invented_families,
          CASE WHEN count(*) FILTER (WHERE doc_id % 50 = 1) = 0 THEN 'PASS' ELSE 'FAILED' END AS status FROM j""",
    "counter_pairs": f"WITH {_LK} SELECT node_id, record_id, 'ce:' || substr(sha1(node_id || chr(10) || record_id), 1, 16) AS candidate_id, round(score, 6) AS score, round(co, 6) AS contrast, round(gr, 6) AS graph, round(an, 6) AS anchor FROM k WHERE rn <= 20 ORDER BY score DESC, node_id, record_id LIMIT 2000",
    "counter_lookup": f"""WITH {_LK}, q AS (SELECT 'gap' || p_partkey AS gap_id, p_partkey AS p, upper(p_name) AS gap FROM part),
        spots AS (SELECT gap_id, 'm' || p AS node FROM q UNION SELECT gap_id, 'm' || (p + 5) FROM q UNION SELECT gap_id, e FROM (SELECT gap_id, unnest([source, target]) AS e FROM q JOIN ed ON ed.id = 'e' || p * 2) UNION SELECT gap_id, id FROM q JOIN n ON lower(label) = lower(gap) AND type = 'Limitation'),
        ce AS (SELECT * FROM ed WHERE relation IN {lookup.EDGES}) SELECT gap_id, id AS edge_id FROM spots JOIN ce ON node IN (source, target) WHERE node IN (SELECT id FROM n) UNION SELECT gap_id, id FROM q JOIN ce ON ref = gap_id""",
    "counter_edges": f"""WITH c AS (SELECT o_orderkey AS k, o_custkey AS p, CASE WHEN o_orderkey % 13 = 0 THEN 'unclear' ELSE {_sql_pick(['fully_addresses', 'relaxes_assumption', 'unrelated', 'handles_failure_condition', 'unclear'], 'o_orderkey')} END AS label,
          CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 7 = 0 THEN 0.5 ELSE least(1.0, (o_orderkey % 12) / 10.0) END AS conf, o_orderkey % 13 <> 0 AND o_orderkey % 4 <> 0 AS make, CASE WHEN o_orderkey % 3 < 2 THEN 'full' ELSE 'unclear' END AS scope FROM orders)
        SELECT 'cedge:' || substr(sha1('paper:' || p || chr(10) || 'g' || k || chr(10) || label), 1, 16) AS id, 'paper:' || p AS source, 'g' || k AS target, CASE label {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in lookup.EDGE_OF.items())} END AS relation, scope AS scope_match, round(conf, 6)::DOUBLE AS confidence
        FROM c WHERE make AND conf >= 0.7 AND label IN {tuple(lookup.EDGE_OF)}""",
}

QUERIES = {
    f.__name__: f
    for f in (
        gate_survival, gate_critic_label, gate_reviewed_only, direct_inputs, agent_rows, verification_summary, agents_pivot, variant_gates, merge_edges, family_rubric, expansion_metrics,
        formal_records, formal_fallbacks, formal_audit, counter_pairs, counter_lookup, counter_edges,
    )
}
