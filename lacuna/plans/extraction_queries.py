"""Label forms, extraction, resolution and gate queries over the tables in the roles of model replies, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import normalise
from lacuna.operators import extraction, graph
from lacuna.plans.views import norm_label, table

# Decorations that the label forms must fold; the same strings stand in the SQL.
TAILS = [r" \tilde{O}(d^{2/3}) (ABC)", " x² yⁿ₁ Ωθ", r" \mathcal{F}^2 (Ab)", " (LIN-UCB2) ", "  Θ(T)", ""]


def _pick(values: list[str], key: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(key, F.lit(len(values))).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_pick(values, key: str) -> str:
    return f"({_sql_list(values)})[({key}) % {len(values)} + 1]"


def normalized_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form of a decorated first line."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.substring_index("text", "\n", 1), _pick(TAILS, F.col("doc_id"))).alias("x"))
    return d.select(
        "doc_id", normalise.normalized_label("x").alias("label"), F.coalesce(normalise.trailing_acronym("x"), F.lit("")).alias("acronym"),
        normalise.path_slug("x").alias("path"), normalise.ascii_slug("x").alias("slug"), normalise.ascii_title("x").alias("title"),
        normalise.latex_escaped(F.col("x")).alias("latex"), normalise.html_escaped("x").alias("html"),
    )


def _alias_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Claims and listed entities whose labels come close to one another: parts' names, types, brands and grades; brands' acronyms."""
    p = table(spark, sf_dir, "part")
    grade = F.when(F.col("p_size") % 3 == 0, " extra").otherwise(F.when(F.col("p_size") % 3 == 1, " the").otherwise(""))
    label = F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" brand "), F.substring("p_brand", 7, 9), F.lit(" grade"), grade, F.lit(" model"))
    short = F.concat(F.lit("BR"), F.substring("p_brand", 7, 9))
    full = F.concat("p_name", F.lit(" brand ("), short, F.lit(")"))
    tuples = p.select(
        F.col("p_partkey").cast("string").alias("paper_id"), F.when(F.col("p_partkey") % 7 == 0, short).when(F.col("p_partkey") % 7 == 1, full).otherwise(label).alias("subject"),
        _pick(["uses_dataset", "measured_by", "assumes", "improves_over", "unheard_of", "contradicts"], F.col("p_partkey")).alias("relation"),
        F.concat(label, F.when(F.col("p_partkey") % 5 == 0, " approach").otherwise("")).alias("object"),
        _pick(["failure", "limitation", "assumption", "result", "unknown"], F.col("p_size").cast("long")).alias("claim_type"),
        F.lit("e").alias("evidence"), F.lit(0.9).alias("confidence"), F.col("p_partkey").cast("string").alias("seq"),
    )
    listed = p.select(
        F.col("p_partkey").cast("string").alias("paper_id"), _pick(["Method", "Dataset", "Limitation"], F.col("p_size").cast("long")).alias("type"),
        F.when(F.col("p_partkey") % 11 == 0, "algorithm 3").when(F.col("p_partkey") % 13 == 0, "insufficient evidence").otherwise(label).alias("label"),
    )
    return tuples, listed


def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.alias_map(graph.label_counts(*_alias_labels(spark, sf_dir)))


def graph_aliased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the graph after aliases, junk labels, refined types and normal forms."""
    nodes, _ = graph.build(*_alias_labels(spark, sf_dir))
    return nodes.select("id", "type", F.array_join("paper_ids", " ").alias("paper_ids"))


def graph_aliased_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = graph.build(*_alias_labels(spark, sf_dir))
    return edges.select("source", "target", "relation", "support_count", F.array_join("paper_ids", " ").alias("paper_ids"))


SPELLINGS = {k: sorted({*v[0], *v[1], "something else"}) for k, v in extraction.ENUMS.items()}


def enum_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling of the six enumerations, counted by what it becomes."""
    e = table(spark, sf_dir, "events")
    cols = {k: F.concat(F.lit(" "), F.upper(_pick(v, F.col("event_id") + i))) for i, (k, v) in enumerate(SPELLINGS.items())}
    rows = extraction.coerced(e.select("event_id", *[c.alias(k) for k, c in cols.items()]))
    return rows.groupBy(*SPELLINGS).agg(F.count(F.lit(1)).alias("n"))


SCOPES = ["own_method", "Prior work", "existing baselines", "the field", "General", "ours", "previous paper", ""]


def subject_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(_pick(SCOPES, F.col("event_id")).alias("x"))
    return e.groupBy(extraction.subject_scope("x").alias("scope")).agg(F.count(F.lit(1)).alias("n"))


def reply_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score maps, evidence lists and labels from replies of several spellings."""
    k, i = F.get_json_object("props", "$.k"), F.col("event_id")
    scores = F.when(i % 4 == 0, F.concat(F.lit('{"a": '), k, F.lit(', "b": "about '), k, F.lit(' %", "c": "none"}'))).when(i % 4 == 1, F.concat(F.lit("score "), k)).when(i % 4 == 2, k).otherwise("n/a")
    proof = F.when(i % 3 == 0, F.concat(F.lit('[{"paper_id": "p'), k, F.lit('", "evidence_text": "t"}]'))).when(i % 3 == 1, F.concat(F.lit('["x'), k, F.lit('", "y"]'))).otherwise(F.concat(F.lit("plain "), k))
    label = _pick(["weak", " Strong ", "drop-generic", "not sure"], i)
    m, e = extraction.score_map(scores), extraction.evidence_list(proof)
    total = F.aggregate(F.map_values(m), F.lit(0.0), lambda a, b: a + b)
    return table(spark, sf_dir, "events").select(
        "event_id", F.size(m).cast("long").alias("n_scores"), total.alias("total"), F.size(e).cast("long").alias("n_evidence"),
        F.coalesce(F.get(e, F.lit(0))["paper_id"], F.lit("")).alias("paper_id"), F.get(e, F.lit(0))["text"].alias("first"),
        extraction.upper_label(label, ("WEAK", "STRONG", "DROP_GENERIC"), "UNCLEAR").alias("label"),
    )


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items as raw claim tuples whose spans come, cut or changed, from their paper: the document of their supplier."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), "text")
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("paper_id"),
        F.when(k % 9 == 0, "The Method").otherwise(F.concat(F.lit("part "), F.col("l_partkey"))).alias("subject"),
        F.when(k % 10 == 7, "relates_to").otherwise(_pick(extraction.ENUMS["relation"][0], F.col("l_partkey"))).alias("relation"),
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("obj "), F.col("l_linenumber"))).alias("object"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise("short").alias("evidence_text"),
        (F.col("l_linenumber") * 7).alias("at"), F.when(k % 4 == 0, " zzz").otherwise("").alias("noise"),
        F.when(k % 2 == 0, "accuracy").otherwise("").alias("metric"), F.lit("").alias("dataset"),
        _pick(["positive", "negative", "neutral", "mixed", "unknown"], F.col("l_suppkey") + F.col("l_linenumber")).alias("polarity"),
    )
    spans = docs.select("paper_id", F.substring("text", 1, 120).alias("head"))
    span = F.concat(F.substring(F.coalesce("head", F.lit("")), F.col("at"), F.lit(30)), "noise")
    return rows.join(spans, "paper_id", "left").withColumn("source_span", span).drop("head", "at", "noise"), docs


def tuple_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extraction.validated(*_claims(spark, sf_dir))
    return rows.groupBy("relation", "polarity", F.coalesce("drop_reason", F.lit("")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


FAILURES = ["We assume bounded noise", "fails under drift", "It requires labels", "requires care when data shift", "The assumption is strong", "performance degrades", "rely on the assumption of mixing"]
TASKS = [" Regression", "ranking", "Bandits", "clustering"]


def rerouted_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array(_pick(FAILURES, k), _pick(FAILURES, k + F.col("o_custkey")), _pick(FAILURES, k * 3)).alias("failure_conditions"),
        F.array(_pick(FAILURES, k + 1)).alias("assumptions"), F.array(_pick(TASKS, k), _pick(TASKS, F.col("o_custkey"))).alias("tasks"),
    )
    return extraction.rerouted(rows).select("o_orderkey", *[F.array_join(c, "|").alias(c) for c in ("failure_conditions", "assumptions", "tasks")])


def condition_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples for the second reading, by relation."""
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select(
        _pick(extraction.ENUMS["relation"][0], F.col("l_partkey")).alias("relation"), _pick(["own_method", "prior_work", "general"], k).alias("subject_scope"),
        F.when(k % 5 == 0, F.lit(None).cast("boolean")).otherwise(k % 4 == 0).alias("raw"), _pick(["", "  ", "under drift"], F.col("l_suppkey")).alias("condition"),
    )
    rows = rows.withColumn("resolved_by_paper", extraction.unresolved_own(F.col("subject_scope"), F.col("relation"), F.col("raw")))
    return rows.where(extraction.needs_condition()).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def resolution_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("paper_id"), F.when(k % 6 == 0, none).otherwise(F.concat(F.lit(" m "), F.col("l_partkey"))).alias("method"),
        _pick([*extraction.RESOLUTION_RELATIONS, "Handles Failure Condition ", "solves"], k).alias("resolution_relation"), _pick(["drift", "", "cost "], F.col("l_partkey")).alias("target_problem"),
        _pick(["Assumption", "limitation", "oops"], F.col("l_suppkey")).alias("target_problem_type"), _pick(["", "noise"], k).alias("addressed_condition"),
        _pick(["FULL", "partial", "maybe"], F.col("l_partkey")).alias("claim_strength"), _pick(["text", " ", "more text"], F.col("l_linenumber").cast("long")).alias("evidence_text"),
        F.when(k % 5 == 0, none).when(k % 5 == 1, "high").otherwise((F.col("l_discount") * 15).cast("decimal(6,2)").cast("string")).alias("confidence"),
    )
    out = extraction.resolutions(rows)
    keys = ("resolution_relation", "target_problem_type", "claim_strength", "confidence_was_imputed")
    return out.groupBy(*keys, F.coalesce("drop_reason", F.lit("")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first"))


LABELS = ["Our Method", "Theorem 3.4", "lemma 2", "Algorithm 7", "claim a", "Baseline", "UCB", "definition 1.", "Remark"]


def junk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(_pick(LABELS, F.col("event_id")).alias("x"))
    return rows.groupBy(extraction.junk_label("x").alias("junk")).agg(F.count(F.lit(1)).alias("n"))


# --- DuckDB ---


def _case(x: str, valid, aliases: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ({v: v for v in valid} | aliases).items())
    return f"CASE lower(trim({x})) {arms} ELSE '{default}' END"


_ASCII = r"regexp_replace(strip_accents(coalesce(x, '')), '[^\x00-\x7F]', '', 'g')"
#: NFKD also opens raised and lowered digits, which ASCII then keeps.
_FOLD = f"translate(translate(x, '{normalise.RAISED}', '{normalise.RAISED_AS}'), '{normalise.LOWERED}', '{normalise.LOWERED_AS}')"


def _has(x: str, phrases, head: str = "") -> str:
    return "(" + " OR ".join(f"contains({x}, '{head}{p}')" for p in phrases) + ")"


def _assuming(t: str) -> str:
    return f"(({' OR '.join(f'starts_with({t}, {p!r})' for p in extraction.ASSUMING)} OR {_has(t, extraction.ASSUMING, ' ')}) AND NOT {_has(t, extraction.FAILING)})"


_SPAN = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(strip_accents({0}), '[^\x00-\x7F]', '', 'g'), '-\s+', '', 'g'), '\s+', ' ', 'g')))"
_REL = _sql_pick(extraction.ENUMS["relation"][0], "l_partkey")
_GRADE = "CASE p_size % 3 WHEN 0 THEN ' extra' WHEN 1 THEN ' the' ELSE '' END"
_STOPS = _sql_list(graph.ALIAS_STOPS)
_OT = "CASE relation " + " ".join(f"WHEN '{r}' THEN '{t}'" for r, t in graph.OBJECT_TYPE.items()) + " ELSE 'Claim' END"
_RT = "CASE claim_type " + " ".join(f"WHEN '{r}' THEN '{t}'" for r, t in graph.REFINED_TYPE.items()) + " ELSE 'Claim' END"
_JUNK = f"(lower(trim({{0}})) IN ({', '.join(repr(x) for x in extraction.JUNK_LABELS)}) OR regexp_matches(lower(trim({{0}})), '{extraction.JUNK_LABEL}'))"
_ALIAS_SQL = rf"""
  p AS (SELECT *, p_name || ' ' || lower(p_type) || ' brand ' || substr(p_brand, 7) || ' grade' || {_GRADE} || ' model' AS lab, 'BR' || substr(p_brand, 7) AS short FROM part),
  t0 AS (SELECT CAST(p_partkey AS VARCHAR) AS paper_id, CASE p_partkey % 7 WHEN 0 THEN short WHEN 1 THEN p_name || ' brand (' || short || ')' ELSE lab END AS subject,
    {_sql_pick(["uses_dataset", "measured_by", "assumes", "improves_over", "unheard_of", "contradicts"], "p_partkey")} AS relation,
    lab || CASE WHEN p_partkey % 5 = 0 THEN ' approach' ELSE '' END AS object, {_sql_pick(["failure", "limitation", "assumption", "result", "unknown"], "p_size")} AS claim_type FROM p),
  t1 AS (SELECT *, CASE WHEN relation = 'contradicts' THEN 'Claim' ELSE 'Method' END AS st, CASE WHEN {_OT} = 'Claim' THEN {_RT} ELSE {_OT} END AS ot FROM t0),
  m0 AS (SELECT CAST(p_partkey AS VARCHAR) AS paper_id, {_sql_pick(["Method", "Dataset", "Limitation"], "p_size")} AS type,
    CASE WHEN p_partkey % 11 = 0 THEN 'algorithm 3' WHEN p_partkey % 13 = 0 THEN 'insufficient evidence' ELSE lab END AS label FROM p),
  m1 AS (SELECT * FROM m0 WHERE label <> 'insufficient evidence'),
  c AS (SELECT type, label, count(*) AS n FROM (SELECT st AS type, subject AS label FROM t1 UNION ALL SELECT ot, object FROM t1 UNION ALL SELECT type, label FROM m1)
    WHERE type IN {graph.ALIAS_TYPES} GROUP BY 1, 2),
  k AS (SELECT type, label, n, list_sort(list_distinct(list_filter(regexp_extract_all(lower(label), '[a-z0-9]+'), lambda w: length(w) >= 2 AND NOT list_contains({_STOPS}, w)))) AS w
    FROM c WHERE length(label) <= {graph.ALIAS_LENGTH}),
  g AS (SELECT type, w, row_number() OVER () AS gid FROM (SELECT DISTINCT type, w FROM k WHERE len(w) > 0)),
  l AS (SELECT a.gid AS a, b.gid AS b FROM g a JOIN g b ON a.type = b.type AND a.gid <> b.gid
    AND len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.85),
  r AS (SELECT gid AS a, gid AS c FROM g UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a WHERE r.c < l.b),
  comp AS (SELECT a AS gid, min(c) AS comp FROM r GROUP BY a),
  named AS (SELECT k.*, comp FROM k JOIN g USING (type, w) JOIN comp USING (gid)),
  best AS (SELECT comp, arg_min(label, (-n, -length(label), label)) AS canonical FROM named GROUP BY comp),
  bywords AS (SELECT type, label, canonical FROM named JOIN best USING (comp) WHERE label <> canonical),
  acr AS (SELECT regexp_extract(label, '{normalise.TRAILING_ACRONYM}', 1) AS a, arg_min(label, (-length(label), label)) AS canonical FROM c
    WHERE type = 'Method' AND regexp_matches(label, '{normalise.TRAILING_ACRONYM}') GROUP BY 1),
  am AS (SELECT * FROM bywords UNION ALL SELECT 'Method', label, canonical FROM c JOIN acr ON label = a WHERE type = 'Method' AND label NOT IN (SELECT label FROM bywords WHERE type = 'Method')),
  t2 AS (SELECT paper_id, relation, st, ot, coalesce(s.canonical, subject) AS subject, coalesce(o.canonical, object) AS object FROM t1
    LEFT JOIN am s ON s.type = st AND s.label = subject LEFT JOIN am o ON o.type = ot AND o.label = object),
  t3 AS (SELECT *, lower(st) || ':' || substr(sha1({norm_label('subject')}), 1, 16) AS source, lower(ot) || ':' || substr(sha1({norm_label('object')}), 1, 16) AS target
    FROM t2 WHERE NOT (st = 'Method' AND {_JUNK.format('subject')})),
  m2 AS (SELECT DISTINCT paper_id, m1.type, coalesce(canonical, m1.label) AS label FROM m1 LEFT JOIN am ON am.type = m1.type AND am.label = m1.label),
  m3 AS (SELECT *, lower(type) || ':' || substr(sha1({norm_label('label')}), 1, 16) AS id FROM m2 WHERE NOT (type = 'Method' AND {_JUNK.format('label')}))"""

ORACLE_SQL = {
    "normalized_labels": rf"""WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) || {_sql_pick(TAILS, 'doc_id')} AS x FROM documents)
        SELECT doc_id, {norm_label('x')} AS label, regexp_extract(x, '{normalise.TRAILING_ACRONYM}', 1) AS acronym,
          lower(coalesce(nullif(substr(trim(regexp_replace(trim(x), '[^A-Za-z0-9._-]+', '_', 'g'), '_'), 1, 80), ''), 'item')) AS path,
          trim(regexp_replace(lower({_ASCII.replace('(x,', f'({_FOLD},')}), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
          trim(regexp_replace(lower({_ASCII.replace('(x,', f'({_FOLD},')}), '[^a-z0-9]+', ' ', 'g')) AS title,
          replace(replace(replace(regexp_replace(replace(x, '\', chr(1)), '([&%$#_{{}}])', '\\\1', 'g'), chr(1), '\textbackslash{{}}'), '~', '\textasciitilde{{}}'), '^', '\textasciicircum{{}}') AS latex,
          replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html FROM d""",
    "alias_map": f"WITH RECURSIVE {_ALIAS_SQL} SELECT type, label, canonical FROM am",
    "graph_aliased": f"""WITH RECURSIVE {_ALIAS_SQL}, ends AS (SELECT source AS id, st AS type, paper_id FROM t3 UNION ALL SELECT target, ot, paper_id FROM t3 UNION ALL SELECT id, type, paper_id FROM m3
          UNION ALL SELECT 'paper:' || paper_id, 'Paper', paper_id FROM m3)
        SELECT id, type, array_to_string(list_sort(list(DISTINCT paper_id)), ' ') AS paper_ids FROM ends GROUP BY 1, 2""",
    "graph_aliased_edges": f"""WITH RECURSIVE {_ALIAS_SQL}, e AS (SELECT DISTINCT source, target, relation, paper_id FROM t3 UNION ALL SELECT 'paper:' || paper_id, id, 'mentions', paper_id FROM (SELECT DISTINCT paper_id, id FROM m3))
        SELECT source, target, relation, count(*) AS support_count, array_to_string(list_sort(list(DISTINCT paper_id)), ' ') AS paper_ids FROM e GROUP BY 1, 2, 3""",
    "enum_aliases": "SELECT " + ", ".join(f"{_case(f'upper({_sql_pick(v, f"event_id + {i}")})', *extraction.ENUMS[k])} AS {k}" for i, (k, v) in enumerate(SPELLINGS.items()))
        + f", count(*) AS n FROM events GROUP BY {', '.join(str(i + 1) for i in range(len(SPELLINGS)))}",
    "subject_scopes": f"""WITH v AS (SELECT replace(lower(trim({_sql_pick(SCOPES, 'event_id')})), ' ', '_') AS v FROM events)
        SELECT CASE WHEN v IN ('own_method', 'prior_work', 'general') THEN v WHEN {_has('v', ['prior', 'baseline', 'existing', 'previous'])} THEN 'prior_work'
          WHEN {_has('v', ['general', 'field'])} THEN 'general' ELSE 'own_method' END AS scope, count(*) AS n FROM v GROUP BY 1""",
    "reply_fields": """WITH v AS (SELECT event_id AS i, json_extract_string(props, '$.k') AS k FROM events)
        SELECT i AS event_id, CASE i % 4 WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS n_scores, CASE i % 4 WHEN 0 THEN 2 * CAST(k AS DOUBLE) WHEN 3 THEN 0.0 ELSE CAST(k AS DOUBLE) END AS total,
          CASE i % 3 WHEN 1 THEN 2 ELSE 1 END AS n_evidence, CASE i % 3 WHEN 0 THEN 'p' || k ELSE '' END AS paper_id, CASE i % 3 WHEN 0 THEN 't' WHEN 1 THEN 'x' || k ELSE 'plain ' || k END AS first,
          (['WEAK', 'STRONG', 'DROP_GENERIC', 'UNCLEAR'])[i % 4 + 1] AS label FROM v""",
    "tuple_validity": f"""WITH d AS (SELECT doc_id AS s, coalesce(text, '') AS text FROM documents),
        r AS (SELECT l.*, {_REL} AS rel0, substr(coalesce(substr(text, 1, 120), ''), l_linenumber * 7, 30) || CASE WHEN l_orderkey % 4 = 0 THEN ' zzz' ELSE '' END AS span, text
          FROM lineitem l LEFT JOIN d ON s = l_suppkey),
        f AS (SELECT *, CASE WHEN l_orderkey % 10 = 7 THEN 'relates_to' ELSE rel0 END AS relation, {_sql_pick(['positive', 'negative', 'neutral', 'mixed', 'unknown'], 'l_suppkey + l_linenumber')} AS pol,
          coalesce(length(span) >= 15 AND {_SPAN.format('span')} <> '' AND contains({_SPAN.format('text')}, {_SPAN.format('span')}), false) AS found FROM r)
        SELECT relation, CASE WHEN relation = 'improves_over' AND pol IN ('negative', 'unknown') THEN 'positive' WHEN relation IN ('fails_under', 'limited_by') AND pol IN ('positive', 'unknown') THEN 'negative'
            WHEN relation = 'assumes' AND pol = 'unknown' THEN 'neutral' ELSE pol END AS polarity,
          CASE WHEN l_orderkey % 10 = 7 THEN 'unknown_relation' WHEN l_orderkey % 13 = 0 OR l_orderkey % 11 = 0 THEN 'no_object_or_evidence' WHEN l_orderkey % 9 = 0 THEN 'junk_subject'
            WHEN relation IN {extraction.EVALUATING} AND l_orderkey % 2 = 1 THEN 'no_metric_or_dataset' WHEN NOT found THEN 'unverified_span' ELSE '' END AS drop_reason, count(*) AS n
        FROM f GROUP BY 1, 2, 3""",
    "rerouted_failures": f"""WITH v AS (SELECT o_orderkey, [{_sql_pick(FAILURES, 'o_orderkey')}, {_sql_pick(FAILURES, 'o_orderkey + o_custkey')}, {_sql_pick(FAILURES, 'o_orderkey * 3')}] AS f,
          {_sql_pick(FAILURES, 'o_orderkey + 1')} AS a, [{_sql_pick(TASKS, 'o_orderkey')}, {_sql_pick(TASKS, 'o_custkey')}] AS t FROM orders),
        w AS (SELECT *, list_filter(f, lambda x: {_assuming('lower(x)')}) AS moved, list_filter(f, lambda x: NOT {_assuming('lower(x)')}) AS rest FROM v),
        u AS (SELECT *, list_filter(moved, lambda x: x <> a) AS m FROM w)
        SELECT o_orderkey, array_to_string(rest, '|') AS failure_conditions,
          array_to_string(list_concat([a], list_filter(m, lambda x, i: list_position(m, x) = i)), '|') AS assumptions,
          array_to_string(list_filter(t, lambda x: lower(trim(x)) NOT IN ({', '.join(repr(x) for x in extraction.GENERIC_TASKS)})), '|') AS tasks FROM u""",
    "condition_candidates": f"""SELECT {_REL} AS relation, count(*) AS n FROM lineitem WHERE {_REL} IN ('fails_under', 'limited_by') AND l_orderkey % 3 = 0 AND l_suppkey % 3 < 2 GROUP BY 1""",
    "resolution_records": f"""WITH r AS (SELECT l_suppkey AS paper, coalesce(CASE WHEN l_orderkey % 6 = 0 THEN '' ELSE 'm ' || l_partkey END, '') AS m,
          {_sql_pick([*extraction.RESOLUTION_RELATIONS, 'handles_failure_condition', 'addresses_limitation'], 'l_orderkey')} AS resolution_relation, {_sql_pick(['drift', '', 'cost'], 'l_partkey')} AS tp,
          {_sql_pick(['assumption', 'limitation', 'unclear'], 'l_suppkey')} AS target_problem_type, {_sql_pick(['', 'noise'], 'l_orderkey')} AS ac,
          {_sql_pick(['full', 'partial', 'unclear'], 'l_partkey')} AS claim_strength, {_sql_pick(['text', '', 'more text'], 'l_linenumber')} AS ev, l_orderkey % 5 AS h,
          CAST(l_discount * 15 AS DECIMAL(6, 2)) AS num FROM lineitem),
        s AS (SELECT *, ev <> '' AND m <> '' AND (tp <> '' OR ac <> '') AS content, 'res:' || substr(sha1(paper || chr(10) || m || chr(10) || tp || chr(10) || ev), 1, 16) AS id FROM r),
        c AS (SELECT *, CASE WHEN h = 0 THEN CASE WHEN content THEN 0.7 ELSE 0 END WHEN h = 1 THEN 0 ELSE greatest(0, least(1, num)) END AS conf FROM s)
        SELECT resolution_relation, target_problem_type, claim_strength, h = 0 AND content AS confidence_was_imputed,
          CASE WHEN ev = '' THEN 'empty_evidence' WHEN conf < 0.65 THEN 'low_confidence' ELSE '' END AS drop_reason, count(*) AS n, min(id) AS first FROM c GROUP BY 1, 2, 3, 4, 5""",
    "junk_labels": f"WITH v AS (SELECT {_sql_pick(LABELS, 'event_id')} AS x FROM events) SELECT {_JUNK.format('x')} AS junk, count(*) AS n FROM v GROUP BY 1",
}

QUERIES = {
    f.__name__: f
    for f in (
        normalized_labels, alias_map, graph_aliased, graph_aliased_edges, enum_aliases, subject_scopes, reply_fields, tuple_validity, rerouted_failures,
        condition_candidates, resolution_records, junk_labels,
    )
}
