"""Graph and motif queries with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import gaps, graph, motifs
from lacuna.plans.views import GRAPH_SQL, evidence_graph, mentions, tuples
from lacuna.scratch import kept

FLAT = ("motif_type", "motif_id", "node_id", "label", "n_support", "score")


def _flat(hits: DataFrame) -> DataFrame:
    """Arrays as text, so that rows compare by value."""
    return hits.select(*FLAT, F.array_join("node_ids", " ").alias("node_ids"), F.array_join("paper_ids", " ").alias("paper_ids"))


def _motif(name: str, **settings):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(getattr(motifs, name)(*evidence_graph(spark, sf_dir), **settings))

    query.__doc__ = f"{name} over the evidence graph."
    return query


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = evidence_graph(spark, sf_dir)
    return nodes.select("id", "type", "label", F.array_join("paper_ids", " ").alias("paper_ids"))


def graph_edges_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = evidence_graph(spark, sf_dir)
    return edges.select("source", "target", "relation", "confidence", "support_count", "evidence", F.array_join("paper_ids", " ").alias("paper_ids"))


def graph_type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = evidence_graph(spark, sf_dir)
    return graph.type_summary(nodes, "type").withColumn("part", F.lit("node")).unionByName(
        graph.type_summary(edges, "relation").withColumn("part", F.lit("edge"))
    )


def graph_degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_top(evidence_graph(spark, sf_dir)[1], 25)


def graph_induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = evidence_graph(spark, sf_dir)
    return graph.induced(edges, graph.degree_top(edges, 4000)).select("source", "target", "relation")


def field_norm_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = evidence_graph(spark, sf_dir)
    total = tuples(spark, sf_dir).select("paper_id").distinct().count()
    return graph.field_norms(nodes, total, 0.002)


def gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.gap_rows(motifs.all_motifs(*evidence_graph(spark, sf_dir))).select(
        "gap_id", "motif_type", "novelty_score", "feasibility_score", "impact_score", "overall_score", "n_papers"
    )


def gap_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.supports_gap(motifs.shared_failure_condition(*evidence_graph(spark, sf_dir)))


def motif_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = motifs.all_motifs(*evidence_graph(spark, sf_dir))
    return hits.groupBy("motif_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def diverse_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gaps.gap_rows(motifs.all_motifs(*evidence_graph(spark, sf_dir)))
    # ranks and sizes both read the gaps, which are thirteen motifs over the graph
    rows = kept(rows.select("gap_id", "motif_type", "n_papers", "overall_score"), "gaps")
    return gaps.diverse_slots(rows, 40).select("gap_id", "motif_type", "slot")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limitations that recur across papers and that no method addresses, as gap rows, best first."""
    hits = motifs.repeated_unaddressed_limitation(*evidence_graph(spark, sf_dir))
    rows = gaps.gap_rows(hits)
    return rows.select("gap_id", "motif_type", "label", "n_papers", "overall_score").orderBy(F.desc("overall_score"), "gap_id").limit(50)


# --- DuckDB ---

_ID = "'motif:' || substr(sha1('{tag}' || chr(10) || {key}), 1, 16)"
_POS = "('improves_over', 'evaluated_on', 'addresses', 'robust_to')"
_NEG = "('fails_under', 'limited_by', 'not_addressed_by', 'sensitive_to')"
_EVAL = "('uses_dataset', 'measured_by')"
_HARM = "('fails_under', 'limited_by')"
_CLAIM = "('addresses', 'improves_over')"


def _words(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _hits(motif: str, source: str, papers: str, support: str, score: str, node_ids: str, tag: str | None = None, key: str = "id") -> str:
    return f"""SELECT '{motif}' AS motif_type, {_ID.format(tag=tag or motif, key=key)} AS motif_id, id AS node_id, label,
      CAST({support} AS BIGINT) AS n_support, round(greatest(0.0, least(1.0, CAST({score} AS DOUBLE))), 6) AS score,
      array_to_string({node_ids}, ' ') AS node_ids, array_to_string(list_sort({papers}), ' ') AS paper_ids FROM ({source})"""


def _u(*parts: str) -> str:
    return "list_sort(list_distinct(" + "list_concat(" + ", ".join(f"coalesce({p}, [])" for p in parts) + ")))" if len(parts) > 1 else f"list_sort(list_distinct({parts[0]}))"


def _f(x: str, test: str) -> str:
    return f"coalesce(list_sort(list(DISTINCT {x}) FILTER (WHERE {test})), [])"


def _pf(test: str) -> str:
    return f"coalesce(list_sort(list_distinct(flatten(list(papers) FILTER (WHERE {test})))), [])"


_METHODS_IN = "(SELECT e.* FROM edges e JOIN nodes m ON m.id = e.source AND m.type = 'Method')"

_SQL = {
    "motif_shared_failure": (
        _hits("shared_failure_condition", f"""SELECT * FROM (SELECT id, label, ms, ps, qs FROM nodes JOIN (
            SELECT target, {_f('source', "relation = 'fails_under'")} AS ms, {_pf("relation = 'fails_under'")} AS ps, {_pf("relation = 'mentions'")} AS qs
            FROM (SELECT * FROM {_METHODS_IN} WHERE relation = 'fails_under' UNION ALL SELECT * FROM edges WHERE relation = 'mentions') GROUP BY target) b ON target = id
            WHERE type = 'FailureCondition') WHERE len(ms) >= 2 AND len(ps) >= 2""", "ps", "len(ms)", "0.4 + 0.15 * len(ms) + 0.1 * len(ps)", "list_concat([id], ms)")
        + " UNION ALL "
        + _hits("shared_failure_condition", f"""SELECT * FROM (SELECT id, label, ms, ps, qs FROM nodes JOIN (
            SELECT target, {_f('source', "relation = 'fails_under'")} AS ms, {_pf("relation = 'fails_under'")} AS ps, {_pf("relation = 'mentions'")} AS qs
            FROM (SELECT * FROM {_METHODS_IN} WHERE relation = 'fails_under' UNION ALL SELECT * FROM edges WHERE relation = 'mentions') GROUP BY target) b ON target = id
            WHERE type = 'FailureCondition') WHERE NOT (len(ms) >= 2 AND len(ps) >= 2) AND len(qs) >= 2""", "qs", "len(qs)", "0.35 + 0.1 * len(qs)", "[id]", "shared_failure_condition_mention")
    ),
    "motif_unaddressed_limitation": _hits(
        "repeated_unaddressed_limitation", f"""SELECT id, label, all_p FROM (SELECT id, label, {_u('papers', 'qs')} AS all_p FROM nodes LEFT JOIN (
            SELECT target, list_distinct(flatten(list(papers))) AS qs FROM edges WHERE relation = 'mentions' GROUP BY target) ON target = id
            WHERE type = 'Limitation' AND id NOT IN (SELECT target FROM edges WHERE relation = 'addresses')) WHERE len(all_p) >= 2""",
        "all_p", "len(all_p)", "0.45 + 0.15 * len(all_p)", "[id]"),
    "motif_conflict_explicit": _hits(
        "conflicting_claims", f"""SELECT e.target AS id, b.label, e.source AS src, {_u('e.papers', 'a.papers', 'b.papers')} AS all_p
            FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE relation = 'contradicts' AND len({_u('e.papers', 'a.papers', 'b.papers')}) >= 2""",
        "all_p", "1", "0.75", "[src, id]", key="src || chr(10) || id"),
    "motif_conflict_implicit": _hits(
        "conflicting_claims", f"""SELECT id, label, srcs, all_p FROM (SELECT target AS id, {_pf(f'relation IN {_POS}')} AS pp, {_pf(f'relation IN {_NEG}')} AS nn,
            list_sort(list(DISTINCT source)) AS srcs, list_sort(list_distinct(flatten(list(papers)))) AS all_p FROM edges WHERE relation IN {_POS} OR relation IN {_NEG} GROUP BY target)
            JOIN (SELECT id, label FROM nodes) USING (id) WHERE len(pp) > 0 AND len(nn) > 0 AND len(all_p) >= 2""",
        "all_p", "len(all_p)", "0.55 + 0.1 * len(all_p)", "list_concat([id], srcs)[1:10]", "implicit_conflict", "id || chr(10) || array_to_string(all_p, chr(10))"),
    "motif_sparse_eval": _hits(
        "sparse_evaluation", f"""SELECT id, label, papers, coalesce(n, 0) AS n, coalesce(tasks, []) AS tasks FROM nodes LEFT JOIN (
            SELECT source, count(*) FILTER (WHERE relation IN {_EVAL}) AS n, {_f('target', "relation = 'evaluated_on'")} AS tasks
            FROM edges WHERE relation IN {_EVAL} OR relation = 'evaluated_on' GROUP BY source) ON source = id WHERE type = 'Method' AND len(papers) >= 2 AND coalesce(n, 0) <= 1""",
        "papers", "n", "0.45 + 0.1 * len(papers) - 0.1 * n", "list_concat([id], tasks)"),
    "motif_assumption_mismatch": _hits(
        "assumption_mismatch", f"""SELECT id, label, a + f AS k, {_u('papers', 'more')} AS all_p, {_u('[id]', 'ts')} AS ids FROM nodes JOIN (
            SELECT source, count(*) FILTER (WHERE relation = 'assumes') AS a, count(*) FILTER (WHERE relation = 'fails_under') AS f,
            {_pf('true')} AS more, {_f('target', 'true')} AS ts FROM edges WHERE relation IN ('assumes', 'fails_under') GROUP BY source) ON source = id
            WHERE type = 'Method' AND a > 0 AND f > 0""", "all_p", "k", "0.6 + 0.05 * len(all_p)", "ids"),
    "motif_unrealistic_assumption": _hits(
        "unrealistic_assumption", f"""SELECT id, label, k, {_u('papers', 'more')} AS all_p, {_u('[id]', 'ts')} AS ids FROM nodes JOIN (
            SELECT source, count(*) FILTER (WHERE ideal) AS k, count(*) FILTER (WHERE relation IN {_HARM}) AS f, {_pf(f'ideal OR relation IN {_HARM}')} AS more,
            {_f('target', f'ideal OR relation IN {_HARM}')} AS ts FROM (SELECT e.*, relation = 'assumes' AND {_words("(lower(n.label) || ' ' || lower(evidence))", motifs.IDEALIZED)} AS ideal
              FROM edges e JOIN nodes n ON n.id = e.target WHERE relation IN ('assumes', 'fails_under', 'limited_by')) GROUP BY source) ON source = id
            WHERE type = 'Method' AND k > 0 AND f > 0""", "all_p", "k", "0.7 + 0.05 * k", "ids"),
    "motif_theory_practice": _hits(
        "theory_practice_gap", f"""SELECT id, label, f, {_u('papers', 'more')} AS all_p, {_u('[id]', 'ts')} AS ids FROM nodes JOIN (
            SELECT source, count(*) FILTER (WHERE relation IN {_EVAL}) AS e, count(*) FILTER (WHERE relation IN {_HARM}) AS f, {_pf(f'relation IN {_HARM}')} AS more,
            {_f('target', f'relation IN {_HARM}')} AS ts FROM edges WHERE relation IN {_EVAL} OR relation IN {_HARM} GROUP BY source) ON source = id
            WHERE type = 'Method' AND len(papers) >= 2 AND e = 0 AND f > 0""", "all_p", "f", "0.65 + 0.05 * len(all_p)", "ids"),
    "motif_transfer_gap": _hits(
        "transfer_solution_gap", f"""SELECT id, label, solvers, affected, all_p FROM (SELECT id, label, solvers, affected, {_u('p1', 'p2')} AS all_p FROM nodes JOIN (
            SELECT target, {_f('source', 'solves')} AS solvers, {_f('source', 'NOT solves AND hurt')} AS affected,
              coalesce(flatten(list(bp) FILTER (WHERE solves)), []) AS p1, coalesce(flatten(list(hp) FILTER (WHERE NOT solves AND hurt)), []) AS p2
            FROM (SELECT target, source, bool_or(relation = 'addresses') AS solves, bool_or(relation IN {_HARM}) AS hurt, {_pf("relation = 'addresses'")} AS bp,
              {_pf(f'relation IN {_HARM}')} AS hp FROM {_METHODS_IN} WHERE relation = 'addresses' OR relation IN {_HARM} GROUP BY target, source) GROUP BY target) ON target = id
            WHERE type IN ('Limitation', 'FailureCondition')) WHERE len(solvers) > 0 AND len(affected) >= 2 AND len(all_p) >= 2""",
        "all_p", "len(affected)", "0.6 + 0.05 * len(all_p) + 0.05 * len(affected)", "list_concat([id], solvers, affected)"),
    "motif_unresolved_tradeoff": _hits(
        "unresolved_tradeoff", f"""SELECT m.id, m.label, e.target AS t, plus, {_u('m.papers', 'more', 'e.papers')} AS all_p, len({_u('e.papers', 'n.papers')}) >= 2 AS wide
            FROM nodes m JOIN (SELECT source, count(*) FILTER (WHERE relation IN {_CLAIM}) AS plus, {_pf(f'relation IN {_CLAIM}')} AS more FROM edges GROUP BY source) o ON o.source = m.id
            JOIN edges e ON e.source = m.id AND e.relation = 'limited_by' JOIN nodes n ON n.id = e.target
            WHERE m.type = 'Method' AND plus >= 1 AND e.target NOT IN (SELECT target FROM edges WHERE relation = 'addresses')""",
        "all_p", "plus", "0.65 + 0.05 * plus + CASE WHEN wide THEN 0.1 ELSE 0 END", "[id, t]", key="id || chr(10) || t"),
    "motif_missing_stress_test": _hits(
        "missing_stress_test", f"""SELECT id, label, ms, ps, ev FROM nodes JOIN (SELECT target, {_f('source', 'true')} AS ms, {_pf('true')} AS ps,
            count(DISTINCT source) FILTER (WHERE source IN (SELECT source FROM edges WHERE relation IN {_EVAL})) AS ev FROM {_METHODS_IN} WHERE relation = 'fails_under' GROUP BY target)
            ON target = id WHERE type = 'FailureCondition' AND (len(ms) >= 2 OR len(ps) >= 2) AND ev <= 1""",
        "ps", "len(ms)", "0.6 + 0.05 * len(ms) + 0.05 * len(ps) - 0.05 * ev", "list_concat([id], ms)"),
    "motif_claim_without_measurement": _hits(
        "claim_without_measurement", f"""SELECT id, label, c, m, {_u('papers', 'more')} AS all_p, ts FROM nodes JOIN (SELECT source, count(*) FILTER (WHERE relation IN {_CLAIM}) AS c,
            count(*) FILTER (WHERE relation = 'measured_by') AS m, {_pf('true')} AS more, {_f('target', f'relation IN {_CLAIM}')} AS ts
            FROM edges WHERE relation IN {_CLAIM} OR relation = 'measured_by' GROUP BY source) ON source = id WHERE type = 'Method' AND c >= 1 AND m <= 0""",
        "all_p", "c", "0.5 + 0.1 * c - 0.05 * m", "list_concat([id], ts)"),
    "motif_claim_strict": _hits(
        "claim_without_measurement", f"""SELECT * FROM (SELECT id, label, c, m, {_u('papers', 'more')} AS all_p, ts FROM nodes JOIN (SELECT source, count(*) FILTER (WHERE relation IN {_CLAIM}) AS c,
            bool_or(relation IN {_CLAIM} AND {_words('lower(evidence)', motifs.CLAIMS)}) AS word,
            count(*) FILTER (WHERE relation = 'measured_by') AS m, {_pf('true')} AS more, {_f('target', f'relation IN {_CLAIM}')} AS ts
            FROM edges WHERE relation IN {_CLAIM} OR relation = 'measured_by' GROUP BY source) ON source = id WHERE type = 'Method' AND c >= 2 AND m <= 0 AND word) WHERE len(all_p) >= 2""",
        "all_p", "c", "0.5 + 0.1 * c - 0.05 * m", "list_concat([id], ts)"),
    "motif_missing_baseline": _hits(
        "missing_baseline_comparison", f"""SELECT id, label, e, {_u('papers', 'more')} AS all_p, ts FROM nodes JOIN (SELECT source, count(*) FILTER (WHERE relation IN {_EVAL}) AS e,
            count(*) FILTER (WHERE relation = 'improves_over') AS i, {_pf(f'relation IN {_EVAL}')} AS more, {_f('target', f'relation IN {_EVAL}')} AS ts
            FROM edges GROUP BY source) ON source = id WHERE type = 'Method' AND e >= 1 AND i = 0""",
        "all_p", "e", "0.55 + 0.05 * e + 0.05 * len(all_p)", "list_concat([id], ts)"),
    "motif_shared_unrealistic": _hits(
        "shared_unrealistic_assumption", f"""SELECT id, label, ms, ps FROM nodes JOIN (SELECT target, {_f('source', 'true')} AS ms, {_pf('true')} AS ps,
            bool_or(source IN (SELECT source FROM edges WHERE relation IN {_HARM})) AS failing, string_agg(lower(evidence), ' ') AS ev
            FROM {_METHODS_IN} WHERE relation = 'assumes' GROUP BY target) ON target = id
            WHERE type = 'Assumption' AND {_words("(lower(label) || ' ' || ev)", motifs.IDEALIZED)} AND len(ms) >= 2 AND failing""",
        "ps", "len(ms)", "0.65 + 0.05 * len(ms) + 0.05 * len(ps)", "list_concat([id], ms)"),
}

_ALL = " UNION ALL ".join(f"SELECT * FROM ({_SQL[k]})" for k in _SQL if k != "motif_claim_strict")
_GAPS = f"""SELECT *, 'gap:' || substr(sha1(motif_id), 1, 16) AS gap_id, len(string_split(paper_ids, ' ')) AS n_papers,
    round(least(1.0, 0.45 + 0.35 * score), 6) AS novelty_score,
    CASE WHEN motif_type IN {gaps.WITH_SPANS} AND NOT (motif_type = 'shared_failure_condition' AND node_ids = node_id) THEN 0.65 ELSE 0.45 END AS feasibility_score,
    round(least(1.0, 0.45 + 0.1 * len(string_split(paper_ids, ' '))), 6) AS impact_score FROM ({_ALL})"""
_OVERALL = "round(CAST(0.3 * novelty_score + 0.25 * feasibility_score + 0.3 * impact_score + 0.15 * score AS DOUBLE), 6)"

ORACLE_SQL = {k: f"WITH {GRAPH_SQL} {v}" for k, v in _SQL.items()} | {
    "graph_nodes": f"WITH {GRAPH_SQL} SELECT id, type, label, array_to_string(papers, ' ') AS paper_ids FROM nodes",
    "graph_edges_merged": f"WITH {GRAPH_SQL} SELECT source, target, relation, confidence, support_count, evidence, array_to_string(papers, ' ') AS paper_ids FROM edges",
    "graph_type_summary": f"WITH {GRAPH_SQL} SELECT type, count(*) AS n, 'node' AS part FROM nodes GROUP BY type UNION ALL SELECT relation, count(*), 'edge' FROM edges GROUP BY relation",
    "graph_degree_topk": f"WITH {GRAPH_SQL} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id ORDER BY degree DESC, id LIMIT 25",
    "graph_induced_edges": f"""WITH {GRAPH_SQL}, top AS (SELECT id FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id ORDER BY count(*) DESC, id LIMIT 4000)
        SELECT source, target, relation FROM edges WHERE source IN (SELECT id FROM top) AND target IN (SELECT id FROM top)""",
    "field_norm_flags": f"""WITH {GRAPH_SQL} SELECT id, label, round(len(papers) / (SELECT count(DISTINCT paper_id) FROM tuples), 3) AS field_norm_fraction,
        round(len(papers) / (SELECT count(DISTINCT paper_id) FROM tuples), 3) >= 0.002 AS field_norm FROM nodes WHERE type = 'Assumption'""",
    "gap_rows": f"WITH {GRAPH_SQL}, g AS ({_GAPS}) SELECT gap_id, motif_type, CAST(novelty_score AS DOUBLE) AS novelty_score, CAST(feasibility_score AS DOUBLE) AS feasibility_score, CAST(impact_score AS DOUBLE) AS impact_score, {_OVERALL} AS overall_score, n_papers FROM g",
    "gap_supports": f"""WITH {GRAPH_SQL}, h AS ({_SQL['motif_shared_failure']}) SELECT unnest(string_split(node_ids, ' ')) AS source,
        'gap:' || substr(sha1(motif_id), 1, 16) AS target, 'supports_gap' AS relation FROM h""",
    "motif_counts": f"WITH {GRAPH_SQL}, h AS ({_ALL}) SELECT motif_type, count(*) AS n, round(avg(score), 6) AS mean_score FROM h GROUP BY motif_type",
    "diverse_slots": f"""WITH {GRAPH_SQL}, g AS ({_GAPS}), r AS (SELECT *, row_number() OVER (PARTITION BY motif_type ORDER BY n_papers DESC, {_OVERALL} DESC, gap_id) AS rn,
          count(*) OVER (PARTITION BY motif_type) AS size FROM g), m AS (SELECT motif_type, row_number() OVER (ORDER BY max(size) DESC, motif_type) AS mr, count(*) OVER () AS mm FROM r GROUP BY motif_type),
        s AS (SELECT r.*, mr, greatest(1, 40 // mm) + CASE WHEN mr <= 40 - greatest(1, 40 // mm) * mm THEN 1 ELSE 0 END AS quota FROM r JOIN m USING (motif_type)),
        p AS (SELECT gap_id, motif_type, row_number() OVER (ORDER BY mr, rn) AS slot FROM s WHERE rn <= quota) SELECT gap_id, motif_type, CAST(slot AS INTEGER) AS slot FROM p WHERE slot <= 40""",
    "flagship_recurring_limitations": f"""WITH {GRAPH_SQL}, h AS ({_SQL['motif_unaddressed_limitation']}), g AS ({_GAPS.replace(_ALL, 'SELECT * FROM h')})
        SELECT gap_id, motif_type, label, n_papers, {_OVERALL} AS overall_score FROM g ORDER BY overall_score DESC, gap_id LIMIT 50""",
}

QUERIES = {
    "flagship_recurring_limitations": flagship,
    "motif_shared_failure": _motif("shared_failure_condition"),
    "motif_unaddressed_limitation": _motif("repeated_unaddressed_limitation"),
    "motif_conflict_explicit": _motif("explicit_conflicts"),
    "motif_conflict_implicit": _motif("implicit_conflicts"),
    "motif_sparse_eval": _motif("sparse_evaluation"),
    "motif_assumption_mismatch": _motif("assumption_mismatch"),
    "motif_unrealistic_assumption": _motif("unrealistic_assumption"),
    "motif_theory_practice": _motif("theory_practice_gap"),
    "motif_transfer_gap": _motif("transfer_solution_gap"),
    "motif_unresolved_tradeoff": _motif("unresolved_tradeoff"),
    "motif_missing_stress_test": _motif("missing_stress_test"),
    "motif_claim_without_measurement": _motif("claim_without_measurement"),
    "motif_claim_strict": _motif("claim_without_measurement", **motifs.STRICT["claim_without_measurement"]),
    "motif_missing_baseline": _motif("missing_baseline_comparison"),
    "motif_shared_unrealistic": _motif("shared_unrealistic_assumption"),
    "graph_nodes": graph_nodes,
    "graph_edges_merged": graph_edges_merged,
    "graph_type_summary": graph_type_summary,
    "graph_degree_topk": graph_degree_topk,
    "graph_induced_edges": graph_induced_edges,
    "field_norm_flags": field_norm_flags,
    "gap_rows": gap_rows,
    "gap_supports": gap_supports,
    "motif_counts": motif_counts,
    "diverse_slots": diverse_slots,
}
