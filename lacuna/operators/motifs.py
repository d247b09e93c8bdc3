"""Structural gaps as graph-pattern queries over nodes and merged edges.

Every detector gives rows (motif_type, motif_id, node_id, label, node_ids, paper_ids, n_support, score); a motif's thresholds are arguments.
Edges are aggregated by one end before they meet the nodes, so hubs are pre-aggregated on the map side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.text import bounded, contains_any, stable_id
from lacuna.scratch import kept

# Words that mark an assumption as idealised.
IDEALIZED = [
    "known", "oracle", "access to", "requires knowledge", "assumes access", "given", "available", "labeled", "ground truth", "perfect",
    "infinite", "iid", "i.i.d", "stationary", "gaussian", "linear", "convex", "requires labeled", "requires oracle", "known horizon",
    "known distribution", "known reward", "known variance", "known noise", "known parameter",
]
# Words that mark a performance claim.
CLAIMS = [
    "robust", "robustness", "efficient", "efficiency", "scalable", "scalability", "generalize", "generalization", "improves",
    "outperforms", "better", "reduces", "increases", "accurate", "accuracy",
]
# Relations by polarity.
POSITIVE = ["improves_over", "evaluated_on", "addresses", "robust_to"]
NEGATIVE = ["fails_under", "limited_by", "not_addressed_by", "sensitive_to"]
EVALUATION = ["uses_dataset", "measured_by"]
HARM = ["fails_under", "limited_by"]
CLAIMING = ["addresses", "improves_over"]


def _rel(*names: str) -> Column:
    return F.col("relation").isin(*names)


def _n(test: Column) -> Column:
    return F.count_if(test)


def _papers(test: Column) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.when(test, F.col("paper_ids"))))))


def _set(test: Column, column: str) -> Column:
    return F.sort_array(F.collect_set(F.when(test, F.col(column))))


def _union(*arrays: Column | str) -> Column:
    out = F.coalesce(F.col(arrays[0]) if isinstance(arrays[0], str) else arrays[0], F.array().cast("array<string>"))
    for a in arrays[1:]:
        out = F.array_union(out, F.coalesce(F.col(a) if isinstance(a, str) else a, F.array().cast("array<string>")))
    return F.sort_array(out)


def _hits(rows: DataFrame, motif: str, papers: Column, support: Column, score: Column, node_ids: Column, tag: Column | str | None = None, key: list | None = None) -> DataFrame:
    return rows.select(
        F.lit(motif).alias("motif_type"),
        stable_id("motif", F.lit(motif if tag is None else tag), *(key or ["id"])).alias("motif_id"),
        F.col("id").alias("node_id"),
        "label",
        node_ids.alias("node_ids"),
        papers.alias("paper_ids"),
        support.cast("long").alias("n_support"),
        F.round(bounded(score), 6).alias("score"),
    )


def _of(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.where(F.col("type").isin(*types)).select("id", "label", "paper_ids")


def _ends(nodes: DataFrame) -> DataFrame:
    """Nodes that claims may have as ends: papers are ends of mentions only, and are many."""
    return nodes.where("type <> 'Paper'")


def _out(nodes: DataFrame, edges: DataFrame, relations: list[str], *aggs: Column) -> DataFrame:
    """Methods with aggregates of their outgoing edges of the given relations."""
    by = edges.where(_rel(*relations)).groupBy(F.col("source").alias("id")).agg(*aggs)
    return _of(nodes, "Method").join(by, "id")


def _methods_in(nodes: DataFrame, edges: DataFrame, relations: list[str]) -> DataFrame:
    """Edges of the given relations that come from methods."""
    return edges.where(_rel(*relations)).join(_of(nodes, "Method").select(F.col("id").alias("source")), "source", "left_semi")


def shared_failure_condition(nodes: DataFrame, edges: DataFrame, min_methods: int = 2) -> DataFrame:
    explicit = _methods_in(nodes, edges, ["fails_under"])
    mentioned = edges.where(_rel("mentions"))
    by = explicit.unionByName(mentioned).groupBy(F.col("target").alias("id")).agg(
        _set(_rel("fails_under"), "source").alias("methods"), _papers(_rel("fails_under")).alias("papers"), _papers(_rel("mentions")).alias("mentions")
    )
    rows = _of(nodes, "FailureCondition").drop("paper_ids").join(by, "id")
    strong = (F.size("methods") >= min_methods) & (F.size("papers") >= 2)
    weak = ~strong & (F.size("mentions") >= max(2, min_methods))
    m, p, q = F.size("methods"), F.size("papers"), F.size("mentions")
    either = lambda x, y: F.when(strong, x).otherwise(y)
    return _hits(
        rows.where(strong | weak), "shared_failure_condition", either(F.col("papers"), F.col("mentions")), either(m, q), either(0.4 + 0.15 * m + 0.1 * p, 0.35 + 0.1 * q),
        either(F.concat(F.array("id"), F.col("methods")), F.array("id")), either(F.lit("shared_failure_condition"), F.lit("shared_failure_condition_mention")),
    )


def repeated_unaddressed_limitation(nodes: DataFrame, edges: DataFrame, min_papers: int = 2) -> DataFrame:
    addressed = edges.where(_rel("addresses")).select(F.col("target").alias("id")).distinct()
    mentioned = edges.where(_rel("mentions")).groupBy(F.col("target").alias("id")).agg(_papers(F.lit(True)).alias("mentions"))
    rows = _of(nodes, "Limitation").join(addressed, "id", "left_anti").join(mentioned, "id", "left")
    rows = rows.withColumn("papers", _union("paper_ids", "mentions")).where(F.size("papers") >= min_papers)
    p = F.size("papers")
    return _hits(rows, "repeated_unaddressed_limitation", F.col("papers"), p, 0.45 + 0.15 * p, F.array("id"))


def explicit_conflicts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = _ends(nodes).select("id", "label", F.col("paper_ids").alias("own"))
    rows = edges.where(_rel("contradicts")).join(ends.select(F.col("id").alias("source"), F.col("own").alias("a")), "source").join(
        ends.select(F.col("id").alias("target"), "label", F.col("own").alias("b")), "target"
    )
    rows = rows.withColumn("papers", _union("paper_ids", "a", "b")).where(F.size("papers") >= 2).withColumn("id", F.col("target"))
    return _hits(rows, "conflicting_claims", F.col("papers"), F.lit(1), F.lit(0.75), F.array("source", "target"), key=["source", "target"])


def implicit_conflicts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    by = edges.where(_rel(*POSITIVE, *NEGATIVE)).groupBy(F.col("target").alias("id")).agg(
        _papers(_rel(*POSITIVE)).alias("plus"), _papers(_rel(*NEGATIVE)).alias("minus"), _set(F.lit(True), "source").alias("sources")
    )
    rows = by.where((F.size("plus") > 0) & (F.size("minus") > 0)).withColumn("papers", _union("plus", "minus")).where(F.size("papers") >= 2)
    rows = rows.join(_ends(nodes).select("id", "label"), "id")
    p = F.size("papers")
    return _hits(rows, "conflicting_claims", F.col("papers"), p, 0.55 + 0.1 * p, F.slice(F.concat(F.array("id"), F.col("sources")), 1, 10), "implicit_conflict", ["id", F.array_join("papers", "\n")])


def conflicting_claims(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return explicit_conflicts(nodes, edges).unionByName(implicit_conflicts(nodes, edges))


def sparse_evaluation(nodes: DataFrame, edges: DataFrame, min_mentions: int = 2, max_evaluations: int = 1) -> DataFrame:
    by = edges.where(_rel(*EVALUATION, "evaluated_on")).groupBy(F.col("source").alias("id")).agg(
        _n(_rel(*EVALUATION)).alias("n"), _set(_rel("evaluated_on"), "target").alias("tasks")
    )
    rows = _of(nodes, "Method").where("id IS NOT NULL").join(by, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = rows.where((F.size("paper_ids") >= min_mentions) & (F.col("n") <= max_evaluations))
    return _hits(
        rows, "sparse_evaluation", F.col("paper_ids"), F.col("n"), 0.45 + 0.1 * F.size("paper_ids") - 0.1 * F.col("n"),
        F.concat(F.array("id"), F.coalesce("tasks", F.array().cast("array<string>"))),
    )


def assumption_mismatch(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    both = _rel("assumes", "fails_under")
    rows = _out(nodes, edges, ["assumes", "fails_under"], _n(_rel("assumes")).alias("a"), _n(_rel("fails_under")).alias("f"), _papers(both).alias("more"), _set(both, "target").alias("targets"))
    rows = rows.where("a > 0 AND f > 0").withColumn("papers", _union("paper_ids", "more"))
    return _hits(rows, "assumption_mismatch", F.col("papers"), F.col("a") + F.col("f"), 0.6 + 0.05 * F.size("papers"), _union(F.array("id"), "targets"))


def _idealized_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of methods to what they assume, harm or are limited by, with ``ideal`` on idealised assumptions."""
    labels = _ends(nodes).select(F.col("id").alias("target"), F.lower("label").alias("target_label"))
    rows = edges.where(_rel("assumes", *HARM)).join(labels, "target")
    text = F.concat_ws(" ", "target_label", F.lower("evidence"))
    return rows.withColumn("ideal", _rel("assumes") & contains_any(text, IDEALIZED))


def unrealistic_assumption(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    used = F.col("ideal") | _rel(*HARM)
    by = _idealized_edges(nodes, edges).groupBy(F.col("source").alias("id")).agg(
        F.count_if("ideal").alias("k"), _n(_rel(*HARM)).alias("f"), _papers(used).alias("more"), _set(used, "target").alias("targets")
    )
    rows = _of(nodes, "Method").join(by, "id").where("k > 0 AND f > 0").withColumn("papers", _union("paper_ids", "more"))
    return _hits(rows, "unrealistic_assumption", F.col("papers"), F.col("k"), 0.7 + 0.05 * F.col("k"), _union(F.array("id"), "targets"))


def theory_practice_gap(nodes: DataFrame, edges: DataFrame, min_papers: int = 2) -> DataFrame:
    rows = _out(nodes, edges, [*EVALUATION, *HARM], _n(_rel(*EVALUATION)).alias("e"), _n(_rel(*HARM)).alias("f"), _papers(_rel(*HARM)).alias("more"), _set(_rel(*HARM), "target").alias("targets"))
    rows = rows.where((F.size("paper_ids") >= min_papers) & (F.col("e") == 0) & (F.col("f") > 0)).withColumn("papers", _union("paper_ids", "more"))
    return _hits(rows, "theory_practice_gap", F.col("papers"), F.col("f"), 0.65 + 0.05 * F.size("papers"), _union(F.array("id"), "targets"))


def transfer_solution_gap(nodes: DataFrame, edges: DataFrame, min_papers: int = 2, min_methods: int = 2) -> DataFrame:
    pairs = _methods_in(nodes, edges, ["addresses", *HARM]).groupBy(F.col("target").alias("id"), "source").agg(
        F.bool_or(_rel("addresses")).alias("solves"), _papers(_rel("addresses")).alias("by"), _papers(_rel(*HARM)).alias("harm"), F.bool_or(_rel(*HARM)).alias("hurt")
    )
    open_ = ~F.col("solves") & F.col("hurt")
    flat = lambda test, c: F.array_distinct(F.flatten(F.collect_list(F.when(test, F.col(c)))))
    by = pairs.groupBy("id").agg(
        _set(F.col("solves"), "source").alias("solvers"), _set(open_, "source").alias("affected"), flat(F.col("solves"), "by").alias("p1"), flat(open_, "harm").alias("p2")
    )
    rows = _of(nodes, "Limitation", "FailureCondition").drop("paper_ids").join(by, "id").withColumn("papers", _union("p1", "p2"))
    rows = rows.where((F.size("solvers") > 0) & (F.size("affected") >= max(1, min_methods)) & (F.size("papers") >= min_papers))
    return _hits(
        rows, "transfer_solution_gap", F.col("papers"), F.size("affected"), 0.6 + 0.05 * F.size("papers") + 0.05 * F.size("affected"),
        F.concat(F.array("id"), F.col("solvers"), F.col("affected")),
    )


def unresolved_tradeoff(nodes: DataFrame, edges: DataFrame, min_positive_edges: int = 1, min_limitation_mentions: int = 1, min_papers: int = 1) -> DataFrame:
    methods = _out(nodes, edges, [*CLAIMING, "limited_by"], _n(_rel(*CLAIMING)).alias("plus"), _n(_rel("limited_by")).alias("lims"), _papers(_rel(*CLAIMING)).alias("more"))
    methods = methods.where((F.col("plus") >= min_positive_edges) & (F.col("lims") >= min_limitation_mentions))
    solved = edges.where(_rel("addresses")).select("target").distinct()
    limits = edges.where(_rel("limited_by")).join(solved, "target", "left_anti").select(F.col("source").alias("id"), "target", F.col("paper_ids").alias("edge_papers"))
    ends = _ends(nodes).select(F.col("id").alias("target"), F.col("paper_ids").alias("target_papers"), F.col("label").alias("limitation"))
    rows = methods.join(limits, "id").join(ends, "target").withColumn("papers", _union("paper_ids", "more", "edge_papers"))
    rows = rows.where(F.size("papers") >= min_papers)
    wide = F.when(F.size(_union("edge_papers", "target_papers")) >= 2, 0.10).otherwise(0.0)
    return _hits(rows, "unresolved_tradeoff", F.col("papers"), F.col("plus"), 0.65 + 0.05 * F.col("plus") + wide, F.array("id", "target"), key=["id", "target"])


def missing_stress_test(nodes: DataFrame, edges: DataFrame, min_methods: int = 2, min_papers: int = 2, max_eval_edges: int = 1) -> DataFrame:
    tested = edges.where(_rel(*EVALUATION)).select("source").distinct().withColumn("tested", F.lit(True))
    failing = _methods_in(nodes, edges, ["fails_under"]).join(tested, "source", "left")
    by = failing.groupBy(F.col("target").alias("id")).agg(
        _set(F.lit(True), "source").alias("methods"), _papers(F.lit(True)).alias("papers"), F.size(F.collect_set(F.when(F.col("tested"), F.col("source")))).alias("e")
    )
    m, p, e = F.size("methods"), F.size("papers"), F.col("e")
    rows = _of(nodes, "FailureCondition").drop("paper_ids").join(by, "id").where(((m >= min_methods) | (p >= min_papers)) & (e <= max_eval_edges))
    return _hits(rows, "missing_stress_test", F.col("papers"), m, 0.6 + 0.05 * m + 0.05 * p - 0.05 * e, F.concat(F.array("id"), F.col("methods")))


def claim_without_measurement(nodes: DataFrame, edges: DataFrame, max_measurement_edges: int = 0, require_claim_keyword: bool = False, min_papers: int = 1, min_claim_edges: int = 1) -> DataFrame:
    rel = [*CLAIMING, "measured_by"]
    word = F.coalesce(F.bool_or(_rel(*CLAIMING) & contains_any(F.lower("evidence"), CLAIMS)), F.lit(False))
    rows = _out(nodes, edges, rel, _n(_rel(*CLAIMING)).alias("c"), _n(_rel("measured_by")).alias("m"), word.alias("word"), _papers(F.lit(True)).alias("more"), _set(_rel(*CLAIMING), "target").alias("targets"))
    rows = rows.withColumn("papers", _union("paper_ids", "more")).where(
        (F.col("c") >= max(1, min_claim_edges)) & (F.col("m") <= max_measurement_edges) & (F.size("papers") >= min_papers)
    )
    rows = rows.where("word") if require_claim_keyword else rows
    return _hits(rows, "claim_without_measurement", F.col("papers"), F.col("c"), 0.5 + 0.1 * F.col("c") - 0.05 * F.col("m"), F.concat(F.array("id"), F.col("targets")))


def missing_baseline_comparison(nodes: DataFrame, edges: DataFrame, min_eval_edges: int = 1, min_method_papers: int = 1) -> DataFrame:
    rows = _out(nodes, edges, [*EVALUATION, "improves_over"], _n(_rel(*EVALUATION)).alias("e"), _n(_rel("improves_over")).alias("i"), _papers(_rel(*EVALUATION)).alias("more"), _set(_rel(*EVALUATION), "target").alias("targets"))
    rows = rows.where((F.col("e") >= max(1, min_eval_edges)) & (F.col("i") == 0)).withColumn("papers", _union("paper_ids", "more"))
    rows = rows.where(F.size("papers") >= min_method_papers)
    return _hits(rows, "missing_baseline_comparison", F.col("papers"), F.col("e"), 0.55 + 0.05 * F.col("e") + 0.05 * F.size("papers"), F.concat(F.array("id"), F.col("targets")))


def shared_unrealistic_assumption(nodes: DataFrame, edges: DataFrame, min_methods: int = 2) -> DataFrame:
    evidence = edges.where(_rel("assumes")).groupBy(F.col("target").alias("id")).agg(F.array_join(F.collect_set(F.lower("evidence")), " ").alias("evidence"))
    ideal = _of(nodes, "Assumption").drop("paper_ids").join(evidence, "id").where(contains_any(F.concat_ws(" ", F.lower("label"), "evidence"), IDEALIZED))
    failing = edges.where(_rel(*HARM)).select("source").distinct().withColumn("failing", F.lit(True))
    by = _methods_in(nodes, edges, ["assumes"]).join(failing, "source", "left").groupBy(F.col("target").alias("id")).agg(
        _set(F.lit(True), "source").alias("methods"), _papers(F.lit(True)).alias("papers"), F.coalesce(F.bool_or("failing"), F.lit(False)).alias("failing")
    )
    rows = ideal.join(by, "id").where((F.size("methods") >= min_methods) & F.col("failing"))
    m, p = F.size("methods"), F.size("papers")
    return _hits(rows, "shared_unrealistic_assumption", F.col("papers"), m, 0.65 + 0.05 * m + 0.05 * p, F.concat(F.array("id"), F.col("methods")))


DETECTORS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        assumption_mismatch, claim_without_measurement, conflicting_claims, missing_baseline_comparison, missing_stress_test,
        repeated_unaddressed_limitation, shared_failure_condition, shared_unrealistic_assumption, sparse_evaluation, theory_practice_gap,
        transfer_solution_gap, unrealistic_assumption, unresolved_tradeoff,
    )
}

# Thresholds of the strict state.
STRICT: dict[str, dict] = {
    "claim_without_measurement": {"min_papers": 2, "min_claim_edges": 2, "require_claim_keyword": True, "max_measurement_edges": 0},
    "unresolved_tradeoff": {"min_positive_edges": 2, "min_limitation_mentions": 2, "min_papers": 2},
    "sparse_evaluation": {"min_mentions": 4, "max_evaluations": 1},
    "missing_baseline_comparison": {"min_eval_edges": 2, "min_method_papers": 2},
    "theory_practice_gap": {"min_papers": 3},
}


def activation(default: str = "normal", enabled: list[str] = (), strict: list[str] = (), disabled: list[str] = ()) -> dict[str, str]:
    """State of every motif: disabled outranks strict, strict outranks enabled; unknown names are an error."""
    unknown = {*enabled, *strict, *disabled} - DETECTORS.keys()
    if unknown:
        raise ValueError(f"unknown motifs: {sorted(unknown)}")
    return {n: "off" if n in disabled else "strict" if n in strict else "normal" if n in enabled else default for n in DETECTORS}


def all_motifs(nodes: DataFrame, edges: DataFrame, states: dict[str, str] | None = None, thresholds: dict[str, dict] | None = None) -> DataFrame:
    """Hits of all active motifs; raises if none is active.

    The graph is written once, by type and relation, and every detector reads the parts it needs.
    """
    states, out = states or activation(), None
    if all(s == "off" for s in states.values()):
        raise ValueError("no motif is active")
    nodes, edges = kept(nodes, "nodes", "type"), kept(edges, "edges", "relation")
    for name in sorted(DETECTORS):
        if states[name] != "off":
            settings = (thresholds or {}).get(name, {}) | (STRICT.get(name, {}) if states[name] == "strict" else {})
            hits = DETECTORS[name](nodes, edges, **settings)
            out = hits if out is None else out.unionByName(hits)
    return out
