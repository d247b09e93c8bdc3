"""Labels' normal forms: the short way equals the folding, and graph ids stay compiled."""

from pyspark.sql import functions as F

from lacuna.functions.normalise import TRAILING_ACRONYM, normalized_label, normalized_math
from lacuna.functions.text import squash
from lacuna.operators import graph
from lacuna.plans import views

LABELS = [
    "Plain label", "  outer  ", "two  spaces", "tab\tin", "line\n", "\tlead", "x²", "a₁", r"\hat{X} Y", "n^{2}", "{a}", "Ω", "ω bound", "θ", "Θ(n)", "Graph Net (GNN)", "Graph Net (GNN) ", "(ABC)",
    "Näher Ünicode", "no-break space", "form\ffeed", "cr\r", "vt\x0b", "", " ", None, "a (b)", "xᵐ", "5ⁿ",
]


def test_short_way_equals_folding(spark):
    rows = spark.createDataFrame([(x,) for x in LABELS], "label string")
    whole = F.lower(squash(F.regexp_replace(F.trim(normalized_math("label")), r"\s*" + TRAILING_ACRONYM, "")))
    for got in rows.select("label", normalized_label("label").alias("got"), whole.alias("want")).collect():
        assert got.got == got.want, got.label


def test_ids_of_both_ends_are_compiled(spark):
    """The JVM leaves methods of over 8000 bytes to its interpreter."""
    rows = graph.resolved(views.tuples(spark, "/root/testdata/sf0.001"))
    plan = rows.select("source", "target", "relation", "paper_id", "evidence", "confidence", "seq")._jdf.queryExecution().executedPlan()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(plan)
    assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000


def test_diverse_slots_find_their_motifs_once(spark, monkeypatch):
    """The gaps are written before ranks and sizes read them, so the motifs' plan is not in the result's twice."""
    from lacuna.plans import graph_queries

    hits = spark.createDataFrame(
        [(f"m{i % 3}", f"id{i}", "n", "l", ["n"], ["p"] * (i % 4 + 1), 1, 0.5) for i in range(60)],
        "motif_type string, motif_id string, node_id string, label string, node_ids array<string>, paper_ids array<string>, n_support long, score double",
    )
    monkeypatch.setattr(graph_queries, "evidence_graph", lambda *_: (None, None))
    monkeypatch.setattr(graph_queries.motifs, "all_motifs", lambda *_: hits)
    got = graph_queries.diverse_slots(spark, "")
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 40 and {r.motif_type for r in got.collect()} == {"m0", "m1", "m2"}
