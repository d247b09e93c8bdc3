"""Operators of the engine on hand-made rows, and every query against its SQL at the smallest scale."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lacuna import cli, config
from lacuna.functions import text as T
from lacuna.functions import vectorised
from lacuna.operators import counterevidence, evolution, families, gaps, graph, judging, models, motifs, profiles, retrieval, similarity
from lacuna.plans import catalogue
from lacuna.sources import html, readers, sinks
from lacuna.streaming import events, ledger

SF = "/root/testdata/sf0.001"


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_scalar_functions(spark):
    n = F.lit(None).cast("double")
    r = one(
        spark, T.bounded(n), T.clamped_confidence(F.lit("abc")), T.clamped_confidence(F.lit("1.7")), T.confidence_from_text(F.lit("about 85 %")),
        T.bare_doi(F.lit("https://doi.org/10.1/x")), T.bare_arxiv(F.lit("2401.1v3")), T.normalized_title(F.lit(" A, b-C! ")), T.jaccard(F.array(F.lit(1)), F.array().cast("array<int>")),
        T.coerced_enum(F.lit(" OutPerforms "), ["improves_over"], {"outperforms": "improves_over"}, "addresses"), T.repaired_json(F.lit('x ```json {"a": [1,],} ``` y')),
        T.truncated(F.lit("a  b" + "c" * 20), 10), T.replaced_words(F.lit("Foo food foo"), {"foo": "X"}), vectorised.ascii_folded(F.lit("Naïve  Con-\nvex")), vectorised.sequence_ratio(F.lit("abcd"), F.lit("bcde")),
    )
    assert r[:4] == (None, 0.5, 1.0, 0.85)
    assert r[4:9] == ("0.1/x", "2401.1", "a bc", 0.0, "improves_over") or r[4].endswith("10.1/x")
    assert json.loads(r[9]) == {"a": [1]} and len(r[10]) <= 10 and r[11] == "X food X" and r[12] == "naive convex" and r[13] == 0.75


TUPLES = "paper_id string, subject string, relation string, object string, evidence string, confidence double, seq string"


def small_graph(spark, rows, mentions=None):
    typed = graph.resolved(spark.createDataFrame([(p, s, r, o, e, 0.9, str(i)) for i, (p, s, r, o, e) in enumerate(rows)], TUPLES))
    listed = spark.createDataFrame(mentions, "paper_id string, type string, label string") if mentions else None
    return graph.nodes(typed, listed), graph.edges(typed, listed)


def test_motifs_by_hand(spark):
    n, e = small_graph(spark, [
        ("p1", "A", "fails_under", "noise", "x"), ("p2", "B", "fails_under", "noise", "x"), ("p1", "A", "limited_by", "cost", ""), ("p3", "C", "limited_by", "cost", ""),
        ("p1", "A", "assumes", "known horizon", ""), ("p2", "B", "assumes", "known horizon", ""), ("p4", "D", "addresses", "drift", "better"), ("p5", "E", "limited_by", "drift", ""), ("p6", "F", "limited_by", "drift", ""),
        ("p7", "G", "uses_dataset", "d", ""), ("p8", "x", "contradicts", "y", ""), ("p9", "x", "contradicts", "y", "again"), ("p1", "A", "unheard_of", "z", ""),
    ])
    got = {k: {r.label: r.score for r in f(n, e).collect()} for k, f in motifs.DETECTORS.items()}
    assert got["shared_failure_condition"] == {"noise": 0.9}
    assert got["repeated_unaddressed_limitation"] == {"cost": 0.75}
    assert got["transfer_solution_gap"] == {"drift": 0.85}
    assert set(got["unrealistic_assumption"]) == {"A", "B"} and got["shared_unrealistic_assumption"] == {"known horizon": 0.85}
    assert got["claim_without_measurement"] == {"D": 0.6} and got["missing_baseline_comparison"] == {"G": 0.65}
    assert got["conflicting_claims"]["y"] == 0.75 and got["missing_stress_test"] == {"noise": 0.8}
    assert motifs.all_motifs(n, e).count() == sum(f(n, e).count() for f in motifs.DETECTORS.values())
    edge = e.where("relation = 'contradicts'").first()
    assert edge.support_count == 2 and edge.paper_ids == ["p8", "p9"]


def test_motif_mentions_and_states(spark):
    n, e = small_graph(spark, [("p1", "A", "fails_under", "noise", "x")], [("p2", "FailureCondition", "noise"), ("p3", "FailureCondition", "noise")])
    hit = motifs.shared_failure_condition(n, e).collect()
    assert [(r.score, r.paper_ids) for r in hit] == [(0.55, ["p2", "p3"])]
    assert motifs.activation("off", strict=["sparse_evaluation"], disabled=["sparse_evaluation"])["sparse_evaluation"] == "off"
    with pytest.raises(ValueError):
        motifs.activation(enabled=["no_such"])
    with pytest.raises(ValueError):
        motifs.all_motifs(n, e, motifs.activation("off"))


def test_similarity(spark):
    rows = spark.createDataFrame([(1, list("abcde")), (2, list("abcdef")), (3, list("xyz")), (4, list("zyx")), (5, []), (6, None)], "id long, tokens array<string>")
    assert {(r.a, r.b) for r in similarity.similar_pairs(rows, 0.8).collect()} == {(1, 2), (3, 4)}
    labels = similarity.components(spark.range(1, 8), spark.createDataFrame([(1, 2), (2, 3), (6, 5)], "a long, b long"))
    assert {r.id: r.component for r in labels.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}


def test_selection(spark):
    rows = spark.createDataFrame([(i, f"t{i % 5}", "ab"[i % 2], "impossibility_boundary" if i < 3 else "m", "STRONG", 0.9 - i / 100, 0.1) for i in range(9)], "id long, title string, source string, kind string, label string, ni double, risk double")
    got = [r.id for r in gaps.soft_capped(rows, 4).orderBy("position").collect()]
    assert len(got) == 4 and got.count(0) + got.count(1) + got.count(2) <= 2
    vec = spark.createDataFrame([(0, 1.0, [1.0, 0.0]), (1, 0.9, [1.0, 0.0]), (2, 0.5, [0.0, 1.0]), (3, 0.0, [0.5, 0.5])], "id long, score double, embedding array<double>")
    assert [r.id for r in retrieval.mmr(vec, 2, 0.5).orderBy("position").collect()] == [0, 2]
    pop = spark.createDataFrame([(i, 1 - i / 10, ["a", str(i)], f"o{i // 3}", f"c{i}", i % 2 == 0) for i in range(8)], "id long, fitness double, tokens array<string>, origin string, cluster string, combined boolean")
    final = [r.id for r in evolution.diverse_finals(pop, 5).orderBy("position").collect()]
    assert final[0] == 0 and sum(i // 3 == 0 for i in final) <= 2 and sum(i % 2 == 0 for i in final) <= 1


def test_evolution(spark):
    rows = spark.createDataFrame([(i, "m", 0.5, 0.5, 0.5, 0.5, 0.4, 3.0, 2.0) for i in range(6)], "id long, motif_type string, novelty double, feasibility double, impact double, specificity double, survival double, evidence double, trace double")
    kids = evolution.mutated(rows, 1).collect()
    assert all(0.5 <= k[s] <= 0.58 for k in kids for s in evolution.SCORES) and evolution.mutated(rows, 1).collect() == kids
    assert evolution.crossed(rows, 1).count() == 3
    assert rows.select(F.round(evolution.base_fitness(), 4)).first()[0] == round(0.3 + 0.075 + 0.04 + 0.06, 4)


def test_counterevidence_and_families(spark):
    g = spark.createDataFrame([("g", "p1", ["a", "b", "c"])], "gap_id string, paper_id string, tokens array<string>")
    r = spark.createDataFrame([("r1", "p2", ["a", "b"]), ("r2", "p1", ["a"]), ("r3", "p3", ["z"])], "record_id string, paper_id string, tokens array<string>")
    got = counterevidence.candidates(g, r, spark.createDataFrame([("a",), ("b",)], "t string")).collect()
    assert [(x.record_id, x.score) for x in got] == [("r1", round(2 / 3 + 0.2, 6)), ("r2", round(1 / 3 - 0.1, 6))]
    v = spark.createDataFrame([("g", "fully_addresses", "", "full", 0.9), ("h", "fully_addresses", "", "partial", 0.7), ("k", "", "", "", 0.1)], "gap_id string, label string, relation string, scope string, confidence double")
    assert {x.gap_id: x.status for x in counterevidence.corpus_status(v).collect()} == {"g": "solved_in_corpus", "h": "partially_addressed", "k": "open"}
    f = spark.createDataFrame([
        (1, "s1", "g1", ["p", "q"], ["a", "b"], 0.9, 0.9, 0.1, 0.8, "strong", "OK", "strong"), (2, "s1", "g2", ["x"], [], 0.8, 0.7, 0.2, 0.6, "weak", "OK", "strong"), (3, "s3", "g3", ["p", "q"], ["a", "b", "c"], 0.7, 0.6, 0.1, 0.6, "weak", "OK", "weak"),
        (4, "s4", "g4", ["y"], [], 0.1, 0.1, 0.9, 0.1, "weak", "DROP", "weak"),
    ], "id long, source string, gap_id string, papers array<string>, tokens array<string>, ni double, specificity double, fake double, feasibility double, support string, label string, fit string")
    fam = {x.family_id: x for x in families.graded(families.families(f, families.family_links(f))).collect()}
    assert fam[1].members == [1, 2, 3] and fam[1].representative == 1 and fam[4].grade == "D"


def test_models_and_resume(spark, tmp_path):
    prompts = spark.createDataFrame([(i, f"prompt {i}") for i in range(6)], "id long, prompt string")
    path = str(tmp_path / "log")
    first = models.resumed(prompts.where("id < 3"), path)
    assert first.count() == 3 and models.resumed(prompts, path).count() == 6 and models.resumed(prompts, path).count() == 6
    assert models.verdicts(spark.read.parquet(path)).where("confidence BETWEEN 0 AND 1").count() == 6
    bad = models.replies(prompts, lambda p: "no json", attempts=2).collect()
    assert all(r.reply is None and r.attempts == 2 and r.error.startswith("JSONDecodeError") for r in bad)


def test_judging_group_of_one(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "m string, v double")
    got = {r.m: (r.v_mean, r.v_std, r.v_stderr, r.n) for r in judging.group_stats(rows, ["m"], ["v"]).collect()}
    assert got == {"a": (2.0, 1.4142, 1.0, 2), "b": (2.0, None, None, 1)}


def test_profiles(spark):
    seeds = spark.createDataFrame([("a",), ("b",)], "k string")
    found = spark.createDataFrame([("b", 1), ("c", 2), ("d", 3)], "k string, rank int")
    got = {r.k: r.provenance for r in profiles.merged_corpus(seeds, found, "k", 3).collect()}
    assert got == {"a": ["seed"], "b": ["seed", "retrieved"], "c": ["retrieved"]}
    g = spark.createDataFrame([(1, ["x", "y"]), (2, [])], "gap_id long, paper_ids array<string>")
    assert {r.gap_id: r.alignment for r in profiles.alignment(g, spark.createDataFrame([("x",)], "paper_id string")).collect()} == {1: 0.5, 2: 0.0}


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"title": "One", "doi": "d1"}\n{"title": "Tw\n{"title": "Two Words"}\n')
    (tmp_path / "b.csv").write_text("Title,Year\nOne more,2001\n,2002\n")
    (tmp_path / "c.bib").write_text("@article{k1, title={A {Bib} Title}, author={X Y and Z W}, year={1999}, journal={J}}\n@misc{k2, year=2000}\n")
    got = {r.seed_paper_id: r.source for r in readers.seeds(spark, str(tmp_path)).collect()}
    assert got == {"d1": "jsonl", "two-words": "jsonl", "one-more": "csv", "a-bib-title": "bib"}
    bib = readers.bibtex(readers.whole_texts(spark, str(tmp_path / "c.bib"))).first()
    assert (bib.key, bib.authors, bib.year, bib.venue) == ("k1", ["X Y", "Z W"], 1999, "J")
    (tmp_path / "m.json").write_text('{"paper_id": "1", "title": "t", "authors": "A", "year": 2000, "source": "s", "text_path": "x"}\n')
    assert readers.local_corpus(spark, str(tmp_path / "m.json")).first().authors == ["A"]
    (tmp_path / "n.json").write_text('{"paper_id": "1", "title": ""}\n')
    with pytest.raises(ValueError, match="title"):
        readers.local_corpus(spark, str(tmp_path / "n.json"))
    n, e = small_graph(spark, [("p1", "A", "fails_under", "noise <&>", "x")])
    sinks.graph(n, e, str(tmp_path / "g"))
    back = sinks.read_graph(spark, str(tmp_path / "g"))
    assert (back[0].count(), back[1].count()) == (2, 1) and "noise &lt;&amp;&gt;" in sinks.graphml(n, e, 10)
    page = spark.createDataFrame([('<html><TITLE>\n A b </title><a class="x name y"><b>T</b> u</a></html>',)], "html string")
    assert page.select(html.title("html"), html.by_class("html", "name")).first() == ("A b", ["T u"])


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:00:01", "a"), (2, "2024-01-01 00:00:02", None)], "id long, t string, kind string").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.deduplicated(events.read(spark, str(tmp_path / "in"), "id long, t timestamp, kind string"), "id", "t")
    ledger.split(stream, str(tmp_path / "out"), "kind IS NOT NULL", str(tmp_path / "cp")).awaitTermination(60)
    assert [ledger.committed(spark, str(tmp_path / "out"), p, "id long, t timestamp, kind string").count() for p in ("done", "failed")] == [1, 1]


def test_config_and_cli(tmp_path, capsys):
    (tmp_path / "a.json").write_text('{"llm": {"mock": "${NO_SUCH_NAME:-false}", "url": "${U:-x}"}, "n": 1}')
    (tmp_path / "b.json").write_text('{"llm": {"url": "y"}}')
    got = config.load([str(tmp_path / "a.json"), str(tmp_path / "b.json")], {"n": 2}, {})
    assert got == {"llm": {"mock": False, "url": "y"}, "n": 2}
    assert config.problems({"api_key": "a" * 24, "p": "/home/me/x"}, ("graph",)) == ["missing section: graph", "secret value: api_key", "private path: p"]
    assert cli.main(["list"]) == 0 and "gap_rows" in capsys.readouterr().out
    assert cli.main(["validate-config", str(tmp_path / "a.json")]) == 0


def plain(x):
    return "NULL" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", ["flagship_recurring_limitations", "motif_transfer_gap", "motif_unresolved_tradeoff", "graph_edges_merged", "dedup_multikey", "near_dup_jaccard", "relevance_score", "win_rates", "verification_gate", "agent_confidence"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    cur = con.execute(catalogue.ORACLE_SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert sorted(tuple(plain(x) for x in r) for r in got.select(*cols).collect()) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
