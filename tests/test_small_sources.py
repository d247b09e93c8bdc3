"""Snapshots, event logs, report rows, profiles and search programs."""

from __future__ import annotations

import sys

import pytest

from lacuna.operators import gates
from lacuna.sources import connectors, html, runs, sinks


def test_generations_replace_only_themselves(spark, tmp_path):
    path = str(tmp_path / "g")
    for number, ids in ((0, [1, 2]), (1, [3]), (1, [4, 5])):
        sinks.generation(spark.createDataFrame([(i,) for i in ids], "id int"), number, path)
    assert sorted((r["generation"], r["id"]) for r in spark.read.parquet(path).collect()) == [(0, 1), (0, 2), (1, 4), (1, 5)]


def test_events_and_reports(spark, tmp_path):
    path = str(tmp_path / "e")
    sinks.events(spark.createDataFrame([("start", "a"), ("failure", "b")], "type string, stage string"), path)
    sinks.events(spark.createDataFrame([("end",)], "type string"), path)
    log = spark.read.json(path)
    assert log.count() == 3 and [r["payload"] for r in sinks.failures(log).collect()] == ['{"stage":"b"}'] and log.where("at IS NULL").count() == 0
    rows = sinks.report_rows(spark.createDataFrame([("x", [1, 2], "o")], "id string, list array<int>, other string"), ["id", "score", "list"], ["other", "none"])
    assert rows.columns == ["id", "score", "list", "other"] and rows.first()["list"] == "[1,2]" and rows.first()["score"] is None


def test_profiles(spark):
    page = lambda body: spark.createDataFrame([(body,)], "html string")
    good = '<a class="x t y">One <b>title</b></a><a class="t">Two</a><a class="t">One title</a><a class="t"> </a>'
    export = spark.createDataFrame([("Three",), (None,), ("Three",), ("Four",)], "Title string")
    take = lambda *a: [(r["title"], r["source"]) for r in sorted(html.profile_titles(*a, "t", 5).collect(), key=lambda r: r["rank"])]
    assert take(page(good), export) == [("One title", "page"), ("Two", "page")]
    for bad in ("<p>nothing</p>", good + "Please solve the CAPTCHA", None):
        assert take(page(bad), export) == [("Three", "export"), ("Four", "export")]
    assert take(None, export)[0] == ("Three", "export") and html.profile_titles(page(good), None, "t", 1).count() == 1
    with pytest.raises(ValueError):
        html.profile_titles(page("x"), None, "t", 5)


def test_programs_and_backends(spark):
    search = connectors.command([sys.executable, "-c", "import json, sys; print(json.dumps([{'id': 'same'}, {'id': sys.argv[1]}, {'n': int(sys.argv[2])}]))"])
    rows = {r["key"]: r["query"] for r in connectors.first_seen(spark, search, ["b", "a"], 5, "id").collect()}
    assert rows == {"same": "b", "b": "b", "a": "a"}
    bad = connectors.searched(spark, connectors.command([sys.executable, "-c", "print('{}')"]), ["q"], 5).first()
    assert bad["body"] is None and "ValueError" in bad["error"]
    known = {"one": search, "two": search}
    assert [n for n, _ in connectors.chosen({"backends": ["two", "two"]}, known)] == ["two"] and len(connectors.chosen({}, known)) == 2
    with pytest.raises(ValueError):
        connectors.chosen({"backends": ["three"]}, known)


def test_run_documents(spark, tmp_path):
    run = tmp_path / "run"
    (run / "verification").mkdir(parents=True)
    assert runs.read_json(run / "none.json", {"a": 1}) == {"a": 1} and runs.first_existing(str(run), ("x", "y")) is None
    runs.write_json(f"{run}/verification/verification_summary.json", [{"gap_id": "g1", "label": "A"}, {"id": "g2"}, "odd"])
    (run / "verification" / f"{gates.AGENTS[0]}_results.jsonl").write_text('{"gap_id": "g1"}\n\n{"gap_id": "g3"}\n')
    summaries, lines = runs.agent_sources(spark, str(run))
    assert sorted(r["gap_id"] for r in summaries.collect()) == ["g1", "g2"] and {(r["gap_id"], r["agent"]) for r in lines.collect()} >= {("g1", gates.AGENTS[0]), ("g3", gates.AGENTS[0])}
    runs.write_manifest(spark.createDataFrame([("p", ["a", "b"])], "paper_id string, authors array<string>"), str(run))
    assert runs.read_json(run / "papers_manifest.json") == [{"paper_id": "p", "authors": ["a", "b"]}] and runs.first_existing(str(run), ("x", "papers_manifest.json")) == f"{run}/papers_manifest.json"
    assert spark.read.option("header", True).csv(f"{run}/papers_manifest_csv").first()["paper_id"] == "p"
    assert "Extracted papers: 0" in runs.summary_text(runs.summarize(spark, str(run))) and runs.summary_text(runs.summarize(spark, str(run))).endswith("not found")
