"""Run folders, local corpora, mock runs, commands, audits, connectors and selections."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from lacuna import cli
from lacuna.operators import evolution, formulations, retrieval_run, search_plans, selection
from lacuna.sources import connectors, readers, runs, sinks


@pytest.fixture(scope="module")
def example(tmp_path_factory):
    folder = tmp_path_factory.mktemp("example")
    assert cli.main(["init-example", str(folder)]) == 0
    return folder


def test_example_corpus(spark, example):
    rows = {r.paper_id: r for r in runs.corpus_rows(spark, str(example / "papers.jsonl")).collect()}
    assert set(rows) == {"toy-001", "toy-002", "toy-003"} and rows["toy-001"].authors == ["A. Author"] and not any(r.problems for r in rows.values())


def test_smoke_run(spark, example, tmp_path, capsys):
    run = str(tmp_path / "run")
    assert cli.main(["smoke-test", str(example / "config.json"), run]) == 0
    assert "Scientific tuples: 3" in capsys.readouterr().out
    found = runs.summarize(spark, run)
    assert (found["tuple_count"], found["candidate_gap_count"], found["run_dir_exists"]) == (3, 0, True)
    assert runs.tuples(spark, run).count() == 3 and runs.papers(spark, run).count() == 3
    for command in ("detect-gaps", "verify-gaps", "report"):
        assert cli.main([command, run]) == 0
    gaps = spark.read.json(f"{run}/gaps/gap_rows")
    assert "small distribution shifts" in {r.label for r in gaps.collect()}
    assert (tmp_path / "run/verification/verification_gate/decisions").exists()


def test_empty_run(spark, tmp_path, capsys):
    assert cli.main(["summarize-run", str(tmp_path)]) == 0
    out = capsys.readouterr().out
    assert "Candidate gaps: 0" in out and "Final report: not found" in out
    assert runs.summarize(spark, str(tmp_path / "none"))["run_dir_exists"] is False


def test_local_corpus_manifests(spark, example, tmp_path):
    run = str(tmp_path / "runs/one")
    assert runs.prepared(spark, str(example / "papers.jsonl"), run).count() == 3 and runs.parsed(spark, run).where("full_text_chars > 50").count() == 3
    assert cli.main(["parse-papers", run]) == 0
    assert {r.heading for r in spark.read.parquet(f"{run}/parsed/sections").collect()} == {"introduction"}
    runs.write_lines(f"{run}/extracted/all_tuples.jsonl", [
        {"paper_id": "toy-001", "subject": "A", "relation": "limited by", "object": "shift", "evidence_text": "limited by small distribution shifts", "polarity": "positive"},
        {"paper_id": "toy-001", "subject": "A", "relation": "limited_by", "object": "shift", "evidence_text": "nowhere in the paper at all", "polarity": "x"},
        {"paper_id": "toy-002", "subject": "the method", "relation": "limited_by", "object": "shift", "evidence_text": "limited by small distribution shifts"},
    ])
    assert cli.main(["extract", run]) == 0
    dropped = {r.drop_reason for r in spark.read.json(f"{run}/extracted/dropped_tuples").collect()}
    assert dropped == {"unverified_span", "junk_subject"} | ({"unknown_relation"} if "unknown_relation" in dropped else set())


@pytest.mark.parametrize("line, error", [('{"paper_id": "1"', "invalid JSON"), ('{"paper_id": "1", "title": "t"}', "missing authors"), ('{"paper_id": "1", "title": "t", "authors": "a", "year": 1, "source": "s"}', "text_path or pdf_path"),
                                         ('{"paper_id": "1", "title": "t", "authors": "a", "year": 1, "source": "s", "text_path": "no"}', "no such file"), ("", "no records")])
def test_bad_manifests(spark, tmp_path, line, error):
    (tmp_path / "config.json").write_text("{}")
    (tmp_path / "papers.jsonl").write_text(line + "\n")
    with pytest.raises(ValueError, match=error):
        runs.prepared(spark, str(tmp_path / "papers.jsonl"), str(tmp_path / "run"))


def test_audit(spark, tmp_path):
    bundle, docs = tmp_path / "artifacts" / "release_bundle", tmp_path / "docs"
    bundle.mkdir(parents=True)
    docs.mkdir()
    (bundle / "a.md").write_text("Coauthor note: do not show this")
    (docs / "b.md").write_text("Internal note: do not show rejected artifacts. /home/someone/x")
    (docs / "c.txt").write_text("key ghp_" + "a1" * 14)
    (docs / ".env").write_text("X=1")
    (docs / "d.pdf").write_bytes(b"%PDF")
    (docs / "big.txt").write_text("x" * 2000)
    found = {(r.kind, r.path) for r in runs.audit(spark, str(tmp_path), 1000).collect()}
    assert ("internal_bundle_note", "artifacts/release_bundle/a.md") in found and ("internal_bundle_note", "docs/b.md") not in found
    assert {("private_path", "docs/b.md"), ("possible_secret", "docs/c.txt"), ("env_file", "docs/.env"), ("raw_pdf", "docs/d.pdf"), ("huge_file", "docs/big.txt")} <= found


def test_run_readers(spark, tmp_path):
    run = str(tmp_path)
    for g in (0, 1):
        runs.write_json(f"{run}/evolution/generation_{g:03d}.json", {"generation": g, "population": [{"candidate_id": "c", "fitness": float(g)}, {"candidate_id": f"d{g}", "fitness": 0.5}]})
        runs.write_json(f"{run}/shard_{g}/status.json", {"extracted": 3 + g, "malformed": 1})
    assert {r.candidate_id: r.fitness for r in runs.generations(spark, run).collect()} == {"c": 1.0, "d0": 0.5, "d1": 0.5}
    assert runs.shard_status(spark, run).first()[:3] == (2, 7, 2)
    runs.write_json(f"{run}/selected_papers.json", [{"id": "7", "title": " T ", "summary": "s", "published": "2001-02"}, {"title": ""}])
    assert [tuple(r) for r in runs.selected_papers(spark, run).collect()] == [("7", "T", "s", "2001")]
    with pytest.raises(PermissionError):
        runs.guarded("x/final/final_report.md")
    for d in ("bandits", "other"):
        for n in runs.PACKET:
            (tmp_path / "p" / d).mkdir(parents=True, exist_ok=True)
            (tmp_path / "p" / d / n).write_text("")
    assert [p.split("/")[-1] for p in runs.packets(f"{run}/p", ["bandits"])] == ["bandits"] and len(runs.packets(f"{run}/p")) == 2
    texts = spark.createDataFrame([("a", "word " * 400), ("b", " ")], "paper_id string, text string")
    records = spark.createDataFrame([("a", "A", "x"), ("b", "B", "about b"), ("c", "C", "")], "paper_id string, title string, abstract string")
    got = runs.chunk_table(texts, records).groupBy("paper_id").count().collect()
    assert {r.paper_id: r["count"] for r in got} == {"a": 2, "b": 1}
    assert runs.forbidden_keys({"a": {"b": 1, "c": {"b": 2}}, "b": 0}, ("b",)) == ["a.b", "a.c.b", "b"]
    times = spark.createDataFrame([("x", "2024-01-01 00:00:00", "start"), ("x", "2024-01-01 00:00:05", "end")], "stage string, t string, kind string").withColumn("ts", F.to_timestamp("t"))
    assert runs.stage_times(times, F.col("kind") == "start", F.col("kind") == "end").first().seconds == 5.0


def test_sources_by_plug_in(spark):
    def search(query, limit):
        if query == "bad":
            raise OSError("down")
        return [{"paperId": f"{query}{i}", "title": f"T {query} {i}"} for i in range(5)]

    rows = connectors.searched(spark, search, ["a", "bad", "b"], 3)
    assert rows.where("error IS NOT NULL").select("query", "error").collect() == [("bad", "OSError: down")]
    assert {r.paper_id for r in connectors.semantic_scholar(rows.where("error IS NULL")).collect()} == {f"s2:{q}{i}" for q in "ab" for i in range(3)}


def test_other_connectors(spark):
    entry = {"id": "http://arxiv.org/abs/2401.1v2", "title": "A\n  B", "summary": "s", "authors": ["X"], "categories": ["cs.LG"], "published": "2024-01-02"}
    got = connectors.arxiv(spark.createDataFrame([(json.dumps(entry), "q")], "body string, query string")).first()
    assert (got.paper_id, got.title, got.year, got.categories) == ("arxiv:2401.1", "A B", 2024, ["cs.LG"])
    note = lambda i, t, a: json.dumps({"id": i, "content": {"title": {"value": t}, "abstract": {"value": a}}})
    rows = [(note("n1", "Robust arms", ""), "q1"), (note("n1", "Robust arms", ""), "q2"), (note("n2", "x", "robust drift"), "q1"), (note("n3", "x", "robust"), "q1"), ("broken", "q1")]
    got = {r.paper_id: r.retrieval_queries for r in connectors.openreview(spark.createDataFrame(rows, "body string, query string"), ["robust", "drift"]).collect()}
    assert got == {"openreview:n1": ["q1", "q2"], "openreview:n2": ["q1"]}
    assert connectors.venues("custom", ["iclr"])[0] == ("ICLR 2025", "ICLR.cc/2025/Conference") and connectors.venues("custom", ["none"]) == [("none", "none")] and len(connectors.venues("a_star")) == 24


def test_retrieval_run(spark):
    s = retrieval_run.Search("Robust bandits for the drift", "theory", max_raw=4)
    assert retrieval_run.expanded(s) == [s.text, f"{s.text} theoretical analysis", f"{s.text} mechanism understanding", f"{s.text} survey overview"]
    assert retrieval_run.fielded(["a"], ["cs.LG"]) == '(ti:"a" OR abs:"a") AND (cat:cs.LG)'
    one = spark.createDataFrame([('"exact one" deep learning theory', "Robust bandits for the drift", "ti:x", "")], "a string, b string, c string, d string").select(
        search_plans.fielded("a", ["deep learning", "learning"]).alias("qa"), search_plans.phrases("b").alias("qb"), search_plans.fielded("c", []).alias("qc"), search_plans.fielded("b", []).alias("qw"), search_plans.phrases("d").alias("qd"),
    ).first()
    assert one.qa == '(ti:"exact one" OR abs:"exact one") AND (ti:"deep learning" OR abs:"deep learning")' and one.qb == ["robust bandits drift", "robust", "bandits", "drift"] and one.qc == "ti:x" and one.qd == []
    assert one.qw == "((ti:robust OR abs:robust) OR (ti:bandits OR abs:bandits) OR (ti:drift OR abs:drift))"
    rows = [(q, "a" if i % 2 else "b", 10 * q + i, f"Robust bandits {i}" if q == 0 else f"Other {i}", "drift " * 3, f"10.1/{i}" if q < 2 else "", "", [], 1, 5, False) for q in range(3) for i in range(2)]
    df = spark.createDataFrame(rows, "query int, source string, id long, title string, abstract string, doi string, arxiv string, fields array<string>, sources int, citations int, is_preprint boolean")
    best, text = retrieval_run.run(df, s)
    assert [r.id for r in best.orderBy("rank").collect()] == [0, 1] and "- raw: 4" in text and "- deduplicated: 2" in text


def test_report_and_csv(spark, tmp_path):
    got = sinks.family_report([{"tier": 1, "family_title": "One <b>", "caveats": "None.", "supporting_papers": ["p"]}])
    assert "### One <b>" in got["final_report.md"] and "One &lt;b&gt;" in got["final_report.html"] and "A_STRONG" not in got["final_report.md"]
    a, b = spark.createDataFrame([(1, [1])], "x long, y array<long>"), spark.createDataFrame([(2, "z")], "x long, w string")
    sinks.union_csv([a, b], str(tmp_path / "c"))
    assert readers.csv_table(spark, str(tmp_path / "c")).columns == ["x", "y", "w"]
    assert formulations.low_signal_reason({"verification_passed_gaps": 2, "verification_reviewed_gaps": 3, "direct": 0}) == "no_direct_formulations" and formulations.low_signal_reason({"families": 1}) is None


def greedy_twin(rows, limit, per_source, share):
    chosen = []
    key = lambda r: ({"STRONG": 0, "MODEST": 1}.get(r["label"], 2), -r["ni"], r["risk"], r["id"])
    while len(chosen) < limit:
        open_ = sorted((r for r in rows if r not in chosen and r["title"].lower() not in {c["title"].lower() for c in chosen} and sum(c["source"] == r["source"] for c in chosen) < per_source), key=key)
        if not open_:
            break
        pick, used = open_[0], sum(c["kind"] == "impossibility_boundary" for c in chosen)
        if pick["kind"] == "impossibility_boundary" and used + 1 > int(share * (len(chosen) + 1)):
            pick = next((r for r in open_ if r["kind"] != "impossibility_boundary" and key(r)[0] <= key(pick)[0] and r["ni"] >= pick["ni"] - 0.10), pick)
        chosen.append(pick)
    return [r["id"] for r in sorted(chosen, key=key)]


def test_soft_caps_equal_plain_greedy(spark):
    r = random.Random(4)
    for n, titles in ((60, 5), (200, 90), (90, 1)):
        rows = [{"id": i, "title": f"T{r.randrange(titles)}", "source": f"s{r.randrange(2 if titles == 1 else 9)}", "kind": r.choice(["impossibility_boundary", "m"]), "label": r.choice(["STRONG", "MODEST", "x"]), "ni": round(r.random(), 2), "risk": round(r.random(), 2)} for i in range(n)]
        df = spark.createDataFrame([tuple(x.values()) for x in rows], "id long, title string, source string, kind string, label string, ni double, risk double")
        assert [x.id for x in selection.soft_capped(df, 6).orderBy("position").collect()] == greedy_twin(rows, 6, 2, 0.4)
    assert selection.soft_capped(df.withColumn("title", F.lit(None).cast("string")), 3).count() == 3


def test_finals_equal_plain_greedy(spark):
    r = random.Random(5)
    rows = [(i, round(r.random(), 3), [r.choice("abcdefgh") for _ in range(4)] if i % 9 else None, f"o{r.randrange(6)}", f"c{r.randrange(4)}", r.random() < 0.5) for i in range(80)]
    got = [x.id for x in selection.diverse_finals(spark.createDataFrame(rows, "id long, fitness double, tokens array<string>, origin string, cluster string, combined boolean"), 8).orderBy("position").collect()]
    left, chosen = sorted(rows, key=lambda x: (-x[1], x[0])), []
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    while left and len(chosen) < 8:
        best = max(left, key=lambda x: (round(x[1] - 0.35 * max((like(set(x[2] or []), set(c[2] or [])) for c in chosen), default=0.0), 12), x[1], -x[0]))
        left.remove(best)
        if sum(c[3] == best[3] for c in chosen) < 2 and sum(c[4] == best[4] for c in chosen) < 3 and not (best[5] and sum(c[5] for c in chosen) >= 2):
            chosen.append(best)
    assert got == [c[0] for c in chosen]


def test_reviewed_finals(spark):
    rows = [(i, True, "KEEP", "open", ["p"], 1 - i / 100, 0.5, 0.5, 0.5, 0.5, f"s{i // 2}", f"o{i % 7}", f"statement number{'abcdefghij'[i % 3]} shared") for i in range(60)]
    schema = "id long, acceptable boolean, review_label string, counterevidence_status string, supporting_papers array<string>, deep_review_score double, evidence_strength double, remaining_gap_realness double, project_concreteness double, feasibility double, origin_signature string, primary_origin_signature string, problem_statement string"
    out, status = selection.reviewed_finals(spark.createDataFrame(rows, schema), 10)
    got, sigs, prim, theme = [], set(), {}, {}
    for x in rows:
        key = x[12].split()[1]
        if len(got) < 10 and x[10] not in sigs and prim.get(x[11], 0) < 2 and theme.get(key, 0) < 4:
            got.append(x[0])
            sigs.add(x[10])
            prim[x[11]], theme[key] = prim.get(x[11], 0) + 1, theme.get(key, 0) + 1
    assert [r.id for r in out.orderBy("position").collect()] == got and status == ("REVIEWED_REPORT_READY" if len(got) >= 10 else "INSUFFICIENT_MEANINGFUL_HYPOTHESES")


def test_evenly_spaced(spark):
    rows = spark.range(3000).select(F.col("id"))
    a = {r.id for r in selection.evenly_spaced(rows, 25, 1).collect()}
    assert len(a) == 25 and a == {r.id for r in selection.evenly_spaced(rows.repartition(7), 25, 1).collect()} and a != {r.id for r in selection.evenly_spaced(rows, 25, 2).collect()}


def test_generations(spark):
    gaps = [(f"g{i}", f"Gap {'abcdefgh'[i]} fails in condition{i} badly", f"target{i}", "s", "insufficient evidence", f"m{i % 3}", ["p"] * (i % 3), 0.5, 0.5, 0.5, 0.5, None if i % 2 else 0.4 + i / 20, 0.6, 3.0, 2.0) for i in range(8)]
    schema = "gap_id string, gap string, target string, scope string, mechanism string, motif_type string, paper_ids array<string>, novelty double, feasibility double, impact double, specificity double, survival double, overall double, evidence double, trace double"
    df = spark.createDataFrame(gaps, schema)
    first = evolution.seeds(df, 10, 2)
    assert first.count() == 10 and first.where("variant = 0").select("gap_id").distinct().count() >= 5
    history = evolution.evolved(first.drop("parents", "generation"), 2, 6)
    assert [len(h) for h in history][0] == 6 and all(h[0]["fitness"] >= h[-1]["fitness"] for h in history) and history == evolution.evolved(first.drop("parents", "generation"), 2, 6)
    for h in history[1:]:
        assert not any(evolution.is_duplicate(a, [b]) for a, b in itertools.combinations(h, 2)) or len(h) == 1
    assert [r.motif_type for r in evolution.interleaved(df, 3, 1).collect()] == ["m0", "m1", "m2"]


def test_merge_rules_by_similarity(spark):
    """Rules D and E against difflib on all pairs."""
    import difflib

    r = random.Random(9)
    words = "thompson clustering heavy-tailed expert privacy kernel graph latent auction federated".split()
    rows = [(i, f"s{i}", "", [f"p{i}"], " ".join(r.choices(words, k=3)), " ".join(r.choices(words, k=2)), " ".join(r.choices(words, k=4)), " ".join(r.choices(words, k=9))) for i in range(30)]
    rows += [(30, "s30", "", ["p30"], *rows[0][4:6], rows[0][6] + "s", "x"), (31, "s31", "", ["p31"], "thompson expert kernel", "thompson expert kernel", "zzz", "y"), (32, "s32", "", ["p32"], "thompson expert kernel", "thompson expert kernels", "qqq", "w")]
    df = spark.createDataFrame(rows, "variant_id long, source_formulation_id string, source_verified_gap_id string, supporting_papers array<string>, core_setting string, broader_problem_class string, title string, problem_statement string")
    got = {(x.a, x.b): x.rule[0] for x in formulations.merge_edges(df).collect()}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    ident = lambda x: {w for k in (4, 5, 6) for w in x[k].split() if len(w) > 2}
    want = {}
    for a, b in itertools.combinations(rows, 2):
        share = lambda k: set(a[k].split()) & set(b[k].split())  # noqa: B023, E731
        if (share(6) or share(7) or set(a[6].split()) & set(b[7].split()) or set(a[7].split()) & set(b[6].split())) and max(ratio(a[6], b[6]), ratio(a[7], b[7])) >= 0.72:
            want[a[0], b[0]] = "D"
        elif ratio(a[5], b[5]) >= 0.85 and len(ident(a) & ident(b)) >= 3:
            want[a[0], b[0]] = "E"
    assert got == want and {"D", "E"} <= set(want.values())
