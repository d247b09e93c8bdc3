"""The commands over run folders: examples, corpora, mock runs, extraction checks, graph, gaps, verification gate, reports, audits."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import extraction, gaps, gates, graph, model_stages, motifs
from lacuna.sources import readers, runs, sinks

Session = Callable[[], SparkSession]


def init_example(args, session: Session) -> int:
    """A folder with a configuration, a manifest and three short texts."""
    base = Path(args.folder)
    base.mkdir(parents=True, exist_ok=True)
    runs.write_json(base / "config.json", {"output_root": str(base / "out"), "llm": {"mock": True, "model": "mock", "base_url": "none"}, "corpus": {"manifest_path": "papers.jsonl"}})
    rows = []
    for n, topic in enumerate(("calibration under shift", "memory limits", "feedback frequency"), 1):
        (base / f"toy-{n:03d}.txt").write_text(f"Introduction\nWe study {topic} in a toy setting. The method is limited by small distribution shifts.\n", encoding="utf-8")
        rows.append({"paper_id": f"toy-{n:03d}", "title": f"Toy study of {topic}", "authors": ["A. Author"], "year": 2024, "source": "synthetic_example", "text_path": f"toy-{n:03d}.txt"})
    runs.write_lines(base / "papers.jsonl", rows)
    print(base)
    return 0


def _manifest(path: str) -> str:
    """The manifest that a configuration names, beside it unless its path is absolute."""
    from lacuna import config

    settings = config.load([path])
    corpus = settings.get("corpus") if isinstance(settings.get("corpus"), dict) else {}
    return str(Path(path).resolve().parent / str(corpus.get("manifest_path") or settings.get("papers_manifest") or settings.get("papers_jsonl") or "papers.jsonl"))


def smoke_test(args, session: Session) -> int:
    """A configuration's corpus through the stages that need no language model: texts, sections, tuples by pattern and their check."""
    spark = session()
    runs.prepared(spark, _manifest(args.config), args.run)
    parse_papers(args, session)
    found = model_stages.extracted(_texts(spark, args.run), model_stages.by_pattern)
    sinks.json_lines(found.select("t.*"), f"{args.run}/extracted/all_tuples.jsonl")
    extract(args, session)
    print(runs.summary_text(runs.summarize(spark, args.run)))
    return 0


def prepare(args, session: Session) -> int:
    if "${" in args.out:
        raise ValueError("the output folder uses a placeholder")
    run = f"{args.out}/runs/{time.strftime('local_corpus_%Y%m%d_%H%M%S')}"
    runs.prepared(session(), _manifest(args.config), run)
    print(run)
    return 0


def summarize(args, session: Session) -> int:
    print(runs.summary_text(runs.summarize(session(), args.run)))
    return 0


def parse_papers(args, session: Session) -> int:
    """Sections of the run's texts; a text that cannot be read has that as its status and stops nothing."""
    from lacuna.operators.retrieval import sections

    spark = session()
    listed = runs.parsed(spark, args.run)
    paths = [r["text_path"] for r in listed.select("text_path").collect() if r["text_path"] and Path(r["text_path"]).exists()]  # a run's manifest
    texts = readers.whole_texts(spark, paths) if paths else spark.createDataFrame([], "path string, text string")
    named = texts.withColumn("k", F.element_at(F.split("path", "/"), -1)).join(listed.select("paper_id", F.element_at(F.split("text_path", "/"), -1).alias("k")), "k")
    found = sections(named.select(F.col("paper_id").alias("id"), "text"))
    found.write.mode("overwrite").parquet(f"{args.run}/parsed/sections")
    status = listed.join(named.select("paper_id", F.length("text").alias("chars")), "paper_id", "left").select("paper_id", F.when(F.col("chars").isNull(), "missing").when(F.col("chars") < 200, "short").otherwise("ok").alias("status"))
    sinks.json_lines(status, f"{args.run}/parsed/status")
    return 0


def _texts(spark: SparkSession, run: str) -> DataFrame:
    listed = runs.parsed(spark, run)
    paths = [r["text_path"] for r in listed.select("text_path").collect() if r["text_path"] and Path(r["text_path"]).exists()]
    texts = readers.whole_texts(spark, paths) if paths else spark.createDataFrame([], "path string, text string")
    return texts.withColumn("k", F.element_at(F.split("path", "/"), -1)).join(listed.select("paper_id", F.element_at(F.split("text_path", "/"), -1).alias("k")), "k").select("paper_id", "text")


def extract(args, session: Session) -> int:
    """Checks the run's raw tuples against its texts; valid ones and dropped ones, with their reasons, are written apart."""
    spark = session()
    rows = extraction.coerced(runs.tuples(spark, args.run).fillna("", ["polarity"]))
    checked = extraction.validated(rows, _texts(spark, args.run))
    sinks.json_lines(checked.where("drop_reason IS NULL").drop("drop_reason"), f"{args.run}/extracted/valid_tuples")
    sinks.json_lines(checked.where("drop_reason IS NOT NULL"), f"{args.run}/extracted/dropped_tuples")
    print(json.dumps({r["drop_reason"] or "valid": r["n"] for r in checked.groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n")).collect()}))
    return 0


def run_graph(spark: SparkSession, run: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a run's tuples and listed entities."""
    rows = runs.tuples(spark, run).select("paper_id", "subject", "relation", "object", F.coalesce("evidence_text", F.lit("")).alias("evidence"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), "claim_type")
    rows = rows.withColumn("seq", F.sha1(F.to_json(F.struct(*rows.columns))))
    lists = {"claims": "Claim", "limitations": "Limitation", "failure_conditions": "FailureCondition", "assumptions": "Assumption", "tasks": "Task"}
    found = runs.extractions(spark, run)
    listed = None
    for c, t in lists.items():
        part = found.select("paper_id", F.lit(t).alias("type"), F.explode(c).alias("label"))
        listed = part if listed is None else listed.unionByName(part)
    return graph.build(rows, listed)


def build_graph(args, session: Session) -> int:
    """The graph of a run folder, or of a folder of tables in the claims' roles."""
    spark = session()
    if (Path(args.run) / "extracted").exists():
        sinks.graph(*run_graph(spark, args.run), args.out)
        return 0
    from lacuna.plans.views import evidence_graph

    sinks.graph(*evidence_graph(spark, args.run), args.out)
    return 0


def detect_gaps(args, session: Session) -> int:
    spark = session()
    hits = motifs.all_motifs(*run_graph(spark, args.run))
    sinks.json_lines(hits, f"{args.run}/gaps/motif_hits")
    sinks.json_lines(gaps.gap_rows(hits), f"{args.run}/gaps/gap_rows")
    return 0


def verify_gaps(args, session: Session) -> int:
    """Decisions of the gate over the run's agents' outputs, as JSON lines and CSV."""
    spark = session()
    rows = gates.agent_rows(*runs.agent_sources(spark, args.run))
    path = f"{args.run}/verification/gap_survival_scores.csv"
    scores = readers.scores_csv(spark, path, "gap_id", "gap_survival_score") if Path(path).exists() else spark.createDataFrame([], "gap_id string, gap_survival_score double")
    decisions = gates.assessed(rows, scores, spark.createDataFrame([], "gap_id string, parse_failures string"), gates.Gate(require_all_agents=False, allow_reviewed_only_fallback=True))
    sinks.json_lines(decisions, f"{args.run}/verification/verification_gate/decisions")
    sinks.csv(gates.decision_table(decisions).coalesce(1), f"{args.run}/verification/verification_gate/decisions_csv")
    return 0


def report(args, session: Session) -> int:
    data = runs.read_json(f"{args.run}/stage9_family_quality/family_quality_scores.json", {"families": []})
    rows = [{"tier": f.get("tier", 3), "family_title": f.get("family_title") or f.get("title", ""), **f} for f in data["families"]]
    for name, text in sinks.family_report(rows).items():
        Path(f"{args.run}/final_family_report").mkdir(parents=True, exist_ok=True)
        Path(f"{args.run}/final_family_report/{name}").write_text(text, encoding="utf-8")
    return 0


def audit_release(args, session: Session) -> int:
    found = runs.audit(session(), args.root).orderBy("kind", "path", "reason").collect()  # findings are read by a person
    print("\n".join([f"release audit findings: {len(found)}", *(f"- {r['kind']} in {r['path']}: {r['reason']}" for r in found)]))
    return int(bool(found))


def run_all(args, session: Session) -> int:
    """The smoke test and, over its folder, the stages that follow."""
    smoke_test(args, session)
    for step in (detect_gaps, verify_gaps, report):
        step(args, session)
    return 0


COMMANDS = {
    "init-example": init_example, "smoke-test": smoke_test, "prepare-local-corpus": prepare, "summarize-run": summarize, "parse-papers": parse_papers, "extract": extract, "build-graph": build_graph,
    "detect-gaps": detect_gaps, "verify-gaps": verify_gaps, "report": report, "audit-release": audit_release, "run-all": run_all,
}
