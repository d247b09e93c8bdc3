"""PDF files, relations, verified gaps and steps that are skipped when complete."""

from __future__ import annotations

import zlib

import pytest
from pyspark.errors import PySparkException

from lacuna.sources import pdf, runs


def _file(*pages: bytes, packed: bool = True) -> bytes:
    out = b"%PDF-1.4\n"
    for i, p in enumerate(pages):
        body = zlib.compress(p) if packed else p
        out += b"%d 0 obj << /Type /Page /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >> endobj\n" % (i * 2 + 10, i * 2 + 11)
        out += b"%d 0 obj << /Length %d %s >> stream\n" % (i * 2 + 11, len(body), b"/Filter /FlateDecode" if packed else b"") + body + b"\nendstream endobj\n"
    return out + b"1 0 obj << /Type /Pages /Count 2 >> endobj\n%%EOF"


def test_streams_show_their_text():
    one = rb"BT /F1 12 Tf 72 720 Td (Regret bounds \(linear\) bandits) Tj 0 -14 Td [(Ab) -20 (stract) -300 (of)] TJ T* <414243> Tj ET"
    for packed in (True, False):
        text, pages = pdf._streams(_file(one, rb"BT (Two \101 lines) ' <FEFF00E9> Tj ET", packed=packed))
        assert pages == 2 and text == "Regret bounds (linear) bandits\nAbstract of\nABC\nTwo A linesé"
    with pytest.raises(ValueError):
        pdf._streams(b"plain")


def test_files_become_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(_file(b"BT (A title of some words) Tj T* (" + b"long " * 300 + b") Tj ET"))
    (tmp_path / "b.pdf").write_bytes(_file(b"BT (short) Tj ET"))
    (tmp_path / "c.pdf").write_bytes(b"broken")
    (tmp_path / "d.txt").write_bytes(b"none")
    got = {r["path"][-5:]: r for r in pdf.parsed(spark, str(tmp_path)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a.pdf": "ok", "b.pdf": "short_text", "c.pdf": "failed"} and got["c.pdf"]["error"] and len(got["a.pdf"]["sha256"]) == 64
    seeds = {r["title"]: r for r in pdf.seeds(spark, str(tmp_path)).collect()}
    assert set(seeds) == {"A title of some words", "b", "c"} and all(r["metadata_incomplete"] for r in seeds.values())
    cached = spark.createDataFrame([(seeds["b"]["paper_id"], "x", None), (seeds["c"]["paper_id"], None, "404")], "paper_id string, sha256 string, error string")
    states = {r["title"]: r["download_status"] for r in pdf.statuses(pdf.seeds(spark, str(tmp_path)), cached).collect()}
    assert states == {"A title of some words": "missing", "b": "cached", "c": "failed: 404"}


def test_relations_and_verified_gaps(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"paper_id": "p", "is_manual_seed_paper": true}\n\n{"other": 1}\n')
    assert [tuple(r) for r in runs.seed_relations(spark, str(good)).collect()] == [("p", True), (None, False)]
    for bad in ("[1]", "{oops", '{"is_manual_seed_paper": true}'):
        (tmp_path / "bad.jsonl").write_text(bad + "\n")
        with pytest.raises(PySparkException):
            runs.seed_relations(spark, str(tmp_path / "bad.jsonl")).collect()
    gaps = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "gap_id string, n int")
    seen = spark.createDataFrame([(" a ", None), ("a", "novel"), ("b", "Known_Solved"), ("", None)], "gap_id string, novelty_class string")
    assert [r["gap_id"] for r in runs.verified_gaps(gaps, seen).collect()] == ["a"]


def test_steps_skip_what_is_complete(tmp_path):
    ran = []

    def step(name: str, file: str, text: str):
        def go() -> None:
            ran.append(name)
            (tmp_path / name).mkdir(exist_ok=True)
            (tmp_path / name / file).write_text(text)

        return name, [file], go

    steps = [step("one", "a.jsonl", ""), step("two", "b.json", "{}"), step("three", "c.md", "text")]
    assert set(runs.run_steps(str(tmp_path), steps).values()) == {"ran"} and set(runs.run_steps(str(tmp_path), steps).values()) == {"skipped"}
    (tmp_path / "two" / "b.json").write_text("{")
    assert runs.run_steps(str(tmp_path), steps) == {"one": "skipped", "two": "ran", "three": "ran"}
    assert set(runs.run_steps(str(tmp_path), steps, force=True).values()) == {"ran"}
    with pytest.raises(RuntimeError):
        runs.run_steps(str(tmp_path), [step("four", "d.json", "")])
