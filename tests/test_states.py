"""Upserts against rebuilds, merged records, patterns in texts, and the lazy selection."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import patterns, records, retrieval, upserts


def test_base_and_deltas_equal_a_rebuild(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"n{r.randint(0, 30)}", r.choice("AB"), f"l{r.randint(0, 3)}", f"p{r.randint(0, 6)}", r.choice(["e", "f", None]), f"{i:05d}") for i in range(400)]
    df = spark.createDataFrame(rows, "id string, type string, label string, paper_id string, evidence string, seq string")
    one, many = upserts.State(spark, str(tmp_path / "one"), 8), upserts.State(spark, str(tmp_path / "many"), 8)
    one.upsert_nodes(df)
    assert many.nodes().count() == 0 and many.upsert_nodes(df.limit(0)) == 0
    for part in ("seq >= '00300'", "seq < '00100'", "seq BETWEEN '00100' AND '00299'", "seq < '00050'"):
        many.upsert_nodes(df.where(part))
    got, want = ({x.id: x for x in s.nodes().collect()} for s in (many, one))
    assert got == want
    for i in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == i]
        assert (want[i].type, want[i].label) == own[0][1:3] and want[i].paper_ids == list(dict.fromkeys(x[3] for x in own)) and [e.text for e in want[i].evidence] == [x[4] for x in own]


def test_only_touched_buckets_are_written(spark, tmp_path):
    state = upserts.State(spark, str(tmp_path / "g"), 32)
    edge = lambda n, c, s: spark.range(n).select(F.concat(F.lit("s"), "id").alias("source"), F.lit("t").alias("target"), F.lit("r").alias("relation"), F.lit("p").alias("paper_id"), F.lit("e").alias("evidence"), F.lit(c).alias("confidence"), F.lit(s).alias("seq"))
    assert state.upsert_edges(edge(500, 0.5, "2")) == 32
    assert state.upsert_edges(edge(1, 0.9, "3")) == 1 and state.upsert_edges(edge(1, 0.1, "1")) == 1  # a late row changes nothing
    assert state.edges().count() == 500 and [x.confidence for x in state.edges().where("source = 's0'").collect()] == [0.9]
    assert sum(1 for _ in (tmp_path / "g/edges/version=1").glob("bucket=*")) == 1


def test_records_merge_by_field(spark):
    schema = "component int, place int, paper_id string, title string, abstract string, doi string, venue string, citation_count int, source_names array<string>, source_ids map<string,string>"
    rows = [(1, 2, "b", "B", "longer", "d2", "", None, ["y"], {"k": "2", "m": "x"}), (1, 1, "a", "A", "same", "", None, 0, ["z", "x"], {"k": "1"}), (1, 3, "c", "C", "longer"[::-1], "d3", "V", 7, None, None), (2, 1, "e", None, None, None, None, None, None, None)]
    got = {x.component: x for x in records.merged_records(spark.createDataFrame(rows, schema)).collect()}
    x = got[1]
    assert (x.n, x.paper_id, x.title, x.abstract, x.doi, x.venue, x.citation_count, x.source_names, x.source_ids) == (3, "a", "A", "longer", "d2", "V", 7, ["x", "y", "z"], {"k": "2", "m": "x"})
    assert (got[2].paper_id, got[2].title, got[2].abstract, got[2].citation_count, got[2].source_ids) == ("e", None, "", None, None)


@pytest.mark.parametrize("group", [1, 3, 20_000])
def test_first_places(spark, group):
    r = random.Random(group)
    text = lambda n: "".join(r.choice("abé ") for _ in range(n))
    found = [(k, text(r.randint(0, 3))) for k in range(5) for _ in range(3)] + [(9, "zzz")]
    texts = [(i, text(r.randint(0, 40))) for i in range(60)] + [(99, None), (100, "")]
    got = patterns.first_places(spark.createDataFrame(found, "key int, pattern string"), spark.createDataFrame(texts, "id int, text string"), group)
    want = {}
    for k, p in found:
        for i, t in texts:
            if p and t and p in t:
                want[k, i] = min(want.get((k, i), 999), t.index(p) + 1)
    assert {(x.key, x.id): x.place for x in got.collect()} == want and got.count() == len(want)
    one = patterns.snippets(spark.createDataFrame([(1, "Needle")], "key int, pattern string"), spark.createDataFrame([(5, "x" * 50 + "a NEEDLE here" + "y" * 50)], "id int, text string"), 20).first()
    assert one.place == 53 and one.snippet == ("x" * 50 + "a NEEDLE here" + "y" * 50)[42:62]


def test_lazy_selection_equals_brute_force(spark):
    r = np.random.default_rng(4)
    n, k = 600, 12
    v, score = r.normal(size=(n, 6)) + 1.0, np.round(r.random(n), 2)
    v[100:110] = v[5]
    rows = spark.createDataFrame([(i, float(score[i]), v[i].tolist()) for i in range(n)], "id int, score double, embedding array<double>")
    seen: list[int] = []
    got = [x.id for x in retrieval.mmr(rows, k, 0.75, 60, seen).orderBy("position").collect()]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    rel, want = (score - score.min()) / (score.max() - score.min()), []
    for _ in range(k):
        value = 0.75 * rel - (0.25 * np.max([(u * u[c]).sum(axis=1) for c in want], axis=0) if want else 0)
        want.append(min((i for i in range(n) if i not in want), key=lambda i: (-round(value[i], 12), -score[i], i)))
    assert got == want and len(seen) == k and sum(seen) < 60 * k / 2


def test_a_node_of_many_facts_is_not_compared_with_itself(spark, tmp_path):
    import time

    state, began, n = upserts.State(spark, str(tmp_path / "hub"), 4), time.time(), 60_000
    rows = spark.range(n).select(F.lit("hub").alias("id"), F.lit("t").alias("type"), F.lit("l").alias("label"), F.concat(F.lit("p"), F.col("id") % 3).alias("paper_id"), F.col("id").cast("string").alias("evidence"), F.lpad(F.col("id").cast("string"), 9, "0").alias("seq"))
    state.upsert_nodes(rows.where("seq >= '000010000'"))
    state.upsert_nodes(rows.where("seq < '000020000'"))
    got = state.nodes().select("paper_ids", F.size("evidence").alias("n"), F.col("evidence")[n - 1]["text"].alias("last")).collect()
    assert [(r.paper_ids, r.n, r.last) for r in got] == [(["p0", "p1", "p2"], n, str(n - 1))] and time.time() - began < 60
