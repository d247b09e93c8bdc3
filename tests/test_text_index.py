"""The BM25 index against the scan, and how many blocks it reads."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lacuna.operators import retrieval, text_index
from lacuna.plans import catalogue


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    text = lambda: " ".join(["Common", *(words[min(299, int(r.expovariate(0.02)))] for _ in range(r.randint(0, 60)))])
    rows = [(i // 5, i % 5, text()) for i in range(600)] + [(200, 0, ""), (200, 1, None), (201, 0, "word1 word1 word1"), (201, 1, "word1 word1 word1")]
    return spark.createDataFrame(rows, "paper_id long, chunk_id long, text string").cache()


@pytest.mark.parametrize(("block", "k"), [(128, 10), (4, 10), (1, 3), (7, 700)])
def test_search_equals_scan(spark, chunks, block, k):
    asked = {1: "common word1 word250", 2: "Word3 word3 word7 nowhere", 3: "word299 word298", 4: "nowhere at all", 5: "", 6: "common"}
    index = text_index.Index.build(chunks, block=block)
    found = index.search(spark.createDataFrame(list(asked.items()), "qid long, text string"), k)
    got = {}
    for x in found.collect():
        got.setdefault(x.qid, []).append((-x.score, x.paper_id, x.chunk_id))
    for q, text in asked.items():
        want = brute(chunks, text, k)
        assert sorted(got[q]) == [(pytest.approx(-s, abs=1e-6), p, c) for s, p, c in want]
    scan = {(x.paper_id, x.chunk_id): x.score for x in retrieval.bm25(chunks, asked[2], k).collect()}
    assert scan == {(p, c): pytest.approx(-s, abs=2e-6) for s, p, c in got[2]}


def brute(chunks, text, k):
    rows = [(x.paper_id, x.chunk_id, re.findall("[a-z0-9]{3,}", (x.text or "").lower())) for x in chunks.collect()]
    asked, n, mean = re.findall("[a-z0-9]{3,}", text.lower()), len(rows), sum(len(w) for _, _, w in rows) / len(rows)
    df = {t: sum(t in w for _, _, w in rows) for t in asked}
    scored = []
    for p, c, w in rows:
        s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in asked)
        if s > 0:
            scored.append((round(s, 9), p, c))
    few, seen = [], {}
    for s, p, c in sorted(scored, key=lambda x: (-x[0], x[2])):
        seen[p] = seen.get(p, 0) + 1
        if seen[p] <= 3:
            few.append((s, p, c))
    if not any(df.values()):
        return [(1 / i, p, c) for i, (p, c) in enumerate(sorted(x[:2] for x in rows)[:k], 1)]
    return sorted(few, key=lambda x: (-x[0], x[1], x[2]))[:k]


def test_blocks_are_skipped(spark):
    """A word in every chunk beside a rare one: the common word's blocks are not read."""
    chunks = spark.range(4000).select(
        F.col("id").alias("paper_id"), F.lit(0).cast("long").alias("chunk_id"), F.concat(F.lit("everywhere "), F.when(F.col("id") % 100 == 0, "seldom seldom").otherwise("filler"), F.lit(" "), F.sha1(F.col("id").cast("string"))).alias("text")
    )
    index = text_index.Index.build(chunks, block=16)
    asked = index.weighted(spark.createDataFrame([(1, "everywhere seldom")], "qid long, text string"))
    read = index.candidates(asked, index.floors(asked, 5, 3))
    assert index.blocks.where("term = 'everywhere'").count() >= 250 and read.where("term = 'everywhere'").count() == 0 and read.count() <= 6
    assert index.search(spark.createDataFrame([(1, "everywhere seldom")], "qid long, text string"), 5).count() == 5
    assert text_index.Index.build(chunks.limit(0)).search(spark.createDataFrame([(1, "everywhere")], "qid long, text string"), 5).count() == 0


def test_only_asked_terms_are_posted(spark, chunks, monkeypatch):
    """An index for known queries posts their terms only, of all chunks, and answers as the whole index does."""
    asked = spark.createDataFrame([(1, "common word1 word250"), (2, "nowhere"), (3, None)], "qid long, text string")
    few, whole = text_index.Index.build(chunks, asked=asked), text_index.Index.build(chunks)
    assert {r.term for r in few.terms.collect()} == {"common", "word1", "word250"} and few.n == whole.n == 604
    assert sorted(few.search(asked, 700).collect()) == sorted(whole.search(asked, 700).collect())
    built = []
    monkeypatch.setattr(text_index.Index, "search", lambda self, queries, k: built.append(self) or queries.selectExpr("qid", "qid AS paper_id", "qid AS chunk_id", "0.0D AS score"))
    catalogue.QUERIES["bm25_many"](spark, "/root/testdata/sf0.001")
    texts = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").where("item_id % 20 = 0").collect()
    assert {r.term for r in built[0].terms.collect()} <= {w for r in texts for w in re.findall("[a-z0-9]{3,}", r.text.lower())}
