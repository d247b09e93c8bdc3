"""The top-k join of gaps and records against brute force, and how few pairs it scores when one token is everywhere."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lacuna.operators import counterevidence, topk


def brute(gaps, records, frequent, minimum, k):
    out = set()
    for g, gp, gt in gaps:
        own = []
        for r, rp, rt in records:
            common, every = set(gt) & set(rt), set(gt) | set(rt)
            if not common:
                continue
            score = min(1.0, len(common) / len(every) + (-0.1 if gp == rp else 0.1) + (0.1 if len(common & frequent) >= 2 else 0))
            if round(score, 6) >= minimum:
                own.append((-round(score, 6), r))
        out |= {(g, r, -s) for s, r in sorted(own)[:k]}
    return out


@pytest.mark.parametrize(("seed", "k", "share"), [(1, 20, 20_000), (2, 3, 10), (3, 1, 4)])
def test_candidates_equal_brute_force(spark, monkeypatch, seed, k, share):
    monkeypatch.setattr(topk, "SHARE", share)
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    some = lambda: list(dict.fromkeys(["every", *(words[min(39, int(r.expovariate(0.12)))] for _ in range(r.randint(0, 12)))]))
    gaps = [(i, f"p{r.randint(0, 9)}", some()) for i in range(40)] + [(90, "p1", [])]
    records = [(i, f"p{r.randint(0, 9)}", some()) for i in range(120)] + [(900, "p1", []), (901, "p2", ["every"])]
    frequent = {"every", "w0", "w1", "w2"}
    got = counterevidence.candidates(
        spark.createDataFrame(gaps, "gap_id long, paper_id string, tokens array<string>"), spark.createDataFrame(records, "record_id long, paper_id string, tokens array<string>"),
        spark.createDataFrame([(t,) for t in sorted(frequent)], "t string"), 0.2, k,
    )
    assert {(x.gap_id, x.record_id, x.score) for x in got.collect()} == brute(gaps, records, frequent, 0.2, k)


def test_everywhere_token_is_not_scored(spark):
    """Each gap has its own two good records; all share one token: a few pairs a gap are scored, not all."""
    n = 300
    token = lambda x: F.concat(F.lit(x), "id")
    gaps = spark.range(n).select(F.col("id").alias("a"), F.array(F.lit("every"), *[token(x) for x in "abcdefg"]).alias("tokens"))
    records = spark.range(n).select((F.col("id") + 1000).alias("b"), F.array(F.lit("every"), *[token(x) for x in "abcdefh"]).alias("tokens"))
    seen = []

    def score(pairs):
        seen.append(pairs.count())
        return pairs.withColumn("score", F.when(F.col("b") == F.col("a") + 1000, 0.8).otherwise(0.1))

    left, right = topk.places(gaps, records)
    found = topk.rising(left, right, score, lambda o: F.lit(0.1), (0.5, 0.2), 1)
    assert sum(seen) == n and found.where("score > 0.5").count() == n
