"""Exact nearest vectors against brute force, and what the balls skip."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import vectors

SCHEMA = "id long, vector array<double>"


def brute(v, ids, k):
    s = vectors._units(v @ v.T)
    np.fill_diagonal(s, -np.inf)
    return {int(i): [int(ids[j]) for j in np.lexsort((ids, -s[a]))[:k] if s[a, j] > -np.inf] for a, i in enumerate(ids)}


def found(spark, v, ids, k):
    rows = spark.createDataFrame([(int(i), [float(c) for c in x]) for i, x in zip(ids, v, strict=True)], SCHEMA)
    got, met = {}, {}
    for r in vectors.nearest_met(rows, k).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
        met[r.id] = r.met
    return got, met


def made(kind, n, r):
    if kind == "clusters":
        return np.repeat(r.normal(size=(40, 24)) * 3, n // 40, axis=0) + r.normal(size=(n, 24)) * 0.05
    if kind == "random":
        return r.normal(size=(n, 24))
    if kind == "copies":  # a third of all vectors are the same
        v = r.normal(size=(n, 24))
        v[r.random(n) < 0.34] = v[0]
        return v
    return r.normal(size=(n, 24)) * np.exp(r.normal(size=(n, 1)) * 2)  # norms of very different sizes


@pytest.mark.parametrize("kind", ["clusters", "random", "copies", "norms"])
def test_nearest_equals_brute_force(spark, kind):
    r = np.random.default_rng(5)
    n = 2000
    v, ids = made(kind, n, r), r.permutation(n) * 7 - 500
    got, met = found(spark, v, ids, 5)
    assert got == brute(v, ids, 5)
    share = sum(met.values()) / n / n
    print(kind, round(share, 3))
    if kind == "clusters":
        assert share < 0.3
    assert share <= 1


@pytest.mark.parametrize("n,k", [(1, 3), (2, 3), (7, 10), (130, 200)])
def test_few_vectors(spark, n, k):
    r = np.random.default_rng(n)
    v, ids = r.normal(size=(n, 3)), np.arange(n)
    want = {i: x for i, x in brute(v, ids, k).items() if x}
    assert found(spark, v, ids, k)[0] == want


def test_nearest_defined_cases(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [0.0, 0.0])], SCHEMA)
    assert sorted(map(tuple, vectors.nearest(rows, 1).collect())) == [(1, 3, 1), (3, 1, 1), (4, 1, 1)]
    assert vectors.nearest(rows.where("id > 9"), 2).count() == 0
    odd = rows.unionByName(spark.createDataFrame([(7, [float("nan"), 0.0]), (8, [float("inf"), 0.0]), (9, [None, 1.0])], SCHEMA))
    assert sorted(map(tuple, vectors.nearest(odd, 1).collect())) == [(1, 3, 1), (3, 1, 1), (4, 1, 1)]
    twice = rows.where("id = 1").withColumn("id", F.explode(F.array(F.lit(5), F.lit(6)))).withColumn("noise", F.lit("x"))
    assert sorted(map(tuple, vectors.nearest(twice, 2).collect())) == [(5, 6, 1), (6, 5, 1)]
