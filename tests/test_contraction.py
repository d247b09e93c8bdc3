"""Components by contraction against union-find: long paths, hubs, repeats."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lacuna.operators import contraction


def united(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_union_find(spark, monkeypatch, seed):
    monkeypatch.setattr(contraction, "FEW", 0 if seed else 1000)
    r = random.Random(seed)
    nodes = list(range(200))
    links = [(r.randrange(200), r.randrange(200)) for _ in range((80, 190)[seed])] + [(5, 5), (7, 7)]
    links += [(b, a) for a, b in links[:20]]
    got = contraction.components(spark.createDataFrame([(n,) for n in nodes + nodes[:9]], "id long"), spark.createDataFrame(links, "a long, b long"))
    assert {x.id: x.component for x in got.collect()} == united(nodes, links) and got.count() == 200
    names = contraction.components(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), spark.createDataFrame([("c", "b")], "a string, b string"))
    assert {x.id: x.component for x in names.collect()} == {"a": "a", "b": "b", "c": "b"}
    assert contraction.components(spark.createDataFrame([], "id long"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_path_and_hub(spark, monkeypatch):
    """A path of 100,000 vertices in scrambled order, and a hub of 100,000: edges get fewer every round, hubs are looked up by broadcast."""
    n = 100_000
    sizes, plain = [], contraction.kept

    def watched(df, label, *partition):
        out = plain(df, label, *partition)
        if label == "edges":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(contraction, "kept", watched)
    monkeypatch.setattr(contraction, "FEW", 1000)
    name = lambda x: (x * 7919) % n  # noqa: E731  # 7919 is prime to n
    path = spark.range(n - 1).select(name(F.col("id")).alias("a"), name(F.col("id") + 1).alias("b"))
    hub = spark.range(n).select(F.lit(n).cast("long").alias("a"), (F.col("id") + n + 1).alias("b"))
    got = contraction.components(spark.range(2 * n + 2), path.unionByName(hub))
    found = {x.component: x.n for x in got.groupBy("component").agg(F.count("*").alias("n")).collect()}
    assert found == {0: n, n: n + 1, 2 * n + 1: 1}
    assert all(b < a for a, b in zip(sizes, sizes[1:], strict=False)) and sizes[-1] == 0 and len(sizes) < 20
