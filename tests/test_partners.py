"""Tournaments, partners across motifs and pairs within one, whatever the number of rows."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lacuna.operators import evolution


def population(spark, n, motif):
    c = F.col("id")
    return spark.range(n).select("id", motif.alias("motif_type"), (c % 7).cast("string").alias("gap_id"), *[(c % 10 / 10.0).alias(s) for s in evolution.SCORES], (c % 3 / 3.0).alias("survival"), (c / float(n)).alias("fitness"))


@pytest.mark.parametrize("n", [1, 2, 5, 4096, 4097])
def test_every_row_has_a_pair(spark, n):
    """4096 and 4097 rows follow one rule: all rows are parents, the last of an odd number with the first."""
    rows = population(spark, n, F.lit("m"))
    got = [r.parents for r in evolution.crossed(rows, 1).select("parents").collect()]
    uses = Counter(x for p in got for x in p)
    assert len(got) == (0 if n == 1 else (n + 1) // 2) and (n == 1 or set(uses) == set(range(n)))
    assert n == 1 or sorted(uses.values())[-1] == (2 if n % 2 else 1)


@pytest.mark.parametrize(("share", "left"), [(3, 0), (1, 100)])
def test_partners_are_of_other_motifs(spark, share, left):
    """Three equal motifs: all partners differ in motif.  One motif only: they differ in gap."""
    rows = population(spark, 300, (F.col("id") % share).cast("string"))
    at = {r.id: (r.motif_type, r.gap_id) for r in rows.collect()}
    pairs = [(r.a, r.b) for r in evolution.partners(rows, 2).collect()]
    assert len({a for a, _ in pairs}) == len(pairs) and all(at[a] != at[b] for a, b in pairs)
    if share > 1:
        assert len(pairs) == 300 and all(at[a][0] != at[b][0] for a, b in pairs) and len({b for _, b in pairs}) == 300


def test_tournaments_draw_fairly(spark):
    """Winners of three by lot: the r-th best of n wins with the hypergeometric probability; entrants differ; the whole population may win alone."""
    n, slots = 20, 6000
    rows = population(spark, n, F.lit("m"))
    won = Counter(r.id for r in evolution.tournaments(rows, slots, 3, 5).collect())
    assert sum(won.values()) == slots and won[0] == won[1] == 0  # the two last cannot win against two others
    for i in range(2, n):
        p = 3 * i * (i - 1) / (n * (n - 1) * (n - 2))
        assert abs(won[i] / slots - p) < 5 * (p * (1 - p) / slots) ** 0.5 + 1e-3
    assert {r.id for r in evolution.tournaments(rows, 50, 99, 5).collect()} == {n - 1}
    assert evolution.tournaments(rows.limit(0), 5, 3, 1).count() == 0
