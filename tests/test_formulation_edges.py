"""Merge edges against a plain cascade over all pairs, with words and papers that most variants share."""

from __future__ import annotations

import difflib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lacuna.operators import formulations as fo

SCHEMA = (
    "variant_id long, source_formulation_id string, source_verified_gap_id string, supporting_papers array<string>, core_setting string, broader_problem_class string, title string, problem_statement string"
)


def brute(rows):
    ratio = lambda x, y: 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio()
    squash = lambda x: re.sub(r"\s+", " ", x).strip()
    bare = lambda x: " ".join(w for w in squash(x).lower().split(" ") if w not in (*fo.FRAMING, *fo.KINDS))
    words = lambda x: [w for w in re.findall(r"[a-z][a-z0-9\-]+", x.lower()) if len(w) > 2 and w not in fo.STOPS]
    out = set()
    for key, rule in ((1, "A_same_source_direct_formulation"), (2, "B_same_source_verified_gap")):
        for own in {r[key] for r in rows if r[key]}:
            ids = sorted(r[0] for r in rows if r[key] == own)
            out |= {(ids[0], i, rule) for i in ids[1:]}
    done = {x[:2] for x in out}
    for x, y in itertools.combinations(sorted(rows), 2):
        ident = [{w for w in (*words(r[4]), *words(r[5]), *words(r[6])) if w not in (*fo.FRAMING, *fo.KINDS)} for r in (x, y)]
        shared, papers = len(ident[0] & ident[1]), (set(x[3]), set(y[3]))
        t, s = (bare(x[6]), bare(y[6])), (bare(x[7]), bare(y[7]))
        said = [{w for w in f"{a} {b}".split(" ") if w and w not in fo.STOPS} for a, b in zip(t, s, strict=True)]
        k = [squash(r[5]).lower() for r in (x, y)]
        if all(papers) and len(papers[0] & papers[1]) / len(papers[0] | papers[1]) >= fo.PAPERS and shared >= fo.IDENTITY_C:
            rule = "C_paper_jaccard_and_identity_overlap"
        elif said[0] & said[1] and max(ratio(*t), ratio(*s)) >= fo.TITLE:
            rule = "D_title_problem_similarity"
        elif shared >= fo.IDENTITY_E and ratio(*k) >= fo.CLASS:
            rule = "E_same_problem_class_and_identity_overlap"
        else:
            continue
        if (x[0], y[0]) not in done:
            out.add((x[0], y[0], rule))
    return out


@pytest.mark.parametrize("split", [2000, 7])
def test_merge_edges_equal_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(fo, "SPLIT", split)
    r = random.Random(split)
    words = ["".join(r.choice("abcdefghijk") for _ in range(r.randint(3, 8))) for _ in range(30)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = []
    for i in range(90):
        title = rows[r.randrange(len(rows))][6] + " x" if rows and r.random() < 0.3 else f"everywhere {some(r.randint(1, 5))}"
        rows.append((i, f"s{r.randint(0, 60)}", r.choice(["", f"g{r.randint(0, 40)}"]), ["p0", *(f"p{r.randint(1, 9)}" for _ in range(r.randint(0, 4)))], some(2), r.choice([some(3), "", "one class of cases that share much", "a class of cases that share much"]), title, some(r.randint(2, 6))))
    got = {tuple(x) for x in fo.merge_edges(spark.createDataFrame(rows, SCHEMA)).select("a", "b", "rule").collect()}
    assert got == brute(rows)
    assert {x[2][0] for x in got} == set("ABCDE")


def test_pairs_of_a_common_word_stay_few(spark):
    """One word in every title: of the pairs that meet, those go on whose characters allow the ratio."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(4, 9))) for _ in range(2000)]
    df = spark.createDataFrame([(f"everywhere {' '.join(r.choice(words) for _ in range(r.randint(3, 12)))}",) for _ in range(400)], "title string")
    both = df.select(*fo.counted("title"), "title")
    a, b = (both.select([F.col(c).alias(f"{s}_{c}") for c in both.columns]) for s in "ab")
    pairs = a.join(b, (F.col("a_title") < F.col("b_title")) & fo.may_be_like("title", 0.85)).count()
    assert pairs < 400 * 399 / 2 / 3


def test_merge_edges_broadcast_no_variants(spark, tmp_path):
    from lacuna.operators import formulations

    rows = [(i, f"s{i // 2}", f"g{i // 3}", [f"p{i % 4}"], f"alpha{i % 3} beta{i % 3} delta", "kind", f"title {i % 5}", f"statement {i % 7}") for i in range(30)]
    df = spark.createDataFrame(rows, "variant_id long, source_formulation_id string, source_verified_gap_id string, supporting_papers array<string>, core_setting string, broader_problem_class string, title string, problem_statement string")
    df.write.parquet(f"{tmp_path}/v")  # a small file, whatever it is in memory
    df = spark.read.parquet(f"{tmp_path}/v")
    assert "Broadcast" not in formulations.merge_edges(df)._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_copies_are_neither_written_nor_joined_with_texts(spark, monkeypatch):
    """Sixty variants of one object are one class, so no table between the steps has as many rows as they have pairs; two more are met through a like kind, whichever comes first."""
    sizes, write = {}, fo.kept
    monkeypatch.setattr(fo, "kept", lambda df, label: sizes.setdefault(label, out := write(df, label)) and out)
    rows = [(i, f"s{i}", "", ["p1", "p2"], "alpha beta gamma", "kind of thing", "one title here", f"statement{i}") for i in range(60)]
    rows += [(60 + i, f"s{60 + i}", "", [f"q{i}"], "delta epsilon zeta", f"a class of cases that share much {'x' * i}", f"eta{i} theta{i}", f"other{i}") for i in range(2)]
    got = {tuple(x) for x in fo.merge_edges(spark.createDataFrame(rows, SCHEMA)).select("a", "b", "rule").collect()}
    assert got == brute(rows) and len(got) == 60 * 59 // 2 + 1
    assert max(df.count() for df in sizes.values()) <= len(rows)
