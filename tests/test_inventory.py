"""Inventories, profiles, title matches and wrappers of models on small rows."""

from __future__ import annotations

import difflib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lacuna.operators import inventory, likeness, models


def test_profile_and_ids():
    got = inventory.topic_profile("bandits", ["linear bandit", "regret bound", "benchmark", "bandits"], 3)
    assert got["task_terms"] == ["linear bandit", "bandits"] and got["method_terms"] == ["regret bound"] and got["benchmark_terms"] == ["benchmark"]
    assert got["queries"] == ["bandits", "bandits linear bandit", "bandits regret bound"]
    assert inventory.run_id("{seed_label_slug}-{author_slug}-{topic_slug}-{timestamp}", None, "Ana Ö. B", "a b c d e", "t") == "seed_set-ana_b-a_b_c_d-t"
    assert inventory.ordered_columns(["z", "b", "a", "id"], ["id", "b", "x"]) == ["id", "b", "a", "z"]


def test_title_matches(spark):
    papers = spark.createDataFrame([("p1", "Regret Bounds for Linear Bandits"), ("p2", "Regret bounds for linear bandits!"), ("p3", "Something else entirely"), ("p4", None)], "paper_id string, title string")
    titles = spark.createDataFrame([(1, "Regret bounds for linear bandit"), (2, "Regret and else"), (3, "Quite unknown"), (4, None), (5, "")], "id int, title string")
    got = {r["id"]: r for r in inventory.title_matches(titles, papers).collect()}
    assert got[1]["resolved"] and got[1]["paper_id"] == "p1" and got[1]["alternatives"] == ["p2"]
    assert [got[i]["reason"] for i in (2, 3, 4, 5)] == ["below threshold"] * 4 and not any(got[i]["resolved"] for i in (2, 3, 4, 5))
    assert {r["reason"] for r in inventory.title_matches(titles, papers.limit(0)).collect()} == {"no candidates"}


def test_rows_and_texts(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 4), (3, "", 1), (4, None, 1)], "id int, k string, at int")
    assert [r["id"] for r in inventory.first_occurrences(rows, F.col("k"), [F.col("at")]).collect()] == [2]
    one = spark.range(1).select(
        inventory.merged_axes(F.array(F.lit("a")), F.array(F.lit(" a "), F.lit("b"), F.lit(" "))).alias("axes"),
        inventory.alignment_reason(F.lit(0.5), F.array(F.lit("p"), F.lit("q"))).alias("yes"), inventory.alignment_reason(F.lit(0.0), F.array(F.lit("p"))).alias("no"),
        inventory.usable_abstract(F.lit("Here we PROVE it"), F.lit("own")).alias("claims"), inventory.usable_abstract(F.lit(" fine "), F.lit("own")).alias("fine"), inventory.usable_abstract(F.lit(None).cast("string"), F.lit("own")).alias("none"),
    ).first()
    assert one["axes"] == ["a", "b"] and one["yes"] == "Supported by 2 seed paper(s): p, q" and one["no"].startswith("No seed")
    assert (one["claims"], one["fine"], one["none"]) == ("own", "fine", "own")


def test_batches_lose_nothing(spark):
    rows = spark.range(23).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("text").alias("line"))
    batches = models.batched_prompts(rows, "key", F.col("line"), 8, "Say", parts=2).cache()
    members = [k for r in batches.collect() for k in r["members"]]
    assert sorted(members) == sorted(f"k{i}" for i in range(23)) and max(len(r["members"]) for r in batches.collect()) == 8
    first = batches.orderBy("id").first()
    assert first["prompt"].startswith("Say\n\n[1] text\n[2] text")
    ids = [r["id"] for r in batches.orderBy("id").collect()]
    log = spark.createDataFrame([(ids[0], '{"classifications": [{"gap_index": 1, "class": "Known_Open"}, {"gap_index": 2, "class": "strange"}]}'), (ids[1], None)], "id string, reply string")
    classes = {r["key"]: r["class"] for r in models.novelty_classes(batches, log).collect()}
    assert len(classes) == 23 and classes[first["members"][0]] == "known_open" and sum(c != "novel" for c in classes.values()) == 1
    kept = {r["key"] for r in models.relevant_members(batches, spark.createDataFrame([(ids[0], "I think [1, 3]")], "id string, reply string")).collect()}
    assert kept == {first["members"][0], first["members"][2]} | set(classes) - set(first["members"])


def test_prompts_retries_and_gates(spark):
    text = spark.createDataFrame([("x", None)], "a string, b string").select(models.prompt('{a}|{b}|{"json": 1}|{c}', {"a": F.col("a"), "b": F.col("b")}).alias("p")).first()["p"]
    assert text == 'x||{"json": 1}|{c}'
    seen = []
    assert models.two_pass(lambda p: seen.append(p) or ("thinking" if len(seen) == 1 else "{}"))("ask") == "{}" and len(seen) == 2 and seen[1].startswith("ask\n\nthinking")

    tries = []

    def third(prompt: str) -> str:
        tries.append(prompt)
        if len(tries) < 3:
            raise ValueError("busy")
        return "ok"

    assert models.backed_off(third, (0, 0, 0))("p") == "ok" and len(tries) == 3
    with pytest.raises(ZeroDivisionError):
        models.backed_off(lambda p: 1 / 0, (0,))("p")
    log = spark.createDataFrame([(1, '{"summary": "s", "confidence": "0.7", "label": "HIGH"}', 1), (2, None, 3)], "id int, reply string, attempts int")
    got = {r["id"]: r for r in models.agent_rows(log).collect()}
    assert got[1]["failure_modes"] == [] and got[2]["failure_modes"] == ["parse_failure"] and got[2]["summary"] == "failed after retries"


def _over(prompt: str) -> str:
    return json.dumps({"score": 3 if "not accepted" in prompt else 9}) if "odd" in prompt else json.dumps({"score": 9 if "never" in prompt else 1})


def test_scoring_loop_asks_once_more(spark):
    prompts = spark.createDataFrame([(1, "odd"), (2, "even"), (3, "never")], "id int, prompt string")
    check = lambda log: log.select("id", F.when(F.get_json_object("reply", "$.score").cast("int") > 5, F.array(F.lit("over cap"))).otherwise(F.array().cast("array<string>")).alias("violations"))
    got = {r["id"]: r for r in models.scored(prompts, _over, check).collect()}
    assert (got[1]["attempt"], got[1]["violations"]) == (2, []) and (got[2]["attempt"], got[2]["violations"]) == (1, []) and got[3]["violations"] == ["over cap"] and len(got) == 3


# --- the exact ratio join ---


def edited(r, text):
    out = list(text)
    for _ in range(r.randint(0, max(1, len(out) // 8))):
        at = r.randrange(len(out) + 1)
        if r.random() < 0.5 and out:
            out.pop(min(at, len(out) - 1))
        else:
            out.insert(at, r.choice("abcdé z"))
    return "".join(out)


@pytest.mark.parametrize("threshold", [0.92, 0.85, 0.72, 0.5, 1.0])
def test_ratio_pairs_equal_brute_force(spark, threshold):
    """Short and long texts, copies, near copies, one word in all of them."""
    r = random.Random(int(100 * threshold))
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 8))) for _ in range(40)]
    some = [" ".join(["study", *(r.choice(words) for _ in range(r.randint(0, 9)))]) for _ in range(50)] + ["a", "b", "ab", "abc", "abcd", "", "x" * 300]
    left = some + [edited(r, t) for t in some] + some[:5]
    right = [edited(r, t) for t in some] + some[::2] + ["".join(r.sample(t, len(t))) for t in some[:20]]
    got = likeness.ratio_pairs(spark.createDataFrame([(t,) for t in left], "text string"), spark.createDataFrame([(t,) for t in right], "text string"), threshold)
    ratio = lambda a, b: 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()
    want = {(a, b): ratio(a, b) for a in set(left) for b in set(right) if a and b and ratio(a, b) >= threshold}
    assert {(x.a, x.b): x.ratio for x in got.collect()} == want and len(want) > 20


def test_bounds_of_shared_grams():
    """No pair of texts shares fewer q-grams than the bound says."""
    r = random.Random(9)
    for _ in range(3000):
        a = "".join(r.choice("abc ") for _ in range(r.randint(1, 30)))
        b = edited(r, a)
        m = sum(x.size for x in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
        t = 2 * m / max(1, len(a) + len(b))
        for q in (1, 2, 3):
            shared = (Counter(likeness.tokens(a, q)) & Counter(likeness.tokens(b, q))).total()
            assert shared >= likeness.least_overlap(len(a), len(b), q, t)


def test_matches_ranks_and_copies(spark):
    left = spark.createDataFrame([(1, "graph neural networks"), (2, "graph neural networks"), (3, ""), (4, None)], "id int, text string")
    right = spark.createDataFrame([(i, "graph neural network") for i in range(9)] + [(9, "graph neural networks"), (10, None)], "other int, text string")
    got = {(x.id, x.rank): x.other for x in likeness.matches(left, right, 0.92, 3).collect()}
    assert got == {(i, k): o for i in (1, 2) for k, o in ((1, 9), (2, 0), (3, 1))}
    assert likeness.matches(left.limit(0), right, 0.92, 3).count() == 0


def test_ratio_pairs_of_equal_length(spark):
    """A letter lost and another doubled: the shorter partners' bound is higher than that of partners as long."""
    got = likeness.ratio_pairs(spark.createDataFrame([("abdefgghijklm",)], "text string"), spark.createDataFrame([("abcdefghijklm",)], "text string"), 0.92)
    assert [(x.a, x.b, round(x.ratio, 6)) for x in got.collect()] == [("abdefgghijklm", "abcdefghijklm", 0.923077)]


def test_ratio_pairs_in_many_blocks(spark, monkeypatch):
    """Blocks of a few texts give the same pairs; what is shuffled or kept are texts, not pairs."""
    r = random.Random(5)
    some = ["".join(r.choice("abcdefg ") for _ in range(r.randint(1, 40))) for _ in range(60)]
    left, right = [edited(r, t) for t in some], some
    monkeypatch.setattr(likeness, "LEFT", (50, 3))
    monkeypatch.setattr(likeness, "RIGHT", (80, 4))
    found = likeness.ratio_pairs(spark.createDataFrame([(t,) for t in left], "text string"), spark.createDataFrame([(t,) for t in right], "text string"), 0.85)
    ratio = lambda a, b: 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()
    want = {(a, b): ratio(a, b) for a in set(left) for b in set(right) if a and b and ratio(a, b) >= 0.85}
    assert {(x.a, x.b): x.ratio for x in found.collect()} == want and len(want) > 20
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString()
