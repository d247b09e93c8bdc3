"""Work that must not grow faster than its input, on small tables."""

import difflib
import itertools
import random

from pyspark import TaskContext
from pyspark.sql import functions as F

from lacuna.functions import vectorised
from lacuna.operators import graph, model_stages, rubrics, similarity, vectors
from lacuna.plans import catalogue, rubric_queries
from lacuna.sources import paged


def test_near_copies_meet_in_blocks(spark, monkeypatch):
    """Sets of one family travel to a few blocks of pairs, and no link is lost, whatever the block's size."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    sets = {i: sorted((set(base) - set(rng.sample(base, 3))) | {f"x{i}", f"y{i % 7}"}) for i in range(80)}
    sets |= {100 + i: [f"z{i}", f"z{i + 1}"] for i in range(20)} | {200: sets[3]}
    monkeypatch.setattr(similarity, "SIDE", 8)
    monkeypatch.setattr(similarity, "TOKENS", 16)
    rows = spark.createDataFrame([(i, t) for i, t in sets.items()], "id long, tokens array<string>")
    got = {(r.a, r.b): round(r.similarity, 9) for r in similarity.similar_pairs(rows, 0.85).collect()}
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(a, b): round(like(sets[a], sets[b]), 9) for a, b in itertools.combinations(sorted(set(sets) - {200}), 2) if like(sets[a], sets[b]) >= 0.85}
    assert len(want) > 500 and got == want | {(3, 200): 1.0}


def test_alike_is_the_ratio_and_compares_few(spark):
    """The bound by edit distance changes no answer, and texts far apart are not compared in Python."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdé𝄞") for _ in range(n))
    pairs = [("", ""), ("", "a"), (None, ""), ("abcd", "bcda")]
    for n in (5, 40, 250):
        for _ in range(60):
            x = word(n)
            y = list(x)
            for _ in range(rng.randrange(max(2, n // 4))):
                i = rng.randrange(len(y))
                y[i : i + 1] = rng.choice([[], [rng.choice("abcdé")], [y[i], "z"]])
                y = y or ["a"]
            pairs.append((x, "".join(y)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for least in (0.72, 0.86):
        want = [a == b or difflib.SequenceMatcher(None, a or "", b or "").ratio() >= least for a, b in pairs]
        got = [r.x for r in df.select(vectorised.alike(F.col("a"), F.col("b"), least).alias("x")).collect()]
        assert got == want and any(want[4:]) and not all(want)


def test_many_pages_share_tasks_and_files(spark, tmp_path):
    """Files and tasks follow the rows, not one to a page; filters choose among the pages of a task as before."""
    rows = spark.range(20_000).select(F.lit("A").alias("venue"), F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), (2000 + F.col("id") % 10).cast("int").alias("year"), F.col("id").alias("place"))
    service = paged.Served.write(rows.where("id NOT BETWEEN 3000 AND 3999"), str(tmp_path / "p"), 10)
    assert len(list((tmp_path / "p").rglob("*.parquet"))) <= 2000 / 64 + 1
    every = paged.listed(spark, service, ["A"], 10)
    assert every.rdd.getNumPartitions() <= paged.TASKS
    got = every.where("page >= 250 AND page < 450 AND year >= 2008").select("id", "page").collect()
    assert sorted((int(r.id), r.page) for r in got) == [(i, i // 10) for i in range(2500, 4500) if i % 10 >= 8 and not 3000 <= i < 4000]


def test_batches_of_vectors_are_bounded_by_bytes(spark):
    """A row of a block holds 64 vectors, so batches by rows alone would hold hundreds of MB."""
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(300)], "id long, vector array<double>")
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(size, "256m")
    got = vectors.nearest(rows, 1)
    assert int(spark.conf.get(size)) <= 8 << 20 and got.count() == 300


def test_batches_of_texts_are_bounded_by_bytes(spark):
    """Whole texts are long, so batches by rows alone have no bound."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(size, "256m")
    catalogue.QUERIES["contamination"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(size)) <= 8 << 20


def test_a_model_is_asked_by_many_tasks(spark):
    """Rows that come in one piece are asked by as many tasks as the session has, the repaired ones too."""
    stage = model_stages.Stage("Number {n}", "task string", ("task",))
    model = lambda prompt: f'{{"task": "{TaskContext.get().partitionId()}"}}' if "could not" in prompt or prompt[-1] in "02468" else "no"
    got = model_stages.asked(spark.range(400).coalesce(1), stage, model, {"n": F.col("id")}).collect()
    assert sorted((r.id, r.attempts, r.problem) for r in got) == [(i, 1 + i % 2, None) for i in range(400)]
    assert len({r.p.task for r in got if r.attempts == 1}) == len({r.p.task for r in got if r.attempts == 2}) == 4


def test_tasks_of_batches_follow_the_rows(spark, monkeypatch):
    """More line items are counted by more tasks, not by larger ones, and with the same result."""
    ask = lambda: catalogue.QUERIES["batch_validation"](spark, "/root/testdata/sf0.001")
    few = sorted(ask().collect())
    monkeypatch.setattr(rubric_queries, "TASK_ROWS", 500)
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert ask().rdd.getNumPartitions() >= n // 500 > 4 and sorted(ask().collect()) == few


def test_labels_are_sought_in_a_text_lowered_once(spark):
    """A reply's text is lowered once, whatever the number of labels, and any of them is found as a whole word."""
    labels = ("baseline method", "Method-X", "a")
    rows = [("The BASELINE method", True), ("method-x!", True), ("method-xy", False), ("éa", False), ("É a", True), (None, False), ("", False)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert all(r.x == r.want == (r.n > 0) for r in df.select("want", rubrics.has_method_label(F.col("t"), labels).alias("x"), F.size(rubrics.method_labels(F.col("t"), labels)).alias("n")).collect())
    assert str(rubrics.reply_violations(rubrics.RUBRICS["idea_quality"], {}, labels)).count("lower(") == 1


def test_tuples_are_shuffled_once_for_edges(spark):
    """Both steps of merging happen behind one exchange, whose rows hold ids' bits; a listing that stands twice is one edge."""
    rows = [(f"p{i % 5}", f"method {i % 7}", ("assumes", "limited_by", "contradicts")[i % 3], f"thing {i % 4}", f"e{i % 2}", i / 100, f"{i:03}") for i in range(100)]
    resolved = graph.resolved(spark.createDataFrame(rows, "paper_id string, subject string, relation string, object string, evidence string, confidence double, seq string"))
    edges = graph.edges(resolved)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    want = {}
    for r in sorted(resolved.collect(), key=lambda r: r.seq):
        want.setdefault((r.source, r.target, r.relation), {})[r.paper_id, r.evidence] = r.confidence
    got = {(r.source, r.target, r.relation): (r.paper_ids, r.evidence, r.confidence, r.support_count) for r in edges.collect()}
    assert got == {k: (sorted({p for p, _ in v}), " ".join(sorted({e for _, e in v})), max(v.values()), len(v)) for k, v in want.items()}
    listed = spark.createDataFrame([("p1", "Limitation", "Thing  A"), ("p1", "Limitation", "thing a"), ("p1", "Limitation", "thing a"), ("p2", "Metric", "b")], "paper_id string, type string, label string")
    both = graph.edges(resolved, listed).where("relation = 'mentions'").collect()
    assert sorted((r.source, r.target.split(":")[0], r.paper_ids, r.support_count) for r in both) == [("paper:p1", "limitation", ["p1"], 1), ("paper:p2", "metric", ["p2"], 1)]
    nodes = {r.id: (r.type, r.label, r.paper_ids) for r in graph.nodes(resolved, listed).collect()}
    assert {r.target for r in both} | {"paper:p1", "paper:p2"} | {k[0] for k in want} <= set(nodes)
    assert nodes["paper:p1"] == ("Paper", "p1", ["p1"]) and ("Limitation", "Thing  A", ["p1"]) in nodes.values()


def test_tokens_travel_in_prefixes_only(spark, monkeypatch):
    """Sets are ordered where they lie, whatever the cells: all links are found, and what is written besides the sets are their prefixes."""
    rng = random.Random(8)
    sets = {i: [f"w{j}" for j in rng.sample(range(3000), 200)] for i in range(40)}
    sets |= {100 + i: [*sets[i][:190], *(f"v{i}-{j}" for j in range(10))] for i in range(20)} | {200: sets[7], 201: sets[7], 202: []}
    rows = spark.createDataFrame(list(sets.items()), "id long, tokens array<string>").repartition(3)
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(a, b): round(like(sets[a], sets[b]), 9) for a, b in itertools.combinations(sorted(set(sets) - {200, 201, 202}), 2) if like(sets[a], sets[b]) >= 0.85}
    assert len(want) == 20
    write = similarity.kept
    for cells in (1 << 22, 64, 1):
        tables = {}
        monkeypatch.setattr(similarity, "CELLS", cells)
        monkeypatch.setattr(similarity, "kept", lambda df, label: tables.setdefault(label, write(df, label)))  # noqa: B023
        near = similarity.similar_pairs(rows, 0.85)
        assert {(r.a, r.b): round(r.similarity, 9) for r in near.collect()} == want | {(7, 200): 1.0, (7, 201): 1.0}
        assert tables["prefix"].count() <= 60 * 31 and [k for k, t in tables.items() if "t" in t.columns] == ["sets", "prefix"]


def test_shapes_leave_few_pairs_to_check(spark, monkeypatch):
    """Sets that share rare tokens and little else are told apart by their shapes; large sets without a shape pass."""
    rng = random.Random(2)
    sets = {i: ["rare", *(f"w{j}" for j in rng.sample(range(600), 240))] for i in range(60)}
    sets |= {100 + i: [*sets[i][:235], *(f"v{i}-{j}" for j in range(6))] for i in range(10)} | {200 + i: [f"x{j}" for j in range(9000 + i)] for i in range(2)}
    rows = spark.createDataFrame([(i, len(t), t) for i, t in sets.items()], "id long, n int, tokens array<string>")
    hashed = rows.select("id", "n", F.transform("tokens", lambda x: F.xxhash64(x)).alias("t"))
    every = spark.createDataFrame([x for x in itertools.combinations(sorted(sets), 2) if (x[0] < 200) == (x[1] < 200)], "a long, b long")
    left = {(r.a, r.b) for r in similarity._may_reach(every, hashed, 0.85).collect()}
    assert {(i, 100 + i) for i in range(10)} | {(200, 201)} <= left and len(left) < 40
