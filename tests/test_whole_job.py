"""Queries against statements of the whole job, which no filter or cut shortens."""

import os
import re
import unicodedata

import numpy as np
import pytest

from lacuna.operators import retrieval, similarity
from lacuna.plans import catalogue
from tests.test_engine import SF, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")


def rows_of(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    return sorted(tuple(plain(x) for x in r) for r in df.select(*cols).collect())


def rows_by(sql):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())


def test_group_stats_of_all_line_items(spark):
    want = rows_by("""SELECT l_suppkey, l_returnflag, count(*) AS n, round(avg(l_quantity), 4) AS l_quantity_mean, round(stddev_samp(l_quantity), 4) AS l_quantity_std,
        round(stddev_samp(l_quantity) / sqrt(count(*)), 4) AS l_quantity_stderr, round(avg(l_discount), 4) AS l_discount_mean, round(stddev_samp(l_discount), 4) AS l_discount_std,
        round(stddev_samp(l_discount) / sqrt(count(*)), 4) AS l_discount_stderr FROM lineitem GROUP BY 1, 2""")
    assert rows_of(spark, "group_stats") == want


def test_complete_rankings_of_all_batches(spark):
    want = rows_by("""WITH r AS (SELECT l_orderkey AS batch, l_linenumber AS rank, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS position FROM lineitem)
        SELECT batch, count(*) = count(DISTINCT rank) AND min(rank) = 1 AND max(rank) = count(*) AS complete, bool_and(rank = position) AS input_order FROM r GROUP BY 1""")
    assert rows_of(spark, "complete_rankings") == want


def test_cosine_topk_among_all_vectors(spark):
    want = rows_by("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.v, b.v), 5) AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, other) AS rank FROM n) SELECT vec_id, other, rank FROM r WHERE rank <= 5""")
    assert rows_of(spark, "cosine_topk") == want


def test_nearest_with_ties_and_few_rows(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(200)], "id long, vector array<double>")
    got = {}
    for r in similarity.nearest(rows, 3).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
    assert got == {i: [j for j in range(i % 2, 200, 2) if j != i][:3] for i in range(200)}
    assert sorted(map(tuple, similarity.nearest(rows.where("id < 2"), 3).collect())) == [(0, 1, 1), (1, 0, 1)]


def test_mmr_over_all_rows(spark):
    """Rows of the top score beyond the first 1000 by id are chosen for their direction; the minimum is the table's."""
    turn = lambda i: [1.0, 0.0, 0.0] if i < 1200 else [0.0, 1.0, 0.0] if i < 1300 else [0.0, 0.0, 1.0]
    rows = [(i, 5.0 if i < 1300 else 4.0 if i < 1400 else -5.0, turn(i)) for i in range(1500)]
    got = retrieval.mmr(spark.createDataFrame(rows, "id long, score double, embedding array<double>").repartition(5), 3).orderBy("position").collect()
    assert [r.id for r in got] == [0, 1200, 1300]


def test_mmr_equals_greedy_choice(spark):
    rng = np.random.default_rng(1)
    v, score = rng.normal(size=(1500, 8)), (np.arange(1500) % 11).astype(float)
    got = retrieval.mmr(spark.createDataFrame([(i, float(score[i]), v[i].tolist()) for i in range(1500)], "id long, score double, embedding array<double>"), 12)
    u, rel, want = v / np.linalg.norm(v, axis=1, keepdims=True), score / 10, []
    while len(want) < 12:
        value = 0.75 * rel - (0.25 * (u @ u[want].T).max(axis=1) if want else 0)
        value[want] = -np.inf
        want.append(int(value.argmax()))
    assert [r.id for r in got.orderBy("position").collect()] == want


def span_form(t):
    t = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii")
    return re.sub(r"\s+", " ", re.sub(r"-\s+", "", t)).strip().lower()


def standing(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    docs = [(r.doc_id, span_form(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    spans = [(r.item_id, span_form(r.text)) for r in items if len(r.text) >= 15]
    return sorted((i, d) for i, s in spans for d, t in docs if s and s in t)


def test_contamination_by_containment(spark, tmp_path):
    bench = [(1, "Who came first, the hen or its egg?"), (2, "a short passage"), (3, "tiny"), (4, "one naïve re-\nsult of three"), (5, "supercalifragilistic")]
    docs = [
        (1, 'He asked: "who came  FIRST, the hen or its egg?".'), (2, "Who came first, the hen and its egg?"), (3, "(A short\npassage)"), (4, "tiny"),
        (5, "xone naive result of threes"), (6, "unsupercalifragilistically"), (7, ""), (8, None),
    ]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in catalogue.QUERIES["contamination"](spark, str(tmp_path)).select("item_id", "doc_id").collect())
    assert got == [(1, 1), (2, 3), (4, 5), (5, 6)] == standing(spark, str(tmp_path))


def test_contamination_equals_plain_search(spark):
    got = sorted(tuple(r) for r in catalogue.QUERIES["contamination"](spark, SF).select("item_id", "doc_id").collect())
    assert got == standing(spark, SF)


#: The registered SQL of these queries cuts texts; without the cuts it states the whole job.
CUTS = [("substr(split_part(text, chr(10), 1), 1, 200)", "split_part(text, chr(10), 1)"), ("substr(title, 1, 60)", "title"), ("substr(text, 1, 200)", "text")]


@pytest.mark.parametrize("name", ["alias_components", "seed_alignment", "dedup_multikey", "relevance_score", "facet_score", "text_functions"])
def test_whole_texts(spark, name):
    sql = catalogue.ORACLE_SQL[name]
    for cut, whole in CUTS:
        sql = sql.replace(cut, whole)
    assert rows_of(spark, name) == rows_by(sql)


def test_titles_and_seeds_to_their_end(spark, tmp_path):
    same = " ".join(f"word{i}" for i in range(60))
    docs = [(1, f"{same} alpha password\nx", "en", "a"), (2, f"{same} beta\nx", "en", "a"), (3, " ".join(f"other{i}" for i in range(9)) + " omega", "en", "b"), (4, same[:200] + "\ny", "en", "c")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, f"{same} omega")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {n: catalogue.QUERIES[n](spark, str(tmp_path)) for n in ("alias_components", "seed_alignment", "dedup_multikey", "relevance_score", "facet_score")}
    assert {r.id: r.component for r in got["alias_components"].collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id: r.share for r in got["seed_alignment"].collect()}[3] == 0.1
    assert got["dedup_multikey"].count() == 4
    assert {r.id for r in got["relevance_score"].where("score >= 6").collect()} == {1}
