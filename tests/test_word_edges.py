"""Words that end before letters beyond ASCII, and other line ends: the same in Spark as in the SQL."""

import duckdb
import pytest

from lacuna.plans import catalogue

TEXTS = [
    "one\nwe useé and extendü a standardé methodö here", "one\nplain words", "two\napplyä x toé y", "two\ntest it\rwith z   under load",
    "\n" + "graphé robustü " * 5, "three\nPaper 7 and arxivé notes", None, "four\npaper\x0b7 of theoremß boundé policý estimateñ sampleå",
    "x\ncausalé robusté federatedé bayesiané quantumé diffusioné " + "deadbeef" * 5 + "é",
]


@pytest.mark.parametrize("name", ["candidate_flags", "formulation_caps", "personalized_caps", "role_caps", "quality_caps", "batch_caps", "secret_scan"])
def test_edges_equal_sql(spark, tmp_path, name):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS * 40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = catalogue.QUERIES[name](spark, str(tmp_path))
    expected = con.execute(f"SELECT {', '.join(found.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, expected))
