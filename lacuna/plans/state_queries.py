"""Upserted graphs, merged records and snippets of many gaps over the tables in those roles, with their DuckDB equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import patterns, records, upserts
from lacuna.plans.views import table
from lacuna.scratch import shared_dir


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as facts of nodes and edges, in the order of orders and lines."""
    p, o = F.col("l_partkey"), F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("n"), (p % 150).cast("string")).alias("id"), F.col("l_returnflag").alias("type"), F.concat(F.lit("label "), (p % 7).cast("string")).alias("label"), F.concat(F.lit("p"), (o % 40).cast("string")).alias("paper_id"),
        F.concat_ws(" ", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("evidence"), F.concat(F.lpad(o.cast("string"), 12, "0"), F.lit("-"), F.col("l_linenumber"), F.lit("-"), F.lpad(p.cast("string"), 9, "0")).alias("seq"), F.col("l_linenumber").alias("line"), ((p % 11) / 10.0).alias("confidence"),
    )


def _state(spark: SparkSession) -> upserts.State:
    return upserts.State(spark, f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}", 16)


def graph_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes after three deltas, the latest lines first and one delta twice: papers in their order, evidence in its order."""
    facts, state = _facts(spark, sf_dir), _state(spark)
    for part in ("line >= 5", "line BETWEEN 3 AND 4", "line <= 2", "line BETWEEN 3 AND 4"):
        state.upsert_nodes(facts.where(part))
    said = F.array_join(F.transform("evidence", lambda e: F.concat_ws("/", e["paper_id"], e["text"])), ";")
    return state.nodes().select("id", "type", "label", F.array_join("paper_ids", " ").alias("papers"), F.size("evidence").cast("long").alias("n"), F.sha1(said).alias("evidence"))


def edge_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after three deltas: of a key the last row holds."""
    facts, state = _facts(spark, sf_dir), _state(spark)
    rows = facts.select(F.col("id").alias("source"), F.concat(F.lit("t"), F.col("label")).alias("target"), F.col("type").alias("relation"), "paper_id", "evidence", "confidence", "seq", "line")
    for part in ("line >= 5", "line <= 2", "line BETWEEN 3 AND 4"):
        state.upsert_edges(rows.where(part))
    return state.edges().select("source", "target", "relation", "paper_id", "evidence", F.round("confidence", 6).alias("confidence"), "seq")


def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records, customers as what they are records of: every field of the merge."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    some = lambda n, x: F.when(k % n == 0, x)
    source = F.concat(F.lit("s"), s(k % 3))
    rows = table(spark, sf_dir, "orders").select(
        c.alias("component"), k.alias("place"), F.concat(F.lit("id"), s(k)).alias("paper_id"), F.concat(F.lit("title "), s(k % 9)).alias("title"), F.array(F.concat(F.lit("a"), s(k % 5))).alias("authors"), some(2, 2000 + k % 20).alias("year"),
        F.repeat(F.lit("x"), (k % 13).cast("int")).alias("abstract"), some(4, F.concat(F.lit("10.1/"), s(k))).alias("doi"), F.when(k % 5 == 0, s(k)).otherwise("").alias("arxiv_id"), some(7, F.lit("V")).alias("venue"),
        F.array(source).alias("source_names"), F.array(F.concat(F.lit("q"), s(k % 4))).alias("retrieval_queries"), some(3, k % 50).alias("citation_count"), some(6, k % 8).alias("influential_citation_count"),
        F.create_map(source, s(k)).alias("source_ids"),
    )
    r = records.merged_records(rows)
    entries = F.array_join(F.transform(F.map_entries("source_ids"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return r.select("component", "n", "paper_id", "title", F.col("authors")[0].alias("author"), F.coalesce("year", F.lit(-1)).alias("year"), F.length("abstract").cast("long").alias("chars"), F.coalesce("doi", F.lit("")).alias("doi"), F.coalesce("arxiv_id", F.lit("")).alias("arxiv_id"),
                    F.coalesce("venue", F.lit("")).alias("venue"), F.array_join("source_names", " ").alias("sources"), F.array_join("retrieval_queries", " ").alias("queries"), F.coalesce("citation_count", F.lit(-1)).alias("citations"), F.coalesce("influential_citation_count", F.lit(-1)).alias("influential"), entries.alias("source_ids"))


def gap_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as gaps, their words of eight letters or more as terms: where they first stand in every document, and the text around."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{8,})"), F.lit(1)))
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.explode(words).alias("pattern"))
    found = patterns.snippets(terms, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 80)
    return found.select(F.col("key").alias("item_id"), F.col("id").alias("doc_id"), "place", F.sha1("snippet").alias("snippet"))


_FACTS = """f AS (SELECT 'n' || l_partkey % 150 AS id, l_returnflag AS type, 'label ' || l_partkey % 7 AS label, 'p' || l_orderkey % 40 AS paper_id, l_linestatus || ' ' || strftime(l_shipdate, '%Y-%m-%d') AS evidence, lpad(l_orderkey::VARCHAR, 12, '0') || '-' || l_linenumber || '-' || lpad(l_partkey::VARCHAR, 9, '0') AS seq, (l_partkey % 11) / 10.0::DOUBLE AS confidence FROM lineitem)"""

ORACLE_SQL = {
    "graph_upserts": f"""WITH {_FACTS}, p AS (SELECT id, paper_id, min(seq) AS s FROM f GROUP BY 1, 2), e AS (SELECT DISTINCT id, seq, paper_id, evidence FROM f)
        SELECT id, (SELECT arg_min(type, (seq, type, label)) FROM f WHERE f.id = i.id) AS type, (SELECT arg_min(label, (seq, type, label)) FROM f WHERE f.id = i.id) AS label, (SELECT string_agg(paper_id, ' ' ORDER BY s, paper_id) FROM p WHERE p.id = i.id) AS papers,
          (SELECT count(*) FROM e WHERE e.id = i.id) AS n, sha1((SELECT string_agg(paper_id || '/' || evidence, ';' ORDER BY seq, paper_id, evidence) FROM e WHERE e.id = i.id)) AS evidence FROM (SELECT DISTINCT id FROM f) i""",
    "edge_upserts": f"""WITH {_FACTS} SELECT id AS source, 't' || label AS target, type AS relation, paper_id, evidence, round(arg_max(confidence, seq), 6) AS confidence, max(seq) AS seq FROM f GROUP BY ALL""",
    "merged_records": """WITH r AS (SELECT o_custkey AS c, o_orderkey AS k FROM orders), m AS (SELECT c, string_agg(s || '=' || k, ';' ORDER BY s) AS ids FROM (SELECT c, 's' || k % 3 AS s, max(k) AS k FROM r GROUP BY 1, 2) GROUP BY 1)
        SELECT c AS component, count(*) AS n, 'id' || min(k) AS paper_id, 'title ' || min(k) % 9 AS title, 'a' || min(k) % 5 AS author, CASE WHEN min(k) % 2 = 0 THEN 2000 + min(k) % 20 ELSE -1 END AS year, max(k % 13) AS chars,
          coalesce('10.1/' || min(k) FILTER (WHERE k % 4 = 0), '') AS doi, coalesce((min(k) FILTER (WHERE k % 5 = 0))::VARCHAR, '') AS arxiv_id, coalesce(CASE WHEN count(*) FILTER (WHERE k % 7 = 0) > 0 THEN 'V' END, '') AS venue, string_agg(DISTINCT 's' || k % 3, ' ' ORDER BY 's' || k % 3) AS sources,
          string_agg(DISTINCT 'q' || k % 4, ' ' ORDER BY 'q' || k % 4) AS queries, coalesce(max(k % 50) FILTER (WHERE k % 3 = 0), -1) AS citations, coalesce(max(k % 8) FILTER (WHERE k % 6 = 0), -1) AS influential, any_value(ids) AS source_ids FROM r JOIN m USING (c) GROUP BY c""",
    "gap_snippets": """WITH t AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}'))) AS term FROM benchmark), h AS (SELECT item_id, doc_id, min(instr(lower(text), term)) AS place FROM t JOIN documents ON contains(lower(text), term) GROUP BY 1, 2)
        SELECT item_id, doc_id, place, sha1(substr(text, greatest(1, place - 40), 80)) AS snippet FROM h JOIN documents USING (doc_id)""",
}

QUERIES = {f.__name__: f for f in (graph_upserts, edge_upserts, merged_records, gap_snippets)}
