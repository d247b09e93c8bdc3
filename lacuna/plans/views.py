"""Claim tuples and mentions derived from the star-schema tables, and the graph built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import normalise
from lacuna.operators import graph

RELATIONS = list(graph.OBJECT_TYPE)
#: Every line item has a role: even residues are claims, odd ones mentions; half the residue keeps subjects and objects as fine as the rows are many.
RESIDUE = "(l_orderkey * 7 + l_linenumber) % 8"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, subject, relation, object, evidence, confidence, seq of the line items that are claims."""
    rows = table(spark, sf_dir, "lineitem").where(f"{RESIDUE} % 2 = 0")
    part = F.expr(f"cast({RESIDUE} div 2 AS string)")
    relation = F.get(F.array(*[F.lit(r) for r in RELATIONS]), F.expr("cast((l_partkey + 3 * l_linenumber + l_suppkey) % 10 AS int)"))
    ideal = F.when((relation == "assumes") & (F.col("l_suppkey") % 3 == 0), F.lit(" known horizon")).otherwise(F.lit(""))
    return rows.select(
        F.col("l_orderkey").cast("string").alias("paper_id"),
        F.concat(F.lit("part "), F.col("l_partkey"), F.lit("-"), part).alias("subject"),
        relation.alias("relation"),
        F.concat(F.lit("obj "), F.col("l_suppkey"), F.lit("-"), F.col("l_linenumber"), F.lit("-"), part, ideal).alias("object"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus", F.when(F.col("l_suppkey") % 5 == 0, F.lit("improves accuracy"))).alias("evidence"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"),
        F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd"), "l_quantity", "l_extendedprice").alias("seq"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, type, label of entities that papers only list: the other line items."""
    return listings(spark, sf_dir).distinct()


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of :func:`mentions`, as often as they stand there."""
    rows = table(spark, sf_dir, "lineitem").where(f"{RESIDUE} % 2 = 1")
    part = F.expr(f"cast({RESIDUE} div 2 AS string)")
    return rows.select(
        F.col("l_orderkey").cast("string").alias("paper_id"),
        F.when(F.col("l_linenumber") % 2 == 1, F.lit("FailureCondition")).otherwise(F.lit("Limitation")).alias("type"),
        F.concat(F.lit("obj "), F.col("l_suppkey"), F.lit("-"), F.col("l_linenumber"), F.lit("-"), part).alias("label"),
    )


def evidence_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    typed, listed = graph.resolved(tuples(spark, sf_dir)), listings(spark, sf_dir)  # nodes and edges count no listing twice
    return graph.nodes(typed, listed), graph.edges(typed, listed)


# --- the same views for DuckDB ---

_TYPES = "CASE relation " + " ".join(f"WHEN '{r}' THEN '{t}'" for r, t in graph.OBJECT_TYPE.items()) + " END"


def norm_label(x: str) -> str:
    """A label's normal form in SQL."""
    folded = f"translate({x}, '{normalise.RAISED}{normalise.LOWERED}', '{normalise.RAISED_AS}{normalise.LOWERED_AS}')"
    bare = f"regexp_replace({folded}, '\\\\(?:{'|'.join(normalise.WRAPPERS)})\\{{([^}}]*)\\}}', '\\1', 'g')"
    plain = f"translate(regexp_replace({bare}, '\\^\\{{([^}}]*)\\}}', '\\1', 'g'), '^{{}}', '')"
    for letters, name in normalise.GREEK.items():
        plain = f"regexp_replace({plain}, '{letters}', '{name}', 'g')"
    return f"lower(trim(regexp_replace(regexp_replace(trim({plain}), '\\s*{normalise.TRAILING_ACRONYM}', ''), '\\s+', ' ', 'g')))"


def _node_id(kind: str, label: str) -> str:
    return f"lower({kind}) || ':' || substr(sha1({norm_label(label)}), 1, 16)"


GRAPH_SQL = f"""
  tuples AS (
    SELECT CAST(l_orderkey AS VARCHAR) AS paper_id, 'part ' || l_partkey || '-' || ({RESIDUE}) // 2 AS subject, r AS relation,
      'obj ' || l_suppkey || '-' || l_linenumber || '-' || ({RESIDUE}) // 2 || CASE WHEN r = 'assumes' AND l_suppkey % 3 = 0 THEN ' known horizon' ELSE '' END AS object,
      l_returnflag || ' ' || l_linestatus || CASE WHEN l_suppkey % 5 = 0 THEN ' improves accuracy' ELSE '' END AS evidence,
      round(1 - l_discount, 2) AS confidence,
      concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d'), l_quantity, l_extendedprice) AS seq
    FROM (SELECT *, ({RELATIONS})[CAST((l_partkey + 3 * l_linenumber + l_suppkey) % 10 AS INTEGER) + 1] AS r
          FROM lineitem WHERE {RESIDUE} % 2 = 0)),
  listed AS (
    SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS paper_id, CASE WHEN l_linenumber % 2 = 1 THEN 'FailureCondition' ELSE 'Limitation' END AS type,
      'obj ' || l_suppkey || '-' || l_linenumber || '-' || ({RESIDUE}) // 2 AS label
    FROM lineitem WHERE {RESIDUE} % 2 = 1),
  typed AS (
    SELECT *, {_TYPES} AS ot, CASE WHEN relation = 'contradicts' THEN 'Claim' ELSE 'Method' END AS st FROM tuples),
  ends AS (
    SELECT {_node_id("st", "subject")} AS id, st AS type, subject AS label, paper_id FROM typed
    UNION ALL SELECT {_node_id("ot", "object")}, ot, object, paper_id FROM typed
    UNION ALL SELECT {_node_id("type", "label")}, type, label, paper_id FROM listed
    UNION ALL SELECT 'paper:' || paper_id, 'Paper', paper_id, paper_id FROM listed),
  np AS (SELECT DISTINCT id, type, paper_id FROM ends),
  nodes AS (SELECT id, type, min(label) AS label, list_sort(list(DISTINCT paper_id)) AS papers FROM ends GROUP BY id, type),
  raw AS (
    SELECT {_node_id("st", "subject")} AS source, {_node_id("ot", "object")} AS target, relation, paper_id, evidence,
      arg_max(confidence, seq) AS confidence FROM typed GROUP BY source, target, relation, paper_id, evidence
    UNION ALL SELECT 'paper:' || paper_id, {_node_id("type", "label")}, 'mentions', paper_id, '', 1.0 FROM listed),
  edges AS (
    SELECT source, target, relation, list_sort(list(DISTINCT paper_id)) AS papers, max(confidence) AS confidence, count(*) AS support_count,
      array_to_string(list_sort(list(DISTINCT evidence)), ' ') AS evidence
    FROM raw GROUP BY source, target, relation)"""
