"""The registered queries of the corpus operators, each over its whole table, and the SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_pairs import byte_pair_digests
from .common import crc_mod, documents
from .exact_dedup import exact_dedup
from .fingerprint import edited_fingerprints
from .language_id import language_id
from .licenses import license_scan
from .licenses import oracle_sql as license_sql
from .middle import middle_digests
from .middle import oracle_sql as middle_sql
from .near_dedup import near_duplicates
from .packing import Limits, pack_documents
from .quality import quality_scores
from .ranked_ties import oracle_sql as ranks_sql
from .ranked_ties import sale_line_ranks
from .secrets import secret_scan
from .sentence_pieces import sentence_pieces
from .suffix_dedup import suffix_dedup


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces(documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").withColumnRenamed("quality", "label")
    return quality_scores(documents(spark, sf_dir), labels, crc_mod("doc_id", 5) == 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir), crc_mod("doc_id", 4) == 2)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=4, percent=80)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four segments and 832 loss-bearing tokens a sequence at most; a quarter of every document is context without loss."""
    return pack_documents(documents(spark, sf_dir), limits=Limits(1024, 4, 832), context=0.25)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))


def op11_ranked_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_line_ranks(spark.read.parquet(f"{sf_dir}/sale_lines.parquet"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_digests(documents(spark, sf_dir))


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pair_digests(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentence_pieces": op1_sentence_pieces,
    "op2_license_scan": op2_license_scan,
    "op3_quality": op3_quality,
    "op4_language_id": op4_language_id,
    "op5_near_dedup": op5_near_dedup,
    "op6_packing": op6_packing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_fingerprints": op8_fingerprints,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_ranked_ties": op11_ranked_ties,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_byte_pairs": op13_byte_pairs,
}

ORACLE_SQL: dict[str, str] = {
    "op11_ranked_ties": ranks_sql(),
    "op12_fill_in_middle": middle_sql(),
    "op2_license_scan": license_sql(),
    "op7_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
          FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
          count(*) OVER (PARTITION BY text_sha256) AS group_size,
          doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM n""",
}
