"""Corpus pipeline: language ID, exact dedup, near-duplicate removal, secret redaction, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of documents.

* language: rows without a recognised language go (null text, no letter, or ``ENOUGH`` n-grams of which no learned language's filter holds any, after
  correction); shorter texts are kept, and so is every text if no language could be learned; ``lang`` is not touched;
* exact: of equal texts (after white-space normalisation) the row with the least doc_id stays;
* near: of near-duplicates (five-word shingles, similarity 0.8 or more) the row with the least doc_id stays;
* secrets: found spans are replaced in the text, ``n_chars`` follows; no row goes;
* packing: one row for each piece of a document in a sequence.

Rows with a null doc_id pass the dedup stages.  Rows that repeat a doc_id and its text are one document, of which the exact stage leaves one row;
other rows that repeat a doc_id share its decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import Tables, crc_mod, small_batches
from lacuna.llm.exact_dedup import exact_dedup
from lacuna.llm.language_id import fit, predict
from lacuna.llm.near_dedup import near_duplicates, only_ids
from lacuna.llm.packing import pack_documents
from lacuna.llm.secrets import redact


def _without(spark: SparkSession, docs: DataFrame, decisions: DataFrame, goes: Column) -> DataFrame:
    """``docs`` without the documents whose decision says so; the decisions are computed once, in a table."""
    gone = Tables(spark, "stage").write(decisions.where(goes & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "gone")
    return only_ids(docs, gone, "doc_id", "left_anti").select(*docs.columns)


#: N-grams after which a text without evidence for any language is rejected.
ENOUGH = 32


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is not recognised."""
    small_batches(spark)
    model = fit(docs.where(crc_mod("doc_id", 4) != 2))
    kept = docs.where(F.col("text").isNotNull())
    if not model.languages:
        return kept
    rejected = (F.col("lang_pred") == "und") | ((F.col("n_grams") >= ENOUGH) & (F.col("evidence") == 0))
    return _without(spark, kept, predict(docs, model), rejected)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without all but the first of equal documents, and without rows that repeat an id and its text."""
    kept = _without(spark, docs, exact_dedup(docs), ~F.col("kept"))
    counts = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    again = Tables(spark, "stage").write(counts.where("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    once = only_ids(kept, again, "doc_id").dropDuplicates(["doc_id", "text"])  # only these rows are shuffled
    return only_ids(kept, again, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without all but the first of every near-duplicate component."""
    return _without(spark, docs, near_duplicates(docs), ~F.col("kept"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced."""
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences."""
    return pack_documents(docs)


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("secret scan", secrets), ("packing", packing)]

ORACLE_SQL = None  # the classifier, the field and the packing are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Tables(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
