"""Readers: JSON lines, CSV, BibTeX, text, local corpora and merged seed folders."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.text import squash


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines file; malformed lines raise, or are left out if not ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def completed_ids(spark: SparkSession, done: str, failed: str | None, key: str) -> DataFrame:
    """Distinct ids of finished rows and, if given, of the failures' log; a half-written last line is skipped."""
    out = None
    for path in filter(None, (done, failed)):
        rows = json_lines(spark, path, f"{key} string", strict=False).where(F.col(key).isNotNull()).select(key)
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header, names in lower case."""
    rows = spark.read.option("header", True).csv(path)
    return rows.toDF(*[c.strip().lower() for c in rows.columns])


def scores_csv(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """(key, value) of the rows whose value is a number."""
    return csv_table(spark, path).select(key, F.col(value).try_cast("double").alias(value)).where(F.col(value).isNotNull())


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of files; undecodable bytes become replacement characters."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _bib_field(entry: Column, name: str) -> Column:
    return squash(F.regexp_replace(F.regexp_extract(entry, rf"(?is)\b{name}\s*=\s*[{{\"](.*?)[}}\"]\s*(?:,|\n|$)", 1), "[{}]", ""))


def bibtex(texts: DataFrame) -> DataFrame:
    """(key, title, authors, year, venue, doi) of the entries in (text); entries without a title are left out."""
    entries = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?s)(@\w+\s*\{[^@]*)"), F.lit(1))).alias("e"))
    e = F.col("e")
    return entries.select(
        F.regexp_extract(e, r"@\w+\s*\{\s*([^,\s]+)", 1).alias("key"),
        _bib_field(e, "title").alias("title"),
        F.filter(F.split(_bib_field(e, "author"), r"\s+and\s+"), lambda a: a != "").alias("authors"),
        F.regexp_extract(e, r"(?i)\byear\s*=\s*[{\"]?(\d{4})", 1).try_cast("int").alias("year"),
        F.coalesce(F.nullif(_bib_field(e, "booktitle"), F.lit("")), F.nullif(_bib_field(e, "journal"), F.lit(""))).alias("venue"),
        _bib_field(e, "doi").alias("doi"),
    ).where("title <> ''")


SEED = "seed_paper_id string, title string, abstract string, year int, arxiv_id string, openreview_id string, doi string"


def seeds(spark: SparkSession, folder: str, minimum: int = 0) -> DataFrame:
    """Seed papers of a folder's .jsonl, .csv and .bib files: id by the first of several keys, one row for each id, first source first."""
    names = sorted(os.listdir(folder))  # the driver's configuration folder, not data
    cols = [c.split()[0] for c in SEED.split(", ")]
    parts = []
    for rank, suffix in enumerate((".jsonl", ".csv", ".bib")):
        paths = [os.path.join(folder, n) for n in names if n.endswith(suffix)]
        for p in paths:
            if suffix == ".jsonl":
                rows = json_lines(spark, p, SEED, strict=False)
            elif suffix == ".csv":
                rows = csv_table(spark, p)
            else:
                rows = bibtex(whole_texts(spark, p))
            have = [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in cols]
            parts.append(rows.select(*have, F.lit(rank).alias("rank"), F.lit(suffix[1:]).alias("source")))
    if not parts:
        raise ValueError(f"no seed files in {folder}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    slug = F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-")
    out = out.where(blank("title").isNotNull()).withColumn(
        "seed_paper_id", F.coalesce(blank("seed_paper_id"), blank("arxiv_id"), blank("openreview_id"), blank("doi"), slug)
    )
    firsts = F.min_by(F.struct(*cols[1:], "source"), F.struct("rank", "title")).alias("s")
    out = out.groupBy("seed_paper_id").agg(firsts).select("seed_paper_id", "s.*")
    if minimum and out.count() < minimum:
        raise ValueError(f"fewer than {minimum} seed papers in {folder}")
    return out


#: Fields that a local corpus record needs.
REQUIRED = ("paper_id", "title", "authors", "year", "source")


def local_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of a local corpus; records that lack a field or a text path are an error that names them."""
    schema = "paper_id string, title string, authors string, year int, source string, text_path string, pdf_path string, abstract string"
    rows = json_lines(spark, path, schema)
    lacking = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in REQUIRED], F.when(F.coalesce("text_path", "pdf_path").isNull(), F.lit("text_path"))))
    bad = rows.select("paper_id", lacking.alias("lacking")).where(F.size("lacking") > 0).limit(5).collect()
    if bad:
        raise ValueError("incomplete records: " + "; ".join(f"{r['paper_id']}: {', '.join(r['lacking'])}" for r in bad))
    is_list = F.col("authors").startswith("[")
    return rows.withColumn("authors", F.when(is_list, F.from_json("authors", "array<string>")).otherwise(F.array("authors")))
