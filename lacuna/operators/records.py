"""Full merge of retrieved records: one record for each component, every field by its rule.

The first record (by ``place``) gives title, authors, dates, address and backend; names, queries, fields and categories are united and sorted; ids, venue and text
file come from the first record that has one; the abstract is the longest; citations are the largest known; of ids and payloads by source the last record's stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST = ("paper_id", "title", "authors", "year", "published_date", "updated_date", "url", "retrieval_backend")
FILLED = ("pdf_url", "doi", "arxiv_id", "semantic_scholar_id", "openalex_id", "venue")
UNITED = ("source_names", "retrieval_queries", "fields_of_study", "categories")
LARGEST = ("citation_count", "influential_citation_count")
BY_SOURCE = ("source_ids", "raw_source_payloads")


def _last_of(rows: DataFrame, c: str) -> DataFrame:
    """(component, c): a map's entries, the last record's value of each key, keys in order."""
    each = rows.select("component", "place", F.explode(c).alias("k", "v")).groupBy("component", "k").agg(F.max_by("v", "place").alias("v"))
    return each.groupBy("component").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(c))


def merged_records(rows: DataFrame) -> DataFrame:
    """One row for each component of (component, place, ...); columns that the rows lack are left out."""
    has = [c for c in rows.columns]
    filled = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col("place")))
    text = F.coalesce("abstract", F.lit("")) if "abstract" in has else None

    def only(names: tuple[str, ...], of) -> list[Column]:
        return [of(c).alias(c) for c in names if c in has]

    aggs = only(FIRST, lambda c: F.min_by(c, "place")) + only(FILLED, filled) + only(LARGEST, F.max)
    aggs += only(UNITED, lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))))
    if text is not None:
        aggs.append(F.max_by(text, F.struct(F.length(text).alias("n"), (-F.col("place")).alias("p"))).alias("abstract"))
    out = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"), *aggs)
    for c in BY_SOURCE:
        if c in has:
            out = out.join(_last_of(rows, c), "component", "left")
    return out
