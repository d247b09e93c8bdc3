"""Paper sources: a pluggable data source over any search function, and parsers of the known services' responses.

Responses are JSON texts (column ``body``) with the query that gave them, so saved ones parse like fresh ones and nothing here needs a network.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Columns of a retrieved record.
RECORD = (
    "paper_id", "title", "abstract", "authors", "year", "published_date", "venue", "arxiv_id", "semantic_scholar_id", "openalex_id", "doi", "url", "pdf_url", "citation_count",
    "fields_of_study", "categories", "source_names", "retrieval_queries", "retrieval_backend",
)
# Venues by group: display name and group id.
VENUES = {
    "top_ml": (
        ("ICLR 2025", "ICLR.cc/2025/Conference"), ("NeurIPS 2024", "NeurIPS.cc/2024/Conference"), ("ICML 2024", "ICML.cc/2024/Conference"), ("ICLR 2024", "ICLR.cc/2024/Conference"),
        ("NeurIPS 2023", "NeurIPS.cc/2023/Conference"), ("ICML 2023", "ICML.cc/2023/Conference"), ("ICLR 2023", "ICLR.cc/2023/Conference"), ("NeurIPS 2022", "NeurIPS.cc/2022/Conference"),
        ("ICML 2022", "ICML.cc/2022/Conference"), ("ICLR 2022", "ICLR.cc/2022/Conference"), ("TMLR", "TMLR"), ("AISTATS 2024", "AISTATS.cc/2024/Conference"),
        ("AISTATS 2023", "AISTATS.cc/2023/Conference"), ("UAI 2024", "UAI.cc/2024/Conference"), ("UAI 2023", "UAI.cc/2023/Conference"),
    ),
    "top_nlp": (
        ("ACL 2024", "aclanthology.org/2024.acl-long"), ("EMNLP 2024", "aclanthology.org/2024.emnlp-main"), ("NAACL 2024", "aclanthology.org/2024.naacl-long"),
        ("EACL 2024", "aclanthology.org/2024.eacl-long"), ("COLM 2024", "aclanthology.org/2024.colm-main"), ("ACL 2023", "aclanthology.org/2023.acl-long"), ("EMNLP 2023", "aclanthology.org/2023.emnlp-main"),
    ),
    "top_cv": (("CVPR 2024", "CVPR.cc/2024/Conference"), ("CVPR 2023", "CVPR.cc/2023/Conference")),
    "top_ir": (),
}


def venues(mode: str, custom: list[str] | None = None) -> list[tuple[str, str]]:
    """(name, group id) of a mode's venues; custom names match any part of a name or id, and stand for themselves if nothing matches."""
    if mode == "a_star":
        return [v for k in ("top_ml", "top_nlp", "top_cv") for v in VENUES[k]]
    if mode != "custom":
        return list(VENUES.get(mode, VENUES["top_ml"]))
    every = [v for group in VENUES.values() for v in group]
    found = [v for name in custom or [] for v in every if name.lower() in v[0].lower() or name.lower() in v[1].lower()]
    return found or [(n, n) for n in custom or []]


def _record(parsed: DataFrame, values: dict[str, Column]) -> DataFrame:
    none = F.lit(None).cast("string")
    lists = ("authors", "fields_of_study", "categories", "source_names", "retrieval_queries")
    empty = F.array().cast("array<string>")
    return parsed.select(*[values.get(c, empty if c in lists else F.lit(None).cast("long") if c in ("year", "citation_count") else none).alias(c) for c in RECORD]).where("title <> ''")


def semantic_scholar(responses: DataFrame) -> DataFrame:
    """Records from search items: ids in the order DOI, arXiv, own; the year from the date where it is missing; items without a title are left out."""
    schema = (
        "paperId string, title string, abstract string, year long, publicationDate string, venue string, publicationVenue struct<name:string>, externalIds struct<ArXiv:string,DOI:string,OpenAlex:string>,"
        "openAccessPdf struct<url:string>, authors array<struct<name:string>>, citationCount long, fieldsOfStudy array<string>, url string"
    )
    p = responses.select(F.from_json("body", schema).alias("i"), "query")
    c = F.col
    empty = F.array().cast("array<string>")
    paper = F.coalesce(F.concat(F.lit("doi:"), c("i.externalIds.DOI")), F.concat(F.lit("arxiv:"), c("i.externalIds.ArXiv")), F.concat(F.lit("s2:"), F.coalesce(c("i.paperId"), F.lit(""))))
    return _record(p, {
        "paper_id": paper, "title": F.trim(F.coalesce(c("i.title"), F.lit(""))), "abstract": F.coalesce(c("i.abstract"), F.lit("")), "authors": F.coalesce(F.transform("i.authors", lambda a: F.coalesce(a["name"], F.lit(""))), empty),
        "year": F.coalesce(c("i.year"), F.substring(c("i.publicationDate"), 1, 4).try_cast("long")), "published_date": F.coalesce(c("i.publicationDate"), F.lit("")),
        "venue": F.coalesce(F.nullif(c("i.publicationVenue.name"), F.lit("")), c("i.venue")), "arxiv_id": c("i.externalIds.ArXiv"), "semantic_scholar_id": c("i.paperId"), "openalex_id": c("i.externalIds.OpenAlex"), "doi": c("i.externalIds.DOI"),
        "url": c("i.url"), "pdf_url": F.coalesce(c("i.openAccessPdf.url"), F.lit("")), "citation_count": c("i.citationCount"), "fields_of_study": F.coalesce(c("i.fieldsOfStudy"), empty),
        "source_names": F.array(F.lit("semantic_scholar")), "retrieval_queries": F.array("query"), "retrieval_backend": F.lit("semantic_scholar"),
    })


def abstract_of(index: Column) -> Column:
    """Text from a map of words to their places."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " "), F.lit(""))


def openalex(responses: DataFrame) -> DataFrame:
    """Records from works: the short id, the DOI without its resolver, the abstract from its inverted index."""
    schema = (
        "id string, title string, doi string, publication_year long, publication_date string, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>,"
        "concepts array<struct<display_name:string>>, open_access struct<oa_url:string>, best_oa_location struct<pdf_url:string>, cited_by_count long"
    )
    p = responses.select(F.from_json("body", schema).alias("i"), "query")
    c = F.col
    empty = F.array().cast("array<string>")
    short = F.element_at(F.split(F.coalesce(c("i.id"), F.lit("")), "/"), -1)
    doi = F.nullif(F.regexp_replace(F.coalesce(c("i.doi"), F.lit("")), "^https://doi\\.org/", ""), F.lit(""))
    return _record(p, {
        "paper_id": F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("openalex:"), short)), "title": F.trim(F.coalesce(c("i.title"), F.lit(""))), "abstract": abstract_of(c("i.abstract_inverted_index")),
        "authors": F.coalesce(F.filter(F.transform("i.authorships", lambda a: a["author"]["display_name"]), lambda n: n.isNotNull() & (n != "")), empty), "year": c("i.publication_year"),
        "published_date": F.coalesce(c("i.publication_date"), F.lit("")), "openalex_id": short, "doi": doi, "url": c("i.id"),
        "pdf_url": F.coalesce(F.nullif(c("i.best_oa_location.pdf_url"), F.lit("")), c("i.open_access.oa_url"), F.lit("")), "citation_count": c("i.cited_by_count"),
        "fields_of_study": F.slice(F.coalesce(F.transform("i.concepts", lambda x: x["display_name"]), empty), 1, 10), "source_names": F.array(F.lit("openalex")), "retrieval_queries": F.array("query"), "retrieval_backend": F.lit("openalex"),
    })


def arxiv(responses: DataFrame) -> DataFrame:
    """Records from entries (id, title, summary, authors, categories, published): the id without address and version."""
    schema = "id string, title string, summary string, authors array<string>, categories array<string>, published string, pdf_url string, doi string"
    p = responses.select(F.from_json("body", schema).alias("i"), "query")
    c = F.col
    bare = F.regexp_replace(F.element_at(F.split(F.coalesce(c("i.id"), F.lit("")), "/abs/"), -1), r"v\d+$", "")
    empty = F.array().cast("array<string>")
    return _record(p, {
        "paper_id": F.concat(F.lit("arxiv:"), bare), "title": F.trim(F.regexp_replace(F.coalesce(c("i.title"), F.lit("")), r"\s+", " ")), "abstract": F.coalesce(c("i.summary"), F.lit("")), "authors": F.coalesce(c("i.authors"), empty),
        "year": F.substring(c("i.published"), 1, 4).try_cast("long"), "published_date": c("i.published"), "arxiv_id": bare, "doi": c("i.doi"), "url": c("i.id"), "pdf_url": c("i.pdf_url"), "categories": F.coalesce(c("i.categories"), empty),
        "source_names": F.array(F.lit("arxiv")), "retrieval_queries": F.array("query"), "retrieval_backend": F.lit("arxiv"),
    })


def openreview(responses: DataFrame, wanted: list[str], least: int = 2) -> DataFrame:
    """Records from notes whose title has a phrase or whose abstract has ``least``; one row of each note."""
    schema = "id string, content struct<title:struct<value:string>,abstract:struct<value:string>,authors:struct<value:array<string>>,venue:struct<value:string>>"
    from lacuna.operators.retrieval_run import phrase_hit

    c = F.col
    p = responses.select(F.from_json("body", schema).alias("i"), "query", "body").where("i.id IS NOT NULL")
    p = p.withColumns({"title": F.trim(F.coalesce(c("i.content.title.value"), F.lit(""))), "abstract": F.coalesce(c("i.content.abstract.value"), F.lit(""))})
    p = p.where(phrase_hit(wanted, least)) if wanted else p
    p = p.groupBy(c("i.id").alias("note")).agg(F.min_by(F.struct("i", "title", "abstract"), F.struct("query", "body")).alias("r"), F.array_sort(F.collect_set("query")).alias("queries"))
    empty = F.array().cast("array<string>")
    return _record(p, {
        "paper_id": F.concat(F.lit("openreview:"), "note"), "title": c("r.title"), "abstract": c("r.abstract"), "authors": F.coalesce(c("r.i.content.authors.value"), empty), "venue": c("r.i.content.venue.value"),
        "url": F.concat(F.lit("https://openreview.net/forum?id="), "note"), "source_names": F.array(F.lit("openreview")), "retrieval_queries": c("queries"), "retrieval_backend": F.lit("openreview"),
    })


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"semantic_scholar": semantic_scholar, "openalex": openalex, "arxiv": arxiv}
Search = Callable[[str, int], list[dict]]


def searched(spark: SparkSession, search: Search, queries: list[str], limit: int = 50) -> DataFrame:
    """(body, query, error) of a search function for every query, one partition for each; an error is a row and not the end of the job.

    The function is sent with the source, so any callable from (query, limit) to items can be one.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(q) for q in queries]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            try:
                for item in search(partition.value, limit)[:limit]:
                    yield json.dumps(item), partition.value, None
            except Exception as e:  # one query's failure leaves the others alone
                yield None, partition.value, f"{type(e).__name__}: {e}"

    class Papers(DataSource):
        @classmethod
        def name(cls) -> str:
            return "papers"

        def schema(self) -> str:
            return "body string, query string, error string"

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Papers)
    return spark.read.format("papers").load()


def command(args: list[str], wait: float = 60.0) -> Search:
    """A search function that runs a local program with the query and the limit as last arguments and reads a JSON list from its output."""

    def search(query: str, limit: int) -> list[dict]:
        import subprocess

        done = subprocess.run([*args, query, str(limit)], capture_output=True, text=True, timeout=wait, check=True)
        items = json.loads(done.stdout or "[]")
        if not isinstance(items, list):
            raise ValueError("the program's output is no list")
        return items

    return search


def chosen(config: dict, known: dict[str, Search]) -> list[tuple[str, Search]]:
    """The configuration's backends in its order; without any, all known ones. Unknown names are an error."""
    names = config.get("backends") or list(known)
    missing = [n for n in names if n not in known]
    if missing:
        raise ValueError(f"unknown backends: {', '.join(missing)}")
    return [(n, known[n]) for n in dict.fromkeys(names)]


def first_seen(spark: SparkSession, search: Search, queries: list[str], limit: int, key: str) -> DataFrame:
    """Items of several queries, every key once, with the first query that found it."""
    rank = F.array_position(F.array(*[F.lit(q) for q in queries]), F.col("query"))
    found = searched(spark, search, queries, limit).where("error IS NULL").withColumn("key", F.get_json_object("body", f"$.{key}"))
    return found.where("key IS NOT NULL").groupBy("key").agg(F.min_by(F.struct("body", "query"), rank).alias("r")).select("key", "r.*")
