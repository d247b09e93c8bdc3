"""Evolution, selection and retrieval-run queries over the tables in those roles, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import evolution, retrieval_run, selection
from lacuna.plans.extraction_queries import _pick, _sql_list, _sql_pick
from lacuna.plans.views import table
from lacuna.sources import connectors

_OPS = list(evolution.MUTATIONS)
_MOTIFS = ["shared_failure_condition", "", "unresolved_tradeoff"]
_GAPS = ["Robust estimation fails under drift", "Known horizon is assumed everywhere", "Sparse evaluation of older methods"]
_TARGETS = ["drift", "", "older methods", "new domains"]
_SCOPES = ["Motif type: sparse; two papers", "", "within labs; x"]


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of orders by every mutation: scores and texts."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), *[((k * (i + 3)) % 100 / 100.0).alias(s) for i, s in enumerate(evolution.SCORES)], F.lit("here").alias("scope"), _pick(_TARGETS, k).alias("target"),
        _pick(["insufficient evidence", "m"], k).alias("mechanism"), _pick(_GAPS, k).alias("problem_statement"),
    )
    out = evolution.mutated(rows, 1, _pick(_OPS, k_id := F.col("id")))
    return out.select("id", "operator", *[F.round(s, 6).alias(s) for s in evolution.SCORES], "scope", "target", "mechanism", F.sha1("problem_statement").alias("statement")).where(k_id.isNotNull())


def lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage of children of two parents."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    roots = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("r"), k % 9), F.concat(F.lit("r"), c % 9), F.lit("")))
    gaps = F.when(k % 12 == 0, F.array(F.lit(""))).otherwise(F.array(F.concat(F.lit("g"), k % 7), F.concat(F.lit("g"), c % 5)))
    got = evolution.combined_lineage(F.lit("crossover"), roots, gaps, F.array(_pick(_MOTIFS, k), _pick(_MOTIFS, c)))
    rows = table(spark, sf_dir, "orders").select(k, got.alias("l"))
    return rows.select("o_orderkey", "l.origin_signature", "l.primary_origin_signature", F.array_join("l.root_origin_signatures", ",").alias("roots"), "l.lineage_invalid")


def problem_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    papers = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (k % 4).cast("int"))
    text = evolution.problem_statement(_pick(_GAPS, k), _pick(_TARGETS, k), _pick(_SCOPES, k), papers)
    return table(spark, sf_dir, "orders").groupBy(text.alias("statement")).agg(F.count(F.lit(1)).alias("n"))


def evidence_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of an order's lines, without repeats of paper and text, in line order."""
    e = F.struct((F.col("l_suppkey") % 3).cast("string").alias("paper_id"), F.col("l_returnflag").alias("evidence_text"), F.col("l_linenumber").alias("n"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", e.alias("e")))).alias("x"))
    out = evolution.distinct_evidence(F.transform("x", lambda v: v["e"]))
    return rows.select("l_orderkey", F.array_join(F.transform(out, lambda v: F.concat_ws("-", v["paper_id"], v["evidence_text"])), ";").alias("evidence"))


def impossibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("evidence_text"), F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("doc_id") % 3).cast("int")).alias("supporting_papers"), _pick(["KEEP", "MAYBE"], F.col("doc_id")).alias("review_label"))
    return evolution.reviewed(rows, ("license", "apache", "token")).select("doc_id", "impossibility_risk", "review_label")


def spaced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty orders at even steps of a seeded order; a sampling operator, so without SQL."""
    return selection.evenly_spaced(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), 20, 7)


# --- retrieval ---


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as results: six queries in order, two sources each."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        (k % 6).cast("int").alias("query"), _pick(["arxiv", "openalex"], k).alias("source"), k.alias("id"), F.substring_index("text", "\n", 1).alias("title"), "lang"
    )


def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the queries that were asked before the limit was reached, by query and source."""
    rows = retrieval_run.collected(_results(spark, sf_dir), 400)
    return rows.groupBy("query", "source").agg(F.count(F.lit(1)).alias("n"))


def retrieval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined scores after embedding, sources and citations, and after the second model on the first hundred."""
    i = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(i.alias("id"), (i % 13 / 2.0).alias("metadata_score"), (i % 3 + 1).alias("n_sources"), F.when(i % 5 != 0, i * 7).alias("citation_count"), "embedding")
    first = retrieval_run.reranked(rows, [0.125] * 64)
    second = retrieval_run.cross_reranked(first, (F.col("id") % 17) / 10.0, 100)
    return second.select("id", F.round("combined_score", 4).alias("combined_score"), "place")


def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest reasons why records were rejected."""
    from lacuna.operators.retrieval import relevance
    from lacuna.plans.corpus_queries import ANCHOR, NEGATIVE, POSITIVE, _docs

    intent = retrieval_run.retrieval.Intent(POSITIVE, ANCHOR, NEGATIVE, ["en"], ["de"])
    return retrieval_run.top_reasons(relevance(_docs(spark, sf_dir), intent), 8)


def in_scan_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of allowed categories from a year on that name an anchor term; and those whose title or text hits enough phrases."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"), F.array("lang", "source").alias("categories"), (2000 + F.col("doc_id") % 26).alias("year"))
    anchored = retrieval_run.in_scan(["en", "fr", *[f"src{i}" for i in range(10)]], 2010, ["the", "une"])
    hits = retrieval_run.phrase_hit(["license", "token", "apache"], 2)
    return d.select("doc_id", anchored.alias("in_scan"), hits.alias("phrase_hit"))


def semantic_scholar_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search responses in one connector's shape, parsed."""
    k = F.col("o_orderkey")
    ids = F.when(k % 3 == 0, F.concat(F.lit(', "externalIds": {"DOI": "10.1/'), k, F.lit('"}'))).when(k % 3 == 1, F.concat(F.lit(', "externalIds": {"ArXiv": "2401.'), k, F.lit('"}'))).otherwise("")
    body = F.concat(F.lit('{"paperId": "s'), k, F.lit('", "title": "'), F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit(" T"), k)), F.lit('"'), ids, F.when(k % 2 == 0, F.lit(', "year": 2001')).otherwise(', "publicationDate": "1999-05-06"'),
                    F.lit(', "authors": [{"name": "A B"}, {"name": "C"}], "venue": "V", "publicationVenue": '), F.when(k % 5 == 0, '{"name": "W"}').otherwise("null"), F.lit(', "citationCount": '), k % 40, F.lit("}"))
    got = connectors.semantic_scholar(table(spark, sf_dir, "orders").select(body.alias("body"), F.lit("q").alias("query")))
    return got.select("paper_id", "title", "year", "venue", F.array_join("authors", ";").alias("authors"), F.coalesce("doi", F.lit("")).alias("doi"), F.coalesce("arxiv_id", F.lit("")).alias("arxiv_id"), "citation_count")


def openalex_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works in the other connector's shape: abstracts come from inverted indexes."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"id": "https://openalex.org/W'), k, F.lit('", "title": "T'), k, F.lit('", "doi": '), F.when(k % 2 == 0, F.concat(F.lit('"https://doi.org/10.2/'), k, F.lit('"'))).otherwise("null"),
                    F.lit(', "publication_year": 2010, "abstract_inverted_index": {"we": [0, 3], "study": [1], "w'), k % 7, F.lit('": [2]}, "authorships": [{"author": {"display_name": "X"}}], "concepts": [{"display_name": "Math"}], "cited_by_count": 4}'))
    got = connectors.openalex(table(spark, sf_dir, "orders").select(body.alias("body"), F.lit("q").alias("query")))
    return got.select("paper_id", "title", "abstract", F.coalesce("doi", F.lit("")).alias("doi"), "openalex_id", F.array_join("fields_of_study", ";").alias("fields"))


# --- DuckDB ---

_DELTA = {s: " + ".join(["0.0"] + [f"CASE WHEN op = '{n}' THEN {d} ELSE 0 END" for n, (t, d) in evolution.MUTATIONS.items() if t == s]) for s in evolution.SCORES}


def _text_sql(name: str, x: str) -> str:
    arms = " ".join(f"WHEN '{n}' THEN '{f.split('{}')[0]}' || {x} || '{f.split('{}')[1]}'" for n, f in evolution.TEXTS[name].items())
    return f"CASE op {arms} ELSE {x} END"


ORACLE_SQL = {
    "mutations": f"""WITH v AS (SELECT o_orderkey AS k, {_sql_pick(_OPS, 'o_orderkey')} AS op, {_sql_pick(_TARGETS, 'o_orderkey')} AS target, {_sql_pick(['insufficient evidence', 'm'], 'o_orderkey')} AS mech, {_sql_pick(_GAPS, 'o_orderkey')} AS st FROM orders)
        SELECT k AS id, op AS operator, {', '.join(f"round(CAST(least(1.0::DOUBLE, (k * {i + 3}) % 100 / 100.0::DOUBLE + {_DELTA[s]}) AS DOUBLE), 6) AS {s}" for i, s in enumerate(evolution.SCORES))}, {_text_sql('scope', "'here'")} AS scope, {_text_sql('target', 'target')} AS target,
          CASE WHEN op = 'add_mechanism' AND mech = 'insufficient evidence' THEN '{evolution.NO_MECHANISM}' ELSE {_text_sql('mechanism', 'mech')} END AS mechanism, sha1({_text_sql('problem_statement', 'st')}) AS statement FROM v""",
    "lineages": f"""WITH v AS (SELECT o_orderkey AS k, list_sort(list_distinct(list_filter([{_sql_pick(_MOTIFS, 'o_orderkey')}, {_sql_pick(_MOTIFS, 'o_custkey')}], lambda x: x <> ''))) AS m, CASE WHEN o_orderkey % 12 = 0 THEN [] ELSE list_sort(list_distinct(['g' || o_orderkey % 7, 'g' || o_custkey % 5])) END AS g,
          CASE WHEN o_orderkey % 4 = 0 THEN [] ELSE list_sort(list_distinct(['r' || o_orderkey % 9, 'r' || o_custkey % 9])) END AS r0 FROM orders), w AS (SELECT *, CASE WHEN len(r0) > 0 THEN r0 ELSE list_transform(g, lambda x: 'recovered:' || x) END AS r FROM v)
        SELECT k AS o_orderkey, 'synth[' || CASE WHEN len(m) > 0 THEN array_to_string(m, '+') ELSE 'unknown' END || ']:' || substr(sha1('crossover|' || array_to_string(r, ',') || '|' || array_to_string(g, ',') || '|' || array_to_string(m, ',')), 1, 10) AS origin_signature,
          coalesce(r[1], '') AS primary_origin_signature, array_to_string(r, ',') AS roots, len(r) = 0 AS lineage_invalid FROM w""",
    "problem_statements": f"""WITH v AS (SELECT {_sql_pick(_GAPS, 'o_orderkey')} AS g, {_sql_pick(_TARGETS, 'o_orderkey')} AS t, {_sql_pick(['sparse', '', 'within labs'], 'o_orderkey')} AS h, o_orderkey % 4 AS p FROM orders)
        SELECT 'Investigate: ' || g || ' — ' || CASE WHEN t = '' OR contains(lower(g), t) THEN CASE WHEN h <> '' THEN 'within ' || h ELSE 'across the evaluated corpus' END ELSE 'targeting ' || t END
          || CASE WHEN least(p, 3) > 0 THEN ' (attested in ' || least(p, 3) || ' paper(s))' ELSE '' END || '.' AS statement, count(*) AS n FROM v GROUP BY 1""",
    "evidence_distinct": """WITH r AS (SELECT l_orderkey, (l_suppkey % 3) || '-' || l_returnflag AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem),
        f AS (SELECT l_orderkey, e, min(n) AS n FROM r GROUP BY 1, 2) SELECT l_orderkey, string_agg(e, ';' ORDER BY n) AS evidence FROM f GROUP BY 1""",
    "impossibility": f"""WITH v AS (SELECT doc_id, CAST(contains(lower(text), 'license') AS INTEGER) + CAST(contains(lower(text), 'apache') AS INTEGER) + CAST(contains(lower(text), 'token') AS INTEGER) AS h, doc_id % 3 AS p, {_sql_pick(['KEEP', 'MAYBE'], 'doc_id')} AS l FROM documents)
        SELECT doc_id, CASE WHEN h >= 2 THEN 1.0 WHEN h = 1 THEN 0.7 ELSE 0.0 END::DOUBLE AS impossibility_risk, CASE WHEN h >= 1 THEN 'DROP_IMPOSSIBLE' WHEN least(p, 2) <= 1 AND l = 'KEEP' THEN 'DROP_TOO_SINGLE_PAPER_FRAGILE' ELSE l END AS review_label FROM v""",
    "collected": """WITH c AS (SELECT doc_id % 6 AS q, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT q, coalesce(sum(n) OVER (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
        SELECT CAST(doc_id % 6 AS INTEGER) AS query, CASE WHEN doc_id % 2 = 0 THEN 'arxiv' ELSE 'openalex' END AS source, count(*) AS n FROM documents JOIN b ON q = doc_id % 6 WHERE before < 400 GROUP BY 1, 2""",
    "retrieval_scores": """WITH v AS (SELECT vec_id AS id, round(vec_id % 13 / 2.0::DOUBLE + 12 * list_dot_product(embedding::DOUBLE[], list_transform(range(64), lambda x: 0.125::DOUBLE)) + CASE WHEN vec_id % 3 + 1 > 1 THEN 1 ELSE 0 END
          + CASE WHEN vec_id % 5 <> 0 AND vec_id > 0 THEN least(log10(vec_id * 7 + 1), 3) ELSE 0 END, 4) AS c FROM embeddings), r AS (SELECT *, row_number() OVER (ORDER BY c DESC, id) AS p FROM v),
        s AS (SELECT id, p, CASE WHEN p <= 100 THEN round(c + 2 * (id % 17) / 10.0::DOUBLE, 4) ELSE c END AS c FROM r)
        SELECT id, c AS combined_score, CASE WHEN p <= 100 THEN row_number() OVER (PARTITION BY p <= 100 ORDER BY c DESC, p) ELSE p END AS place FROM s""",
    "in_scan_filters": f"""SELECT doc_id, doc_id % 26 >= 10 AND list_contains({_sql_list(['en', 'fr', *[f'src{i}' for i in range(10)]])}, lang) AND list_contains({_sql_list(['en', 'fr', *[f'src{i}' for i in range(10)]])}, source)
          AND (contains(lower(split_part(text, chr(10), 1) || ' ' || text), 'the') OR contains(lower(split_part(text, chr(10), 1) || ' ' || text), 'une')) AS in_scan,
        contains(lower(split_part(text, chr(10), 1)), 'license') OR contains(lower(split_part(text, chr(10), 1)), 'token') OR contains(lower(split_part(text, chr(10), 1)), 'apache')
          OR CAST(contains(lower(text), 'license') AS INTEGER) + CAST(contains(lower(text), 'token') AS INTEGER) + CAST(contains(lower(text), 'apache') AS INTEGER) >= 2 AS phrase_hit FROM documents""",
    "semantic_scholar_records": """SELECT CASE o_orderkey % 3 WHEN 0 THEN 'doi:10.1/' || o_orderkey WHEN 1 THEN 'arxiv:2401.' || o_orderkey ELSE 's2:s' || o_orderkey END AS paper_id, 'T' || o_orderkey AS title, CASE WHEN o_orderkey % 2 = 0 THEN 2001 ELSE 1999 END AS year,
        CASE WHEN o_orderkey % 5 = 0 THEN 'W' ELSE 'V' END AS venue, 'A B;C' AS authors, CASE WHEN o_orderkey % 3 = 0 THEN '10.1/' || o_orderkey ELSE '' END AS doi, CASE WHEN o_orderkey % 3 = 1 THEN '2401.' || o_orderkey ELSE '' END AS arxiv_id, o_orderkey % 40 AS citation_count FROM orders WHERE o_orderkey % 11 <> 0""",
    "openalex_records": """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'doi:10.2/' || o_orderkey ELSE 'openalex:W' || o_orderkey END AS paper_id, 'T' || o_orderkey AS title, 'we study w' || o_orderkey % 7 || ' we' AS abstract, CASE WHEN o_orderkey % 2 = 0 THEN '10.2/' || o_orderkey ELSE '' END AS doi,
        'W' || o_orderkey AS openalex_id, 'Math' AS fields FROM orders""",
}


def _reasons_sql() -> str:
    from lacuna.plans.corpus_queries import ORACLE_SQL as corpus

    return f"SELECT reason, count(*) AS n FROM ({corpus['relevance_score']}) WHERE NOT keep GROUP BY 1 ORDER BY n DESC, reason LIMIT 8"


ORACLE_SQL["rejection_reasons"] = _reasons_sql().replace("SELECT reason,", "SELECT CASE WHEN reason = '' THEN 'below_threshold' ELSE reason END AS reason,").replace("ORDER BY n DESC, reason", "ORDER BY n DESC, 1")

QUERIES = {
    f.__name__: f
    for f in (
        mutations, lineages, problem_statements, evidence_distinct, impossibility, spaced_sample, collected, retrieval_scores, rejection_reasons, in_scan_filters,
        semantic_scholar_records, openalex_records,
    )
}
