"""Queries over documents, pages, embeddings and messages, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import text as T
from lacuna.functions import vectorised
from lacuna.llm.common import small_batches
from lacuna.operators import patterns, retrieval, similarity, text_index
from lacuna.plans.views import table

STOPS = ["with", "that", "this", "from", "were", "have"]
#: Bytes of an Arrow batch of whole texts, of which a Python task has some copies.
TEXT_BATCH = 4 << 20
POSITIVE, ANCHOR, NEGATIVE = ["license", "token", "password"], ["the and", "and the"], ["trash", "stupid"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the first line is the title, the rest the abstract."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.coalesce("text", F.lit("")).alias("abstract"), F.array("lang").alias("fields"),
        (F.col("doc_id") % 3).alias("sources"), (F.col("doc_id") % 50).alias("citations"), (F.col("doc_id") % 2 == 0).alias("is_preprint"),
        (2000 + F.col("doc_id") % 26).alias("year"), F.array("lang", "source").alias("categories"), "source", "text", "lang",
    )


_REC = """rec AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, coalesce(text, '') AS abstract, lang, source, text,
    doc_id % 3 AS sources, doc_id % 50 AS citations, doc_id % 2 = 0 AS is_preprint, 2000 + doc_id % 26 AS year FROM documents)"""


def _n(column: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({column}), '{p}') AS INTEGER)" for p in phrases) + ")"


def relevance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    intent = retrieval.Intent(POSITIVE, ANCHOR, NEGATIVE, ["en"], ["de"])
    return retrieval.relevance(_docs(spark, sf_dir), intent).select("id", F.coalesce("reason", F.lit("")).alias("reason"), F.round("score", 4).alias("score"), "keep")


def facet_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.facet_scores(_docs(spark, sf_dir), ["license", "apache"], ["token", "version"], ["disgusting"], ["en", "src1"], 2005)
    return rows.select("id", F.coalesce("reason", F.lit("")).alias("reason"), "score")


def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("digest", F.sha2("text", 256))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    lead = F.when(F.col("id") % 16 == 4, "http://dx.doi.org/10.1/").otherwise("https://doi.org/10.1/")
    doi = F.when(F.col("id") % 4 == 0, F.concat(lead, (F.col("id") / 8).cast("long"))).otherwise("")
    arxiv = F.when(F.col("id") % 5 == 0, F.concat(F.lit("2401."), (F.col("id") / 10).cast("long"), F.lit("v"), F.col("id") % 3 + 1)).otherwise("")
    return d.select("id", "title", "abstract", doi.alias("doi"), arxiv.alias("arxiv"), "source", "citations")


def _record_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.key_links(_records(spark, sf_dir), {"doi": T.bare_doi("doi"), "arxiv": T.bare_arxiv("arxiv"), "title": T.normalized_title("title")})


def dedup_multikey(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    labels = similarity.components(records.select("id"), _record_links(spark, sf_dir))
    rows = similarity.merged(records, labels)
    return rows.select("component", "n", F.length("abstract").cast("long").alias("abstract_chars"), "sources", "citations", F.coalesce("doi", F.lit("")).alias("doi"))


def near_dup_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.tokens("text").alias("tokens"))
    return similarity.similar_pairs(sets, 0.85).withColumn("similarity", F.round("similarity", 6))


def alias_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _docs(spark, sf_dir).select("id", T.tokens("title", "[a-z0-9]{2,}").alias("tokens"))
    links = similarity.similar_pairs(heads, 0.85)
    return similarity.components(heads.select("id"), links.select("a", "b"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = retrieval.chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    parts = parts.select(F.col("id").alias("paper_id"), F.col("chunk_id").cast("long").alias("chunk_id"), "text")
    return retrieval.bm25(parts, "licensed under the apache license version", 20)


def bm25_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of the documents for every twentieth benchmark text, through the inverted index of these texts' terms."""
    parts = retrieval.chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    asked = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), "text")
    index = text_index.Index.build(parts.select(F.col("id").alias("paper_id"), F.col("chunk_id").cast("long").alias("chunk_id"), "text"), asked=asked)
    return index.search(asked, 10).select(F.col("qid").alias("item_id"), "paper_id", "chunk_id", "score")


def keyphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyphrases(table(spark, sf_dir, "documents"), 40, STOPS).select(F.col("size").cast("int").alias("size"), "phrase", "n")


def anchor_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.anchor_terms(table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("label")), 100)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return rows.select("id", F.col("chunk_id").cast("long").alias("chunk_id"), F.length("text").cast("long").alias("n_chars"), F.sha1("text").alias("digest"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.sections(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), r"^(the|of|was|la|de|die|der|el)(?:[^\p{L}\p{N}_]|$)")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.snippets(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), ["license", "token"], 120)
    return rows.select("id", F.col("at").alias("pos"), F.sha1("snippet").alias("digest"))


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(
        "id", T.stable_id("doc", "id", "source").alias("stable"), T.normalized_title("title").alias("title"), T.token_estimate("text").cast("long").alias("tokens"),
        T.slug("title").alias("slug"), F.size(T.tokens("text")).cast("long").alias("n_tokens"), F.sha2("text", 256).alias("sha256"),
    )


def enum_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.coerced_enum(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")), ["click", "view"], {"purchase": "buy"}, "other")
    return table(spark, sf_dir, "events").groupBy(v.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def confidence_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(T.confidence_from_text("props"), 6).alias("from_text"), F.round(T.clamped_confidence(F.get_json_object("props", "$.k")), 6).alias("clamped")
    )


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.concat(F.lit("note ```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n``` end"))
    k = F.get_json_object(T.repaired_json(wrapped), "$.k").try_cast("long")
    return table(spark, sf_dir, "events").groupBy((k % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.sources import html

    return html.titles(table(spark, sf_dir, "pages")).select("page_id", "title")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.operators import release

    return release.findings(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", "kind", "n")


def blind_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = T.replaced_words("text", {"apache": "SYSTEM", "license": "METHOD", "token": "ITEM"})
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(clean).alias("digest"), (clean != F.col("text")).alias("changed"))


def seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "benchmark").select(T.tokens("text").alias("s")).select(F.explode("s").alias("t")).distinct()
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens("text")).alias("t"))
    marked = rows.join(seeds.withColumn("hit", F.lit(1)), "t", "left").groupBy("doc_id")
    return marked.agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1)), 6).alias("share"))


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark spans of 15 characters or more stand in which documents, both in the reference's form.

    Where a span stands, its interior words are whole words of the text, whatever is glued to its ends.  So spans of six words or more meet the
    documents on their second to fifth word, and a plain search confirms; automata seek the others in every document.
    """
    small_batches(spark, 10_000, TEXT_BATCH)
    four = lambda w, i: F.xxhash64(F.array_join(F.slice(w, i + 1, F.lit(4)), " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = table(spark, sf_dir, "benchmark").where(F.length("text") >= 15).select("item_id", vectorised.span_form("text").alias("span")).where("span <> ''")
    spans = spans.withColumn("w", F.split("span", " "))
    keys = spans.where(F.size("w") >= 6).select("item_id", four(F.col("w"), F.lit(1)).alias("k"))
    d = docs.select("doc_id", F.split(vectorised.span_form("text"), " ").alias("w")).where(F.size("w") >= 4)
    places = d.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 4), lambda i: four(F.col("w"), i)))).alias("k"))
    met = places.join(F.broadcast(keys.select("item_id", "k")) if keys.count() <= 100_000 else keys.select("item_id", "k"), "k").select("item_id", "doc_id").distinct()
    # texts and spans join the pairs that met only
    hits = met.join(docs, "doc_id").join(spans.select("item_id", "span"), "item_id").select("item_id", "doc_id", "span", vectorised.span_form("text").alias("t"))
    few = spans.where(F.size("w") < 6).select(F.col("item_id").alias("key"), F.col("span").alias("pattern"))
    short = patterns.first_places(few, docs.select(F.col("doc_id").alias("id"), vectorised.span_form("text").alias("text"))).select(F.col("key").alias("item_id"), F.col("id").alias("doc_id"))
    return hits.where(F.contains("t", "span")).select("item_id", "doc_id").unionByName(short).distinct()


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closest five others of every vector, among all vectors."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return similarity.nearest(e, 5).select(F.col("id").alias("vec_id"), "other", "rank")


def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("base", (F.col("vec_id") % 7).cast("double"))
    rows = retrieval.rerank(e, [0.125] * 64)
    return rows.select("vec_id", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "vec_id").limit(50)


def mmr_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 11).cast("double").alias("score"), "embedding")
    return retrieval.mmr(e, 20)


_TOK = r"list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]{{{1},}}'))"
_SQ = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_CHUNKS = f"""ch AS (SELECT id, c AS chunk_id, substr(t, c * 1050 + 1, 1200) AS text FROM (SELECT id, t, unnest(range(0, CAST(greatest(0, ceil((length(t) - 1200) / 1050.0)) AS BIGINT) + 1)) AS c
    FROM (SELECT doc_id AS id, {_SQ.format('text')} AS t FROM documents) WHERE t <> ''))"""
_FORM = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(strip_accents({0}), '[^\x00-\x7F]', '', 'g'), '-\s+', '', 'g'), '\s+', ' ', 'g')))"
_ASKED = ["licensed", "under", "the", "apache", "license", "version"]

def _whole(x: str, word: str, by: str) -> str:
    """Whole words replaced; twice, for words that share the character between them."""
    one = lambda y: f"regexp_replace({y}, '(?i)(^|[^A-Za-z0-9_\\-]){word}($|[^A-Za-z0-9_\\-])', '\\1{by}\\2', 'g')"
    return one(one(x))


_SANITISED = _whole(_whole(_whole("text", "apache", "SYSTEM"), "license", "METHOD"), "token", "ITEM")

ORACLE_SQL = {
    "relevance_score": f"""WITH {_REC}, s AS (SELECT *, {_n('title', POSITIVE)} AS pt, {' + '.join(f"CAST(contains(lower(abstract), '{p}') AND NOT contains(lower(title), '{p}') AS INTEGER)" for p in POSITIVE)} AS pa,
        {_n('title', ANCHOR)} AS ta, {_n('abstract', ANCHOR)} AS aa, {_n('title', NEGATIVE)} AS nt, {_n('abstract', NEGATIVE)} AS na, CAST(lang = 'en' AS INTEGER) AS good, CAST(lang = 'de' AS INTEGER) AS off FROM rec),
        r AS (SELECT *, CASE WHEN pt + pa + ta + aa = 0 THEN 'no_positive' WHEN nt > 0 AND pt = 0 THEN 'negative_title'
          WHEN trim(abstract) = '' AND len(list_filter(string_split_regex(title, '\\s+'), lambda x: x <> '')) < 5 THEN 'no_content' ELSE '' END AS reason FROM s),
        v AS (SELECT *, CASE WHEN reason = '' THEN round(CAST(6 * pt + 4 * pa + 4 * least(ta, 2) + 3 * least(aa, 2) + 2 * good + CASE WHEN sources > 1 THEN 1 ELSE 0 END
          + CASE WHEN citations > 0 AND NOT is_preprint THEN least(log10(citations + 1), 3) ELSE 0 END - 7 * nt - 3 * na - 4 * off AS DOUBLE), 4) ELSE 0.0 END AS score FROM r)
        SELECT id, reason, CAST(score AS DOUBLE) AS score, reason = '' AND score >= 6 AS keep FROM v""",
    "facet_score": f"""WITH {_REC}, r AS (SELECT *, CASE WHEN contains(lower(title || ' ' || abstract), 'disgusting') THEN 'excluded' WHEN year < 2005 THEN 'too_old'
        WHEN {_n("title || ' ' || abstract", ['license', 'apache'])} = 0 THEN 'nothing_included' ELSE '' END AS reason FROM rec)
        SELECT id, reason, CASE WHEN reason <> '' THEN -999.0::DOUBLE ELSE round(CAST(least(5, 2.5 * {_n('title', ['license', 'apache'])}) + least(3, 1.5 * {_n('abstract', ['license', 'apache'])})
          + least(4, {_n("title || ' ' || abstract", ['token', 'version'])}) + least(3, 1.5 * (CAST(lang IN ('en', 'src1') AS INTEGER) + CAST(source IN ('en', 'src1') AS INTEGER))) AS DOUBLE), 4) END AS score FROM r""",
    "dedup_exact": "SELECT sha256(text) AS digest, min(doc_id) AS keep_id, count(*) AS n FROM documents GROUP BY 1",
    "dedup_multikey": rf"""WITH RECURSIVE {_REC}, r AS (SELECT id, title, abstract, source, citations, CASE WHEN id % 4 = 0 THEN CASE WHEN id % 16 = 4 THEN 'http://dx.doi.org/10.1/' ELSE 'https://doi.org/10.1/' END || (id // 8) ELSE '' END AS doi,
          CASE WHEN id % 5 = 0 THEN '2401.' || (id // 10) || 'v' || (id % 3 + 1) ELSE '' END AS arxiv FROM rec),
        k AS (SELECT id, 'd' || ltrim(ltrim(lower(trim(doi)), 'https://doi.org/'), 'http://dx.doi.org/') AS key FROM r WHERE doi <> ''
          UNION ALL SELECT id, 'a' || regexp_replace(arxiv, 'v\d+$', '') FROM r WHERE arxiv <> ''
          UNION ALL SELECT id, 't' || t FROM (SELECT id, trim(regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')) AS t FROM r) WHERE t <> ''),
        l AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b USING (key)),
        w AS (SELECT id AS a, id AS c FROM r UNION SELECT l.b, w.c FROM w JOIN l ON l.a = w.a WHERE w.c < l.b),
        c AS (SELECT a AS id, min(c) AS component FROM w GROUP BY a)
        SELECT component, count(*) AS n, max(length(abstract)) AS abstract_chars, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, max(citations) AS citations,
          coalesce(arg_min(doi, id) FILTER (WHERE doi <> ''), '') AS doi FROM r JOIN c USING (id) GROUP BY component""",
    "near_dup_jaccard": f"""WITH s AS (SELECT doc_id AS id, list_sort({_TOK.format('text', 3)}) AS t FROM documents), k AS (SELECT * FROM s WHERE len(t) > 0),
        c AS (SELECT t, min(id) AS id FROM k GROUP BY t), p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) AS n FROM c a JOIN c b
          ON a.id < b.id AND len(a.t) * 100 >= 85 * len(b.t) AND len(b.t) * 100 >= 85 * len(a.t))
        SELECT a, b, round(i / (n - i), 6) AS similarity FROM p WHERE i / (n - i) >= 0.85
        UNION ALL SELECT c.id, k.id, 1.0 FROM k JOIN c USING (t) WHERE k.id <> c.id""",
    "alias_components": f"""WITH RECURSIVE {_REC}, s AS (SELECT id, list_sort({_TOK.format('title', 2)}) AS t FROM rec), c AS (SELECT t, min(id) AS id FROM s WHERE len(t) > 0 GROUP BY t),
        l0 AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.id < b.id AND len(a.t) * 100 >= 85 * len(b.t) AND len(b.t) * 100 >= 85 * len(a.t)
          WHERE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.85 UNION SELECT c.id, s.id FROM s JOIN c USING (t) WHERE s.id <> c.id),
        l AS (SELECT a, b FROM l0 UNION SELECT b, a FROM l0), w AS (SELECT id AS a, id AS c FROM s UNION SELECT l.b, w.c FROM w JOIN l ON l.a = w.a WHERE w.c < l.b)
        SELECT a AS id, min(c) AS component FROM w GROUP BY a""",
    "bm25_topk": f"""WITH {_CHUNKS}, w AS (SELECT id AS paper_id, chunk_id, regexp_extract_all(lower(text), '[a-z0-9]{{3,}}') AS w FROM ch),
        t AS (SELECT paper_id, chunk_id, len(w) AS dl, {', '.join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(_ASKED))} FROM w),
        s AS (SELECT count(*) AS n, avg(dl) AS a, {', '.join(f'count(*) FILTER (WHERE t{i} > 0) AS d{i}' for i in range(len(_ASKED)))} FROM t),
        r AS (SELECT paper_id, chunk_id, {' + '.join(f'ln(1 + (n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) * t{i} * 2.5::DOUBLE / (t{i} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(a, 1)))' for i in range(len(_ASKED)))} AS score FROM t, s),
        f AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, chunk_id) AS k FROM r WHERE score > 0)
        SELECT paper_id, chunk_id, round(score, 6) AS score FROM f WHERE k <= 3 ORDER BY score DESC, paper_id, chunk_id LIMIT 20""",
    "bm25_many": f"""WITH {_CHUNKS}, w AS (SELECT id AS paper_id, chunk_id, regexp_extract_all(lower(text), '[a-z0-9]{{3,}}') AS w FROM ch),
        st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w), p AS (SELECT paper_id, chunk_id, len(w) AS dl, t, count(*) AS tf FROM (SELECT paper_id, chunk_id, w, unnest(w) AS t FROM w) GROUP BY ALL),
        d AS (SELECT t, count(*) AS df FROM p GROUP BY 1), q AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS t FROM benchmark WHERE item_id % 20 = 0) GROUP BY ALL),
        r AS (SELECT item_id, paper_id, chunk_id, round(sum(q * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(a, 1)))), 9) AS score FROM q JOIN d USING (t) JOIN p USING (t), st GROUP BY ALL),
        f AS (SELECT *, row_number() OVER (PARTITION BY item_id, paper_id ORDER BY score DESC, chunk_id) AS k FROM r WHERE score > 0),
        g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, paper_id, chunk_id) AS place FROM f WHERE k <= 3)
        SELECT item_id, paper_id, chunk_id, round(score, 6) AS score FROM g WHERE place <= 10
        UNION ALL SELECT item_id, paper_id, chunk_id, round(1.0::DOUBLE / row_number() OVER (PARTITION BY item_id ORDER BY paper_id, chunk_id), 6)
          FROM (SELECT item_id FROM benchmark WHERE item_id % 20 = 0 AND item_id NOT IN (SELECT item_id FROM q JOIN d USING (t))), (SELECT id AS paper_id, CAST(chunk_id AS BIGINT) AS chunk_id FROM ch ORDER BY 1, 2 LIMIT 10)""",
    "keyphrases": f"""WITH w AS (SELECT list_filter(regexp_extract_all(lower(text), '[a-z]{{4,}}'), lambda x: x NOT IN {tuple(STOPS)}) AS w FROM documents),
        g AS (SELECT 1 AS size, unnest(w) AS phrase FROM w UNION ALL SELECT 2, w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w))
        SELECT CAST(size AS INTEGER) AS size, phrase, count(*) AS n FROM g GROUP BY size, phrase ORDER BY size DESC, n DESC, phrase LIMIT 40""",
    "anchor_terms": "WITH t AS (SELECT unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]{5,}')) AS term FROM part) SELECT term, count(*) AS n FROM t GROUP BY term ORDER BY n DESC, term LIMIT 100",
    "chunks": f"WITH {_CHUNKS} SELECT id, CAST(chunk_id AS BIGINT) AS chunk_id, length(text) AS n_chars, sha1(text) AS digest FROM ch",
    "sections": r"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, string_split(text, chr(10)) AS ls FROM documents),
        h AS (SELECT id, regexp_extract(lower(trim(line)), '^(the|of|was|la|de|die|der|el)(?:[^\p{L}\p{N}_]|$)', 1) AS heading, length(trim(line)) AS n,
          coalesce(list_sum(list_transform(ls[1:i - 1], lambda x: length(x) + 1)), 0) AS start FROM l)
        SELECT id, heading, CAST(min(start) AS BIGINT) AS start FROM h WHERE heading <> '' AND n <= 80 GROUP BY id, heading""",
    "snippets": """WITH p AS (SELECT doc_id AS id, text, list_min(list_filter([instr(lower(text), 'license'), instr(lower(text), 'token')], lambda x: x > 0)) AS pos FROM documents)
        SELECT id, pos, sha1(substr(text, greatest(1, pos - 60), 120)) AS digest FROM p WHERE pos IS NOT NULL""",
    "text_functions": rf"""WITH {_REC} SELECT id, 'doc:' || substr(sha1(id || chr(10) || source), 1, 16) AS stable,
        trim(regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')) AS title, greatest(1, length(text) // 4) AS tokens,
        substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80) AS slug, len({_TOK.format('text', 3)}) AS n_tokens, sha256(text) AS sha256 FROM rec""",
    "enum_coercion": "SELECT CASE lower(event_type) WHEN 'click' THEN 'click' WHEN 'view' THEN 'view' WHEN 'purchase' THEN 'buy' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1",
    "confidence_parse": r"""WITH v AS (SELECT event_id, coalesce(try_cast(nullif(regexp_extract(props, '(\d+(?:\.\d+)?)', 1), '') AS DOUBLE), 0) AS x, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
        SELECT event_id, CAST(round(greatest(0, least(1, CASE WHEN x > 1 THEN x / 100 ELSE x END)), 6) AS DOUBLE) AS from_text, CAST(round(coalesce(greatest(0, least(1, k)), 0.5), 6) AS DOUBLE) AS clamped FROM v""",
    "json_fields": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1",
    "html_titles": r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages",
    "secret_scan": r"""WITH f AS (SELECT doc_id AS id, 'assigned_secret' AS kind, len(regexp_extract_all(text, '(?i)(?:api_?key|secret|token|password)\s*[:=]\s*["'']?[A-Za-z0-9_\-]{12,}')) AS n FROM documents
        UNION ALL SELECT doc_id, 'email', len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) FROM documents
        UNION ALL SELECT doc_id, 'private_path', len(regexp_extract_all(text, '/(?:home|Users)/[A-Za-z0-9_.-]+')) FROM documents
        UNION ALL SELECT doc_id, 'long_hex', len(regexp_extract_all(text, '\b[0-9a-f]{32,}\b')) FROM documents) SELECT id, kind, n FROM f WHERE n > 0""",
    "blind_sanitize": f"""WITH c AS (SELECT doc_id, text, {_SANITISED} AS x FROM documents)
        SELECT doc_id, sha1(x) AS digest, x <> text AS changed FROM c""",
    "seed_alignment": f"""WITH s AS (SELECT DISTINCT unnest({_TOK.format('text', 3)}) AS t FROM benchmark), d AS (SELECT doc_id, unnest({_TOK.format('text', 3)}) AS t FROM documents)
        SELECT doc_id, round(count(*) FILTER (WHERE t IN (SELECT t FROM s)) / count(*), 6) AS share FROM d GROUP BY doc_id""",
    "contamination": rf"""SELECT item_id, doc_id FROM (SELECT item_id, {_FORM.format('text')} AS s FROM benchmark WHERE length(text) >= 15) b
        JOIN (SELECT doc_id, {_FORM.format('text')} AS t FROM documents) d ON s <> '' AND contains(t, s)""",
    "cosine_topk": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.v, b.v), 5) AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, other) AS rank FROM n) SELECT vec_id, other, rank FROM r WHERE rank <= 5""",
    "rerank_topk": """SELECT vec_id, round(vec_id % 7 + 12 * list_dot_product(embedding::DOUBLE[], list_transform(range(64), lambda x: 0.125::DOUBLE)), 4) AS score FROM embeddings
        ORDER BY score DESC, vec_id LIMIT 50""",
}

QUERIES = {
    f.__name__: f
    for f in (
        relevance_score, facet_score, dedup_exact, dedup_multikey, near_dup_jaccard, alias_components, bm25_topk, bm25_many, keyphrases, anchor_terms, chunks,
        sections, snippets, text_functions, enum_coercion, confidence_parse, json_fields, html_titles, secret_scan, blind_sanitize,
        seed_alignment, contamination, cosine_topk, rerank_topk, mmr_selection,
    )
}
