"""Inventory, profile and text-assembly queries over the tables in those roles, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import text as T
from lacuna.operators import formal, inventory, models, profiles, rollups
from lacuna.plans.extraction_queries import _pick, _sql_list, _sql_pick
from lacuna.plans.views import GRAPH_SQL, evidence_graph, table
from lacuna.sources import runs

_MOTIFS = ["shared_failure_condition", "assumption_mismatch", "sparse_evaluation", "repeated_unaddressed_limitation", "unrealistic_assumption", "theory_practice_gap", "shared_unrealistic_assumption", "missing_stress_test", "other"]
_CUES = ["It is impossible: a lower bound rules it out", "an intractable case", "nothing", "NP-hard and unavoidable"]
_LEFT = ["none identified", "Covered elsewhere", "much"]
_VIABLE = ["viable formulation", "POSSIBLE_FORMULATION_WITH_REWRITE", "VIABLE_FORMULATION", None]


def axis_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = evidence_graph(spark, sf_dir)
    return inventory.top_labels(nodes, 25).select("axis", "label", "weight", F.col("rank").cast("long").alias("rank"))


def axis_comparators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.comparators(*evidence_graph(spark, sf_dir), 20)


def axis_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.frequent_words(table(spark, sf_dir, "documents").select("text"), inventory.AXIS_STOPS, 25)


def profile_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.profile_phrases(table(spark, sf_dir, "documents").select(F.substring_index("text", "\n", 1).alias("text"))).select("phrase", F.col("rank").cast("long").alias("rank"))


def paper_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as papers of several sources in one shape."""
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        F.when(p % 3 == 0, F.concat(F.lit("a"), p)).otherwise("").alias("paper_id"), F.when(p % 2 == 0, F.concat(F.lit("x"), p)).alias("arxiv_id"), F.when(p % 17 == 0, " ").otherwise(F.concat(F.lit(" "), F.initcap("p_name"), F.lit(" "), p % 5)).alias("title"),
        F.col("p_type").alias("summary"), F.when(p % 4 == 0, "2001-02-03").alias("published"), F.col("p_brand").alias("source_query"), p.alias("place"),
    )
    return inventory.pool(rows).select("paper_id", "title", "abstract", F.coalesce("year", F.lit("")).alias("year"), "source")


def role_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ("the", "der", "une")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(inventory.role_words("text", words)).alias("digest"), inventory.has_role_words("text", words).alias("found"))


def commonest_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.commonest_author(table(spark, sf_dir, "lineitem").select(F.array(F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), F.col("l_partkey") % 40)).alias("authors")))


def mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    many = lambda n: F.slice(F.array(F.lit("known horizon"), F.lit("iid noise"), F.lit("oracle")), 1, (p % n).cast("int"))
    text = inventory.mechanism(_pick(_MOTIFS, p), F.concat("p_name", F.lit(" "), F.repeat(F.col("p_type"), 12)), many(4), many(3), p % 9)
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("mechanism"))


def viability_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    label = F.when(k % 4 == 3, F.lit(None).cast("string")).otherwise(_pick([v or "" for v in _VIABLE], k))
    got = inventory.viability(label, _pick(_CUES, F.floor(k / 4).cast("long")), _pick(_LEFT, F.floor(k / 16).cast("long")))
    return table(spark, sf_dir, "orders").groupBy(got.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def tuple_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("domain"), F.col("l_orderkey").cast("string").alias("paper_id"), F.when(n % 2 == 0, "c").otherwise(" ").alias("condition"), F.when(n % 3 == 0, "m").alias("metric"),
        F.col("l_linestatus").alias("dataset"), (n % 5 == 0).alias("resolved_by_paper"),
    )
    return inventory.overview(rows, "domain")


def proposal_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts of documents as proposals: the reply where it claims nothing, else one of the proposal's parts."""
    k = F.col("doc_id")
    own = inventory.abstract(F.substring_index("text", "\n", 1), F.slice(F.array(F.lit("m1"), F.lit("m2")), 1, (k % 3).cast("int")), F.slice(F.array(F.lit("p1"), F.lit("p2")), 1, (k % 2).cast("int")), F.when(k % 2 == 0, " why "), F.when(k % 5 == 0, "rest"))
    reply = F.when(k % 3 == 0, "We SHOW that").when(k % 3 == 1, " A plan. ").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(inventory.usable_abstract(reply, own)).alias("digest"))


def novelty_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of gaps from batched replies of a model that answers for its first two members."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("line"))
    batches = models.batched_prompts(rows, "key", F.col("line"), 5, "Classify")
    log = models.replies(batches, _two)
    return models.novelty_classes(batches, log).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def _two(prompt: str) -> str:
    return '{"classifications": [{"gap_index": 1, "class": "Trivial"}, {"gap_index": 2, "class": "odd"}]}'


def tokenisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a text's token sets by every tokeniser of the engine."""
    t = F.col("text")
    plain = F.array_except(T.tokens(t, "[a-z0-9]{2,}"), F.array(*[F.lit(w) for w in inventory.PROFILE_STOPS]))
    hyphened = T.tokens(t, r"[a-z][a-z\-]+")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(T.tokens(t)).alias("three"), F.size(plain).alias("content"), F.size(F.split(F.trim(F.regexp_replace(t, r"[ \n\t]+", " ")), " ")).alias("spaced"), F.size(hyphened).alias("hyphened"),
        F.size(T.tokens(t, "[a-z]{5,}")).alias("five"), (F.size(F.array_except(T.tokens(F.lit("the file is code")), T.tokens(t))) == 0).alias("holds"),
    )


def min_max_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances between 0 and 1 over the whole table; the bounds are scalar subqueries."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("x"))
    low, high = rows.agg(F.min("x")).scalar(), rows.agg(F.max("x")).scalar()
    return rows.select("c_custkey", F.round(F.when(high > low, (F.col("x") - low) / (high - low)).otherwise(F.lit(1.0)), 9).alias("score"))


def verified_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as gaps that their line items verify and do not know as solved."""
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("gap_id"), F.when(F.col("l_returnflag") == "R", "known_solved").otherwise("novel").alias("novelty_class"))
    gaps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("gap_id"), "o_orderpriority")
    return runs.verified_gaps(gaps, seen).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def family_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as families with their representative's and their problem's fields; families without either stay."""
    families = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("family_id"), (F.col("p_partkey") % 100).alias("representative"), F.array(F.col("p_partkey") % 7, F.col("p_partkey") % 300).alias("members"))
    direct = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("formulation_id"), "s_name")
    problems = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("family_id")).agg(F.count(F.lit(1)).alias("problems"))
    return formal.families_with(families, direct, problems).select("family_id", F.col("representative_row.s_name").alias("representative"), F.size("member_rows").alias("members"), F.coalesce("problems", F.lit(0)).alias("problems"))


def titled_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order's priority as title, the id where there is none."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("paper_id"), F.col("l_linenumber").alias("n"))
    manifest = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("title"))
    titled = rows.join(manifest, "paper_id", "left").withColumn("title", F.coalesce("title", F.col("paper_id").cast("string")))
    return titled.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("lines"))


def title_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of every twentieth document, mistyped (third character lost, one doubled in the middle), resolved among the first lines of all documents."""
    papers = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), "doc_id", F.substring_index("text", "\n", 1).alias("title"))
    n = F.length("title")
    typed = F.concat(F.substring("title", 1, 2), F.substring(F.col("title"), F.lit(4), F.floor(n / 2).cast("int") - 2), F.substring(F.col("title"), F.floor(n / 2).cast("int") + 1, n))
    found = inventory.title_matches(papers.where("doc_id % 20 = 0").select(F.col("doc_id").alias("id"), F.when(n > 8, typed).otherwise(F.col("title")).alias("title")), papers)
    return found.select("id", "resolved", "paper_id", F.array_join("alternatives", " ").alias("alternatives"), "reason", "score")


def generation_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls and hypotheses of generations (months): calls, successful ones, failures, best fitness."""
    rows = table(spark, sf_dir, "orders").select(F.month("o_orderdate").cast("long").alias("generation"), (F.col("o_orderstatus") != "P").alias("ok"), (F.col("o_totalprice") / 1000).cast("double").alias("fitness"))
    return rollups.progress(rows)


def personal_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as gaps, ranked by their overall score and by the personalised one."""
    k = F.col("o_orderkey")
    part = lambda n: ((k % n) / n).alias
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), part(101)("overall"), part(7)("alignment"), part(13)("survival"), part(29)("novelty"))
    return profiles.blended(rows).select("id", "personal", "original_rank", "personal_rank")


# --- DuckDB ---

_ARMS = {
    "shared_failure_condition": "'Shared failure condition across methods: ' || substr(l, 1, 80)", "assumption_mismatch": "'Implicit assumption in ' || m || ' violated by observed failure conditions'",
    "sparse_evaluation": "'Repeated use of ' || m || ' without evaluation across diverse datasets/metrics'", "repeated_unaddressed_limitation": "'Unaddressed cross-paper limitation: ' || m",
    "unrealistic_assumption": "CASE WHEN a <> '' AND f <> '' THEN m || ' assumes ' || a || ', which breaks under ' || f ELSE 'Idealized assumption in ' || m || ' violated under realistic conditions' END",
    "theory_practice_gap": "m || ' has theoretical guarantees not validated empirically; fails under ' || CASE WHEN f <> '' THEN f ELSE 'real-world conditions' END",
    "shared_unrealistic_assumption": "'Assumption ''' || substr(l, 1, 80) || ''' shared across ' || n || ' methods is unrealistic in practice'", "missing_stress_test": "m || ' lacks evaluation under distribution shift or adversarial conditions'",
}
_PSTOP = _sql_list(inventory.PROFILE_STOPS)
_HITS = " + ".join(f"CAST(contains(c, '{x}') AS INTEGER)" for x in inventory.CUES)
_WORD = r"(?i)(^|[^\pL\pN_])(the|der|une)($|[^\pL\pN_])"
_THREE = ["known horizon", "iid noise", "oracle"]

ORACLE_SQL = {
    "axis_labels": f"""WITH {GRAPH_SQL}, a AS (SELECT CASE type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in inventory.AXES.items())} END AS axis, trim(label) AS label, sum(greatest(len(papers), 1)) AS weight FROM nodes WHERE type IN {tuple(inventory.AXES)} GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY weight DESC, label) AS rank FROM a) SELECT axis, label, weight::BIGINT AS weight, rank FROM r WHERE rank <= 25""",
    "axis_comparators": f"WITH {GRAPH_SQL} SELECT trim(label) AS label, count(*) AS n FROM edges JOIN nodes ON id = target WHERE relation = 'improves_over' GROUP BY 1 ORDER BY n DESC, label LIMIT 20",
    "axis_words": f"WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z\\-]{{4,}}')) AS term FROM documents) SELECT term, count(*) AS n FROM w WHERE NOT list_contains({_sql_list(inventory.AXIS_STOPS)}, term) GROUP BY 1 ORDER BY n DESC, term LIMIT 25",
    "profile_phrases": f"""WITH w AS (SELECT list_filter(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z][a-z0-9\\-]+'), lambda x: length(x) > 2 AND NOT list_contains({_PSTOP}, x)) AS w FROM documents),
        b AS (SELECT phrase, count(*) AS n, 2 AS size FROM (SELECT w[i] || ' ' || w[i + 1] AS phrase FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)) GROUP BY 1 ORDER BY n DESC, phrase LIMIT 15),
        u AS (SELECT phrase, count(*) AS n, 1 AS size FROM (SELECT unnest(w) AS phrase FROM w) GROUP BY 1 ORDER BY n DESC, phrase LIMIT 15), a AS (SELECT * FROM b UNION ALL SELECT * FROM u)
        SELECT phrase, row_number() OVER (ORDER BY size DESC, n DESC, phrase) AS rank FROM a ORDER BY rank LIMIT 15""",
    "paper_pool": """WITH r AS (SELECT p_partkey AS p, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE (SELECT string_agg(upper(substr(x, 1, 1)) || substr(x, 2), ' ') FROM (SELECT unnest(string_split(p_name, ' ')) AS x)) || ' ' || p_partkey % 5 END AS title, p_type, p_brand FROM part),
        k AS (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY p) AS rn FROM r WHERE title <> '')
        SELECT CASE WHEN p % 3 = 0 THEN 'a' || p WHEN p % 2 = 0 THEN 'x' || p ELSE 'paper:' || substr(lpad(CAST(p AS VARCHAR), 4, '0'), 1, 4) END AS paper_id, title, p_type AS abstract, CASE WHEN p % 4 = 0 THEN '2001' ELSE '' END AS year, p_brand AS source FROM k WHERE rn = 1""",
    # Once more for words that share the character between them.
    "role_words": f"""SELECT doc_id, sha1(regexp_replace(regexp_replace(text, '{_WORD}', '\\1author\\3', 'g'), '{_WORD}', '\\1author\\3', 'g')) AS digest, regexp_matches(text, '{_WORD}') AS found FROM documents""",
    "commonest_author": "SELECT author, count(*) AS n FROM (SELECT 's' || l_suppkey AS author FROM lineitem UNION ALL SELECT 'p' || l_partkey % 40 FROM lineitem) GROUP BY 1 ORDER BY n DESC, author LIMIT 1",
    "mechanisms": f"""WITH v AS (SELECT p_partkey, {_sql_pick(_MOTIFS, 'p_partkey')} AS t, p_name || ' ' || repeat(p_type, 12) AS l, array_to_string(({_sql_list(_THREE)})[1:least(2, p_partkey % 4)], ', ') AS a, array_to_string(({_sql_list(_THREE)})[1:least(2, p_partkey % 3)], ', ') AS f, p_partkey % 9 AS n FROM part),
        w AS (SELECT *, substr(l, 1, 60) AS m FROM v) SELECT p_partkey, CASE t {' '.join(f"WHEN '{k}' THEN {x}" for k, x in _ARMS.items())} ELSE 'insufficient evidence' END AS mechanism FROM w""",
    "viability_labels": f"""WITH v AS (SELECT CASE o_orderkey % 4 WHEN 3 THEN 'NEEDS_EXTERNAL_LIT_CHECK' WHEN 1 THEN 'POSSIBLE_FORMULATION_WITH_REWRITE' ELSE 'VIABLE_FORMULATION' END AS u, lower({_sql_pick(_CUES, 'o_orderkey // 4')}) AS c, lower({_sql_pick(_LEFT, 'o_orderkey // 16')}) AS l FROM orders),
        w AS (SELECT CASE WHEN {_HITS} >= 2 AND u <> 'NEEDS_EXTERNAL_LIT_CHECK' THEN 'IMPOSSIBLE_FORMULATION' ELSE u END AS x, l FROM v)
        SELECT CASE WHEN (contains(l, 'none identified') OR contains(l, 'covered')) AND x = 'VIABLE_FORMULATION' THEN 'ARTIFICIAL_SCOPE' ELSE x END AS label, count(*) AS n FROM w GROUP BY 1""",
    "tuple_overview": """SELECT coalesce(l_returnflag, 'TOTAL') AS domain, count(DISTINCT l_orderkey) AS papers, count(*) AS tuples, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS with_condition, count(*) FILTER (WHERE l_linenumber % 3 = 0) AS with_metric,
        count(*) AS with_dataset, count(*) FILTER (WHERE l_linenumber % 5 = 0) AS resolved FROM lineitem GROUP BY ROLLUP (l_returnflag)""",
    "proposal_abstracts": """WITH v AS (SELECT doc_id AS k, rtrim(trim(split_part(text, chr(10), 1)), '.') AS s, ['', 'm1', 'm1, m2'][doc_id % 3 + 1] AS m FROM documents),
        t AS (SELECT k, 'This project studies ' || s || '. The central question arises from ' || CASE WHEN m <> '' THEN m ELSE 'an identified structural gap' END || ' observed across the corpus' || CASE WHEN k % 2 = 1 THEN ' (1 supporting papers).' ELSE '.' END || ' '
          || CASE WHEN k % 2 = 0 THEN 'A possible approach is suggested by the mechanism: why.' ELSE 'A possible approach would formalize the gap and test it against the supporting evidence.' END || CASE WHEN k % 5 = 0 THEN ' The remaining open scope is: rest.' ELSE '' END
          || ' A successful outcome would clarify when the underlying assumptions hold and provide a concrete, testable account of the gap.' AS t FROM v)
        SELECT k AS doc_id, sha1(CASE WHEN k % 3 = 1 THEN 'A plan.' WHEN len(string_split(t, ' ')) < 100 THEN t || ' This project would investigate the conditions, evidence, and falsifiable predictions needed to turn the observed gap into a well-posed research problem.' ELSE t END) AS digest FROM t""",
    "tokenisers": f"""WITH t AS (SELECT doc_id, text, lower(text) AS x, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS three FROM documents)
        SELECT doc_id, len(three) AS three, len(list_filter(list_distinct(regexp_extract_all(x, '[a-z0-9]{{2,}}')), lambda w: NOT list_contains({_PSTOP}, w))) AS content, len(string_split(trim(regexp_replace(text, '[ \\n\\t]+', ' ', 'g')), ' ')) AS spaced,
        len(list_distinct(regexp_extract_all(x, '[a-z][a-z\\-]+'))) AS hyphened, len(list_distinct(regexp_extract_all(x, '[a-z]{{5,}}'))) AS five, list_has_all(three, ['the', 'file', 'code']) AS holds FROM t""",
    "min_max_scores": "SELECT c_custkey, round((c_acctbal::DOUBLE - min(c_acctbal::DOUBLE) OVER ()) / (max(c_acctbal::DOUBLE) OVER () - min(c_acctbal::DOUBLE) OVER ()), 9) AS score FROM customer",
    "verified_gaps": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R') GROUP BY 1",
    "family_problems": """WITH m AS (SELECT DISTINCT p_partkey, unnest([p_partkey % 7, p_partkey % 300]) AS s FROM part), k AS (SELECT p_partkey, count(*) AS n FROM m JOIN supplier ON s_suppkey = s GROUP BY 1)
        SELECT p.p_partkey AS family_id, s_name AS representative, coalesce(k.n, 0)::INTEGER AS members, (SELECT count(*) FROM lineitem WHERE l_partkey = p.p_partkey) AS problems
        FROM part p LEFT JOIN supplier ON s_suppkey = p.p_partkey % 100 LEFT JOIN k ON k.p_partkey = p.p_partkey""",
    "titled_extractions": """SELECT coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END, CAST(l_partkey AS VARCHAR)) AS title, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem LEFT JOIN orders ON o_orderkey = l_partkey GROUP BY 1""",
    "personal_ranks": """WITH s AS (SELECT o_orderkey AS id, (o_orderkey % 101) / 101 AS o, least(1, greatest(0, 0.35::DOUBLE * ((o_orderkey % 101) / 101) + 0.30::DOUBLE * ((o_orderkey % 7) / 7) + 0.20::DOUBLE * ((o_orderkey % 13) / 13) + 0.15::DOUBLE * ((o_orderkey % 29) / 29))) AS p FROM orders),
        r AS (SELECT id, o, round(p, 6) AS personal FROM s) SELECT id, personal, row_number() OVER (ORDER BY o DESC, id) AS original_rank, row_number() OVER (ORDER BY personal DESC, id) AS personal_rank FROM r""",
    "generation_progress": """SELECT month(o_orderdate) AS generation, count(*) AS calls, count(*) FILTER (WHERE o_orderstatus <> 'P') AS succeeded, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, round(max(o_totalprice::DOUBLE / 1000), 6) AS best_fitness FROM orders GROUP BY 1""",
}

QUERIES = {
    f.__name__: f
    for f in (
        axis_labels, axis_comparators, axis_words, profile_phrases, paper_pool, role_words, commonest_author, mechanisms, viability_labels, tuple_overview, proposal_abstracts, novelty_batches, tokenisers, min_max_scores,
        verified_gaps, family_problems, titled_extractions, title_resolution, generation_progress, personal_ranks,
    )
}
