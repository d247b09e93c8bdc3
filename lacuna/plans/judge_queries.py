"""Queries over labels, orders, events and messages in the roles of judgements, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.operators import gaps, judging
from lacuna.operators.graph import alias_by_acronym, top_per
from lacuna.plans.views import table

ACTIONS = ["KEEP", "REVISE", "DROP", "MERGE"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.group_stats(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], ["l_quantity", "l_discount"])


def action_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.get(F.array(*[F.lit(a) for a in ACTIONS]), (F.col("o_orderkey") % 4).cast("int"))
    return judging.action_counts(_orders(spark, sf_dir).withColumn("action", action), "o_orderpriority", ACTIONS)


def unblind(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _orders(spark, sf_dir).select(F.col("o_custkey").alias("candidate_id"), "o_totalprice")
    key = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("candidate_id"), F.col("c_mktsegment").alias("method"))
    return judging.unblinded(scores, key).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean_score"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    winner = F.expr("CASE WHEN o_orderkey % 11 = 0 THEN 'CANNOT_JUDGE' WHEN o_orderkey % 5 = 0 THEN 'TIE' WHEN o_orderkey % 3 = 0 THEN 'B' ELSE 'A' END")
    return _orders(spark, sf_dir).select(F.col("o_orderpriority").alias("pool_a"), F.col("o_orderstatus").alias("pool_b"), winner.alias("winner"), "o_orderkey")


def win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.win_rates(_pairs(spark, sf_dir))


def mean_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 5).alias("domain"), F.col("l_linestatus").alias("criterion"), F.col("l_returnflag").alias("method"), ((F.col("l_partkey") + F.col("l_linenumber")) % 4 + 1).alias("rank")
    )
    return judging.mean_ranks(rows)


def domain_total_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.domain_totals(_orders(spark, sf_dir), "o_orderstatus", "o_orderpriority", PRIORITIES)


def ordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.ordered_pairs(table(spark, sf_dir, "conversations").withColumn("id", F.col("turn")), "conv_id", F.col("turn"))


def complete_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch"), F.col("l_partkey").alias("candidate_id"), F.col("l_linenumber").cast("long").alias("rank"),
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")).cast("long").alias("position"),
    )
    return judging.complete_ranking(rows)


def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.plans.views import tuples

    return judging.extraction_quality(tuples(spark, sf_dir), 100, 3)


def plateau_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("step"), F.round("value", 0).alias("best"))
    return judging.plateaus(rows, "user_id", 5.0)


def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "events").where("event_id % 97 = 0").select("user_id")
    return judging.remaining(table(spark, sf_dir, "events").select("user_id").distinct(), done, "user_id")


def referential_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = table(spark, sf_dir, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("k"))
    return judging.audit(parent, _orders(spark, sf_dir).select(F.col("o_custkey").alias("k")), "k")


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as gaps: papers are their line items' suppliers."""
    by = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("gap_id")).agg(
        F.collect_set(F.col("l_suppkey").cast("string")).alias("paper_ids"), F.collect_set(F.col("l_partkey").cast("string")).alias("node_ids")
    )
    return by.select("gap_id", F.size("paper_ids").alias("n_papers"), "node_ids", F.lit(0.45).alias("feasibility_score"), ((F.col("gap_id") % 10) / 10.0).alias("extraction_uncertainty"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    agent = F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'skeptic_agent' WHEN 1 THEN 'feasibility_agent' ELSE 'mechanism_agent' END")
    key = F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'already_solved_score' WHEN 1 THEN 'experimentability' ELSE 'mechanism_plausibility' END")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("gap_id"), agent.alias("agent_name"), key.alias("key"), F.round(F.col("l_discount") * 8, 2).alias("value"))


def survival_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gaps.survival_scores(_gaps(spark, sf_dir), _results(spark, sf_dir))
    return rows.select("gap_id", F.round("gap_survival_score", 4).alias("gap_survival_score"))


def verification_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    agents = table(spark, sf_dir, "lineitem").select(
        k.alias("gap_id"), F.get(F.array(*[F.lit(a) for a in gaps.AGENTS]), (F.col("l_linenumber") % 5).cast("int")).alias("agent_name"), (k % 6 != 0).alias("parsed"),
        F.when(k % 5 == 0, "DROP_GENERIC").otherwise("keep").alias("label"), ((k % 10) / 10.0).alias("confidence"),
    )
    scores = _orders(spark, sf_dir).where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("gap_id"), ((F.col("o_orderkey") % 100) / 100.0).alias("gap_survival_score"))
    return gaps.verification_gate(_orders(spark, sf_dir).select(F.col("o_orderkey").alias("gap_id")), agents, scores)


def agent_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    parts = [F.when(k % (i + 2) != 0, ((k * (i + 1)) % 10) / 10.0) for i in range(5)]
    return _orders(spark, sf_dir).select("o_orderkey", F.round(gaps.blended_confidence(parts, (k % 7) / 10.0), 6).alias("confidence"))


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rec = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'MAYBE' ELSE 'DROP' END")
    label = gaps.quality_label((k % 10) / 10.0, (k % 9) / 10.0, (k % 7) / 10.0, rec)
    return _orders(spark, sf_dir).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def capped_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two best orders of every customer."""
    return top_per(_orders(spark, sf_dir), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


def acronym_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    short = F.upper(F.substring("n_name", 1, 3))
    labels = n.select(F.concat("n_name", F.lit(" ("), short, F.lit(")")).alias("label")).unionByName(n.select(short.alias("label"))).distinct()
    return alias_by_acronym(labels)


def soft_cap_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = _orders(spark, sf_dir).select(
        k.alias("id"), F.concat(F.lit("t"), k % 97).alias("title"), (F.col("o_custkey") % 13).cast("string").alias("source"),
        F.when(k % 3 == 0, "impossibility_boundary").otherwise("method").alias("kind"), F.when(k % 4 == 0, "STRONG").otherwise("MODEST").alias("label"),
        ((k % 100) / 100.0).alias("ni"), ((k % 41) / 100.0).alias("risk"),
    )
    return gaps.soft_capped(rows)


_SUB = [(f"(CASE WHEN o_orderkey % {i + 2} <> 0 THEN ((o_orderkey * {i + 1}) % 10) / 10.0::DOUBLE END)", w) for i, w in enumerate(gaps.SUB_SCORES)]
_WEIGHT = " + ".join(f"CASE WHEN {x} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for x, w in _SUB)
_TOTAL = " + ".join(f"coalesce({x} * {w}::DOUBLE, 0)" for x, w in _SUB)

ORACLE_SQL = {
    "group_stats": """SELECT l_suppkey, l_returnflag, count(*) AS n, round(avg(l_quantity), 4) AS l_quantity_mean, round(stddev_samp(l_quantity), 4) AS l_quantity_std,
        round(stddev_samp(l_quantity) / sqrt(count(*)), 4) AS l_quantity_stderr, round(avg(l_discount), 4) AS l_discount_mean, round(stddev_samp(l_discount), 4) AS l_discount_std,
        round(stddev_samp(l_discount) / sqrt(count(*)), 4) AS l_discount_stderr FROM lineitem GROUP BY 1, 2""",
    "action_pivot": "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (WHERE o_orderkey % 4 = {i}) AS {a.lower()}" for i, a in enumerate(ACTIONS)) + ", count(*) AS total FROM orders GROUP BY 1",
    "unblind": """SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment ELSE 'UNKNOWN' END AS method, count(*) AS n, round(avg(o_totalprice), 2) AS mean_score
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "win_rates": """WITH p AS (SELECT o_orderpriority AS a, o_orderstatus AS b, CASE WHEN o_orderkey % 11 = 0 THEN 'CANNOT_JUDGE' WHEN o_orderkey % 5 = 0 THEN 'TIE' WHEN o_orderkey % 3 = 0 THEN 'B' ELSE 'A' END AS w FROM orders),
        s AS (SELECT a AS pool, 'A' AS side, w FROM p UNION ALL SELECT b, 'B', w FROM p),
        g AS (SELECT pool, count(*) AS comparisons, count(*) FILTER (WHERE w = side) AS wins, count(*) FILTER (WHERE w IN ('A', 'B') AND w <> side) AS losses,
          count(*) FILTER (WHERE w = 'TIE') AS ties, count(*) FILTER (WHERE w = 'CANNOT_JUDGE') AS cannot_judge FROM s GROUP BY pool)
        SELECT *, round(wins / nullif(wins + losses, 0), 4) AS rate_excluding_ties, round((wins + 0.5::DOUBLE * ties) / nullif(wins + losses + ties, 0), 4) AS rate_half_ties FROM g""",
    "mean_ranks": """SELECT l_returnflag AS method, l_linestatus AS criterion, count(*) AS n, round(avg((l_partkey + l_linenumber) % 4 + 1), 4) AS mean_rank,
        count(*) FILTER (WHERE (l_partkey + l_linenumber) % 4 = 0) AS first_places, count(DISTINCT l_orderkey % 5) AS domains FROM lineitem GROUP BY 1, 2""",
    "domain_total_rollup": "SELECT coalesce(o_orderstatus, 'TOTAL') AS domain, " + ", ".join(f"count(*) FILTER (WHERE o_orderpriority = '{p}') AS \"{p}\"" for p in PRIORITIES) + ", count(*) AS total FROM orders GROUP BY ROLLUP (o_orderstatus)",
    "ordered_pairs": r"""WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)
        SELECT conv_id, k // 2 AS pair, max(turn) FILTER (WHERE k % 2 = 0) AS first, max(turn) FILTER (WHERE k % 2 = 1) AS second FROM n GROUP BY 1, 2""",
    "complete_rankings": """WITH r AS (SELECT l_orderkey AS batch, l_linenumber AS rank, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS position
          FROM lineitem) SELECT batch, count(*) = count(DISTINCT rank) AND min(rank) = 1 AND max(rank) = count(*) AS complete, bool_and(rank = position) AS input_order FROM r GROUP BY 1""",
    "extraction_quality": """WITH t AS (SELECT l_orderkey AS p, (l_partkey + 3 * l_linenumber + l_suppkey) % 10 AS r FROM lineitem WHERE (l_orderkey * 7 + l_linenumber) % 8 % 2 = 0),
        g AS (SELECT count(*) AS types, max(n) AS most, CAST(sum(n) AS BIGINT) AS tuples FROM (SELECT r, count(*) AS n FROM t GROUP BY r)), u AS (SELECT count(DISTINCT p) AS papers FROM t)
        SELECT papers, tuples, types, round(tuples / papers, 4) AS mean_tuples, round(most / tuples, 4) AS largest_share,
          CASE WHEN papers < 90 OR types < 3 OR most / tuples > 0.95 THEN 'FAIL' WHEN NOT (tuples / papers >= 2 OR tuples >= 400) THEN 'LOW' ELSE 'PASS' END AS status FROM g, u""",
    "plateau_lag": """WITH d AS (SELECT user_id, abs(round(value, 0) - lag(round(value, 0)) OVER (PARTITION BY user_id ORDER BY event_id)) AS d FROM events)
        SELECT user_id, count(*) AS steps, count(*) FILTER (WHERE d < 5) AS flat FROM d GROUP BY 1""",
    "resume_anti": "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 97 = 0)",
    "referential_audit": """WITH p AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 9 <> 0), c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
        SELECT CASE WHEN p.k IS NULL THEN 'invented' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'once' END AS status, count(*) AS n FROM p FULL JOIN c ON p.k = c.k GROUP BY 1""",
    "survival_scores": """WITH g AS (SELECT l_orderkey AS gap_id, count(DISTINCT l_suppkey) AS np, count(DISTINCT l_partkey) AS nn,
          avg(round(l_discount * 8, 2)) FILTER (WHERE l_linenumber % 3 = 0) AS s, avg(round(l_discount * 8, 2)) FILTER (WHERE l_linenumber % 3 = 1) AS e,
          avg(round(l_discount * 8, 2)) FILTER (WHERE l_linenumber % 3 = 2) AS m FROM lineitem GROUP BY 1)
        SELECT gap_id, CAST(round(greatest(0, least(1, 0.4 * least(1.0, np / 3) + 0.2 * (1 - least(1, coalesce(s, 0.2))) + 0.15 * least(1, coalesce(e, 0.45)) + 0.15 * least(1, coalesce(m, 0.5))
          + 0.1 * least(1.0, nn / 4) - 0.25 * least(1, coalesce(s, 0)) - 0.1 * ((gap_id % 10) / 10))), 4) AS DOUBLE) AS gap_survival_score FROM g""",
    "verification_gate": f"""WITH a AS (SELECT l_orderkey AS g, ({list(gaps.AGENTS)})[l_linenumber % 5 + 1] AS agent FROM lineitem),
        b AS (SELECT g, count(DISTINCT agent) AS n, bool_or(agent = 'critic_agent') AS critic FROM a GROUP BY g),
        r AS (SELECT o_orderkey AS gap_id, coalesce(n, 0) < 5 AS missing, n IS NOT NULL AND o_orderkey % 6 = 0 AS failed, o_orderkey % 4 = 0 AS unscored, (o_orderkey % 100) / 100 < 0.6 AS low,
          coalesce(critic, false) AND o_orderkey % 5 = 0 AS rejected, NOT coalesce(critic, false) OR (o_orderkey % 10) / 10 < 0.5 AS unsure FROM orders LEFT JOIN b ON g = o_orderkey),
        s AS (SELECT gap_id, missing, concat_ws(';', CASE WHEN missing THEN 'missing_agents' END, CASE WHEN failed THEN 'parse_failures' END,
          CASE WHEN unscored THEN 'missing_survival_score' WHEN low THEN 'low_survival_score' END, CASE WHEN rejected THEN 'critic_reject' WHEN unsure THEN 'low_critic_confidence' END) AS reasons FROM r)
        SELECT gap_id, reasons = '' AS passed, reasons, NOT missing AS reviewed FROM s""",
    "agent_confidence": f"""WITH v AS (SELECT o_orderkey, (o_orderkey % 7) / 10.0::DOUBLE AS raw, {_WEIGHT} AS w, {_TOTAL} AS t FROM orders)
        SELECT o_orderkey, round(CAST(greatest(0, least(1, CASE WHEN w < 0.1 THEN raw WHEN raw > 0 THEN 0.7::DOUBLE * t / w + 0.3::DOUBLE * raw ELSE t / w END)) AS DOUBLE), 6) AS confidence FROM v""",
    "quality_labels": """WITH v AS (SELECT (o_orderkey % 10) / 10 AS c, (o_orderkey % 9) / 10 AS s, (o_orderkey % 7) / 10 AS t, CASE o_orderkey % 3 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'MAYBE' ELSE 'DROP' END AS r FROM orders)
        SELECT CASE WHEN r = 'DROP' OR c < 0.4 OR t > 0.6 THEN 'DROP' WHEN c >= 0.7 AND s >= 0.6 AND t <= 0.3 AND r = 'KEEP' THEN 'STRONG' WHEN c >= 0.5 AND r IN ('KEEP', 'MAYBE') THEN 'USABLE' ELSE 'WEAK' END AS label, count(*) AS n FROM v GROUP BY 1""",
    "capped_per_source": """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) SELECT * FROM r WHERE rank <= 2""",
    "acronym_aliases": r"""WITH l AS (SELECT n_name || ' (' || upper(substr(n_name, 1, 3)) || ')' AS label FROM nation UNION SELECT upper(substr(n_name, 1, 3)) FROM nation),
        a AS (SELECT label, regexp_extract(label, '\(([A-Z][A-Z0-9\-]+)\)\s*$', 1) AS acr FROM l), b AS (SELECT acr, arg_min(label, (-length(label), label)) AS canonical FROM
          (SELECT * FROM a WHERE acr <> '') GROUP BY acr) SELECT label, canonical FROM l JOIN b ON label = b.acr""",
}

QUERIES = {
    f.__name__: f
    for f in (
        group_stats, action_pivot, unblind, win_rates, mean_ranks, domain_total_rollup, ordered_pairs,
        complete_rankings, extraction_quality, plateau_lag, resume_anti, referential_audit, survival_scores, verification_gate,
        agent_confidence, quality_labels, capped_per_source, acronym_aliases, soft_cap_selection,
    )
}
