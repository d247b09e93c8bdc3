"""Greedy selections under caps, exact over all rows: Spark filters and orders, the driver sees the few rows that are chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BATCH = 256


def _open(rows: DataFrame, full: dict[str, list]) -> DataFrame:
    """Rows whose keys are not used up; a null key never is."""
    for name, values in full.items():
        if values:
            rows = rows.where(F.col(name).isNull() | ~F.col(name).isin(*values))
    return rows


def greedy(rows: DataFrame, order: list[Column], limit: int, caps: dict[str, int]) -> list:
    """The first ``limit`` rows in order that no cap forbids; ``caps`` says how often a value of a column may be chosen.

    A cap, once reached, stays reached, so rows passed over never come back: each query reads what is still open and cuts it to one batch.
    """
    chosen: list = []
    counts: dict[str, dict] = {c: {} for c in caps}
    while len(chosen) < limit:
        full = {c: [v for v, n in seen.items() if n >= caps[c]] for c, seen in counts.items()}
        batch = _open(rows, full).orderBy(*order).limit(BATCH + len(chosen)).collect()
        taken = {r.asDict(True).__repr__() for r in chosen}
        before = len(chosen)
        for r in batch:
            if len(chosen) == limit:
                break
            if r.asDict(True).__repr__() in taken or any(r[c] is not None and counts[c].get(r[c], 0) >= caps[c] for c in caps):
                continue
            chosen.append(r)
            for c in caps:
                if r[c] is not None:
                    counts[c][r[c]] = counts[c].get(r[c], 0) + 1
        if len(chosen) == before or len(batch) < BATCH:
            break
    return chosen


def soft_capped(rows: DataFrame, limit: int = 12, per_source: int = 2, share: float = 0.4) -> DataFrame:
    """(id, position) of a diverse choice of (id, title, source, kind, label, ni, risk): ``per_source`` of a source, distinct titles, few boundary results.

    The best open row is taken, unless it is a boundary result beyond the share and a comparable other result is open.  Each choice is one query over the
    rows that are still open (the best of each title, source and kind), so nothing is cut beforehand.  A null title is no title and repeats freely.
    """
    rank = F.when(F.col("label") == "STRONG", 0).when(F.col("label") == "MODEST", 1).otherwise(2)
    r = rows.withColumns({"rank": rank, "_title": F.lower("title"), "boundary": F.coalesce(F.col("kind") == "impossibility_boundary", F.lit(False))})
    chosen: list = []
    keys = (F.asc("rank"), F.desc("ni"), F.asc("risk"), F.asc("id"))
    while len(chosen) < limit:
        sources: dict = {}
        for c in chosen:
            sources[c["source"]] = sources.get(c["source"], 0) + 1
        open_ = _open(r, {"_title": [c["_title"] for c in chosen if c["_title"] is not None], "source": [s for s, n in sources.items() if s is not None and n >= per_source], "id": [c["id"] for c in chosen]})
        found = open_.orderBy(*keys).limit(1).collect()
        if not found:
            break
        pick, used = found[0], sum(c["boundary"] for c in chosen)
        if pick["boundary"] and used + 1 > int(share * (len(chosen) + 1)):
            like = open_.where(~F.col("boundary") & (F.col("rank") <= pick["rank"]) & (F.col("ni") >= pick["ni"] - 0.10))
            pick = (like.orderBy(*keys).limit(1).collect() or [pick])[0]
        chosen.append(pick)
    chosen.sort(key=lambda c: (c["rank"], -c["ni"], c["risk"], c["id"]))
    return rows.sparkSession.createDataFrame([(c["id"], i) for i, c in enumerate(chosen, 1)], f"id {dict(rows.dtypes)['id']}, position int")


def diverse_finals(rows: DataFrame, limit: int, penalty: float = 0.35, per_origin: int = 2, cluster_share: float = 0.40, combined_share: float = 0.35) -> DataFrame:
    """(id, position) of a diverse choice of (id, fitness, tokens, origin, cluster, combined).

    Each round takes the row with the largest fitness less ``penalty`` times its greatest Jaccard similarity to a chosen one, among the rows whose origin, cluster and
    kind have room.  Rows without room would be dropped when they came up, so leaving them out beforehand changes nothing.
    """
    cluster_cap, combined_cap = max(1, int(cluster_share * limit)), int(combined_share * limit)
    r = rows.withColumns({"tokens": F.coalesce("tokens", F.array().cast("array<string>")), "combined": F.coalesce("combined", F.lit(False))})
    chosen: list = []
    while len(chosen) < limit:
        count = lambda k: {v: sum(c[k] == v for c in chosen) for v in {c[k] for c in chosen}}
        full = {"origin": [v for v, n in count("origin").items() if v is not None and n >= per_origin], "cluster": [v for v, n in count("cluster").items() if v is not None and n >= cluster_cap], "id": [c["id"] for c in chosen]}
        open_ = _open(r, full)
        if sum(c["combined"] for c in chosen) >= combined_cap:
            open_ = open_.where(~F.col("combined"))
        value = F.col("fitness")
        if chosen:
            like = [F.array(*[F.lit(t) for t in c["tokens"]]).cast("array<string>") for c in chosen]
            share = lambda x: F.coalesce(F.try_divide(F.size(F.array_intersect("tokens", x)), F.size(F.array_union("tokens", x))), F.lit(0.0))
            value = value - penalty * F.greatest(F.lit(0.0), *[share(x) for x in like])
        found = open_.withColumn("_value", value).orderBy(F.desc("_value"), F.desc("fitness"), "id").limit(1).collect()
        if not found:
            break
        chosen.append(found[0])
    return rows.sparkSession.createDataFrame([(c["id"], i) for i, c in enumerate(chosen, 1)], f"id {dict(rows.dtypes)['id']}, position int")


# Labels that are dropped for good, and words that every statement of the field shares.
HARD_DROP = ("DROP_IMPOSSIBLE", "DROP_ALREADY_SOLVED", "DROP_GENERIC", "DROP_ARTIFICIAL_SCOPE", "DROP_OFF_DOMAIN", "DROP_DUPLICATE", "DROP_TOO_SINGLE_PAPER_FRAGILE")
THEME_STOPS = ("problem", "designing", "bandit", "bandits", "regret", "robust", "sublinear", "bounds", "despite", "achieve", "achieves", "algorithm", "algorithms")


def reviewed_finals(rows: DataFrame, limit: int = 20, per_primary: int = 2, theme_share: float = 0.40, ready: int = 10) -> tuple[DataFrame, str]:
    """((id, position), status) of acceptable reviews by five scores: one of an origin, ``per_primary`` of a primary origin, a share of a theme.

    ``rows`` has id, acceptable, review_label, counterevidence_status, supporting_papers, the scores, origin_signature, primary_origin_signature and problem_statement.
    """
    words = F.filter(F.regexp_extract_all(F.lower("problem_statement"), F.lit("([a-z]{5,})"), F.lit(1)), lambda w: ~w.isin(*THEME_STOPS))
    ok = F.col("acceptable") & ~F.col("review_label").isin(*HARD_DROP) & (F.col("counterevidence_status") != "known_solved_in_corpus") & (F.size("supporting_papers") > 0)
    r = rows.where(ok).withColumns({
        "theme": F.array_join(F.slice(F.array_sort(words), 1, 6), "|"), "origin_signature": F.nullif(F.col("origin_signature"), F.lit("")),
        "primary": F.coalesce(F.nullif(F.col("primary_origin_signature"), F.lit("")), F.col("origin_signature")),
    })
    order = [F.desc(c) for c in ("deep_review_score", "evidence_strength", "remaining_gap_realness", "project_concreteness", "feasibility")] + [F.asc("id")]
    cols = ["id", "origin_signature", "primary", "theme"]
    chosen = greedy(r.select(*cols, *[c for c in r.columns if c not in cols]), order, limit, {"origin_signature": 1, "primary": per_primary, "theme": max(1, int(limit * theme_share))})
    out = rows.sparkSession.createDataFrame([(c["id"], i) for i, c in enumerate(chosen, 1)], f"id {dict(rows.dtypes)['id']}, position int")
    return out, "REVIEWED_REPORT_READY" if len(chosen) >= ready else "INSUFFICIENT_MEANINGFUL_HYPOTHESES"


def evenly_spaced(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows (id) at even steps of an order that follows from ids and seed."""
    total = rows.count()
    if total <= n:
        return rows.select("id")
    key = F.xxhash64(F.col("id"), F.lit(seed))
    step = total / n
    parts = rows.select("id", key.alias("k")).withColumn("b", F.floor(F.shiftrightunsigned("k", 54)).cast("int"))  # 1024 stretches of the key, each ranked by itself
    sizes = {r["b"]: r["n"] for r in parts.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = {}, 0
    for b in sorted(sizes):
        before[b], at = at, at + sizes[b]
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("b")]
    place = F.row_number().over(Window.partitionBy("b").orderBy(F.shiftleft("k", 10).bitwiseXOR(F.lit(-(1 << 63))), "id")) - 1 + offset
    wanted = [int(i * step) for i in range(n)]
    return parts.withColumn("place", place).where(F.col("place").isin(*wanted)).select("id")
