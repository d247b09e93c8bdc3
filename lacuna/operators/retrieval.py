"""Relevance scoring, BM25, keyphrases, chunks, sections and reranking."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.text import count_phrases, dot, matched_phrases, squash, words
from lacuna.scratch import kept, ranked


@dataclass
class Intent:
    """What a search is for: phrases that speak for, anchor or speak against a record, and its fields of study."""

    positive: list[str]
    anchor: list[str] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)
    good_fields: list[str] = field(default_factory=list)
    off_fields: list[str] = field(default_factory=list)
    keep_threshold: float = 6.0


def relevance(rows: DataFrame, intent: Intent) -> DataFrame:
    """Adds score, reason and keep to (title, abstract, fields, sources, citations, is_preprint).

    Weights: 6 and 4 for positive phrases in title and abstract, 4 and 3 for up to two anchors, 2 for each good field, 1 for several sources,
    up to 3 for citations; 7, 3 and 4 off for negative phrases in title and abstract and for off-domain fields.
    """
    t, a = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("abstract", F.lit("")))
    pos_t = matched_phrases(t, intent.positive)
    pos_a = F.size(F.array_except(matched_phrases(a, intent.positive), pos_t))
    anc_t, anc_a = count_phrases(t, intent.anchor), count_phrases(a, intent.anchor)
    neg_t, neg_a = count_phrases(t, intent.negative), count_phrases(a, intent.negative)
    fields = F.transform(F.coalesce("fields", F.array().cast("array<string>")), lambda x: F.lower(x))
    good = F.size(F.filter(fields, lambda x: x.isin(*intent.good_fields)))
    off = F.size(F.filter(fields, lambda x: x.isin(*intent.off_fields)))
    cited = F.coalesce("citations", F.lit(0))
    some = (F.size(pos_t) + pos_a + anc_t + anc_a) > 0
    reason = (
        F.when(F.lit(bool(intent.positive)) & ~some, "no_positive")
        .when((neg_t > 0) & (F.size(pos_t) == 0), "negative_title")
        .when((F.trim(a) == "") & (F.size(words(t)) < 5), "no_content")
        .when((off > 0) & ~some, "off_domain")
    )
    score = (
        6.0 * F.size(pos_t) + 4.0 * pos_a + 4.0 * F.least(anc_t, F.lit(2)) + 3.0 * F.least(anc_a, F.lit(2)) + 2.0 * good
        + F.when(F.col("sources") > 1, 1.0).otherwise(0.0)
        + F.when((cited > 0) & ~F.col("is_preprint"), F.least(F.log10(cited + 1.0), F.lit(3.0))).otherwise(0.0)
        - 7.0 * neg_t - 3.0 * neg_a - 4.0 * off
    )
    rows = rows.withColumns({"reason": reason, "score": F.when(reason.isNull(), F.round(score, 4)).otherwise(0.0)})
    return rows.withColumn("keep", F.col("reason").isNull() & (F.col("score") >= intent.keep_threshold))


def facet_scores(rows: DataFrame, include: list[str], keywords: list[str], exclude: list[str], categories: list[str], min_year: int) -> DataFrame:
    """Adds reason and score for one facet to (title, abstract, categories, year); rejected rows score -999."""
    t, a = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("abstract", F.lit("")))
    both = F.concat(t, F.lit(" "), a)
    reason = (
        F.when(count_phrases(both, exclude) > 0, "excluded")
        .when(F.col("year") < min_year, "too_old")
        .when(count_phrases(both, include) == 0, "nothing_included")
    )
    cats = F.size(F.array_intersect("categories", F.array(*[F.lit(c) for c in categories])))
    score = (
        F.least(F.lit(5.0), 2.5 * count_phrases(t, include)) + F.least(F.lit(3.0), 1.5 * count_phrases(a, include))
        + F.least(F.lit(4.0), 1.0 * count_phrases(both, keywords)) + F.least(F.lit(3.0), 1.5 * cats)
    )
    return rows.withColumns({"reason": reason, "score": F.when(reason.isNull(), F.round(score, 4)).otherwise(-999.0)})


def bm25(chunks: DataFrame, query: str, k: int, per_paper: int = 3, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Best k chunks (paper_id, chunk_id, text) for the query's words of three letters and digits or more, at most ``per_paper`` of a paper; scores over 0 only.

    Chunks become counts of the query's terms in one pass over the texts; the counts are written once and serve the statistics and the scores.
    Without any match the first k chunks come with falling scores.
    """
    asked = re.findall("[a-z0-9]{3,}", query.lower())
    terms = {t: asked.count(t) for t in asked}
    low = F.lower(F.coalesce("text", F.lit("")))
    tf = {t: F.regexp_count(low, F.lit(f"(?<![a-z0-9]){t}(?![a-z0-9])")) for t in terms}
    rows = kept(chunks.select("paper_id", "chunk_id", F.regexp_count(low, F.lit("[a-z0-9]{3,}")).alias("dl"), *[v.alias(f"tf{i}") for i, v in enumerate(tf.values())]), "bm25")
    if not terms:
        return _in_order(rows, k)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i, q in enumerate(terms.values()):
        t, d = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5))
        score = score + q * idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("dl") / F.greatest("avgdl", F.lit(1.0))))
    hits = rows.where(functools.reduce(operator.or_, [F.col(f"tf{i}") > 0 for i in range(len(terms))]))
    scored = hits.crossJoin(F.broadcast(stats)).withColumn("score", score).where("score > 0")  # stats: one row
    if not scored.limit(1).count():
        return _in_order(rows, k)
    by = Window.partitionBy("paper_id").orderBy(F.desc("score"), "chunk_id")
    first = scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= per_paper)
    return first.select("paper_id", "chunk_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "paper_id", "chunk_id").limit(k)


def _in_order(rows: DataFrame, k: int) -> DataFrame:
    """The first k chunks with scores 1, 1/2, 1/3 ..."""
    first = rows.select("paper_id", "chunk_id").orderBy("paper_id", "chunk_id").limit(k)
    return first.withColumn("score", F.round(1.0 / F.row_number().over(Window.orderBy("paper_id", "chunk_id")), 6))  # k rows


def keyphrases(texts: DataFrame, k: int, stops: list[str]) -> DataFrame:
    """Most frequent bigrams, then unigrams, of lower-case words of four letters or more that are no stop words."""
    w = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1)), lambda x: ~x.isin(*stops))
    rows = texts.select(w.alias("w"))
    two = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    grams = rows.select(F.explode(F.concat(
        F.transform("w", lambda x: F.struct(F.lit(1).alias("size"), x.alias("phrase"))), F.transform(two, lambda x: F.struct(F.lit(2).alias("size"), x.alias("phrase"))),
    )).alias("g"))
    return grams.groupBy("g.size", "g.phrase").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size"), F.desc("n"), "phrase").limit(k)


def anchor_terms(labels: DataFrame, k: int = 100) -> DataFrame:
    """Most frequent tokens of five characters or more in labels."""
    rows = labels.select(F.explode(F.regexp_extract_all(F.lower("label"), F.lit("([a-z0-9]{5,})"), F.lit(1))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(k)


def chunks(texts: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """Overlapping stretches (id, chunk_id, text) of the white-space squashed text; the last one ends with the text."""
    step = max(1, size - overlap)
    rows = texts.select("id", squash("text").alias("t")).where("t <> ''")
    count = F.greatest(F.lit(0), F.ceil((F.length("t") - size) / step)).cast("int") + 1
    rows = rows.select("id", "t", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_id"))
    return rows.select("id", "chunk_id", F.substring(F.col("t"), F.col("chunk_id") * step + 1, F.lit(size)).alias("text"))


def sections(texts: DataFrame, pattern: str = r"^(abstract|introduction|related work|method[s]?|experiments?|results|discussion|limitations?|conclusions?)(?:[^\p{L}\p{N}_]|$)") -> DataFrame:
    """First line (id, heading, start) of every kind of heading, with its character offset; headings have 80 characters at most."""
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    head = F.regexp_extract(F.lower(F.trim("line")), pattern, 1)
    found = lines.select("id", "i", head.alias("heading"), F.length(F.trim("line")).alias("n")).where("heading <> '' AND n <= 80")
    first = found.groupBy("id", "heading").agg(F.min("i").alias("i"))
    # the offset of a line is the length of what stands before it, read from the text itself
    start = F.length(F.array_join(F.slice(F.split("text", "\n"), 1, F.col("i")), "\n")) + F.when(F.col("i") > 0, 1).otherwise(0)
    return first.join(texts, "id").select("id", "heading", start.cast("long").alias("start"))


def snippets(texts: DataFrame, terms: list[str], window: int = 600) -> DataFrame:
    """Text around the first occurrence of any term."""
    low = F.lower("text")
    at = F.array_min(F.filter(F.array(*[F.instr(low, t) for t in terms]), lambda x: x > 0))
    rows = texts.withColumn("at", at).where("at IS NOT NULL")
    return rows.select("id", F.col("at").cast("long").alias("at"), F.substring(F.col("text"), F.greatest(F.lit(1), F.col("at") - window // 2), F.lit(window)).alias("snippet"))


def rerank(rows: DataFrame, query: list[float], weight: float = 12.0) -> DataFrame:
    """Adds score = base + weight * cosine of (embedding, base) with unit vectors."""
    cosine = dot("embedding", F.array(*[F.lit(float(x)) for x in query]))
    return rows.withColumn("score", F.col("base") + weight * cosine)


#: Most blocks that a selection's rows are divided into; rows of a block, until there are that many; blocks looked at together.
BLOCKS, BLOCK_ROWS, AT_ONCE = 512, 1024, 8


def mmr(rows: DataFrame, k: int, balance: float = 0.75, blocks: int | None = None, seen: list[int] | None = None) -> DataFrame:
    """Maximal marginal relevance over all rows (id, score, embedding): (id, position).  Ties go to the larger score, then to the lesser id.

    A row's value only falls as more are chosen, so a value from an earlier round is an upper bound.  Rows are written in blocks by score, and the driver keeps one
    bound for each of the blocks (``BLOCKS`` at most); a round reads the blocks with the largest bounds until no other block can hold a better row.  ``seen`` takes
    the number of blocks read in each round.
    """
    rows = rows.select("id", F.col("score").cast("double").alias("score"), "embedding")
    spark, schema = rows.sparkSession, f"id {dict(rows.dtypes)['id']}, position int"
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    if n <= k:
        all_rows = rows.orderBy(F.desc("score"), "id").collect()
        return spark.createDataFrame([(r["id"], i) for i, r in enumerate(all_rows, 1)], schema)
    blocks = blocks or min(BLOCKS, -(-n // BLOCK_ROWS))
    relevance = lambda score: (score - low) / (high - low) if high > low else score
    place = ranked(rows, [F.desc("score"), F.asc("id")], "place").withColumn("block", F.floor((F.col("place") - 1) * blocks / n).cast("int"))
    table = kept(place.drop("place").repartition("block"), "mmr", "block")
    bounds = {r["block"]: balance * relevance(r["top"]) for r in table.groupBy("block").agg(F.max("score").alias("top")).collect()}  # a row for each block
    chosen: list[tuple] = []

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = [i for i, _ in chosen], [_unit(np.array([v]))[0] for _, v in chosen]
        for p in parts:
            p = p[~p["id"].isin(ids)]
            if not len(p):
                continue
            value = balance * relevance(p["score"].to_numpy(float))
            if vectors:
                v = _unit(np.stack(p["embedding"].to_numpy()).astype(float))
                # sums by row: equal vectors get equal similarities wherever they stand
                value = value - (1 - balance) * np.max([(v * c).sum(axis=1) for c in vectors], axis=0)
            p = p.assign(value=value).sort_values(["value", "score", "id"], ascending=[False, False, True])
            yield p.groupby("block").head(1)

    kinds = ", ".join(f"{c} {t}" for c, t in table.dtypes)
    while len(chosen) < k:
        top, fresh = None, set()
        while True:
            order = sorted((b for b in bounds if b not in fresh), key=lambda b: -bounds[b])
            some = [b for b in order[:AT_ONCE] if top is None or bounds[b] >= top["value"] - 1e-12]
            if not some:
                break
            found = table.where(F.col("block").isin(some)).mapInPandas(best, f"{kinds}, value double").orderBy(F.desc("value"), F.desc("score"), "id").collect()  # some rows for each of few blocks
            fresh.update(some)
            for b in some:
                bounds[b] = max((r["value"] for r in found if r["block"] == b), default=-np.inf)
            for r in found[:1]:
                if top is None or (-r["value"], -r["score"], r["id"]) < (-top["value"], -top["score"], top["id"]):
                    top = r
        if seen is not None:
            seen.append(len(fresh))
        chosen.append((top["id"], top["embedding"]))
    return spark.createDataFrame([(i, n) for n, (i, _) in enumerate(chosen, 1)], schema)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def abstract_from_index(rows: DataFrame) -> DataFrame:
    """Text (id, abstract) from an inverted index (id, index map<string, array<int>>)."""
    places = rows.select("id", F.explode("index").alias("word", "at")).select("id", "word", F.explode("at").alias("p"))
    ordered = places.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("p", "word"))).alias("o"))
    return ordered.select("id", F.array_join(F.transform("o", lambda x: x["word"]), " ").alias("abstract"))


def best_match(left: DataFrame, right: DataFrame, similarity: Column, threshold: float, key: str) -> DataFrame:
    """For each left row its most similar right row that shares the blocking column ``key``."""
    joined = left.join(right, key).withColumn("similarity", similarity).where(F.col("similarity") >= threshold)
    by = Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id")
    return joined.withColumn("rank", F.row_number().over(by)).where("rank = 1")
