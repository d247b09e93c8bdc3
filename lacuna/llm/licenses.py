"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is any ``BLOCK`` consecutive words of a text (fewer where the text ends), at every place.  It matches a template T if it contains the share t
of T's tokens.  Template tokens are ordered by their frequency over the whole corpus, rarest first, and three filters go before the count:

* prefix: a block that matches holds one of T's first |T| - ceil(t |T|) + 1 tokens, so a text without them is done, and so is every block;
* position: a block that matches can be moved on to its first token of T without losing any, so only blocks that begin at such a token count;
* length: from its begin on a block must have ceil(t |T|) words.

Blocks left are verified by the intersection with the template.  Everything happens within a document's row: the templates are a fixed list, so nothing
but the token frequencies is shuffled.  Base phrases are templates with threshold 1, followed by a check that their words stand consecutively; so they
begin a block of their own.

Defined cases: a null text counts as empty; an empty text has no words and no label and score 0; a null or repeated doc_id gives a row like any other,
and repeated rows repeated results; equal frequencies order by the token; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64  # words of a block; templates have as many different ones at most
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base phrases with their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Notices of common licenses with their labels.
NOTICES = (
    ("free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("released under the mit license", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc"),
)


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    threshold: float
    phrase: bool

    @property
    def tokens(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.words))

    @property
    def need(self) -> int:
        return math.ceil(self.threshold * len(self.tokens) - 1e-9)


def templates(threshold: float = 0.8) -> list[Template]:
    out = [Template(tuple(p.split()), label, 1.0, True) for p, label in BASE]
    out += [Template(tuple(p.split()), label, threshold, False) for p, label in NOTICES]
    return out


def _parts(text: Column) -> Column:
    """Words of the whole text, A-Z lower-cased: runs of digits, letters and non-ASCII characters; a separator at either end leaves one empty part there."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)


def words(text: Column) -> Column:
    """The parts without empty ones.  The split stands in it several times, which only code that shares subexpressions evaluates once."""
    parts = _parts(text)
    return F.slice(
        parts,
        F.when(parts[0] == "", 2).otherwise(1),
        F.greatest(F.size(parts) - F.when(parts[0] == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0), F.lit(0)),
    )


def token_frequencies(docs: DataFrame, tokens: Sequence[str]) -> dict[str, int]:
    """How often each token stands in the texts; the result has a row for each token at most."""
    found = docs.select(F.explode(_parts(F.col("text"))).alias("token")).where(F.col("token").isin(*tokens))
    return {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _stands(t: Template):
    """Whether the template's words stand consecutively from a place on."""

    def test(at: Column) -> Column:
        found = F.get("w", at) == t.words[0]
        for k, w in enumerate(t.words[1:], 1):
            found = found & (F.coalesce(F.get("w", at + k), F.lit("")) == w)
        return found

    return test


def _blocks(t: Template, prefix: Sequence[str], block: int) -> Column:
    """(s, k) of the blocks that match: their first word and how many of the template's tokens they hold."""
    tokens, rare = _strings(t.tokens), _strings(prefix)
    part = lambda s: F.slice("w", s + 1, F.lit(block))
    starts = F.filter(
        F.sequence(F.lit(0), F.col("n_words") - t.need),
        lambda s: F.get("w", s).isin(*t.tokens) & F.arrays_overlap(part(s), rare),
    )
    counted = F.transform(starts, lambda s: F.struct(s.alias("s"), F.size(F.array_intersect(part(s), tokens)).alias("k")))
    found = F.filter(counted, lambda x: x["k"] >= t.need)
    return F.when((F.col("n_words") >= t.need) & F.arrays_overlap("w", rare), found)


def license_scan(docs: DataFrame, known: list[Template] | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    known = templates() if known is None else known
    if any(len(t.tokens) > block or t.phrase and len(t.words) > block for t in known):
        raise ValueError(f"a template may have {block} different words at most")
    often = token_frequencies(docs, sorted({w for t in known for w in t.tokens}))
    ordered = [sorted(t.tokens, key=lambda w: (often.get(w, 0), w)) for t in known]
    prefix = [tokens[: len(tokens) - t.need + 1] for t, tokens in zip(known, ordered, strict=True)]
    marks = sorted({w for p in prefix for w in p})
    n = F.col("n_words")

    rows = docs.select("doc_id", words(F.col("text")).alias("w"))
    rows = rows.select("doc_id", "w", F.size("w").alias("n_words"), F.arrays_overlap("w", _strings(marks)).alias("any"))
    found = {f"m{i}": F.when(F.col("any"), _blocks(t, p, block)) for i, (t, p) in enumerate(zip(known, prefix, strict=True))}
    rows = rows.select("doc_id", "w", "n_words", *[c.alias(k) for k, c in found.items()])
    phrases = [(i, t) for i, t in enumerate(known) if t.phrase]
    notices = [(i, t) for i, t in enumerate(known) if not t.phrase]
    none = F.array().cast("array<int>")
    begins = [F.filter(F.coalesce(F.transform(f"m{i}", lambda x: x["s"]), none), _stands(t)).alias(f"p{i}") for i, t in phrases]
    shares = [F.coalesce(F.array_max(F.transform(f"m{i}", lambda x: x["k"])), F.lit(0)).alias(f"k{i}") for i, _ in notices]
    rows = rows.select("doc_id", "n_words", *begins, *shares)
    base = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(t.label)) for i, t in phrases]))
    own = F.array_compact(F.array(*[F.when(F.col(f"k{i}") > 0, F.lit(t.label)) for i, t in notices])) if notices else F.array().cast("array<string>")
    share = F.greatest(F.lit(0.0), F.lit(0.0), *[F.col(f"k{i}") / len(t.tokens) for i, t in notices])
    rows = rows.select(
        "doc_id", "n_words", (F.concat(*[f"p{i}" for i, _ in phrases]) if phrases else none).alias("every"), F.array_sort(F.array_distinct(base)).alias("base"), own.alias("own"), share.alias("share"),
    )
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"),
        F.array_max("every").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", "own"))), ",").alias("labels"),
        F.when(F.size("every") > 0, F.lit(1.0)).otherwise(F.col("share")).alias("score"),
    )


def _sql_list(values: Sequence) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def oracle_sql(known: list[Template] | None = None) -> str:
    """DuckDB SQL for :func:`license_scan`: the blocks that begin at any of a template's tokens, without other filters."""
    known = templates() if known is None else known
    rows = ", ".join(f"({i}, {_sql_list(t.tokens)}, {t.need}, {t.phrase}, '{t.label}')" for i, t in enumerate(known))
    places = " UNION ALL ".join(
        f"SELECT doc_id, i, '{t.label}' AS label FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM t) WHERE "
        + " AND ".join(f"coalesce(w[i + {k + 1}], '') = '{x}'" for k, x in enumerate(t.words))
        for t in known if t.phrase
    )
    return rf"""
        WITH t AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        templates(id, tokens, need, phrase, label) AS (VALUES {rows}),
        places AS (SELECT doc_id, w[i + 1] AS token, i FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM t)),
        tokens AS (SELECT id, need, len(tokens) AS size, label, unnest(tokens) AS token FROM templates WHERE NOT phrase),
        stands AS (SELECT doc_id, id, need, size, label, i, token FROM places JOIN tokens USING (token)),
        matched AS (
          SELECT a.doc_id, a.label, count(DISTINCT b.token) / any_value(a.size)::DOUBLE AS share
          FROM stands a JOIN stands b ON b.doc_id = a.doc_id AND b.id = a.id AND b.i BETWEEN a.i AND a.i + {BLOCK - 1}
          GROUP BY a.doc_id, a.id, a.label, a.i HAVING count(DISTINCT b.token) >= any_value(a.need)),
        notices AS (SELECT doc_id, max(share) AS share, list(DISTINCT label) AS labels FROM matched GROUP BY doc_id),
        phrases AS ({places}),
        base AS (
          SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels
          FROM phrases GROUP BY doc_id)
        SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
          CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
          array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
          array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(notices.labels, [])))), ',') AS labels,
          CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS DOUBLE) AS score
        FROM t LEFT JOIN base USING (doc_id) LEFT JOIN notices USING (doc_id)"""
