"""Many patterns in many texts: automata over bounded groups of patterns, first places of each key's patterns in each text.

Patterns are numbered and taken in groups of ``GROUP``; a group travels to the tasks as one automaton, which reads every text once and whole.  A text costs
its length for each group, whatever the number of patterns in it; there is no join of texts with patterns, and no task holds more than a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.scratch import kept, ranked

#: Patterns in one automaton.
GROUP = 20_000


def _search(found: list[tuple], texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First places (from 1) of every key with a pattern in a text."""
    keys: dict[str, list] = {}
    for key, pattern in found:
        keys.setdefault(pattern, []).append(key)
    automaton = ahocorasick.Automaton()
    for pattern, own in keys.items():
        automaton.add_word(pattern, (len(pattern), own))
    automaton.make_automaton()
    for p in texts:
        rows = []
        for i, text in zip(p["id"], p["text"], strict=True):
            first: dict = {}
            for end, (n, own) in automaton.iter(text or ""):
                at = end - n + 2
                for key in own:
                    if at < first.get(key, at + 1):
                        first[key] = at
            rows += [(key, i, at) for key, at in first.items()]
        yield pd.DataFrame(rows, columns=["key", "id", "place"])


def first_places(patterns: DataFrame, texts: DataFrame, group: int = GROUP) -> DataFrame:
    """(key, id, place): where, from 1, the first of a key's patterns (key, pattern) begins in a text (id, text), for every key and text that it is found in; empty patterns are nowhere."""
    listed = kept(ranked(patterns.where("pattern <> ''").distinct(), [F.asc("pattern"), F.asc("key")], "number").withColumn("part", F.floor((F.col("number") - 1) / group).cast("int")), "patterns", "part")
    groups = (listed.agg(F.max("part")).first()[0] or 0) + 1
    schema = f"key {dict(patterns.dtypes)['key']}, id {dict(texts.dtypes)['id']}, place long"
    out = None
    for g in range(groups):
        found = [(r.key, r.pattern) for r in listed.where(F.col("part") == g).select("key", "pattern").collect()]  # ``group`` at most
        if found:
            here = texts.select("id", "text").mapInPandas(lambda parts, found=found: _search(found, parts), schema)
            out = here if out is None else out.unionByName(here)
    if out is None:
        return patterns.sparkSession.createDataFrame([], schema)
    return out if groups == 1 else out.groupBy("key", "id").agg(F.min("place").alias("place"))


def snippets(patterns: DataFrame, texts: DataFrame, window: int = 600, group: int = GROUP) -> DataFrame:
    """(key, id, place, snippet): the text around the first place of a key's terms, case ignored; rows for keys and texts that meet."""
    low = texts.select("id", F.lower("text").alias("text"))
    at = first_places(patterns.select("key", F.lower("pattern").alias("pattern")), low, group)
    return at.join(texts.select("id", "text"), "id").select("key", "id", "place", F.substring(F.col("text"), F.greatest(F.lit(1), F.col("place") - window // 2).cast("int"), F.lit(window)).alias("snippet"))
