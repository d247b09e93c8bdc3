"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds one bitmask of languages per slot; an n-gram's languages are the bitwise AND of the
masks in its slots.  A document's n-grams are looked up together, the masks' bits are counted per language, each count is
corrected for that language's false-positive rate (its slice's fill to the power of the number of hash functions), and the largest
corrected share decides.

Learning: document frequencies of n-grams per language, over a bounded sample of labelled rows (``sample_per_language``
rows expected per language, chosen by a hash of the id); every n-gram that the share ``least_share`` of a language's sampled rows hold enters the filter.

Defined cases: null text, or text without any letter, gives ``und`` and score 0; text without evidence (too short for an n-gram, or none of
its n-grams in any filter) gives the language learned from most rows with score 0; ties go to the language learned from more rows, then to the
lesser name; no labelled row at all gives ``und`` throughout; a null or repeated doc_id gives a row like any other; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, column, small_batches

GRAM = 5  # bytes
HASHES = 3
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
SEGMENT = 1 << 20
LETTER = re.compile(r"[^\W\d_]")

_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def grams(text: str) -> Iterator[np.ndarray]:
    """The text's n-grams as integers, segment by segment: lower case, all but letters as a space, four letter bytes at least."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    for at in range(0, max(len(raw) - GRAM + 1, 0), SEGMENT):
        part = np.zeros(min(SEGMENT + GRAM - 1, len(raw) - at) + 8 - GRAM, dtype=np.uint8)
        part[: len(part) - 8 + GRAM] = _FOLD[raw[at : at + SEGMENT + GRAM - 1]]
        n = len(part) - 7
        wide = np.ndarray(shape=(n,), dtype="<u8", buffer=part, strides=(1,)) & np.uint64((1 << (8 * GRAM)) - 1)
        blank = np.concatenate(([0], np.cumsum(part == 0x20)))
        yield wide[(blank[GRAM : GRAM + n] - blank[:n]) <= 1]


@dataclass
class Filter:
    """Languages in order of preference, slots (one 64-bit mask per group of 64 languages), corrected rates."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def build(cls, languages: list[str], grams_of: dict[str, np.ndarray], bits_per_gram: int = 16) -> Filter:
        most = max((len(g) for g in grams_of.values()), default=1)
        size = 1 << max(10, int(np.ceil(np.log2(max(1, most * bits_per_gram)))))
        slots = np.zeros((max(1, -(-len(languages) // 64)), size), dtype=np.uint64)
        for i, name in enumerate(languages):
            for at in cls._places(grams_of[name], size):
                slots[i // 64, at] |= np.uint64(1 << (i % 64))
        fill = np.array([np.mean((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(languages))])
        return cls(languages, slots, fill**HASHES)

    @staticmethod
    def _places(g: np.ndarray, size: int) -> list[np.ndarray]:
        shift = np.uint64(64 - int(size).bit_length() + 1)
        return [((g * m) >> shift).astype(np.int64) for m in MULTIPLIERS]

    def counts(self, g: np.ndarray) -> np.ndarray:
        """For each language, how many of the n-grams its slice holds."""
        places = self._places(g, self.slots.shape[1])
        out = np.zeros(len(self.languages))
        for w in range(len(self.slots)):
            word = self.slots[w]
            masks = word[places[0]] & word[places[1]] & word[places[2]]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                out[i] = np.count_nonzero(masks & np.uint64(1 << (i % 64)))
        return out

    def predict(self, text: str | None) -> tuple[str, float, int, float]:
        """Language, score, n-grams read, and the corrected number of them that the language's slice holds."""
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0, 0, 0.0
        total, hits = 0, np.zeros(len(self.languages))
        for g in grams(text):
            total += len(g)
            hits += self.counts(g)
        share = np.clip((hits - total * self.false_rate) / (1 - self.false_rate), 0, None)
        best = int(np.argmax(share))
        return self.languages[best], float(share[best] / share.sum()) if share.sum() > 0 else 0.0, total, float(share[best])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("df", pa.int64())])
    held: dict[str, list[np.ndarray]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n)], schema=schema)
        held.clear()

    size = 0
    for batch in batches:
        for text, lang in zip(column(batch, "text"), column(batch, "lang"), strict=True):
            parts = [np.unique(g) for g in grams(text)]
            if parts:
                held.setdefault(lang, []).append(np.unique(np.concatenate(parts)))
                size += len(held[lang][-1])
        if size > 4_000_000:
            yield from flush()
            size = 0
    yield from flush()


def fit(labelled: DataFrame, sample_per_language: int = 1000, least_share: float = 0.005) -> Filter:
    """Learns from the rows' text and lang; rows where either is null teach nothing."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Filter.build([], {})
    scale = 1 << 30
    bars = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(scale, sample_per_language * scale // n))])
    sample = rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(scale)) < bars[F.col("lang")])
    counted = sample.repartition(16, F.xxhash64("doc_id")).mapInArrow(_frequencies, "lang string, gram long, df long")
    # the table of n-grams is bounded by the sample: a language has at most 1 / least_share times its mean number of n-grams a row
    drawn = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    need = F.create_map(*[F.lit(x) for k in sizes for x in (k, max(1, math.ceil(least_share * drawn.get(k, 0))))])
    common = counted.groupBy("lang", "gram").agg(F.sum("df").alias("df")).where(F.col("df") >= need[F.col("lang")])
    got: dict[str, list[int]] = {k: [] for k in sizes}
    for r in common.select("lang", "gram").collect():
        got[r["lang"]].append(r["gram"])
    order = sorted(sizes, key=lambda k: (-sizes[k], k))
    return Filter.build(order, {k: np.array(got[k], dtype=np.int64).astype(np.uint64) for k in order})


def predict(docs: DataFrame, model: Filter, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_grams, evidence for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_grams", pa.int64()), ("evidence", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known = sent.value
        for batch in batches:
            for i, held, text in zip(column(batch, "doc_id"), column(batch, "held_out"), column(batch, "text"), strict=True):
                yield (i, held, *known.predict(text))

    held_out = F.lit(False) if held_out is None else held_out
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(
        lambda batches: batched(rows(batches), schema), "doc_id long, held_out boolean, lang_pred string, score double, n_grams long, evidence double"
    )


def language_id(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learns from the rows that are not held out, then predicts every row."""
    small_batches(docs.sparkSession)
    return predict(docs, fit(docs.where(~F.coalesce(held_out, F.lit(False)))), held_out)
