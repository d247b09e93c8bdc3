"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed as LZ78 does: each phrase is the shortest prefix of what is left that is not a phrase yet, so the phrase set is closed
under prefixes and the next phrase's end is found by searching over its length.  The fingerprint is the ``SIGNATURE`` smallest
hashes of the phrase set (bottom-k minimum-hash signature); two fingerprints are compared by the share of common values among the
smallest of their union, which estimates the Jaccard similarity of the phrase sets.

Defined cases: null text counts as empty; empty texts have the empty fingerprint, whose likeness is 1 to itself and 0 to any other;
equal texts have equal fingerprints; texts are parsed whole whatever their length; rows repeating a doc_id follow one another in the order of
their texts' hashes; null doc_ids come after all others; an empty table gives an empty result; with one document the next document is itself;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, column, small_batches

SIGNATURE = 128
BASE = 0x9E3779B97F4A7C15 | 1
STEP = 1 << 16
#: Powers of BASE and of its inverse modulo 2**64, for one step of the text.
def _powers(base: int) -> np.ndarray:
    out = np.full(STEP + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def phrase_ends(b: bytes) -> list[int]:
    """Ends of the LZ78 phrases of ``b``; a last phrase that is known already ends the list too."""
    seen: set[bytes] = set()
    add, out, i, n, k = seen.add, [], 0, len(b), 3
    while i < n:
        j = i + k
        p = b[i:j]
        if p in seen:
            while j < n:
                j += 1
                p = b[i:j]
                if p not in seen:
                    break
        else:
            while k > 1:
                q = b[i : j - 1]
                if q in seen:
                    break
                p = q
                j -= 1
                k -= 1
        add(p)
        i += len(p)
        out.append(min(i, n))
        k = len(p)
    return out


def phrase_hashes(b: bytes) -> np.ndarray:
    """A 32-bit hash of every phrase; hashes depend on the phrases only, not on where they stand."""
    ends = np.array(phrase_ends(b), dtype=np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    raw = np.frombuffer(b, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    out = np.empty(len(ends), dtype=np.uint64)
    lo = 0
    while lo < len(ends):  # polynomial sums step by step: a step holds whole phrases
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + STEP, "right")))
        s, e = int(starts[lo]), int(ends[hi - 1])
        if e - s > STEP:  # one phrase longer than a step
            digest = hashlib.blake2b(b[s:e], digest_size=8).digest()
            out[lo] = int.from_bytes(digest, "little")
        else:
            sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(raw[s:e] * _UP[: e - s])))
            a, z = starts[lo:hi] - s, ends[lo:hi] - s
            out[lo:hi] = (sums[z] - sums[a]) * _DOWN[a] + (z - a).astype(np.uint64)
        lo = hi
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0x94D049BB133111EB)
    return (out >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str | None) -> np.ndarray:
    """The smallest distinct hashes of the text's phrases, ascending."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return np.unique(phrase_hashes(b))[:SIGNATURE] if b else np.zeros(0, dtype=np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the phrase sets."""
    if not len(a) and not len(b):
        return 1.0
    least = np.union1d(a, b)[:SIGNATURE]
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(np.isin(common, least, assume_unique=True)) / len(least))


def hexed(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def edited(text: str, after: str) -> str:
    """The text with its last floor(n/2) characters replaced by the first as many of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex) of every row."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                yield i, hexed(fingerprint(text))

    return docs.select("doc_id", "text").mapInArrow(lambda b: batched(rows(b), schema), "doc_id long, fingerprint string")


#: Stands for a null doc_id in the order: after all others.
LAST = -(1 << 63)


def _rank(sorted_values: list[int], x: Column) -> Column:
    """How many of the ascending values are less than x, by binary search over one literal array."""
    if not sorted_values:
        return F.lit(0)
    values = F.array(*[F.lit(int(v)) for v in sorted_values])
    steps = F.array(*[F.lit(1 << k) for k in range(len(sorted_values).bit_length() - 1, -1, -1)])
    further = lambda at, step: (at + step <= len(sorted_values)) & (F.get(values, at + step - 1) < x)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))


def followed(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, doc_id, text, tail): each part holds a range of ids, descending, and one more row (tail) that follows its last.

    The texts are shuffled once, every part into a partition of its own.  The driver sees bounds and the largest id of each part only; null ids
    come last; rows that repeat an id follow one another by their texts' hashes, then by the texts.
    """
    ids = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"))
    bounds = sorted(set(ids.approxQuantile("_id", [i / parts for i in range(1, parts)], 0.0005))) if parts > 1 else []
    part = _rank([int(x) for x in bounds], F.col("_id"))  # rank of the range, ascending ids
    heads = {r["part"]: r["head"] for r in ids.select("_id", part.alias("part")).groupBy("part").agg(F.max("_id").alias("head")).collect()}  # a row for each part
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), "doc_id", "text").withColumn("part", part)
    if not heads:
        return rows.select("part", "doc_id", "_id", "text", F.lit(False).alias("tail"))
    order = sorted(heads, reverse=True)
    above = {k: order[i - 1] for i, k in enumerate(order)}  # the part that a part's head follows; the last one for the first
    table = lambda found: F.get(F.array(*[F.lit(found.get(k)).cast("long") for k in range(len(bounds) + 1)]), F.col("part"))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("tail"))
    extra = F.struct(table(above).cast("int").alias("part"), F.lit(True).alias("tail"))
    both = F.explode(F.when(F.col("_id") == table(heads), F.array(own, extra)).otherwise(F.array(own)))
    dealt = rows.withColumn("_to", both).select(F.col("_to.part").alias("part"), "doc_id", "_id", "text", F.col("_to.tail").alias("tail"))
    return dealt.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "tail", F.desc("_id"), F.xxhash64("text"), "text")


def edited_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited form, with the likenesses to the edited and to the next text."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    schema = pa.schema(fields)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None  # the row that waits for the one after it, with its fingerprint
        for batch in batches:
            for part, i, text, tail in zip(*(column(batch, c) for c in ("part", "doc_id", "text", "tail")), strict=True):
                text = text or ""
                if held is not None and held[0] != part:
                    held = None
                f = fingerprint(text)
                if held is not None:
                    _, key, mine, own = held
                    other = edited(mine, text)
                    g = fingerprint(other)
                    sha = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
                    yield (key, len(mine), sha, hexed(own), hexed(g), likeness(own, g), likeness(own, f))
                held = None if tail else (part, i, text, f)

    spec = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    dealt = followed(docs.select("doc_id", "text"), parts)
    return dealt.select("part", "doc_id", "text", "tail").mapInArrow(lambda b: batched(stream(b), schema, 256), spec)
