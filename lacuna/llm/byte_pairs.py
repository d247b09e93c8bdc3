"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Words (the pattern's matches) are encoded together instead of one by one: :func:`replay` lays many distinct words out in one byte string, indexes
the positions of every token pair by the rank of its merge, and applies the merges in rank order, each at all its positions; only the pairs
to the left and right of a merged one are looked up anew.  A merge that opens a pair of lower rank is interrupted for it, so every word goes through the
same merges as alone.  A word that is a token itself is that token.

Over a corpus: one pass counts the words; the most frequent ones (``COMMON`` at most, by their counts, and ``SHORT`` bytes long at most) are replayed by
Spark's tasks, each over its share of the vocabulary, and broadcast.  A second pass replaces words by ids; words that are not common are
replayed together, batch by batch, and remembered up to ``KNOWN``.  Which words are common changes no result.

Ids are kept as little-endian unsigned 32-bit integers, one binary value a document; decoding joins the ids' bytes.

Defined cases: a null text counts as empty and has no ids; texts and words of any length are encoded whole; repeated rows give equal results; an
empty table gives an empty result; other columns are ignored; ids that the vocabulary lacks are refused.
"""

from __future__ import annotations

import base64
import gc
import re
import sys
import uuid
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, batched, column, small_batches

LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
DEFAULT = "byte_bpe_multi_50k.tiktoken"
#: Common words at most; the greatest length of a word that is remembered; words a worker remembers besides; words that a batch of counts holds.
COMMON, SHORT, KNOWN, COUNTED = 250_000, 64, 400_000, 200_000


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        found = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    if not all(bytes([b]) in found for b in range(256)):
        raise ValueError("every single byte must be a token")
    return found


@lru_cache(maxsize=2)
def tokens(path: str) -> list[bytes | None]:
    """Bytes by id."""
    known = ranks(path)
    out: list[bytes | None] = [None] * (max(known.values()) + 1)
    for token, i in known.items():
        out[i] = token
    return out


def _bytes_paired(text: bytes, ends: np.ndarray, known: dict[bytes, int]) -> dict[int, list[int]]:
    """Rank of every merge of two bytes, and where they stand, in order; none reaches into or over an end."""
    ranked = np.full(1 << 16, -1, dtype=np.int64)
    for token, r in known.items():
        if len(token) == 2:
            ranked[token[0] << 8 | token[1]] = r
    byte = np.frombuffer(text, dtype=np.uint8).astype(np.int64)
    found = np.append(ranked[byte[:-1] << 8 | byte[1:]], -1)
    found[ends], found[ends - 1] = -1, -1
    at = np.flatnonzero(found >= 0)
    at = at[np.argsort(found[at], kind="stable")]
    of = found[at]
    cuts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(at)).tolist()
    where = at.tolist()
    return {int(of[i]): where[i:j] for i, j in zip(cuts, cuts[1:], strict=False)}


def replay(words: list[bytes], known: dict[bytes, int]) -> list[list[int]]:
    """Ids of every word, all merged together in rank order."""
    out: list[list[int] | None] = [[known[w]] if w in known else None if w else [] for w in words]
    open_ = [w for w, ids in zip(words, out, strict=True) if ids is None]
    if not open_:
        return out
    text = b"\0".join([*open_, b""])  # a byte behind every word stands for its end
    rank = known.get
    ends = np.cumsum([len(w) + 1 for w in open_]) - 1
    starts = np.append(0, ends[:-1] + 1)
    follows, precedes = np.arange(1, len(text) + 1), np.arange(-1, len(text) - 1)
    follows[ends], precedes[starts] = 0, -1  # no pair begins at an end
    after, before, spots = follows.tolist(), precedes.tolist(), _bytes_paired(text, ends, known)
    size = {}
    waiting = list(spots)
    heapify(waiting)
    while waiting:
        r = heappop(waiting)
        where = spots.pop(r, None)
        if where is None:
            continue
        where.sort()
        n = size.get(r) or 2
        for k, i in enumerate(where):
            j = after[i]
            if j <= 0 or after[j] != i + n:  # merged otherwise since
                continue
            end = i + n
            after[i], after[j], before[end] = end, -1, i
            lower = False
            left, right = before[i], after[end]
            for a, z in ((left, end), (i, right)):
                if a < 0 or z <= 0:
                    continue
                new = rank(text[a:z])
                if new is None:
                    continue
                if new not in spots:
                    spots[new] = []
                    size[new] = z - a
                    heappush(waiting, new)
                spots[new].append(a)
                lower = lower or new < r
            if lower and k + 1 < len(where):
                spots.setdefault(r, []).extend(where[k + 1 :])
                heappush(waiting, r)
                break
    cut = iter(zip(open_, starts.tolist(), strict=True))
    for place, ids in enumerate(out):
        if ids is None:
            word, i = next(cut)
            end, ids = i + len(word), []
            while i < end:
                z = after[i]
                ids.append(known[text[i:z]])
                i = z
            out[place] = ids
    return out


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if LITTLE else np.array(ids, dtype="<u4").tobytes()


#: Letters, numbers and white space below U+0250, and further punctuation that is none of them: texts of these alone are cut by plain classes.
LETTERS, NUMBERS, SPACE = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t-\\r \u0085\u00a0"
OTHER = "\u2010-\u2027\u2030-\u205e\u20ac"


def splitter() -> Callable[[str], list[str]]:
    """A text's words; texts of Latin letters are cut by the same pattern with its classes spelled out, which is faster."""
    spelled = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACE}{LETTERS}{NUMBERS}]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]")
    plain = re.compile(spelled.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")).findall
    strange = re.compile(f"[^\\x00-\u024f{OTHER}]").search
    every = regex.compile(public_tokenizers.PATTERN).findall
    return lambda text: plain(text) if text.isascii() or not strange(text) else every(text)


@dataclass
class Encoder:
    """A worker's words: the common ones and those remembered besides."""

    path: str
    common: dict[str, bytes]
    remembered: int = KNOWN

    def __post_init__(self) -> None:
        self.known, self.split = ranks(self.path), splitter()
        self.memo = dict(self.common)

    def encode(self, texts: list[str]) -> list[bytes]:
        memo = self.memo
        cut = [self.split(t) for t in texts]
        new = list({w for words in cut for w in set(words) if w not in memo})
        if len(memo) + len(new) > len(self.common) + self.remembered:
            memo = self.memo = dict(self.common)
            new = list({w for words in cut for w in set(words) if w not in memo})
        gc.disable()  # many short lists, none of which refer to one another
        try:
            memo.update(zip(new, map(packed, replay([w.encode() for w in new], self.known)), strict=True))
        finally:
            gc.enable()
        out = [b"".join(map(memo.__getitem__, words)) for words in cut]
        for w in new:
            if len(w) > SHORT:
                del memo[w]
        return out


_encoders: dict[str, Encoder] = {}


def _encoder(path: str, run_id: str, common: Broadcast, remembered: int) -> Encoder:
    """The worker's encoder, kept from task to task of one run."""
    if run_id not in _encoders:
        _encoders.clear()
        _encoders[run_id] = Encoder(path, common.value, remembered)
    return _encoders[run_id]


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: how often every word stands in the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        held: Counter[str] = Counter()
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        for batch in batches:
            for text in column(batch, "text"):
                held.update(split(text or ""))
            if len(held) > COUNTED:
                yield from batched(iter(held.items()), schema, 8192)
                held.clear()
        yield from batched(iter(held.items()), schema, 8192)

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(docs: DataFrame, path: str) -> dict[str, bytes]:
    """Ids of the COMMON most frequent words at most (all words of a count or none); each task replays its share of them."""
    tables = Tables(docs.sparkSession, "words")
    words = tables.write(vocabulary(docs).where((F.col("n") > 1) & (F.octet_length("word") <= SHORT)), "words")
    steps = F.floor(8 * F.log2("n")).cast("int")  # counts within a twelfth of one another fall together: some hundreds of steps at most
    least, total = None, 0
    for r in sorted(words.groupBy(steps.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        total += r.words
        if total > COMMON:
            break
        least = r.step
    often = words.where(steps >= least) if least is not None else words.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = column(batch, "word")
            ids = replay([w.encode() for w in found], ranks(path))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(map(packed, ids), pa.binary())], ["word", "ids"])

    out = {r.word: bytes(r.ids) for r in often.mapInArrow(run, "word string, ids binary").collect()}
    tables.drop(words)
    return out


def encode(docs: DataFrame, path: str | None = None, remembered: int = KNOWN) -> DataFrame:
    """doc_id, ids (binary, 32 bits each)."""
    path = path or public_tokenizers.path(DEFAULT)
    spark = docs.sparkSession
    small_batches(spark)
    shared, run_id = spark.sparkContext.broadcast(common_words(docs, path)), uuid.uuid4().hex
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, run_id, shared, remembered)
        for batch in batches:
            ids = encoder.encode([t or "" for t in column(batch, "text")])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of ``encoded`` and ``decoded``: the bytes that the ids stand for."""
    path = path or public_tokenizers.path(DEFAULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = tokens(path)
        for batch in batches:
            ids = (np.frombuffer(x or b"", dtype="<u4").tolist() for x in column(batch, "ids"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b"".join(map(spelled.__getitem__, x)) for x in ids], pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, encoded.withColumn("decoded", F.lit(b"")).schema)


def byte_pair_digests(docs: DataFrame, path: str | None = None, remembered: int = KNOWN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    done = decode(encode(docs, path, remembered), path)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
