"""Packing of token sequences: vector bin packing by the dot-product heuristic.

Every example has a vector of demands (tokens, segments, loss-bearing tokens) and every sequence a vector of capacities.  One sequence
is filled at a time from a bounded buffer of waiting examples: among those that fit, the one whose demands have the largest dot product
with the sequence's remaining capacities goes in.  When none fits, or the last segment could take more, the waiting example of which most goes in is cut;
a sequence that no cut can fill is cut into lengths that are powers of two, which need no padding.  Each task packs the rows it
reads, so nothing is shuffled, and memory is bounded by the buffer.

Defined cases: a null or empty text is the closing id alone; a text of any length is cut into whole sequences and a rest; repeated rows
are packed as often as they occur; an empty table gives an empty result; other columns are ignored.  Sequence numbers
carry the task's number in their upper bits and differ between tasks.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import batched, column, small_batches

END = 0  # id that closes every document


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE vocabulary at ``path`` as a function from text to ids.

    The ranks beside the JSON file give the same ids faster; the JSON tokenizer serves texts on which their pattern engine gives up.
    """
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    specials = {t.content: i for i, t in exact.get_added_tokens_decoder().items()}
    with open(path.rsplit(".", 1)[0] + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=specials)

    def encode(text: str) -> np.ndarray:
        try:
            ids = fast.encode(text, allowed_special="all")
        except Exception:  # the pattern engine's limits on very long runs
            ids = exact.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4")

    return encode


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 1024
    segments: int = 256
    loss: int = 1024


@dataclass
class Piece:
    """Part of an example: its ids and loss marks from ``start`` on; ``total`` counts the whole example's ids."""

    key: object
    start: int
    ids: np.ndarray
    loss: np.ndarray
    total: int

    def split(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.key, self.start, self.ids[:n], self.loss[:n], self.total),
            Piece(self.key, self.start + n, self.ids[n:], self.loss[n:], self.total),
        )


@dataclass
class Packer:
    """Packs the pieces it is given; yields whole sequences as lists of pieces."""

    limits: Limits = field(default_factory=Limits)
    waiting: int = 256

    def __post_init__(self) -> None:
        self.cap = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], dtype=float)
        self.items: list[Piece] = []
        self.demand = np.zeros((2 * self.waiting + 8, 3))
        self.silent = np.zeros(len(self.demand))  # leading ids without loss

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Takes one example; yields the sequences that are then complete."""
        size = self.limits.tokens
        while len(piece.ids) >= size and int(piece.loss[:size].sum()) <= self.limits.loss:
            head, piece = piece.split(size)
            yield [head]
        if len(piece.ids) == 0:
            return
        while len(piece.ids) >= size or int(piece.loss.sum()) > self.limits.loss:  # too much loss for one sequence
            at = min(size - 1, int(np.searchsorted(np.cumsum(piece.loss), self.limits.loss, "right")))
            head, piece = piece.split(max(1, at))
            self._wait(head)
        if len(piece.ids):
            self._wait(piece)
        while len(self.items) >= self.waiting:
            yield from self._fill()

    def finish(self) -> Iterator[list[Piece]]:
        while self.items:
            yield from self._fill()

    def _wait(self, piece: Piece) -> None:
        if len(self.items) == len(self.demand):
            self.demand = np.vstack([self.demand, np.zeros_like(self.demand)])
            self.silent = np.append(self.silent, np.zeros_like(self.silent))
        self.demand[len(self.items)] = (len(piece.ids), 1, piece.loss.sum())
        self.silent[len(self.items)] = int(piece.loss.argmax()) if piece.loss.any() else len(piece.ids)
        self.items.append(piece)

    def _take(self, i: int) -> Piece:
        """Removes item i; the last one takes its place."""
        got, last = self.items[i], len(self.items) - 1
        self.items[i] = self.items[last]
        self.demand[i], self.silent[i] = self.demand[last], self.silent[last]
        self.items.pop()
        return got

    def _fill(self) -> Iterator[list[Piece]]:
        left, held = self.cap.copy(), []
        while self.items and left[0] > 0 and left[1] > 0:
            d = self.demand[: len(self.items)]
            value = d @ (left / self.cap**2)
            value[(d > left).any(axis=1)] = -1
            i = int(value.argmax())
            most = np.minimum(np.minimum(left[0], d[:, 0] - 1), self.silent[: len(d)] + left[2])  # what a cut could take at least
            # none fits, or the last segment would take less than a cut could: cut where most goes in
            if value[i] < 0 or left[1] == 1 and d[i, 0] < min(left[0], most.max()):
                i = int(most.argmax())
                piece, n = self.items[i], int(most[i])
                if n < 1:
                    break
                head, rest = self._take(i).split(n)
                self._wait(rest)
                held.append(head)
                left -= (n, 1, head.loss.sum())
                continue
            left -= d[i]
            held.append(self._take(i))
        if left[0] == 0:
            yield held
        else:
            yield from powers_of_two(held)


def powers_of_two(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces in sequences whose lengths are the powers of two of the sum, largest first."""
    total = sum(len(p.ids) for p in pieces)
    queue = list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        left, out = 1 << bit, []
        while left:
            p = queue.pop()
            if len(p.ids) > left:
                p, rest = p.split(left)
                queue.append(rest)
            out.append(p)
            left -= len(p.ids)
        yield out


def _rows(sequences: Iterator[list[Piece]], number: Iterator[int], with_ids: bool) -> Iterator[tuple]:
    for pieces in sequences:
        k, at = next(number), 0
        for p in pieces:
            row = (p.key, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, k, at, int(p.loss.sum()))
            yield (*row, p.ids.tolist()) if with_ids else row
            at += len(p.ids)


def _numbers() -> Iterator[int]:
    k = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    while True:
        yield k
        k += 1


def pack_examples(examples: DataFrame, key: str, limits: Limits = Limits(), waiting: int = 256, with_ids: bool = True) -> DataFrame:
    """Packs rows (``key`` long, ids array<int>, loss array<boolean>): instruction data, for example, with loss on answers only."""
    small_batches(examples.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        for batch in batches:
            for k, ids, loss in zip(column(batch, key), column(batch, "ids"), column(batch, "loss"), strict=True):
                ids = np.array(ids or [], dtype="<u4")
                marks = np.ones(len(ids), dtype=bool) if loss is None else np.array([bool(x) for x in loss], dtype=bool)
                yield Piece(k, 0, ids, marks, len(ids))

    return _packed(examples.select(key, "ids", "loss"), pieces, key, limits, waiting, with_ids)


def shares(whole: Piece, context: int, size: int) -> Iterator[Piece]:
    """A long example as equal shares of its context (its first ids) and of its rest, so that each sequence can take some of both."""
    n = len(whole.ids)
    if n <= size or context <= n // size:  # short, or too little context for a share in every sequence
        yield whole
        return
    m = -(-n // size)
    for i in range(m):
        for first, end in ((0, context), (context, n)):
            a, b = first + (end - first) * i // m, first + (end - first) * (i + 1) // m
            if a < b:
                yield Piece(whole.key, a, whole.ids[a:b], whole.loss[a:b], whole.total)


def pack_documents(docs: DataFrame, path: str | None = None, limits: Limits = Limits(), waiting: int = 256, with_ids: bool = False, context: float = 0.0) -> DataFrame:
    """Packs documents: one row per piece with doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens (and ids).

    The first ids of a document, the share ``context`` of them and one at least, are read without loss, as a prefix language model does; all others bear loss.
    """
    small_batches(docs.sparkSession)
    path = public_tokenizers.path("byte_bpe_50k.json") if path is None else path

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        encode = encoder(path)
        for batch in batches:
            for k, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                ids = np.append(encode(text or ""), np.array([END], dtype="<u4"))
                silent = max(1, int(context * len(ids)))
                loss = np.ones(len(ids), dtype=bool)
                loss[:silent] = False
                yield from shares(Piece(k, 0, ids, loss, len(ids)), silent, limits.tokens)

    return _packed(docs.select("doc_id", "text"), pieces, "doc_id", limits, waiting, with_ids)


def _packed(rows: DataFrame, pieces, key: str, limits: Limits, waiting: int, with_ids: bool) -> DataFrame:
    fields = [(key, pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64())]
    spec = ", ".join(f"{n} long" for n, _ in fields)
    if with_ids:
        fields.append(("ids", pa.list_(pa.int64())))
        spec += ", ids array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(limits, waiting), _numbers()

        def sequences() -> Iterator[list[Piece]]:
            for p in pieces(batches):
                yield from packer.add(p)
            yield from packer.finish()

        yield from batched(_rows(sequences(), number, with_ids), pa.schema(fields))

    return rows.mapInArrow(run, spec)
