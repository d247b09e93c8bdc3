"""SentencePiece encoding and decoding by a max-plus parallel scan; the ids are the model's own.

Encoding is a path through the text's positions: pieces are its steps, piece scores (integers) add up, and a step is only open after a step that it
fits (else its weight is minus infinity).  In a model of pair merges two neighbouring pieces fit if their joined text is encoded as just these two;
a way to cut a text in which all neighbours fit is the one that merging yields, so one path is left to every position.  In a unigram model all
pieces fit, and the largest sum wins, among equal sums the longest piece at every end position, from the end backwards.

Giant texts are divided into chunks.  A path crosses a chunk's border in a state: the piece that lies across the border or ends at it, by how far it
reaches back and ahead.  Each chunk yields the max-plus matrix from entry to exit states; matrices are combined associatively, in a tree of bounded
fan-in, which gives every chunk its entry scores.  Then every chunk yields the map from exit state to the entry state of the best path, these maps
are combined likewise from the end, and every chunk is backtraced by itself between its two states.

Within a chunk, a text falls into units that no piece crosses (a run of word marks with what follows it, or a character that is in no longer
piece); units seen before are not cut again.  A chunk with two such borders has a matrix of rank one but for its first stretch.

Characters in no piece become their UTF-8 bytes' pieces, scored as one unknown character: the least score less 10.

Defined cases: a null text counts as empty; an empty text has no pieces and score 0; a word mark (U+2581) in a text decodes as a space, as in
the model's own decoding, and its round trip is then false; repeated rows give repeated results, whatever their ids; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, batched, column, small_batches

MARK = "▁"
NONE = np.int64(-(1 << 60))  # no path
UNKNOWN_PENALTY = 10
CHUNK = 1 << 15
FAN_IN = 64
UNIGRAM, MERGES = 1, 2  # the model format's numbers of the two kinds
KNOWN_UNITS, KNOWN_PAIRS = 800_000, 1_000_000  # remembered by a worker (some 300 bytes each); only time depends on them
PRIME = 0x9E3779B97F4A7C15 | 1  # base of the polynomial digest of ids, modulo 2**64

State = tuple[int, int]  # how far the piece at a border reaches back and ahead; (0, 0): the text's start or end


@dataclass
class Pieces:
    """Pieces with integer scores and ids; ``unknown`` is an unknown character's score; ``byte`` the id of byte 0; ``merged`` joins two pieces' text."""

    ids: dict[str, int]
    scores: dict[str, int]
    unknown: int
    byte: int
    names: list[str]
    longest: int
    units: re.Pattern | None
    merged: Callable[[str], list[int]] | None = None

    def __post_init__(self) -> None:
        self.by_id = np.array([self.scores.get(x, 0) for x in self.names], dtype=np.int64)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.shown = [chr(i - self.byte) if self.byte <= i < self.byte + 128 else x for i, x in enumerate(self.names)]
        self.partial = frozenset(range(self.byte + 128, self.byte + 256))  # bytes that are no character alone
        self.greedy = ahocorasick.Automaton()
        for x in self.scores:
            self.greedy.add_word(x, x)
        self.greedy.make_automaton()
        #: every beginning of a piece: the piece's score, or False where it is none itself
        self.walk: dict[str, int | bool] = {p[:k]: False for p in self.scores for k in range(1, len(p))} | self.scores

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        spec, kind = m.normalizer_spec, m.trainer_spec.model_type
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("models that rewrite texts other than by word marks are not supported")
        if kind not in (UNIGRAM, MERGES) or any(p.type in (4, 5) for p in m.pieces):
            raise ValueError("only unigram and pair-merge models without user-defined or unused pieces are supported")
        plain = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        whole = all(m.pieces[i].score == int(m.pieces[i].score) for i in plain.values())
        scores = {x: round(m.pieces[i].score * (1 if whole else 1 << 16)) for x, i in plain.items()}
        unknown = min(scores.values()) - UNKNOWN_PENALTY * (1 if whole else 1 << 16)
        byte = next(i for i, p in enumerate(m.pieces) if p.type == 6)
        names, merged = [p.piece for p in m.pieces], None
        if kind == MERGES:
            spec.add_dummy_prefix = False
            merged = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString()).encode
            known = list(scores)
            scores = {x: scores[x] for x, ids in zip(known, merged(known, num_threads=1), strict=True) if ids == [plain[x]]}  # others are never left by merging
        joined = {c for p in scores if len(p) > 1 for c in p}
        crossing = any(a != MARK and b == MARK for p in scores for a, b in zip(p, p[1:], strict=False))
        alone = "".join(c for c in "\n\t\r" if c not in joined)
        units = None if crossing else re.compile(f"[{alone}]|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        return cls({x: plain[x] for x in scores}, scores, unknown, byte, names, max(map(len, scores)), units, merged)

    # --- cutting ---

    def fits(self, a: str, b: str) -> bool:
        """Whether piece ``b`` is left behind piece ``a`` (empty: nothing before it) when their text is merged."""
        got = not a or tuple(self.merged(a + b)) == self.spell([a, b])
        if self.n_pairs >= KNOWN_PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        self.pairs.setdefault(a, {})[b] = got
        self.n_pairs += 1
        return got

    def forward(self, s: str, entry: dict[int, tuple[int, str]], stop: int) -> tuple[list[int], list[int]]:
        """Best score of every position and where its last piece begins (-1: entered there); pieces begin before ``stop``.

        Entries give the score and the last piece at a position.
        """
        n = len(s)
        best, start, last = [int(NONE)] * (n + 1), [-1] * (n + 1), [""] * (n + 1)
        for p, (v, piece) in entry.items():
            best[p], last[p] = v, piece
        step = self._sums if self.merged is None else self._merges
        step(s, best, start, last, min(n, stop))
        return best, start

    def _sums(self, s: str, best: list[int], start: list[int], last: list[str], stop: int) -> None:
        n, none, walk, unknown = len(s), int(NONE), self.walk.get, self.unknown
        for q in range(stop):
            b = best[q]
            if b <= none:
                continue
            p = q
            while p < n:
                p += 1
                v = walk(s[q:p])
                if p == q + 1 and (v is None or v is False):  # in no piece, or only at the beginning of longer ones
                    if b + unknown > best[p]:
                        best[p], start[p] = b + unknown, q
                elif v is not None and v is not False and b + v > best[p]:
                    best[p], start[p] = b + v, q
                if v is None:
                    break

    def _merges(self, s: str, best: list[int], start: list[int], last: list[str], stop: int) -> None:
        """A position that has its path needs no other: there is one at most."""
        n, none, walk, unknown, pairs, fits, new = len(s), int(NONE), self.walk.get, self.unknown, self.pairs.get, self.fits, {}
        for q in range(stop):
            b = best[q]
            if b <= none:
                continue
            before, p = last[q], q
            known = pairs(before, new).get
            while p < n:
                p += 1
                piece = s[q:p]
                v = walk(piece)
                if v is None:
                    if p > q + 1:
                        break
                    if best[p] <= none and fits(before, piece):
                        best[p], start[p], last[p] = b + unknown, q, piece
                    break
                if best[p] > none:
                    continue
                if v is False:
                    if p > q + 1:
                        continue
                    v = unknown
                ok = known(piece)
                if ok or (ok is None and fits(before, piece)):
                    best[p], start[p], last[p] = b + v, q, piece

    def opened(self, s: str) -> list[str]:
        """The one open path through a whole unit of a model of merges, its steps tried deepest and longest first (from the start on by an automaton).

        A path that is open so far is what merging yields for its part of the unit, so a position met twice is met by the same path: one that
        led nowhere is closed for good.
        """
        n, walk, pairs, fits, none = len(s), self.walk.get, self.pairs.get, self.fits, {}
        path: list[str] = []
        closed: set[int] = set()
        q, before = 0, ""
        for end, piece in self.greedy.iter_long(s):
            if end - len(piece) != q - 1:  # a character in no piece
                break
            if q:
                ok = pairs(before, none).get(piece)
                if not ok and (ok is not None or not fits(before, piece)):
                    break
            path.append(piece)
            q, before = end + 1, piece
        while q < n:
            p = q + 1
            ends = [p]  # a piece or an unknown character
            v = walk(s[q:p])
            while v is not None and p < n:
                p += 1
                v = walk(s[q:p])
                if v is not None and v is not False:
                    ends.append(p)
            known = pairs(before, none).get
            for p in reversed(ends):
                if p in closed:
                    continue
                piece = s[q:p]
                ok = not before or known(piece)
                if ok or (ok is None and fits(before, piece)):
                    path.append(piece)
                    q, before = p, piece
                    break
            else:
                if not path:
                    raise ValueError("no open path")
                closed.add(q)
                q -= len(path.pop())
                before = path[-1] if path else ""
        return path

    def trace(self, s: str, start: list[int], at: int) -> tuple[list[str], int]:
        """Pieces backwards from ``at`` to the position where the path was entered, in order, and that position."""
        out = []
        while start[at] >= 0:
            out.append(s[start[at] : at])
            at = start[at]
        return out[::-1], at

    def spell(self, cuts: list[str]) -> tuple[int, ...]:
        """Ids of the pieces."""
        try:
            return tuple(map(self.ids.__getitem__, cuts))
        except KeyError:
            return tuple(i for x in cuts for i in ([self.ids[x]] if x in self.ids else [self.byte + b for b in x.encode("utf-8", "surrogatepass")]))

    def counted(self, ids: list[int] | np.ndarray) -> tuple[int, int]:
        """How many ids are bytes, and the ids' score; an unknown character counts once, by its first byte."""
        at = np.asarray(ids, dtype=np.int64)
        raw = at[(at >= self.byte) & (at < self.byte + 256)] - self.byte
        return len(raw), int(self.by_id[at].sum()) + self.unknown * int(((raw & 0xC0) != 0x80).sum())

    def unit(self, s: str) -> tuple[int, ...]:
        """Ids of a unit."""
        if self.merged is None:
            return self.spell(self.trace(s, self.forward(s, {0: (0, "")}, len(s))[1], len(s))[0])
        return (self.ids[s],) if s in self.ids else self.spell(self.opened(s))

    def _units(self, s: str) -> list[int]:
        """Ids of a stretch between units' borders; short units are remembered."""
        units = self.units.findall(s) if self.units else [s]
        memo = self.memo
        new = set(units).difference(memo)
        if len(memo) + len(new) > KNOWN_UNITS:
            memo.clear()
            new = set(units)
        unit, long = self.unit, {}
        for u in new:
            (memo if len(u) <= 64 else long)[u] = unit(u)
        if long:
            return [i for u in units for i in (long[u] if u in long else memo[u])]
        return list(chain.from_iterable(map(memo.__getitem__, units)))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return self._units(MARK + text.replace(" ", MARK)) if text else []

    def decode(self, ids: list[int], first: bool = True) -> str:
        if self.partial.isdisjoint(ids):
            text = "".join(map(self.shown.__getitem__, ids)).replace(MARK, " ")
            return text[1:] if first and text.startswith(" ") else text
        out, held = [], bytearray()
        for i in ids:
            if self.byte <= i < self.byte + 256:
                held.append(i - self.byte)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            out.append(self.names[i])
        out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if first and text.startswith(" ") else text

    # --- chunks: s holds ``size`` characters and those that a piece may reach behind them; ``left`` what it may reach before them ---

    def states(self, left: str, right: str) -> list[State]:
        """States of a border between two texts, in a fixed order."""
        found = [(a, e) for a in range(1, min(len(left), self.longest) + 1) for e in range(min(len(right), self.longest - a) + 1) if left[len(left) - a :] + right[:e] in self.scores]
        return sorted({*found, (1, 0)}) if left else [(0, 0)]

    def exits(self, s: str, size: int, last: bool) -> list[State]:
        return [(0, 0)] if last else self.states(s[max(0, size - self.longest) : size], s[size : size + self.longest - 1])

    def borders(self, s: str, size: int) -> tuple[int, int] | None:
        """The first and the last position of the chunk that every path cuts at, if they lie behind all entries."""
        if not self.units:
            return None
        cuts = [m.start() for m in self.units.finditer(s) if m.start() > 0]
        cuts = [c for c in cuts if self.longest <= c <= size]
        return (cuts[0], cuts[-1]) if len(cuts) > 1 else None

    def _entry(self, left: str, s: str, state: State) -> str:
        """The piece of an entry state."""
        return left[len(left) - state[0] :] + s[: state[1]] if state[0] else ""

    def _reached(self, path: tuple[list[int], list[int]], base: int, size: int, state: State, last: bool) -> int:
        """Score of leaving in a state, or NONE; the path's texts begin at ``base``."""
        best, start = path
        at = size + state[1] - base
        return best[at] if last or start[at] == size - state[0] - base else int(NONE)

    def matrix(self, left: str, s: str, size: int, last: bool) -> np.ndarray:
        """Max-plus transfer matrix from entry to exit states."""
        rows, ends = self.states(left, s[: self.longest - 1]), self.exits(s, size, last)
        out = np.full((len(rows), len(ends)), NONE, dtype=np.int64)
        cut = self.borders(s, size)
        if cut:
            a, b = cut
            tail = self.forward(s[b:], {0: (0, "")}, size - b)
            tails = [self._reached(tail, b, size, x, last) for x in ends]
            middle = self.counted(self._units(s[a:b]))[1]
        for r, state in enumerate(rows):
            e = state[1]
            here = {0: (0, self._entry(left, s, state))}
            if cut:
                head = self.forward(s[e:a], here, a - e)[0][a - e]
                for c, t in enumerate(tails):
                    if head > NONE and t > NONE:
                        out[r, c] = head + middle + t
            else:
                path = self.forward(s[e:], here, max(0, size - e))
                for c, x in enumerate(ends):
                    out[r, c] = self._reached(path, e, size, x, last)
        return out

    def _path(self, left: str, s: str, size: int, entry: np.ndarray):
        rows = self.states(left, s[: self.longest - 1])
        scores: dict[int, tuple[int, str]] = {}
        index: dict[int, int] = {}
        for r, state in enumerate(rows):  # among equal sums the piece that reaches back further wins
            v, e = int(entry[r]), state[1]
            if v > NONE and (e not in scores or v >= scores[e][0]):
                scores[e], index[e] = (v, self._entry(left, s, state)), r
        cut = self.borders(s, size)
        if cut:
            head = self.forward(s[: cut[0]], scores, cut[0])
            tail = self.forward(s[cut[1] :], {0: (0, "")}, size - cut[1])
            return index, cut, head, tail
        return index, None, self.forward(s, scores, size), None

    def entries(self, left: str, s: str, size: int, last: bool, entry: np.ndarray) -> np.ndarray:
        """For every exit state the entry state of the best path (-1: no path)."""
        ends = self.exits(s, size, last)
        out = np.full(len(ends), -1, dtype=np.int64)
        index, cut, head, tail = self._path(left, s, size, entry)
        for c, state in enumerate(ends):
            if cut:
                if head[0][cut[0]] > NONE and self._reached(tail, cut[1], size, state, last) > NONE:
                    out[c] = index[self.trace(s, head[1], cut[0])[1]]
            elif self._reached(head, 0, size, state, last) > NONE:
                out[c] = index[self.trace(s, head[1], size + state[1])[1]]
        return out

    def between(self, left: str, s: str, size: int, last: bool, entry: np.ndarray, leave: int) -> tuple[list[int], int]:
        """Ids of the best path that leaves in state ``leave``, and how far that reaches ahead."""
        ahead = self.exits(s, size, last)[leave][1]
        _, cut, head, tail = self._path(left, s, size, entry)
        if not cut:
            return list(self.spell(self.trace(s, head[1], size + ahead)[0])), ahead
        rest = s[cut[1] :]
        first, end = self.trace(s, head[1], cut[0])[0], self.trace(rest, tail[1], size - cut[1] + ahead)[0]
        return [*self.spell(first), *self._units(s[cut[0] : cut[1]]), *self.spell(end)], ahead


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces.load(path)


def digest(ids: list[int] | np.ndarray) -> int:
    """Polynomial in PRIME, modulo 2**64, with coefficients id + 1; digests of parts add up, each times PRIME to its offset."""
    x = np.asarray(ids, dtype=np.int64).astype(np.uint64) + np.uint64(1)
    if not len(x):
        return 0
    return int((x * _powers(1 << max(10, len(x) - 1).bit_length())[: len(x)]).sum(dtype=np.uint64))


@lru_cache(maxsize=24)
def _powers(n: int) -> np.ndarray:
    powers = np.full(n, PRIME, dtype=np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def _signed(x: int) -> int:
    x %= 1 << 64
    return x - (1 << 64) if x >> 63 else x


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of matrices in the max-plus semiring."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NONE)


def _packed(a: np.ndarray) -> bytes:
    return np.array(a.shape, dtype=np.int64).tobytes() + a.tobytes()


def _square(b: bytes) -> np.ndarray:
    rows, columns = np.frombuffer(b[:16], dtype=np.int64)
    return np.frombuffer(b[16:], dtype=np.int64).reshape(rows, columns)


def _line(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=np.int64)


def compose(later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Exit state to entry state through two neighbouring stretches."""
    return np.where(later < 0, -1, earlier[np.maximum(later, 0)])


_TREE = "text_id long, idx long, value binary"


def scan(values: DataFrame, start: bytes, combine: Callable, apply: Callable, tables: Tables) -> DataFrame:
    """Exclusive scan of each text's values by ``idx``: (text_id, idx, before), ``start`` applied to all earlier values in turn.

    ``combine`` must be associative.  Values go up a tree whose nodes have FAN_IN children, states come down it.
    """

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        value = pdf["value"].iloc[0]
        for v in pdf["value"].iloc[1:]:
            value = combine(value, v)
        return pd.DataFrame({"text_id": pdf["text_id"].iloc[:1], "idx": pdf["idx"].iloc[:1] // FAN_IN, "value": [value]})

    def down(children: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
        children = children.sort_values("idx")
        state, out = parents["before"].iloc[0], []
        for v in children["value"]:
            out.append(state)
            state = apply(state, v)
        return pd.DataFrame({"text_id": children["text_id"], "idx": children["idx"], "before": out})

    levels = [values]
    most = values.agg(F.max("idx")).first()[0] or 0
    while most > 0:
        up = levels[-1].groupBy("text_id", (F.col("idx") / FAN_IN).cast("long").alias("above")).applyInPandas(
            lambda pdf: product(pdf), _TREE
        )
        levels.append(tables.write(up, "up"))
        most //= FAN_IN
    states = levels[-1].select("text_id", "idx", F.lit(bytearray(start)).alias("before"))
    for level in reversed(levels[:-1]):
        above = states.withColumnRenamed("idx", "above")
        states = level.withColumn("above", (F.col("idx") / FAN_IN).cast("long")).groupBy("text_id", "above").cogroup(
            above.groupBy("text_id", "above")
        ).applyInPandas(lambda a, b: down(a, b), "text_id long, idx long, before binary")
        states = tables.write(states, "down")
    return states


_CHUNKS = pa.schema([("text_id", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("idx", pa.int64()), ("n_chunks", pa.int64()), ("left", pa.string()), ("s", pa.string()), ("size", pa.int64())])


def _divided(path: str, chunk: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        longest = pieces(path).longest
        for batch in batches:
            for k, i, text in zip(column(batch, "text_id"), column(batch, "doc_id"), column(batch, "text"), strict=True):
                s = MARK + text.replace(" ", MARK)
                n = max(1, len(s) // chunk)
                for c in range(n):
                    a, b = c * chunk, (c + 1) * chunk if c + 1 < n else len(s)
                    yield (k, i, len(text), c, n, s[max(0, a - longest) : a], s[a : b + longest - 1], b - a)

    return lambda batches: batched(rows(batches), _CHUNKS, 64)


def _giants(giant: DataFrame, path: str, chunk: int, tables: Tables) -> DataFrame:
    """Results of the texts that are divided, one row each."""
    spec = "text_id long, doc_id long, n_chars long, idx long, n_chunks long, left string, s string, size long"
    cut = giant.withColumn("text_id", F.monotonically_increasing_id()).mapInArrow(_divided(path, chunk), spec)
    chunks = tables.write(cut.repartition("text_id", "idx"), "chunks")
    last = F.col("idx") + 1 == F.col("n_chunks")

    def each(fields: pa.Schema, names: list[str], f: Callable):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            known = pieces(path)
            for batch in batches:
                for row in zip(*(column(batch, c) for c in names), strict=True):
                    yield f(known, *row)

        return lambda batches: batched(rows(batches), fields, 64)

    tree = pa.schema([("text_id", pa.int64()), ("idx", pa.int64()), ("value", pa.binary())])
    names = ["text_id", "idx", "left", "s", "size", "last"]
    matrices = chunks.select("text_id", "idx", "left", "s", "size", last.alias("last")).mapInArrow(
        each(tree, names, lambda known, k, i, left, s, size, end: (k, i, _packed(known.matrix(left, s, size, end)))), _TREE
    )
    start = np.zeros((1, 1), dtype=np.int64)
    product = lambda a, b: _packed(max_plus(_square(a), _square(b)))
    scores = scan(tables.write(matrices, "matrices"), _packed(start), product, product, tables)
    entered = tables.write(chunks.join(scores.withColumnRenamed("before", "entry"), ["text_id", "idx"]), "entered")
    back = (F.col("n_chunks") - 1 - F.col("idx")).alias("idx")  # from the end
    maps = entered.select("text_id", back, "left", "s", "size", last.alias("last"), "entry").mapInArrow(
        each(tree, [*names, "entry"], lambda known, k, i, left, s, size, end, v: (k, i, known.entries(left, s, size, end, _square(v)[0]).tobytes())), _TREE
    )
    none = np.zeros(1, dtype=np.int64)  # the text's end is left in state 0
    leaves = scan(
        tables.write(maps, "maps"), none.tobytes(),
        lambda a, b: compose(_line(a), _line(b)).tobytes(), lambda v, b: compose(_line(v), _line(b)).tobytes(), tables,
    ).withColumnRenamed("before", "leave")
    pairs = entered.withColumn("back", F.col("n_chunks") - 1 - F.col("idx")).join(leaves.withColumnRenamed("idx", "back"), ["text_id", "back"])
    parts = pa.schema([("text_id", pa.int64()), ("doc_id", pa.int64()), ("idx", pa.int64()), ("n_chars", pa.int64()), ("n_chunks", pa.int64()), ("n", pa.int64()), ("b", pa.int64()), ("score", pa.int64()), ("h", pa.int64()), ("same", pa.bool_())])

    def spelled(known: Pieces, k, i, idx, chars, n, left, s, size, entry, leave) -> tuple:
        ids, ahead = known.between(left, s, size, idx + 1 == n, _square(entry)[0], int(_line(leave)[0]))
        n_bytes, score = known.counted(ids)
        text = known.decode(ids, first=False)
        came = size + ahead - len(text)  # a decoded stretch is as long as its part of the text
        same = came >= 0 and text == s[came : size + ahead].replace(MARK, " ")
        return (k, i, idx, chars, n, len(ids), n_bytes, score, _signed(digest(ids)), same)

    names = ["text_id", "doc_id", "idx", "n_chars", "n_chunks", "left", "s", "size", "entry", "leave"]
    done = pairs.select(*names).mapInArrow(
        each(parts, names, spelled), "text_id long, doc_id long, idx long, n_chars long, n_chunks long, n long, b long, score long, h long, same boolean"
    )

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        """A text's chunks: four numbers each."""
        pdf, at, h = pdf.sort_values("idx"), 0, 0
        for n, own in zip(pdf["n"], pdf["h"], strict=True):
            h += (int(own) % (1 << 64)) * pow(PRIME, at, 1 << 64)
            at += int(n)
        row = pdf.iloc[:1]
        return pd.DataFrame({
            "doc_id": row["doc_id"], "n_chars": row["n_chars"], "n_pieces": [at], "n_bytes": [pdf["b"].sum()], "score": [pdf["score"].sum()],
            "ids_hash": [_signed(h)], "round_trip": [bool(pdf["same"].all())], "n_chunks": row["n_chunks"],
        })

    return done.groupBy("text_id").applyInPandas(joined, RESULT)


RESULT = "doc_id long, n_chars long, n_pieces long, n_bytes long, score long, ids_hash long, round_trip boolean, n_chunks long"
_FIELDS = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_chars", "n_pieces", "n_bytes", "score", "ids_hash")), ("round_trip", pa.bool_()), ("n_chunks", pa.int64())])


def sentence_pieces(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_chars, n_pieces, n_bytes, score, ids_hash, round_trip, n_chunks of every row's whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    path = public_tokenizers.path("piece_bpe_32k.model") if path is None else path
    if chunk < 4 * pieces(path).longest:
        raise ValueError("chunks must be longer than four pieces")
    tables = Tables(spark, "sentence-pieces")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    small = F.length("text") + 1 < 2 * chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known = pieces(path)
        for batch in batches:
            for i, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                ids = known.encode(text)
                at = np.array(ids, dtype=np.int64)
                n_bytes, score = known.counted(at)
                yield (i, len(text), len(ids), n_bytes, score, _signed(digest(at)), known.decode(ids) == text, 1)

    plain = rows.where(small).mapInArrow(lambda batches: batched(whole(batches), _FIELDS), RESULT)
    return plain.unionByName(_giants(rows.where(~small), path, chunk, tables))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of every text, each held by one task; for texts of ordinary length."""
    small_batches(docs.sparkSession)
    path = public_tokenizers.path("piece_bpe_32k.model") if path is None else path
    fields = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                yield i, pieces(path).encode(text or "")

    return docs.select("doc_id", "text").mapInArrow(lambda b: batched(rows(b), fields), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give an empty text."""
    path = public_tokenizers.path("piece_bpe_32k.model") if path is None else path
    fields = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i, ids in zip(column(batch, "doc_id"), column(batch, "ids"), strict=True):
                yield i, pieces(path).decode(ids or [])

    return encoded.select("doc_id", "ids").mapInArrow(lambda b: batched(rows(b), fields), "doc_id long, text string")
