"""Secret scans: rule spans, and a linear-chain conditional random field that tags further secret tokens.

The base spans come from three fixed patterns.  The field tags tokens (runs without white space, quotes, brackets and marks such as ``=``
or ``:``) as outside, begin or inside; features are the token's shape (length, character classes, class changes, character
variety), the marks before it, hashed lower-case words of the token and of its neighbours, and features of the whole text.

The patterns' own spans cannot teach more than the patterns find, so the field learns from three kinds of windows: places of the corpus around
base values, half of them with the announcing word and marks hidden, so that shape counts by itself; plain places of the corpus; and
the same plain places with a made statement put in, which holds a secret of some other shape or a look-alike (``secret_examples``).  Weights
maximise the L2-regularised conditional likelihood over a bounded sample of documents (``sample_rows``, ``windows_per_row``).  ``MARGIN`` is added to
outside before decoding, for the sake of clean text.  Texts are decoded whole by Viterbi: a token whose best begin or inside score cannot outweigh
outside, whatever its neighbours are and even if the token after it must begin anew, is outside in every best path, so the text falls
apart there into segments which are decoded exactly; equal paths go to the lower tag.  Field spans that overlap a base span are left out.

Defined cases: null text counts as empty and has no span; a text of any length is read whole; a null or repeated doc_id gives a row like any
other, and repeated rows repeated results; without any text the field adds nothing; an empty table gives an empty result; other columns are
ignored (or kept by :func:`redact`).
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import secret_examples
from .common import batched, column, small_batches

KINDS = ("assign", "access", "hex", "field")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
#: A maximal run that is long enough is what the contract's run patterns keep after short runs are dropped.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("passw", "secret", "token", "api")

OUT, BEGIN, INSIDE = 0, 1, 2
HASHED = 1 << 12
LONGEST = 60_000  # characters of a token that are counted together; longer tokens are read in parts
NEVER = -1e9
#: Added to every token's score for outside.
MARGIN = 2.0
#: Windows whose likelihood is worked out at once in learning, which bounds the driver's memory.
AT_ONCE = 1024
#: Characters before a token in which its marks are sought.
REACH = 4

# Per character (all from 256 on share one entry): separator, class, counters packed four to a word of 16 bits each.
_SEP = np.zeros(257, dtype=bool)
_SEP[:33] = _SEP[127] = True
_SEP[[ord(c) for c in "\"'`=:,;()[]{}<>|"]] = True
_MARK = np.zeros((3, 257), dtype=np.int32)  # assignment, quote, end of line
_MARK[0, [ord(c) for c in "=:>"]] = _MARK[1, [ord(c) for c in "\"'`"]] = _MARK[2, [10, 13]] = 1
_CODE = np.zeros(257, dtype=np.uint8)
_LOW = np.arange(257, dtype=np.uint32)
_LOW[0x41:0x5B] += 32
_PACK = np.zeros((2, 257), dtype=np.uint64)
for _i in range(257):
    _c = chr(_i)
    if not _SEP[_i]:
        _kinds = (
            _c.isdigit(), _c.isupper(), _c.isalpha() and not _c.isupper(), _c in "0123456789abcdef",
            _c == ".", _c in "@#$%&*!?~^", _c in "+/_-", _i > 127,
        )
        _CODE[_i] = 1 if _kinds[0] else 2 if _kinds[1] else 3 if _kinds[2] else 4
        for _k, _hit in enumerate(_kinds):
            _PACK[_k // 4, _i] |= np.uint64(int(_hit) << (16 * (_k % 4)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    found = []
    folded = text.lower()
    if any(w in folded for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def digest_form(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and character indices (code points, all from 256 on as 256) of the tokens between separators."""
    at = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), 256)
    inside = np.concatenate(([False], ~_SEP[at], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if len(starts) and (ends - starts).max() > LONGEST:
        cuts = [np.arange(s, e, LONGEST) for s, e in zip(starts, ends, strict=True)]
        ends = np.concatenate([np.append(c[1:], e) for c, e in zip(cuts, ends, strict=True)])
        starts = np.concatenate(cuts)
    return starts, ends, at


SHAPES = 52
#: The first of the features that tell of marks before the token.
MARKED = 46


def token_features(starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shape features (tokens x SHAPES) and hashes of the lower-cased words."""
    n = (ends - starts).astype(np.float32)
    counts = []
    for table in _PACK:
        packed = np.add.reduceat(table[at], starts)
        counts += [((packed >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.float32) for k in range(4)]
    digit, upper, lower, hexes, dots, signs, joins, high = counts
    code = _CODE[at]
    turn = np.zeros(len(at), dtype=np.uint32)
    turn[1:] = (code[1:] != code[:-1]) & (code[1:] > 0) & (code[:-1] > 0)
    turn[starts] = 0
    turns = np.add.reduceat(turn, starts).astype(np.float32)
    low = _LOW[at]
    pair = low * np.uint32(2654435761)
    pair[1:] ^= low[:-1] * np.uint32(40503)
    pair = (pair ^ (pair >> np.uint32(15))) * np.uint32(2246822519)
    pair[_SEP[at]] = 0
    word = np.add.reduceat(pair ^ (pair >> np.uint32(13)), starts, dtype=np.uint32)
    word = ((word * np.uint32(3266489917)) >> np.uint32(20)).astype(np.int64)
    x = np.zeros((len(starts), SHAPES), dtype=np.float32)
    x[:, 0] = 1
    x[:, 1] = np.minimum(n, 64) / 16
    for i, c in enumerate((digit, upper, lower, hexes, joins, high)):
        x[:, 2 + i] = c / n
    x[:, 8] = np.where(n >= 16, hexes / n, 0)
    x[:, 9] = (digit > 0) & (upper + lower > 0)
    x[:, 10] = (digit > 0) & (upper > 0) & (lower > 0)
    x[:, 11] = dots > 0
    x[:, 12] = signs > 0
    x[:, 13] = joins > 0
    x[:, 14] = np.minimum(turns, 32) / 8
    x[:, 15] = (n >= 16) & (digit > 1) & (upper + lower > 1) & (high == 0)
    x[:, 16] = (n >= 16) & (turns >= 6)
    rows = np.arange(len(starts))
    x[rows, 17 + np.minimum(np.log2(n).astype(np.int64), 7)] = 1
    x[rows, 25 + np.minimum((8 * digit / n).astype(np.int64), 7)] = 1
    x[rows, 33 + np.minimum(turns / 2, 7).astype(np.int64)] = 1
    x[rows, 41 + code[starts]] = 1  # class of the first character
    for k, table in enumerate(_MARK):
        upto = np.concatenate(([0], np.cumsum(table[at], dtype=np.int32)))
        x[:, MARKED + k] = upto[starts] > upto[np.maximum(starts - REACH, 0)]
    x[:, 49] = (upper > 0) & (lower > 0) & (digit > 0) & (signs > 0)
    x[:, 50] = (n >= 20) & (turns * 4 >= n)
    x[:, 51] = (n >= 20) & (lower == 0) & (digit > 1) & (upper > 1)
    return x, word


def text_features(text: str) -> tuple[int, int]:
    """Two features of the whole text: has a key-like word; has assignment marks."""
    low = text.lower()
    return int(any(w in low for w in WORDS)), int("=" in text)


@dataclass
class Field:
    """Weights: dense (SHAPES x 3), own, previous and next word (HASHED x 3), text (2 x 3), transitions (3 x 3)."""

    dense: np.ndarray
    own: np.ndarray
    prev: np.ndarray
    next: np.ndarray
    text: np.ndarray
    trans: np.ndarray

    @property
    def slack(self) -> float:
        """The most that three transitions can differ by; so many change when a token turns outside and an inside after it begins anew."""
        legal = self.trans[self.trans > NEVER / 2]
        return 3 * float(legal.max() - legal.min())

    def emissions(self, x: np.ndarray, word: np.ndarray, flags: tuple[int, int]) -> np.ndarray:
        e = x @ self.dense + self.own[word] + np.array(flags, dtype=np.float32) @ self.text
        e[:, OUT] += MARGIN
        e[1:] += self.prev[word[:-1]]
        e[:-1] += self.next[word[1:]]
        return e

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tags; exact, by Viterbi over the segments between tokens that must be outside."""
        tags = np.zeros(len(e), dtype=np.int8)
        after = np.append(np.maximum(e[1:, INSIDE] - e[1:, BEGIN], 0), 0)
        open_ = np.flatnonzero(np.maximum(e[:, BEGIN], e[:, INSIDE]) + after + self.slack >= e[:, OUT])
        if not len(open_):
            return tags
        for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            tags[part] = self._viterbi(e[part[0] : part[-1] + 1], last=part[-1] + 1 == len(e))
        return tags

    def _viterbi(self, e: np.ndarray, last: bool) -> np.ndarray:
        score = e[0] + self.trans[OUT]  # before a segment stands an outside token or the text's start
        back = np.zeros((len(e), 3), dtype=np.int8)
        for t in range(1, len(e)):
            through = score[:, None] + self.trans
            back[t] = through.argmax(axis=0)
            score = through.max(axis=0) + e[t]
        if not last:
            score = score + self.trans[:, OUT]
        out = np.zeros(len(e), dtype=np.int8)
        out[-1] = score.argmax()
        for t in range(len(e) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        starts, ends, at = tokens(text)
        if not len(starts):
            return []
        tags = self.decode(self.emissions(*token_features(starts, ends, at), text_features(text)))
        found: list[list[int]] = []
        for t in np.flatnonzero(tags):
            if tags[t] == BEGIN:
                found.append([int(starts[t]), int(ends[t])])
            elif found:
                found[-1][1] = int(ends[t])
        return [(s, 3, s + len(text[s:e].rstrip("."))) for s, e in found if text[s:e].strip(".")]


def tags_from(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tags of the tokens from the spans they overlap; overlapping spans count as one."""
    tags = np.zeros(len(starts), dtype=np.int64)
    upto = -1
    for s, _, e in sorted(spans):
        a, b = np.searchsorted(ends, s, "right"), np.searchsorted(starts, e, "left")
        tags[a:b] = np.where(tags[a:b] == BEGIN, BEGIN, INSIDE)
        if s >= upto and a < b:
            tags[a] = BEGIN
        upto = max(upto, e)
    return tags


def _values(text: str) -> list[tuple[int, int, int]]:
    """The base spans without what announces an assigned value."""
    low = text.lower()
    assigned = [(m.start(2), 0, m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if any(w in low for w in WORDS) else []
    return assigned + [x for x in base_spans(text) if x[1]]


def _window(text: str, spans: list[tuple[int, int, int]], flags: tuple[int, int], at: int, radius: int) -> tuple:
    """(features, words, tags, text features) of the tokens around a place of the text."""
    starts, ends, codes = tokens(text)
    x, word = token_features(starts, ends, codes)
    i = int(np.searchsorted(starts, at))
    a, b = max(0, i - radius), min(len(starts), i + radius)
    return x[a:b], word[a:b], tags_from(starts, ends, spans)[a:b], flags


def _hidden(window: tuple) -> tuple:
    """The window without what announces its secrets: marks go, and the words before them become those of other places."""
    x, word, tags, _ = window
    x, word, begins = x.copy(), word.copy(), np.flatnonzero(tags == BEGIN)
    x[begins, MARKED : MARKED + 3] = 0
    other = word[::-1].copy()
    for i in begins[begins > 0]:
        word[i - 1] = other[i]
    return x, word, tags, (0, 0)


def windows(text: str, seed: str, limit: int = 8, radius: int = 12, reach: int = 240) -> list[tuple]:
    """``limit`` training windows of a text at most: half of them around base values (in turn as they are and hidden), the rest plain and with made statements.

    Places, statements and which values are taken follow from ``seed``.
    """
    r = random.Random(seed)
    found, flags, out = _values(text), text_features(text), []
    marks = sorted(found) if len(found) <= limit // 2 else r.sample(sorted(found), limit // 2)
    for k, (s, _, e) in enumerate(marks):
        a, b = max(0, s - reach), e + reach
        near = _window(text[a:b], [(x - a, k, y - a) for x, k, y in found if a <= x and y <= b], flags, s - a, radius)
        out.append(_hidden(near) if k % 2 or r.random() < 0.5 else near)
    while len(out) < limit and text:
        at = r.randrange(len(text))
        a = max(0, at - reach)
        at = text.rfind(" ", a, at) + 1 or a
        left, right = text[a:at], text[at : at + reach]
        spans = [(x - a, k, y - a) for x, k, y in found if a <= x and y <= at + reach]
        out.append(_window(left + right, spans, flags, at - a, radius))
        made, secrets = secret_examples.statement(r, re.findall(r"[^\W\d_]{2,14}", left + right)[:60])
        right = " " + right
        spans = [(x, k, y) if y <= len(left) else (x + len(made) + 1, k, y + len(made) + 1) for x, k, y in spans if y <= len(left) or x >= len(left)]
        spans += [(len(left) + x, 3, len(left) + y) for x, y in secrets]
        whole = left + made + right
        out.append(_window(whole, spans, text_features(whole) if r.random() < 0.5 else flags, len(left) + len(made) // 2, radius))
    return [w for w in out[:limit] if len(w[2])]


@dataclass
class _Examples:
    """Windows padded to one length."""

    dense: np.ndarray
    word: np.ndarray  # with one more place at either end; HASHED where there is no token
    gold: np.ndarray
    mask: np.ndarray
    flags: np.ndarray

    @classmethod
    def of(cls, examples: list[tuple]) -> _Examples:
        n, longest = len(examples), max((len(tags) for _, _, tags, _ in examples), default=1)
        dense, word = np.zeros((n, longest, SHAPES), dtype=np.float32), np.full((n, longest + 2), HASHED)
        gold, mask = np.zeros((n, longest), dtype=np.int64), np.zeros((n, longest), dtype=bool)
        for i, (x, h, tags, _) in enumerate(examples):
            dense[i, : len(tags)], word[i, 1 : len(tags) + 1], gold[i, : len(tags)], mask[i, : len(tags)] = x, h, tags, True
        return cls(dense, word, gold, mask, np.array([f for *_, f in examples], dtype=np.float32).reshape(n, 2))

    def parts(self, size: int) -> Iterator[_Examples]:
        for a in range(0, len(self.gold), size):
            yield _Examples(*(x[a : a + size] for x in (self.dense, self.word, self.gold, self.mask, self.flags)))

    @property
    def places(self) -> dict[str, np.ndarray]:
        return {"own": self.word[:, 1:-1], "prev": self.word[:, :-2], "next": self.word[:, 2:]}


ILLEGAL = np.zeros((3, 3))
ILLEGAL[OUT, INSIDE] = NEVER
WEIGHTS = {"dense": (SHAPES, 3), "own": (HASHED, 3), "prev": (HASHED, 3), "next": (HASHED, 3), "text": (2, 3), "trans": (3, 3)}


def likelihood(w: dict[str, np.ndarray], of: _Examples) -> tuple[float, dict[str, np.ndarray]]:
    """Conditional log-likelihood of the windows' tags and its gradient by every weight."""
    trans = w["trans"] + ILLEGAL
    e = (of.dense @ w["dense"].astype(of.dense.dtype)).astype(float) + (of.flags @ w["text"])[:, None, :]
    for k, at in of.places.items():
        e += np.vstack([w[k], np.zeros(3)])[at]
    marginal, pair, z = _marginals(e, trans, of.mask)
    one_hot = np.eye(3)[of.gold] * of.mask[..., None]
    both = of.mask[:, 1:] & of.mask[:, :-1]
    pair_gold = np.zeros((3, 3))
    np.add.at(pair_gold, (of.gold[:, :-1][both], of.gold[:, 1:][both]), 1.0)
    first = np.bincount(of.gold[:, 0], minlength=3)
    pair_gold[OUT] += first
    pair[OUT] += marginal[:, 0].sum(axis=0)
    value = float((one_hot * e).sum() + (pair_gold * trans).sum() - z.sum())
    g = one_hot - marginal
    grads = {k: np.stack([np.bincount(at.ravel(), g[..., c].ravel(), HASHED + 1)[:HASHED] for c in range(3)], 1) for k, at in of.places.items()}
    grads |= {"dense": of.dense.reshape(-1, SHAPES).T @ g.reshape(-1, 3).astype(of.dense.dtype), "text": of.flags.T @ g.sum(axis=1), "trans": np.where(ILLEGAL < 0, 0, pair_gold - pair)}
    return value, grads


def train(examples: list[tuple], rounds: int = 100, l2: float = 1e-4, rate: float = 0.1) -> Field:
    """Maximises the regularised likelihood by Adam over all windows."""
    return trained(_Examples.of(examples), rounds, l2, rate)


def trained(of: _Examples, rounds: int = 100, l2: float = 1e-4, rate: float = 0.1) -> Field:
    """:func:`train` over padded windows, a part of them at a time."""
    w = {k: np.zeros(v) for k, v in WEIGHTS.items()}
    dense = ("dense", "own", "prev", "next", "text")
    if not of.gold.any():
        w["dense"][0, OUT] = 10.0
        return Field(*(w[k] for k in dense), ILLEGAL)
    scale = max(1, int((of.gold == BEGIN).sum()))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    for step in range(1, rounds + 1):
        grads = {k: np.zeros(v) for k, v in WEIGHTS.items()}
        for part in of.parts(AT_ONCE):
            for k, g in likelihood(w, part)[1].items():
                grads[k] += g
        for k, v in w.items():
            d = grads[k] / scale - l2 * v
            m, s = moments[k]
            m[:] = 0.9 * m + 0.1 * d
            s[:] = 0.999 * s + 0.001 * d * d
            v += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Field(*(w[k].astype(np.float32) for k in dense), w["trans"] + ILLEGAL)


def _marginals(e: np.ndarray, trans: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tag marginals, summed transition expectations and log partitions by forward-backward over padded windows."""

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    n, t_max, _ = e.shape
    f = np.zeros_like(e)
    b = np.zeros_like(e)
    f[:, 0] = e[:, 0] + trans[OUT]
    for t in range(1, t_max):
        f[:, t] = np.where(mask[:, t, None], lse(f[:, t - 1, :, None] + trans, 1) + e[:, t], f[:, t - 1])
    for t in range(t_max - 2, -1, -1):
        b[:, t] = np.where(mask[:, t + 1, None], lse(trans + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
    z = lse(f[:, -1], 1)
    marg = np.exp(np.clip(f + b - z[:, None, None], -700, 0)) * mask[..., None]
    pair = np.zeros((3, 3))
    for t in range(1, t_max):
        p = f[:, t - 1, :, None] + trans + (e[:, t] + b[:, t])[:, None, :] - z[:, None, None]
        pair += (np.exp(np.clip(p, -700, 0)) * mask[:, t, None, None]).sum(axis=0)
    return marg, pair, z


def fit(docs: DataFrame, sample_rows: int = 1500, windows_per_row: int = 8) -> Field:
    """Learns from about ``sample_rows`` documents, half of them with a key-like word or a long run if there are so many."""
    rows = docs.where(F.col("text").isNotNull())
    likely = F.lower("text").rlike("passw|secret|token|api_?key|[0-9a-f]{24}") | F.col("text").contains("AKIA")
    marked = rows.select("doc_id", likely.alias("likely"), "text")
    n = {r["likely"]: r["n"] for r in marked.groupBy("likely").agg(F.count(F.lit(1)).alias("n")).collect()}
    scale = 1 << 30
    bars = {k: min(scale, sample_rows // 2 * scale // max(1, n.get(k, 0))) for k in (True, False)}
    bar = F.when(F.col("likely"), bars[True]).otherwise(bars[False])
    sample = marked.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("field")), F.lit(scale)) < bar).select("doc_id", "text")
    schema = pa.schema([("key", pa.string()), ("x", pa.binary()), ("word", pa.binary()), ("tags", pa.binary()), ("f0", pa.int32()), ("f1", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                for k, (x, word, tags, flags) in enumerate(windows(text, f"{i}:{zlib.crc32(text.encode())}", windows_per_row)):
                    yield (f"{i}:{k:02d}", x.tobytes(), word.tobytes(), tags.tobytes(), *flags)

    got = sample.mapInArrow(
        lambda batches: batched(cut(batches), schema), "key string, x binary, word binary, tags binary, f0 int, f1 int"
    ).collect()  # windows_per_row windows of 24 tokens for each sampled row at most
    of = _Examples.of([
        (np.frombuffer(r["x"], np.float32).reshape(-1, SHAPES), np.frombuffer(r["word"], np.int64), np.frombuffer(r["tags"], np.int64), (r["f0"], r["f1"]))
        for r in sorted(got, key=lambda r: (r["key"], r["tags"]))
    ])
    del got  # the padded copy is enough
    return trained(of)


def _scan(texts: list[str | None], known: Field) -> Iterator[tuple[list, list]]:
    for text in texts:
        text = text or ""
        base = base_spans(text)
        covered = sorted((s, e) for s, _, e in base)
        own = [x for x in known.spans(text) if not any(s < x[2] and x[0] < e for s, e in covered)]
        yield base, own


def secret_scan(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_field, base_sha256, spans for every row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs) if model is None else model)
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_field", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i, (base, own) in zip(column(batch, "doc_id"), _scan(column(batch, "text"), sent.value), strict=True):
                kinds = [k for _, k, _ in base]
                digest = hashlib.sha256(digest_form(base).encode()).hexdigest()
                yield (i, *(kinds.count(k) for k in range(3)), digest, digest_form(base + own), len(own))

    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: batched(rows(batches), schema),
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_field long",
    )


def redact(docs: DataFrame, model: Field | None = None, mark: str = "[secret]") -> DataFrame:
    """All columns of ``docs``; every found span in ``text`` is replaced by ``mark``, a null text stays null."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs) if model is None else model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            out = []
            for text, (base, own) in zip(texts, _scan(texts, sent.value), strict=True):
                pieces, end = [], 0
                for s, e in sorted((s, e) for s, _, e in base + own):
                    if e > end:
                        if s >= end:
                            pieces += [text[end:s], mark]
                        end = e
                out.append(None if text is None else "".join([*pieces, text[end:]]))
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.string()))

    return docs.mapInArrow(rows, docs.schema)
