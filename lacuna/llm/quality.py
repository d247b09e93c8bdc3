"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Statistics are taken from whole texts and transformed (logarithms of counts, logits of shares).  Per class, mean and
covariance come from sums that tasks return for their share of the labelled rows; covariances are shrunk towards the
pooled covariance and its diagonal.  Scores are the posterior from the difference of Mahalanobis log-densities, using
Cholesky factors computed once and sent with the model.

Defined cases: a null text counts as empty; an empty text has all-zero statistics and is scored like any other; with labels of one
class only (or none) the score is that class's share (0.5 without labels); repeated label rows count as often as they occur; a null
label teaches nothing; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, batched, column, small_batches, utf8

FEATURES = (
    "log_bytes", "log_words", "log_word_len", "sd_word_len", "log_longest", "type_ratio", "top_word", "log_lines",
    "repeat_lines", "upper", "digit", "space", "stop", "comma", "other_punct", "symbol", "high", "odd_words",
    "capital_words", "stops_per_word", "repeat_bigrams", "pure_words", "short_words",
)
D = len(FEATURES)
#: Least variance of a statistic: well above what rounding leaves of a constant one.
LEAST_VARIANCE = 1e-6

_CLASS = np.zeros(256, dtype=np.int64)
for _i, _set in enumerate((
    range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), (0x20, 9, 10, 11, 12, 13), b".!?", b",;:", b"'\"()-",
    b"#$%&*+/<=>@[\\]^_`{|}~", range(0x80, 0x100),
)):
    _CLASS[list(_set)] = _i


def _logit(k: float, n: float) -> float:
    """Smoothed log-odds of k among n."""
    return math.log((k + 0.5) / (max(n - k, 0) + 0.5)) if n else 0.0


def statistics(b: bytes) -> list[float]:
    """Transformed statistics of one text (UTF-8)."""
    n = len(b)
    if not n:
        return [0.0] * D
    by_byte = np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256)
    low, upper, digit, space, stop, comma, punct, symbol, high = np.bincount(_CLASS, weights=by_byte, minlength=9)
    words = b.split()
    w = len(words)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=w)
    kinds = Counter(words)
    lines = [x for x in b.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    pure = odd = capital = 0
    for word, k in kinds.items():
        if word.isalpha():
            pure += k
        elif not word.rstrip(b".,;:!?").isalpha() and word.isascii():
            odd += k
        if word[:1].isupper():
            capital += k
    mean = float(lens.mean()) if w else 0.0
    return [
        math.log1p(n),
        math.log1p(w),
        math.log1p(mean),
        math.log1p(float(lens.std())) if w else 0.0,
        math.log1p(int(lens.max())) if w else 0.0,
        _logit(len(kinds), w) / (1 + math.log1p(w)),
        _logit(max(kinds.values(), default=0), w),
        math.log1p(len(lines)),
        _logit(len(lines) - len(set(lines)), len(lines)),
        _logit(upper, n),
        _logit(digit, n),
        _logit(space, n),
        _logit(stop, n),
        _logit(comma, n),
        _logit(punct, n),
        _logit(symbol, n),
        _logit(high, n),
        _logit(odd, w),
        _logit(capital, w),
        math.log1p(stop) - math.log1p(w),
        _logit(max(w - 1 - pairs, 0), max(w - 1, 0)),
        _logit(pure, w),
        _logit(int(np.count_nonzero(lens <= 3)), w),
    ]


def document_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``x``, the array of statistics."""
    spark_schema = docs.select(*keep).schema.add("x", T.ArrayType(T.DoubleType()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(b) for b in utf8(batch, "text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(k)) for k in keep], x], names=[*keep, "x"]
            )

    return docs.select(*keep, "text").mapInArrow(rows, spark_schema)


@dataclass
class Discriminant:
    """Class log-priors, means, inverse Cholesky factors and log-determinants; ``flat`` is the score where a class is missing."""

    prior: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray
    logdet: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    flat: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        z = (x - self.center) / self.scale
        density = []
        for c in (0, 1):
            y = (z - self.mean[c]) @ self.whiten[c].T
            density.append(self.prior[c] - 0.5 * (y * y).sum(axis=1) - 0.5 * self.logdet[c])
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(labelled: DataFrame, shrink_pooled: float = 0.25, shrink_diagonal: float = 0.02) -> Discriminant:
    """Learns from rows (x, label in 0/1); tasks return sums of x and of its outer products only."""
    schema = pa.schema([("label", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64())), ("p", pa.list_(pa.float64()))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = [0, 0], np.zeros((2, D)), np.zeros((2, D, D))
        for batch in batches:
            x = np.array(column(batch, "x"), dtype=float).reshape(-1, D)
            y = np.array(column(batch, "label"), dtype=int)
            for c in (0, 1):
                part = x[y == c]
                n[c] += len(part)
                s[c] += part.sum(axis=0)
                p[c] += part.T @ part
        yield from batched(((c, n[c], s[c].tolist(), p[c].ravel().tolist()) for c in (0, 1) if n[c]), schema)

    got = labelled.select("x", F.col("label").cast("int").alias("label")).where("label in (0, 1)").mapInArrow(
        sums, "label int, n long, s array<double>, p array<double>"
    ).groupBy("label").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(D)],
        *[F.sum(F.col("p")[i * D + j]).alias(f"p{i}_{j}") for i in range(D) for j in range(i, D)],
    ).collect()  # two rows
    n, s, p = np.zeros(2), np.zeros((2, D)), np.zeros((2, D, D))
    for r in got:
        c = r["label"]
        n[c] = r["n"]
        s[c] = [r[f"s{i}"] for i in range(D)]
        for i in range(D):
            for j in range(i, D):
                p[c, i, j] = p[c, j, i] = r[f"p{i}_{j}"]
    none = np.zeros((2, D))
    if n.min() < 1:
        flat = 0.5 if not n.sum() else float(n[1] / n.sum())
        return Discriminant(none[:, 0], none, np.zeros((2, D, D)), none[:, 0], none[0], none[0] + 1, flat)
    center = s.sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diagonal(p.sum(axis=0)) / n.sum() - center**2, LEAST_VARIANCE))
    mean = (s / n[:, None] - center) / scale
    cov = np.array([(p[c] / n[c] - np.outer(s[c], s[c]) / n[c] ** 2) / np.outer(scale, scale) for c in (0, 1)])
    pooled = (cov * n[:, None, None]).sum(axis=0) / n.sum()
    whiten, logdet = [], []
    for c in (0, 1):
        a = shrink_pooled * min(1.0, 20 * D / n[c]) if n[c] > D else 1.0
        shrunk = (1 - a) * cov[c] + a * pooled
        shrunk = (1 - shrink_diagonal) * shrunk + shrink_diagonal * np.diag(np.diagonal(pooled)) + 1e-6 * np.eye(D)
        root = np.linalg.cholesky(shrunk)
        whiten.append(np.linalg.inv(root))
        logdet.append(2 * np.log(np.diagonal(root)).sum())
    return Discriminant(np.log(n / n.sum()), mean, np.array(whiten), np.array(logdet), center, scale)


def score(stats: DataFrame, model: Discriminant, keep: list[str]) -> DataFrame:
    sent = stats.sparkSession.sparkContext.broadcast(model)  # two small matrices

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(column(batch, "x"), dtype=float).reshape(-1, D)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(k)) for k in keep], pa.array(sent.value.scores(x))],
                names=[*keep, "score"],
            )

    return stats.select(*keep, "x").mapInArrow(rows, stats.select(*keep).schema.add("score", T.DoubleType()))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from ``labels`` (doc_id, label) of the rows that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    stats = Tables(spark, "quality").write(
        document_statistics(docs.select("doc_id", held_out.alias("held_out"), "text"), ["doc_id", "held_out"]), "stats"
    )
    model = fit(stats.where(~F.coalesce("held_out", F.lit(False))).join(labels.select("doc_id", "label"), "doc_id"))
    return score(stats, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
