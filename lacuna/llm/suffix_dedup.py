"""Removal of byte passages that occur in an earlier document, by a depth-limited radix sort of suffixes.

Suffixes are ordered through ``window`` bytes only; those that are then equal are exactly the repeated windows.  The sort goes by most
significant digits and drops a suffix as soon as its group lies in one document:

* The leading digit is taken where all copies of a window agree to take it: at the window's minimizer, the ``K``-byte string with the least hash
  in it.  Consecutive windows share minimizers, so one row stands for some fifteen suffixes.  Rows are dealt by the digit's hash; a group within one
  document is finished.
* Rows of the remaining groups come back with the bytes of their windows.  Equal rows are merged to the smallest document first; the windows of rows that
  differ are split by (digit, place in the window), then eight bytes at a time through the whole window, and every equal group yields its smallest document.

A window of a document with a larger id than its group's smallest is repeated; the bytes under repeated windows go.  What hashes decide
is only which rows meet, never that windows are equal.  Rows travel as one binary value for each pair of task and target.

Both passes combine before they shuffle, so a digit or passage that a large share of documents has costs its part a few rows for each task and not a
row for each document: a task that sees a digit in two documents sends two of its rows as witnesses and the others straight back to their
documents; a task that sees equal rows sends the smallest document's and knows that the others are repeated.

Defined cases: null text counts as empty; texts under ``window`` bytes stay whole; matches never cross documents; rows repeating a
doc_id are one document for the comparison (never each other's source) and are cut each by itself; rows with a null doc_id stay whole and are no source;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, column, small_batches, utf8

K = 20
SEGMENT = 1 << 19
PLACE = np.uint64((1 << 20) - 1)
FLUSH = 300_000
TARGET_BYTES = 16 << 20  # input bytes for one target part


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xC2B2AE3D27D4EB4F)


def _words(b: bytes, at: int, n: int) -> np.ndarray:
    """The n overlapping 8-byte words of ``b`` from place ``at`` on."""
    return np.ndarray(shape=(n,), dtype="<u8", buffer=b, offset=at, strides=(1,))


def leading(b: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share a minimizer: its hash, its place, the run's first window and the number of windows."""
    parts = []
    for at in range(0, max(0, len(b) - window + 1), SEGMENT):
        part = b[at : at + SEGMENT + window - 1]
        n, w = len(part) - K + 1, window - K + 1
        g = _mix(_words(part, 0, n) ^ _mix(_words(part, 8, n) ^ _mix(_words(part, K - 8, n))))
        g ^= g >> np.uint64(29)
        least = (g & ~PLACE) | np.arange(n, dtype=np.uint64)
        step = 1
        while step * 2 <= w:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if w > step:
            least = np.minimum(least[: step - w], least[w - step :])
        place = (least & PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        p = place[first]
        parts.append((g[p], p + at, first + at, np.diff(np.append(first, len(place)))))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# --- binary values: the arrays' lengths, then their bytes, compressed ---


def _pack(*arrays: np.ndarray) -> bytes:
    plain = b"".join([np.array([len(a) for a in arrays], dtype="<u4").tobytes(), *(a.tobytes() for a in arrays)])
    return zstandard.ZstdCompressor(level=1).compress(plain)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    blob = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(blob, dtype="<u4", count=len(kinds)), 4 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(blob, dtype=kind, count=int(n), offset=at))
        at += out[-1].nbytes
    return out


def _gather(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    parts = [_unpack(x, *kinds) for x in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=k) for i, k in enumerate(kinds)]


def _ends(edges: np.ndarray, n: int) -> np.ndarray:
    """Where the groups end that begin at ``edges``."""
    return np.append(edges[1:], n) if len(edges) else edges


def _dealt(target: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(target, binary value) for every target that has rows; rows of one target keep their order."""
    order = np.argsort(target, kind="stable")
    target = target[order]
    edges = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1]))) if len(target) else np.zeros(0, dtype=int)
    for a, b in zip(edges, _ends(edges, len(target)), strict=True):
        at = order[a:b]
        yield int(target[a]), _pack(*(x[at] for x in arrays))


_BLOBS = pa.schema([("part", pa.int32()), ("decided", pa.bool_()), ("blob", pa.binary())])


def _table(rows: list[tuple[int, bytes]], decided: list[tuple[int, bytes]] = ()) -> pa.Table:
    """Rows for the pass that follows, and decided ones, which only pass through it to their documents' part."""
    both = [*((p, False, b) for p, b in rows), *((p, True, b) for p, b in decided)]
    return pa.table([pa.array([r[k] for r in both], f.type) for k, f in enumerate(_BLOBS)], schema=_BLOBS)


def _blobs(table: pa.Table, decided: bool) -> list[bytes]:
    return [b for b, d in zip(table.column("blob").to_pylist(), table.column("decided").to_pylist(), strict=True) if d is decided]


INSTANCE = ("<u8", "<i8", "<u4", "<u4")  # digit, document, text's crc, place
PLACES = ("<i8", "<u4", "<u4")  # document, crc, place
RUNS = ("<i8", "<u4", "<u4", "<u4")  # document, crc, first window, windows


def _digits(parts: int, window: int):
    """Task side of the leading digit: one binary value for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            g, doc, crc, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, g))
            sorted_g, sorted_doc = g[order], doc[order]
            edges = _groups(sorted_g)
            ends = _ends(edges, len(g)) - 1
            known = np.repeat(sorted_doc[edges] != sorted_doc[ends], ends - edges + 1)
            known[edges] = known[ends] = False  # the witnesses
            back = np.zeros(len(g), dtype=bool)
            back[order] = known  # rows keep their texts' order, in which they compress well
            rows = _dealt((g[~back] >> np.uint64(40)) % np.uint64(parts), g[~back], doc[~back], crc[~back], place[~back])
            out = _table(list(rows), list(_dealt(doc[back] % parts, doc[back], crc[back], place[back])))
            held.clear()
            yield from out.to_batches()

        for batch in batches:
            for i, b in zip(column(batch, "doc_id"), utf8(batch, "text"), strict=True):
                if i is None or len(b) < window:
                    continue
                g, place, _, _ = leading(b, window)
                n = len(g)
                held.append((g.astype("<u8"), np.full(n, i, "<i8"), np.full(n, zlib.crc32(b), "<u4"), place.astype("<u4")))
                size += n
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.zeros(0, dtype=int)


def _repeated(docs_parts: int):
    """Digit groups that span documents: their rows' places, dealt by document."""

    def run(table: pa.Table) -> pa.Table:
        g, doc, crc, place = _gather(_blobs(table, False), *INSTANCE)
        order = np.argsort(g, kind="stable")
        g, doc = g[order], doc[order]
        edges = _groups(g)
        keep = np.zeros(0, dtype=bool)
        if len(edges):
            several = np.minimum.reduceat(doc, edges) != np.maximum.reduceat(doc, edges)
            keep = np.repeat(several, _ends(edges, len(g)) - edges)
        known = _gather(_blobs(table, True), *PLACES)
        at = order[keep]
        doc, crc, place = (np.concatenate(x) for x in zip((doc[keep], crc[at], place[at]), known, strict=True))
        return _table(list(_dealt(doc % docs_parts, doc, crc, place)))

    return run


def _by_text(doc: np.ndarray, crc: np.ndarray, *rest: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, ...]]:
    order = np.lexsort((crc, doc))
    doc, crc = doc[order], crc[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1]))) if len(doc) else np.zeros(0, dtype=bool)
    edges = np.flatnonzero(new)
    return {
        (int(doc[a]), int(crc[a])): tuple(x[order[a:b]] for x in rest)
        for a, b in zip(edges, _ends(edges, len(doc)), strict=True)
    }


def _contexts(parts: int, window: int):
    """The windows' bytes for rows of repeated digits; rows with equal bytes are merged as far as this task sees."""

    def run(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        wanted = _by_text(*_gather(blobs.column("blob").to_pylist(), *PLACES))
        rows: list[tuple[int, bytes]] = []
        known: list[tuple[int, bytes]] = []
        by_part: dict[int, tuple[dict, list]] = {}
        size = 0

        def flush() -> None:
            sure = []
            for part, (kinds, found) in by_part.items():
                keys = list(kinds)
                inst = np.array(found, dtype=np.int64).reshape(-1, 4)
                least = np.full(len(keys), np.iinfo(np.int64).max)
                np.minimum.at(least, inst[:, 0], inst[:, 1])
                later = inst[:, 1] > least[inst[:, 0]]
                count = np.array([len(k[2]) - window + 1 for k in keys], dtype=np.int64)
                sure.append(np.column_stack([inst[later, 1:], count[inst[later, 0]]]))
                inst = inst[~later]
                rows.append((part, _pack(
                    np.array([k[0] for k in keys], "<u8"), np.array([k[1] for k in keys], np.uint8),
                    np.array([len(k[2]) - window + 1 for k in keys], np.uint8), np.frombuffer(b"".join(k[2] for k in keys), np.uint8),
                    inst[:, 0].astype("<u4"), inst[:, 1].astype("<i8"), inst[:, 2].astype("<u4"), inst[:, 3].astype("<u4"),
                )))
            if sure and len(run := np.concatenate(sure)):
                known.extend(_dealt(run[:, 0] % parts, run[:, 0].astype("<i8"), *(run[:, k].astype("<u4") for k in (1, 2, 3))))
            by_part.clear()

        for i, b in zip(texts.column("doc_id").to_pylist(), texts.column("text").cast(pa.binary()).to_pylist(), strict=True):
            if i is None or b is None or (found := wanted.get((i, crc := zlib.crc32(b)))) is None:
                continue
            g, place, first, count = leading(b, window)
            at = np.flatnonzero(np.isin(place, found[0]))
            targets = ((g[at] >> np.uint64(40)) % np.uint64(parts)).tolist()
            for part, digit, p, f, n in zip(targets, g[at].tolist(), place[at].tolist(), first[at].tolist(), count[at].tolist(), strict=True):
                kinds, inst = by_part.setdefault(part, ({}, []))
                k = kinds.setdefault((digit, p - f, b[f : f + n - 1 + window]), len(kinds))
                inst.append((k, i, crc, f))
            size += len(at)
            if size >= FLUSH:
                flush()
                size = 0
        flush()
        return _table(rows, known)

    return run


CONTEXT = ("<u8", "u1", "u1", "u1", "<u4", "<i8", "<u4", "<u4")


def least_documents(group: np.ndarray, start: np.ndarray, doc: np.ndarray, data: np.ndarray, window: int) -> np.ndarray:
    """The smallest document among equal windows: most-significant-digit passes of eight bytes within the given groups.

    Windows begin at ``start`` in ``data`` (padded by eight bytes); a group that lies in one document is not sorted further.
    """
    out = doc.copy()
    live = np.arange(len(start))
    for at in [*range(0, window - 7, 8), *([window - 8] if window % 8 else [])]:
        word = _words(data, 0, len(data) - 7)[start[live] + at]
        order = np.lexsort((word, group[live]))
        live, word = live[order], word[order]
        g = group[live]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (word[1:] != word[:-1]))) if len(live) else np.zeros(0, dtype=bool)
        edges = np.flatnonzero(new)
        if not len(edges):
            return out
        sizes = np.diff(np.append(edges, len(live)))
        d = doc[live]
        low, high = np.minimum.reduceat(d, edges), np.maximum.reduceat(d, edges)
        group[live] = np.repeat(np.arange(len(edges)), sizes)
        keep = np.repeat(low != high, sizes)
        live = live[keep]
        if at + 8 >= window:
            out[live] = np.repeat(low, sizes)[keep]
    return out


def _decided(docs_parts: int, window: int):
    """Smallest document of every window, and from it the repeated windows of every row, as runs dealt by document."""

    def run(table: pa.Table) -> pa.Table:
        ids: dict[tuple, int] = {}
        texts: list[bytes] = []
        inst: list[list[np.ndarray]] = []
        for blob in _blobs(table, False):
            digit, off, count, data, k, doc, crc, first = _unpack(blob, *CONTEXT)
            ends = np.cumsum(count.astype(np.int64) + window - 1)
            whole = data.tobytes()
            mine = np.empty(len(digit), dtype=np.int64)
            a = 0
            for j, (d, o, e) in enumerate(zip(digit.tolist(), off.tolist(), ends.tolist(), strict=True)):
                key = (d, o, whole[a:e])
                got = ids.setdefault(key, len(ids))
                if got == len(texts):
                    texts.append(key[2])
                mine[j] = got
                a = e
            inst.append([mine[k], doc, crc, first])
        known = _gather(_blobs(table, True), *RUNS)
        if not inst:
            return _table(list(_dealt(known[0] % docs_parts, *known)))
        k, doc, crc, first = (np.concatenate(x) for x in zip(*inst, strict=True))
        digit = np.fromiter((x[0] for x in ids), dtype=np.uint64, count=len(ids))
        off = np.fromiter((x[1] for x in ids), dtype=np.int64, count=len(ids))
        ids.clear()
        count = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts)) - window + 1
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, k, doc)
        # windows of rows whose digit has other rows too: places in the bytes, group by (digit, place of the digit in the window)
        _, group, size = np.unique(digit, return_inverse=True, return_counts=True)
        base = np.concatenate(([0], np.cumsum(count)))
        own = np.repeat(np.arange(len(texts)), count)
        step = np.arange(base[-1]) - base[own]
        source = least[own]
        at = np.flatnonzero(size[group][own] > 1)
        if len(at):
            data = np.frombuffer(b"".join(texts) + bytes(8), dtype=np.uint8)
            begin = np.concatenate(([0], np.cumsum(count + window - 1)))[:-1]
            place = off[own[at]] - step[at]
            source[at] = least_documents(group[own[at]] * 256 + place, begin[own[at]] + step[at], source[at], data, window)
        low, high = np.minimum.reduceat(source, base[:-1]), np.maximum.reduceat(source, base[:-1])
        every, none = doc > high[k], doc <= low[k]
        runs = [tuple(known), (doc[every], crc[every], first[every], count[k[every]])]
        rest = np.flatnonzero(~every & ~none)
        if len(rest):
            n = count[k[rest]]
            row = np.repeat(rest, n)
            j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            hit = doc[row] > source[base[k[row]] + j]
            row, j = row[hit], j[hit]
            runs.append((doc[row], crc[row], first[row] + j, np.ones(len(row), dtype=np.int64)))
        doc, crc, first, n = (np.concatenate(x) for x in zip(*runs, strict=True))
        return _table(list(_dealt(doc % docs_parts, doc.astype("<i8"), crc.astype("<u4"), first.astype("<u4"), n.astype("<u4"))))

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def cut(b: bytes, first: np.ndarray, count: np.ndarray, window: int) -> tuple[bytes, int, int]:
    """The bytes outside the windows that begin in the runs, the number of bytes removed and of maximal removed runs."""
    edge = np.zeros(len(b) + 1, dtype=np.int64)
    np.add.at(edge, first.astype(np.int64), 1)
    np.add.at(edge, first.astype(np.int64) + count.astype(np.int64) - 1 + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
    return np.frombuffer(b, dtype=np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def _cut(window: int, with_text: bool):
    def run(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        runs = _by_text(*_gather(blobs.column("blob").to_pylist(), *RUNS))
        rows = []
        for i, b in zip(texts.column("doc_id").to_pylist(), texts.column("text").cast(pa.binary()).to_pylist(), strict=True):
            b = b or b""
            kept, removed, spans = b, 0, 0
            if i is not None and (found := runs.get((i, zlib.crc32(b)))) is not None:
                kept, removed, spans = cut(b, *found, window)
            row = (i, len(b), removed, spans, hashlib.sha256(kept).hexdigest())
            rows.append((*row, kept.decode("utf-8", "replace")) if with_text else row)
        schema = _RESULT.append(pa.field("kept", pa.string())) if with_text else _RESULT
        return pa.table([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(schema)], schema=schema)

    return run


def suffix_dedup(docs: DataFrame, window: int = 50, parts: int | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row (and the kept text, undecodable bytes replaced)."""
    if not K + 8 <= window <= 256:
        raise ValueError(f"window must lie between {K + 8} and 256 bytes")
    spark = docs.sparkSession
    small_batches(spark)
    if parts is None:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 20, -(-size // TARGET_BYTES)))
    tables = Tables(spark, "suffix-dedup")
    rows = docs.select("doc_id", "text")
    texts = rows.withColumn("part", F.coalesce(F.pmod("doc_id", F.lit(parts)), F.lit(0)).cast("int"))
    blobs = "part int, decided boolean, blob binary"
    instances = rows.mapInArrow(_digits(parts, window), blobs)
    by = lambda df: df.repartitionById(parts, "part").groupBy("part")  # noqa: E731  # a task for each part
    places = tables.write(by(instances).applyInArrow(_repeated(parts), blobs), "places")
    contexts = by(texts).cogroup(by(places)).applyInArrow(_contexts(parts, window), blobs)
    runs = tables.write(by(contexts).applyInArrow(_decided(parts, window), blobs), "runs")
    tables.drop(places)
    spec = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    return by(texts).cogroup(by(runs)).applyInArrow(_cut(window, with_text), spec)
