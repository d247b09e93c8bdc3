"""Near-duplicate detection: minima of universal hashes with banding, signature verification, exact confirmation, components.

Texts become sets of word shingles; equal sets are one class from the start and only one member of a class goes on.  A class's
signature has ``HASHES`` minima.  ``BANDS`` bands of ``ROWS`` minima deal classes into buckets (a pair at similarity 0.8 misses all buckets
with a probability of about 2e-6), and four bits of every minimum make a sketch for verification (its error at 0.8 has a standard
deviation of 0.021).

Inside a bucket pairs are never made into rows.  First every class meets the bucket's centre: the class whose buckets are most populous.
Pairs that the sketches admit are confirmed on the full sets and give components.  Then only buckets that still hold several components are
revisited, and there only classes outside the bucket's largest component meet the others of another component, in bounded blocks and twice.
The first meeting names the classes with an admitted partner: sketches and a bound (shingles that no other revisited class has cannot
be common to a pair) must admit it.  Those classes meet again with their full sets beside them, where the pairs are confirmed, and a link
is written only if it unites two components that the task has not yet united.  So every pair that shares a bucket has been confirmed, refuted, or
lies within one component already, and the rows written grow with the classes, whatever the number of pairs.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing; texts with fewer words than a shingle have one
element, their whole sequence; rows repeating a doc_id count as one document (the row kept is each of them; the
text with the least hash is compared with others); a null doc_id is linked
with nothing and kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, attach_group, batched, column, small_batches, utf8
from .components import connected_components

ROWS, BANDS, HASHES = 6, 44, 384
BLOCK = 512
#: Sketches admit a pair from this estimated similarity on, 4.6 standard deviations (of 0.0212) under 0.8.
ADMIT = 0.7025
#: Ids that a semi-join may broadcast: 16 MB.
BROADCAST_IDS = 1_000_000
#: Least number of stretches over which a centre's members are dealt.
STRETCHES = 16
#: Rows of a bucket, and shingles of their sets, on either side of one block.
MEET, MEET_SHINGLES = 512, 1 << 20
#: Pairs of a block that are compared at once: 6 MB.
COMPARED = 1 << 13

_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_K = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


class _Words(dict):
    """64-bit hashes of words, remembered for the frequent ones."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(b: bytes, size: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles: A-Z lower-cased, words between ASCII white space."""
    w = b.lower().split()
    n = len(w)
    h = np.fromiter(map(words.__getitem__, w), dtype=np.uint64, count=n)
    if n == 0:
        return h
    if n < size:
        return _mix((h * _K[:n]).sum(keepdims=True) + np.uint64(n))
    total = h[: n - size + 1] * _K[0]
    for k in range(1, size):
        total += h[k : n - size + 1 + k] * _K[k]
    return np.unique(_mix(total))


def minima(s: np.ndarray) -> np.ndarray:
    """The HASHES minima of a shingle set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    room = np.empty((HASHES, min(BLOCK, len(x))), dtype=np.uint32)
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK]
        out = room[:, : len(part)]
        np.multiply(_A[:, None], part[None, :], out=out)
        out += _B[:, None]
        np.minimum(least, out.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    used = least[: ROWS * BANDS].reshape(BANDS, ROWS).astype(np.uint64)
    return _mix((used * _K[:ROWS]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64) * _K[ROWS]).view(np.int64)


def sketch(least: np.ndarray) -> bytes:
    """Four bits of every minimum."""
    low = (least & 15).astype(np.uint8)
    return (low[::2] | low[1::2] << 4).tobytes()


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches, row by row."""
    d = a ^ b
    equal = ((d & 15) == 0).sum(axis=1) + ((d >> 4) == 0).sum(axis=1)
    return (equal / HASHES - 1 / 16) * 16 / 15


def _sketches(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(-1, HASHES // 2)


_SIGNED = pa.schema([
    ("doc_id", pa.int64()), ("version", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64())),
])


def _signatures(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        words = _Words()
        for batch in batches:
            for i, version, b in zip(column(batch, "doc_id"), column(batch, "version"), utf8(batch, "text"), strict=True):
                s = shingles(b, size, words)
                if not len(s) or i is None:
                    yield (i, version, len(s), None, None, None)
                    continue
                least = minima(s)
                yield (i, version, len(s), xxhash.xxh3_128_hexdigest(s.tobytes()), sketch(least), band_keys(least).tolist())

    return lambda batches: batched(rows(batches), _SIGNED, 512)


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sizes can reach the threshold and whose sketches agree enough."""
    side = lambda name, key: classes.select(F.col("rep").alias(key), F.col("n").alias(f"{name}n"), F.col("sketch").alias(f"{name}s"))
    fits = F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent
    joined = pairs.join(side("a", "u"), "u").join(side("b", "v"), "v").where(fits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = agreeing(_sketches(column(batch, "as")), _sketches(column(batch, "bs"))) >= ADMIT - 0.8 + percent / 100
            yield batch.select(["u", "v"]).filter(pa.array(good))

    return joined.select("u", "v", "as", "bs").mapInArrow(rows, "u long, v long")


_MEETING = ("key", "band", "rep", "component", "main", "n", "most", "sketch", "keys")


def _deal(rows: DataFrame, parts: int) -> DataFrame:
    """The rows of every bucket dealt into blocks (key, ob, ib) that hold each outer row (of a component other than the main one) beside each row.

    A bucket's blocks follow the number and the size of its outer rows and of all its rows; outer rows come first in a block.
    """
    blocks = lambda side: F.ceil(F.greatest(F.sum(side) / MEET, F.sum(side * F.col("n")) / MEET_SHINGLES, F.lit(1)))
    out = (F.col("component") != F.col("main")).cast("long")
    counts = rows.groupBy("key").agg(blocks(out).alias("obs"), blocks(F.lit(1)).alias("ibs"), F.sum(out).alias("outside")).where("outside > 0").drop("outside")
    rows = rows.join(counts, "key")
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    outer = rows.where("component <> main").withColumns({"ob": mine("obs"), "inner": F.lit(False)}).withColumn("ib", every("ibs"))
    inner = rows.withColumns({"ib": mine("ibs"), "inner": F.lit(True)}).withColumn("ob", every("obs"))
    both = outer.unionByName(inner).drop("obs", "ibs")
    return both.repartition(parts, "key", "ob", "ib").sortWithinPartitions("key", "ob", "ib", "inner", "rep")


class _Side:
    """Columns of some rows of a block as arrays."""

    def __init__(self, parts: list[dict[str, list]]):
        whole = {c: sum((p[c] for p in parts), []) for c in parts[0]}
        for c in ("rep", "component", "main", "n", "most"):
            setattr(self, c, np.array(whole[c], dtype=np.int64))
        self.band = whole["band"][0]
        self.sketch = _sketches(whole["sketch"])
        self.keys = np.array(whole["keys"], dtype=np.int64).reshape(-1, BANDS)
        self.sets = [np.frombuffer(x, dtype=np.uint64) for x in whole.get("set", [])]


def _admitted(a: _Side, b: _Side, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in a (outer) and b (inner) of the pairs to be confirmed in this bucket, and their estimated similarity."""
    both = np.minimum(a.most[:, None], b.most[None, :])
    fits = (a.component[:, None] != b.component[None, :]) & (both * 100 >= (a.n[:, None] + b.n[None, :] - both) * percent)
    fits &= (b.component == b.main)[None, :] | (a.rep[:, None] < b.rep[None, :])
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    rows, columns = np.nonzero(fits)
    for at in range(0, len(rows), COMPARED):
        i, j = rows[at : at + COMPARED], columns[at : at + COMPARED]
        like = agreeing(a.sketch[i], b.sketch[j])
        near = like >= ADMIT - 0.8 + percent / 100
        i, j, like = i[near], j[near], like[near]
        first = (a.keys[i] == b.keys[j]).argmax(axis=1) == a.band  # in the first of their buckets only
        found.append((i[first], j[first], like[first]))
    i, j, like = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j, like


def _sides(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[_Side, _Side]]:
    """(outer, some inner) rows of every block: the outer ones are held, the inner ones stream past them."""
    key, outer, held = None, [], None
    for batch in batches:
        cols = {c: column(batch, c) for c in (*columns, "ob", "ib", "inner")}
        ids = list(zip(cols["key"], cols["ob"], cols["ib"], cols["inner"], strict=True))
        at = 0
        while at < len(ids):
            end = at
            while end < len(ids) and ids[end] == ids[at]:
                end += 1
            if ids[at][:3] != key:
                key, outer, held = ids[at][:3], [], None
            part = {c: cols[c][at:end] for c in columns}
            if not ids[at][3]:
                outer.append(part)
                held = None
            elif outer:
                held = held or _Side(outer)
                yield held, _Side([part])
            at = end


_NEEDED = pa.schema([("key", pa.int64()), ("rep", pa.int64())])


def _sift(percent: int):
    """(key, rep) of the classes that have an admitted partner in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, seen = None, 0, np.zeros(0, dtype=bool)

        def flush() -> Iterator[pa.RecordBatch]:
            if seen.any():
                reps = held.rep[seen]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(reps), keys)), pa.array(reps)], schema=_NEEDED)

        for a, b in _sides(batches, _MEETING):
            if a is not held:
                yield from flush()
                held, keys, seen = a, int(a.keys[0][a.band]), np.zeros(len(a.rep), dtype=bool)
            i, j, _ = _admitted(a, b, percent)
            seen[i] = True
            if len(j):
                reps = b.rep[np.unique(j)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(reps), keys)), pa.array(reps)], schema=_NEEDED)
        yield from flush()

    return run


def _unite(percent: int):
    """Links (u, v) confirmed on the full sets, each of which unites two components that the task has not yet united."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        for a, b in _sides(batches, (*_MEETING, "set")):
            i, j, like = _admitted(a, b, percent)
            for k in np.argsort(-like, kind="stable"):
                s, t = a.sets[i[k]], b.sets[j[k]]
                x, y = find(int(a.component[i[k]])), find(int(b.component[j[k]]))
                if x != y:
                    if len(s) > len(t):
                        s, t = t, s
                    both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        root[max(x, y)] = min(x, y)
                        yield int(a.rep[i[k]]), int(b.rep[j[k]])

    return lambda batches: batched(run(batches), schema)


def _version() -> Column:
    return F.xxhash64("text").alias("version")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents ``ids`` (doc_id); of rows that repeat an id the one with the least version."""
    rows = only_ids(docs.select("doc_id", "text").where(F.col("text").rlike(r"[^\x20\x09-\x0D]")), ids, "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", _version()).alias("text"))


def only_ids(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi- or anti-join on distinct ids; they are broadcast only if counted as few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, how)


def _confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int, tables: Tables) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough.

    Each centre u meets its members in stretches whose number follows the partitions', sorted so that its own text comes first; a task holds two
    sets at a time.
    """
    pairs = tables.write(pairs.select("u", "v").distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    texts = tables.write(_texts(docs, ids), "texts")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(max(STRETCHES, parts // 4))))
    members = salted.select("u", "salt", "v").join(texts.withColumnRenamed("doc_id", "v"), "v")
    centres = salted.select("u", "salt").distinct().join(texts.withColumnRenamed("doc_id", "u"), "u")
    rows = centres.select("u", "salt", F.lit(None).cast("long").alias("v"), "text").unionByName(members.select("u", "salt", "v", "text"))
    dealt = rows.repartition(parts, "u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        words, key, own = _Words(), None, None
        for batch in batches:
            for u, salt, v, b in zip(column(batch, "u"), column(batch, "salt"), column(batch, "v"), utf8(batch, "text"), strict=True):
                s = shingles(b, size, words)
                if v is None:
                    key, own = (u, salt), s
                elif key == (u, salt):
                    both = np.intersect1d(own, s, assume_unique=True).size
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        yield u, v

    return tables.write(dealt.mapInArrow(lambda b: batched(check(b), schema), "u long, v long"), "links")


def _own_shingles(reps: DataFrame, docs: DataFrame, size: int, tables: Tables) -> DataFrame:
    """(rep, own): how many of a class's shingles no other of the classes ``reps`` has."""
    texts = _texts(docs, reps.select(F.col("rep").alias("doc_id")))
    schema = pa.schema([("rep", pa.int64()), ("h", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for i, b in zip(column(batch, "doc_id"), utf8(batch, "text"), strict=True):
                h = shingles(b, size, words).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i)), pa.array(h)], schema=schema)

    single = texts.mapInArrow(rows, "rep long, h long").groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("rep")).where("c = 1")
    return tables.write(single.groupBy("rep").agg(F.count(F.lit(1)).alias("own")), "own")


def _sets(reps: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(rep, set): the sorted shingle hashes of the classes ``reps``."""
    texts = _texts(docs, reps.select(F.col("rep").alias("doc_id")))
    schema = pa.schema([("rep", pa.int64()), ("set", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        words = _Words()
        for batch in batches:
            for i, b in zip(column(batch, "doc_id"), utf8(batch, "text"), strict=True):
                yield i, shingles(b, size, words).tobytes()

    return texts.mapInArrow(lambda batches: batched(rows(batches), schema, 64), "rep long, set binary")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    tables = Tables(spark, "near-dedup")
    spec = "doc_id long, version long, n long, digest string, sketch binary, keys array<long>"
    signed = tables.write(docs.select("doc_id", _version(), "text").mapInArrow(_signatures(size), spec), "signed")
    groups = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    total = signed.count()
    members = attach_group(signed.select("doc_id", "version", "n", "digest"), groups, "digest", "copies", total)
    members = tables.write(members.select("doc_id", "version", "n", F.coalesce("rep", "doc_id").alias("rep")), "members")
    first = members.where("doc_id = rep and n > 0").groupBy("rep").agg(F.min("version").alias("chosen"))
    members = members.drop("version")
    classes = signed.where("digest is not null").join(first, (F.col("doc_id") == F.col("rep")) & (F.col("version") == F.col("chosen")))
    classes = tables.write(classes.dropDuplicates(["rep"]).select("rep", "n", "sketch", "keys"), "classes")

    # buckets with more than one class
    dealt = classes.select("rep", F.posexplode("keys").alias("band", "key"))
    several = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    bands = tables.write(dealt.join(several, "key"), "bands")
    weight = bands.groupBy("rep").agg(F.sum("c").alias("weight"))
    weighed = bands.join(weight, "rep")
    centre = weighed.groupBy("key").agg(F.max(F.struct(F.col("weight"), (-F.col("rep")).alias("neg"))).alias("top"))
    pairs = bands.join(centre.select("key", (-F.col("top.neg")).alias("u")), "key").where("rep <> u").select("u", F.col("rep").alias("v")).distinct()
    near = tables.write(_near(pairs, classes, percent), "near")
    links = _confirm(near, docs, size, percent, tables)
    component = connected_components(links, tables)

    # buckets that still hold several components: what is outside the largest meets the others
    held = bands.join(component.select(F.col("node").alias("rep"), "component"), "rep", "left")
    held = tables.write(held.select("key", "band", "c", "rep", F.coalesce("component", "rep").alias("component")), "held")
    counted = held.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    largest = counted.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "main")
    mixed = tables.write(held.join(largest, "key"), "mixed")
    own = _own_shingles(mixed.select("rep").distinct(), docs, size, tables)
    able = classes.join(own, "rep", "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    mixed = tables.write(mixed.join(able.where(F.col("most") * 100 >= F.col("n") * percent), "rep"), "able")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    needed = tables.write(_deal(mixed.select(*_MEETING), parts).mapInArrow(_sift(percent), "key long, rep long").distinct(), "needed")
    rows = mixed.select(*_MEETING).join(needed, ["key", "rep"]).join(_sets(needed.select("rep").distinct(), docs, size), "rep")
    rows = tables.write(rows, "meeting")
    more = tables.write(_deal(rows, parts).mapInArrow(_unite(percent), "u long, v long").distinct(), "more")
    if not more.isEmpty():
        component = connected_components(links.unionByName(more), tables)
    named = component.select(F.col("node").alias("rep"), "component")
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    named = sizes.join(named, "rep", "left").select("rep", "copies", F.coalesce("component", "rep").alias("component"))
    found = attach_group(members, named, "rep", "copies", total)
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
