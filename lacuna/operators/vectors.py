"""Exact nearest neighbours by dot product: balls of vectors, and bounds that skip whole balls.

Every vector goes to the closest of some pivots, and a sort by pivot, distance and id splits the table into groups of like vectors; hot pivots are split by
distance, equal vectors by id.  Consecutive vectors of a pivot form blocks, and a group's blocks of one pivot form a shelf.  Each has a ball (centre and radius), and
two balls bound their products: <u, v> <= <c, d> + |c| s + |d| r + r s.  A block is sent to the groups of those shelves only that may still take something
from it, judged by the k-th best product that every vector finds within its own block.  Inside a group, the blocks with the highest bounds come first, and a
block meets only those whose k-th best it may still change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import small_batches
from lacuna.scratch import kept

#: Vectors in a block; vectors of a group; most groups; most pivots, and sampled vectors for each pivot.
BLOCK, SOUGHT, GROUPS, PIVOTS, SAMPLED = 64, 65536, 8192, 1024, 16
#: Blocks that are judged together inside a task.
TILE = 16
#: Bytes of an Arrow batch: a block's row holds all its vectors, and a task has some copies of a batch.
BATCH = 4 << 20
#: Products are compared in units of the fifth place; bounds are widened by this share of a unit for rounding in sums.
UNIT, SLACK = 1e5, 1e-3
_LAST = np.iinfo(np.int64).max
_BLOCKS = "g int, pivot int, centre binary, radius double, kth double, worst long, least long, ids binary, vectors binary"


def _units(s: np.ndarray) -> np.ndarray:
    """Products in units, halves away from zero."""
    s = s * UNIT
    return np.trunc(s + np.copysign(0.5, s))


def _bound(c: np.ndarray, r: np.ndarray, d: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The most units that products between the balls (c, r) and (d, s) may have: a row for each c, a column for each d."""
    nc, nd = np.linalg.norm(c, axis=1), np.linalg.norm(d, axis=1)
    most = c @ d.T + np.outer(nc, s) + np.outer(r, nd) + np.outer(r, s)
    return np.floor(most * UNIT + 0.5 + SLACK * (1 + 1e-6 * np.outer(nc + r, nd + s)))


def _may_change(bound: np.ndarray, kth: np.ndarray, worst: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether something with at most ``bound`` units and at least the id ``least`` may enter a list that ends with (kth, worst)."""
    return (bound > kth) | (bound == kth) & (least < worst)


def _closer(ids: np.ndarray, v: np.ndarray, others: np.ndarray, w: np.ndarray, best: np.ndarray, names: np.ndarray) -> None:
    """Updates best (units) and names (ids), which are in order, by what ``w`` has; ``others`` ascend."""
    k = best.shape[1]
    s = _units(v @ w.T)
    s[ids[:, None] == others[None, :]] = -np.inf
    rows = np.flatnonzero(s.max(axis=1) >= best[:, -1])
    s, found = s[rows], []
    for _ in range(min(k, len(others)) if len(rows) else 0):
        at = s.argmax(axis=1)[:, None]  # the first of equals has the least id
        found.append((np.take_along_axis(s, at, 1), others[at]))
        np.put_along_axis(s, at, -np.inf, 1)
    if found:
        score, name = np.hstack([best[rows], *[x for x, _ in found]]), np.hstack([names[rows], *[x for _, x in found]])
        order = np.lexsort((name, -score))[:, :k]
        best[rows], names[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(name, order, 1)


def _empty(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, k), -np.inf), np.full((n, k), _LAST)


def _read(block: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, np.int64)
    return names, np.frombuffer(block, np.float64).reshape(len(names), -1)


def _pivots(rows: DataFrame, n: int) -> np.ndarray:
    """Centres of like vectors, from at most PIVOTS * SAMPLED vectors, those with the least hashes.  They decide how much is skipped, not what is found."""
    wanted = max(1, min(PIVOTS, int(2 * n**0.5)))
    sample = np.array([r["vector"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(wanted * SAMPLED).select("vector").collect()], dtype=np.float64)
    centres = sample[:wanted].copy()
    for _ in range(4):
        own = _closest(sample, centres)[0]
        for i in np.unique(own):
            centres[i] = sample[own == i].mean(axis=0)
    return centres


def _closest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (v**2).sum(axis=1)[:, None] - 2 * v @ centres.T + (centres**2).sum(axis=1)[None, :]
    own = d.argmin(axis=1)
    return own, np.sqrt(np.maximum(d[np.arange(len(v)), own], 0))


def _blocks(rows: DataFrame, k: int, groups: int, centres: np.ndarray) -> DataFrame:
    """The vectors in blocks with balls and the last of the k best that a block's vectors find in it."""

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                own, far = _closest(np.stack(p["vector"].to_numpy()).astype(np.float64), centres)
                yield p.assign(pivot=own.astype(np.int32), far=np.round(far, 5))

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        g, rest = TaskContext.get().partitionId(), None
        for p in parts:
            p = p if rest is None else pd.concat([rest, p], ignore_index=True)
            starts = [0]  # where a block begins: at a new pivot or a full block
            pivot = p["pivot"].to_numpy()
            for i in range(1, len(p)):
                if pivot[i] != pivot[i - 1] or i - starts[-1] == BLOCK:
                    starts.append(i)
            rest = p.iloc[starts[-1] :]
            for i, j in zip(starts, starts[1:]):
                yield one(g, p.iloc[i:j])
        if rest is not None and len(rest):
            yield one(g, rest)

    def one(g: int, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id", kind="stable")
        ids, v = p["id"].to_numpy(np.int64), np.stack(p["vector"].to_numpy()).astype(np.float64)
        centre = v.mean(axis=0)
        best, names = _empty(len(ids), k)
        _closer(ids, v, ids, v, best, names)
        kth, worst = _last(best, names)
        radius = float(np.sqrt(((v - centre) ** 2).sum(axis=1).max()))
        row = (g, p["pivot"].iloc[0], centre.tobytes(), radius, kth, worst, ids[0], ids.tobytes(), v.tobytes())
        return pd.DataFrame([row], columns=[c.split()[0] for c in _BLOCKS.split(", ")])

    near = rows.mapInPandas(placed, "id long, vector array<double>, pivot int, far double")
    sorted_ = near.repartitionByRange(groups, "pivot", "far", "id").sortWithinPartitions("pivot", "far", "id")
    return kept(sorted_.mapInPandas(packed, _BLOCKS), "vector-blocks")


def _last(best: np.ndarray, names: np.ndarray) -> tuple[float, int]:
    """The least k-th entry of some lists, and of those with it the largest id."""
    kth = best[:, -1].min()
    return float(kth), int(names[best[:, -1] == kth, -1].max())


def _shelves(blocks: DataFrame) -> dict[str, np.ndarray]:
    """Ball and last entry of every group's blocks of a pivot: at most GROUPS + PIVOTS rows.

    The ball lies around the mean of the blocks' centres; the last entry is the least of the blocks'.
    """

    def summed(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        c = np.stack([np.frombuffer(x) for x in p["centre"]])
        centre = c.mean(axis=0)
        radius = float((np.linalg.norm(c - centre, axis=1) + p["radius"].to_numpy()).max())
        kth = p["kth"].min()
        return pd.DataFrame([(int(key[0]), centre.tobytes(), radius, kth, int(p["worst"][p["kth"] == kth].max()))], columns=["g", "centre", "radius", "kth", "worst"])

    found = blocks.select("g", "pivot", "centre", "radius", "kth", "worst").groupBy("g", "pivot").applyInPandas(summed, "g int, centre binary, radius double, kth double, worst long").toPandas()
    found = found.sort_values(["g", "radius"], ignore_index=True)
    return {
        "g": found["g"].to_numpy(), "centre": np.stack([np.frombuffer(x) for x in found["centre"]]),
        "radius": found["radius"].to_numpy(), "kth": found["kth"].to_numpy(), "worst": found["worst"].to_numpy(),
    }


def nearest_met(rows: DataFrame, k: int) -> DataFrame:
    """(id, other, rank, met): as :func:`nearest`; ``met`` counts the vectors that the id's block was compared with, out of all."""
    rows = rows.where("id IS NOT NULL AND vector IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))  # NaN is larger than all numbers
    spark = rows.sparkSession
    small_batches(spark, 10_000, BATCH)
    n = rows.count()
    if n == 0:
        return spark.createDataFrame([], "id long, other long, rank long, met long")
    groups = min(GROUPS, max(2 * spark.sparkContext.defaultParallelism, -(-n // SOUGHT)))
    blocks = _blocks(rows, k, groups, _pivots(rows, n))
    shelves = _shelves(blocks)

    def sent(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row of kind 0 for the block's own group, and one of kind 1 for every group that may take from it, with the highest bound there."""
        for p in parts:
            for i in range(0, len(p), 16):
                x = p.iloc[i : i + 16]
                d = np.stack([np.frombuffer(c) for c in x["centre"]])
                bound = _bound(shelves["centre"], shelves["radius"], d, x["radius"].to_numpy())
                wanted = _may_change(bound, shelves["kth"][:, None], shelves["worst"][:, None], x["least"].to_numpy()[None, :])
                for j in range(len(x)):
                    row = x.iloc[[j]]
                    to = pd.DataFrame({"to": shelves["g"][wanted[:, j]], "bound": bound[wanted[:, j], j]}).groupby("to", as_index=False).max()
                    own = pd.DataFrame({"to": row["g"], "bound": [np.inf], "kind": [0]})
                    yield pd.concat([own, to.assign(kind=1)]).merge(row, how="cross")[["to", "kind", "bound", "centre", "radius", "least", "ids", "vectors"]]

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, own, state = None, [], None

        def result() -> Iterator[pd.DataFrame]:
            if state:
                at, rank = np.nonzero(state["best"] > -np.inf)
                met = np.repeat(state["met"], np.diff(state["edges"]))
                yield pd.DataFrame({"id": state["ids"][at], "other": state["names"][at, rank], "rank": rank + 1, "met": met[at]})

        def begun(p: pd.DataFrame) -> dict:
            read = [_read(v, i) for v, i in zip(p["vectors"], p["ids"], strict=True)]
            edges = np.cumsum([0, *[len(ids) for ids, _ in read]])
            best, names = _empty(edges[-1], k)
            return {
                "ids": np.concatenate([ids for ids, _ in read]), "v": np.concatenate([v for _, v in read]), "best": best, "names": names, "edges": edges,
                "centre": np.stack([np.frombuffer(c) for c in p["centre"]]), "radius": p["radius"].to_numpy(),
                "kth": np.full(len(p), -np.inf), "worst": np.full(len(p), _LAST), "met": np.zeros(len(p), np.int64),
            }

        for p in parts:
            for g, x in p.groupby("to", sort=True):
                if g != group:
                    yield from result()
                    group, own, state = g, [], None
                if len(mine := x[x["kind"] == 0]):
                    own.append(mine)
                x = x[x["kind"] == 1]
                if len(x) and state is None:
                    state, own = begun(pd.concat(own)), []
                for j in range(0, len(x), 2 * TILE):
                    compare(state, x.iloc[j : j + 2 * TILE])
        yield from result()

    def compare(state: dict, x: pd.DataFrame) -> None:
        read = [_read(v, i) for v, i in zip(x["vectors"], x["ids"], strict=True)]
        d = np.stack([np.frombuffer(c) for c in x["centre"]])
        bound = _bound(state["centre"], state["radius"], d, x["radius"].to_numpy())
        wanted = _may_change(bound, state["kth"][:, None], state["worst"][:, None], x["least"].to_numpy()[None, :])
        for i in range(0, len(wanted), TILE):
            tile = wanted[i : i + TILE]
            if tile.mean() > 0.5:  # one large product is cheaper than many small ones
                meet(state, i, i + len(tile), read)
            else:
                for j in np.flatnonzero(tile.any(axis=1)):
                    meet(state, i + j, i + j + 1, [read[t] for t in np.flatnonzero(tile[j])])

    def meet(state: dict, i: int, j: int, targets: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """The blocks i to j - 1 meet all vectors of the targets."""
        others, w = np.concatenate([o for o, _ in targets]), np.concatenate([y for _, y in targets])
        order, edges = np.argsort(others, kind="stable"), state["edges"]
        at = slice(edges[i], edges[j])
        _closer(state["ids"][at], state["v"][at], others[order], w[order], state["best"][at], state["names"][at])
        state["met"][i:j] += len(others)
        for b in range(i, j):
            at = slice(edges[b], edges[b + 1])
            state["kth"][b], state["worst"][b] = _last(state["best"][at], state["names"][at])

    to = blocks.mapInPandas(sent, "to int, kind int, bound double, centre binary, radius double, least long, ids binary, vectors binary")
    dealt = to.repartition(groups, "to").sortWithinPartitions("to", "kind", F.desc("bound"), "least")
    return dealt.mapInPandas(search, "id long, other long, rank long, met long")


def nearest(rows: DataFrame, k: int) -> DataFrame:
    """(id, other, rank): for every row (id, vector) the k others with the largest dot products to five places; ties go to the lesser id.

    Exact, and no norm is assumed.  Vectors have one length; rows without id or vector, or with an entry that is null or not finite, are left out.  Where vectors have no structure that balls can show (random
    ones of many dimensions), every block still meets every other: the rows stay N for each group, the work quadratic.
    """
    return nearest_met(rows, k).select("id", "other", "rank")
