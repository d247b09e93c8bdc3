"""Ranks within groups, ties told apart, by a secondary sort over all tasks.

A custom partitioner gives every row its task by (group, pair, tie-break) ranges, and rows are sorted within tasks
(``repartitionById`` and ``sortWithinPartitions``: the DataFrame form of ``repartitionAndSortWithinPartitions``).  A group or pair of any size
is therefore spread over as many tasks as its rows need; equal rows are told apart by a running number, so that even they can be divided.
The ranges' bounds come from a sample of ``PER_TASK`` rows for each task, and there are as many tasks as the session's shuffle partitions,
so neither follows the input; results do not depend on either.

A state machine streams over each task's sorted rows in Arrow batches.  It keeps the counts of the current group and pair only, and holds
rows of the current pair until their number is known, ``HOLD`` at most; a longer pair's rows leave it without that number.  For its first and last
group and pair, and for longer pairs, it also leaves a count.  The boundary summary pass adds these counts up over the tasks (a few rows a task)
and repairs the rows of groups and pairs that began in an earlier task or end in a later one.

Defined cases: columns are longs; null groups are one group, null pairs come first and are equal, null tie-breaks come last; repeated rows are ranked
separately; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.scratch import kept

from .common import arrow_batches

#: Sampled rows for each task's bounds; rows of one pair that a task holds until their number is known; kinds of the machine's rows.
PER_TASK, HOLD = 64, 1 << 16
LINE, RUN, GROUP = 0, 1, 2
SALTS = 251


@dataclass(frozen=True)
class Order:
    """Columns of the groups, of the pairs (nulls first) and of the tie-breaks (nulls last), all ascending."""

    group: tuple[str, ...]
    pair: tuple[str, ...]
    ties: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return [*self.group, *self.pair, *self.ties]

    def sorting(self) -> list[Column]:
        return [F.col(c).asc_nulls_first() for c in (*self.group, *self.pair)] + [F.col(c).asc_nulls_last() for c in self.ties]


def _values(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column's numbers, 0 for null, and where it is null."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.fill_null(0).to_numpy(zero_copy_only=False), col.is_null().to_numpy(zero_copy_only=False)


def keys(batch: pa.RecordBatch, order: Order, first: int) -> np.ndarray:
    """Byte strings that sort as the rows do; the last byte is a running number from ``first`` on, modulo SALTS, which divides equal rows."""
    n = batch.num_rows
    out = np.empty((n, 9 * len(order.columns) + 1), dtype=np.uint8)
    for i, name in enumerate(order.columns):
        value, null = _values(batch, name)
        out[:, 9 * i] = null if name in order.ties else ~null
        out[:, 9 * i + 1 : 9 * i + 9] = (value.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(n, 8)
    out[:, -1] = (np.arange(first, first + n) * 97) % SALTS + 1  # never 0, which a byte string would lose at its end
    return out.reshape(-1).view(f"S{out.shape[1]}")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    seen = 0
    for batch in batches:
        yield batch, seen
        seen += batch.num_rows


def bounds(rows: DataFrame, order: Order, tasks: int) -> np.ndarray:
    """Keys at which tasks begin, but for the first: ``tasks`` - 1 of a sample's keys at most."""
    share = tasks * PER_TASK / max(1, rows.count())

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first in _numbered(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys(batch, order, first).tolist(), pa.binary())], ["key"])

    some = rows if share >= 1 else rows.sample(share, seed=11)
    found = np.sort(np.array([bytes(r.key) for r in some.mapInArrow(sampled, "key binary").collect()], dtype=f"S{9 * len(order.columns) + 1}"))
    return np.unique(found[np.arange(1, tasks) * len(found) // tasks]) if len(found) else found


def placed(rows: DataFrame, order: Order, tasks: int) -> DataFrame:
    """Rows dealt to tasks by range and sorted within them."""
    cuts = bounds(rows, order, tasks)

    def task_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first in _numbered(batches):
            at = np.searchsorted(cuts, keys(batch, order, first), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "task"])

    schema = ", ".join([*(f"`{c}` long" for c in rows.columns), "task int"])
    return rows.mapInArrow(task_of, schema).repartitionById(tasks, "task").sortWithinPartitions(*order.sorting())


@dataclass
class Machine:
    """The state between batches of a task's sorted rows."""

    order: Order
    most: int
    schema: pa.Schema
    hold: int = HOLD
    task: int = 0
    group_at: tuple | None = None  # the current group's and pair's values
    pair_at: tuple | None = None
    group_no: int = -1
    run_no: int = -1
    in_group: int = 0
    in_run: int = 0
    place: int = 0
    held: list[tuple[pa.RecordBatch, np.ndarray]] = field(default_factory=list)  # rows of the current pair and their positions
    n_held: int = 0
    long: bool = False

    def feed(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        if not n:
            return
        self.task = batch.column(batch.schema.get_field_index("task"))[0].as_py()
        new_group = self._changes(batch, self.order.group, self.group_at)
        new_run = new_group | self._changes(batch, self.order.pair, self.pair_at)
        starts, at = np.flatnonzero(new_run), np.arange(n)
        opened = np.maximum.accumulate(np.where(new_group, at, -1))
        pos = np.where(opened >= 0, at - opened + 1, self.in_group + at + 1)
        head = int(starts[0]) if len(starts) else n  # rows that go on with the pair of the batch before
        if head:
            yield from self._hold(batch.slice(0, head), pos[:head])
            self.in_run += head
        self.in_group += int(np.flatnonzero(new_group)[0]) if new_group.any() else n
        if len(starts):
            yield from self._close()
            if self.group_no == 0 and new_group.any():
                yield self._count(GROUP, self.group_at, None, self.in_group)
            yield from self._whole(batch, starts, new_group, pos)
        last = n - 1
        self.group_at, self.pair_at = self._row(batch, last, self.order.group), self._row(batch, last, self.order.pair)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.group_at is None:
            return
        number = self.in_run
        yield from self._let_go(None if self.long else number)
        yield self._count(RUN, self.group_at, self.pair_at, number)
        yield self._count(GROUP, self.group_at, None, self.in_group)

    def _changes(self, batch: pa.RecordBatch, names: tuple[str, ...], before: tuple | None) -> np.ndarray:
        out = np.zeros(batch.num_rows, dtype=bool)
        for name in names:
            value, null = _values(batch, name)
            out[1:] |= (value[1:] != value[:-1]) | (null[1:] != null[:-1])
        out[0] = before is None or self._row(batch, 0, names) != before
        return out

    @staticmethod
    def _row(batch: pa.RecordBatch, i: int, names: tuple[str, ...]) -> tuple:
        return tuple(batch.column(batch.schema.get_field_index(c))[i].as_py() for c in names)

    def _hold(self, rows: pa.RecordBatch, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of the current pair, whose number is not known yet."""
        if self.place > self.most:
            return
        self.held.append((rows, pos))
        self.n_held += len(pos)
        if self.long or self.n_held > self.hold:
            self.long = True
            yield from self._let_go(None)

    def _let_go(self, number: int | None) -> Iterator[pa.RecordBatch]:
        for rows, pos in self.held:
            n = len(pos)
            tied = pa.nulls(n, pa.int64()) if number is None else pa.array(np.full(n, number, dtype=np.int64))
            yield self._lines(rows, np.full(n, self.group_no), np.full(n, self.run_no), pos, np.full(n, self.place), tied)
        self.held, self.n_held = [], 0

    def _close(self) -> Iterator[pa.RecordBatch]:
        """Ends the pair of the batch before."""
        if self.group_at is None:
            return
        yield from self._let_go(None if self.long else self.in_run)
        if self.long or self.run_no == 0:
            yield self._count(RUN, self.group_at, self.pair_at, self.in_run)

    def _whole(self, batch: pa.RecordBatch, starts: np.ndarray, new_group: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs that begin in the batch: all but the last one end in it."""
        n, first, last = batch.num_rows, int(starts[0]), int(starts[-1])
        sizes = np.diff(np.append(starts, n))
        run_no = np.repeat(self.run_no + 1 + np.arange(len(starts)), sizes)
        group_no = self.group_no + np.cumsum(new_group)[first:]
        place, tied, pos = np.repeat(pos[starts], sizes), np.repeat(sizes, sizes), pos[first:]
        ended = np.arange(first, n) < last
        mask = ended & (place <= self.most)
        rows = batch.slice(first).filter(pa.array(mask))
        if rows.num_rows:
            yield self._lines(rows, group_no[mask], run_no[mask], pos[mask], place[mask], pa.array(tied[mask]))
        if self.run_no < 0 and last > first:  # the task's first pair and group
            yield self._count(RUN, self._row(batch, 0, self.order.group), self._row(batch, 0, self.order.pair), int(sizes[0]))
        if self.group_no < 0 and (more := np.flatnonzero(new_group)[1:]).size:
            yield self._count(GROUP, self._row(batch, 0, self.order.group), None, int(more[0]))
        self.group_no, self.run_no = int(group_no[-1]), int(run_no[-1])
        self.in_group, self.in_run, self.place, self.long = int(pos[-1]), int(sizes[-1]), int(place[-1]), False
        yield from self._hold(batch.slice(last), pos[last - first :])

    def _lines(self, rows, group_no, run_no, pos, place, tied) -> pa.RecordBatch:
        n = rows.num_rows
        own = [rows.column(rows.schema.get_field_index(c)) for c in self.order.columns]
        numbers = [np.full(n, self.task), group_no, run_no, pos, place]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, LINE, np.int32)), *own, *(pa.array(np.asarray(x, np.int64)) for x in numbers), tied], schema=self.schema)

    def _count(self, kind: int, group: tuple, pair: tuple | None, n: int) -> pa.RecordBatch:
        run = self.run_no if self.run_no >= 0 else 0
        values = [kind, *group, *(pair or [None] * len(self.order.pair)), *[None] * len(self.order.ties), self.task, max(self.group_no, 0), run, None, None, n]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, self.schema, strict=True)], schema=self.schema)


def ranked_ties(rows: DataFrame, order: Order, most: int, tasks: int | None = None, hold: int = HOLD, batch: int = 10_000) -> DataFrame:
    """The rows whose place is at most ``most``: the order's columns, ``pos`` (equal rows apart), ``place`` (1 plus the rows of earlier pairs) and
    ``tied`` (rows of the pair), counted within groups.  ``tasks`` is the session's number of shuffle partitions unless given; ``hold`` and ``batch`` bound memory."""
    spark = rows.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(*[F.col(c).cast("long") for c in order.columns])
    numbers = ["task", "group_no", "run_no", "pos", "place", "tied"]
    schema = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in (*order.columns, *numbers))])

    def machine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Machine(order, most, schema, hold)
        for batch in batches:
            yield from state.feed(batch)
        yield from state.end()

    ddl = ", ".join(["kind int", *(f"`{c}` long" for c in (*order.columns, *numbers))])
    with arrow_batches(spark, batch):
        found = kept(placed(rows, order, tasks).mapInArrow(machine, ddl), "ranked-ties", "kind")
    return repaired(found, order, most)


def repaired(found: DataFrame, order: Order, most: int) -> DataFrame:
    """The boundary summary pass: counts of earlier tasks are added to the rows of groups and pairs that began there."""
    out = [*order.columns, "pos", "place", "tied"]
    by_group = Window.partitionBy(*order.group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_pair = Window.partitionBy(*order.group, *order.pair)
    groups = found.where(F.col("kind") == GROUP).select("task", "group_no", F.coalesce(F.sum("tied").over(by_group), F.lit(0)).alias("before"))
    runs = found.where(F.col("kind") == RUN).select(
        "task",
        "run_no",
        F.coalesce(F.sum("tied").over(by_pair.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("same_before"),
        F.sum("tied").over(by_pair).alias("in_all"),
    )
    lines = found.where(F.col("kind") == LINE).join(groups, ["task", "group_no"], "left").join(runs, ["task", "run_no"], "left")
    before, same = F.coalesce("before", F.lit(0)), F.coalesce("same_before", F.lit(0))
    mended = lines.withColumns({"pos": F.col("pos") + before, "place": F.col("place") + before - same, "tied": F.coalesce("in_all", "tied")})
    return mended.where(F.col("place") <= most).select(*out)


# --- sale lines ---

LINE_ORDER = Order(("vendor_id", "part", "month"), ("fewer", "percent"), ("sale_id", "line_no", "quantity", "amount_cents"))


def _whole_number(x: Column) -> Column:
    """The floor as a long; null where there is none (not a number, infinite)."""
    return F.when(F.abs(x) < 9e18, F.floor(x).cast("long"))


def sale_line_ranks(lines: DataFrame, most: int = 3) -> DataFrame:
    """Lines of ``sale_lines`` by vendor, item part and month, larger quantity tens first, then smaller discount percents."""
    joint = F.col("sale_id").isNotNull() & (F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5 == 0)
    keyed = lines.select(
        F.when(joint, -1).otherwise(F.col("vendor_id")).alias("vendor_id"),
        F.when(joint, -1).otherwise(F.coalesce(F.col("item_id") % 10, F.lit(-1))).alias("part"),
        F.when(joint, -1).otherwise(F.coalesce(100 * F.year("shipped_at") + F.month("shipped_at"), F.lit(-1))).alias("month"),
        (-F.floor(F.col("quantity") / 10)).alias("fewer"),
        _whole_number(100 * F.col("discount") + 0.5).alias("percent"),
        "sale_id",
        "line_no",
        "quantity",
        _whole_number(100 * F.col("amount") + 0.5).alias("amount_cents"),
    )
    names = ["vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied"]
    return ranked_ties(keyed, LINE_ORDER, most).select(*names)


def oracle_sql() -> str:
    """DuckDB SQL for :func:`sale_line_ranks`; crc32 from its polynomial."""
    return r"""
        WITH crc AS MATERIALIZED (
          SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        ids AS (
          SELECT sale_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(sale_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 AS joint
          FROM (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL), crc),
        keyed AS (
          SELECT CASE WHEN joint THEN -1 ELSE vendor_id END AS vendor_id,
            CASE WHEN joint THEN -1 ELSE coalesce(item_id % 10, -1) END AS part,
            CASE WHEN joint THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END AS month,
            CAST(floor(quantity / 10) AS BIGINT) AS tens,
            CASE WHEN abs(100 * discount + 0.5) < 9e18 THEN CAST(floor(100 * discount + 0.5) AS BIGINT) END AS percent,
            sale_id, CAST(line_no AS BIGINT) AS line_no, CAST(quantity AS BIGINT) AS quantity,
            CASE WHEN abs(100 * amount + 0.5) < 9e18 THEN CAST(floor(100 * amount + 0.5) AS BIGINT) END AS amount_cents
          FROM sale_lines LEFT JOIN ids USING (sale_id)),
        ranked AS (
          SELECT *, row_number() OVER (g ORDER BY tens DESC NULLS FIRST, percent NULLS FIRST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos,
            rank() OVER (g ORDER BY tens DESC NULLS FIRST, percent NULLS FIRST) AS place,
            count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied
          FROM keyed WINDOW g AS (PARTITION BY vendor_id, part, month))
        SELECT CAST(vendor_id AS BIGINT) AS vendor_id, CAST(part AS BIGINT) AS part, CAST(month AS BIGINT) AS month, pos, place, sale_id, line_no, quantity, percent, amount_cents, tied
        FROM ranked WHERE place <= 3"""
