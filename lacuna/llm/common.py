"""Helpers shared by the corpus operators: shared-folder tables, Arrow text access, skew-safe joins."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.scratch import remove, shared_dir

#: Groups holding at least 1/HOT_SHARE of all rows are hot; there are HOT_SHARE of them at most,
#: which bounds every table of hot groups that is broadcast.
HOT_SHARE = 1000

#: Spark's setting for removing an execution's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_owned: dict[str, SparkSession] = {}


def _clean_up() -> None:
    for path, spark in list(_owned.items()):
        try:
            remove(spark, path)
        except Exception:  # the session may have ended first
            pass
        _owned.pop(path, None)


atexit.register(_clean_up)


class Tables:
    """Intermediate Parquet tables in the shared folder, cutting lineage so that lost executors cost a re-read.

    Superseded tables are dropped with :meth:`drop`; the rest go when the driver ends, as results are read from them after the operator has returned.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _owned[self.root] = spark

    def write(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = f"{self.root}/{self.n:03d}-{label}"
        self.n += 1
        conf, before = self.spark.conf, self.spark.conf.get(CLEAN_UP, None)
        try:  # once the table stands, the shuffles that led to it are not read again
            conf.set(CLEAN_UP, "true")
            df.write.mode("overwrite").parquet(path)
        finally:
            conf.unset(CLEAN_UP) if before is None else conf.set(CLEAN_UP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lacuna_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_lacuna_path", None)
        if path:
            remove(self.spark, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 256, size: int = 32 << 20) -> None:
    """Bounds what one Arrow batch holds by rows and by bytes, as texts may be long.

    The settings belong to the session and stay: results are computed after the operator has returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int = 32 << 20) -> Iterator[None]:
    """The same bounds for what is computed inside the block; the session's own settings hold again after it."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(x, None) for x in names]
    small_batches(spark, rows, size)
    try:
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def crc_mod(doc_id: Column | str, k: int) -> Column:
    """crc32 of the decimal id, modulo k: the split between learning and held-out rows."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(k)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column's values as UTF-8 bytes, null as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    """Tuples to record batches of bounded length."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


def attach_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of ``rows`` to one row per group, safe when one group holds a large share of all rows.

    Groups with at least ``total / HOT_SHARE`` rows go by broadcast (HOT_SHARE rows at most, by counting);
    the others meet their rows in a shuffled join, in which hot rows carry scattered keys that match nothing.
    """
    cols = [c for c in groups.columns if c != key]
    bar = max(2, -(-total // HOT_SHARE))
    hot = groups.where(F.col(size) >= bar).select(F.col(key), *[F.col(c).alias(f"_hot_{c}") for c in cols])
    cold = groups.where(F.col(size) < bar).select(F.col(key).alias("_cold_key"), *[F.col(c).alias(f"_cold_{c}") for c in cols])
    first = rows.join(F.broadcast(hot), key, "left")
    cold_row = F.col(f"_hot_{size}").isNull()
    scattered = F.xxhash64(*[F.col(c) for c in rows.columns]).cast(rows.schema[key].dataType)
    lookup = F.when(cold_row, F.col(key)).otherwise(scattered)
    joined = first.withColumns({"_lookup": lookup, "_cold": cold_row}).join(
        cold, (F.col("_lookup") == F.col("_cold_key")) & F.col("_cold"), "left"
    )
    return joined.select(
        *[F.col(c) for c in rows.columns], *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in cols]
    )
