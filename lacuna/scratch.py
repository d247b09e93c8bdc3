"""Tables between the steps of an operator, in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local: str | None = None
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only in local mode, where there is one machine."""
    global _local
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    _local = _local or tempfile.mkdtemp(prefix="lacuna-")
    return _local


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame, label: str, *partition: str) -> DataFrame:
    """Writes the rows once and reads them back, which cuts the lineage; ``partition`` columns prune later filters."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    writer = df.write.mode("overwrite").option("compression", "zstd")  # ids and hashes as hexadecimal digits take half of what they take without an entropy coder
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out._lacuna_path = path  # type: ignore[attr-defined]
    return out


def removed(df: DataFrame) -> None:
    """Deletes a table of :func:`kept` that nothing reads any more."""
    path = getattr(df, "_lacuna_path", None)
    if path:
        remove(df.sparkSession, path)
        _written.pop(path, None)


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the place of every row in a total order, from 1: a sort over ranges, and the ranges' sizes (a row for each) added up."""
    placed = kept(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    joined = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_at", "_before")


@atexit.register
def clean_up() -> None:
    """Removes what :func:`kept` wrote; long sessions may call it between queries whose results they have taken."""
    for path, spark in list(_written.items()):
        try:
            remove(spark, path)
        except Exception:  # the session may have ended first
            pass
        _written.pop(path, None)
