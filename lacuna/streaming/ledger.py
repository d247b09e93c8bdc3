"""Sinks and scoring loops whose replayed batches change nothing: every batch has its own folders, and a ledger says which are complete.

A batch's folders carry the streaming query's id and the batch's number, and are written whole, so a batch that is run again after a failure replaces
what it had left.  The ledger's entry is written last; readers take entered batches only and never see half of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lacuna.operators import models

LEDGER = "ledger"


def _run_id(spark: SparkSession) -> str:
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def entered(spark: SparkSession, root: str) -> DataFrame:
    """(run, batch, part, n): complete batches and how many rows each part of them has."""
    schema = "part string, n long, run string, batch long"
    return spark.read.schema(schema).parquet(f"{root}/{LEDGER}") if _exists(spark, f"{root}/{LEDGER}") else spark.createDataFrame([], schema)


def committed(spark: SparkSession, root: str, part: str, schema: str) -> DataFrame:
    """Rows of a part, of complete batches only; each batch once."""
    if not _exists(spark, f"{root}/{part}"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, run string, batch long").parquet(f"{root}/{part}")
    return rows.join(entered(spark, root).select("run", "batch").distinct(), ["run", "batch"], "left_semi").drop("run", "batch")


def write(batch: DataFrame, number: int, root: str, parts: dict[str, Callable[[DataFrame], DataFrame]], run: str | None = None) -> None:
    """Writes a batch's parts and then its entry; a complete batch is left as it is."""
    spark = batch.sparkSession
    at = f"run={run or _run_id(spark)}/batch={number}"
    if _exists(spark, f"{root}/{LEDGER}/{at}"):
        return
    rows = batch.persist()
    try:
        counts = None
        for name, of in parts.items():
            path = f"{root}/{name}/{at}"
            of(rows).write.mode("overwrite").parquet(path)
            n = spark.read.parquet(path).agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
            counts = n if counts is None else counts.unionByName(n)
        counts.coalesce(1).write.mode("overwrite").parquet(f"{root}/{LEDGER}/{at}")
    finally:
        rows.unpersist()


def split(stream: DataFrame, root: str, ok: str | Column, checkpoint: str) -> StreamingQuery:
    """Rows that satisfy ``ok`` become part ``done``, the others ``failed``; everything available is taken, then the query ends."""
    good = F.coalesce(F.expr(ok) if isinstance(ok, str) else ok, F.lit(False))
    parts = {"done": lambda b: b.where(good), "failed": lambda b: b.where(~good)}
    return stream.writeStream.foreachBatch(lambda b, n: write(b, n, root, parts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ANSWERS = "id string, reply string, violations array<string>, attempt int"


def attempts(spark: SparkSession, root: str) -> DataFrame:
    """(id, attempts, accepted): how often each id was asked in complete batches, and whether a reply of it had no violations."""
    log = committed(spark, root, "answers", ANSWERS)
    return log.groupBy("id").agg(F.max("attempt").alias("attempts"), F.bool_or(F.coalesce(F.size("violations") == 0, F.lit(False))).alias("accepted"))


def scored(stream: DataFrame, root: str, model: models.Model, check: Callable[[DataFrame], DataFrame], checkpoint: str, most: int = 2) -> StreamingQuery:
    """A scoring loop over a stream of (id, prompt): an id is asked until a reply is accepted, ``most`` times at most over all batches and restarts.

    ``check`` maps (id, reply) to (id, violations); unreadable replies have null violations and count as attempts.
    """

    def answers(batch: DataFrame) -> DataFrame:
        spark = batch.sparkSession
        so_far = attempts(spark, root)
        asked = batch.groupBy("id").agg(F.min("prompt").alias("prompt")).join(so_far, "id", "left")
        open_ = asked.where(~F.coalesce("accepted", F.lit(False)) & (F.coalesce("attempts", F.lit(0)) < most))
        log = models.replies(open_.select("id", "prompt"), model, 1).select("id", "reply")
        marked = log.join(check(log.where("reply IS NOT NULL")), "id", "left")
        return marked.join(open_.select("id", (F.coalesce("attempts", F.lit(0)) + 1).cast("int").alias("attempt")), "id").select("id", "reply", "violations", "attempt")

    return stream.writeStream.foreachBatch(lambda b, n: write(b, n, root, {"answers": answers})).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
