"""Nodes and edges as a state that takes deltas: only the buckets a delta touches are read, merged and written anew.

A node has its papers in the order in which they first named it and every piece of evidence in order; type and label are the first ones.  Its state is rows of
facts, each once, and they meet only when the nodes are read.  An edge's key is its
ends, relation, paper and evidence; the last row of a key holds.  Order is ``seq``'s, so deltas may come late or twice: base and deltas give what a
rebuild from all rows gives.  Buckets follow the key's hash; a bucket's versions stand beside one another, and a ledger row, written last, makes one current.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "id string, paper_id string, evidence string, seq string, type string, label string"
EDGE = "source string, target string, relation string, paper_id string, evidence string, confidence double, seq string"
#: What tells buckets apart, and the shares of a bucket.
KEYS = {"nodes": ("id",), "edges": ("source", "target", "relation", "paper_id", "evidence")}
SHARE_KEYS = {"nodes": ("id", "paper_id", "evidence", "seq"), "edges": KEYS["edges"]}
#: Files of a bucket's version at most, each merged by a task of its own.
SHARES = 8


def node_rows(rows: DataFrame) -> DataFrame:
    """Facts of (id, type, label, paper_id, evidence, seq), texts all."""
    return rows.select("id", "paper_id", "evidence", F.col("seq").cast("string").alias("seq"), "type", "label")


def merged_nodes(facts: DataFrame, *by: str) -> DataFrame:
    """Each fact once; of its types and labels the first ones."""
    first = F.min(F.struct("type", "label"))
    return facts.groupBy(*by, *SHARE_KEYS["nodes"]).agg(first.alias("first")).select(*by, *SHARE_KEYS["nodes"], "first.type", "first.label")


def node_states(facts: DataFrame) -> DataFrame:
    """(id, type, label, paper_ids, evidence) of merged facts: papers in the order of their first naming, evidence in order.

    Only a node's own record is gathered: facts and papers are distinct rows before, so nothing is compared within an array.
    """
    papers = facts.groupBy("id", "paper_id").agg(F.min(F.struct("seq", "type", "label")).alias("first"))
    named = papers.groupBy("id").agg(
        F.min("first").alias("f"), F.transform(F.sort_array(F.collect_list(F.struct("first.seq", "paper_id"))), lambda p: p["paper_id"]).alias("paper_ids"),
    )
    said = facts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "paper_id", F.col("evidence").alias("text")))).alias("e"))
    evidence = F.transform("e", lambda e: F.struct(e["paper_id"].alias("paper_id"), e["text"].alias("text")))
    return named.join(said, F.equal_null(named["id"], said["id"])).select(named["id"], "f.type", "f.label", "paper_ids", evidence.alias("evidence"))


def merged_edges(rows: DataFrame, *by: str) -> DataFrame:
    """The last row of every key."""
    return rows.groupBy(*by, *KEYS["edges"]).agg(F.max_by("confidence", "seq").alias("confidence"), F.max("seq").alias("seq"))


@dataclass
class State:
    """Tables ``nodes`` and ``edges`` under ``root``, in buckets."""

    spark: SparkSession
    root: str
    buckets: int = 64

    def _current(self, kind: str) -> dict[int, int]:
        """The current version of every written bucket: ``buckets`` entries at most."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}-ledger")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return {}
        rows = self.spark.read.schema("bucket int, version int").parquet(f"{self.root}/{kind}-ledger").groupBy("bucket").agg(F.max("version").alias("v")).collect()
        return {r.bucket: r.v for r in rows}

    def _read(self, kind: str, which: dict[int, int]) -> DataFrame:
        schema = NODE if kind == "nodes" else EDGE
        paths = [f"{self.root}/{kind}/version={v}/bucket={b}" for b, v in sorted(which.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def nodes(self) -> DataFrame:
        """(id, type, label, paper_ids, evidence): papers and evidence in order."""
        return node_states(self._read("nodes", self._current("nodes")))

    def edges(self) -> DataFrame:
        return self._read("edges", self._current("edges"))

    def upsert_nodes(self, rows: DataFrame) -> int:
        """Takes rows (id, type, label, paper_id, evidence, seq); gives how many buckets were written."""
        return self._upsert("nodes", node_rows(rows), merged_nodes)

    def upsert_edges(self, rows: DataFrame) -> int:
        """Takes rows (source, target, relation, paper_id, evidence, confidence, seq); gives how many buckets were written."""
        own = rows.select("source", "target", "relation", "paper_id", "evidence", F.col("confidence").cast("double").alias("confidence"), F.col("seq").cast("string").alias("seq"))
        return self._upsert("edges", own, merged_edges)

    def _upsert(self, kind: str, delta: DataFrame, merge) -> int:
        from lacuna.scratch import kept, removed

        number = F.pmod(F.xxhash64(*KEYS[kind]), F.lit(self.buckets)).cast("int")
        new = kept(delta.withColumn("bucket", number), "delta")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # ``buckets`` at most
        if not touched:
            return 0
        now = self._current(kind)
        version = max(now.values(), default=-1) + 1
        base = self._read(kind, {b: v for b, v in now.items() if b in touched})
        share = F.pmod(F.xxhash64(F.lit(7), *SHARE_KEYS[kind]), F.lit(SHARES)).cast("int")
        dealt = base.withColumn("bucket", number).unionByName(new).withColumn("share", share).repartition("bucket", "share")  # the one shuffle of the merge
        merge(dealt, "bucket", "share").drop("share").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{kind}/version={version}")
        self.spark.createDataFrame([(b, version) for b in touched], "bucket int, version int").coalesce(1).write.mode("append").parquet(f"{self.root}/{kind}-ledger")
        removed(new)
        return len(touched)
