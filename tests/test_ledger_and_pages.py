"""Replayed batches, scoring state over restarts, and paged sources with filters that reach the service."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lacuna.sources import paged
from lacuna.streaming import ledger


def test_split_survives_a_crash(spark, tmp_path, monkeypatch):
    """The query dies after a batch's first part; started again it writes the batch anew, and no row stands twice."""
    source, root, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    spark.range(100).select("id", (F.col("id") % 3).alias("k")).write.parquet(source)
    stream = spark.readStream.schema("id long, k long").option("maxFilesPerTrigger", 1).parquet(source)
    plain, calls = ledger.write, []

    def dying(batch, number, root, parts, run=None):
        if not calls:
            calls.append(number)
            first = dict(list(parts.items())[:1])
            for name, of in first.items():
                of(batch).write.mode("overwrite").parquet(f"{root}/{name}/run={ledger._run_id(batch.sparkSession)}/batch={number}")
            raise RuntimeError("lost")
        plain(batch, number, root, parts, run)

    monkeypatch.setattr(ledger, "write", dying)
    with pytest.raises(Exception, match="lost"):
        ledger.split(stream, root, "k > 0", checkpoint).awaitTermination(60)
    assert ledger.committed(spark, root, "done", "id long, k long").count() == 0  # half a batch is not seen
    ledger.split(stream, root, "k > 0", checkpoint).awaitTermination(60)
    done, failed = (ledger.committed(spark, root, p, "id long, k long") for p in ("done", "failed"))
    assert sorted(r.id for r in done.collect()) == [i for i in range(100) if i % 3] and failed.count() == 34
    ledger.write(spark.range(5).withColumn("k", F.lit(1)), 0, root, {"done": lambda b: b}, ledger.entered(spark, root).where("batch = 0").first().run)  # a replay of a complete batch
    assert done.count() == 66 and ledger.entered(spark, root).where("part = 'done'").agg(F.sum("n")).first()[0] == 66


def test_scoring_state(spark, tmp_path):
    """Three starts on one checkpoint: accepted ids are not asked again, others twice at most."""
    source, root, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    source.mkdir()
    stream = spark.readStream.schema("id string, prompt string").json(str(source))

    def check(log):
        return log.select("id", F.when(F.get_json_object("reply", "$.ok") == "true", F.array().cast("array<string>")).otherwise(F.array(F.lit("bad"))).alias("violations"))

    def model(prompt):
        if prompt == "broken":
            raise ValueError("no reply")
        return json.dumps({"ok": prompt == "good"})

    for n in range(3):
        (source / f"{n}.json").write_text("".join(json.dumps({"id": i, "prompt": p}) + "\n" for i, p in (("a", "good"), ("b", "poor"), ("c", "broken"), (f"new{n}", "good"))))
        ledger.scored(stream, root, model, check, checkpoint).awaitTermination(60)
    got = {r.id: (r.attempts, r.accepted) for r in ledger.attempts(spark, root).collect()}
    assert got == {"a": (1, True), "b": (2, False), "c": (2, False), "new0": (1, True), "new1": (1, True), "new2": (1, True)}
    assert ledger.committed(spark, root, "answers", ledger.ANSWERS).count() == 8


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    rows = spark.range(60).select((F.when(F.col("id") % 3 == 0, "A").otherwise("B")).alias("venue"), F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), "id").alias("title"), (2000 + F.col("id") % 10).cast("int").alias("year"), F.col("id").alias("place"))
    return paged.Served.write(rows, str(tmp_path_factory.mktemp("pages") / "p"), 10)


def test_filters_reach_the_service(spark, served):
    every = paged.listed(spark, served, ["A", "B"], 10)
    assert every.count() == 60 and every.rdd.getNumPartitions() == 12
    some = every.where("venue = 'A' AND page >= 2 AND page < 5 AND year >= 2005 AND title <> 't27'")
    assert some.rdd.getNumPartitions() == 3  # pages of others are not asked for
    assert {int(r.id) for r in some.collect()} == {i for i in range(20, 50) if i % 3 == 0 and i % 10 >= 5 and i != 27}
    assert every.where("venue = 'none'").count() == 0
    reader = paged.Reader(served, ["A", "B"], 10, None, ())
    assert [type(f).__name__ for f in reader.pushFilters([paged.EqualTo(("venue",), "A"), paged.GreaterThan(("year",), 2004), paged.EqualTo(("title",), "x")])] == ["EqualTo"]
    assert reader.year == 2005 and {p.venue for p in reader.partitions()} == {"A"}


def test_caps_errors_and_over_fetch(spark, served):
    assert paged.venue_cap(100, 8) == 12 and paged.venue_cap(10, 8) == 5
    capped = paged.listed(spark, served, ["A", "B"], 10, 12)
    assert {(r.venue, r.page) for r in capped.select("venue", "page").distinct().collect()} == {("A", 0), ("A", 1), ("B", 0), ("B", 1)}
    few = paged.over_fetched(paged.listed(spark, served, ["A", "B"], 10), spark.createDataFrame([(str(i),) for i in range(0, 60, 2)], "id string"), 4)
    assert {(r.venue, int(r.id)) for r in few.collect()} == {("A", i) for i in (0, 6, 12, 18)} | {("B", i) for i in (2, 4, 8, 10)}

    class Failing(paged.Served):
        def page(self, venue, number, least_year):
            if number == 3:
                raise TimeoutError("slow")
            return super().page(venue, number, least_year)

    rows = paged.listed(spark, Failing(served.root, served.counts), ["A", "B"], 10, None, (0.01,)).collect()
    assert [(r.venue, r.error) for r in sorted(rows) if r.error] == [("A", "TimeoutError: slow"), ("B", "TimeoutError: slow")] and sum(r.error is None for r in rows) == 50


def test_stream_takes_pages_once(spark, served, tmp_path):
    spark.dataSource.register(paged.source(served, ["A", "B"], 10))
    stream = spark.readStream.format("paged_listing").load().select("venue", "id")
    for _ in range(2):
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(int(r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(60))
