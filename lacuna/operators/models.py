"""Model-backed operators: a pluggable function from prompts to JSON texts, run in batches, with call log and resume."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[str], str]


def mock(prompt: str) -> str:
    """A deterministic reply that follows from the prompt's digest."""
    h = hashlib.sha256(prompt.encode()).digest()
    return json.dumps({"label": ["novel", "known_open", "known_solved", "trivial"][h[0] % 4], "confidence": round(h[1] / 255, 3)})


def replies(prompts: DataFrame, model: Model = mock, attempts: int = 3) -> DataFrame:
    """(id, reply, attempts, error, prompt_sha256) of (id, prompt): the first reply that parses as JSON, else the last error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, prompt in zip(frame["id"], frame["prompt"], strict=True):
                reply = error = None
                for n in range(1, attempts + 1):
                    try:
                        reply = model(prompt or "")
                        json.loads(reply)
                        error = None
                        break
                    except Exception as e:  # a model's failure is a row, not the end of the job
                        reply, error = None, f"{type(e).__name__}: {e}"
                rows.append((i, reply, n, error, hashlib.sha256((prompt or "").encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["id", "reply", "attempts", "error", "prompt_sha256"])

    kind = dict(prompts.dtypes)["id"]
    return prompts.select("id", "prompt").mapInPandas(run, f"id {kind}, reply string, attempts int, error string, prompt_sha256 string")


def resumed(prompts: DataFrame, path: str, model: Model = mock) -> DataFrame:
    """Replies for prompts that the log at ``path`` has no reply for; the log is appended to and returned."""
    spark = prompts.sparkSession
    try:
        done = spark.read.parquet(path).where("error IS NULL").select("id").distinct()
        todo = prompts.join(done, "id", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = prompts
    replies(todo, model).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def verdicts(log: DataFrame) -> DataFrame:
    """(id, label, confidence) of the parsed replies; confidences are kept between 0 and 1."""
    parsed = F.from_json("reply", "label string, confidence double")
    rows = log.where("reply IS NOT NULL").select("id", parsed.alias("p"))
    return rows.select("id", F.coalesce("p.label", F.lit("novel")).alias("label"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("p.confidence", F.lit(0.5)))).alias("confidence"))


def backed_off(model: Model, waits: tuple[float, ...] = (1.0, 2.0, 4.0)) -> Model:
    """The model with waits between attempts that fail, the last failure raised."""
    import time

    def call(prompt: str) -> str:
        for n, wait in enumerate((*waits, None)):
            try:
                return model(prompt)
            except Exception:
                if wait is None or n == len(waits):
                    raise
                time.sleep(wait)
        raise AssertionError

    return call


def timed(model: Model, seconds: float) -> Model:
    """The model with a limit of wall-clock time: a call that takes longer raises TimeoutError and is left behind in its thread."""
    import queue
    import threading

    def call(prompt: str) -> str:
        out: queue.SimpleQueue = queue.SimpleQueue()

        def run() -> None:
            try:
                out.put((model(prompt), None))
            except Exception as e:
                out.put((None, e))

        threading.Thread(target=run, daemon=True).start()
        try:
            reply, error = out.get(timeout=seconds)
        except queue.Empty:
            raise TimeoutError(f"no reply within {seconds} s") from None
        if error is not None:
            raise error
        return reply

    return call


def two_pass(model: Model, ask: str = "Give the final JSON object only.") -> Model:
    """A reply without any JSON object (reasoning only) is sent back once with the request for the object."""

    def call(prompt: str) -> str:
        first = model(prompt)
        return first if "{" in first else model(f"{prompt}\n\n{first}\n\n{ask}")

    return call


def batched_prompts(rows: DataFrame, key: str, line: Column, size: int, head: str, parts: int = 64) -> DataFrame:
    """(id, prompt, members) of batches of ``size`` rows, numbered from 1; rows are dealt by hash and batched within the part, so nothing is ordered globally."""
    from pyspark.sql import Window

    part = F.pmod(F.xxhash64(key), F.lit(parts))
    placed = rows.withColumn("part", part).withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1)
    placed = placed.withColumns({"batch": F.floor(F.col("at") / size), "no": F.col("at") % size + 1, "line": line})
    by = placed.groupBy("part", "batch").agg(F.array_sort(F.collect_list(F.struct("no", F.col(key).alias("key"), "line"))).alias("m"))
    text = F.concat(F.lit(head + "\n\n"), F.array_join(F.transform("m", lambda x: F.concat(F.lit("["), x["no"].cast("string"), F.lit("] "), x["line"])), "\n"))
    return by.select(F.concat_ws("-", "part", "batch").alias("id"), text.alias("prompt"), F.transform("m", lambda x: x["key"]).alias("members"))


NOVELTY = ("trivial", "known_open", "known_solved", "novel")


def novelty_classes(batches: DataFrame, log: DataFrame) -> DataFrame:
    """(key, class) of batches' members: classes by their place in the reply; what is missing, unknown or failed is novel, so nothing is lost to a bad reply."""
    parsed = F.from_json("reply", "classifications array<struct<gap_index:int,class:string>>")
    both = batches.join(log.select("id", parsed.alias("p")), "id", "left").select(F.posexplode("members").alias("at", "key"), F.col("p.classifications").alias("c"))
    found = F.get(F.filter("c", lambda x: x["gap_index"] == F.col("at") + 1), F.lit(0))["class"]
    return both.select("key", F.when(F.lower(found).isin(*NOVELTY), F.lower(found)).otherwise("novel").alias("class"))


def relevant_members(batches: DataFrame, log: DataFrame) -> DataFrame:
    """(key) of the members whose 1-based places a reply lists; a batch without a readable reply keeps all."""
    places = F.from_json(F.regexp_extract("reply", r"(\[[^\]]*\])", 1), "array<int>")
    both = batches.join(log.select("id", places.alias("p")), "id", "left").select(F.posexplode("members").alias("at", "key"), "p")
    return both.where(F.col("p").isNull() | F.array_contains("p", F.col("at") + 1)).select("key")


def agent_rows(log: DataFrame) -> DataFrame:
    """One row per prompt, failed ones as rows that say so, so that the gate sees them."""
    parsed = F.from_json("reply", "summary string, confidence string, label string")
    rows = log.select("id", parsed.alias("p"), "reply", "attempts")
    failed = F.col("reply").isNull() | F.col("p.summary").isNull()
    return rows.select(
        "id", F.when(failed, "failed after retries").otherwise(F.col("p.summary")).alias("summary"), F.when(failed, "0.0").otherwise(F.col("p.confidence")).alias("confidence"),
        F.when(failed, F.array(F.lit("parse_failure"))).otherwise(F.array().cast("array<string>")).alias("failure_modes"), F.col("p.label").alias("quality_label"),
    )


def scored(prompts: DataFrame, model: Model, check, attempts: int = 2) -> DataFrame:
    """A scoring loop: replies whose violations are not empty are asked again with them; the last attempt's reply stays, with its violations.

    ``check`` maps a log (id, reply) to (id, violations array); unreadable replies have null violations and are left as errors.
    """
    from lacuna.scratch import kept

    open_, done = prompts.select("id", "prompt"), None
    for n in range(1, attempts + 1):
        log = kept(replies(open_, model, 1), "scored")
        marked = kept(log.join(check(log.where("reply IS NOT NULL")), "id", "left").withColumn("attempt", F.lit(n)), "marked")
        last = n == attempts
        final = marked if last else marked.where(F.size("violations") == 0)
        done = final if done is None else done.unionByName(final)
        if not last:
            again = marked.where(F.col("violations").isNull() | (F.size("violations") > 0))
            told = F.concat("prompt", F.lit("\n\nThe last reply was not accepted: "), F.coalesce(F.array_join("violations", ", "), F.lit("no JSON object")))
            open_ = open_.join(again.select("id", "violations"), "id").select("id", told.alias("prompt"))
    return done


def prompt(template: str, fields: dict[str, Column]) -> Column:
    """A prompt from a template with {name} places and columns for them; whatever else stands in braces stays."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(fields[p].cast("string"), F.lit("")) if p in fields else F.lit("{" + p + "}") for i, p in enumerate(parts)])
