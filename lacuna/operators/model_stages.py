"""Stages that ask a language model: prompts from rows, one repair of a reply that does not fit, parsed rows and error rows; nothing is lost to a bad reply.

A model is any callable from prompt to text.  A reply fits if it holds a JSON object with the stage's needed fields; one that does not is sent back
once, with what was wrong.  Every asked row comes back: with its parsed reply, or with the reason why it has none.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.text import repaired_json
from lacuna.operators import extraction, lookup, models
from lacuna.scratch import kept


@dataclass(frozen=True)
class Stage:
    """What is asked, with {name} places for columns; the reply's schema; fields that it must have."""

    template: str
    schema: str
    needed: tuple[str, ...]


# Field names of replies.
EXTRACTION = Stage(
    "Read the paper and list its claims as JSON: {\"tuples\": [{\"subject\", \"relation\", \"object\", \"evidence_text\", \"claim_type\", \"polarity\", \"confidence\", \"subject_scope\", \"condition\"}]}. "
    "Use evidence_text word for word from the paper.\n\nPaper {paper_id}:\n{text}",
    "tuples array<struct<subject:string,relation:string,object:string,evidence_text:string,claim_type:string,polarity:string,confidence:double,subject_scope:string,condition:string>>",
    ("tuples",),
)
CONDITION = Stage(
    "A method fails under a condition that the claim leaves out. Give it as JSON {\"condition\"} from the evidence; an empty one if the evidence names none.\n\nClaim: {subject} {relation} {object}\nEvidence: {evidence_text}",
    "condition string", ("condition",),
)
RESOLUTION = Stage(
    "List what the paper resolves as JSON {\"resolutions\": [{\"target_problem\", \"resolution_type\", \"method\", \"scope\", \"evidence_text\", \"confidence\"}]}.\n\nPaper {paper_id}:\n{text}",
    "resolutions array<struct<target_problem:string,resolution_type:string,method:string,scope:string,evidence_text:string,confidence:double>>", ("resolutions",),
)
COUNTER = Stage(
    "Does the record address the gap? Answer as JSON {\"label\", \"scope_match\", \"confidence\", \"should_create_counterevidence_edge\", \"remaining_gap_scope\"}.\n\nGap: {label}\nRecord: {record}",
    "label string, scope_match string, confidence string, should_create_counterevidence_edge string, remaining_gap_scope string", ("label",),
)
DIRECT = Stage(
    "State the gap as one research problem, as JSON {\"title\", \"problem_statement\", \"recommendation\", \"coherence_score\", \"specificity_score\"}.\n\nGap: {gap}",
    "title string, problem_statement string, recommendation string, coherence_score double, specificity_score double", ("title", "problem_statement"),
)
REPAIR = "\n\nThe last reply could not be used ({}). Reply with the JSON object only."


def _read(log: DataFrame, stage: Stage) -> DataFrame:
    """Adds ``p``, the parsed reply, and ``problem``, why it cannot be used, to (id, reply, error)."""
    parsed = F.coalesce(F.from_json("reply", stage.schema), F.from_json(repaired_json("reply"), stage.schema))
    rows = log.withColumn("p", parsed)
    missing = F.array_compact(F.array(*[F.when(F.col(f"p.{c}").isNull(), F.lit(c)) for c in stage.needed]))
    problem = F.when(F.col("error").isNotNull(), F.col("error")).when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    return rows.withColumn("problem", problem)


def asked(rows: DataFrame, stage: Stage, model: models.Model, fields: dict[str, Column]) -> DataFrame:
    """(id, p, attempts, problem) for every row of (id, ...): the parsed reply, how often the model was asked, and null or the last problem."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = rows.select("id", *[c.alias(f"_{k}") for k, c in fields.items()]).repartition(tasks, "id")  # a small file of many short rows would be asked by one task
    prompts = kept(dealt.select("id", models.prompt(stage.template, {k: F.col(f"_{k}") for k in fields}).alias("prompt")), "prompts")
    first = kept(_read(models.replies(prompts, _text(model), 1), stage).select("id", "p", "problem"), "replies")
    bad = first.where("problem IS NOT NULL").select("id", "problem")
    head, tail = REPAIR.split("{}")
    again = prompts.join(bad, "id").select("id", F.concat("prompt", F.lit(head), "problem", F.lit(tail)).alias("prompt"))
    second = _read(models.replies(again, _text(model), 1), stage).select("id", "p", F.lit(2).alias("attempts"), "problem")
    return kept(first.where("problem IS NULL").select("id", "p", F.lit(1).alias("attempts"), "problem").unionByName(second), "answers")


def _text(model: models.Model) -> models.Model:
    """The model with replies that are not JSON passed on as JSON texts, so that reading them is the stage's task."""

    def call(prompt: str) -> str:
        reply = model(prompt)
        found = re.search(r"\{.*\}", reply or "", re.DOTALL)
        if not found:
            raise ValueError("no JSON object in the reply")
        return found.group(0)

    return call


def extracted(texts: DataFrame, model: models.Model) -> DataFrame:
    """(paper_id, t, problem): the claims of texts (paper_id, text), enumerations by their spellings; a paper without a usable reply is one row with its problem."""
    found = asked(texts.select(F.col("paper_id").alias("id"), "text"), EXTRACTION, model, {"paper_id": F.col("id"), "text": F.col("text")})
    each = found.where("problem IS NULL").select(F.col("id").alias("paper_id"), F.explode("p.tuples").alias("r")).select("paper_id", "r.*")
    good = extraction.coerced(each.fillna("", ["polarity", "condition"]))
    bad = found.where("problem IS NOT NULL").select(F.col("id").alias("paper_id"), "problem")
    return good.select("paper_id", F.struct("paper_id", *[c for c in good.columns if c != "paper_id"]).alias("t"), F.lit(None).cast("string").alias("problem")).unionByName(bad, allowMissingColumns=True)


def conditioned(tuples: DataFrame, model: models.Model) -> DataFrame:
    """Tuples (id, ...) with the condition that a model finds for own-method failures which lack one; others, and those without a usable reply, stay as they are."""
    c = F.col
    open_ = tuples.where(extraction.needs_condition())
    found = asked(open_, CONDITION, model, {k: c(k) for k in ("subject", "relation", "object", "evidence_text")})
    told = found.where("problem IS NULL").select("id", c("p.condition").alias("told"))
    return tuples.join(told, "id", "left").withColumn("condition", F.coalesce(F.nullif("told", F.lit("")), "condition")).drop("told")


def resolved(texts: DataFrame, model: models.Model) -> DataFrame:
    """(paper_id, r, problem): what texts (paper_id, text) resolve; a paper without a usable reply is one row with its problem."""
    found = asked(texts.select(F.col("paper_id").alias("id"), "text"), RESOLUTION, model, {"paper_id": F.col("id"), "text": F.col("text")})
    good = found.where("problem IS NULL").select(F.col("id").alias("paper_id"), F.explode("p.resolutions").alias("r"))
    return good.withColumn("problem", F.lit(None).cast("string")).unionByName(found.where("problem IS NOT NULL").select(F.col("id").alias("paper_id"), "problem"), allowMissingColumns=True)


def judged_pairs(pairs: DataFrame, model: models.Model) -> DataFrame:
    """Pairs (id, node_id, paper_id, label, record) with the classifier's verdict; without a usable reply the label is unclear and no edge follows."""
    found = asked(pairs, COUNTER, model, {"label": F.col("label"), "record": F.col("record")})
    reply = F.when(F.col("problem").isNull(), F.to_json("p")).otherwise("{}")
    return lookup.classified(pairs.drop("label").join(found.select("id", reply.alias("reply"), "attempts", "problem"), "id")).drop("reply")


def formulated(gaps: DataFrame, model: models.Model) -> DataFrame:
    """(gap_id, title, problem_statement, recommendation, coherence_score, specificity_score, error): one row a gap; a gap without a usable reply is dropped by its recommendation."""
    found = asked(gaps.select(F.col("gap_id").alias("id"), "gap"), DIRECT, model, {"gap": F.col("gap")})
    bad, c = F.col("problem").isNotNull(), F.col
    text = lambda k: F.when(bad, "").otherwise(F.coalesce(c(f"p.{k}"), F.lit("")))
    number = lambda k: F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c(f"p.{k}"), F.lit(0.0)))))
    return found.select(
        c("id").alias("gap_id"), text("title").alias("title"), text("problem_statement").alias("problem_statement"), F.when(bad, "DROP").otherwise(F.upper(F.coalesce("p.recommendation", F.lit("MAYBE")))).alias("recommendation"),
        number("coherence_score").alias("coherence_score"), number("specificity_score").alias("specificity_score"), c("problem").alias("error"),
    )


def by_pattern(prompt: str) -> str:
    """A stand-in for a model: claims from sentences of the form "the X is limited by Y." of the prompt's paper."""
    text = prompt.partition("\nPaper ")[2].partition(":\n")[2]
    found = re.finditer(r"(?:[Tt]he )?([\w-]+) is limited by ([^.\n]+)\.", text)
    return json.dumps({"tuples": [
        {"subject": m[1], "relation": "limited_by", "object": m[2], "evidence_text": m[0], "claim_type": "limitation", "polarity": "negative", "confidence": 0.7, "subject_scope": "own_method", "condition": ""} for m in found
    ]})
