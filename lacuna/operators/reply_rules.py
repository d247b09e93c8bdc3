"""Rules over whole judge replies (JSON texts): what must not be in them, special winners, justifications, and batches with each reply's own rules.

They stand beside the rules on parsed fields in ``rubrics``; each gives an array of violations, empty for an accepted reply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators import rubrics

# Keys that a mode's replies must not have, special winners, criteria whose scores need a justification, always or where the rubric has them.
REFUSED = {
    "preference": ("scores", "candidate_a_scores", "candidate_b_scores"), "ranking": ("scores", "pairwise_preference"), "independent": ("pairwise_preference",),
}
COMPOSITE = "weighted_composite"
SPECIAL = ("best_overall_candidate", "most_auditable_candidate", "most_actionable_candidate", "most_novel_potential_candidate")
JUSTIFIED = ("evidence_grounding", "formalizability", "overall_worth_reading")
JUSTIFIED_IF_SCORED = ("actionability", "pursuit_priority", "auditability_overall")


def _keys(x: Column) -> Column:
    return F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))


def _text(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit("")))


def refused(mode: str, reply: Column | str = "reply") -> Column:
    """Keys that the mode's replies must not have, and a composite score anywhere in them; a batch refuses a preference anywhere, too."""
    x = F.col(reply) if isinstance(reply, str) else reply
    keys = F.transform(F.array_intersect(F.array(*[F.lit(k) for k in REFUSED.get(mode, ())]), _keys(x)) if mode in REFUSED else F.array().cast("array<string>"), lambda k: F.concat(F.lit("refused:"), k))
    anywhere = [F.when(F.contains(F.lower(x), F.lit(COMPOSITE)), F.lit("refused:composite"))]
    if mode == "batch":
        anywhere.append(F.when(F.contains(x, F.lit("pairwise_preference")), F.lit("refused:pairwise_preference")))
    return F.concat(keys, F.array_compact(F.array(*anywhere)))


def special_winners(candidates: Column, reply: Column | str = "reply", labels: tuple[str, ...] = rubrics.HIDDEN) -> Column:
    """A four-way reply beside its rankings: it lists its packet's candidates, names each special winner among them with a reason, has a confidence and no method label."""
    x = F.col(reply) if isinstance(reply, str) else reply
    listed = F.from_json(F.get_json_object(x, "$.candidate_ids"), "array<string>")
    known = F.transform(candidates, lambda c: c.cast("string"))
    same = (F.size(F.array_except(known, listed)) == 0) & (F.size(F.array_except(listed, known)) == 0)
    rules = [(~F.coalesce(same, F.lit(False)), "candidate_ids")]
    reasons = []
    for k in SPECIAL:
        at = F.from_json(F.get_json_object(x, f"$.{k}"), "candidate_id string, reason string")
        rules += [(at.isNull(), f"no_object:{k}"), (at.isNotNull() & ~F.coalesce(F.array_contains(known, at["candidate_id"]), F.lit(False)), f"unknown:{k}"), (at.isNotNull() & (_text(at["reason"]) == ""), f"no_reason:{k}")]
        reasons.append(_text(at["reason"]))
    said = F.concat_ws("\n", _text(F.get_json_object(x, "$.domain_level_notes")), *reasons)
    confidence = F.get_json_object(x, "$.confidence")
    rules += [(~F.coalesce(confidence.isin(*rubrics.CONFIDENCES), F.lit(False)), "invalid_confidence"), (F.size(rubrics.method_labels(said, labels)) > 0, "method_label")]
    return rubrics._rules(*rules)


def justifications(criteria: tuple[str, ...], reply: Column | str = "reply") -> Column:
    """Criteria whose score needs a justification and has none."""
    x = F.col(reply) if isinstance(reply, str) else reply
    given = F.from_json(F.get_json_object(x, "$.score_justification"), "map<string,string>")
    needed = (*JUSTIFIED, *(k for k in JUSTIFIED_IF_SCORED if k in criteria))
    return F.when(given.isNull(), F.array(F.lit("no_justifications"))).otherwise(rubrics._rules(*[(_text(F.try_element_at(given, F.lit(k))) == "", f"no_justification:{k}") for k in needed]))


def preference_reply(pair_id: Column, labels: tuple[str, ...] = rubrics.HIDDEN) -> Column:
    """All rules of a preference reply with its parsed fields and its text (column ``reply``)."""
    return F.concat(refused("preference"), rubrics.preference_violations(pair_id, labels))


def independent_reply(criteria: tuple[str, ...], low: int = 1, high: int = 5) -> Column:
    """All rules of an independent reply (columns scores, confidence, strengths, weaknesses, rationale and ``reply``)."""
    rest = rubrics._rules(
        (~F.coalesce(F.col("confidence").isin(*rubrics.CONFIDENCES), F.lit(False)), "invalid_confidence"), (~rubrics._filled("strengths"), "no_strengths"), (~rubrics._filled("weaknesses"), "no_weaknesses"),
        (_text(F.col("rationale")) == "", "no_rationale"),
    )
    return F.concat(refused("independent"), rubrics.score_keys(criteria, low, high), rest, justifications(criteria))


def batch_replies(rows: DataFrame, expected: DataFrame, heads: DataFrame, own: Column) -> DataFrame:
    """(batch, violations): the batch's rules, what its text must not hold, its stated size, and every reply's own rules with its candidate.

    ``heads`` is (batch, reply, batch_size); ``own`` is an array of a row's violations, such as :func:`independent_reply` and the hard caps together.
    """
    whole = rubrics.batch_violations(rows, expected)
    sizes = expected.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    head = heads.join(sizes, "batch", "left").select("batch", F.concat(refused("batch"), rubrics._rules((F.col("batch_size").isNotNull() & ~F.col("batch_size").eqNullSafe(F.col("n")), "batch_size"))).alias("head"))
    each = rows.select("batch", F.explode(F.transform(own, lambda v: F.concat_ws(":", F.col("candidate_id").cast("string"), v))).alias("v")).groupBy("batch").agg(F.array_sort(F.collect_list("v")).alias("each"))
    none = F.array().cast("array<string>")
    every = whole.join(head, "batch", "left").join(each, "batch", "left")
    return every.select("batch", F.concat("violations", F.coalesce("head", none), F.coalesce("each", none)).alias("violations"))
