"""Evidence graph: claim tuples to typed nodes and merged edges, and summaries of both.

Nodes are (id, type, label, paper_ids); edges (source, target, relation, paper_ids, evidence, confidence, support_count).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.normalise import normalized_label, trailing_acronym
from lacuna.functions.text import stable_id
from lacuna.operators.extraction import junk_label
from lacuna.operators.similarity import components, similar_pairs

# The object's node type for every relation.
OBJECT_TYPE = {
    "evaluated_on": "Task",
    "improves_over": "Method",
    "fails_under": "FailureCondition",
    "assumes": "Assumption",
    "contradicts": "Claim",
    "uses_dataset": "Dataset",
    "measured_by": "Metric",
    "limited_by": "Limitation",
    "addresses": "Limitation",
    "not_addressed_by": "Limitation",
}


# The object's type where the relation leaves it open, by the kind of claim.
REFINED_TYPE = {"failure": "FailureCondition", "limitation": "Limitation", "assumption": "Assumption", "result": "Result"}
# Types whose near-equal labels are one entity, the longest label compared, words that do not tell labels apart.
ALIAS_TYPES, ALIAS_LENGTH = ("Method", "Dataset", "Metric", "Assumption"), 60
ALIAS_STOPS = (
    "the", "a", "an", "of", "for", "in", "on", "with", "and", "or", "by", "to", "algorithm", "method", "approach", "model", "technique", "framework",
    "system", "our", "their", "its", "this", "that", "we", "they",
)


def _typed_id(kind: Column, label: Column) -> Column:
    return F.concat(F.lower(kind), F.lit(":"), F.substring(stable_id("n", normalized_label(label)), 3, 16))


def _digits(node_id: Column) -> Column:
    """The 64 bits behind a typed id's kind; with the kind they are shuffled in its place."""
    return F.conv(F.right(node_id, F.lit(16)), 16, -10).cast("long")


def _kind(node_id: Column) -> Column:
    return F.substring(node_id, F.lit(1), F.length(node_id) - 17)


def _joined(kind: Column, digits: Column) -> Column:
    return F.concat(F.lower(kind), F.lit(":"), F.lower(F.lpad(F.hex(digits), 16, "0")))


def typed(tuples: DataFrame) -> DataFrame:
    """Adds the node types of subject and object.

    A relation fixes its object's type; where it leaves a claim (``contradicts`` and unknown relations), the tuple's ``claim_type`` refines it.
    """
    table = F.create_map(*[F.lit(x) for kv in OBJECT_TYPE.items() for x in kv])
    refined = F.create_map(*[F.lit(x) for kv in REFINED_TYPE.items() for x in kv])
    kind = F.coalesce(F.try_element_at(table, F.col("relation")), F.lit("Claim"))
    claim = F.col("claim_type") if "claim_type" in tuples.columns else F.lit(None).cast("string")
    return tuples.where("subject IS NOT NULL AND object IS NOT NULL").withColumns({
        "object_type": F.when(kind == "Claim", F.coalesce(F.try_element_at(refined, claim), kind)).otherwise(kind),
        "subject_type": F.when(F.col("relation") == "contradicts", F.lit("Claim")).otherwise(F.lit("Method")),
    })


def resolved(tuples: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Adds node types and ids of subject and object; with ``aliases`` (type, label, canonical) labels are replaced first.

    Methods with a junk label are no nodes, and neither are their tuples edges.
    """
    rows = typed(tuples)
    if aliases is not None:
        for end in ("subject", "object"):
            rows = _replaced(rows, f"{end}_type", end, aliases)
    rows = rows.where(~((F.col("subject_type") == "Method") & junk_label("subject")))
    return rows.withColumns({
        "source": _typed_id(F.col("subject_type"), F.col("subject")),
        "target": _typed_id(F.col("object_type"), F.col("object")),
    })


def _replaced(rows: DataFrame, kind: str, label: str, aliases: DataFrame) -> DataFrame:
    names = aliases.select(F.col("type").alias(kind), F.col("label").alias(label), F.col("canonical").alias("_canonical"))
    return rows.join(names, [kind, label], "left").withColumn(label, F.coalesce("_canonical", label)).drop("_canonical")


def resolved_mentions(mentions: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Listed entities (paper_id, type, label) without blank and junk ones, by their canonical labels."""
    rows = mentions.where("label IS NOT NULL AND label <> '' AND label <> 'insufficient evidence'")
    rows = rows if aliases is None else _replaced(rows, "type", "label", aliases)
    return rows.where(~((F.col("type") == "Method") & junk_label("label"))).select("paper_id", "type", "label").distinct()


def label_counts(tuples: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """(type, label, n): how often every label of a type that has aliases is used."""
    rows = typed(tuples)
    uses = rows.select(F.explode(F.array(
        F.struct(F.col("subject_type").alias("type"), F.col("subject").alias("label")), F.struct(F.col("object_type").alias("type"), F.col("object").alias("label")),
    )).alias("u")).select("u.*")
    if mentions is not None:
        uses = uses.unionByName(mentions.where("label <> '' AND label <> 'insufficient evidence'").select("type", "label"))
    return uses.where(F.col("type").isin(*ALIAS_TYPES)).groupBy("type", "label").agg(F.count(F.lit(1)).alias("n"))


def alias_map(counts: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(type, label, canonical) of labels that stand for another: near-equal word sets, and acronyms of methods.

    Labels of one type link if the Jaccard similarity of their words reaches the threshold; a component's name is its most frequent label, then its
    longest, then its first.  Types never meet, as words carry their type.  A bare acronym of a method stands for the longest label that ends in it;
    word sets take precedence.
    """
    words = F.filter(F.regexp_extract_all(F.lower("label"), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: (F.length(w) >= 2) & ~w.isin(*ALIAS_STOPS))
    rows = counts.where(F.length("label") <= ALIAS_LENGTH).withColumns({
        "id": F.xxhash64("type", "label"), "tokens": F.transform(F.array_distinct(words), lambda w: F.concat_ws("|", F.col("type"), w)),
    })
    near = similar_pairs(rows.select("id", "tokens"), threshold).select("a", "b")
    linked = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    named = rows.join(components(linked, near), "id")
    best = named.groupBy("component").agg(F.min_by("label", F.struct(-F.col("n"), -F.length("label"), F.col("label"))).alias("canonical"))
    by_words = named.join(best, "component").where("label <> canonical").select("type", "label", "canonical")
    methods = counts.where("type = 'Method'").select("label")
    by_acronym = alias_by_acronym(methods).select(F.lit("Method").alias("type"), "label", "canonical")
    return by_words.unionByName(by_acronym.join(by_words.select("type", "label"), ["type", "label"], "left_anti"))


def build(tuples: DataFrame, mentions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of claim tuples and listed entities, aliases resolved."""
    aliases = alias_map(label_counts(tuples, mentions))
    rows, listed = resolved(tuples, aliases), None if mentions is None else resolved_mentions(mentions, aliases)
    return nodes(rows, listed), edges(rows, listed)


def nodes(typed: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """One row per (type, label); ``mentions`` (paper_id, type, label) adds entities that papers list, and the papers themselves."""
    ends = typed.select(F.explode(F.array(
        F.struct(_digits(F.col("source")).alias("digits"), F.col("subject_type").alias("type"), F.col("subject").alias("label"), "paper_id"),
        F.struct(_digits(F.col("target")).alias("digits"), F.col("object_type").alias("type"), F.col("object").alias("label"), "paper_id"),
    )).alias("e")).select("e.*")
    if mentions is not None:
        ends = ends.unionByName(mentions.select(_digits(_typed_id(F.col("type"), F.col("label"))).alias("digits"), "type", "label", "paper_id"))
    out = ends.groupBy("digits", "type").agg(F.min("label").alias("label"), F.sort_array(F.collect_set("paper_id")).alias("paper_ids"))
    out = out.select(_joined(F.col("type"), F.col("digits")).alias("id"), "type", "label", "paper_ids")
    if mentions is None:
        return out
    papers = mentions.select("paper_id").distinct()
    return out.unionByName(papers.select(_paper(F.col("paper_id")).alias("id"), F.lit("Paper").alias("type"), F.col("paper_id").alias("label"), _alone("paper_id").alias("paper_ids")))


def _paper(paper_id: Column) -> Column:
    return F.concat(F.lit("paper:"), paper_id)


def _alone(x: str) -> Column:
    return F.array_compact(F.array(x))


def edges(typed: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """Tuples with one key (source, relation, target, paper, evidence) are one edge, the last by ``seq``; parallel edges are merged.

    Both steps happen where one shuffle by source, target and relation has brought the rows.  A paper mentions an entity once, so these edges need no more than their ends.
    """
    ends = ["source_kind", "source_digits", "target_kind", "target_digits", "relation"]
    parts = [f(F.col(x)).alias(f"{x}_{n}") for x in ("source", "target") for n, f in (("kind", _kind), ("digits", _digits))]
    rows = typed.select(*parts, "relation", "paper_id", "evidence", "confidence", "seq").repartition(*ends)
    last = rows.groupBy(*ends, "paper_id", "evidence").agg(F.max_by("confidence", "seq").alias("confidence"))
    merged = last.groupBy(*ends).agg(
        F.sort_array(F.collect_set("paper_id")).alias("paper_ids"),
        F.array_join(F.sort_array(F.collect_set("evidence")), " ").alias("evidence"),
        F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("support_count"),
    )
    own = ["relation", "paper_ids", "evidence", "confidence", "support_count"]
    out = merged.select(*[_joined(F.col(f"{x}_kind"), F.col(f"{x}_digits")).alias(x) for x in ("source", "target")], *own)
    if mentions is None:
        return out
    listed = mentions.select("paper_id", "type", _digits(_typed_id(F.col("type"), F.col("label"))).alias("digits")).distinct()
    return out.unionByName(listed.select(
        _paper(F.col("paper_id")).alias("source"), _joined(F.col("type"), F.col("digits")).alias("target"), F.lit("mentions").alias("relation"), _alone("paper_id").alias("paper_ids"),
        F.lit("").alias("evidence"), F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("support_count"),
    ))


def type_summary(rows: DataFrame, column: str) -> DataFrame:
    """Counts by type, most frequent first."""
    return rows.groupBy(F.col(column).alias("type")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def degree_top(graph_edges: DataFrame, k: int) -> DataFrame:
    ends = graph_edges.select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "id").limit(k)


def induced(graph_edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends in ``kept`` (id)."""
    ids = kept.select("id").distinct()
    return graph_edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi"
    )


def field_norms(graph_nodes: DataFrame, total_papers: Column | int, threshold: float = 0.5) -> DataFrame:
    """Assumptions that a large share of all papers hold."""
    share = F.round(F.size("paper_ids") / (F.lit(total_papers) if isinstance(total_papers, int) else total_papers), 3)
    return graph_nodes.where("type = 'Assumption'").select(
        "id", "label", share.alias("field_norm_fraction"), (share >= threshold).alias("field_norm")
    )


def alias_by_acronym(labels: DataFrame) -> DataFrame:
    """(label, canonical): "ACR" to the longest "Full Name (ACR)", the first of equals; labels without a full form are absent."""
    found = labels.select("label", trailing_acronym("label").alias("acronym")).where("acronym IS NOT NULL")
    best = found.groupBy("acronym").agg(F.min_by("label", F.struct(-F.length("label"), F.col("label"))).alias("canonical"))
    return labels.select("label").distinct().join(best, F.col("label") == F.col("acronym")).select("label", "canonical")


def supports_gap(hits: DataFrame) -> DataFrame:
    """Gap nodes' edges from the nodes that their motif traced."""
    return hits.select(
        F.explode("node_ids").alias("source"), stable_id("gap", "motif_id").alias("target"), F.lit("supports_gap").alias("relation")
    )


def top_per(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of each group; Spark prunes with a group limit before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
