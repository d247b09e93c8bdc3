"""Evolution of hypotheses: operators as projections, lineage, duplicates, fitness with diversity, generations.

Random choices follow a hash of (generation, id), so runs repeat whatever the partitioning.  A population is bounded by its setting (tens to some hundred
candidates), which bounds what the driver's loop holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.text import bounded, stable_id
from lacuna.operators.selection import diverse_finals  # noqa: F401
from lacuna.scratch import kept, ranked

# What each mutation adds to which score.
MUTATIONS = {
    "narrow_scope": ("feasibility", 0.08), "broaden_scope": ("impact", 0.08), "change_target_domain": ("novelty", 0.05), "add_mechanism": ("feasibility", 0.04),
    "strengthen_evidence_requirement": ("novelty", 0.03), "merge_compatible_gaps": (None, 0.0), "scope_narrowing": ("feasibility", 0.07), "scope_broadening": ("impact", 0.07),
    "mechanism_substitution": ("novelty", 0.04), "failure_condition_swap": ("feasibility", 0.03), "evaluation_protocol_generation": ("specificity", 0.08),
    "contradiction_to_benchmark": ("impact", 0.05), "limitation_to_method": ("novelty", 0.04),
}
CROSSOVERS = ("combine_mechanism_and_gap", "merge_evidence_sets", "combine_target_scope")
# What mutations write into the candidate's texts; {} is the parent's text.
TEXTS: dict[str, dict[str, str]] = {
    "scope": {
        "narrow_scope": "{}; narrowed to the most traceable setting", "broaden_scope": "{}; broadened to adjacent tasks or datasets",
        "scope_narrowing": "{}; narrowed to the most evidence-dense setting", "scope_broadening": "{}; broadened to include adjacent tasks",
    },
    "target": {"change_target_domain": "adjacent domain for {}", "failure_condition_swap": "robustness under: {}"},
    "mechanism": {"mechanism_substitution": "Alternative mechanism: {}"},
    "problem_statement": {
        "strengthen_evidence_requirement": "{} Require replication across at least two independent papers or benchmarks.",
        "merge_compatible_gaps": "{} Merge with compatible recurring limitations when supported by traceable evidence.",
        "evaluation_protocol_generation": "{} Propose a systematic evaluation protocol across at least three diverse settings.",
        "contradiction_to_benchmark": "{} Design a benchmark to directly measure this contradiction.",
        "limitation_to_method": "{} Propose a method that directly addresses this limitation.",
    },
}
NO_MECHANISM = "Potential mechanism: mismatch between training/evaluation assumptions and deployment perturbations."
SCORES = ("novelty", "feasibility", "impact", "specificity")
CONTENT_STOPS = (
    "about", "above", "after", "again", "against", "being", "between", "could", "doing", "during", "every", "from", "further", "have", "having", "here", "itself", "might", "more",
    "most", "other", "over", "same", "should", "some", "such", "than", "that", "their", "them", "then", "there", "these", "they", "this", "those", "through", "under", "until", "very",
    "was", "were", "what", "when", "where", "which", "while", "will", "with", "would", "your", "problem", "designing", "achieves", "despite", "using", "based", "toward", "without",
    "across", "within", "proposed", "novel", "approach", "method", "algorithm", "framework", "system", "model", "existing", "current",
)
#: Thresholds of a duplicate: statements; gaps and mechanisms of one gap; content words of one gap.
SAME_STATEMENT, SAME_TEXTS, SAME_CONTENT = 0.45, 0.90, 0.60


def draw(generation: int, *by: Column | str) -> Column:
    """A number in [0, 1) that depends on the generation and the columns only."""
    return F.pmod(F.xxhash64(F.lit(generation), *by), F.lit(1 << 20)) / float(1 << 20)


def drawn_mutation(generation: int) -> Column:
    return F.get(F.array(*[F.lit(n) for n in MUTATIONS]), (draw(generation, "id") * len(MUTATIONS)).cast("int"))


def mutated(rows: DataFrame, generation: int, operator: Column | None = None) -> DataFrame:
    """One child of every row by its operator (drawn if none is given): moved scores, and texts where the rows have them."""
    out = rows.withColumn("operator", drawn_mutation(generation) if operator is None else operator)
    for s in SCORES:
        delta = F.lit(0.0)
        for n, (target, d) in MUTATIONS.items():
            if target == s:
                delta = F.when(F.col("operator") == n, d).otherwise(delta)
        out = out.withColumn(s, bounded(F.col(s) + delta))
    for name, forms in TEXTS.items():
        if name in rows.columns:
            text = F.col(name)
            for n, form in forms.items():
                head, tail = form.split("{}")
                text = F.when(F.col("operator") == n, F.concat(F.lit(head), F.col(name), F.lit(tail))).otherwise(text)
            if name == "mechanism":
                text = F.when((F.col("operator") == "add_mechanism") & (F.col(name) == "insufficient evidence"), NO_MECHANISM).otherwise(text)
            out = out.withColumn(name, text)
    return out.withColumns({"parents": F.array("id"), "generation": F.lit(generation)})


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``place``, from 0, in a total order; no task holds more than a range of it."""
    return ranked(rows, order, "place").withColumn("place", F.col("place") - 1)


def tournaments(rows: DataFrame, slots: int, size: int, generation: int) -> DataFrame:
    """(slot, ...): winners of tournaments, each among ``size`` different drawn rows of (id, fitness, ...): the fittest, of equals the least id.

    A tournament draws places in the order of ids; rows meet their places in a join, so the population is never gathered.
    """
    n = rows.count()
    size = min(size, n)
    drawn = lambda j: F.pmod(F.xxhash64(F.lit(generation), F.col("slot"), j), F.lit(1 << 40)) / float(1 << 40)
    # the j-th of different places: a number below n - j, moved past those that are taken, in their order
    other = lambda taken, j: F.aggregate(taken, F.floor(drawn(j) * (F.lit(n) - j)).cast("long"), lambda x, t: x + (x >= t).cast("long"))
    places = F.aggregate(F.sequence(F.lit(0), F.lit(max(size - 1, 0))), F.array().cast("array<long>"), lambda taken, j: F.array_sort(F.array_append(taken, other(taken, j))))
    entered = rows.sparkSession.range(slots if n else 0).select(F.col("id").alias("slot")).select("slot", F.explode(places).alias("place"))
    met = entered.join(placed(rows, [F.asc("id")]), "place")
    first = met.groupBy("slot").agg(F.max_by(F.struct(*rows.columns), F.struct("fitness", (-F.col("place")).alias("first"))).alias("r"))
    return first.select("slot", "r.*")


def partners(rows: DataFrame, generation: int) -> DataFrame:
    """(a, b): for every row (id, motif_type, gap_id) a drawn partner of another motif, else of another gap; rows that have neither get none.

    Rows are placed by motif, gap and draw, and each takes the row as many places on as the largest motif has rows: then no two of a motif meet
    unless it holds more than half of all, and as few as can be if it does.
    """
    at = kept(placed(rows.select("id", "motif_type", "gap_id"), [F.asc("motif_type"), F.asc("gap_id"), draw(generation, "id"), F.asc("id")]), "partners")
    n = at.count()
    far = at.groupBy("motif_type").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    b = at.select(F.pmod(F.col("place") - far, F.lit(max(n, 1))).alias("place"), F.col("id").alias("b"), F.col("motif_type").alias("bm"), F.col("gap_id").alias("bg"))
    different = (F.col("motif_type") != F.col("bm")) | (F.col("gap_id") != F.col("bg"))
    return at.join(b, "place").where(different & (F.col("id") != F.col("b"))).select(F.col("id").alias("a"), "b")


def crossed(rows: DataFrame, generation: int) -> DataFrame:
    """Children of drawn pairs: neighbours in the drawn order of a motif's rows, the last of an odd number with the first; mean scores with a bonus, the better survival.

    Places come from one sort over ranges, so a motif of any size is dealt over tasks and every size follows the same rule.
    """
    at = kept(placed(rows, [F.asc("motif_type"), draw(generation, "id"), F.asc("id")]), "crossed")
    first = at.groupBy("motif_type").agg(F.min("place").alias("from"), F.count(F.lit(1)).alias("n"))  # a row for each motif
    numbered = at.join(F.broadcast(first), "motif_type").withColumn("k", F.col("place") - F.col("from"))
    one = numbered.where("k % 2 = 0 AND n > 1").select("motif_type", F.when(F.col("k") + 1 < F.col("n"), F.col("k") + 1).otherwise(0).alias("with"), F.struct(*rows.columns).alias("a"))
    both = one.join(numbered.select("motif_type", F.col("k").alias("with"), F.struct(*rows.columns).alias("b")), ["motif_type", "with"])
    operator = F.get(F.array(*[F.lit(c) for c in CROSSOVERS]), (draw(generation, "a.id", "b.id") * len(CROSSOVERS)).cast("int"))
    more = {}
    if "mechanism" in rows.columns:
        swap = (F.col("operator") == "combine_mechanism_and_gap") & (F.col("b.mechanism") != "insufficient evidence")
        more["mechanism"] = F.when(swap, F.col("b.mechanism")).otherwise(F.col("a.mechanism"))
    if "scope" in rows.columns:
        more["scope"] = F.when(F.col("operator") == "combine_target_scope", F.concat("a.scope", F.lit("; related scope: "), "b.scope")).otherwise(F.col("a.scope"))
    if "evidence_list" in rows.columns:
        more["evidence_list"] = F.when(F.col("operator") == "merge_evidence_sets", distinct_evidence(F.concat("a.evidence_list", "b.evidence_list"))).otherwise(F.col("a.evidence_list"))
    both = both.withColumn("operator", operator)
    return both.select(
        F.least("a.id", "b.id").alias("id"), "motif_type", F.array_sort(F.array("a.id", "b.id")).alias("parents"), "operator",
        bounded((F.col("a.novelty") + F.col("b.novelty")) / 2 + 0.02).alias("novelty"), bounded((F.col("a.feasibility") + F.col("b.feasibility")) / 2).alias("feasibility"),
        bounded((F.col("a.impact") + F.col("b.impact")) / 2 + 0.02).alias("impact"), F.greatest("a.survival", "b.survival").alias("survival"),
        F.lit(generation).alias("generation"), *[c.alias(k) for k, c in more.items()],
    )


def distinct_evidence(x: Column) -> Column:
    """Evidence (paper_id, evidence_text, ...) without repeats of paper and text; the first stays."""
    key = lambda e: F.struct(e["paper_id"].alias("p"), e["evidence_text"].alias("t"))
    return F.aggregate(x, F.slice(x, 1, 0), lambda out, e: F.when(F.exists(out, lambda o: key(o).eqNullSafe(key(e))), out).otherwise(F.array_append(out, e)))


def seed_signature(motif: Column, gap_id: Column) -> Column:
    return F.concat_ws(":", F.coalesce(F.nullif(motif, F.lit("")), F.lit("unknown_motif")), gap_id)


def combined_lineage(operator: Column, roots: Column, gap_ids: Column, motifs: Column) -> Column:
    """Lineage of a child of several parents: united origins, a signature that they decide, and whether no origin could be recovered."""
    clean = lambda x: F.array_sort(F.array_distinct(F.filter(x, lambda v: v.isNotNull() & (v != ""))))
    g, m, own = clean(gap_ids), clean(motifs), clean(roots)
    r = F.when(F.size(own) > 0, own).otherwise(F.transform(g, lambda x: F.concat(F.lit("recovered:"), x)))
    key = F.concat_ws("|", operator, F.array_join(r, ","), F.array_join(g, ","), F.array_join(m, ","))
    tag = F.when(F.size(m) > 0, F.array_join(m, "+")).otherwise("unknown")
    return F.struct(
        F.concat(F.lit("synth["), tag, F.lit("]:"), F.substring(F.sha1(key), 1, 10)).alias("origin_signature"), F.coalesce(F.get(r, F.lit(0)), F.lit("")).alias("primary_origin_signature"),
        r.alias("root_origin_signatures"), g.alias("origin_gap_ids"), m.alias("origin_motif_types"), (F.size(r) == 0).alias("lineage_invalid"),
    )


def content_words(x: Column) -> Column:
    """Words of five characters or more that carry content."""
    return F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: (F.length(w) >= 5) & ~w.isin(*CONTENT_STOPS)))


def problem_statement(gap: Column, target: Column, scope: Column, papers: Column) -> Column:
    """What a gap asks to investigate; the scope stands in where the target only repeats the gap."""
    t, g = F.trim(F.coalesce(target, F.lit(""))), F.trim(gap)
    hint = F.trim(F.replace(F.split_part(F.coalesce(scope, F.lit("")), F.lit(";"), F.lit(1)), F.lit("Motif type:"), F.lit("")))
    context = F.when((t == "") | F.contains(F.lower(g), F.lower(t)), F.when(hint != "", F.concat(F.lit("within "), hint)).otherwise("across the evaluated corpus")).otherwise(F.concat(F.lit("targeting "), t))
    attested = F.when(F.size(papers) > 0, F.concat(F.lit(" (attested in "), F.size(papers).cast("string"), F.lit(" paper(s))"))).otherwise("")
    return F.concat(F.lit("Investigate: "), g, F.lit(" — "), context, attested, F.lit("."))


# Mutations and endings of the first variants of a gap.
SEED_MUTATIONS = ("narrow_scope", "broaden_scope", "add_mechanism", "change_target_domain", "evaluation_protocol_generation")
SEED_ENDINGS = (
    " Require controlled evaluation across diverse settings.", " Propose a mechanism to address this gap.", " Generalize to adjacent tasks and domains.",
    " Design a benchmark to directly measure this gap.", " Provide theoretical analysis of the failure mode.",
)


def seeds(gaps: DataFrame, size: int, variants: int = 1) -> DataFrame:
    """The first population: gaps by survival, each with its variants, ``size`` rows in all.

    ``gaps`` has gap_id, gap, target, scope, mechanism, motif_type, paper_ids, the scores, survival and overall; a missing survival is the overall score.
    """
    r = gaps.withColumns({"survival": F.coalesce("survival", "overall"), "statement": problem_statement(F.col("gap"), F.col("target"), F.col("scope"), F.col("paper_ids"))})
    best = r.orderBy(F.desc("survival"), "gap_id").limit(size)  # one row of each gap at least
    each = best.select("*", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("variant"))
    operator = F.when(F.col("variant") > 0, F.get(F.array(*[F.lit(m) for m in SEED_MUTATIONS]), F.col("variant") % len(SEED_MUTATIONS)))
    ending = F.when(F.col("variant") > 0, F.get(F.array(*[F.lit(e) for e in SEED_ENDINGS]), (F.col("variant") - 1) % len(SEED_ENDINGS))).otherwise("")
    out = each.withColumns({"id": stable_id("cand", "gap_id", F.lit("seed"), "variant"), "problem_statement": F.concat("statement", ending), "origin": seed_signature(F.col("motif_type"), F.col("gap_id"))})
    made = mutated(out, 0, operator).withColumn("problem_statement", F.concat("statement", ending))  # a variant's statement is its own ending
    return made.drop("statement").orderBy(F.desc("survival"), "gap_id", "variant").limit(size)


def base_fitness() -> Column:
    c = F.col
    return bounded(
        0.2 * c("novelty") + 0.2 * c("feasibility") + 0.2 * c("impact") + 0.15 * F.least(F.lit(1.0), c("evidence") / 6) + 0.1 * F.least(F.lit(1.0), c("trace") / 5) + 0.15 * c("survival")
    )


def with_fitness(rows: DataFrame, diversity: float = 0.10) -> DataFrame:
    """Adds fitness: the base, and the mean Jaccard distance of the statement's words to all others' of the population.

    A population's words are sent once; each task compares its rows with them, so no pairs become rows.
    """
    rows = rows.withColumn("fitness", base_fitness())
    words = {r["id"]: frozenset((r["problem_statement"] or "").lower().split()) for r in rows.select("id", "problem_statement").collect()}  # a population
    sent = rows.sparkSession.sparkContext.broadcast(words)
    schema = rows.select("id").schema.add("distance", "double")

    def distances(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = sent.value
        for frame in frames:
            out = []
            for i in frame["id"]:
                own = every[i]
                d = [1 - len(own & w) / len(own | w) for j, w in every.items() if j != i and w] if own else []
                out.append(sum(d) / len(d) if d else 0.0)
            yield pd.DataFrame({"id": frame["id"], "distance": out})

    far = rows.select("id").mapInPandas(distances, schema)
    return rows.join(far, "id").withColumn("fitness", F.round(bounded(F.col("fitness") + diversity * F.col("distance")), 9)).drop("distance")


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def is_duplicate(child: dict, population: list[dict]) -> bool:
    """Too like a member: statements; gap and mechanism of one gap; content words of one gap."""
    words = lambda r, k: set((r[k] or "").lower().split())
    content = lambda r: {w for w in words(r, "problem_statement") if len(w) >= 5 and w not in CONTENT_STOPS}
    mine, own = words(child, "problem_statement"), content(child)
    for other in population:
        if _jaccard(mine, words(other, "problem_statement")) >= SAME_STATEMENT:
            return True
        if child["gap_id"] == other["gap_id"]:
            if _jaccard(words(child, "gap"), words(other, "gap")) >= SAME_TEXTS and _jaccard(words(child, "mechanism"), words(other, "mechanism")) >= SAME_TEXTS:
                return True
            if _jaccard(own, content(other)) >= SAME_CONTENT:
                return True
    return False


def interleaved(gaps: DataFrame, count: int, generation: int) -> DataFrame:
    """``count`` gaps for immigrants: one of each motif in turn, larger motifs first, in a drawn order within a motif."""
    size = gaps.groupBy("motif_type").agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy("motif_type").orderBy(draw(generation, "gap_id"), "gap_id")
    first = gaps.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= count)
    return first.join(F.broadcast(size), "motif_type").orderBy("turn", F.desc("size"), "motif_type").limit(count)  # a row for each motif


def evolved(population: DataFrame, generations: int, size: int, elite: float = 0.2) -> list[list[dict]]:
    """Generations of a population (list of rows each): elites stay, drawn parents mutate, duplicates are rejected, the fittest ``size`` go on.

    The loop is sequential and its state a population, so it runs over small frames; children come from :func:`mutated` and :func:`crossed`.
    """
    spark, schema = population.sparkSession, population.schema
    now = [r.asDict(True) for r in with_fitness(population).orderBy(F.desc("fitness"), "id").limit(size).collect()]
    history = [now]
    for g in range(1, generations + 1):
        elites = now[: max(1, int(size * elite))]
        frame = spark.createDataFrame([{f.name: r.get(f.name) for f in schema.fields} for r in now], schema)
        children = [r.asDict(True) for r in mutated(frame, g).withColumn("id", stable_id("cand", "id", "operator", F.lit(g))).orderBy(draw(g, "id"), "id").collect()]
        next_ = list(elites)
        for child in children:
            if len(next_) < size and not is_duplicate(child, next_):
                next_.append(child)
        frame = spark.createDataFrame([{f.name: r.get(f.name) for f in schema.fields} for r in next_], schema)
        now = [r.asDict(True) for r in with_fitness(frame).orderBy(F.desc("fitness"), "id").collect()]
        history.append(now)
    return history


def reviewed(rows: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """Adds impossibility_risk by keywords in the evidence (0, 0.7, 1) and the review label that it, or evidence from one paper, overrides."""
    text = F.lower("evidence_text")
    hits = F.lit(0)
    for k in keywords:
        hits = hits + F.contains(text, F.lit(k)).cast("int")
    risk = F.when(hits >= 2, 1.0).when(hits == 1, 0.7).otherwise(0.0)
    label = F.when(F.col("impossibility_risk") >= 0.7, "DROP_IMPOSSIBLE").when((F.size("supporting_papers") <= 1) & (F.col("review_label") == "KEEP"), "DROP_TOO_SINGLE_PAPER_FRAGILE").otherwise(F.col("review_label"))
    return rows.withColumn("impossibility_risk", risk).withColumn("review_label", label)
