"""Formulation variants: gates, hard-anchor merging into families, rollup, quality rubric, tiers, caveats and metrics.

Variants carry the columns that the generating and judging steps give them (variant_id, title, problem_statement, core_setting, ...).
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import vectorised
from lacuna.functions.text import jaccard, squash
from lacuna.operators.similarity import components
from lacuna.scratch import kept

# Bounds of the generator's and of the critic's gate, labels and support that the critic must give.
GENERATOR = {"coherence_score": (">=", 0.75), "specificity_score": (">=", 0.60), "term_soup_risk": ("<=", 0.30), "non_incrementality_score": (">=", 0.70), "incrementality_risk": ("<=", 0.40)}
CRITIC = {"critic_non_incrementality_score": (">=", 0.70), "critic_incrementality_risk": ("<=", 0.40), "critic_fake_ambition_risk": ("<=", 0.35)}
KEEP_LABELS, SUPPORT = ("STRONG_NON_INCREMENTAL", "VALID_BUT_MODEST"), ("strong", "moderate")
BAD_LABELS = ("FAKE_AMBITION", "DROP", "INCREMENTAL_REPHRASING")
# Words without identity (general, framing a result, naming a kind of contribution).
STOPS = tuple(
    "a an the of for and or to in on with without via using under over from into is are be this that these those new towards toward problem problems "
    "method methods approach approaches model models setting settings study studies analysis framework general design designing characterizing "
    "characterization robust robustness optimal adaptive based learning".split()
)
FRAMING = tuple(dict.fromkeys(
    "identifiability boundary boundaries limit limits failure failures phase transition transitions impossibility lower bound bounds upper theorem theorems "
    "regret exploration exploit robust robustness online offline adaptive characterization characterizing characterize fundamental necessary necessity "
    "sufficient sufficiency conditions condition gap gaps unknown known parameter parameters parameter-free method methods algorithm algorithms class classes "
    "model models setting settings problem problems analysis framework guarantee guarantees minimax optimal optimality sample complexity bounds rate rates "
    "dynamics estimation estimator learnable unlearnable characterizes finite infinite".split()
))
KINDS = ("theorem", "algorithm", "lower_bound", "benchmark", "empirical_study", "impossibility_boundary", "lower", "bound", "impossibility", "empirical", "study")
# Thresholds of merging and of near-duplicates within a family.
PAPERS, IDENTITY_C, TITLE, CLASS, IDENTITY_E, DUPLICATE = 0.50, 2, 0.72, 0.85, 3, 0.86
# Labels, actions, and how caveats read.
LABELS = {"A_STRONG": "READ_FIRST", "B_PROMISING_NEEDS_REFRAMING": "REFRAME", "C_LOW_PRIORITY": "READ_LATER", "D_DROP": "DROP"}
REFRAMABLE = ("weak_source_support", "too_broad", "too_method_specific", "incremental_or_validation_only", "low_domain_fit", "unclear_problem_object")
CAVEATS = {
    "off_domain": "appears to sit outside this run's core topic (it reads as a different research area)",
    "low_domain_fit": "only partially overlaps this run's core topic",
    "duplicate_of_stronger_family": "its variants are near-duplicates of one another, so it may be worth consolidating into a single direction",
    "weak_source_support": "the source grounding is thin",
    "fake_ambition_risk": "the stated ambition may outrun the available evidence",
    "formal_plausibility_concern": "the formal/empirical plausibility still needs checking",
    "too_broad": "the scope is broad and would benefit from narrowing",
    "too_method_specific": "it is tied closely to one named method, so the object may need generalizing",
    "incremental_or_validation_only": "it may be closer to validating an existing method than to a new result",
    "unclear_problem_object": "the core research object is under-specified",
}


def _t(x: str) -> Column:
    return F.coalesce(F.col(x).cast("string"), F.lit(""))


def _bounds(table: dict[str, tuple[str, float]]) -> Column:
    worst = lambda op: 0.0 if op == ">=" else 1.0
    value = lambda k, op: F.coalesce(F.col(k), F.lit(worst(op)))
    return functools.reduce(operator.and_, [value(k, op) >= b if op == ">=" else value(k, op) <= b for k, (op, b) in table.items()])


def generator_gate() -> Column:
    """Scores within bounds, the justifying texts there; one named method only for a benchmark or study of a class of methods."""
    named = F.lower(_t("named_method_dependency")) == "high"
    broad = _t("contribution_type").isin("benchmark", "empirical_study") & (F.trim(_t("method_class_scope")) != "")
    said = (F.trim(_t("broader_problem_class")) != "") & (F.trim(_t("why_not_just_validation")) != "")
    return F.upper(_t("recommendation")).isin("KEEP", "MAYBE") & _bounds(GENERATOR) & said & (~named | broad)


def critic_gate() -> Column:
    valid = F.coalesce("critic_broader_problem_class_valid", F.lit(False)) & F.coalesce("critic_contribution_type_valid", F.lit(False))
    return _bounds(CRITIC) & valid & _t("critic_quality_label").isin(*KEEP_LABELS) & F.lower(_t("critic_supported_by_source")).isin(*SUPPORT)


def variant_score() -> Column:
    c = F.col
    return 1.5 * c("non_incrementality_score") + c("ambition_score") + c("coherence_score") + c("specificity_score") - c("incrementality_risk") + 0.5 * c("seed_alignment_score")


def words(x: Column) -> Column:
    """Distinct words of three characters or more that are not general ones."""
    found = F.regexp_extract_all(F.lower(x), F.lit(r"([a-z][a-z0-9\-]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*STOPS)))


def object_words() -> Column:
    return F.array_distinct(F.concat(words(_t("core_setting")), words(_t("broader_problem_class")), words(_t("title"))))


def identity_words(topic: tuple[str, ...] = ()) -> Column:
    """Words that tell one research object from another: without the topic's, framing and contribution words."""
    return F.filter(object_words(), lambda w: ~w.isin(*topic, *FRAMING, *KINDS))


def without_framing(x: Column) -> Column:
    return F.array_join(F.filter(F.split(F.lower(squash(x)), " "), lambda w: ~w.isin(*FRAMING, *KINDS)), " ")


#: Rows of one key that meet in one share; characters counted together for the ratio's bound.
SPLIT = 2000
COUNTED = ("a", "e", "i", "o", "u", "t", "n", "s", "r", "l", "dhc", "mpg", "bfywkv", "xqjz", "01234", "56789", " ")


def counted(x: str) -> list[Column]:
    """A text's length and how often it has the characters of each class, as columns."""
    return [F.length(x).alias(f"{x}_n"), *[F.regexp_count(x, F.lit(f"[{c}]")).alias(f"{x}_{i}") for i, c in enumerate(COUNTED)]]


def may_be_like(x: str, threshold: float) -> Column:
    """Whether characters' counts (``counted`` columns of sides a and b) allow the ratio: matching blocks have no more of a class than the text with fewer."""
    a, b = (lambda k: F.col(f"a_{x}_{k}")), (lambda k: F.col(f"b_{x}_{k}"))
    classes = range(len(COUNTED))
    rest = F.least(a("n") - sum(a(i) for i in classes), b("n") - sum(b(i) for i in classes))
    return 2 * (sum(F.least(a(i), b(i)) for i in classes) + rest) >= threshold * (a("n") + b("n")) - 1e-9


def merge_edges(rows: DataFrame, topic: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, rule) with a < b: the first of the hard anchors A to E that two variants share.

    A and B link the variants of a key to its least id; C meets on papers and E on identity words (both rarest first), D on words of titles and statements without
    framing: titles without a common word are taken to differ.  Through a word that many share, only pairs go on whose characters' counts allow the ratio.

    Variants with the same papers, identity words and kind are one class, and C and E are found between classes, at the rarest thing that two have in common.  Words, papers
    and texts are compared as 64-bit hashes; texts travel only where they differ and a ratio decides.  Variants are written once, and sides of a join are shuffled
    whatever their size is taken for: small files of them are large in memory, so none goes through the driver as a broadcast.
    """
    hashes = lambda x: F.array_sort(F.transform(F.array_distinct(F.array_compact(x)), lambda w: F.xxhash64(w)))
    v = kept(rows.select(
        F.col("variant_id").alias("id"), _t("source_formulation_id").alias("source"), _t("source_verified_gap_id").alias("gap"),
        hashes(F.coalesce("supporting_papers", F.array().cast("array<string>"))).alias("papers"), hashes(identity_words(topic)).alias("identity"),
        without_framing(_t("title")).alias("title"), without_framing(_t("problem_statement")).alias("statement"), F.lower(squash(_t("broader_problem_class"))).alias("kind"),
    ).withColumn("class", F.xxhash64(F.size("papers"), "papers", F.size("identity"), "identity", "kind")), "variants")
    out = None
    for rule, key in (("A_same_source_direct_formulation", "source"), ("B_same_source_verified_gap", "gap")):
        least = v.where(F.col(key) != "").groupBy(key).agg(F.min("id").alias("a"))
        links = v.select("id", key).join(_shuffled(least), key).where("id <> a").select("a", F.col("id").alias("b"), F.lit(rule).alias("rule"))
        out = links if out is None else out.unionByName(links)
    out = kept(out, "links")
    near = _of_classes(v).unionByName(_of_texts(v)).unionByName(out.select("a", "b", F.lit(0).alias("code")))
    first = near.groupBy("a", "b").agg(F.min("code").alias("code")).where("code > 0")
    return out.unionByName(first.select("a", "b", F.get(F.array(*[F.lit(x) for x in RULES]), F.col("code") - 1).alias("rule")))


#: What the codes 1 to 3 of a pair's rule stand for.
RULES = ("C_paper_jaccard_and_identity_overlap", "D_title_problem_similarity", "E_same_problem_class_and_identity_overlap")


def _shuffled(df: DataFrame) -> DataFrame:
    return df.hint("merge")


def _shares(n: Column) -> Column:
    return F.ceil(n / SPLIT).cast("int").alias("shares")


def _sides(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of rows (id, key, shares, ...), as a_ and b_ columns, to join on key and share: a key of many rows is dealt out, each share of one side meeting a copy of the other."""
    own = [c for c in keys.columns if c not in ("id", "key", "shares")]
    name = lambda s: [F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in own]]
    one = keys.select(*name("a"), "key", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"))
    return one, _shuffled(keys.select(*name("b"), "key", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")))


def _met(keys: DataFrame, fit: Column) -> DataFrame:
    """Pairs a < b of rows (id, key, shares, ...) that share a key and fit, with their columns, once for each key."""
    one, two = _sides(keys)
    return one.join(two, ["key", "share"]).where((F.col("a") < F.col("b")) & fit)


def _counted_keys(keys: DataFrame) -> DataFrame:
    """Adds ``shares`` by the rows of each key; keys of one row meet nothing and go."""
    return keys.join(_shuffled(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")), "key").select(*keys.columns, _shares(F.col("n")))


def _of_classes(v: DataFrame) -> DataFrame:
    """(a, b, code) of rules C (1) and E (3): between classes first, then for their members."""
    classes = kept(v.select(F.col("class").alias("id"), "papers", "identity", "kind").distinct(), "classes")
    ranked = classes.select("id", F.xxhash64("kind").alias("kind"), F.length("kind").alias("n"))
    for x in ("papers", "identity"):
        each = classes.select("id", F.explode(x).alias("key"))
        often = each.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
        order = each.join(_shuffled(often), "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias(x))
        ranked = ranked.join(_shuffled(order), "id", "left")
    ranked = kept(ranked, "ranked")
    plain = lambda x: F.transform(x, lambda k: k["key"])

    def keys(x: str, most: Column, *own: Column) -> DataFrame:
        """A class's first ``most`` keys, rarest first; those of one class only meet nothing."""
        rows = ranked.select("id", *own, F.explode(F.slice(x, 1, F.greatest(most, F.lit(0)))).alias("k")).where("k.df > 1")
        return rows.select(*[c for c in rows.columns if c != "k"], "k.key", _shares(F.col("k.df")))

    common = lambda x: F.array_intersect(f"a_{x}", f"b_{x}")
    first = lambda x: F.get(common(x), F.lit(0)) == F.col("key")  # noqa: E731  # in order of rarity, so a pair is taken at one key
    # papers with a Jaccard similarity share one of either's first; sets that share three words share one besides the two most frequent of either
    size = F.size("papers")
    first_papers = keys("papers", size - F.ceil(PAPERS * size - 1e-9).cast("int") + 1, plain("papers").alias("papers"), plain("identity").alias("identity"))
    by_papers = _met(first_papers, first("papers") & (jaccard("a_papers", "b_papers") >= PAPERS) & (F.size(common("identity")) >= IDENTITY_C))
    rare = keys("identity", F.size("identity") - (IDENTITY_E - 1), plain("identity").alias("identity"), "kind", "n")
    fits = 2 * F.least("a_n", "b_n") >= CLASS * (F.col("a_n") + F.col("b_n"))  # the ratio's bound by length
    by_words = kept(_met(rare, first("identity") & (F.size(common("identity")) >= IDENTITY_E) & fits).select("a", "b", "a_kind", "b_kind"), "words")
    both = by_papers.select("a", "b", F.lit(1).alias("code"), F.lit(0).alias("way")).unionByName(by_words.where("a_kind = b_kind").select("a", "b", F.lit(3).alias("code"), F.lit(0).alias("way")))
    other = by_words.where("a_kind <> b_kind")
    if not other.isEmpty():  # kinds' texts are compared once for each two of them, either way: the ratio depends on which variant comes first
        texts = classes.select(F.xxhash64("kind").alias("h"), "kind").distinct()
        said = lambda s: _shuffled(texts.select(F.col("h").alias(f"{s}_kind"), F.col("kind").alias(f"{s}_text")))
        kinds = other.select("a_kind", "b_kind").distinct().join(said("a"), "a_kind").join(said("b"), "b_kind")
        ahead, back = vectorised.alike(F.col("a_text"), F.col("b_text"), CLASS), vectorised.alike(F.col("b_text"), F.col("a_text"), CLASS)
        like = kinds.select("a_kind", "b_kind", ahead.alias("ahead"), back.alias("back")).where("ahead OR back")
        way = F.when(F.col("ahead") & F.col("back"), 0).when(F.col("ahead"), 1).otherwise(2)
        both = both.unionByName(other.join(_shuffled(like), ["a_kind", "b_kind"]).select("a", "b", F.lit(3).alias("code"), way.alias("way")))
    n = F.size("identity")
    own = classes.select("id", F.when((F.size("papers") > 0) & (n >= IDENTITY_C), 1).when(n >= IDENTITY_E, 3).alias("code")).where("code IS NOT NULL")
    best = both.groupBy("a", "b").agg(F.min(F.struct("code", "way")).alias("m")).select("a", "b", "m.*")
    met = best.unionByName(own.select(F.col("id").alias("a"), F.col("id").alias("b"), "code", F.lit(1).alias("way")))
    members = v.select(F.col("class").alias("key"), "id")
    sizes = v.groupBy(F.col("class").alias("b")).agg(_shares(F.count(F.lit(1))))
    left = met.join(_shuffled(sizes), "b").join(_shuffled(members.select(F.col("key").alias("a"), F.col("id").alias("x"))), "a")
    left = left.select("x", "code", "way", F.col("b").alias("key"), F.pmod(F.xxhash64("x"), F.col("shares")).cast("int").alias("share"))
    right = members.join(_shuffled(sizes.withColumnRenamed("b", "key")), "key").select("key", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    pairs = left.join(_shuffled(right), ["key", "share"]).where((F.col("way") == 0) | (F.col("way") == F.when(F.col("x") < F.col("y"), 1).when(F.col("x") > F.col("y"), 2)))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "code")


def _of_texts(v: DataFrame) -> DataFrame:
    """(a, b, code) of rule D (2): equal titles and statements by their hashes, others by common words, counts of characters and ratio."""
    worded = lambda x: F.filter(F.array_distinct(F.split(x, " ")), lambda w: (w != "") & ~w.isin(*STOPS))
    mark = lambda x: F.when(F.size(worded(x)) > 0, F.xxhash64(F.lit(x), x))  # noqa: E731  # null where no word can be common
    marks = v.select("id", F.explode(F.array_compact(F.array(mark("title"), mark("statement")))).alias("key"))
    same = _met(_counted_keys(marks), F.lit(True)).select("a", "b", F.lit(2).alias("code"))
    said = v.select("id", F.explode(F.array_union(worded("title"), worded("statement"))).alias("key"), mark("title").alias("t"), mark("statement").alias("s"))
    # a word of one title or one statement only brings no more pairs than that
    alone = lambda x: (F.count(x) == F.count(F.lit(1))) & (F.min(x) == F.max(x))
    words = kept(said.groupBy("key").agg(_shares(F.count(F.lit(1))), (alone("t") | alone("s") | (F.count(F.lit(1)) == 1)).alias("alone")).where("NOT alone").drop("alone"), "said")
    if words.isEmpty():
        return same
    keys = v.select("id", F.explode(F.array_union(worded("title"), worded("statement"))).alias("key"), *counted("title"), *counted("statement")).join(_shuffled(words), "key")
    pairs = kept(_met(keys, may_be_like("title", TITLE) | may_be_like("statement", TITLE)).select("a", "b").distinct(), "pairs")
    side = lambda s: _shuffled(v.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("title", "statement")]))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    like = vectorised.alike(F.col("a_title"), F.col("b_title"), TITLE) | vectorised.alike(F.col("a_statement"), F.col("b_statement"), TITLE)
    return same.unionByName(both.where(like).select("a", "b", F.lit(2).alias("code")))


def level(x: Column, high: float, middle: float) -> Column:
    return F.when(x >= high, "strong").when(x >= middle, "moderate").otherwise("weak")


def families(rows: DataFrame, edges: DataFrame, topic: tuple[str, ...] = ()) -> DataFrame:
    """One graded row per family: representative (largest critic's non-incrementality, least fake risk, best rank), members, unions, the rubric's parts,
    label, action, downgrade reasons, recoverability and the inconsistency warning."""
    named = components(rows.select(F.col("variant_id").alias("id")), edges.select("a", "b")).withColumnRenamed("id", "variant_id")
    v = rows.join(named, "variant_id")
    ni, fake = F.coalesce("critic_non_incrementality_score", F.lit(0.0)), F.coalesce("critic_fake_ambition_risk", F.lit(1.0))
    best = v.groupBy("component").agg(F.min_by(F.struct("variant_id", "title", "problem_statement"), F.struct((-ni).alias("n"), fake.alias("f"), F.col("expanded_rank").alias("r"), F.col("variant_id").alias("i"))).alias("rep"))
    v = v.join(best, "component")
    norm = lambda x: F.lower(squash(F.coalesce(x, F.lit(""))))
    v = v.withColumns({"_t": norm(F.col("title")), "_rt": norm(F.col("rep.title")), "_s": norm(F.col("problem_statement")), "_rs": norm(F.col("rep.problem_statement"))})
    same = vectorised.alike(F.col("_t"), F.col("_rt"), DUPLICATE) | vectorised.alike(F.col("_s"), F.col("_rs"), DUPLICATE)
    v = v.withColumns({"dup": (F.col("variant_id") != F.col("rep.variant_id")) & same, "object": object_words()})
    support = F.when(F.lower(_t("critic_supported_by_source")) == "strong", 2).when(F.lower(_t("critic_supported_by_source")) == "moderate", 1).otherwise(0)
    labels = F.collect_set(_t("critic_quality_label"))
    f = v.groupBy("component").agg(
        F.first("rep.variant_id").alias("representative_variant_id"), F.first("rep.title").alias("family_title"), F.array_sort(F.collect_list("variant_id")).alias("member_variant_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("supporting_papers")))).alias("supporting_papers"),
        F.array_sort(F.collect_set(F.when(_t("source_verified_gap_id") != "", F.col("source_verified_gap_id")))).alias("source_verified_gaps"),
        F.array_sort(F.collect_set(F.when(_t("source_formulation_id") != "", F.col("source_formulation_id")))).alias("source_direct_formulations"),
        F.count(F.lit(1)).alias("n"), F.count_if("dup").alias("dups"), F.max(support).alias("support"), F.max(ni).alias("ni"), F.max(F.coalesce("specificity_score", F.lit(0.0))).alias("spec"),
        F.max(F.coalesce("feasibility_score", F.lit(0.0))).alias("feas"), F.min(fake).alias("fake"), labels.alias("labels"), F.bool_or(F.lower(_t("named_method_dependency")) == "high").alias("named"),
        F.array_distinct(F.flatten(F.collect_list("object"))).alias("object"), F.max(F.length(F.trim(F.concat_ws(" ", _t("broader_problem_class"), _t("core_setting"))))).alias("object_chars"),
    )
    overlap = F.size(F.filter("object", lambda w: w.isin(*topic))) if topic else F.lit(1)
    bad = F.arrays_overlap("labels", F.array(*[F.lit(x) for x in BAD_LABELS]))
    only_dups = (F.col("n") > 1) & (F.col("dups") == F.col("n") - 1)
    f = f.withColumns({
        "evidence_grounding": F.when(F.col("support") == 2, "strong").when(F.col("support") == 1, "moderate").otherwise("weak"), "non_incrementality": level(F.col("ni"), 0.85, 0.70),
        "specificity": level(F.col("spec"), 0.80, 0.60),
        "plausibility": F.when((F.col("feas") >= 0.70) & (F.col("fake") <= 0.20), "strong").when((F.col("fake") >= 0.35) | (F.col("feas") < 0.50), "weak").otherwise("moderate"),
        "domain_fit": F.when(overlap >= 2, "strong").when(overlap == 1, "moderate").otherwise("weak"), "only_dups": only_dups,
        "unclear": (F.size(F.filter("object", lambda w: ~w.isin(*topic, *FRAMING, *KINDS))) == 0) | (F.col("object_chars") < 15),
    })
    c = F.col
    some = lambda x: c(x).isin("strong", "moderate")
    label = (
        F.when((c("domain_fit") == "weak") | bad | (c("plausibility") == "weak") | c("only_dups"), "D_DROP")
        .when(some("evidence_grounding") & (c("non_incrementality") == "strong") & some("specificity") & some("plausibility") & (c("domain_fit") == "strong"), "A_STRONG")
        .when(some("non_incrementality") & ((c("specificity") == "weak") | (c("evidence_grounding") == "weak") | (c("domain_fit") == "moderate")), "B_PROMISING_NEEDS_REFRAMING")
        .otherwise("C_LOW_PRIORITY")
    )
    has = lambda x: F.array_contains("labels", x)
    reasons = F.array_compact(F.array(
        F.when(c("only_dups"), "duplicate_of_stronger_family"), F.when((c("fake") >= 0.35) | has("FAKE_AMBITION"), "fake_ambition_risk"),
        F.when(c("plausibility") == "weak", "formal_plausibility_concern"), F.when((c("non_incrementality") != "strong") | has("INCREMENTAL_REPHRASING"), "incremental_or_validation_only"),
        F.when(c("domain_fit").isin("weak", "moderate"), "low_domain_fit"), F.when(c("domain_fit") == "weak", "off_domain"), F.when(c("specificity") == "weak", "too_broad"),
        F.when(c("named"), "too_method_specific"), F.when(c("unclear"), "unclear_problem_object"), F.when(c("evidence_grounding") == "weak", "weak_source_support"),
    ))
    f = f.withColumns({"quality_label": label, "dr": reasons})
    forced = F.when(c("plausibility") != "strong", "formal_plausibility_concern").otherwise("low_domain_fit")
    f = f.withColumn("downgrade_reasons", F.when((c("quality_label") == "D_DROP") & (F.size("dr") == 0), F.array(forced)).otherwise(c("dr")))
    d = lambda x: F.array_contains("downgrade_reasons", x)
    recover = F.when(c("quality_label").isin("D_DROP", "C_LOW_PRIORITY"), (
        F.when(d("duplicate_of_stronger_family"), "MERGE_WITH_RELATED_FAMILY").when(d("off_domain"), "DROP_PERMANENTLY").when(c("quality_label") == "C_LOW_PRIORITY", "READ_LATER")
        .when((F.size("downgrade_reasons") > 0) & (F.size(F.array_except("downgrade_reasons", F.array(*[F.lit(x) for x in REFRAMABLE]))) == 0), "REFRAME").otherwise("DROP_PERMANENTLY")
    ))
    action = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    strong = (c("quality_label") == "D_DROP") & (c("evidence_grounding") == "strong") & (c("plausibility") == "strong") & (c("domain_fit") == "strong")
    return f.withColumns({
        "recommended_action": action[c("quality_label")], "maybe_recoverable_as": recover, "label_inconsistency_warning": strong,
        "duplicate_status": F.when(c("dups") > 0, "merged_duplicate_family").otherwise("unique"),
    }).drop("support", "ni", "spec", "feas", "fake", "labels", "named", "object", "object_chars", "only_dups", "unclear", "dr")


def ranked_families(rows: DataFrame) -> DataFrame:
    """Families by label A to D, then by members; few rows, as they are read one by one."""
    return rows.orderBy("quality_label", F.desc("n"), "component")


def tier(label: Column) -> Column:
    return F.when(label == "A_STRONG", 1).when(label == "B_PROMISING_NEEDS_REFRAMING", 2).otherwise(3)


def caveats(reasons: Column | str) -> Column:
    """One sentence of the reasons, overlapping phrasings once."""
    r = F.col(reasons) if isinstance(reasons, str) else reasons
    table = F.create_map(*[F.lit(x) for kv in CAVEATS.items() for x in kv])
    kept = F.filter(r, lambda x: ~((x == "low_domain_fit") & F.array_contains(r, "off_domain")))
    s = F.array_join(F.array_distinct(F.transform(kept, lambda x: F.coalesce(F.try_element_at(table, x), x))), "; ")
    return F.when(F.size(r) > 0, F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 100_000), F.lit("."))).otherwise("No major caveats were flagged.")


def low_signal_reason(counts: dict[str, int], source: str = "verification_passed_gaps") -> str | None:
    """Why a run ended without families: the first stage of the funnel that gave nothing."""
    if counts.get("families"):
        return None
    steps = [("verification_reviewed_gaps", "no_verification_reviewed_gaps"), ("direct", "no_direct_formulations"), ("critic_passing", "no_critic_passing_formulations")]
    if source == "verification_passed_gaps":
        steps.insert(0, ("verification_passed_gaps", "no_verification_passed_gaps"))
    return next((reason for k, reason in steps if not counts.get(k)), "no_project_families")


def expansion_metrics(rows: DataFrame) -> DataFrame:
    """One row: how many variants each gate drops, and averages to three places."""
    ni, risk = F.coalesce("non_incrementality_score", F.lit(0.0)), F.coalesce("incrementality_risk", F.lit(1.0))
    cni, fake = F.coalesce("critic_non_incrementality_score", F.lit(0.0)), F.coalesce("critic_fake_ambition_risk", F.lit(1.0))
    ok = generator_gate()
    return rows.agg(
        F.count(F.lit(1)).alias("variants"), F.count_if(ok).alias("passing_generator_gate"), F.count_if(ok & critic_gate()).alias("passing_final_gate"),
        F.count_if(ni < 0.70).alias("dropped_by_non_incrementality_gate"), F.count_if(risk > 0.40).alias("dropped_by_incrementality_risk_gate"),
        F.count_if(ok & (cni < 0.70)).alias("dropped_by_critic_non_incrementality"), F.count_if(ok & (fake > 0.35)).alias("dropped_by_critic_fake_ambition"),
        F.count_if(ok & ~F.lower(_t("critic_supported_by_source")).isin(*SUPPORT)).alias("dropped_by_critic_source_support"),
        F.round(F.avg("non_incrementality_score"), 3).alias("avg_generator_non_incrementality_all"), F.round(F.avg("critic_non_incrementality_score"), 3).alias("avg_critic_non_incrementality_all"),
    )


def assignment_audit(families_: DataFrame, variants: DataFrame) -> DataFrame:
    """One row of invariants: every variant in exactly one family, no invented ids, nothing dropped is to be read first."""
    used = families_.select(F.explode("member_variant_ids").alias("variant_id")).groupBy("variant_id").agg(F.count(F.lit(1)).alias("uses"))
    both = variants.select("variant_id").distinct().withColumn("known", F.lit(True)).join(used, "variant_id", "full")
    first = families_.agg(F.count_if((F.col("quality_label") == "D_DROP") & (F.col("recommended_action") == "READ_FIRST")).alias("wrong"))
    one = both.agg(F.count_if(F.col("known").isNull()).alias("invented"), F.count_if(F.coalesce("uses", F.lit(0)) != 1).alias("not_once"))
    return one.crossJoin(F.broadcast(first)).select((F.col("not_once") == 0).alias("all_assigned_once"), (F.col("invented") == 0).alias("no_invented_ids"), (F.col("wrong") == 0).alias("no_drop_is_read_first"))
