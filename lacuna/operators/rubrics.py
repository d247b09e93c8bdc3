"""Judge rubrics: what a reply must hold, predicates over a candidate's texts, and the cap rules between both.

A candidate is a row with the text columns of ``FIELDS``; a reply is a row whose ``scores`` is a map from criterion to integer text (as parsed from
JSON).  Every validator returns an array of violations, empty for a valid reply, so that a whole corpus of replies is checked in one pass.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.text import ascii_words

NOT_PROVIDED = "not provided"
# The fields of a candidate, the criteria, enumerations and labels of the judging protocol.
FIELDS = (
    "candidate_id", "domain", "title", "problem_statement", "motivation_or_abstract", "proposed_direction", "expected_contribution", "evaluation_plan",
    "risks_or_caveats", "source_context_or_grounding", "formal_problem_statement", "assumptions_or_problem_setup", "ambiguity_or_missing_definitions",
)
FORMULATION_ONLY = (
    "problem_definition_clarity_10", "technical_specificity_10", "well_posedness_10", "assumption_boundary_clarity_10", "formalizability_10",
    "nontriviality_10", "scope_control_10", "source_grounded_specificity_10", "ambiguity_hygiene_10", "overall_formulation_quality_10",
)
FORMULATION_QUALITY = (
    "well_posedness_0_to_10", "technical_sharpness_0_to_10", "meaningful_assumption_shift_0_to_10", "nontriviality_0_to_10", "domain_fit_0_to_10",
    "source_grounded_specificity_0_to_10", "feasibility_0_to_10", "scope_control_0_to_10", "ambiguity_hygiene_0_to_10", "overall_formulation_quality_0_to_10",
)
PROFILE_CRITERIA = ("profile_alignment_10", "profile_specificity_10", "intellectual_style_match_10", "profile_novelty_fit_10", "personalization_overall_10")
IDEA_QUALITY = (
    "novelty_originality_10", "feasibility_10", "potential_impact_10", "clarity_coherence_10", "actionability_10", "groundedness_10",
    "traceability_auditability_10", "non_redundancy_scope_control_10",
)
PREFERENCE = (
    "clarity_specificity", "significance", "novelty_potential", "feasibility", "evidence_grounding", "formalizability", "non_incrementality", "actionability",
    "low_term_soup", "auditability_overall", "pursuit_priority",
)
SPECIAL_WINNERS = ("best_overall_candidate", "most_auditable_candidate", "most_actionable_candidate", "most_novel_potential_candidate")
ROLES = {
    "scientific_merit_reviewer": ("novelty_potential_10", "significance_10", "feasibility_10", "actionability_10", "research_priority_10"),
    "formalization_reviewer": ("formalizability_10", "assumption_clarity_10", "objective_clarity_10", "evaluation_model_clarity_10"),
    "evidence_auditability_reviewer": ("evidence_grounding_10", "source_traceability_10", "auditability_10", "low_term_soup_10"),
}
ACTIONS = ("READ_FIRST", "PROMISING_NEEDS_REFINEMENT", "NEEDS_REFRAMING", "DROP_OR_DEPRIORITIZE")
CONFIDENCES = ("LOW", "MEDIUM", "HIGH")
CHECKLIST = (
    "concrete_source_grounding", "formal_problem_skeleton", "clear_assumptions_or_shift", "clear_objective_or_success_criterion", "clear_evaluation_path",
    "term_soup_or_overcomposed",
)
# Word lists of the predicates, as patterns over lower-case text.
LOOSE = r"\b(causal|quantum|federated|diffusion|graph|multimodal|fair|robust|adversarial|bayesian|conformal|world model|foundation|neural|symbolic)\b"
SOUP = (
    r"\b(causal|robust|federated|bayesian|quantum|diffusion|transformer|graph|multimodal|privacy|fairness|meta-learning|neurosymbolic|hierarchical|reinforcement|"
    r"contrastive|conformal|foundation model|world model|active learning)\b"
)
APPLY = r"\b(apply|test|combine|benchmark|evaluate)\b.{0,80}\b(to|under|with|against)\b"
EVIDENCE = (
    r"\b(paper\s+\d+|corpus\s+#\d+|openreview|arxiv|doi:|supporting_papers|source_verified_gaps|retrieved_context|top_source|source_context|context items?)\b"
)
SKELETON = (
    r"\b(entity|entities|variable|variables|arm|policy|reward|state|action|observation|feedback|distribution|estimator)\b",
    r"\b(assumption|assume|constraint|under the condition|setting)\b",
    r"\b(objective|success criterion|minimize|maximize|regret|bound|identify|estimate|guarantee)\b",
    r"\b(observation|feedback|evaluation model|measurement|benchmark|experiment|observed|sample)\b",
)
ACTION_PATH = (
    r"\b(theorem|algorithm|benchmark|dataset|experiment|empirical|proof|source-reading|read|evaluation|validate|compare|simulation|lower bound|upper bound)\b"
)
VARIABLES = (
    r"\b(variables?|entities|arms?|actions?|states?|observations?|feedback|rewards?|polic(?:y|ies)|constraints?|objectives?|estimators?|environments?|distributions?)\b"
)
ASSUMPTIONS = r"\b(assumption|assume|under|condition|constraint|setting|given)\b"
OBJECTIVE = (
    r"\b(objective|success criterion|minimi[sz]e|maximi[sz]e|optimi[sz]e|bound|identify|estimate|guarantee|regret|loss|error|risk|accuracy|coverage)\b"
)
EVALUATION = r"\b(observation|feedback|measurement|evaluation|benchmark|experiment|dataset|simulation|compare|validate|metric|protocol|theorem|proof)\b"
GENERIC_SOURCE = ("provided corpus", "recent work", "literature", "source context", "papers in the corpus", "not provided")
NAMED_SOURCE = r"\b(paper\s+\d+|openreview|arxiv|doi:|source_verified_gaps|supporting_papers)\b"
KNOWN_VERBS, KNOWN_NOUNS = r"\b(apply|application|use|extend|adapt|combine|test|evaluate)\b", r"\b(known|existing|standard|method|algorithm|approach|framework)\b"
SPECIFIC = (
    "given", "let ", "under ", "assume", "objective", "identify", "bound", "regret", "policy", "distribution", "estimator", "samples", "observations",
    "reward", "theorem", "condition", "constraint",
)
GENERIC_PROBLEM = ("improve machine learning", "better machine learning", "general framework", "future benchmarks", "many datasets", "scientific discovery")
OFF_PROFILE = ("name-dropping", "name dropping", "off-profile", "off profile")
WEAK_PROFILE = ("generic", "could apply to many", "not profile-specific", "name-dropping", "off-profile")
PROFILE_STOPS = (
    "profile", "researcher", "artifact", "supported", "themes", "papers", "paper", "context", "include", "includes", "including", "source", "sources",
    "title", "titles", "research", "problem", "method", "methods", "learning", "machine",
)
#: What a blinded text must not show, besides the labels of the methods compared, which are arguments.
HIDDEN = ("baseline method",)


@dataclass(frozen=True)
class Rubric:
    """Criteria of a scoring mode and their scale."""

    criteria: tuple[str, ...]
    low: int = 0
    high: int = 10
    key: str = "domain"


RUBRICS = {
    "formulation_only": Rubric(FORMULATION_ONLY),
    "formulation_quality": Rubric(FORMULATION_QUALITY),
    "personalized": Rubric(FORMULATION_ONLY + PROFILE_CRITERIA, key="profile"),
    "idea_quality": Rubric(IDEA_QUALITY, low=1),
}


def _text(x: str) -> Column:
    return F.coalesce(F.col(x).cast("string"), F.lit(""))


def _either(tests) -> Column:
    return functools.reduce(operator.or_, tests, F.lit(False))


def _contains(x: Column, phrases: tuple[str, ...]) -> Column:
    return _either(F.contains(x, F.lit(p)) for p in phrases)


def provided(x: str) -> Column:
    """Whether a field says anything."""
    t = F.trim(_text(x))
    return (t != "") & ~F.lower(t).isin(NOT_PROVIDED, "none", "n/a", "null")


def _joined(*names: str) -> Column:
    return F.lower(F.concat_ws("\n", *[_text(n) for n in names]))


def whole_text(fields: tuple[str, ...] = FIELDS) -> Column:
    return F.concat_ws("\n", *[F.col(n).cast("string") for n in fields])


def concrete_evidence(fields: tuple[str, ...] = FIELDS) -> Column:
    source = F.lower(F.trim(_text("source_context_or_grounding")))
    return F.lower(whole_text(fields)).rlike(ascii_words(EVIDENCE)) | ((source != NOT_PROVIDED) & (F.length(source) > 40))


def formal_structure(fields: tuple[str, ...] = FIELDS) -> Column:
    """Statement and setup are there, or the text shows three of entities, assumptions, objective and feedback."""
    text = F.lower(whole_text(fields))
    marks = functools.reduce(operator.add, [text.rlike(ascii_words(p)).cast("int") for p in SKELETON])
    return (provided("formal_problem_statement") & provided("assumptions_or_problem_setup")) | (marks >= 3)


def action_path() -> Column:
    return _joined("evaluation_plan", "expected_contribution", "proposed_direction").rlike(ascii_words(ACTION_PATH))


def has_variables() -> Column:
    return _joined("formal_problem_statement", "assumptions_or_problem_setup", "problem_statement").rlike(ascii_words(VARIABLES))


def has_assumptions() -> Column:
    return _joined("assumptions_or_problem_setup", "formal_problem_statement", "problem_statement").rlike(ascii_words(ASSUMPTIONS))


def has_objective() -> Column:
    return _joined("formal_problem_statement", "assumptions_or_problem_setup", "evaluation_plan", "expected_contribution", "problem_statement").rlike(ascii_words(OBJECTIVE))


def has_evaluation_model() -> Column:
    return _joined("evaluation_plan", "formal_problem_statement", "assumptions_or_problem_setup", "expected_contribution").rlike(ascii_words(EVALUATION))


def generic_source(fields: tuple[str, ...] = FIELDS) -> Column:
    source = F.lower(F.trim(_text("source_context_or_grounding")))
    vague = ~concrete_evidence(fields) | (_contains(source, GENERIC_SOURCE) & ~source.rlike(ascii_words(NAMED_SOURCE)))
    return (source != "") & (source != NOT_PROVIDED) & vague


def term_soup(fields: tuple[str, ...] = FIELDS) -> Column:
    """Six different fashionable terms or more."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(whole_text(fields)), F.lit(ascii_words(SOUP)), F.lit(1)))) >= 6


def incremental(fields: tuple[str, ...] = FIELDS) -> Column:
    text = F.lower(whole_text(fields))
    return text.rlike(ascii_words(KNOWN_VERBS)) & text.rlike(ascii_words(KNOWN_NOUNS))


def loose_terms(fields: tuple[str, ...] = FIELDS) -> Column:
    return F.regexp_count(F.lower(whole_text(fields)), F.lit(ascii_words(LOOSE)))


def vague_problem() -> Column:
    """No statement; a short one without formal part; none of the specific words anywhere; or a generic phrase."""
    problem, formal, setup = (F.lower(F.trim(_text(x))) for x in ("problem_statement", "formal_problem_statement", "assumptions_or_problem_setup"))
    specific = _contains(problem, SPECIFIC) | _contains(formal, SPECIFIC) | _contains(setup, SPECIFIC)
    short = (F.length(problem) < 120) & ((formal == NOT_PROVIDED) | (setup == NOT_PROVIDED))
    return problem.isin("", NOT_PROVIDED) | short | ~specific | _contains(problem, GENERIC_PROBLEM)


def _score(name: str) -> Column:
    return F.coalesce(F.try_element_at("scores", F.lit(name)).try_cast("int"), F.lit(0))


def _rules(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules]))


def formulation_caps(fields: tuple[str, ...] = FIELDS) -> Column:
    """The ten rules of the formulation-only rubric."""
    s = _score
    formal, setup = provided("formal_problem_statement"), provided("assumptions_or_problem_setup")
    return _rules(
        (vague_problem() & (s("overall_formulation_quality_10") > 6), "vague_problem_but_overall_above_6"),
        (~formal & (s("well_posedness_10") > 6), "formal_problem_statement_missing_but_well_posedness_above_6"),
        (~formal & (s("formalizability_10") > 6), "formal_problem_statement_missing_but_formalizability_above_6"),
        (~setup & (s("well_posedness_10") > 6), "assumptions_or_problem_setup_missing_but_well_posedness_above_6"),
        (~setup & (s("assumption_boundary_clarity_10") > 6), "assumptions_or_problem_setup_missing_but_assumption_boundary_above_6"),
        (~provided("ambiguity_or_missing_definitions") & (s("ambiguity_hygiene_10") > 6), "ambiguity_missing_definitions_missing_but_ambiguity_hygiene_above_6"),
        (~provided("source_context_or_grounding") & (s("source_grounded_specificity_10") > 4), "source_context_or_grounding_missing_but_source_specificity_above_4"),
        ((loose_terms(fields) >= 8) & (s("scope_control_10") > 4), "many_loose_concepts_but_scope_control_above_4"),
        (F.lower(whole_text(fields)).rlike(ascii_words(APPLY)) & (s("nontriviality_10") > 6), "apply_or_test_x_to_y_but_nontriviality_above_6"),
        (~formal_structure(fields) & (s("overall_formulation_quality_10") > 7), "no_clear_formal_skeleton_but_overall_above_7"),
    )


def quality_caps(fields: tuple[str, ...] = FIELDS) -> Column:
    """The nine rules of the formulation-quality rubric."""
    s = lambda k: _score(f"{k}_0_to_10")
    formal, source, shape = provided("formal_problem_statement"), provided("source_context_or_grounding"), formal_structure(fields)
    weak = (~source | ~concrete_evidence(fields)) & (~formal | ~shape)
    return _rules(
        (~formal & (s("well_posedness") > 6), "formal_problem_statement_missing_but_well_posedness_above_6"),
        (~formal & (s("overall_formulation_quality") > 7), "formal_problem_statement_missing_but_overall_above_7"),
        (~provided("assumptions_or_problem_setup") & (s("well_posedness") > 6), "assumptions_or_problem_setup_missing_but_well_posedness_above_6"),
        (~source & (s("source_grounded_specificity") > 4), "source_context_or_grounding_missing_but_source_specificity_above_4"),
        (~provided("ambiguity_or_missing_definitions") & (s("ambiguity_hygiene") > 6), "ambiguity_missing_definitions_missing_but_ambiguity_hygiene_above_6"),
        (~provided("evaluation_plan") & (s("feasibility") > 6), "evaluation_plan_missing_but_feasibility_above_6"),
        (~shape & (s("technical_sharpness") > 5), "broad_or_underformalized_candidate_but_technical_sharpness_above_5"),
        ((loose_terms(fields) >= 8) & (s("scope_control") > 4), "many_loose_concepts_but_scope_control_above_4"),
        (weak & (s("overall_formulation_quality") > 6), "source_grounding_and_formal_structure_weak_but_overall_above_6"),
    )


def weak_profile_signal() -> Column:
    """No profile context, a phrase that says so, or fewer than two of its first 80 words in the candidate and no source either."""
    context = F.lower(F.trim(_text("profile_context")))
    text = _joined("title", "problem_statement", "motivation_or_abstract", "formal_problem_statement", "source_context_or_grounding", "supporting_papers")
    found = F.regexp_extract_all(context, F.lit(r"([a-z][a-z0-9\-]{4,})"), F.lit(1))
    asked = F.slice(F.array_distinct(F.filter(found, lambda w: ~w.isin(*PROFILE_STOPS))), 1, 80)
    overlap = F.size(F.filter(asked, lambda w: F.contains(text, w)))
    said = lambda x: ~F.lower(F.trim(_text(x))).isin("", NOT_PROVIDED)
    sourced = said("source_context_or_grounding") | said("supporting_papers")
    return context.isin("", NOT_PROVIDED) | _contains(text, WEAK_PROFILE) | ((overlap < 2) & ~sourced)


def personalized_caps(fields: tuple[str, ...] = FIELDS) -> Column:
    """The formulation-only rules and four on the profile."""
    s, context = _score, F.lower(F.trim(_text("profile_context")))
    more = _rules(
        (context.isin("", NOT_PROVIDED) & (s("personalization_overall_10") > 5), "profile_context_missing_but_personalization_overall_above_5"),
        (weak_profile_signal() & (s("profile_specificity_10") > 5), "generic_or_weak_profile_signal_but_profile_specificity_above_5"),
        (_contains(F.lower(whole_text(fields)), OFF_PROFILE) & (s("profile_alignment_10") > 4), "name_dropping_or_off_profile_but_profile_alignment_above_4"),
        ((s("profile_alignment_10") <= 5) & (s("personalization_overall_10") > 7), "weak_profile_alignment_but_personalization_overall_above_7"),
    )
    return F.concat(formulation_caps(fields), more)


def role_caps(role: str, fields: tuple[str, ...] = FIELDS) -> tuple[Column, Column]:
    """(rules triggered, rules broken) of a reviewer's role."""
    s, formal, evidence = _score, provided("formal_problem_statement"), concrete_evidence(fields)
    table: list[tuple[Column, str, list[tuple[str, int, str]]]] = {
        "scientific_merit_reviewer": [
            (~action_path(), "no_clear_evaluation_or_next_step_path", [("actionability_10", 5, "without a clear evaluation or next-step path")]),
            (s("feasibility_10") <= 4, "weak_feasibility", [("research_priority_10", 6, "despite weak feasibility")]),
            (incremental(fields), "mostly_generic_or_known_method_application", [("novelty_potential_10", 5, "for a mostly generic/common direction")]),
        ],
        "formalization_reviewer": [
            (~formal, "formal_problem_statement_missing", [("formalizability_10", 5, "when formal_problem_statement is missing or not provided")]),
            (~has_variables(), "variables_or_entities_missing", [("formalizability_10", 6, "without explicit variables/entities")]),
            (~has_assumptions(), "assumptions_missing", [("assumption_clarity_10", 5, "without explicit assumptions")]),
            (~has_objective(), "objective_missing", [("objective_clarity_10", 5, "without explicit objective/success criterion")]),
            (~has_evaluation_model(), "evaluation_model_missing", [("evaluation_model_clarity_10", 5, "without explicit observation/evaluation model")]),
        ],
        "evidence_auditability_reviewer": [
            (~evidence, "no_concrete_source_evidence", [
                ("evidence_grounding_10", 4, "without concrete source papers/evidence trail/context items"), ("source_traceability_10", 4, "without traceable support/context"),
            ]),
            (generic_source(fields), "generic_source_evidence", [("evidence_grounding_10", 6, "with generic source evidence")]),
            (~evidence & ~formal_structure(fields), "weak_evidence_and_formal_structure", [("auditability_10", 5, "when formal structure and evidence trail are weak")]),
            (term_soup(fields), "term_soup_or_overcomposed", [("low_term_soup_10", 4, "for a term-soup/over-composed candidate")]),
        ],
    }[role]
    triggered = _rules(*[(test, name) for test, name, _ in table])
    broken = _rules(*[(test & (s(k) > cap), f"{k} exceeds {cap} {why}") for test, _, caps in table for k, cap, why in caps])
    return triggered, broken


def batch_caps(fields: tuple[str, ...] = FIELDS) -> Column:
    """Hard caps of the batch mode (scores 1 to 5), against the candidate and the reply's own checklist; an exception names its rule's keyword."""
    s = _score
    said = lambda k, v: F.coalesce(F.try_element_at("pre_score_checklist", F.lit(k)) == v, F.lit(False))
    free = lambda word: F.coalesce(F.exists("cap_exceptions", lambda x: F.contains(F.lower(x), F.lit(word))), F.lit(False))
    evidence, shape, path = concrete_evidence(fields), formal_structure(fields), action_path()
    formal, setup, ambiguity = (provided(x) for x in ("formal_problem_statement", "assumptions_or_problem_setup", "ambiguity_or_missing_definitions"))
    grounding, formalizing, priority = s("evidence_grounding"), s("formalizability"), s("pursuit_priority")
    weak = ((grounding <= 3) & (formalizing <= 3)) | (~formal & ~setup & ~ambiguity)
    return _rules(
        (~evidence & (grounding > 2) & ~free("evidence"), "evidence_grounding exceeds hard cap without concrete evidence"),
        (said("concrete_source_grounding", "NO") & (grounding > 2) & ~free("evidence"), "evidence_grounding exceeds checklist NO cap"),
        (said("concrete_source_grounding", "PARTIAL") & (grounding > 3) & ~free("evidence"), "evidence_grounding exceeds checklist PARTIAL cap"),
        (~shape & (formalizing > 3) & ~free("formal"), "formalizability exceeds hard cap without visible formal structure"),
        (~formal & ~setup & (formalizing > 3) & ~free("formal"), "formalizability exceeds cap while formal_problem_statement and setup are not provided"),
        (said("formal_problem_skeleton", "NO") & (formalizing > 2) & ~free("formal"), "formalizability exceeds checklist NO skeleton cap"),
        (said("formal_problem_skeleton", "PARTIAL") & (formalizing > 3) & ~free("formal"), "formalizability exceeds checklist PARTIAL skeleton cap"),
        (~path & (s("actionability") > 3) & ~free("action"), "actionability exceeds hard cap without clear evaluation/action path"),
        (said("clear_evaluation_path", "NO") & (s("actionability") > 3) & ~free("action"), "actionability exceeds checklist NO evaluation path cap"),
        ((grounding <= 2) & (formalizing <= 3) & (priority > 3) & ~free("pursuit"), "pursuit_priority exceeds cap despite weak evidence and formalizability"),
        ((s("feasibility") <= 2) & (priority > 3) & ~free("pursuit"), "pursuit_priority exceeds cap despite low feasibility"),
        ((s("actionability") <= 2) & (priority > 3) & ~free("pursuit"), "pursuit_priority exceeds cap despite low actionability"),
        (weak & (s("auditability_overall") > 3) & ~free("audit"), "auditability_overall exceeds cap despite weak or missing evidence/formalization structure"),
    )


def calibration_flags(fields: tuple[str, ...] = FIELDS) -> Column:
    """Soft flags of independent scores (1 to 5)."""
    s, text = _score, F.lower(whole_text(fields))
    evidence, shape = concrete_evidence(fields), formal_structure(fields)
    known = text.rlike(ascii_words(r"\b(apply|application|extend|use)\b")) & text.rlike(ascii_words(r"\b(known|existing|standard)\b"))
    basis = (s("clarity_specificity") >= 4) & (s("significance") >= 4) & (s("feasibility") >= 4) & ((s("evidence_grounding") >= 4) | (s("formalizability") >= 4))
    return _rules(
        (~evidence & (s("evidence_grounding") > 2), "evidence_grounding_above_2_without_concrete_source_evidence"),
        (~evidence & (s("auditability_overall") > 3), "auditability_above_3_without_concrete_source_evidence"),
        (~shape & (s("formalizability") > 3), "formalizability_above_3_without_visible_formal_structure"),
        (~shape & (s("auditability_overall") > 3), "auditability_above_3_without_visible_formal_structure"),
        (known & (s("non_incrementality") > 3), "non_incrementality_above_3_for_apparent_known_method_application"),
        (~action_path() & (s("actionability") > 3), "actionability_above_3_without_evaluation_plan"),
        ((s("evidence_grounding") <= 2) & (s("formalizability") <= 3) & (s("pursuit_priority") > 3), "pursuit_priority_above_3_despite_weak_evidence_and_formalizability"),
        ((s("feasibility") <= 2) & (s("pursuit_priority") > 3), "pursuit_priority_above_3_despite_low_feasibility"),
        ((s("pursuit_priority") == 5) & ~basis, "pursuit_priority_5_without_strong_specific_feasible_grounded_basis"),
    )


def _word(*labels: str) -> str:
    """A pattern of labels as whole words."""
    each = ["".join("\\" + c if not c.isalnum() and c != " " else c for c in n.lower()) for n in labels]
    return r"(?<![\p{L}\p{N}_])(?:" + "|".join(each) + r")(?![\p{L}\p{N}_])"


def method_labels(text: Column, labels: tuple[str, ...] = HIDDEN) -> Column:
    """Labels of methods that stand in a text as whole words, whatever the case."""
    return _rules(*[(F.lower(text).rlike(_word(n)), n) for n in labels])


def has_method_label(text: Column, labels: tuple[str, ...] = HIDDEN) -> Column:
    """Whether :func:`method_labels` finds any; the text is lowered once, not for each label."""
    return F.coalesce(F.lower(text).rlike(_word(*labels)), F.lit(False)) if labels else F.lit(False)


def score_keys(criteria: tuple[str, ...], low: int, high: int, scores: str = "scores") -> Column:
    """Criteria that are missing, unknown, no integers, or outside the scale."""
    known, given = F.array(*[F.lit(c) for c in criteria]), F.coalesce(F.map_keys(scores), F.array().cast("array<string>"))
    entries = F.coalesce(F.map_entries(scores), F.array().cast("array<struct<key:string,value:string>>"))
    integer = lambda e: F.coalesce(e["value"].rlike(r"^-?\d+$"), F.lit(False))
    tag = lambda name: lambda k: F.concat(F.lit(f"{name}:"), k)
    # each entry is looked at once: lambdas and what they take are evaluated anew wherever they stand
    fault = lambda e: F.when(~e["key"].isin(*criteria), tag("unknown")(e["key"])).when(~integer(e), tag("no_integer")(e["key"])).when(~e["value"].try_cast("bigint").between(low, high), tag("range")(e["key"]))
    return F.sort_array(F.concat(F.transform(F.array_except(known, given), tag("missing")), F.array_compact(F.transform(entries, fault))))


def _filled(x: str) -> Column:
    return F.coalesce(F.exists(x, lambda v: F.trim(v) != ""), F.lit(False))


def reply_violations(rubric: Rubric, expected: dict[str, Column], labels: tuple[str, ...] = HIDDEN) -> Column:
    """A scoring reply against its candidate: ids, score keys and scale, action, confidence, filled lists and rationale, no method label.

    ``expected`` gives the value of every reply column that must agree (candidate_id, domain or profile, role_id).
    """
    own = F.concat_ws("\n", F.col("rationale"), F.array_join("strengths", "\n"), F.array_join("weaknesses", "\n"))
    checks = [(F.coalesce(F.col(k).cast("string") != v.cast("string"), F.lit(True)), f"{k}_mismatch") for k, v in expected.items()]
    checks += [
        (~F.coalesce(F.col("recommended_action").isin(*ACTIONS), F.lit(False)), "invalid_recommended_action"),
        (~F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False)), "invalid_confidence"),
        (~_filled("strengths"), "no_strengths"),
        (~_filled("weaknesses"), "no_weaknesses"),
        (F.trim(_text("rationale")) == "", "no_rationale"),
        (has_method_label(own, labels), "method_label"),
    ]
    return F.concat(_rules(*checks), score_keys(rubric.criteria, rubric.low, rubric.high))


def side_violations(criteria: tuple[str, ...], low: int = 1, high: int = 5, preferences: tuple[str, ...] = ("A", "B", "TIE", "CANNOT_JUDGE")) -> Column:
    """A pair reply with scores of both sides."""
    side = lambda x: F.transform(score_keys(criteria, low, high, f"candidate_{x}_scores"), lambda v: F.concat(F.lit(f"{x}."), v))
    rest = _rules(
        (~F.coalesce(F.col("pairwise_preference").isin(*preferences), F.lit(False)), "invalid_preference"),
        (~F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False)), "invalid_confidence"),
        (F.trim(_text("rationale")) == "", "no_rationale"),
    )
    return F.concat(side("a"), side("b"), rest)


def preference_violations(pair_id: Column, labels: tuple[str, ...] = HIDDEN) -> Column:
    """A preference reply: its pair, winner, a winner for every criterion, three texts, no method label."""
    known, given = F.array(*[F.lit(c) for c in PREFERENCE]), F.coalesce(F.map_keys("criterion_winners"), F.array().cast("array<string>"))
    values = F.coalesce(F.map_values("criterion_winners"), F.array().cast("array<string>"))
    texts = ("why_winner", "candidate_a_weakness", "candidate_b_weakness")
    return _rules(
        (F.coalesce(F.col("pair_id") != pair_id, F.lit(True)), "pair_id_mismatch"),
        (~F.coalesce(F.col("winner").isin("A", "B", "TIE", "CANNOT_JUDGE"), F.lit(False)), "invalid_winner"),
        (~F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False)), "invalid_confidence"),
        ((F.size(F.array_except(known, given)) > 0) | (F.size(F.array_except(given, known)) > 0), "criterion_winners_keys"),
        (F.exists(values, lambda v: ~F.coalesce(v.isin("A", "B", "TIE"), F.lit(False))), "criterion_winners_values"),
        *[(F.trim(_text(t)) == "", f"no_{t}") for t in texts],
        (has_method_label(F.concat_ws("\n", *texts), labels), "method_label"),
    )


def ranking_violations(rows: DataFrame, packets: DataFrame, criteria: tuple[str, ...] = PREFERENCE, size: int = 4) -> DataFrame:
    """(packet_id, violations) of four-way rankings (packet_id, criterion, candidate_id, rank, reason) against their packets (packet_id, candidate_id).

    Ties are allowed; every criterion must rank every candidate of its packet exactly once, between 1 and ``size``, with a reason.
    """
    known = packets.select("packet_id", F.col("candidate_id"), F.lit(True).alias("known"))
    marked = rows.join(known, ["packet_id", "candidate_id"], "left")
    by = marked.groupBy("packet_id", "criterion").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("candidate_id").alias("d"), F.bool_or(F.col("known").isNull()).alias("stranger"),
        F.bool_or(F.coalesce(~F.col("rank").between(1, size), F.lit(True))).alias("off"), F.bool_or(F.trim(_text("reason")) == "").alias("bare"),
    )
    wrong = by.select("packet_id", "criterion", F.explode_outer(_rules(
        (~F.col("criterion").isin(*criteria), "unknown_criterion"), (F.col("n") != size, "row_count"), (F.col("stranger"), "unknown_candidate"),
        (F.col("off"), "rank_range"), (F.col("bare"), "no_reason"), ((F.col("d") != F.col("n")) | (F.col("d") != size), "not_once_each"),
    )).alias("rule"))
    listed = wrong.groupBy("packet_id").agg(
        F.collect_set(F.when(F.col("rule").isNotNull(), F.concat_ws(":", "rule", "criterion"))).alias("bad"), F.collect_set("criterion").alias("seen")
    )
    missing = F.transform(F.array_except(F.array(*[F.lit(c) for c in criteria]), F.coalesce("seen", F.array().cast("array<string>"))), lambda c: F.concat(F.lit("missing:"), c))
    every = packets.select("packet_id").distinct().join(listed, "packet_id", "left")
    return every.select("packet_id", F.array_sort(F.concat(missing, F.coalesce("bad", F.array().cast("array<string>")))).alias("violations"))


def batch_violations(rows: DataFrame, expected: DataFrame, tasks: int | None = None) -> DataFrame:
    """(batch, violations) of batch replies (batch, candidate_id, rank, checklist map) against the expected candidates (batch, candidate_id, position).

    With ``tasks``, which should follow the rows, batches are counted by so many tasks, whatever the session's shuffle partitions.  Ids agree, ranks are 1..n without ties and not the input's order, checklists have their six keys with YES, PARTIAL or NO.
    """
    known = F.array(*[F.lit(c) for c in CHECKLIST])
    keys, values = F.map_keys("checklist"), F.map_values("checklist")
    bad = (F.size(F.array_except(known, keys)) > 0) | (F.size(F.array_except(keys, known)) > 0) | F.exists(values, lambda v: ~v.isin("YES", "PARTIAL", "NO"))
    both = expected.join(rows.select("batch", "candidate_id", "rank", F.coalesce(bad, F.lit(True)).alias("bad"), F.lit(True).alias("given")), ["batch", "candidate_id"], "full")
    both = both.repartition(tasks, "batch") if tasks else both
    by = both.groupBy("batch").agg(
        F.count_if(F.col("given").isNull()).alias("missing"), F.count_if(F.col("position").isNull()).alias("extra"), F.count(F.lit(1)).alias("n"),
        F.countDistinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.bool_and(F.col("rank") == F.col("position")).alias("same"),
        F.bool_or(F.coalesce("bad", F.lit(False))).alias("bad"),
    )
    complete = (F.col("d") == F.col("n")) & (F.col("lo") == 1) & (F.col("hi") == F.col("n"))
    return by.select("batch", _rules(
        (F.col("missing") > 0, "missing_candidates"), (F.col("extra") > 0, "unknown_candidates"), (F.col("bad"), "checklist"),
        (~F.coalesce(complete, F.lit(False)), "incomplete_ranking"), (F.coalesce(F.col("same"), F.lit(False)) & (F.col("n") > 1), "mirrors_input_order"),
    ).alias("violations"))


def merged_roles(rows: DataFrame) -> DataFrame:
    """One row per candidate from its roles' rows (candidate_id, role, confidence, triggered, broken, valid): least confidence, distinct rules, validity."""
    order = F.when(F.col("confidence") == "LOW", 0).when(F.col("confidence") == "MEDIUM", 1).when(F.col("confidence") == "HIGH", 2)
    return rows.groupBy("candidate_id").agg(
        F.coalesce(F.min_by("confidence", order), F.lit("LOW")).alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("triggered")))).alias("cap_rules_triggered"),
        F.array_sort(F.flatten(F.collect_list("broken"))).alias("cap_violations"),
        F.array_sort(F.collect_set(F.when(~F.col("valid"), F.col("role")))).alias("invalid_roles"),
    ).withColumn("valid_for_run", (F.size("cap_violations") == 0) & (F.size("invalid_roles") == 0))


def best_of_method(rows: DataFrame, limit: int = 1) -> DataFrame:
    """The best candidate of each (domain, method) by score, then title, then place; a group's ranks are pruned before the shuffle."""
    order = Window.partitionBy("domain", "method").orderBy(F.desc("score"), F.lower("title"), "place")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
