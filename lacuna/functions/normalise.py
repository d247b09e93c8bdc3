"""Normal forms of labels, titles, slugs and replies; on the JVM except where NFKD is needed."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions import vectorised
from lacuna.functions.text import _c, bounded, squash

# Raised and lowered digits, wrappers of decorated letters, Greek letters that are spelled out.
RAISED, RAISED_AS = "⁰¹²³⁴⁵⁶⁷⁸⁹ⁿᵐ", "0123456789nm"
LOWERED, LOWERED_AS = "₀₁₂₃₄₅₆₇₈₉", "0123456789"
WRAPPERS = ("tilde", "hat", "widetilde", "bar", "mathcal", "mathrm")
GREEK = {"[Ωω]": "Omega", "[Θθ]": "Theta"}
#: Fixed value: an acronym in brackets at a label's end.
TRAILING_ACRONYM = r"\(([A-Z][A-Z0-9\-]+)\)\s*$"
#: What a label has if folding changes more than its outer spaces and its case.
FOLDED = r"[\t\n\x0B\f\r\\^{}(" + RAISED + LOWERED + "".join(GREEK).replace("[", "").replace("]", "") + "]|  "


def normalized_math(x: Column | str) -> Column:
    """Equal bounds become equal strings: raised and lowered digits, LaTeX wrappers, carets and braces go, Greek letters are spelled."""
    flat = F.translate(F.translate(_c(x), RAISED, RAISED_AS), LOWERED, LOWERED_AS)
    bare = F.regexp_replace(flat, r"\\(?:" + "|".join(WRAPPERS) + r")\{([^}]*)\}", "$1")
    plain = F.translate(F.regexp_replace(bare, r"\^\{([^}]*)\}", "$1"), "^{}", "")
    return functools.reduce(lambda c, kv: F.regexp_replace(c, *kv), GREEK.items(), plain)


def trailing_acronym(x: Column | str) -> Column:
    """The acronym in brackets at the end, else null."""
    return F.nullif(F.regexp_extract(_c(x), TRAILING_ACRONYM, 1), F.lit(""))


def normalized_label(x: Column | str) -> Column:
    """The form that identifies a graph node: math folded, trailing acronym dropped, white space squashed, lower case.

    Labels with nothing to fold, as one search tells, are only trimmed and lowered: the folding's steps are many times as dear.  They stand in a
    lambda, as spelled out for two labels of a row they make a generated method of over 8000 bytes, which the JVM does not compile.
    """
    folded = F.transform(F.array(_c(x)), lambda v: squash(F.regexp_replace(F.trim(normalized_math(v)), r"\s*" + TRAILING_ACRONYM, "")))
    return F.lower(F.when(_c(x).rlike(FOLDED), F.get(folded, F.lit(0))).otherwise(F.trim(_c(x))))


def path_slug(x: Column | str, limit: int = 80) -> Column:
    """Safe in paths: other characters become underscores, at most ``limit`` characters, lower case; ``item`` if nothing is left."""
    kept = F.substring(F.trim(F.regexp_replace(F.trim(_c(x)), r"[^A-Za-z0-9._-]+", "_"), F.lit("_")), 1, limit)
    return F.lower(F.coalesce(F.nullif(kept, F.lit("")), F.lit("item")))


def _ascii_words(x: Column | str, by: str) -> Column:
    return F.trim(F.regexp_replace(vectorised.ascii_lower(F.coalesce(_c(x), F.lit(""))), "[^a-z0-9]+", by), F.lit(by))


def ascii_slug(x: Column | str, fallback: str = "") -> Column:
    """NFKD, ASCII letters and digits, underscores between; ``fallback`` if nothing is left."""
    return F.coalesce(F.nullif(_ascii_words(x, "_"), F.lit("")), F.lit(fallback))


def ascii_title(x: Column | str) -> Column:
    """NFKD, ASCII letters and digits, single spaces between."""
    return _ascii_words(x, " ")


def first_text(*values: Column | str) -> Column:
    """The first value with other than white space, squashed; else empty."""
    return F.coalesce(*[F.nullif(squash(v), F.lit("")) for v in values], F.lit(""))


def as_bool(x: Column | str) -> Column:
    """1, true, yes and on, whatever the case."""
    return F.lower(F.trim(_c(x).cast("string"))).isin("1", "true", "yes", "on")


def as_double(x: Column | str, default: float | None = None) -> Column:
    """Number or default; never fails."""
    return F.coalesce(_c(x).cast("string").try_cast("double"), F.lit(default).cast("double"))


def clipped(x: Column | str, head: int = 20_000, tail: int = 4_000, mark: str = "\n...\n") -> Column:
    """Head and tail of a text that is longer than both."""
    t = _c(x)
    return F.when(F.length(t) <= head + tail, t).otherwise(F.concat(F.substring(t, 1, head), F.lit(mark), F.right(t, F.lit(tail))))


def sorted_first_words(words: Column, k: int = 6) -> Column:
    """Coarse key of a theme: the first ``k`` words in order, joined."""
    return F.array_join(F.slice(F.array_sort(F.array_distinct(words)), 1, k), "|")


def sections_by_label(x: Column | str, labels: tuple[str, ...]) -> Column:
    """Map from label to the text between ``Label:`` at a line's start and the next label."""
    stop = "|".join(labels)
    found = {n: F.trim(F.regexp_extract(_c(x), rf"(?ims)^\s*\**{n}\**\s*:\s*(.*?)(?=^\s*\**(?:{stop})\**\s*:|\z)", 1)) for n in labels}
    return F.map_filter(F.create_map(*[y for n, c in found.items() for y in (F.lit(n), c)]), lambda _, v: v != "")


def latex_escaped(x: Column | str) -> Column:
    """LaTeX's special characters as commands."""
    escaped = F.regexp_replace(F.regexp_replace(_c(x), r"\\", "\u0001"), r"([&%$#_{}])", r"\\$1")
    for a, b in (("\u0001", r"\\textbackslash{}"), ("~", r"\\textasciitilde{}"), (r"\^", r"\\textasciicircum{}")):
        escaped = F.regexp_replace(escaped, a, b)
    return escaped


def html_escaped(x: Column | str) -> Column:
    out = _c(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def flattened(schema, prefix: str = "") -> list[Column]:
    """Select list with dotted names for every leaf of nested structs."""
    out = []
    for f in schema.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        out += flattened(f.dataType, path) if hasattr(f.dataType, "fields") else [F.col(".".join(f"`{p}`" for p in path.split("."))).alias(path)]
    return out


def blend(parts: dict[str, float]) -> Column:
    """Weighted sum of bounded columns."""
    return functools.reduce(lambda a, b: a + b, [bounded(F.col(k)) * w for k, w in parts.items()])
