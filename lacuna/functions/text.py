"""Identifiers, normalisers, tokenisers and set similarity as column expressions; all of them stay on the JVM."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """prefix, colon, first 16 hex digits of the SHA-1 of the non-null parts joined by newlines."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(F.concat_ws("\n", *[_c(p).cast("string") for p in parts])), 1, 16))


def bounded(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x between low and high; null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


#: Where a word of ASCII letters, digits and _ begins, and where it begins or ends.
BEGIN, EDGE = r"(?=\w)(?<!\w)", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def ascii_words(pattern: str) -> str:
    """The pattern with edges and blanks of ASCII, and a dot for all but line feeds: Java's ``\\b`` counts letters beyond ASCII, depending on its version.

    An edge before a group or a class is a word's beginning: their alternatives begin with letters or digits.
    """
    return "(?d)" + pattern.replace(r"\b(", f"{BEGIN}(").replace(r"\b[", f"{BEGIN}[").replace(r"\b", EDGE).replace(r"\s", r"[\t\n\f\r ]")


def squash(x: Column | str) -> Column:
    """White-space runs as one space, none at either end."""
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def normalized_title(x: Column | str) -> Column:
    """Lower case, letters, digits, underscores and single spaces only."""
    return squash(F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{N}_\s]", ""))


def bare_arxiv(x: Column | str) -> Column:
    """Without its version."""
    return F.regexp_replace(F.trim(_c(x)), r"v\d+$", "")


# resolvers' addresses; their characters are stripped from the left of a DOI, one address after the other.
DOI_LEADS = ("https://doi.org/", "http://dx.doi.org/")


def bare_doi(x: Column | str) -> Column:
    """Lower case; leading characters that occur in the first resolver's address go, then those of the second."""
    return functools.reduce(lambda c, lead: F.ltrim(c, F.lit(lead)), DOI_LEADS, F.trim(F.lower(_c(x))))


def tokens(x: Column | str, pattern: str = "[a-z0-9]{3,}") -> Column:
    """Distinct lower-case tokens in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(x)), F.lit(f"({pattern})"), F.lit(1)))


def words(x: Column | str) -> Column:
    """White-space separated words, empty ones dropped."""
    return F.filter(F.split(_c(x), r"\s+"), lambda w: w != "")


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of two arrays taken as sets; 0 if either is empty."""
    a, b = _c(a), _c(b)
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def contains_any(x: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(x, F.lit(p))
    return found


def count_phrases(x: Column, phrases: list[str]) -> Column:
    """How many of the phrases the text contains."""
    total = F.lit(0)
    for p in phrases:
        total = total + F.contains(x, F.lit(p)).cast("int")
    return total


def matched_phrases(x: Column, phrases: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(x, F.lit(p)), F.lit(p)) for p in phrases]))


def slug(x: Column | str, limit: int = 80) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-"), F.lit("-")), 1, limit)


def coerced_enum(x: Column | str, valid: list[str], aliases: dict[str, str], default: str) -> Column:
    """Trimmed lower-case value if valid, else its alias, else the default."""
    v = F.lower(F.trim(_c(x)))
    table = F.create_map(*[F.lit(y) for kv in ({k: k for k in valid} | aliases).items() for y in kv])
    return F.coalesce(F.try_element_at(table, v), F.lit(default))


def clamped_confidence(x: Column | str, default: float = 0.5) -> Column:
    return F.coalesce(bounded(F.expr(f"try_cast({x} AS double)") if isinstance(x, str) else x.try_cast("double")), F.lit(default))


def confidence_from_text(x: Column | str) -> Column:
    """First number in the text; numbers over 1 are percentages; none gives 0."""
    v = F.regexp_extract(_c(x), r"(\d+(?:\.\d+)?)", 1)
    number = F.when(v == "", F.lit(0.0)).otherwise(v.try_cast("double"))
    return bounded(F.when(number > 1, number / 100).otherwise(number))


def token_estimate(x: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(_c(x)) / 4).cast("int"))


def truncated(x: Column | str, n: int) -> Column:
    t = squash(x)
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n - 3)), F.lit("..."))).otherwise(t)


def replaced_words(x: Column | str, table: dict[str, str], inner: str = r"A-Za-z0-9_\-") -> Column:
    """Whole-word replacements whatever the case, in the table's order; words end where no ``inner`` character follows."""
    out = _c(x)
    for word, by in table.items():
        out = F.regexp_replace(out, rf"(?i)(?<![{inner}]){re.escape(word)}(?![{inner}])", by)
    return out


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def repaired_json(x: Column | str) -> Column:
    """Fences, text outside the outer braces, smart quotes and trailing commas removed."""
    t = F.regexp_replace(_c(x), r"```[a-zA-Z]*", "")
    t = F.translate(t, "“”‘’", "\"\"''")
    t = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.regexp_replace(t, r",\s*([}\]])", "$1")
