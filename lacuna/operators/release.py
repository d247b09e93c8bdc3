"""Release audit: patterns that must not appear in published texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.text import ascii_words

# Kinds of findings and their patterns.
PATTERNS = {
    "assigned_secret": r"(?i)(?:api_?key|secret|token|password)\s*[:=]\s*[\"']?[A-Za-z0-9_\-]{12,}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "private_path": r"/(?:home|Users)/[A-Za-z0-9_.-]+",
    "long_hex": r"\b[0-9a-f]{32,}\b",
}


def findings(texts: DataFrame) -> DataFrame:
    """(id, kind, n) for every text and pattern with a match."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count("text", F.lit(ascii_words(p))).cast("long").alias("n")) for k, p in PATTERNS.items()])
    return texts.select("id", F.explode(kinds).alias("f")).select("id", "f.kind", "f.n").where("n > 0")
