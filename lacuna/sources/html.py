"""Saved HTML pages: titles and marked elements by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.text import squash


def title(html: Column | str) -> Column:
    return squash(F.regexp_extract(F.col(html) if isinstance(html, str) else html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def titles(pages: DataFrame) -> DataFrame:
    return pages.withColumn("title", title("html"))


def by_class(html: Column | str, name: str) -> Column:
    """Texts of the anchors whose class attribute holds ``name``, inner tags stripped."""
    found = F.regexp_extract_all(F.col(html) if isinstance(html, str) else html, F.lit(rf'(?is)<a[^>]*class="[^"]*\b{name}\b[^"]*"[^>]*>(.*?)</a>'), F.lit(1))
    return F.filter(F.transform(found, lambda x: squash(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: x != "")


#: What a page says that answers with a barrier instead of its content.
BARRIERS = ("unusual traffic", "not a robot", "captcha", "please show you're not a robot")


def blocked(html: Column | str) -> Column:
    """Whether a saved page is a barrier and no content."""
    page = F.lower(F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")))
    return F.exists(F.array(*[F.lit(b) for b in BARRIERS]), lambda b: F.contains(page, b))


def profile_titles(pages: DataFrame | None, export: DataFrame | None, name: str, most: int) -> DataFrame:
    """(title, rank, source) of a profile: from its saved page unless that is missing, blocked or without titles, else from its export's title column.

    Titles keep their first place; at most ``most`` stay, which is the feature.
    """
    out = None
    if pages is not None:
        shown = pages.where(~blocked("html")).select(F.posexplode(by_class("html", name)).alias("rank", "title"), F.lit("page").alias("source"))
        out = shown if not shown.isEmpty() else None
    if out is None and export is not None:
        column = next(c for c in export.columns if c.lower() == "title")
        out = export.select(F.monotonically_increasing_id().alias("rank"), F.trim(column).alias("title"), F.lit("export").alias("source"))
    if out is None:
        raise ValueError("a profile needs a saved page with titles or an export")
    first = out.where(F.coalesce("title", F.lit("")) != "").groupBy("title", "source").agg(F.min("rank").alias("rank"))
    return first.orderBy("rank").limit(most)
