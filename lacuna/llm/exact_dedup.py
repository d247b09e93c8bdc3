"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one counts, with map-side combining, how often each slot of a Bloom filter is hit by the documents' hashes;
slots hit twice or more form the filter of possibly repeated hashes, kept as bitmaps.  Pass two tests every row against that
filter: only rows whose slots are all repeated are shuffled and grouped by digest, the rest pass straight through
as groups of one.  A false positive costs a shuffled row and never changes a result.

The filter grows with the rows.  Up to ``BROADCAST_BITS`` its bitmaps are broadcast whole.  Beyond, they are too large for that: the bitmaps stay
partitioned by page, the rows' hashes alone (not the rows) are sent to the pages, once for each hash function and after the first one only those that
passed it, and the hashes that are left come back to the rows, by broadcast if they are few and in a shuffled join otherwise.

Defined cases: a null text counts as empty; empty texts are equal to one another; rows repeating a doc_id count as
rows of the group and carry the same decision; an empty table gives an empty result; other columns are ignored.
A null doc_id groups by its text, is never the row that stays unless all ids of the group are null, and is then kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, attach_group

#: Two hash functions; slots per row; the least filter; the largest one that is broadcast, in bits (32 MiB).
HASHES, SLOTS_PER_ROW, MIN_BITS, BROADCAST_BITS = 2, 32, 1 << 18, 1 << 28
PAGE = 32768  # bits in one built-in bitmap
#: Hashes that come back to the rows by broadcast at most (16 MB).
BROADCAST_HASHES = 1_000_000


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def filter_bits(rows: int) -> int:
    """A power of two, so many slots for every row."""
    return max(MIN_BITS, 1 << (rows * SLOTS_PER_ROW - 1).bit_length())


def _slot(h: Column, which: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(which)), F.lit(bits))


def repeated_slots(digests: DataFrame, bits: int) -> DataFrame:
    """Pass one: (page, map) bitmaps of the slots that two rows or more have hit."""
    slots = digests.select(F.explode(F.array(*[_slot(F.col("h"), i, bits) for i in range(HASHES)])).alias("slot"))
    often = slots.groupBy("slot").count().where("count > 1")
    return often.groupBy((F.col("slot") / PAGE).cast("long").alias("page")).agg(
        F.bitmap_construct_agg(F.col("slot") % PAGE).alias("map")
    )


def _hit(slot: str, bitmap: str) -> Column:
    """Whether a slot's bit is set in its page's bitmap; a missing page has none."""
    bit = F.col(slot) % PAGE
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast({slot} % 8 as int))")) != 0, F.lit(False))


def possibly_repeated(digests: DataFrame, pages: DataFrame, bits: int) -> DataFrame:
    """Pass two with a filter of BROADCAST_BITS at most: adds ``maybe``."""
    out = digests
    for i in range(HASHES):
        p, m = f"_p{i}", f"_m{i}"
        side = F.broadcast(pages.select(F.col("page").alias(p), F.col("map").alias(m)))
        out = out.withColumn(f"_s{i}", _slot(F.col("h"), i, bits))
        out = out.join(side, (F.col(f"_s{i}") / PAGE).cast("long") == F.col(p), "left")
        out = out.withColumn(f"_b{i}", _hit(f"_s{i}", m)).drop(p, m)
    maybe = F.col("_b0")
    for i in range(1, HASHES):
        maybe = maybe & F.col(f"_b{i}")
    return out.withColumn("maybe", maybe).select("doc_id", "h", "text_sha256", "maybe")


def possibly_repeated_by_page(digests: DataFrame, pages: DataFrame, bits: int, tables: Tables) -> DataFrame:
    """Pass two with a larger filter: hashes meet the bitmaps page by page, those that pass mark the rows.

    A page's share of the hashes is even but for copies of one text, which skewed-join handling splits (the bitmaps' side is unique).
    """
    left = digests.select("h")
    for i in range(HASHES):
        slot = left.withColumn("_s", _slot(F.col("h"), i, bits)).withColumn("page", (F.col("_s") / PAGE).cast("long"))
        left = slot.join(pages, "page").where(_hit("_s", "map")).select("h")
    hashes = tables.write(left.distinct(), "repeated").withColumn("_hit", F.lit(True))
    few = hashes.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES
    marked = digests.join(F.broadcast(hashes) if few else hashes, "h", "left")
    return marked.select("doc_id", "h", "text_sha256", F.coalesce("_hit", F.lit(False)).alias("maybe"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    text = normalised(F.col("text"))
    tables = Tables(spark, "exact-dedup")
    digests = tables.write(
        docs.select("doc_id", text.alias("_n")).select(
            "doc_id", F.xxhash64("_n").alias("h"), F.sha2("_n", 256).alias("text_sha256")
        ),
        "digests",
    )
    total = digests.count()
    bits = filter_bits(total)
    pages = repeated_slots(digests, bits)
    if bits <= BROADCAST_BITS:
        marked = possibly_repeated(digests, pages, bits)
    else:
        marked = possibly_repeated_by_page(digests, tables.write(pages, "pages"), bits, tables)
    single = marked.where(~F.col("maybe")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    several = marked.where("maybe").select("doc_id", "text_sha256")
    groups = several.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = attach_group(several, groups, "text_sha256", "group_size", total)
    return single.unionByName(
        found.select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
        )
    )
