"""Fill-in-middle transformation: texts cut in three by units, the middle moved to the end behind sentinels.

Units are matched left to right: a class-changing ASCII character (white space) is one; other characters fall into units of up to ``width`` of them, so
``width`` 1 makes every code point a unit.  One Aho-Corasick automaton finds the class-changing characters and the sentinels.  A gap of n characters
between two such events holds ceil(n / width) units, so the events alone, with the units before each, tell how many units there are, and the place
of the k-th is found by a binary search among the events and arithmetic in one gap.

Where the cuts fall, and the form of the output, follow four numbers from a hash of the document's id, so they repeat on any cluster:

* plain: the text as it is (empty, or it contains a sentinel, or the id is dealt so);
* psm: sentinel, prefix, sentinel, suffix, sentinel, middle;
* spm: sentinel, suffix, sentinel, prefix, sentinel, middle.

Sentinels must not be able to overlap, so that the first one of each kind in an output is the one put there and the text can be rebuilt from output and form.

Defined cases: a null text counts as empty; a null id is hashed as the empty word; repeated rows give equal results; texts of any length are
cut whole (events take some bytes each); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, column, small_batches

CHANGES = " \t\n\v\f\r"
CHANGE, SENTINEL = 0, 1


@dataclass(frozen=True)
class Middle:
    """Sentinels of prefix, suffix and middle; characters of a unit; documents of a hundred that change; of those, the spm ones; the hash's seed."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    width: int = 1
    changed: int = 90
    spm: int = 20
    seed: int = 1

    def __post_init__(self) -> None:
        marks = self.marks
        if self.width < 1 or not all(marks) or len(set(marks)) < 3:
            raise ValueError("three different sentinels and units of one character or more are needed")
        if any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)) + (a != b))) or any(a != b and a in b for a in marks for b in marks):
            raise ValueError("sentinels must not overlap or contain one another")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


@lru_cache(maxsize=8)
def automaton(marks: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for c in CHANGES:
        out.add_word(c, CHANGE)
    for mark in marks:
        out.add_word(mark, SENTINEL)
    out.make_automaton()
    return out


@dataclass(frozen=True)
class Events:
    """Places of a text's class-changing characters and the units before each; the number of all units; whether it holds a sentinel."""

    at: np.ndarray
    before: np.ndarray
    units: int
    width: int
    chars: int
    sentinel: bool

    @classmethod
    def scan(cls, text: str, how: Middle) -> Events:
        found = list(automaton(how.marks).iter(text)) if text else []
        at = np.fromiter((end for end, kind in found if kind == CHANGE), dtype=np.int64)
        sentinel = len(at) < len(found)
        gaps = np.diff(at, prepend=-1) - 1
        inside = -(-gaps // how.width)
        before = np.cumsum(inside) + np.arange(len(at))
        tail = len(text) - (int(at[-1]) + 1 if len(at) else 0)
        units = (int(before[-1]) + 1 if len(at) else 0) - (-tail // how.width)
        return cls(at, before, units, how.width, len(text), sentinel)

    def place(self, k: int) -> int:
        """Code points before the k-th unit, from 0 (k units: the text's end)."""
        if k >= self.units:
            return self.chars
        i = int(np.searchsorted(self.before, k, "left"))  # the first event that has k units before it, or more
        if i < len(self.at) and self.before[i] == k:
            return int(self.at[i])
        start, done = (int(self.at[i - 1]) + 1, int(self.before[i - 1]) + 1) if i else (0, 0)
        return start + (k - done) * self.width


def numbers(doc_id: int | None, seed: int) -> list[int]:
    """The first four 32-bit numbers of the id's hash."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def transform(doc_id: int | None, text: str, how: Middle) -> tuple:
    """n, form, prefix_chars, middle_chars and the output of one text."""
    events = Events.scan(text, how)
    n, (h1, h2, h3, h4) = events.units, numbers(doc_id, how.seed)
    if not text or events.sentinel or h3 % 100 >= how.changed:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = events.place(a), events.place(b)
    head, mid, tail = text[:i], text[i:j], text[j:]
    if h4 % 100 < how.spm:
        return n, "spm", i, j - i, how.suffix + tail + how.prefix + head + how.middle + mid
    return n, "psm", i, j - i, how.prefix + head + how.suffix + tail + how.middle + mid


def fill_in_middle(docs: DataFrame, how: Middle | None = None) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output."""
    how = how or Middle()
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(column(batch, "doc_id"), column(batch, "text"), strict=True)
            yield from batched(((i, *transform(i, t or "", how)) for i, t in rows), schema, 256)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, how: Middle | None = None) -> Column:
    """The text, rebuilt from output and form alone."""
    how = how or Middle()
    marks = (how.prefix, how.suffix, how.middle), (how.suffix, how.prefix, how.middle)

    def parts(first: str, second: str, third: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        a = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(a) + len(second) + 1, F.length(rest))
        b = F.substring_index(rest, third, 1)
        return a, b, F.substring(rest, F.length(b) + len(third) + 1, F.length(rest))

    (head, tail, mid), (late, early, inner) = parts(*marks[0]), parts(*marks[1])
    return F.when(form == "psm", F.concat(head, mid, tail)).when(form == "spm", F.concat(early, inner, late)).otherwise(output)


def middle_digests(docs: DataFrame) -> DataFrame:
    """The transformation's digests: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    done = fill_in_middle(docs)
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


def oracle_sql() -> str:
    """DuckDB SQL for :func:`middle_digests`."""
    return r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        k AS (
          SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
          FROM d),
        c AS (
          SELECT *, substr(text, 1, least(a, b)) AS head, substr(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS mid, substr(text, greatest(a, b) + 1) AS tail FROM k)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
          sha256(CASE form WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid WHEN 'spm' THEN '<S>' || tail || '<P>' || head || '<M>' || mid ELSE text END) AS output_sha256,
          sha256(text) AS restored_sha256
        FROM c"""
