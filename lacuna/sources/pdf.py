"""Texts of PDF files: an installed parser where there is one, else a small reader of content streams; failures are rows with a status."""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, sha256 string, text string, pages int, parser string, status string, error string"
_STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<[^<>]*>|<<(?:[^<>]|<[^<>]*>)*>>)*)>>\s*stream\r?\n(?P<body>.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]*|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_NUMBER = re.compile(rb"[-+]?\d*\.?\d+")
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


def _literal(token: bytes) -> str:
    """A string of a content stream, in Latin-1 or, with its mark, UTF-16."""
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _PLAIN.get(m[1], m[1]), token[1:-1])
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def _shown(stream: bytes) -> str:
    """What a content stream shows: strings of Tj, TJ, ' and ", wide kerning as a space, moves and text ends as line ends."""
    out, waiting, array = [], [], False
    for m in _TOKEN.finditer(stream):
        t = m[0]
        if t[:1] in b"(<":
            waiting.append(_literal(t))
        elif t in (b"[", b"]"):
            array = t == b"["
        elif array:
            if _NUMBER.fullmatch(t) and float(t) < -200:
                waiting.append(" ")
        elif re.fullmatch(rb"[A-Za-z'\"*]+", t):
            if t in (b"'", b'"'):
                out.append("\n")
            if t in (b"Tj", b"TJ", b"'", b'"'):
                out.extend(waiting)
            elif t in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
                out.append("\n")
            waiting = []
    return re.sub(r"\n+", "\n", "".join(out)).strip()


def _streams(content: bytes) -> tuple[str, int]:
    if not content.lstrip()[:5] == b"%PDF-":
        raise ValueError("no PDF")
    texts, objects = [], [content]
    for m in _STREAM.finditer(content):
        body, head = m["body"], m["head"]
        if b"FlateDecode" in head:
            body = zlib.decompressobj().decompress(body)
        elif b"/Filter" in head:
            continue
        if b"ObjStm" in head:
            objects.append(body)
        elif b"BT" in body:
            texts.append(_shown(body))
    pages = sum(len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", o)) for o in objects)
    return "\n".join(t for t in texts if t), pages


def _library(content: bytes) -> tuple[str, int]:
    from pypdf import PdfReader

    found = PdfReader(io.BytesIO(content)).pages
    return "\n".join(p.extract_text() or "" for p in found), len(found)


def text_of(content: bytes) -> tuple[str, int, str]:
    """(text, pages, parser): the library's, or the small reader's where the library is missing or fails."""
    try:
        return (*_library(content), "library")
    except Exception:
        return (*_streams(content), "streams")


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    for frame in frames:
        rows = []
        for path, content in zip(frame["path"], frame["content"], strict=True):
            content = bytes(content)
            try:
                text, pages, parser = text_of(content)
                row = (text, pages, parser, "ok", None)
            except Exception as e:  # a broken file is a row with its error
                row = (None, 0, None, "failed", f"{type(e).__name__}: {e}")
            rows.append((path, hashlib.sha256(content).hexdigest(), *row))
        yield pd.DataFrame(rows, columns=["path", "sha256", "text", "pages", "parser", "status", "error"])


def parsed(spark: SparkSession, path: str, least: int = 1000) -> DataFrame:
    """One row per PDF file under ``path``: its digest, text, pages, parser and status (ok, short_text or failed)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", "content").mapInPandas(_parse, SCHEMA)
    return rows.withColumn("status", F.when((F.col("status") == "ok") & (F.length("text") < least), "short_text").otherwise(F.col("status")))


def title_line(text: Column | str, fallback: Column | str) -> Column:
    """The first line that may be a title (12 to 200 characters, three words or more), else the fallback."""
    lines = F.transform(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"\n"), lambda x: F.trim(x))
    fit = F.filter(lines, lambda x: F.length(x).between(12, 200) & (F.size(F.split(x, r"\s+")) >= 3))
    return F.coalesce(F.get(fit, F.lit(0)), F.col(fallback) if isinstance(fallback, str) else fallback)


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed papers from PDF files, marked as incomplete: authors and year are not known."""
    rows = parsed(spark, path)
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"(?i)\.pdf$", "")
    return rows.select(F.concat(F.lit("pdf:"), F.substring("sha256", 1, 16)).alias("paper_id"), title_line("text", name).alias("title"), F.lit(True).alias("metadata_incomplete"), "status", "pages")


def statuses(seeds_: DataFrame, cached: DataFrame) -> DataFrame:
    """Seeds (paper_id) with what a cache (paper_id, sha256, error) knows of their files: cached, failed or missing."""
    status = F.when(F.col("sha256").isNotNull(), "cached").when(F.col("error").isNotNull(), F.concat(F.lit("failed: "), "error")).otherwise("missing")
    return seeds_.join(cached.dropDuplicates(["paper_id"]), "paper_id", "left").withColumn("download_status", status).drop("error")
