"""Ranked ties, fill-in-middle and byte pairs against brute force, the library and on defined cases."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from lacuna.llm import byte_pairs, middle, ranked_ties
from tests.llm.test_corpus_operators import SCHEMA, by_id, frame

PATH = public_tokenizers.path(byte_pairs.DEFAULT)


# --- ranked ties ---

ORDER = ranked_ties.Order(("g", "h"), ("p", "q"), ("t", "u"))


def brute_ranks(rows, most):
    first = lambda x: (x is not None, x or 0)
    last = lambda x: (x is None, x or 0)
    out, groups = [], {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r)
    for own in groups.values():
        own.sort(key=lambda r: (first(r[2]), first(r[3]), last(r[4]), last(r[5])))
        for i, r in enumerate(own):
            same = [j for j, o in enumerate(own) if o[2:4] == r[2:4]]
            if same[0] + 1 <= most:
                out.append((*r, i + 1, same[0] + 1, len(same)))
    return sorted(out, key=str)


def made(seed, n):
    """A third of the rows in one group, a third of those equal to one another; nulls everywhere."""
    r = random.Random(seed)
    some = lambda k: r.choice([None, *range(-2, k)])
    rows = [(some(3), some(4), some(3), some(2), some(30), some(5)) for _ in range(n)]
    rows += [(7, 7, some(2), some(2), some(1000), some(5)) for _ in range(n // 2)] + [(7, 7, None, 0, 5, 5)] * (n // 2)
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("tasks", "hold", "batch", "most"), [(1, 1 << 16, 10_000, 3), (7, 20, 16, 3), (40, 1, 7, 1), (40, 1 << 16, 50, 12), (300, 5, 10_000, 3)])
def test_ranked_ties(spark, tasks, hold, batch, most):
    rows = made(tasks, 600)
    df = spark.createDataFrame(rows, "g long, h long, p long, q long, t long, u long").withColumns({"place": F.lit("x"), "task": F.lit("y")})
    got = ranked_ties.ranked_ties(df.repartition(3), ORDER, most, tasks, hold, batch).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_ranks(rows, most)


def test_ranked_ties_spread_one_group(spark):
    """One group, most of it one pair of equal rows: no task gets more than a few times its share."""
    n, tasks = 20_000, 10
    df = spark.range(n).select(F.lit(1).cast("long").alias("g"), F.lit(1).cast("long").alias("h"), (F.col("id") % 10 == 0).cast("long").alias("p"), *[F.lit(0).cast("long").alias(c) for c in "qtu"])
    sizes = [r["count"] for r in ranked_ties.placed(df, ORDER, tasks).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == tasks and max(sizes) < 2.5 * n / tasks
    got = ranked_ties.ranked_ties(df, ORDER, 3, tasks).agg(F.count("*"), F.countDistinct("pos"), F.max("pos"), F.min("tied"), F.max("place")).first()
    assert tuple(got) == (18_000, 18_000, 18_000, 18_000, 1)


def test_ranked_ties_settings_and_empty(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    lines = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, place int"
    assert ranked_ties.sale_line_ranks(spark.createDataFrame([], lines)).count() == 0
    assert spark.conf.get(name) == before
    odd = [(None, None, None, None, None, None, None, None, None, 1), (None, 1, -3, 2, -5, float("nan"), float("inf"), "x", None, 2)]
    got = {r.vendor_id: r for r in ranked_ties.sale_line_ranks(spark.createDataFrame(odd, lines)).collect()}
    assert (got[None].part, got[None].month, got[None].place, got[None].tied) == (-1, -1, 1, 1)
    assert (got[2].part, got[2].percent, got[2].amount_cents, got[2].quantity) == (-3, None, None, -5)


# --- fill in middle ---


@pytest.mark.parametrize("width", [1, 2, 5])
def test_places_of_units(width):
    r = random.Random(width)
    unit = re.compile(rf"[ \t\n\v\f\r]|[^ \t\n\v\f\r]{{1,{width}}}")
    how = middle.Middle(width=width)
    for text in ["", " ", "a", "ab", "\n\n", "x" * 1000, *("".join(r.choice("ab é𝄞\n\t<P>") for _ in range(r.randint(0, 60))) for _ in range(300))]:
        units = unit.findall(text)
        events = middle.Events.scan(text, how)
        assert events.units == len(units) and "".join(units) == text
        assert [events.place(k) for k in range(len(units) + 1)] == [0, *np.cumsum([len(u) for u in units])]
        assert events.sentinel == any(m in text for m in how.marks)


def brute_middle(i, text, width=1):
    text = text or ""
    units = re.findall(rf"[ \t\n\v\f\r]|[^ \t\n\v\f\r]{{1,{width}}}", text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("width", [1, 3])
def test_fill_in_middle(spark, width):
    r = random.Random(8)
    texts = [None, "", " ", "<P>", "a<S>b", "almost <M", "é𝄞" * 50, "x" * 100_000] + ["".join(r.choice("ab <>PSM\né𝄞") for _ in range(r.randint(0, 90))) for _ in range(150)]
    how = middle.Middle(width=width)
    docs = frame(spark, texts)
    done = middle.fill_in_middle(docs, how).withColumn("again", middle.restored(F.col("output"), F.col("form"), how))
    got = by_id(done)
    forms = set()
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:6] == brute_middle(i, t, width) and got[i].again == (t or "")
        forms.add(got[i].form)
    assert forms == {"plain", "psm", "spm"}
    if width == 1:
        d = by_id(middle.middle_digests(docs))
        assert all(d[i].restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and d[i].output_sha256 == hashlib.sha256(got[i].output.encode()).hexdigest() for i, t in enumerate(texts))


def test_fill_in_middle_cases(spark):
    docs = spark.createDataFrame([(None, "no id", None, None, 5, "x", "y", 1, 0.5), (3, "twice here", None, None, 5, "x", "y", 1, 0.5), (3, "twice here", None, None, 5, "x", "y", 1, 0.5)], SCHEMA)
    got = middle.fill_in_middle(docs).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(brute_middle(i, t) for i, t in ((None, "no id"), (3, "twice here"), (3, "twice here")))
    assert middle.middle_digests(frame(spark, [])).count() == 0
    for marks in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("", "b", "c"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            middle.Middle(*marks)


# --- byte pairs ---


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_equal_the_pattern():
    """Every character below U+0300 and the further punctuation, alone and between others; texts of all kinds."""
    every, split = regex.compile(public_tokenizers.PATTERN).findall, byte_pairs.splitter()
    r = random.Random(6)
    chars = [chr(c) for c in (*range(0x300), *range(0x2000, 0x2070), 0x20AC, 0x3000, 0x65E5, 0x1D11E)]
    for c in chars:
        for text in (c, f"a{c}b", f" {c} 1{c}", f"{c}{c}'s  {c}", f"x {c}\n\n{c} "):
            assert split(text) == every(text), repr(text)
    for _ in range(3000):
        text = "".join(r.choice(chars if r.random() < 0.5 else "ab 1'\n.é\x1c") for _ in range(r.randint(0, 30)))
        assert split(text) == every(text) and "".join(every(text)) == text


def test_replay_equals_library(library):
    """Together, one by one and in the library; with a vocabulary whose ranks are out of order, too."""
    r = random.Random(4)
    words = ["a", "aaaa", "a" * 3000, "ab" * 700, "", "ÿ", "\x00", "日本語", "zzzzzz"] + ["".join(r.choice("abcdeiorst éßü日") for _ in range(r.randint(1, 40))) for _ in range(1500)]
    words = [w.encode() for w in words] + [bytes(r.randrange(256) for _ in range(r.randint(1, 12))) for _ in range(500)]
    known = byte_pairs.ranks(PATH)
    got = byte_pairs.replay(words, known)
    assert got == [byte_pairs.replay([w], known)[0] for w in words]
    assert all(ids == (library._encode_single_piece(w) if w else []) for w, ids in zip(words, got, strict=True))
    mixed = {bytes([b]): b for b in range(256)}
    for n in (2, 3, 4, 5):
        mixed |= {bytes(r.choice(b"abc") for _ in range(n)): r.randrange(10_000) + 256 for _ in range(60)}
    order = {t: i for i, t in enumerate(sorted(mixed, key=lambda t: (len(t) > 1, mixed[t], t)))}
    odd = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=order, special_tokens={})
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 60))).encode() for _ in range(2000)]
    assert byte_pairs.replay(words, order) == [odd._encode_single_piece(w) for w in words]


@pytest.mark.parametrize(("common", "known"), [(50_000, 300_000), (10, 5), (1, 0)])
def test_byte_pairs(spark, library, monkeypatch, common, known):
    monkeypatch.setattr(byte_pairs, "COMMON", common)
    r = random.Random(common)
    texts = [None, "", " ", "don't  stop\n\n now ", "x" * 20_000, " \t  　 é", "１２３ ٣٤ ½", "<|endoftext|> <P>", "​﻿\x85a\x1cb", "plain \x1c\x1f text\x1d"]
    texts += ["".join(r.choice("abcdeiorst  \n'éßü日本1234.,!?\t") for _ in range(r.randint(0, 400))) for _ in range(80)] + ["the same text again"] * 5
    got = by_id(byte_pairs.byte_pair_digests(frame(spark, texts), remembered=known))
    for i, t in enumerate(texts):
        ids = np.array(library.encode_ordinary(t or ""), dtype="<u4")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest()), repr(t)[:80]
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_pairs.encode(frame(spark, [])).count() == 0


def test_byte_pairs_whole_table(spark, library):
    """The registered query over sf0.001, document by document."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = by_id(byte_pairs.byte_pair_digests(docs))
    for r in docs.select("doc_id", "text").collect():
        ids = np.array(library.encode_ordinary(r.text or ""), dtype="<u4")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
