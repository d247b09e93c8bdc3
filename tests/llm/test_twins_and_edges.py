"""Plain twins of the learned and hashed operators, and the defined cases of all ten."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import common, exact_dedup, fingerprint, language_id, licenses, near_dedup, packing, quality, secrets, sentence_pieces, suffix_dedup
from tests.llm.test_corpus_operators import SCHEMA, brute_cut, brute_phrases, by_id, frame

WORDS = "the river stone lamp twelve harbour window carries über größe été lumière casa mañana".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)) + "."


# --- quality ---


def test_quality_scores_equal_plain_formula(spark):
    """Posterior from densities computed with determinants and solves, on the same statistics."""
    r = random.Random(3)
    texts = [prose(r, r.randint(5, 120)) if i % 3 else " ".join("#" * r.randint(1, 5) for _ in range(r.randint(5, 60))) + prose(r, 4) for i in range(240)]
    labels = [int(i % 3 > 0) if r.random() < 0.9 else 0 for i in range(240)]
    docs, marks = frame(spark, texts), spark.createDataFrame(list(enumerate(labels)), "doc_id long, label int")
    got = by_id(quality.quality_scores(docs, marks, common.crc_mod("doc_id", 5) == 0))
    x = np.array([quality.statistics(t.encode()) for t in texts])
    used = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in range(240)])
    y = np.array(labels)
    center, scale = x[used].mean(axis=0), np.maximum(x[used].std(axis=0), quality.LEAST_VARIANCE**0.5)
    z = (x - center) / scale
    parts = [z[used & (y == c)] for c in (0, 1)]
    n = [len(p) for p in parts]
    cov = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(k * c for k, c in zip(n, cov, strict=True)) / sum(n)
    density = []
    for c in (0, 1):
        a = 0.25 * min(1.0, 20 * quality.D / n[c]) if n[c] > quality.D else 1.0
        s = 0.98 * ((1 - a) * cov[c] + a * pooled) + 0.02 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(quality.D)
        d = z - parts[c].mean(axis=0)
        density.append(math.log(n[c] / sum(n)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,ij->i", d, np.linalg.solve(s, d.T).T))
    want = 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))
    assert np.allclose([got[i].score for i in range(240)], want, atol=1e-4)


def test_quality_statistics_by_hand():
    s = dict(zip(quality.FEATURES, quality.statistics(b"Aa bb, bb.\n\n7x #"), strict=True))
    logit = lambda k, n: math.log((k + 0.5) / (n - k + 0.5))
    assert s["log_bytes"] == math.log1p(16) and s["log_words"] == math.log1p(5) and s["log_longest"] == math.log1p(3)
    assert s["upper"] == logit(1, 16) and s["digit"] == logit(1, 16) and s["symbol"] == logit(1, 16) and s["space"] == logit(5, 16)
    assert s["capital_words"] == logit(1, 5) and s["top_word"] == logit(1, 5) and s["log_lines"] == math.log1p(2)


# --- languages ---


def brute_grams(text):
    b = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in text.lower().encode())
    return [b[i : i + 5] for i in range(len(b) - 4) if b[i : i + 5].count(b" ") <= 1]


def as_int(gram):
    return int.from_bytes(gram, "little")


def test_grams_equal_plain_slices():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice("abcXYZ 19.-éßü\n") for _ in range(r.randint(0, 40)))
        assert [int(x) for g in language_id.grams(text) for x in g] == [as_int(g) for g in brute_grams(text)]


def test_filter_bits_equal_sets():
    """Every language of an n-gram is found; false ones are as rare as the correction assumes; counts are those of the bits."""
    r = np.random.default_rng(2)
    sets = {k: np.unique(r.integers(0, 1 << 40, n, dtype=np.uint64)) for k, n in (("a", 3000), ("b", 500), ("c", 2000))}
    known = language_id.Filter.build(["a", "b", "c"], sets)
    for i, k in enumerate("abc"):
        assert known.counts(sets[k])[i] == len(sets[k])
    strange = r.integers(1 << 40, 1 << 41, 200_000, dtype=np.uint64)
    seen = known.counts(strange) / len(strange)
    assert np.all(np.abs(seen - known.false_rate) <= 0.3 * known.false_rate + 2e-4)
    size = known.slots.shape[1]
    one = strange[:500]
    shift = 64 - size.bit_length() + 1
    plain = [sum(all(int(known.slots[0, ((int(g) * int(m)) % (1 << 64)) >> shift]) >> i & 1 for m in language_id.MULTIPLIERS) for g in one) for i in range(3)]
    assert known.counts(one).tolist() == plain


def test_language_equals_plain_counts(spark):
    """Predictions from sets of n-grams and exact membership; documents are long enough for false positives not to matter."""
    r = random.Random(6)
    pools = {k: ["".join(r.choice(s) for _ in range(r.randint(4, 9))) for _ in range(60)] for k, s in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "ijklmnop"))}
    langs = [r.choice(list(pools)) for _ in range(90)]
    texts = [" ".join(r.choice(pools[k]) for _ in range(r.randint(20, 60))) for k in langs]
    got = by_id(language_id.language_id(frame(spark, texts, langs), common.crc_mod("doc_id", 4) == 2))
    df = {k: collections.Counter() for k in pools}
    for i, (t, k) in enumerate(zip(texts, langs, strict=True)):
        if zlib.crc32(str(i).encode()) % 4 != 2:
            df[k].update(set(brute_grams(t)))
    rows = collections.Counter(k for i, k in enumerate(langs) if zlib.crc32(str(i).encode()) % 4 != 2)
    order = sorted(rows, key=lambda k: (-rows[k], k))
    for i, t in enumerate(texts):
        hits = [sum(g in df[k] for g in brute_grams(t)) for k in order]
        assert got[i].lang_pred == order[int(np.argmax(hits))] and got[i].n_grams == len(brute_grams(t))
        assert got[i].score == pytest.approx(max(hits) / sum(hits), abs=0.02)


def test_language_ties(spark):
    """Equal evidence: the language learned from more rows, then the lesser name."""
    same = "lorem ipsum dolor amet"
    docs = frame(spark, [same] * 7 + ["lorem", "xyzzy plugh", "ab"], ["bb", "bb", "cc", "cc", "aa", "bb", "cc", None, None, None])
    got = by_id(language_id.language_id(docs, F.lit(False)))
    assert {got[i].lang_pred for i in range(10)} == {"bb"} and (got[8].score, got[8].evidence) == (0.0, 0.0) and got[9].n_grams == 0


# --- fingerprints ---


def brute_fingerprint(text):
    b, s, out = (text or "").encode(), 0, set()
    for e in brute_phrases(b):
        h = (sum((c + 1) * pow(fingerprint.BASE, i, 1 << 64) for i, c in enumerate(b[s:e])) + e - s) % (1 << 64)
        h ^= h >> 31
        h = h * 0xBF58476D1CE4E5B9 % (1 << 64)
        h ^= h >> 29
        h = h * 0x94D049BB133111EB % (1 << 64)
        out.add(h >> 32)
        s = e
    return sorted(out)[:128]


def brute_likeness(a, b):
    if not a and not b:
        return 1.0
    least = sorted({*a, *b})[:128]
    return len(set(a) & set(b) & set(least)) / len(least)


def test_fingerprints_equal_plain_twin(spark):
    r = random.Random(4)
    texts = [None, "", "a", "日本語テキスト", "ab" * 40, *[prose(r, r.randint(1, 200)) for _ in range(12)], "x" * 900]
    ids = [50, 3, 77, 12, 5, *range(100, 112), 1]
    got = by_id(fingerprint.edited_fingerprints(frame(spark, texts, ids=ids), parts=4))
    order = sorted(range(len(ids)), key=lambda k: -ids[k])
    for at, k in enumerate(order):
        own, nxt = texts[k] or "", texts[order[(at + 1) % len(order)]] or ""
        half = len(own) // 2
        other = own[: len(own) - half] + nxt[:half]
        f, g, h = brute_fingerprint(own), brute_fingerprint(other), brute_fingerprint(nxt)
        row, text = got[ids[k]], lambda x: "".join(f"{v:08x}" for v in x)
        assert (row.n_chars, row.edited_sha256) == (len(own), hashlib.sha256(other.encode()).hexdigest())
        assert (row.fingerprint, row.edited_fingerprint) == (text(f), text(g))
        assert (row.near_edited, row.near_next) == (brute_likeness(f, g), brute_likeness(f, h))


def test_phrases_longer_than_a_step(monkeypatch):
    """Sums go step by step; where the steps end does not matter, but for phrases longer than one."""
    b = (prose(random.Random(8), 300) * 3).encode()
    whole = fingerprint.phrase_hashes(b)
    monkeypatch.setattr(fingerprint, "STEP", 64)
    assert np.array_equal(whole, fingerprint.phrase_hashes(b))
    monkeypatch.setattr(fingerprint, "STEP", 4)
    assert len(fingerprint.phrase_hashes(b)) == len(whole)


def test_parts_hold_a_range_each(spark):
    docs = frame(spark, [f"text {i}" for i in range(400)], ids=[i * 7 for i in range(400)])
    sizes = [len(p) for p in fingerprint.followed(docs.select("doc_id", "text"), 8).rdd.glom().collect()]
    assert len(sizes) == 8 and min(sizes) >= 40 and max(sizes) <= 60


# --- packing ---


def test_packing_against_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(11)
    texts = [None, "", "a<|endoftext|>b", "naïve 日本\n\t12345", *[prose(r, r.randint(1, 700)) for _ in range(60)], " ".join(prose(r, 50) for _ in range(100))]
    rows = packing.pack_documents(frame(spark, texts).coalesce(1), with_ids=True).collect()
    docs, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for x in rows:
        docs[x.doc_id].append(x)
        seqs[x.sequence_id].append(x)
    for i, t in enumerate(texts):
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(docs[i], key=lambda x: x.start)
        assert [v for p in parts for v in p.ids] == ids and {p.doc_tokens for p in parts} == {len(ids)}
        assert [p.ids_crc32 for p in parts] == [zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in parts]
    totals = sorted(sum(p.length for p in s) for s in seqs.values())
    short = [n for n in totals if n < 1024]
    # one task: what is left over fills distinct powers of two, so at most ten short sequences and no padding
    assert all(n & (n - 1) == 0 for n in short) and len(short) == len(set(short)) <= 10
    assert sum(totals) == sum(len(exact.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)


# --- hot passages ---


def test_hot_passage_costs_tasks_not_documents(spark, monkeypatch):
    """A passage in every document: removed from all but the first, and combined before it is shuffled."""
    r = random.Random(21)
    passage = prose(r, 25)
    texts = [prose(r, 6) + str(i) + " " + passage + " " + prose(r, 5) + str(i) for i in range(150)]
    got = by_id(suffix_dedup.suffix_dedup(frame(spark, texts), 50, parts=3))
    assert [tuple(got[i][1:5]) for i in range(150)] == brute_cut(texts, 50)
    import pyarrow as pa

    batch = pa.record_batch({"doc_id": pa.array(range(150), pa.int64()), "text": texts})
    sent = [x for out in suffix_dedup._digits(3, 50)([batch]) for x in suffix_dedup._blobs(pa.Table.from_batches([out]), False)]
    g = np.concatenate([suffix_dedup._unpack(x, *suffix_dedup.INSTANCE)[0] for x in sent])
    doc = np.concatenate([suffix_dedup._unpack(x, *suffix_dedup.INSTANCE)[1] for x in sent])
    for digit in np.unique(g):
        assert len(set(doc[g == digit])) <= 2


# --- defined cases of all operators ---

R = random.Random(31)
BASE_TEXT = prose(R, 60)
CASES = [
    (1, None), (2, ""), (3, " \t\n"), (4, BASE_TEXT), (5, BASE_TEXT), (5, BASE_TEXT), (6, BASE_TEXT + " token = \"0123456789abcdef0123456789abcdef\""), (7, prose(R, 70)), (7, prose(R, 80)),
    (None, BASE_TEXT), (None, None), (8, "apache license " * 40), (9, "x" * 70_000), (10, prose(R, 9000)), (-3, "ünï" * 50), (11, "\x00\x01 \x7f"), (12, "a"),
]


def cases(spark):
    rows = [(i, t, "aa" if i and i % 2 else "bb", None, None, "x", "y", 1, 0.5) for i, t in CASES]
    return spark.createDataFrame(rows, SCHEMA)


MARKS = [(i, i % 2) for i in range(1, 13)]
OPERATORS = {
    "op1": lambda d: sentence_pieces.sentence_pieces(d),
    "op2": lambda d: licenses.license_scan(d),
    "op3": lambda d: quality.quality_scores(d, d.sparkSession.createDataFrame(MARKS, "doc_id long, label int"), common.crc_mod("doc_id", 5) == 0),
    "op4": lambda d: language_id.language_id(d, common.crc_mod("doc_id", 4) == 2),
    "op5": lambda d: near_dedup.near_duplicates(d, 4, 80),
    "op7": lambda d: exact_dedup.exact_dedup(d),
    "op8": lambda d: fingerprint.edited_fingerprints(d, parts=3),
    "op9": lambda d: suffix_dedup.suffix_dedup(d, parts=3),
    "op10": lambda d: secrets.secret_scan(d),
}


def plain(rows):
    return sorted(str([f"{v:.9f}" if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_defined_cases(spark, name):
    """A row for every row, whatever the ids; the same result from one partition and from seven; empty tables stay empty."""
    run = OPERATORS[name]
    one = run(cases(spark).coalesce(1))
    got = one.collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in CASES)
    assert plain(got) == plain(run(cases(spark).repartition(7)).collect())
    empty = run(cases(spark).limit(0))
    assert empty.columns == one.columns and empty.count() == 0


def test_repeated_and_null_ids_by_operator(spark):
    docs = cases(spark)
    seven = exact_dedup.exact_dedup(docs).collect()
    same = [r for r in seven if r.group_size == 4]
    assert {r.keep_id for r in same} == {4} and sum(r.kept for r in same) == 1 and [r.kept for r in same if r.doc_id is None] == [False]
    nine = suffix_dedup.suffix_dedup(docs, parts=3).collect()
    assert all(r.n_removed == 0 for r in nine if r.doc_id is None) and all(r.n_removed == r.n_bytes for r in nine if r.doc_id == 5)
    packed = packing.pack_documents(docs, with_ids=True).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in CASES}
    five = near_dedup.near_duplicates(docs, 4, 80).collect()
    assert all(r.kept and r.component_id is None for r in five if r.doc_id is None)


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline

    for k, rows in enumerate((CASES, [])):
        docs = spark.createDataFrame([(i, t, "aa", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        now = spark.read.parquet(f"{tmp_path}/{k}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, f"{tmp_path}/{k}")
            assert now.columns == docs.columns
        assert corpus_pipeline.run(spark, f"{tmp_path}/{k}").count() >= len(rows) > 0 or not rows


def test_pipeline_keeps_extra_columns_and_unlearned_texts(spark, tmp_path):
    """Without any language learned nothing is rejected; columns whose names clash with the operators' pass through."""
    import corpus_pipeline

    docs = cases(spark).withColumn("lang", F.lit(None).cast("string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == sum(t is not None for _, t in CASES)
    for stage in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.secrets):
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    assert "0123456789abcdef" not in " ".join(r.text for r in kept.collect())


def test_rejected_languages(spark, tmp_path):
    """Text in letters of no learned language goes once it is long enough to tell; short clean text stays."""
    import corpus_pipeline

    texts = [prose(random.Random(i), 30) for i in range(20)] + ["zq" * 60, "hi", "12 34", prose(random.Random(77), 8)]
    docs = frame(spark, texts, ["aa"] * 20 + [None] * 4).select("doc_id", "text", "lang", "source", "n_chars")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()}
    assert kept == {*range(20), 21, 23}

