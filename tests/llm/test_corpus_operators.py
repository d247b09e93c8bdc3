"""The ten corpus operators against brute force and on defined edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import common, exact_dedup, fingerprint, language_id, licenses, near_dedup, packing, quality, secrets, sentence_pieces, suffix_dedup
from lacuna.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, held_out string, part int, score double"


def frame(spark, texts, langs=None, ids=None):
    """Documents with extra columns whose names clash with those of the operators."""
    langs, ids = langs or [None] * len(texts), ids or list(range(len(texts)))
    rows = [(i, t, lang, None, None if t is None else len(t), "x", "y", 1, 0.5) for i, t, lang in zip(ids, texts, langs, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(60)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = prose(120), prose(30)
    out = [None, "", " ", "a", "ab\n\tab", base, base, base.replace(" ", "  "), base + " tail", "x" * 300, "the " * 500]
    out += [prose(r.randint(1, 80)) for _ in range(10)] + [prose(20) + " " + passage + " " + prose(20) for _ in range(4)]
    near = base.split()
    for _ in range(6):
        w = list(near)
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return out


def by_id(rows):
    return {r["doc_id"]: r for r in rows.collect()}


@pytest.mark.parametrize("broadcast_bits", [1 << 28, 1 << 10])
def test_exact_dedup(spark, texts, monkeypatch, broadcast_bits):
    monkeypatch.setattr(exact_dedup, "BROADCAST_BITS", broadcast_bits)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    got = by_id(exact_dedup.exact_dedup(frame(spark, texts)))
    for i, n in enumerate(norm):
        same = [j for j, m in enumerate(norm) if m == n]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (same[0], len(same), same[0] == i)
        assert got[i].text_sha256 == hashlib.sha256(n.encode()).hexdigest()
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def brute_near(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, texts, size):
    want = brute_near(texts, size, 80)
    got = by_id(near_dedup.near_duplicates(frame(spark, texts), size, 80))
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i][1] == i) for i in range(len(texts)))
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_chain_of_centres(spark):
    """A chain whose ends are unlike: links must be found away from any bucket's centre."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    now, chain = [r.choice(words) for _ in range(150)], []
    for _ in range(12):
        chain.append(" ".join(now))
        now = now[3:] + [r.choice(words) for _ in range(3)]
    chain += ["", *[" ".join(r.choice(words) for _ in range(150)) for _ in range(5)]]
    got = by_id(near_dedup.near_duplicates(frame(spark, chain), 4, 80))
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(chain))] == brute_near(chain, 4, 80)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 140)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), common.Tables(spark, "t"))
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def brute_cut(texts, window):
    out = []
    raw = [(t or "").encode() for t in texts]
    first = {}
    for i, b in enumerate(raw):
        for k in range(len(b) - window + 1):
            first.setdefault(b[k : k + window], i)
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < i:
                gone[k : k + window] = b"\1" * window
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("window", [50, 33])
def test_suffix_dedup(spark, texts, window):
    more = [*texts, "ab" * 200, "ba" * 150, "x" * 60, "é" * 40, "z" + "x" * 49]
    got = by_id(suffix_dedup.suffix_dedup(frame(spark, more), window, parts=3))
    assert [tuple(got[i][1:5]) for i in range(len(more))] == brute_cut(more, window)
    assert suffix_dedup.suffix_dedup(frame(spark, []), parts=3).count() == 0


def test_suffix_dedup_segments(monkeypatch):
    r = random.Random(1)
    b = bytes(r.choice(b"ab ") for _ in range(5000))
    whole = {(int(p), int(w)) for _, p, f, n in zip(*suffix_dedup.leading(b, 50), strict=True) for w in range(f, f + n)}
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    assert {(int(p), int(w)) for _, p, f, n in zip(*suffix_dedup.leading(b, 50), strict=True) for w in range(f, f + n)} == whole
    assert len(whole) == len(b) - 49


def test_least_documents_by_digits():
    data = np.frombuffer(b"abcdefghij" * 10 + bytes(8), dtype=np.uint8)
    start = np.arange(40)
    doc = 100 - np.arange(40)
    got = suffix_dedup.least_documents(np.zeros(40, dtype=np.int64), start, doc, data, 30)
    assert [int(x) for x in got] == [min(100 - k for k in range(40) if k % 10 == s % 10) for s in range(40)]


def test_packing(spark, texts):
    rows = packing.pack_documents(frame(spark, [*texts, "word " * 3000]), with_ids=True).collect()
    encode = packing.encoder(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    docs, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for i, t in enumerate([*texts, "word " * 3000]):
        parts = sorted(docs[i], key=lambda r: r.start)
        ids = [*encode(t or "").tolist(), 0]
        assert [x for p in parts for x in p.ids] == ids and all(p.doc_tokens == len(ids) for p in parts)
        assert [p.start for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1]]
    for parts in seqs.values():
        parts.sort(key=lambda r: r.offset)
        total = sum(p.length for p in parts)
        assert [p.offset for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1]]
        assert total <= 1024 and (total == 1024 or total & (total - 1) == 0)
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_packing_limits(spark):
    r = random.Random(2)
    rows = [(i, [1] * (n := r.randint(1, 90)), [r.random() < 0.7 for _ in range(n)]) for i in range(60)] + [(99, None, None), (100, [], [])]
    df = spark.createDataFrame(rows, "id long, ids array<int>, loss array<boolean>").coalesce(1)
    limits = packing.Limits(tokens=64, segments=3, loss=30)
    got = packing.pack_examples(df, "id", limits, waiting=8).collect()
    seqs = collections.defaultdict(list)
    loss = {i: m for i, _, m in rows}
    for x in got:
        seqs[x.sequence_id].append(x)
    for parts in seqs.values():
        assert sum(p.length for p in parts) <= 64 and len(parts) <= 3
        assert sum(sum(loss[p.id][p.start : p.start + p.length]) for p in parts) <= 30
    assert sum(p.length for p in got) == sum(len(ids or []) for _, ids, _ in rows)


def test_packing_limits_decide(spark, texts):
    """Segments and loss bind: sequences differ from those of tokens alone, none exceeds a limit, none is padded, and long texts fill whole sequences."""
    r = random.Random(7)
    more = [*texts, *[" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(r.choice([5, 60, 300, 900]))) for _ in range(120)], "word " * 30000]
    docs = frame(spark, more).coalesce(1)
    got = packing.pack_documents(docs, limits=packing.Limits(1024, 4, 832), context=0.25).collect()
    plain = packing.pack_documents(docs).collect()
    seqs, parts = collections.defaultdict(list), collections.defaultdict(list)
    for x in got:
        seqs[x.sequence_id].append(x)
        parts[x.doc_id].append(x)
        silent = max(1, int(0.25 * x.doc_tokens))
        assert x.loss_tokens == x.length - max(0, min(silent, x.start + x.length) - x.start)
    for i, p in parts.items():
        p.sort(key=lambda x: x.start)
        assert [x.start for x in p] == [0, *np.cumsum([x.length for x in p])[:-1]] and sum(x.length for x in p) == p[0].doc_tokens, i
    sizes = [sum(x.length for x in q) for q in seqs.values()]
    assert all(n == 1024 or n & (n - 1) == 0 for n in sizes) and max(len(q) for q in seqs.values()) == 4
    assert max(sum(x.loss_tokens for x in q) for q in seqs.values()) == 832
    assert sum(n for n in sizes if n == 1024) > 0.9 * sum(sizes)
    assert {(x.doc_id, x.start, x.length) for x in got} != {(x.doc_id, x.start, x.length) for x in plain}


def test_packing_by_products_and_not_by_size():
    """The example whose loss uses the scarcer capacity goes in before larger ones."""
    def piece(k, n, loss):
        return packing.Piece(k, 0, np.ones(n, "<u4"), np.arange(n) >= n - loss, n)

    packer = packing.Packer(packing.Limits(100, 10, 40), waiting=8)
    for p in (piece("a", 60, 0), piece("b", 40, 20), piece("c", 39, 1), piece("d", 30, 30)):
        assert list(packer.add(p)) == []
    first = next(packer.finish())
    assert sum(len(p.ids) for p in first) == 100 and sum(int(p.loss.sum()) for p in first) <= 40
    assert [p.key for p in first][:2] == ["d", "a"]


def test_encoder_equals_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    exact, encode = Tokenizer.from_file(path), packing.encoder(path)
    for t in ["", "a<|endoftext|>b", "naïve  日本\n\n\tx's 12345 ---", "é" * 50, " " * 40 + "x", "<|endoftext|>" * 3]:
        assert encode(t).tolist() == exact.encode(t, add_special_tokens=False).ids


def brute_phrases(b):
    seen, out, s = set(), [], 0
    for e in range(1, len(b) + 1):
        if b[s:e] not in seen:
            seen.add(b[s:e])
            out.append(e)
            s = e
    return out + ([len(b)] if s < len(b) else [])


def test_fingerprints(spark, texts):
    for t in [*texts, "a" * 500, "ab" * 100]:
        assert fingerprint.phrase_ends((t or "").encode()) == brute_phrases((t or "").encode())
    rows = by_id(fingerprint.edited_fingerprints(frame(spark, texts), parts=3))
    n = len(texts)
    for i in range(n):
        own, nxt = texts[i] or "", texts[(i - 1) % n] or ""
        other = fingerprint.edited(own, nxt)
        f, g, h = map(fingerprint.fingerprint, (own, other, nxt))
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(other.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.hexed(f), fingerprint.hexed(g))
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(f, g), fingerprint.likeness(f, h))
    assert fingerprint.edited_fingerprints(frame(spark, []), parts=3).count() == 0
    one = fingerprint.edited_fingerprints(frame(spark, ["abcdef"]), parts=3).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_phrase_hashes_do_not_depend_on_place():
    a, b = b"abcabcabdabe" * 20, b"zz" + b"abcabcabdabe" * 20
    assert set(fingerprint.phrase_hashes(a)) & set(fingerprint.phrase_hashes(b))
    assert fingerprint.likeness(fingerprint.fingerprint("aab"), fingerprint.fingerprint("aab")) == 1.0


def brute_licenses(text, known):
    low = (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, base, labels, score = [], set(), set(), 0.0
    for t in known:
        if t.phrase:
            at = [i for i in range(len(w)) if tuple(w[i : i + len(t.words)]) == t.words]
            starts += at
            base |= {t.label} if at else set()
        else:
            for b in range(max(1, len(w))):
                k = len(set(w[b : b + licenses.BLOCK]) & set(t.tokens))
                if k >= t.need:
                    labels.add(t.label)
                    score = max(score, k / len(t.tokens))
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if starts else score)


def test_license_scan(spark, texts):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    more = [
        *texts, "Apache License", "the GNU General Public\nLicense. MIT license; mit licenses CC-BY", "x " * 31 + "apache license " + "y " * 70 + "Apache LICENSE",
        notice, "word " * 40 + notice.replace("hereby", "") + " word" * 40, "Licensed under the Apache License, Version 2.0.", "redistribution and use in source and binary forms with or without modification are allowed",
        "ßapache licensé apache license", "x " * 50 + notice.replace(" ", " # 7 ") + " x" * 50, notice.replace(" ", " lorem ipsum "), " ".join(notice.split()[::-1]),
        " ".join([*notice.split()[:8], *["pad"] * 40, *notice.split()[8:]]),
    ]
    known = licenses.templates()
    got = by_id(licenses.license_scan(frame(spark, more)))
    for i, t in enumerate(more):
        want = brute_licenses(t, known)
        assert tuple(got[i][1:8]) == pytest.approx(want) if want[2] is not None else tuple(got[i][1:8]) == want
    assert licenses.license_scan(frame(spark, [])).count() == 0


def test_base_secrets():
    text = "api_key = 'abcdef12' secret=token:abcdefgh PASSWORD:  xyz token=abc password=longenough AKIA" + "A1" * 8 + " AKIAshort " + "0f" * 12 + " beef"
    spans = sorted(secrets.base_spans(text))
    assert [(secrets.KINDS[k], text[s:e]) for s, k, e in spans] == [
        ("assign", "api_key = 'abcdef12"), ("assign", "password=longenough"), ("access", "AKIA" + "A1" * 8), ("hex", "0f" * 12),
    ]
    assert secrets.base_spans("") == []


def test_secret_field_decodes_exactly():
    r = np.random.default_rng(4)
    field = secrets.Field(*(np.zeros((1, 3)) for _ in range(5)), np.array([[0.3, -0.5, secrets.NEVER], [-0.2, 0.1, 0.6], [0.2, -0.3, 0.4]]))
    for _ in range(200):
        e = r.normal(0, 2, (r.integers(1, 7), 3))
        e[:, 0] += r.choice([0, 6], len(e))
        best = max(itertools.product(range(3), repeat=len(e)), key=lambda p: sum(e[i, t] for i, t in enumerate(p)) + sum(field.trans[a, b] for a, b in zip((0, *p), p, strict=False)))
        last = field._viterbi(e, last=True)
        assert tuple(last.tolist()) == best and tuple(field.decode(e).tolist()) == best


def test_secret_scan(spark, texts):
    rows = [*texts, *[f"some words here token = \"{hashlib.sha1(bytes([i])).hexdigest()}\" and more words {i}" for i in range(12)]]
    got = by_id(secrets.secret_scan(frame(spark, rows)))
    for i, t in enumerate(rows):
        base = secrets.base_spans(t or "")
        kinds = [k for _, k, _ in base]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(kinds.count(k) for k in range(3))
        assert got[i].base_sha256 == hashlib.sha256(secrets.digest_form(base).encode()).hexdigest()
        assert set(filter(None, secrets.digest_form(base).split(","))) <= set(got[i].spans.split(","))
    assert secrets.secret_scan(frame(spark, [])).count() == 0
    clean = by_id(secrets.redact(frame(spark, rows)))
    assert clean[0].text is None and clean[5].text == texts[5] and not any(secrets.base_spans(r.text or "") for r in clean.values())


def test_language_id(spark):
    r = random.Random(7)
    pools = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["weiß", "größe", "schön", "über"], "cc": ["kata", "buku", "rumah", "baik"]}
    langs = [r.choice("aa bb cc".split()) for _ in range(60)]
    texts = [" ".join(r.choice(pools[k]) for _ in range(r.randint(5, 40))) for k in langs]
    texts += [None, "", "123 -- 4", "x"]
    docs = frame(spark, texts, [*langs, None, None, "aa", "bb"])
    got = by_id(language_id.language_id(docs, common.crc_mod("doc_id", 4) == 2))
    assert [got[i].lang_pred for i in range(60)] == langs
    assert [got[i].lang_pred for i in (60, 61, 62)] == ["und"] * 3 and got[63].lang_pred in pools
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 for i in got)
    assert language_id.language_id(frame(spark, []), common.crc_mod("doc_id", 4) == 2).count() == 0
    assert [r.lang_pred for r in language_id.language_id(frame(spark, ["abc def"]), F.lit(False)).collect()] == ["und"]


def test_language_segments(monkeypatch):
    text = "größe und schön " * 50
    whole = np.concatenate(list(language_id.grams(text)))
    monkeypatch.setattr(language_id, "SEGMENT", 37)
    assert np.array_equal(whole, np.concatenate(list(language_id.grams(text))))


def test_quality(spark):
    r = random.Random(8)
    good = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(r.randint(20, 90))) + "."
    bad = lambda: " ".join("".join(r.choice("abc#$%&") for _ in range(r.randint(2, 4))) for _ in range(r.randint(20, 90)))
    labels = [i % 2 for i in range(200)]
    docs = frame(spark, [*(good() if y else bad() for y in labels), None, ""])
    marks = spark.createDataFrame([*enumerate(labels), (0, None), (9999, 1)], "doc_id long, label int")
    got = by_id(quality.quality_scores(docs, marks, common.crc_mod("doc_id", 5) == 0))
    assert len(got) == 202 and np.mean([got[i].predicted == y for i, y in enumerate(labels)]) > 0.97
    assert got[200].score == got[201].score and all(r.predicted == int(r.score >= 0.3) for r in got.values())
    none = quality.quality_scores(docs, marks.limit(0), common.crc_mod("doc_id", 5) == 0)
    assert {r.score for r in none.collect()} == {0.5}
    assert quality.quality_scores(frame(spark, []), marks, common.crc_mod("doc_id", 5) == 0).count() == 0


def brute_pieces(known, s):
    """Best segmentation of a unigram model, longest last piece first among equals, without units or chunks."""
    best, start = [0] + [None] * len(s), [0] * (len(s) + 1)
    for p in range(1, len(s) + 1):
        for q in range(max(0, p - known.longest), p):
            v = known.scores.get(s[q:p], known.unknown if p - q == 1 else None)
            if v is not None and (best[p] is None or best[q] + v > best[p]):
                best[p], start[p] = best[q] + v, q
    cuts, p = [], len(s)
    while p:
        cuts.append((start[p], p))
        p = start[p]
    return list(known.spell([s[a:b] for a, b in cuts[::-1]])), best[-1]


HARD = ["日本 naïve  run\n\nnew\tline", "q" * 700, "ab " * 300, "▁marks ▁", "the  of   and    a" * 20, "aaaa" * 50 + "bbbb", "🎉🎉x🎉  ", "   ", "undschtzzuein,überber" * 30, " ".join(["intionan"] * 40) + "\r\n"]


def test_sentence_pieces(spark, texts):
    """Ids are those of the model's own library, whatever the chunks."""
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, known = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.pieces(path)
    rows = [*texts, *HARD]
    for chunk in (64, 97, 1 << 15):
        got = by_id(sentence_pieces.sentence_pieces(frame(spark, rows), chunk=chunk))
        for i, t in enumerate(rows):
            ids = own.encode(t or "")
            score = sum(own.get_score(x) for x in ids if not own.is_byte(x)) + known.unknown * sum(c not in known.ids for c in (t or "").replace(" ", "▁"))
            assert (got[i].n_pieces, got[i].score, got[i].ids_hash) == (len(ids), score, sentence_pieces._signed(sentence_pieces.digest(ids))), (chunk, t)
            assert got[i].round_trip == (sentence_pieces.MARK not in (t or ""))
    assert sentence_pieces.sentence_pieces(frame(spark, [])).count() == 0
    plain = [t or "" for t in rows if sentence_pieces.MARK not in (t or "")]
    docs = frame(spark, plain)
    ids = by_id(sentence_pieces.encode(docs))
    assert all(ids[i].ids == own.encode(t) for i, t in enumerate(plain))
    back = by_id(sentence_pieces.decode(sentence_pieces.encode(docs)))
    assert [back[i].text for i in range(len(plain))] == plain


def test_unigram_pieces(spark, texts, tmp_path):
    import public_tokenizers
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = sentence_pieces.UNIGRAM
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    known, rows = sentence_pieces.pieces(path), [*texts, *HARD]
    for chunk in (64, 1 << 15):
        got = by_id(sentence_pieces.sentence_pieces(frame(spark, rows), path, chunk))
        for i, t in enumerate(rows):
            ids, score = brute_pieces(known, sentence_pieces.MARK + t.replace(" ", sentence_pieces.MARK)) if t else ([], 0)
            assert (got[i].n_pieces, got[i].score, got[i].ids_hash) == (len(ids), score, sentence_pieces._signed(sentence_pieces.digest(ids))), (chunk, t)


def test_max_plus_is_associative():
    r = np.random.default_rng(6)
    a, b, c = (r.integers(-50, 0, (5, 5)) for _ in range(3))
    m = sentence_pieces.max_plus
    assert np.array_equal(m(m(a, b), c), m(a, m(b, c)))


def test_pipeline(spark, texts, tmp_path):
    import corpus_pipeline

    langs = ["aa" if t and len(t) > 3 else None for t in texts]
    docs = frame(spark, texts, langs).select("doc_id", "text", "lang", "source", "n_chars")
    docs.unionByName(docs.where("doc_id in (10, 12)")).write.parquet(f"{tmp_path}/documents.parquet")  # rows that repeat
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns
    rows = [r.doc_id for r in now.collect()]
    kept = set(rows)
    assert len(rows) == len(kept)
    lettered = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    norm = {}
    for i in lettered:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    left = sorted(norm.values())
    near = brute_near([texts[i] for i in left], 5, 80)
    assert kept == {i for k, i in enumerate(left) if near[k][1] == k}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == kept
