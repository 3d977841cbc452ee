"""Document fingerprints: plain versions of classes, windows and comparison; likeness of edited texts; odd tables."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import digests

SF = "/root/testdata/sf0.001"


def plain_classes(data):
    f = [round(k * np.log2(k) * 2**16) if k else 0 for k in range(34)]
    padded = [0] * 32 + list(data)
    return [min((f[32] - sum(f[c] for c in Counter(padded[j + 1 : j + 33]).values())) * 1000 // f[32], 999) for j in range(len(data))]


def test_classes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 40, 700):
        for top in (1, 3, 256):
            x = rng.integers(0, top, n).astype(np.uint8)
            assert digests.classes(x).tolist() == plain_classes(x)


def plain_features(text, ranks):
    """The least key of each ``span`` neighbouring windows, in order, once each."""
    if not text:
        return []
    data = np.frombuffer(text, np.uint8)
    keys = digests.keys(np.concatenate((np.zeros(31, np.uint8), data)), ranks)[31:].tolist()
    span = next(s for top, s in digests.SPANS if len(text) <= top)
    chosen = [min(keys[max(0, i) : i + span]) for i in range(1 - span, len(keys))]
    strong = [k for k in chosen if k >> 54 < digests.BINS]
    return list(dict.fromkeys(strong if strong and len(text) > 128 else chosen))


def test_features_however_texts_are_laid_out(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 97 + top, n).astype(np.uint8)) for n in (0, 1, 6, 60, 128, 129, 512, 513, 4096, 4097, 20_000) for top in (1, 4, 26)]
    ranks = np.concatenate((np.full(digests.WEAK, 1000), rng.permutation(1000 - digests.WEAK)))
    want = [plain_features(t, ranks) for t in texts]
    assert [f.tolist() for f in digests.features(texts, ranks)] == want
    monkeypatch.setattr(digests, "CHUNK", 300)
    assert [f.tolist() for f in digests.features(texts, ranks)] == want


def test_a_shorter_span_selects_what_a_longer_one_does(monkeypatch):
    text = [bytes(np.random.default_rng(3).integers(97, 110, 3000).astype(np.uint8))]
    ranks, chosen = np.arange(1000), {}
    for span in (1, 4, 16, 64):
        monkeypatch.setattr(digests, "SPANS", ((1 << 62, span),))
        chosen[span] = set(digests.features(text, ranks)[0].tolist())
    assert chosen[64] < chosen[16] < chosen[4] < chosen[1]


def test_likeness():
    rng = np.random.default_rng(4)
    a, b = (digests.chain(rng.integers(0, 2**63, 700, dtype=np.uint64)) for _ in range(2))
    assert len(a) == 5 and digests.likeness(a, a) == 1 and digests.likeness(a, b) == 0
    assert digests.likeness(a, np.vstack([b, a])) == pytest.approx(1) and digests.likeness(digests.chain(np.zeros(0, np.uint64)), a) == 0
    none = digests.chain(np.zeros(0, np.uint64))
    assert digests.likeness(none, none) == 1 and digests.written(none) == "" and digests.read("").shape == (0, 256)
    assert (digests.read(digests.written(a)) == a).all()
    shared = rng.integers(0, 2**63, 120, dtype=np.uint64)
    x, y = (digests.chain(np.concatenate((shared, rng.integers(0, 2**63, 40, dtype=np.uint64)))) for _ in range(2))
    assert digests.likeness(x, y) == digests.likeness(y, x) == pytest.approx(0.75, abs=0.06)


def following(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, hashlib.md5((rows[k][1] or "").encode()).hexdigest()))
    return {k: order[(i + 1) % len(order)] for i, k in enumerate(order)}


def check(spark, rows, ranks=None):
    df = spark.createDataFrame([(i, t, "x", 1.0, b"", 1) for i, t in rows], "doc_id bigint, text string, fingerprint string, n_chars double, t binary, part int").repartition(3)
    got = digests.near_edited(df).collect()
    ranks = digests.rarity(df)
    marks = [digests.chain(f) for f in digests.features([(t or "").encode() for _, t in rows], ranks)]
    want, after = [], following(rows)
    for k, (i, t) in enumerate(rows):
        t, m = t or "", len(t or "") // 4
        new = t[: len(t) - m] + (rows[after[k]][1] or "")[:m]
        changed = digests.chain(digests.features([new.encode()], ranks)[0])
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), digests.written(marks[k]), digests.written(changed), digests.likeness(marks[k], changed), digests.likeness(marks[k], marks[after[k]])))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    return got


def test_documents_and_their_edits(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = check(spark, rows)
    long = [r for r in got if r.n_chars >= 400]
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.97 and np.median([r.near_edited for r in long]) > 0.65
    assert np.mean([r.near_next < 0.1 for r in long]) > 0.95


def test_odd_tables(spark):
    text = "one two three four five six seven eight nine ten " * 8
    rows = [(1, text), (1, text), (2, text + "eleven"), (3, None), (4, ""), (None, text), (None, None), (5, " \n\t "), (6, "word " * 30_000), (7, "x" * 300_000), (8, "é🎉 ½ ſ\x1c\x85a"), (9, "short"), (10, "short"), (11, "\0" * 50)]
    got = check(spark, rows)
    assert len({r.fingerprint for r in got if r.doc_id in (9, 10)}) == 1 and all(r.fingerprint == "" for r in got if not r.n_chars)
    assert check(spark, [(1, text)])[0].near_next == 1
    assert digests.near_edited(spark.createDataFrame(rows, "doc_id bigint, text string").limit(0)).collect() == []
    one = digests.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).where(F.col("doc_id") == 6).first()
    assert one.fingerprint == next(r.fingerprint for r in got if r.doc_id == 6)


def test_rarity_counts_all_windows(spark, monkeypatch):
    monkeypatch.setattr(digests, "CHUNK", 100)  # laid out in many pieces
    counted = sum(np.bincount(digests.classes(laid)[own], minlength=1000) for laid, own in digests._grouped([b"abcdefgh" * 30, b"", b"xyz" * 11]))
    assert counted.tolist() == np.bincount(plain_classes(b"abcdefgh" * 30) + plain_classes(b"xyz" * 11), minlength=1000).tolist()
    texts = ["abcabc" * 40, None, "", "zz" * 30, "The quick brown fox jumps over the lazy dog " * 20]
    n = Counter(c for t in texts if t for c in plain_classes(t.encode()))
    ranks = digests.rarity(spark.createDataFrame([(t,) for t in texts], "text string"))
    strong = [c for c in range(digests.WEAK, 1000) if n[c]]
    assert sorted(strong, key=lambda c: ranks[c]) == sorted(strong, key=lambda c: (n[c], -c)) and min(ranks[: digests.WEAK]) >= digests.BINS
