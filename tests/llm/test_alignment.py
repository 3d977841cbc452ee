"""Token alignment against a plain version that walks both token lists, and every odd table."""

import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import align
from tessera.llm.bpe import byte_symbols

SF = "/root/testdata/sf0.001"
A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    return align.ByteTokens(A_FILE), align.PieceTokens(B_FILE)


@pytest.fixture(scope="module")
def libraries():
    tok = Tokenizer.from_file(A_FILE)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def plain(libraries, text):
    """((A ids, B ids) of each group, ends), or None."""
    tok, sp = libraries
    byte = {c: b for b, c in byte_symbols().items()}
    a, b = tok.encode(" " + (text or ""), add_special_tokens=False).ids, sp.encode(text or "")
    spelled = [bytes(byte[c] for c in tok.id_to_token(i)) for i in a], [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
    if not text or any(b"".join(s) != (" " + text).encode() for s in spelled):
        return None
    ends = [list(itertools.accumulate(map(len, s))) for s in spelled]
    out, at = [], [0, 0]
    for c in sorted(set(ends[0]) & set(ends[1])):
        group = ([], [])
        for side, ids in enumerate((a, b)):
            while at[side] < len(ids) and ends[side][at[side]] <= c:
                group[side].append(ids[at[side]])
                at[side] += 1
        out.append((*group, c))
    return out


def expected(libraries, rows):
    groups = [plain(libraries, t) for _, t in rows]
    links = [Counter((p, q) for a, b, _ in g or () for p in a for q in b) for g in groups]
    count = Counter(pair for each in links for pair in each)
    best = defaultdict(int)
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for (i, _), g, each in zip(rows, groups, links, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b, _ in g or ())
        out.append((i, sum(len(a) for a, _, _ in g or ()), sum(len(b) for _, b, _ in g or ()), len(g or ()), sum(each.values()), sum(m for (p, q), m in each.items() if count[p, q] == best[p]),
                    sum(m * count[k] for k, m in each.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


ODD = [(1, "one two  three\n\nfour"), (1, "one two  three\n\nfour"), (2, None), (3, ""), (None, "naïve 🎉🎉 東京 ½\x00́ <|endoftext|> <s> <0x41>"), (None, None), (4, "the mark ▁ is a space"), (5, " \n\t "), (6, "word and more of it, " * 9_000), (7, "x" * 150_000), (8, "'s 're'll 123 4567 ...!!! é  　|"), (9, "short"), (10, "short"), (11, "\n"), (12, "�▁")]


def result(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sent_pairs", [align.SENT_PAIRS, 0])
def test_alignment_of_odd_tables(spark, tokens, libraries, sent_pairs):
    odd = spark.createDataFrame([(i, t, "x", 1.0, "k", b"\0") for i, t in ODD], "doc_id bigint, text string, id string, digest double, block string, ids binary").repartition(3)
    assert result(align.align(odd, *tokens, sent_pairs=sent_pairs)) == expected(libraries, ODD)
    assert align.align(odd.limit(0), *tokens, sent_pairs=sent_pairs).collect() == []


def test_alignment_of_the_documents(spark, tokens, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(align.align(docs, *tokens)) == expected(libraries, [(r.doc_id, r.text) for r in docs.collect()])


def test_groups_in_many_blocks(spark, tokens, libraries, monkeypatch):
    monkeypatch.setattr(align, "BLOCK", 7)  # the driver's stretches; workers fork from it in these tests
    rows = [(k, t) for k, (_, t) in enumerate(ODD) if t and len(t) < 1000]
    got = align.group_table(spark.createDataFrame(rows, "doc_id bigint, text string"), *tokens).collect()
    for k, text in rows:
        own = sorted((r for r in got if r.doc_id == k), key=lambda r: r.place)
        want = plain(libraries, text) or []
        assert [(r.a_ids, r.b_ids, r.end) for r in own] == want and [r.start for r in own] == [0, *[g[2] for g in want]][: len(want)]


def test_sweep_by_blocks_is_the_sweep():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 6, 50), rng.integers(1, 6, 50)
        ids = [rng.integers(0, 50, 400).astype(np.uint16) for _ in range(2)]
        ends = [np.cumsum(n[i]) for n, i in zip(lengths, ids, strict=True)]
        whole = align.Sweep(lengths).block(tuple(ids), (0, 0))
        state, parts = align.Sweep(lengths), []
        for lo in range(0, int(max(e[-1] for e in ends)) + 40, 40):
            inside = [np.flatnonzero((e > lo) & (e <= lo + 40)) for e in ends]
            starts = [int(e[i[0] - 1]) if len(i) and i[0] else 0 for e, i in zip(ends, inside, strict=True)]
            parts.append(state.block((ids[0][inside[0]], ids[1][inside[1]]), tuple(starts)))
        for k in range(5):
            assert np.concatenate([p[k] for p in parts]).tolist() == whole[k].tolist()


def test_links_of_large_groups():
    rng = np.random.default_rng(2)
    na, nb = np.array([1, 2000, 3, 1]), np.array([2, 1500, 1, 900])
    ia, ib = rng.integers(0, 70, na.sum()).astype(np.uint16), rng.integers(0, 90, nb.sum()).astype(np.uint16)
    keys, times = align._counted(list(align.linked(ia, ib, na, nb, 100)))
    want = Counter()
    for a0, a1, b0, b1 in zip(np.cumsum(na) - na, np.cumsum(na), np.cumsum(nb) - nb, np.cumsum(nb), strict=True):
        for p, x in Counter(ia[a0:a1].tolist()).items():
            for q, y in Counter(ib[b0:b1].tolist()).items():
                want[p * 100 + q] += x * y
    assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == want


def test_tokens_are_the_libraries(tokens, libraries):
    """Every code point between others, in both tokenizers."""
    a, b = tokens
    tok, sp = libraries
    for lo in [*range(0, 0xD800, 512), *range(0xE000, 0x11000, 512), 0x1F300, 0x20000]:
        text = " ".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}\n" for c in range(lo, lo + 512) if c != 0x2581)
        assert a.encode(text).tolist() == tok.encode(" " + text, add_special_tokens=False).ids
        want = sp.encode(text)
        got = b.encode(text)
        same = b"".join(b.bytes.get(i, b"") for i in want) == (" " + text).encode()
        assert (got is None) != same and (got is None or got.tolist() == want)


def test_packing():
    for x in (np.zeros(0, np.uint16), np.arange(70_000, dtype=np.uint32) * 7, np.array([255], np.uint8), np.array([2**63], np.uint64)):
        assert align.unpack(align.pack(x)).tolist() == x.tolist()
