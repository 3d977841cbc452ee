"""Each operator against a brute-force version, held-out rows, or a round trip; and every odd table."""

import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from oracle import compare, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, common, dom, forest, gam, hostrules, licenses, mixing, queries, shingles, simhash, toxicity, urlgraph

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size string, fp string, id string, label int, host string"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    text = "one two three four five six seven eight nine ten " * 8
    rows = [(1, text), (1, text), (2, text + "eleven"), (3, None), (4, ""), (None, text), (None, None), (5, " \n\t "), (6, "word " * 30_000), (7, "x" * 200_000), (8, "é🎉 ½ ſ\x1c\x85a"), (9, "short"), (10, "short")]
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 2}", None, 1.0, "big", "f", "i", 1, "h") for k, (i, t) in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def no_docs(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 1, "x"), (2, 1, None, None), (None, 1, 1, None), (5, None, 0, None)], "doc_id bigint, quality int, toxic int, text string")


# 1


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    q = gam.quality(table(spark, "documents", sf), table(spark, "labels", sf)).join(table(spark, "labels", sf), "doc_id")
    r = q.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.a >= 0.95 and 0 <= r.lo <= r.hi <= 1


def test_quality_never_sees_held_out_labels(spark, labels):
    sample = gam.labelled_sample(labels.union(spark.range(200).selectExpr("id", "1", "0", "'y'")), "quality", 1000)
    assert sample.where(gam.is_held_out()).count() == 0 and sample.groupBy("doc_id").count().where("count > 1").count() == 0
    assert gam.labelled_sample(labels.union(spark.range(200).selectExpr("id", "1", "0", "'y'")), "quality", 10).count() == 10


def test_quality_of_odd_tables(odd, no_docs, labels):
    assert gam.quality(odd, labels).count() == odd.count()
    assert gam.quality(odd, labels.limit(0)).select("score").distinct().count() == 1
    assert gam.quality(no_docs, labels).count() == 0
    assert gam.keep_good(odd, labels).columns == odd.columns


def test_gam_scores_by_brute_force():
    """A score is the sigmoid of the base and one table entry per feature and pair."""
    rng = np.random.default_rng(4)
    x = rng.random((400, 4))
    m = gam.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float), rounds=20, pair_rounds=10)
    for row, got in zip(x[:50], m.score(x[:50]), strict=True):
        at = [sum(v >= c for c in cuts) for v, cuts in zip(row, m.cuts, strict=True)]
        z = m.base + sum(t[b] for t, b in zip(m.tables, at, strict=True)) + sum(t[at[i], at[j]] for i, j, t in m.pairs)
        assert got == pytest.approx(1 / (1 + np.exp(-z)))


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = gam.fit(x, y, rounds=30, pair_rounds=60)
    assert ((m.score(x) > 0.5) == (y > 0.5)).mean() > 0.95 and {m.pairs[0][0], m.pairs[0][1]} == {0, 1}


# 2


def test_host_rules_agree_with_sql(spark):
    assert compare(hostrules.host_rules(table(spark, "documents")), connect(SF), hostrules.ORACLE_SQL) == ""


def test_base_counts():
    assert hostrules.base_counts(None) == (0, 0, 0, 0, 0)
    assert hostrules.base_counts("a b c a b c\n#x\n#x\n\n \n é") == (9, 11, 2, 1, 6)
    t = "a b c d a b c e a b"
    w = t.split()
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    cover = {i + k for i, g in enumerate(tri) if tri.count(g) > 1 for k in range(3)}
    assert hostrules.base_counts(t)[4] == len(cover)


def test_a_bad_host_is_rejected_whole(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, "bad words", "bad") for i in range(300)] + [(900, good, "bad")] + [(1000 + i, good, "good") for i in range(300)] + [(2000, good, None)]
    out = {r.doc_id: r.kept for r in hostrules.host_rules(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    assert not out[900] and not out[0] and out[1000] and out[2000]


def test_host_rules_of_odd_tables(odd, no_docs):
    out = hostrules.host_rules(odd)
    assert out.count() == odd.count() and out.where("kept is null or base_failed is null").count() == 0
    assert hostrules.host_rules(no_docs).count() == 0


# 3


def brute_fingerprint(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return comp


def test_fingerprints():
    for t in ("", None, "A b", "Ab cd ef gh", "É x y z é " * 40, "word " * 70_000):
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_near_duplicates_against_all_pairs(spark):
    docs = table(spark, "documents")
    rows = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    comp = brute_components(rows, [(a, b) for a, b in itertools.combinations(rows, 2) if (rows[a] ^ rows[b]).bit_count() <= 3])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{f:016x}", comp[i]) for i, f in rows.items()}


def test_every_link_within_three_bits_is_found(spark):
    rnd = random.Random(5)
    fps = set()
    for _ in range(60):
        base = rnd.getrandbits(64)
        fps.add(base)
        for k in (1, 2, 3, 3, 4, 5):
            fps.add(base ^ sum(1 << b for b in rnd.sample(range(64), k)))
    fps |= {0, 1, 1 << 63, (1 << 63) | (1 << 31) | 1, (1 << 64) - 1}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    got = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")).collect()
    want = {tuple(sorted((signed(a), signed(b)))) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3}
    assert len(got) == len(want) and {(r.src, r.dst) for r in got} == want


def test_crowded_anchors_give_the_same_links(spark):
    rnd = random.Random(9)
    fps = {b ^ sum(1 << k for k in rnd.sample(range(64), n)) for b in [rnd.getrandbits(64) for _ in range(25)] for n in (0, 1, 2, 3, 3, 4, 6)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    one, two = ([tuple(r) for r in simhash.links(df, crowded=c).collect()] for c in (False, True))
    assert len(one) == len(set(one)) == len(two) and set(one) == set(two)


def test_near_duplicates_of_odd_tables(odd, no_docs):
    out = simhash.near_duplicates(odd)
    assert out.count() == odd.count()
    got = {r.doc_id: r for r in out.where("doc_id in (3, 4, 5)").collect()}
    assert {r.component_id for r in got.values()} == {3} and got[3].fingerprint == "0" * 16
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_representatives(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (1, 3, 4, 5, 9, 10)").count() == 3
    assert kept.where("doc_id is null").count() == 2 and simhash.keep_representatives(no_docs).count() == 0


def test_representatives_of_repeated_ids(spark):
    a, b = ("a long text of some words " * 9, "quite another text with other words in it " * 9)
    rows = [(0, a, "x"), (1, b, "x"), (1, a, "y"), (2, b, "z"), (1, b, "w"), (1, b, "x")]
    got = [sorted(tuple(r) for r in simhash.keep_representatives(spark.createDataFrame(rows[k:] + rows[:k], "doc_id int, text string, _tag string")).collect()) for k in range(3)]
    assert got[0] == got[1] == got[2] and [(i, t) for i, t, _ in got[0]] == [(0, a), (1, b)]


@pytest.mark.parametrize("block", [512, 7])
def test_large_buckets_in_blocks(spark, monkeypatch, block):
    """Near copies of one text, all different, and a chain whose ends differ: groups as those of all pairs."""
    monkeypatch.setattr(shingles, "BLOCK_SETS", block)
    monkeypatch.setattr(shingles, "PIVOTS", 2)
    rnd, base, rows = random.Random(1), [f"w{i}" for i in range(120)], []
    for i in range(60):
        w = list(base)
        for k in rnd.sample(range(120), rnd.choice((1, 2, 3, 9))):
            w[k] = f"x{i}"
        rows.append((i, " ".join(w)))
    chain = list(base)
    for i in range(60, 80):
        chain[(i - 60) * 5] = "y"
        rows.append((i, " ".join(chain)))
    sets = {i: set(shingles.shingles(t).tolist()) for i, t in rows}
    comp = brute_components(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    got = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(comp.values())) and len(set(comp.values())) > 3


def test_long_chains_are_one_component(spark):
    edges = spark.range(0, 400).selectExpr("id as src", "id + 1 as dst").union(spark.createDataFrame([(1000, 1001), (7, 7)], "src bigint, dst bigint"))
    got = {r.node: r.component for r in common.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(401)} | {1000: 1000, 1001: 1000}


# 4


@pytest.fixture(scope="module")
def tokenizer():
    return queries.tokenizer()


def test_bpe_round_trip(tokenizer):
    hf = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(2)
    texts = [None, "", " ", "It's <|endoftext|> 'LL we'll", "ΣΑΣ İ é ½ 漢字 🎉🎉", "a" * 3000, "lolololol"]
    texts += ["".join(rnd.choice("abcdehilnorstuaeit'") for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    for t in texts:
        ids = hf.encode(t or "", add_special_tokens=False).ids
        assert tokenizer.encode(t) == ids
        assert tokenizer.decode(ids) == hf.decode(ids, skip_special_tokens=False)


def test_bpe_by_plain_merging():
    merges = [("a", "b"), ("b", "c"), ("ab", "c"), ("c", "c"), ("a", "a"), ("aa", "b</w>"), ("a", "b</w>")]
    vocab = {t: i for i, t in enumerate([*"abc", *(x + "</w>" for x in "abc"), *(x + y for x, y in merges)])}
    auto = bpe.compile_automaton(vocab, merges)
    for n in range(1, 8):
        for w in map("".join, itertools.product("abc", repeat=n)):
            parts = [*w[:-1], w[-1] + "</w>"]
            for x, y in merges:
                i = 0
                while i < len(parts) - 1:
                    if (parts[i], parts[i + 1]) == (x, y):
                        parts[i : i + 2] = [x + y]
                    i += 1
            assert [auto.labels[t] for t in auto.encode(w)] == parts


def test_bpe_tables(spark, odd, no_docs, tokenizer):
    got = {(r.doc_id, r.ids_sha256): r for r in bpe.digest_table(odd, tokenizer).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[3, empty].n_tokens == 0 and got[4, empty].decoded_sha256 == empty
    assert bpe.digest_table(no_docs, tokenizer).count() == 0 and bpe.digest_table(odd, tokenizer).count() == odd.count()
    r = bpe.encode_table(odd.where("doc_id = 9"), tokenizer).first()
    assert tokenizer.decode(r.ids) == r.decoded == "short</w>"


# 5

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><div class="cookie-notice"><p>We use cookies, accept them please.</p></div>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<article><h1>A &amp; B</h1><p>First  paragraph of\n the text, long enough to be read by somebody.<p><b>Second one &mdash; also of some length, it says.<br>
<div class="ad">Buy this now</div><script>var x = "</p>";</script><ul><li>an item of a list</li><li>another item there</li></ul></article>
<section id="comments"><h3>Comments</h3><div class="comment">I liked the text very much, thank you.</div></section>
<aside class="sidebar"><p>Related things to read on and on.</p></aside><form><label>Search</label><input><button>Go</button></form><footer>&copy; somebody, all rights</footer>"""


def test_main_text():
    text = dom.extract_many([PAGE], dom.model())[0]
    assert text == "A & B\nFirst paragraph of the text, long enough to be read by somebody.\nSecond one — also of some length, it says.\nan item of a list\nanother item there"


def test_places_at_every_width():
    at = dom.FEATURES.index("place")
    for n in (3, 63, 64, 200):
        nodes, _ = dom.parse("<body>" + "<p>some words</p>" * n)
        assert dom.node_features(nodes)[2:, at] == pytest.approx(np.arange(n) / n)


def test_start_tags_are_read_whole():
    filler = f'data-x="{"y" * 9000}"'
    nodes, blocks = dom.parse(f"""<div {filler} class="comments" hidden>a</div><p title="{"> " * 40}" id='ad'>b</p><p title=it's class=ad>c</p><p data-class="ad" title="class='ad' hidden">d</p>""")
    ad, talk = 1 << dom.KINDS.index("ad"), 1 << dom.KINDS.index("talk")
    assert [(n.kinds, n.hidden) for n in nodes[1:]] == [(talk, True), (ad, False), (ad, False), (0, False)]
    assert [t for _, t in blocks] == ["a", "b", "c", "d"]
    assert dom.parse("<p " + "x " * 200_000 + "=" * 200_000)[1] == [] == dom.parse('<p a="' + "> " * 200_000)[1]


def test_pages(spark):
    import html

    for r in dom.extract_table(table(spark, "pages")).join(table(spark, "pages").select("page_id", "html"), "page_id").collect():
        body = r.html[r.html.index("<article>") : r.html.index("</article>")]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in want if b) and r.n_chars == len(r.text)


def test_decoding_is_the_best_consistent_choice():
    rnd = random.Random(1)
    for _ in range(30):
        nodes = [dom.Node("html", -1, 0, 0, False, 0)] + [dom.Node("div", rnd.randrange(i), 1, 0, False, 0) for i in range(1, 8)]
        score = np.array([rnd.uniform(-3, 3) for _ in nodes])
        value = lambda keep: sum(-np.logaddexp(0, -s if k else s) for k, s in zip(keep, score, strict=True))  # noqa: E731, B023
        ok = [k for k in itertools.product([False, True], repeat=len(nodes)) if all(not k[i] or n.parent < 0 or k[n.parent] for i, n in enumerate(nodes))]
        assert value(dom.decode(nodes, score)) == pytest.approx(max(map(value, ok)))


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "plain words only"), (5, "u", "<p" * 5000), (6, "u", "<div>" * 3000 + "x"), (7, "u", "<script>never ends"), (8, "u", '<a href="unclosed>text</a><p>more'), (None, "u", PAGE), (None, "u", PAGE)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id int, url string, html string, text string")
    out = dom.extract_table(df)
    assert out.count() == len(rows) and out.where("text is null").count() == 0
    assert out.where("page_id <= 3").select("text").distinct().collect()[0][0] == ""
    assert dom.extract_table(df.limit(0)).count() == 0


# 6


def test_rules_and_hosts(spark):
    urls = ["http://A.x.Net/p?q", "http://net", "https://example.net/en/1", "http://example.net/en", "http://m.example.com/de/x#y", "http://notexample.com/de/x", "http://w.org/fr/", "nothing", None, "http://h.com?x=/de/", "://"]
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlgraph.url_filter(spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id int, url string, html string")).collect()}
    assert out[0] == ("a.x.net", "/p", "net/", "block") and out[1][:3] == ("net", "", None)
    assert out[2][2:] == ("example.net/en/", "allow") and out[3][2:] == ("net/", "block")
    assert out[4] == ("m.example.com", "/de/x", "example.com/de/", "block") and out[5] == ("notexample.com", "/de/x", None, "allow")
    assert out[6][2:] == ("org/fr/", "allow") and out[7] == ("", "", None, "allow") == out[8] and out[9] == ("h.com", "", None, "allow") and out[10] == ("", "", None, "allow")


def brute_rank(edges, seed, damping):
    nodes = sorted({x for e in edges for x in e} | set(seed))
    score = {n: (1 - damping) * seed.get(n, 0) for n in nodes}
    for _ in range(300):
        new = {n: (1 - damping) * seed.get(n, 0) for n in nodes}
        for (a, b), k in edges.items():
            new[b] += damping * score[a] * k / sum(v for (x, _), v in edges.items() if x == a)
        score = new
    return score


def test_distrust_reaches_those_who_link_to_blocked_hosts(spark):
    link = lambda *hs: "".join(f'<p><a class=x href="http://{h}/1">l</a>' for h in hs)
    pages = [("http://farm.com/", link("casino.net", "casino.net", "bad.net")), ("http://fan.com/", link("farm.com")), ("http://news.org/", link("good.com", "farm.com")), ("http://good.com/", link("quiet.com", "casino.net", "tail.com"))]
    rows = urlgraph.parsed(spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id int, url string, html string"))
    edges = {(r.src, r.dst): r.n for r in urlgraph.host_edges(rows).collect()}
    assert edges[("farm.com", "casino.net")] == 2
    got = {r.host: r for r in urlgraph.host_verdicts(rows).collect()}
    back = brute_rank({(b, a): n for (a, b), n in edges.items()}, {"casino.net": 1, "bad.net": 1}, 0.85)
    trust = brute_rank(edges, {"news.org": 1}, 0.85)
    for h, r in got.items():
        assert r.distrust == pytest.approx(back.get(h, 0), abs=2e-6) and r.trust == pytest.approx(trust.get(h, 0), abs=2e-6)
    assert {h: r.host_verdict for h, r in got.items()} == {"farm.com": "block", "casino.net": "block", "bad.net": "block", "fan.com": "block", "news.org": "allow", "good.com": "allow", "quiet.com": "allow", "tail.com": "allow"}


def test_propagation_over_hubs_and_cycles(spark):
    """A few hundred hosts with hubs, cycles and hosts that lead nowhere, against the exact solution."""
    rnd, n = random.Random(3), 250
    edges = {(i, (i + 1) % 40): 1 for i in range(40)} | {(i, 0): 2 for i in range(40, n)} | {(1, i): 1 for i in range(100, n)}
    edges |= {(rnd.randrange(n), rnd.randrange(n)): rnd.randint(1, 4) for _ in range(900)}
    edges = {(a, b): k for (a, b), k in edges.items() if a != b and a != 60}
    bad, good = {5, 77, 120}, {9, 200}
    m = np.zeros((n, n))
    for (a, b), k in edges.items():
        m[a, b] = k
    along, against = (x / np.maximum(x.sum(1, keepdims=True), 1) for x in (m, m.T))
    seed = lambda hs: np.isin(np.arange(n), list(hs)).astype(float)
    want = {"trust": 0.15 * np.linalg.solve(np.eye(n) - 0.85 * along.T, seed(good)), "distrust": 0.15 * np.linalg.solve(np.eye(n) - 0.85 * against.T, seed(bad))}
    free = ~np.isin(np.arange(n), list(bad))
    want["exposure"] = np.linalg.solve(np.eye(n) - 0.85 * along * free[:, None], seed(bad))
    df = spark.createDataFrame([(str(a), str(b), k) for (a, b), k in edges.items()], "src string, dst string, n long")
    seeded = spark.createDataFrame([(k, str(i), float(i in hs)) for k, hs in (("trust", good), ("distrust", bad)) for i in range(n)], "kind string, host string, seed double")
    got = urlgraph.propagate(df, seeded, tolerance=1e-7).collect()
    assert len(got) == 3 * n and max(abs(r.score - want[r.kind][int(r.host)]) for r in got) < 2e-6


def test_a_farm_of_any_size_is_blocked(spark):
    link = lambda *hs: "".join(f'<a href="http://{h}/1">l</a>' for h in hs)
    for n in (1, 300):
        pages = [(f"http://farm{i}.com/", link("casino.com")) for i in range(n)] + [("http://mixed.com/", link("casino.com", "a.com", "b.com", "c.com"))]
        more = spark.createDataFrame([("casino.com", "block"), ("casino.com", "allow"), (None, "block")], "host string, action string")
        got = {r.host: r.verdict for r in urlgraph.url_filter(spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id int, url string, html string"), more=more).collect()}
        assert {h for h, v in got.items() if v == "block"} == {f"farm{i}.com" for i in range(n)}


def test_odd_urls(spark):
    df = spark.createDataFrame([(1, "http://a.com/", "<a href='//b.com'>", "x")] * 2 + [(None, None, None, None)], "page_id int, url string, html string, host string")
    assert urlgraph.url_filter(df).count() == 3 and urlgraph.url_filter(df.limit(0)).count() == 0


# 7


def brute_links(rows, threshold=0.93):
    ok = {i: np.array(v, float) for i, v, lb in rows if v is not None and lb is not None and len(v) and np.all(np.isfinite([np.nan if x is None else x for x in v])) and np.any(v)}
    label = {i: lb for i, _, lb in rows}
    return [(a, b) for a, b in itertools.combinations(ok, 2) if label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold]


def clusters(n_groups, size, seed=3):
    rng, rows = np.random.default_rng(seed), []
    for g in range(n_groups):
        c = rng.standard_normal(24)
        for _ in range(size):
            v = c + rng.standard_normal(24) * rng.uniform(0.05, 0.35)
            rows.append((len(rows), [float(np.float32(x)) for x in v], g % 2))
    return rows


def near_rows(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    return {r.vec_id: (r.n_links, r.component_id) for r in forest.near_duplicates(df, **sizes).collect()}


@pytest.mark.parametrize("sizes", [{}, {"group_rows": 60}, {"group_rows": 100, "block_rows": 20}])
def test_forest_against_brute_force(spark, sizes):
    rows = clusters(40, 12)
    want = brute_links(rows)
    got = near_rows(spark, rows, **sizes)
    links = sum(n for n, _ in got.values())
    assert 0.98 * 2 * len(want) <= links <= 2 * len(want)
    if links == 2 * len(want):
        assert {i: c for i, (_, c) in got.items()} == brute_components(range(len(rows)), want)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_found_link_is_lost(spark, seed):
    """Every link that joins a component is counted: none of its vectors has no links, and both ends count it."""
    rows = clusters(60, 30, seed)
    got = near_rows(spark, rows, group_rows=250)
    sizes = {}
    for _, c in got.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert all((n == 0) == (sizes[c] == 1) for n, c in got.values())
    want = brute_links(rows)
    assert sum(n for n, _ in got.values()) <= 2 * len(want) and all(n <= sum(i in w for w in want) for i, (n, _) in list(got.items())[:50])


def test_groups_of_copies_are_compared_once(spark):
    rows = clusters(6, 5)
    copies = [(1000 + i, rows[i % 3][1], rows[i % 3][2]) for i in range(300)]
    got, want = near_rows(spark, rows + copies), brute_links(rows + copies)
    assert sum(n for n, _ in got.values()) == 2 * len(want) and {i: c for i, (_, c) in got.items()} == brute_components([r[0] for r in rows + copies], want)


@pytest.mark.parametrize("depth", [4, 8, 12])
def test_upper_trees_by_depth(depth):
    """Recall of just linked pairs and copies per vector: both hold as the trees grow deeper."""
    rng = np.random.default_rng(depth)
    centres = rng.standard_normal((3000, 64))
    x = forest._unit(np.concatenate([centres, centres + rng.standard_normal(centres.shape) * 0.38]))
    linked = (x[:3000] * x[3000:]).sum(1) >= 0.93
    assert linked.sum() > 500 and (x[:3000] * x[3000:]).sum(1)[linked].mean() < 0.96
    together = np.zeros(3000, bool)
    for _ in range(2 + (depth + 1) // 2):
        u = rng.standard_normal((depth, 64))
        tree = forest.Tree(u / np.linalg.norm(u, axis=1, keepdims=True))
        tree.grow(x, forest.SPILL * forest.reach(64, 0.93), 0.93)
        assert depth < 12 or tree.leaves > 2**9
        row, leaf = tree.route(x)
        assert len(row) <= forest.GROWTH * len(x)
        at = [set() for _ in x]
        for r, lf in zip(row.tolist(), leaf.tolist(), strict=True):
            at[r].add(lf)
        together |= [bool(a & b) for a, b in zip(at[:3000], at[3000:], strict=True)]
    assert together[linked].mean() >= 0.9


def test_a_group_compares_few_pairs_and_misses_few():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.standard_normal((600, 64)), 5, 0)
    x = forest._unit(x + rng.standard_normal(x.shape) * rng.uniform(0.05, 0.35, (len(x), 1)))
    found, compared = forest.linked(x, 0, 0.93, seed=1)
    want = x @ x.T >= 0.93
    np.fill_diagonal(want, False)
    assert not (found & ~want).any() and found.sum() >= 0.98 * want.sum() and compared < 0.2 * len(x) ** 2 / 2
    parts, _ = forest.linked(x, 1400, 0.93, seed=1)
    want[:1400, :1400] = want[1400:, 1400:] = False
    assert not (parts & ~want).any() and parts.sum() >= 0.98 * want.sum()


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (12, [1e-200, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id int, embedding array<double>, label int, leaf string, key string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in forest.near_duplicates(df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[12] == (2, 1, False) and got[None] == (0, None, False)
    assert all(got[i] == (0, i, True) for i in range(3, 12))
    assert forest.near_duplicates(df.limit(0)).count() == 0


def test_repeated_rows_are_one_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.1], 1)], "vec_id int, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in forest.near_duplicates(df).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1)]


def test_embeddings_agree_with_sql(spark):
    assert compare(forest.near_duplicates(table(spark, "embeddings")), connect(SF), forest.ORACLE_SQL) == ""


# 8


NOTICES = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, subject to the following conditions:',
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "apache": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License from its authors.',
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unknown": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
}


def test_licences(spark, no_docs):
    rows = [(1, "x\nReleased under the MIT License.\nY"), (2, "Licensed under CC BY-NC 4.0."), (3, "my driving license"), (4, "no notice"), (5, None), (6, "This work is licensed under the GNU General Public License, version 3."), (7, "Licensed under the Apache License, Version 2.0."), (8, "Distributed under MPL-2.0"), (8, "Distributed under MPL-2.0")]
    rows += [(100 + i, f"Some words of a text.\n\n{t}\n\nAnd some more of it.") for i, t in enumerate(NOTICES.values())]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id int, text string, family string, paragraph int")
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licenses.scan(df).collect())
    assert got == [(1, 1, "mit"), (2, 0, "cc_by_nc"), (6, 0, "gpl"), (7, 0, "apache"), (8, 0, "mpl"), (8, 0, "mpl"), *((100 + i, 1, f) for i, f in enumerate(NOTICES))]
    assert licenses.scan(no_docs).count() == 0


def test_licences_of_odd_tables(spark, odd):
    notice = spark.createDataFrame([(1, "x\nAll rights reserved."), (None, "All rights reserved."), (None, "All rights reserved."), (7, "é " * 40_000 + "\nReleased under the MIT License")], "doc_id bigint, text string")
    both = odd.unionByName(notice, allowMissingColumns=True)
    assert sorted(((r.doc_id or 0), r.family) for r in licenses.scan(both).collect()) == [(0, "proprietary"), (0, "proprietary"), (1, "proprietary"), (7, "mit")]


def brute_paragraphs(text):
    out = []
    for block in re.split(r"\n\s*\n", (text or "").replace("\r", "\n")):
        lines = [x.strip() for x in block.split("\n") if x.strip()]
        width = max(map(len, lines), default=0)
        for i, x in enumerate(lines):
            wrapped = i and width <= licenses.WRAP and len(lines[i - 1]) + 1 + len(x.split(" ")[0]) > width
            goes_on = i and x[0].islower() and lines[i - 1][-1] not in ".!?:;|"
            out[-1:] = [out[-1] + " " + x] if wrapped or goes_on else [*out[-1:], x]
    return [" ".join(x.split()) for x in out]


def test_licence_scores_by_brute_force(spark):
    """Paragraphs, n-grams, probabilities, overlaps and verdicts of the documents, computed in plain Python."""
    docs = table(spark, "documents").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(NOTICES.values())], "doc_id bigint, text string"), allowMissingColumns=True)
    got = {(r.doc_id, r.paragraph): (r.family, r.probability, r.overlap, r.text) for r in licenses.scan(docs).collect()}
    rows = [(r.doc_id, k, p) for r in docs.collect() for k, p in enumerate(brute_paragraphs(r.text))]
    short = spark.createDataFrame([(p,) for _, _, p in rows if len(p.split(" ")) <= licenses.MAX_NEGATIVE_WORDS], "text string").orderBy(F.xxhash64("text"), "text").limit(licenses.MAX_NEGATIVES)
    names, weights = licenses.train([r.text for r in short.collect()])
    index, want = {g: i for i, g in enumerate(names)}, {}
    for doc, k, p in rows:
        grams = licenses._ngrams(p)
        prob = licenses._softmax((weights[-1] + sum((weights[index[g]] for g in grams if g in index), np.zeros(len(licenses.CLASSES))))[None])[0]
        family = licenses.CLASSES[int(prob.argmax())]
        if family != licenses.NONE and set(grams) & (set(names) | {" ".join(q) for ts in licenses.TEMPLATES.values() for t in ts for q in licenses._pairs(t)}):
            share = max((licenses._overlap(p, t) for t in licenses.TEMPLATES.get(family, ())), default=0.0)
            want[doc, k] = (family if share >= licenses.MIN_OVERLAP else licenses.UNKNOWN, pytest.approx(prob.max(), abs=1e-4), pytest.approx(share, abs=1e-6), p)
    assert got == want and len({f for f, *_ in got.values()}) >= 6


# 9


def test_toxicity_held_out(spark):
    bad, stems = ["grumf", "blarg", "snork"], ["zorp", "quill"]
    rnd, rows, marks = random.Random(4), [], []
    for i in range(900):
        w = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            w[3:3] = [rnd.choice(bad)] * 2 if i % 12 else [rnd.choice(stems) + rnd.choice("abcdefgh") * 2]
        rows.append((i, " ".join(w), "en" if i % 12 else "de"))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs, labels).join(labels.withColumnRenamed("toxic", "y"), "doc_id").where(gam.is_held_out()).collect()
    assert sum(r.toxic == bool(r.y) for r in got) >= 0.97 * len(got)


def test_toxicity_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"grumf {i}", "en") for i in range(3000)] + [(i, "fine words", "xx") for i in range(2, 40)], "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame([(i, int(i < 12)) for i in range(1, 40)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, marks, limit=100)
    assert model.names[-1] == "toxic" and set(model.names) <= {"toxic_en", "toxic_xx", "toxic"}


def test_chain_scores_by_brute_force():
    """Each category's linear model sees the word features and the probabilities of the categories before it."""
    rng = np.random.default_rng(2)
    model = toxicity.Chain(("toxic_en", "toxic_de", "toxic"), {f"w{i}": i for i in range(6)}, [rng.normal(size=6 + j + 1) for j in range(3)])
    for hits in ([], [0], [1, 4, 5]):
        p = []
        for w in model.weights:
            z = sum(w[h] for h in hits) + sum(a * b for a, b in zip(w[6:], p)) + w[-1]
            p.append(1 / (1 + np.exp(-z)))
        assert model.score([hits])[0].tolist() == pytest.approx(p)


def test_later_models_are_trained_with_out_of_fold_predictions(monkeypatch):
    """A row's inputs from earlier categories come from models that didn't see the row."""
    seen = []
    fit, predict = toxicity._fit, toxicity._predict
    monkeypatch.setattr(toxicity, "_fit", lambda rows, cols, scale, prior, k, y, take: (seen.append(("fit", prior.shape[1], take.copy())), fit(rows, cols, scale, prior, k, y, take))[1])
    data = [(i, i % 2, "en" if i % 4 < 2 else "de", [i % 2, 2]) for i in range(30)]
    model, prior = toxicity.fit_chain(data, 3, np.ones(3), "toxic")
    assert model[0] == ("toxic_en", "toxic_de", "toxic") and prior.shape == (30, 3)
    assert [(j, int(t.sum())) for _, j, t in seen] == [(j, n) for j in range(3) for n in (20, 20, 20, 30)]
    for i in range(3):
        w = fit(*_sparse(data), np.ones(3), np.zeros((30, 0)), 3, np.array([y * (g == "en") for _, y, g, _ in data]), np.arange(30) % 3 != i)
        assert predict(*_sparse(data), np.zeros((30, 0)), 3, w)[np.arange(30) % 3 == i] == pytest.approx(prior[np.arange(30) % 3 == i, 0])


def _sparse(data):
    return np.repeat(np.arange(len(data)), [len(r[3]) for r in data]), np.concatenate([r[3] for r in data])


def test_toxicity_of_odd_tables(odd, no_docs, labels):
    odd = odd.withColumnRenamed("fp", "__p_toxic").withColumnRenamed("host", "__scored_text").withColumnRenamed("size", "__SCORE")
    out = toxicity.toxicity(odd, labels)
    assert out.count() == odd.count() and out.where("toxic is null").count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).where("toxic").count() == 0
    assert toxicity.toxicity(no_docs, labels).count() == 0
    for keep in (toxicity.keep_civil, gam.keep_good):
        kept = keep(odd, labels)
        assert kept.columns == odd.columns and kept.where("__p_toxic = 'f' and __scored_text = 'h' and __SCORE = 'big'").count() == kept.count()


# 10


def brute_mix(rows):
    """Targets by repeated water-filling, then entries one by one in the order of virtual finish times."""
    sources = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    size = {s: sum(n for _, t, n in rows if t == s) for s in sources}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    target, free, rest = {}, set(sources), sum(size.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if 3 * size[s] <= level * weight[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3 * size[s]
            rest -= 3 * size[s]
        free -= over
    return size, target


def test_mixing_targets_and_budget(spark):
    rnd = random.Random(6)
    docs = [(i, rnd.choice(["a", "b", "c", "d", None]) if i % 3 else "hot", rnd.randint(0, 60)) for i in range(900)] + [(5000, "tiny", 4)]
    df = spark.createDataFrame([(i, "w " * n, s) for i, s, n in docs], "doc_id bigint, text string, source string")
    size, target = brute_mix(docs)
    got = mixing.mix(df).join(df.select("doc_id", "source"), "doc_id").collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    for s in size:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 130
    total = sum(size.values())
    assert total - 130 <= sum(r.taken for r in got) <= total
    again = mixing.mix(df.repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}


def test_mixing_reruns_agree_without_ids(spark):
    rows = [(None, " ".join(f"w{i}" for _ in range(5)), "ab"[i % 2]) for i in range(80)]
    one, two = (sorted(r.text for r in mixing.mixed_rows(spark.createDataFrame(x, "doc_id bigint, text string, source string").repartition(n)).collect()) for x, n in ((rows, 1), (rows[::-1], 5)))
    assert one == two and len(set(one)) > 20


def test_mixing_agrees_with_sql(spark):
    assert compare(mixing.mix(table(spark, "documents")), connect(SF), mixing.ORACLE_SQL) == ""


def test_mixed_rows(odd, no_docs):
    got, rows = mixing.mix(odd), mixing.mixed_rows(odd)
    assert rows.columns == odd.columns and got.count() == odd.count()
    want = got.where("taken > 0").agg(F.sum(F.col("taken") / F.col("size"))).first()[0]
    assert rows.count() == want and mixing.mix(no_docs).count() == 0 and mixing.mixed_rows(no_docs).count() == 0


# shared


def test_lookup_join_beyond_the_broadcast_bound(spark):
    left = spark.range(200).selectExpr("id", "if(id % 4 = 3, null, if(id < 100, 0, id % 3)) as k")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    for how in ("left", "inner", "left_semi"):
        want = None
        for sizes in ({}, {"limit": 1}, {"limit": 1, "few": 10}):
            got = common.lookup_join(left, right, "k", how, **sizes)
            rows = sorted(tuple(str(r[c]) for c in sorted(got.columns)) for r in got.collect())
            want = want or rows
            assert rows == want and len(rows) > 90


def test_components_with_hot_nodes(spark):
    star = spark.range(1, 300).selectExpr("id as src", "0L as dst").union(spark.range(300, 600).selectExpr("id as src", "900L as dst"))
    got = {r.node: r.component for r in common.connected_components(star, few=10).collect()}
    assert got == {i: 0 for i in range(300)} | {i: 300 for i in [*range(300, 600), 900]}


def test_scratch_tables_are_removed(spark):
    with common.scratch(spark):
        one = common.materialize(spark.range(3), "one")
        two = common.materialize(one.where("id > 0"), "two")
    assert two.count() == 2
    with pytest.raises(Exception):
        one.count()
