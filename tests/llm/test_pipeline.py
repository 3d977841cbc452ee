"""The stages keep the documents' columns, take effect, and end in tokens of the mixture."""

import itertools
import random

import corpus_pipeline

from tessera.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "bpe"]
    docs = table(spark, SF, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        now = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and now <= ids, name
        ids = now
    assert 0 < len(ids) < 200
    assert docs.count() == corpus_pipeline.run(spark, SF).count()


def test_clean_documents_stay(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    clean = docs.join(labels.where("quality = 1 and toxic = 0"), "doc_id", "left_semi")
    for name, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, clean, SF).count() >= 0.98 * clean.count(), name


def test_queries_are_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names) and [n for n in names if n.startswith("op")] == list(QUERIES)


def five_grams(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """Least ids of the groups that pairs of similarity 0.8 join."""
    sets = {i: five_grams(t) for i, t in rows}
    comp = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        small, large = sorted((len(sets[a]), len(sets[b])))
        if small >= 0.79 * large and comp[a] != comp[b]:
            both = len(sets[a] & sets[b])
            if not large or both / (small + large - both) >= 0.8:
                lo, hi = sorted((comp[a], comp[b]))
                comp = {i: lo if c == hi else c for i, c in comp.items()}
    return set(comp.values())


def test_edited_copies_leave(spark):
    rnd, rows = random.Random(8), []
    for _ in range(12):
        base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        rows.append(base)
        for edits in (1, 3, 4, 5, 8, 40):
            w = list(base)
            for k in rnd.sample(range(200), edits):
                w[k] = "edit"
            rows.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(900, None), (901, ""), (902, "a b"), (903, "A  b")]
    want = brute_kept(rows)
    got = corpus_pipeline.distinct(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(want) and len(want) <= len(rows) - 30


def test_near_duplicates_of_the_documents(spark):
    docs = table(spark, SF, "documents")
    assert {r.doc_id for r in corpus_pipeline.distinct(spark, docs, SF).collect()} == brute_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_stages_of_odd_and_empty_tables(spark):
    """Nulls, empty and long texts, repeated rows and extra columns go through every stage; so do no rows at all."""
    text = "one two three four five six seven eight nine ten " * 8
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, text, "en", None), (None, None, None, None), (4, "word " * 20_000, "de", "b"), (5, "x" * 100_000, "de", "b")]
    odd = spark.createDataFrame([(*r, 1, "clash", 2.0) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, __score string, _tag double")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            got = out.collect()
            assert name == "bpe" or (out.columns == docs.columns and {r.doc_id for r in got} <= {r[0] for r in rows}), name
            assert bool(got) <= bool(docs.count()) and (name != "bpe" or len(got) == docs.count()), name
