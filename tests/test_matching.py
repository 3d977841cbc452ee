"""Matching against taking one pair after the other, folds of whole groups, and literal search against plain search."""

import random

import pytest
import xxhash
from oracle import connect
from pyspark.sql import functions as F

from tessera.operators import matching as mt
from tessera.plans import registry

SF = "/root/testdata/sf0.001"


def one_after_the_other(edges, h):
    used, out = set(), set()
    for g, a, b, s in sorted(edges, key=lambda e: (-e[3], h[e[1]], h[e[2]], e[1], e[2])):
        if ("l", g, a) not in used and ("r", g, b) not in used:
            used |= {("l", g, a), ("r", g, b)}
            out.add((g, a, b, s))
    return out


def hashes(spark, keys):
    return {r.k: r.h for r in spark.createDataFrame([(k,) for k in keys], "k long").select("k", F.xxhash64("k").alias("h")).collect()}


@pytest.mark.parametrize("values", [3, 10**6])
def test_greedy_matching(spark, values):
    rng = random.Random(values)
    edges = [(g, a, 100 + b, float(rng.randrange(values))) for g in "xy" for a in range(15) for b in range(12) if rng.random() < 0.6]
    df = spark.createDataFrame(edges, "g string, l long, r long, s double").repartition(3)
    got = {tuple(r) for r in mt.greedy_matching(df, "g", "l", "r", "s").collect()}
    assert got == one_after_the_other(edges, hashes(spark, range(112)))


def test_greedy_matching_of_odd_tables(spark):
    df = spark.createDataFrame([("g", 1, 10, 0.9), ("g", 1, 10, 0.2), ("g", 1, None, 2.0), (None, 1, 10, 3.0), ("g", 2, 10, 0.7)], "g string, l long, r long, s double")
    assert [tuple(r) for r in mt.greedy_matching(df, "g", "l", "r", "s").collect()] == [("g", 1, 10, 0.9)]
    assert mt.greedy_matching(df.limit(0), "g", "l", "r", "s").count() == 0


@pytest.mark.parametrize("spread", [4, 1000])
def test_nearest_matching_is_greedy_over_all_pairs(spark, spread):
    rng = random.Random(spread)
    left = [(rng.choice("ab"), k, float(rng.randrange(spread))) for k in range(40)]
    right = [(rng.choice("ab"), 100 + k, float(rng.randrange(spread))) for k in range(30)] + [("c", 200, 1.0)]
    h = hashes(spark, range(201))
    want = one_after_the_other([(g, a, b, -abs(x - y)) for g, a, x in left for q, b, y in right if g == q], h)
    a, b = (spark.createDataFrame(d, "g string, k long, v double") for d in (left, right))
    got = {tuple(r) for r in mt.nearest_matching(a.withColumnRenamed("k", "l"), b.withColumnRenamed("k", "r"), "g", "l", "r", "v", per_end=1).collect()}
    assert {(g, i, j, s + 0.0) for g, i, j, s in got} == {(g, i, j, s + 0.0) for g, i, j, s in want}


def test_matching_query_is_greedy(spark):
    parts = [r for r in spark.read.parquet(f"{SF}/part.parquet").collect()]
    h = hashes(spark, [r.p_partkey for r in parts])
    edges = [(a.p_brand, a.p_partkey, b.p_partkey, -abs(a.p_retailprice - b.p_retailprice)) for a in parts for b in parts if a.p_brand == b.p_brand and a.p_partkey % 2 == 1 and b.p_partkey % 2 == 0]
    want = {e[:3] for e in one_after_the_other(edges, h)}
    assert {tuple(r)[:3] for r in registry.queries()["j13_greedy_matching"](spark, SF).collect()} == want


@pytest.mark.parametrize("few", [10**4, 0])
def test_folds_keep_groups_whole_and_classes_even(spark, few):
    rng = random.Random(2)
    rows = [(g, rng.choice("AABC" if g % 2 else "ABCC")) for g in range(300) for _ in range(1 + int(rng.expovariate(0.2)))] + [(None, "A"), (1, None)]
    df = spark.createDataFrame(rows, "g long, c string")
    folds = {r.g: r.fold for r in mt.stratified_group_folds(df, "g", "c", 5, 3, few=few, share=100).collect()}
    assert len(folds) == 300 and set(folds) == set(range(300))
    for c in "ABC":
        n = [sum(1 for g, x in rows if x == c and g is not None and folds[g] == f) for f in range(5)]
        assert max(n) - min(n) <= 0.15 * sum(n)
    again = mt.stratified_group_folds(df.repartition(7), "g", "c", 5, 3, few=few, share=100)
    assert {r.g: r.fold for r in again.collect()} == folds
    assert mt.stratified_group_folds(df.limit(0), "g", "c", 5, 3, few=few).count() == 0


def test_fold_query_leaks_no_group(spark):
    got = registry.queries()["l06_stratified_group_folds"](spark, SF).collect()
    assert {r.n_split for r in got} == {0} and len({r.fold for r in got}) == 3
    con = connect(SF)
    for lang, n in con.execute("select lang, count(*) from documents group by 1").fetchall():
        assert sum(r.n_rows for r in got if r.lang == lang) == n


def test_literal_hits(spark):
    rng = random.Random(6)
    words = ["ab", "b", "", "a  b", "xay", "%", "é", "b\nc"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for k in range(150)] + [(998, None), (999, "")]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 1, 2, 2, 3, 3, 4, 5, 6) for _ in range(4)] + ["", None, "b", texts[5][1][1:-1], texts[9][1]]
    got = {(r.k, r.i) for r in mt.literal_hits(spark.createDataFrame(texts, "k long, t string"), "k", "t", spark.createDataFrame([(i,) for i in items], "i string"), "i", bare=3).collect()}
    assert got == {(k, i) for k, t in texts for i in items if i and t is not None and i in t}


def test_leakage_has_no_nested_loop(spark):
    plan = registry.queries()["f22_literal_leakage"](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hash_is_what_spark_says(spark):
    assert spark.range(1).select(F.xxhash64(F.lit(5).cast("bigint"))).first()[0] == int.from_bytes(xxhash.xxh64_digest((5).to_bytes(8, "little"), 42), "big", signed=True)
