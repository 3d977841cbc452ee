"""Literal cases and metamorphic checks of the metric kernels."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.columns import clean_value, decimal_text, dot, ellipsis, jaccard, unit
from tessera.functions.text import canonical_entities, split_ids, tokens
from tessera.operators import encoders
from tessera.operators import metrics as met
from tessera.operators import relational as rel
from tessera.operators import resampling as res
from tessera.operators.pairorder import pair_order_accuracy
from tessera.plans import registry
from tessera.operators.geometry import cosine_pairs, distinct_cosine_pairs, fuse_ranks, spearman_pairs, unordered_pairs


def one(df, col):
    return df.first()[col]


def test_fractional_topk(spark):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([5, 4, 4, 4, 1])], "q int, i int, s double")
    got = [r.rel for r in met.fractional_topk(df, "s", 2, "q").orderBy("i").collect()]
    assert got == pytest.approx([1, 1 / 3, 1 / 3, 1 / 3, 0])


def test_boundary_ties(spark):
    df = spark.createDataFrame([(0, i, 2.0 if i < 8 else 1.0) for i in range(13)], "q int, i int, s double")
    assert [r.rel for r in met.fractional_topk(df, "s", 10, "q").orderBy("i").collect()] == pytest.approx([1] * 8 + [0.4] * 5)


def test_rank_correlation(spark):
    rows = [(g, float(x), float(y)) for g, ys in (("up", range(5)), ("down", range(0, -5, -1)), ("flat", [1] * 5)) for x, y in zip(range(5), ys, strict=True)]
    got = {r.g: (r.rho, r.status) for r in met.spearman(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", "g").collect()}
    assert got["up"] == (pytest.approx(1), "ok") and got["down"] == (pytest.approx(-1), "ok") and got["flat"] == (None, "constant_response")


def test_too_few_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 3.0), ("a", float("nan"), 1.0)], "g string, x double, y double")
    assert met.spearman(df, "x", "y", "g").first().status == "too_few"
    assert met.spearman(df.limit(0), "x", "y", "g").count() == 0


def brute_ndcg(rel, score, k):
    orders = []
    for p in itertools.permutations(range(len(score))):
        if all(score[p[i]] >= score[p[i + 1]] for i in range(len(p) - 1)):
            orders.append(sum(rel[j] / math.log2(r + 2) for r, j in enumerate(p[:k])))
    ideal = sum(x / math.log2(r + 2) for r, x in enumerate(sorted(rel, reverse=True)[:k]))
    return np.mean(orders) / ideal


def test_ndcg_is_the_mean_over_tie_orders(spark):
    score, truth = [4.0, 3.0, 3.0, 3.0, 1.0], [0.2, 1.0, 0.4, 0.0, 0.0]
    df = spark.createDataFrame([(0, s, t) for s, t in zip(score, truth, strict=True)], "q int, s double, t double")
    got = met.expected_ndcg(df, "t", "s", 2, "q", minimum=2).first()
    assert got.ndcg == pytest.approx(brute_ndcg([0, 1, 1, 0, 0], score, 2))


@pytest.mark.parametrize("parts", [1, 7])
def test_all_ties_are_random_and_perfect_is_one(spark, parts):
    rnd = random.Random(3)
    rows = [(q, rnd.random()) for q in range(3) for _ in range(14)]
    df = spark.createDataFrame(rows, "q int, t double").repartition(parts)
    tied = met.expected_ndcg(df.withColumn("s", F.lit(1.0)), "t", "s", 10, "q").collect()
    assert all(r.excess == pytest.approx(0) for r in tied)
    assert all(r.ndcg == pytest.approx(1) for r in met.expected_ndcg(df.withColumn("s", F.col("t")), "t", "s", 10, "q").collect())


def test_ties_from_counts(spark):
    """Harmonic numbers need no list of places, and a target without a score has none."""
    data = [(0, 2, 3, 9), (1, 100_000, 50_000, 400_000), (2, 250, 10, 300), (3, 0, 0, 5)]
    got = met.tie_retrieval(spark.createDataFrame(data, "q int, a long, e long, n long"), "q")
    h = lambda n: sum(1 / i for i in range(1, n + 1))
    for r, (_, a, e, n) in zip(got.orderBy("q").collect(), data, strict=True):
        assert r.mrr == (pytest.approx((h(a + e) - h(a)) / e, rel=1e-10) if e else None) and r.random_mrr == pytest.approx(h(n) / n, rel=1e-13)
    assert "sequence" not in got._jdf.queryExecution().toString()


def test_m12_makes_no_pairs(spark):
    from tessera.plans import registry

    plan = registry.queries()["m12_expected_ties"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Window" not in plan and "Generate explode(array(" not in plan


def test_uninformative_truth(spark):
    df = spark.createDataFrame([(0, float(i), 1.0) for i in range(14)], "q int, s double, t double")
    r = met.expected_ndcg(df, "t", "s", 10, "q").first()
    assert r.status == "UNINFORMATIVE_TRUTH" and r.ndcg is None


def test_expected_ties(spark):
    df = spark.createDataFrame([(0, 3.0, False), (0, 2.0, True), (0, 2.0, False), (0, 1.0, False)], "q int, s double, t boolean")
    r = met.expected_tie_retrieval(df, "s", "t", "q").first()
    assert r.mrr == pytest.approx((1 / 2 + 1 / 3) / 2) and r.hit1 == 0 and r.random_mrr == pytest.approx(sum(1 / i for i in range(1, 5)) / 4)


def test_pair_order_of_a_constant_prediction(spark):
    df = spark.createDataFrame([("g", i, float(i), 0.0) for i in range(5)], "g string, k int, t double, p double")
    assert pair_order_accuracy(df, "t", "p", "g").first().accuracy == 0.5


def test_equal_children(spark):
    df = spark.createDataFrame([("m", "a", 1.0), ("m", "a", None), *[("m", "b", 0.0)] * 4], "m string, g string, v double")
    assert one(met.equal_weight(df, "v", [["m", "g"], ["m"]]), "v") == 0.5


def test_cosine_scale_and_zero(spark):
    df = spark.createDataFrame([("g", 0, [1.0, 0.0]), ("g", 1, [2.0, 0.0]), ("g", 2, [0.0, 0.0])], "g string, k int, v array<double>")
    assert [r.sim for r in cosine_pairs(df, "g", "k", "v").orderBy("i", "j").collect()] == [1, 0, 0]
    assert distinct_cosine_pairs(df, "g", "k", "v").count() == 3


def test_spearman_leaves_constant_rows_out(spark):
    df = spark.createDataFrame([("g", 0, [1.0, 2.0, 3.0]), ("g", 1, [10.0, 20.0, 40.0]), ("g", 2, [1.0, 1.0, 1.0])], "g string, k int, v array<double>")
    assert [(r.i, r.j, round(r.sim, 9)) for r in spearman_pairs(df, "g", "k", "v").collect()] == [(0, 1, 1.0)]


def test_rank_fusion(spark):
    df = spark.createDataFrame([(0, 1.0, 3.0), (0, 2.0, 2.0), (0, 3.0, 1.0)], "g int, a double, b double")
    assert [r.fused for r in fuse_ranks(df, "a", "b", "g").collect()] == [0.5] * 3


def test_jaccard(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2]), ([], [])], "a array<int>, b array<int>")
    assert [r.j for r in df.select(jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [pytest.approx(2 / 3), 1.0]


def test_columns(spark):
    df = spark.createDataFrame([(" NaN ", "100.500", "a; b;a", '["x", "y"]', "abc def ghi")], "a string, d string, e string, j string, t string")
    r = df.select(clean_value(F.col("a")).alias("a"), decimal_text(F.col("d")).alias("d"), canonical_entities(F.col("e")).alias("e"), split_ids(F.col("j")).alias("j"), ellipsis(F.col("t"), 4).alias("t"), tokens(F.lit("Ab c déf")).alias("w"), unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("p")).first()
    assert (r.a, r.d, r.e, r.j, r.t, r.w, r.u, r.p) == (None, "100.5", "a+b", ["x", "y"], "abc...", ["ab", "déf"], [0.6, 0.8], 11.0)


def test_contract_join_fails_on_duplicates(spark):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="not unique"):
        rel.contract_join(a, b, ["k"]).collect()


def test_controls_fall_back_to_donors(spark):
    rows = [("x", 0, 0, False)] + [(None, 0, 0, True)] * 3 + [(None, 0, 1, True)] * 20
    df = spark.createDataFrame(rows, "atom string, donor int, batch int, c boolean")
    assert rel.match_controls(df, "atom", "donor", "batch", "c").first().asDict() == {"atom": "x", "level": "donor", "n_pert": 1, "n_controls": 23}


def test_sign_flip(spark):
    df = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 3.0, 0.0)], "g string, v double")
    assert res.sign_flip(df, "g", "v").first().asDict() == {"g": "g", "n": 3, "p": 0.25}


def test_bootstrap_of_a_constant(spark):
    df = spark.createDataFrame([("g", i, 2.0) for i in range(5)], "g string, k int, v double")
    r = res.bootstrap_ci(df, "g", "k", "v", 50, 1).first()
    assert (r.n, r.mean, r.lo, r.hi) == (5, 2, 2, 2)


@pytest.mark.parametrize("units", [10**5, 0])
def test_bootstrap_of_the_same_draws(spark, units):
    rng = np.random.default_rng(6)
    rows = [(g, k, float(x)) for g in ("a", "b", None) for k, x in enumerate(rng.normal(0, 1, 23))] + [("a", 99, None)]
    got = {r.g: r for r in res.bootstrap_ci(spark.createDataFrame(rows, "g string, k int, v double").repartition(4), "g", "k", "v", 130, 5, array_units=units).collect()}
    for g in ("a", "b", None):
        v = [x for q, _, x in rows if q == g and x is not None]
        name = [] if g is None else [g]
        at = lambda d, j: int(hashlib.sha256("|".join(["5", *name, str(d), str(j)]).encode()).hexdigest()[:8], 16) % len(v)
        means = [np.mean([v[at(d, j)] for j in range(len(v))]) for d in range(130)]
        assert got[g].n == 23 and [got[g]["mean"], got[g].lo, got[g].hi] == pytest.approx([np.mean(v), *np.quantile(means, [0.025, 0.975])])


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 6):
        c = rng.random((n, n))
        p = res.assign(c)
        best = min(sum(c[i, q[i]] for i in range(n)) for q in itertools.permutations(range(n)))
        assert sorted(p) == list(range(n)) and sum(c[i, p[i]] for i in range(n)) == pytest.approx(best)


def test_derangements_keep_no_text():
    texts = ["a", "b", "b", "c", "d"]
    p = res.derangement(list("abcde"), texts, 1)
    assert p and all(texts[i] != texts[j] for i, j in enumerate(p))


def test_assignment_is_the_cheapest():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 6):
        cost = rng.random((n, n))
        assert cost[np.arange(n), res.assign(cost)].sum() == pytest.approx(min(cost[np.arange(n), list(p)].sum() for p in itertools.permutations(range(n))))


def test_pairs_in_blocks_are_the_same(spark):
    df = spark.range(40).selectExpr("id % 3 as g", "id as k", "id * 2 as v")
    one, many = (sorted(map(tuple, unordered_pairs(df, "g", "k", b).collect())) for b in (1, 4))
    assert one == many and len(one) == 247


def test_assignment_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").collect()
    got = {r.s_suppkey: r.slot for r in registry.queries()["j15_assignment"](spark, "/root/testdata/sf0.001").collect()}
    for nation in {r.s_nationkey for r in rows}:
        own = sorted((r for r in rows if r.s_nationkey == nation), key=lambda r: r.s_suppkey)
        a = np.array([r.s_acctbal for r in own])
        cost = np.abs(a[:, None] - np.roll(a, 1)[None, :])
        slots = [got[r.s_suppkey] for r in own]
        assert sorted(slots) == list(range(len(own)))
        if len(own) <= 7:
            assert cost[np.arange(len(own)), slots].sum() == pytest.approx(min(cost[np.arange(len(own)), list(p)].sum() for p in itertools.permutations(range(len(own)))))


def test_encoder_query(spark):
    rows = {(r.conv_id, r.turn): r.text for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()}
    model = encoders.HashedTokens()
    for r in registry.queries()["l25_text_encoder"](spark, "/root/testdata/sf0.001").limit(25).collect():
        hidden, mask = model.hidden([rows[r.conv_id, r.turn] or ""])
        for m in encoders.MODES:
            v = encoders.pool(hidden, mask, m)[0]
            assert np.allclose(r[m], v / np.linalg.norm(v), atol=2e-6)
