"""Pairs by blocks against all pairs one by one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.columns import dot, unit
from tessera.operators import pairblocks as pb


def table(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, 6)).round(1)
    v[3] = v[7] = v[12]
    v[5] = 0
    return spark.createDataFrame([(k, k % 3 if k % 11 else None, v[k].tolist()) for k in range(n)], "k bigint, g bigint, v array<double>")


def one_by_one(df):
    u = df.where("g is not null").select("g", "k", unit(F.slice("v", 1, 4)).alias("a"), unit(F.slice("v", 3, 4)).alias("b"))
    o = u.select("g", F.col("k").alias("l"), F.col("a").alias("c"), F.col("b").alias("d"))
    clip = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    return u.join(o, "g").where("k < l").select("g", F.col("k").alias("i"), F.col("l").alias("j"), clip(dot(F.col("a"), F.col("c"))).alias("x"), clip(dot(F.col("b"), F.col("d"))).alias("y"))


VIEWS = {"x": (0, 4), "y": (2, 6)}


@pytest.mark.parametrize("rows", [3, 8, 100])
def test_pairs_are_bitwise_those_of_one_by_one(spark, rows):
    df = table(spark)
    got = pb.view_pairs(df, "g", "k", "v", VIEWS, 20, rows=rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, one_by_one(df).collect()))


def test_rounded_values_are_those_of_spark(spark):
    df = table(spark)
    got = pb.view_pairs(df, "g", "k", "v", VIEWS, 20, {"s": (lambda x, y: (x + y) / 2, 6), "t": (lambda x, y: x, 1)}, rows=7)
    want = one_by_one(df).select("g", "i", "j", F.round((F.col("x") + F.col("y")) / 2, 6) + 0.0, F.round("x", 1) + 0.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_halves_round_as_in_spark():
    a, b = [np.array([[1.0]])], [np.array([[0.125, -0.125, 0.145, -0.005, 0.115, 1.0]])]
    got = pb.rounded_cosines(a, b, {"x": (lambda x: x, 2)})[0]
    assert got.tolist() == [[13, -13, 15, -1, 12, 100]]


def test_rows_without_a_vector_have_null_cosines(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, None), (3, 0, [1.0, 0.0])], "k bigint, g bigint, v array<double>")
    for outputs in (None, {"x": (lambda x: x, 6)}):
        for rows in (1, 10):
            got = pb.view_pairs(df, "g", "k", "v", {"x": (0, 2)}, 3, outputs, rows=rows)
            assert sorted(map(tuple, got.collect()), key=str) == [(0, 1, 2, None), (0, 1, 3, 1.0), (0, 2, 3, None)]


@pytest.mark.parametrize(("rows", "others"), [(4, 4), (5, 20), (100, 100)])
def test_neighbours_are_counted_whole(spark, rows, others):
    df = table(spark)
    got = pb.neighbour_counts(df, "g", "k", "v", {"x": (0, 4, 1), "y": (2, 6, 2)}, 20, rows=rows, others=others)
    p = one_by_one(df).select("g", "i", "j", (F.round("x", 1) + 0.0).alias("x"), (F.round("y", 2) + 0.0).alias("y"))
    want = p.select("g", F.col("i").alias("q"), "x", "y").union(p.select("g", "j", "x", "y")).groupBy("g", "q", "x", "y").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_kinds_of_rows_give_their_pairs_values(spark):
    df = spark.createDataFrame([(k, k % 2, [x for x in (k % 3, k % 5) if x], None if k == 4 else k % 4) for k in range(40)], "k bigint, g bigint, b array<bigint>, c bigint")

    def output(a, b):
        return pb.jaccards([x[0] for x in a], [x[0] for x in b]) * pb.alike([x[1] for x in a], [x[1] for x in b])

    rows = df.collect()
    want = {}
    for p in rows:
        for q in rows:
            if p.k < q.k and p.g == q.g:
                s, u = set(p.b), set(q.b)
                j = len(s & u) / len(s | u) if s | u else 1.0
                want[p.k, q.k] = None if p.c is None or q.c is None else round(j * (p.c == q.c), 6)
    for size in (6, 50):
        got = pb.kind_pairs(df, "g", "k", ["b", "c"], output, 20, rows=size)
        assert {(r.i, r.j): r.sim for r in got.collect()} == want and got.count() == len(want)
        assert "Broadcast" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("options", [{}, {"rows": 8, "others": 16}])
def test_asked_stretch_by_stretch(spark, options):
    """Queries are answered where their cosines are: no pair leaves a task, whatever the number of stretches."""
    from tessera.operators.pairblocks import NO_COSINE, asked

    rng = np.random.default_rng(5)
    data = [(k % 2, k, None if k in (4, 9) else rng.normal(0, 1, 6).tolist(), k * 10) for k in range(60)]
    df = spark.createDataFrame(data, "g int, k long, v array<double>, w long").repartition(3)

    def answer(q, own, keys, codes):
        assert (np.diff(keys) > 0).all() and q not in keys
        return [(own[0], len(keys), int((codes[0] > 0).sum()), int((codes[0] == NO_COSINE).sum()))]

    got = asked(df, "g", "k", "v", {"x": (0, 6, 1)}, 30, answer, {"w": "bigint", "n": "bigint", "up": "bigint", "none": "bigint"}, ("w",), **options).groupBy("q").agg({"w": "max", "n": "sum", "up": "sum", "none": "sum"}).collect()
    assert len(got) == 60
    vec = {k: None if v is None else np.array(v) / np.linalg.norm(v) for _, k, v, _ in data}
    for r in got:
        others = [k for k in vec if k % 2 == r.q % 2 and k != r.q]
        up = sum(round(float(vec[r.q] @ vec[k]), 1) > 0 for k in others if vec[r.q] is not None and vec[k] is not None)
        none = sum(vec[r.q] is None or vec[k] is None for k in others)
        assert (r["max(w)"], r["sum(n)"], r["sum(up)"], r["sum(none)"]) == (r.q * 10, 29, up, none)


def test_pairs_of_kinds_are_made_by_functions(spark):
    """Python gives lists per kind and piece; more kinds than are compared at a time, and more rows than a piece, lose nothing."""
    df = spark.range(2_600).select((F.col("id") * 7 % 2_600).alias("k"), F.lit(0).alias("g"), (F.col("id") % 2_300).alias("c"))

    def output(a, b):
        return pb.alike([x[0] for x in a], [x[0] for x in b])

    for rows in (900, 5_000):
        got = pb.kind_pairs(df, "g", "k", ["c"], output, 2_600, rows=rows)
        assert "posexplode" in got._jdf.queryExecution().toString()
        r = got.agg(F.count("*"), F.countDistinct("i", "j"), F.sum("sim"), F.bool_and(F.col("i") < F.col("j"))).first()
        assert tuple(r) == (2_600 * 2_599 // 2, 2_600 * 2_599 // 2, 300.0, True)


def test_copies_of_rows_are_bounded():
    """A row is dealt once per block of its group: at most eight times up to 262,144 rows."""
    assert all(-(-n // pb.block_rows(n)) <= 8 for n in (1, 200, 1_025, 12_000, 72_000, 262_144))
    assert pb.block_rows(10**7) == 32_768


@pytest.mark.parametrize("rows", [7, 100])
def test_rounded_cosines_are_counted_whole(spark, rows):
    df = table(spark)
    got = pb.value_counts(df, "g", "k", "v", VIEWS, 20, 2, rows=rows)
    p = one_by_one(df)
    want = p.select("g", F.lit("x").alias("view"), F.round("x", 2).alias("z")).union(p.select("g", F.lit("y"), F.round("y", 2)))
    want = want.groupBy("g", "view", F.rint(F.col("z") * 100).cast("bigint").alias("value")).count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rank_fusion_and_distinct_cosines_join_no_pairs(spark):
    from tessera.plans import registry

    for name in ("v10_rank_fusion", "v02_distinct_cosine"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        at = plan.index("FlatMapGroupsInArrow")
        assert "Window" not in plan[:at] and "Aggregate" not in plan[:at]


@pytest.mark.parametrize("rows", [7, 100])
def test_equal_vectors_have_cosine_one(spark, rows):
    df = table(spark, 80).withColumn("v", F.when(F.col("k") % 8 == 2, F.array(*[F.lit(0.0)] * 6)).when(F.col("k") % 5 == 0, F.array(*[F.lit(0.1 * i) for i in range(6)])).otherwise(F.col("v")))
    got = {(r.i, r.j): r.x for r in pb.view_pairs(df, "g", "k", "v", {"x": (0, None)}, 27, rows=rows, equal=True).collect()}
    v = {r.k: r.v for r in df.collect()}
    assert any(v[i] == v[j] for i, j in got) and all((x == 1.0) == (v[i] == v[j]) for (i, j), x in got.items())
