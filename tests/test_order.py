"""Positions, running totals and ranks in bins against windows over everything at once."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as met
from tessera.operators import order
from tessera.operators.geometry import fuse_ranks
from tessera.operators.relational import group_folds


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), rng.choice([0.0, -0.0, 1.5, -2.0, rng.random()]), rng.choice([1.0, 2.0, rng.random()]), k) for k in range(900)]
    return spark.createDataFrame(data, "g string, x double, y double, k long").repartition(6)


def ranks_of(data, at, group, doubled=False):
    out = {}
    for g in {d[0] for d in data} if group else {0}:
        own = [d for d in data if not group or d[0] == g]
        for d in own:
            r = sum(o[at] < d[at] for o in own) + (sum(o[at] == d[at] for o in own) + 1) / 2
            out[d[3]] = int(2 * r) if doubled else r
    return out


@pytest.mark.parametrize("most", [0, 10**6])
@pytest.mark.parametrize("group", [("g",), ()])
def test_ranks_either_way(rows, most, group):
    data = list(map(tuple, rows.collect()))
    got = order.with_ranks(rows, {"a": "x", "b": "y"}, *group, largest=1, most=most).collect()
    assert {r.k: r.a for r in got} == ranks_of(data, 1, group) and {r.k: r.b for r in got} == ranks_of(data, 2, group)
    got = order.with_ranks(rows, {"a": "x"}, *group, doubled=True, descending=True, largest=1, most=most).collect()
    n = {g: sum(d[0] == g for d in data) if group else len(data) for g in ("a", "b", None)}
    up = ranks_of(data, 1, group, True)
    assert {r.k: r.a for r in got} == {d[3]: 2 * (n[d[0]] + 1) - up[d[3]] for d in data}


def test_a_large_group_is_in_more_than_one_bin(spark):
    df = spark.range(4000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 4001).cast("double").alias("x"))
    small = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")
    try:
        bins = df.repartitionByRange("g", "x").groupBy(F.spark_partition_id()).count().collect()
        got = sorted((r.x, r.below) for r in order.value_ranks(df, "x", "g").collect())
    finally:
        spark.conf.unset(small)
    assert len(bins) > 1 and max(r["count"] for r in bins) < 2000
    assert [b for _, b in got] == list(range(4000))


def test_spearman_and_fusion_either_way(rows):
    d = rows.where("g is not null")
    for f in (lambda most: met.spearman(d, "x", "y", "g", largest=1, most=most), lambda most: fuse_ranks(d, "x", "y", "g", largest=1, most=most).select("g", "k", "fused")):
        one, many = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f(most).collect()) for most in (10**6, 0))
        assert one == many


def test_running_totals_by_group(rows):
    got = {r.k: r.before for r in order.running_totals(rows, ["x", "k"], "k", "g").collect()}
    data = list(map(tuple, rows.collect()))
    assert got == {d[3]: sum(o[3] for o in data if o[0] == d[0] and (o[1], o[3]) < (d[1], d[3])) for d in data}


def test_positions(rows):
    got = sorted((r.position, r.y, r.k) for r in order.positions(rows, "y", "k").collect())
    assert [g[0] for g in got] == list(range(900)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert order.positions(rows.limit(0), "y", "k").count() == 0 and order.hash_positions(rows.limit(0), "k", 1).count() == 0


def test_hash_positions_and_folds(rows):
    import hashlib

    want = sorted(range(900), key=lambda k: hashlib.sha256(f"7|{k}".encode()).hexdigest())
    assert [r.k for r in sorted(order.hash_positions(rows, "k", 7).collect(), key=lambda r: r.position)] == want
    assert {r.k: r.fold for r in group_folds(rows, "k", 4, 7).collect()} == {k: i % 4 for i, k in enumerate(want)}
