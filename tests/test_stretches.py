"""Stretches of a line against taking one pair after the other, and few rounds however many pairs tie."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_matching import hashes, one_after_the_other

from tessera.operators import matching as mt
from tessera.operators.stretches import match_stretches

SCHEMA = pa.schema([("g", pa.string()), ("_x", pa.float64()), ("_h", pa.int64()), ("_l", pa.int64()), ("_r", pa.int64()), ("_s", pa.float64())])
VALUES = {
    "chain": lambda rng: float(rng.randrange(30)), "tenths": lambda rng: 900 + rng.randrange(60) / 10, "spread": lambda rng: rng.random(),
    "runs": lambda rng: rng.choice([0, 100]) + rng.random(), "two": lambda rng: rng.choice([1.0, 2.0]), "rounded": lambda rng: rng.choice([1e16, 1e16 + 2, -1e16, 0.1, 0.2, 1.0, 1e8]),
}


def in_rounds(rows, size, rng):
    """What the rounds come to when partitions begin at random values and batches are small."""
    out = set()
    while True:
        both = {r[0] for r in rows if r[3] is not None} & {r[0] for r in rows if r[4] is not None}
        rows = sorted((r for r in rows if r[0] in both), key=lambda r: r[:3])
        if not rows:
            return out
        cuts = sorted(rng.sample(sorted({r[:2] for r in rows}), min((len(rows) - 1) // size, len({r[:2] for r in rows}))))
        rest = []
        for k in range(len(cuts) + 1):
            part = [r for r in rows if sum(c <= r[:2] for c in cuts) == k]
            batches = [pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in part[i : i + 5]], SCHEMA) for i in range(0, len(part), 5)]
            got = [tuple(r.values()) for b in match_stretches(batches, "g", size, not cuts) for r in b.to_pylist()]
            out |= {(r[0], r[3], r[4], r[5]) for r in got if r[5] is not None}
            rest += [r for r in got if r[5] is None]
        size, rows = size * 2 if len(rest) == len(rows) else size, rest


@pytest.mark.parametrize("kind", VALUES)
def test_stretches_settle_what_is_taken_one_after_the_other(kind):
    for seed in range(25):
        rng = random.Random(seed)
        side, rows, h = {}, [], {}
        for k in range(rng.randrange(2, 70)):
            g, x = rng.choice("aab"), VALUES[kind](rng)
            left = side.setdefault((g, x), x < 1.5 if kind == "two" else x < 50 if kind == "runs" else rng.random() < 0.5)
            h[k] = rng.randrange(2**62)
            rows.append((g, x, h[k], k if left else None, None if left else k, None))
        edges = [(a[0], a[3], b[4], -abs(a[1] - b[1])) for a in rows for b in rows if a[0] == b[0] and a[3] is not None and b[4] is not None]
        assert in_rounds(rows, rng.choice([1, 2, 5, 12, 30, 100]), rng) == one_after_the_other(edges, h), seed


def test_rounds_stay_few_where_many_pairs_tie(spark, monkeypatch):
    written, store = [], mt.store
    monkeypatch.setattr(mt, "store", lambda df, name: written.append(name) or store(df, name))
    df = spark.range(240).select(F.lit("g").alias("g"), F.col("id").alias("k"), (F.col("id") % 6).cast("double").alias("v"))
    a, b = (df.where(F.col("k") % 2 == p).withColumnRenamed("k", n) for p, n in ((1, "l"), (0, "r")))
    got = {tuple(r) for r in mt.nearest_matching(a, b, "g", "l", "r", "v").collect()}
    edges = [("g", i, j, -float(abs(i % 6 - j % 6))) for i in range(1, 240, 2) for j in range(0, 240, 2)]
    assert got == one_after_the_other(edges, hashes(spark, range(240)))
    assert len(written) <= 4


def test_small_stretches_of_spark_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), k, rng.choice([float(rng.randrange(40)), 40 * rng.random()])) for k in range(160)]
    edges = [(g, i, j, -abs(x - y)) for g, i, x in rows for q, j, y in rows if g == q and i % 2 == 1 and j % 2 == 0]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    a, b = (df.where(F.col("k") % 2 == p).withColumnRenamed("k", n) for p, n in ((1, "l"), (0, "r")))
    got = {tuple(r) for r in mt.nearest_matching(a, b, "g", "l", "r", "v", rows=30).collect()}
    assert {(g, i, j, s + 0.0) for g, i, j, s in got} == {(g, i, j, s + 0.0) for g, i, j, s in one_after_the_other(edges, hashes(spark, range(160)))}


def test_what_fits_one_stretch_is_in_one_partition(spark, monkeypatch):
    frame = type(spark.range(1))
    deal = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *c: deal(self, max(n, 7) if isinstance(n, int) else n, *c))
    rng = random.Random(4)
    rows = [("a", k, 40 * rng.random()) for k in range(80)]
    edges = [("a", i, j, -abs(x - y)) for _, i, x in rows for _, j, y in rows if i % 2 == 1 and j % 2 == 0]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    a, b = (df.where(F.col("k") % 2 == p).withColumnRenamed("k", n) for p, n in ((1, "l"), (0, "r")))
    assert {tuple(r) for r in mt.nearest_matching(a, b, "g", "l", "r", "v").collect()} == one_after_the_other(edges, hashes(spark, range(80)))
