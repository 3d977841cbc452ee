"""Block tables against a dictionary: selections, pruning, and planted faults of the layout."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import blocks as bl

N, M = 50, 30


@pytest.fixture(scope="module")
def data():
    rng = random.Random(1)
    return {(i, j): float(rng.randrange(1, 9)) for i in range(N) for j in range(M) if rng.random() < 0.15 and i % 7 != 3}


@pytest.fixture(scope="module")
def table(spark, data, tmp_path_factory):
    rows = [(i, j, x) for (i, j), x in data.items()] + [(4, 5, 0.0), (None, 1, 1.0), (1, None, 1.0), (2, 2, None)]
    rows = [r for r in rows if r[:2] != (2, 2) or r[2] is not None]
    path = str(tmp_path_factory.mktemp("blocks") / "m")
    bl.write_blocks(bl.to_blocks(spark.createDataFrame(rows, "r long, c long, v double").repartition(4), "r", "c", "v", N, 8, 10), path)
    return bl.read_blocks(spark, path)


def got(df):
    return {(r.major, r.minor): r.value for r in df.collect()}


def test_all_cells_come_back(table, data):
    assert got(bl.to_long(table)) == data and bl.layout_problems(table, N, M).collect() == []
    assert table.where("minor_block = 0").count() == 7 and table.agg(F.max(F.size("pointers"))).first()[0] == 9


def test_selections(spark, table, data):
    assert got(bl.row_range(table, 5, 21)) == {k: v for k, v in data.items() if 5 <= k[0] < 21}
    wanted = spark.createDataFrame([(3,), (9,), (9,), (None,), (49,), (1000,)], "k long")
    assert got(bl.select_majors(table, wanted, "k", 8)) == {k: v for k, v in data.items() if k[0] in (3, 9, 49)}
    assert got(bl.select_minors(table, [0, 11, 29], 10)) == {k: v for k, v in data.items() if k[1] in (0, 11, 29)}
    assert got(bl.row_range(table, 60, 70)) == {} and got(bl.select_majors(table, wanted.limit(0), "k", 8)) == {}


def test_selections_reach_the_scan(table):
    plan = bl.select_minors(table, [0, 11], 10)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(minor_block" in plan or "PushedFilters: [Or(EqualTo(minor_block" in plan or "PushedFilters: [IsNotNull(minor_block" in plan or "In(minor_block" in plan.split("PushedFilters")[1][:80]
    assert "LessThan(start,21)" in bl.row_range(table, 5, 21)._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    "problem,change",
    [
        ("gap", lambda t: t.where("major_block <> 2")),
        ("gap", lambda t: t.where("major_block <> 6")),
        ("bounds", lambda t: t.withColumn("minors", F.when((F.col("major_block") == 1) & (F.col("minor_block") == 0), F.transform("minors", lambda j: j + 1000)).otherwise(F.col("minors")))),
        ("bounds", lambda t: t.withColumn("vals", F.when((F.col("major_block") == 1) & (F.col("minor_block") == 0), F.slice("vals", 2, 99)).otherwise(F.col("vals")))),
        ("bounds", lambda t: t.withColumn("pointers", F.when((F.col("major_block") == 3) & (F.col("minor_block") == 0), F.transform("pointers", lambda p: p + 1)).otherwise(F.col("pointers")))),
        ("order", lambda t: t.withColumn("minors", F.when((F.col("major_block") == 0) & (F.col("minor_block") == 0), F.sort_array("minors", asc=False)).otherwise(F.col("minors")))),
        ("order", lambda t: t.withColumn("pointers", F.when((F.col("major_block") == 0) & (F.col("minor_block") == 0), F.concat(F.slice("pointers", 1, 1), F.reverse(F.slice("pointers", 2, 7)), F.slice("pointers", 9, 1))).otherwise(F.col("pointers")))),
    ],
)
def test_planted_faults(table, problem, change):
    assert [tuple(r) for r in bl.layout_problems(change(table), N, M).collect()] == [(problem, 1)]


def test_empty_matrix(spark):
    empty = spark.createDataFrame([], "r long, c long, v double")
    t = bl.to_blocks(empty, "r", "c", "v", 20, 8, 8)
    assert bl.to_long(t).count() == 0 and bl.layout_problems(t, 20, 8).collect() == [] and bl.layout_problems(t.limit(0), 20, 8).collect()[0].problem == "gap"


def test_tiles_are_not_repeated_per_major(spark):
    df = spark.createDataFrame([(i, j, float(i + j + 1)) for i in range(0, 40, 3) for j in range(5)], "i bigint, j bigint, x double")
    long = bl.to_long(bl.to_blocks(df, "i", "j", "x", 40, 8, 2))
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, df.collect()))
    # one generator, which reads the tile's lines and not a copy of the tile for each of its majors
    assert long._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
