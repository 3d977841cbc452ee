"""Sparse matrices as tables of blocks, which row and column selections prune.

A block is a tile: ``per_major`` consecutive rows (or columns, if the matrix is stored by columns) by ``per_minor`` of the
other side. It holds pointers into an array of minor positions and one of values, as compressed sparse rows do. A tile's
size is bounded by its sides, so no row of a table grows with the matrix. Tables are written sorted by tile, and readers
filter on the tile first, so files of other tiles aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PER_MAJOR, PER_MINOR = 1_024, 4_096
SCHEMA = "major_block bigint, minor_block bigint, start bigint, stop bigint, pointers array<bigint>, minors array<bigint>, vals array<double>"
TILE = pa.schema([*[(c, pa.int64()) for c in ("major_block", "minor_block", "start", "stop")], *[(c, pa.list_(pa.int64())) for c in ("pointers", "minors")], ("vals", pa.list_(pa.float64()))])


def to_blocks(matrix: DataFrame, major: str, minor: str, value: str, n_major: int, per_major: int = PER_MAJOR, per_minor: int = PER_MINOR) -> DataFrame:
    """Tiles of a long matrix (major, minor, value), whose majors are 0 to ``n_major`` - 1; zero and null values aren't
    stored, a place that comes twice is stored twice. Tiles without values are left out, but for those of minor block 0,
    which together cover all majors."""
    m = matrix.select(F.col(major).cast("bigint").alias("i"), F.col(minor).cast("bigint").alias("j"), F.col(value).cast("double").alias("x")).where("x <> 0 and i is not null and j is not null")
    m = m.withColumn("major_block", F.floor(F.col("i") / per_major)).withColumn("minor_block", F.floor(F.col("j") / per_minor))
    # a row without a value makes a tile of minor block 0 where there is none
    none = [F.lit(None).cast(k).alias(c) for c, k in (("j", "bigint"), ("x", "double"))]
    first = matrix.sparkSession.range(-(-n_major // per_major)).select((F.col("id") * per_major).alias("i"), *none, F.col("id").alias("major_block"), F.lit(0).cast("bigint").alias("minor_block"))

    def tile(t: pa.Table) -> pa.Table:
        block, other = t.column("major_block")[0].as_py(), t.column("minor_block")[0].as_py()
        cells = t.filter(t.column("j").is_valid())
        i, j, x = (cells.column(c).to_numpy() for c in ("i", "j", "x"))
        order = np.lexsort((x, j, i))
        start = block * per_major
        stop = min(start + per_major, n_major)
        pointers = np.searchsorted(i[order], np.arange(start, stop + 1)) if stop > start else None
        one = [[block], [other], [start], [stop], [pointers], [j[order]], [x[order]]]
        return pa.table(one, schema=TILE)

    return m.unionByName(first).groupBy("major_block", "minor_block").applyInArrow(tile, SCHEMA)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Sorted by tile, so that a selection skips files by their least and largest tile. Refuses to overwrite."""
    blocks.repartitionByRange("major_block", "minor_block").sortWithinPartitions("major_block", "minor_block").write.mode("errorifexists").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _lines(blocks: DataFrame, majors: Column) -> DataFrame:
    """(major, minor, value) of some majors of each tile, an array of positions that it holds. They are taken from the
    tile's arrays inside the row, so no tile is repeated per major."""

    def line(i: Column) -> Column:
        place = (i - F.col("start") + 1).cast("int")
        low, high = F.element_at("pointers", place), F.element_at("pointers", place + 1)
        n = (high - low).cast("int")
        cut = lambda c: F.slice(c, (low + 1).cast("int"), n)
        return F.zip_with(cut("minors"), cut("vals"), lambda j, x: F.struct(i.alias("major"), j.alias("minor"), x.alias("value")))

    return blocks.select(F.inline(F.flatten(F.transform(majors, line))))


def to_long(blocks: DataFrame) -> DataFrame:
    """(major, minor, value) of all tiles."""
    return _lines(blocks.where("stop > start"), F.sequence(F.col("start"), F.col("stop") - 1))


def row_range(blocks: DataFrame, start: int, stop: int) -> DataFrame:
    """(major, minor, value) of majors ``start`` to ``stop`` - 1; other tiles aren't read."""
    near = blocks.where((F.col("start") < stop) & (F.col("stop") > start) & F.lit(stop > start))
    return _lines(near, F.sequence(F.greatest("start", F.lit(start)), F.least("stop", F.lit(stop)) - 1))


def select_majors(blocks: DataFrame, wanted: DataFrame, key: str, per_major: int = PER_MAJOR) -> DataFrame:
    """(major, minor, value) of the wanted majors, a selection of any size; one that comes twice counts once, one that the
    matrix doesn't have gives nothing. Only tiles with a wanted major are unpacked."""
    w = wanted.select(F.col(key).cast("bigint").alias("major")).where("major is not null").distinct().withColumn("major_block", F.floor(F.col("major") / per_major))
    each = blocks.join(w.groupBy("major_block").agg(F.array_sort(F.collect_list("major")).alias("w")), "major_block")
    return _lines(each, F.filter("w", lambda i: (i >= F.col("start")) & (i < F.col("stop"))))


def select_minors(blocks: DataFrame, minors: list[int], per_minor: int = PER_MINOR) -> DataFrame:
    """(major, minor, value) of some minors: a filter on the tile that reaches the scan, then on positions."""
    near = blocks.where(F.col("minor_block").isin(sorted({m // per_minor for m in minors})))
    return to_long(near).where(F.col("minor").isin(*minors))


def layout_problems(blocks: DataFrame, n_major: int, n_minor: int) -> DataFrame:
    """(problem, n): how many tiles break the layout, each by its first fault; empty for a canonical table.

    ``bounds``: majors beyond the matrix, pointers that don't begin at 0 and end at the number of values, minors beyond
    the matrix. ``order``: pointers that fall, minors of a line that fall. ``gap``: a first tile of a block of
    majors whose start is neither 0 nor where another one stops, or a matrix whose last major none holds."""
    pointers, minors = F.col("pointers"), F.col("minors")
    size = F.size(minors)
    steps = F.zip_with(F.slice(pointers, 1, F.greatest(F.size(pointers) - 1, F.lit(0))), F.slice(pointers, 2, F.greatest(F.size(pointers) - 1, F.lit(0))), lambda a, b: b - a)
    bounds = (F.col("start") < 0) | (F.col("stop") > n_major) | (F.size(pointers) != F.col("stop") - F.col("start") + 1) | (F.get(pointers, F.lit(0)) != 0) | (F.get(pointers, F.size(pointers) - 1) != size) | (F.size("vals") != size)
    bounds = bounds | F.exists(minors, lambda j: (j < 0) | (j >= n_minor))
    falls = F.exists(steps, lambda d: d < 0)
    # a minor below the one before it must begin a line
    begins = F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda k: F.when((size > 1) & (F.element_at(minors, k + 1) < F.element_at(minors, k)), k.cast("bigint")))
    unsorted = F.size(F.array_except(F.filter(begins, lambda k: k.isNotNull()), pointers)) > 0
    own = blocks.select(F.when(F.coalesce(bounds, F.lit(True)), "bounds").when(falls | unsorted, "order").alias("problem"))
    edges = blocks.where("minor_block = 0").select("start", "stop")
    gaps = edges.where("start <> 0").join(edges.select(F.col("stop").alias("start")).distinct(), "start", "left_anti").select(F.lit("gap").alias("problem"))
    last = edges.agg(F.coalesce(F.max("stop"), F.lit(0)).alias("m")).where(F.col("m") < n_major).select(F.lit("gap").alias("problem"))
    return own.where("problem is not null").union(gaps).union(last).groupBy("problem").agg(F.count("*").alias("n"))
