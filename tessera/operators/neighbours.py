"""Exact nearest neighbours by cosine, without comparing what can't be near.

Rows lie in cells around pivots, a bounded set of them, and in rings by their angle to the pivot. On unit vectors angles
obey the triangle inequality, so a query at angle a to a pivot is at least ``max(a - high, low - a)`` away from all rows of
a ring from ``low`` to ``high``. A first pass goes through the rings around each query's nearest pivots until they hold
enough rows; the angle of the k-th best row found bounds the second pass, which visits every other ring that may hold a
nearer one. Rings of many rows are cut into blocks, and the queries that visit a block into chunks; a block gives at most k
rows per query, and no task holds more than a block and a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import hash_order
from tessera.sources.shared import store

from .linear import unit_rows

#: Pivots at most, rings from a pivot to its opposite, rows of a block, queries of a chunk.
PIVOTS, RINGS, BLOCK_ROWS, CHUNK = 64, 64, 16_384, 8_192
#: Up to so many rows comparing all of them, in the same blocks, is less work than bounding, whose rings exclude little
#: where vectors have many dimensions.
FEW = 1_000_000
#: Queries of a chunk that are compared with a block at a time.
AT_ONCE = 256
#: Angles and cosines of different summation orders may differ by so much.
SLACK = 1e-7


def _angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit_rows(v) @ pivots.T, -1, 1))


def _located(df: DataFrame, key: str, vector: str, pivots: np.ndarray) -> DataFrame:
    """(key, v, cell, angle, angles): the nearest pivot of each vector, and its angles to all of them."""
    sent = df.sparkSession.sparkContext.broadcast(pivots)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                a = _angles(v, sent.value)
                cell = a.argmin(1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * a.shape[1], pa.int32()), pa.array(a.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int64()), pa.array(a[np.arange(len(a)), cell]), lists], names=["key", "v", "cell", "angle", "angles"])

    return df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"key {kind}, v array<double>, cell bigint, angle double, angles array<double>")


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, seed: int = 0, pivots: int = PIVOTS, rings: int = RINGS, block_rows: int = BLOCK_ROWS, chunk: int = CHUNK, few: int = FEW) -> DataFrame:
    """(q, key, cosine, place): the ``k`` rows of largest cosine to each query, ties by key, as comparing everything gives.

    Keys are unique on each side, vectors of one length and not null; zero vectors have cosine 0 with all. Fewer than k
    rows give all of them; empty tables give none."""
    n = rows.limit(few + 1).count()
    kind, own = queries.schema[key].dataType.simpleString(), rows.schema[key].dataType.simpleString()
    if 0 < n <= few:
        one = [F.lit(0).cast("bigint").alias(c) for c in ("cell", "ring")]
        asked, table = (d.select(F.col(key).alias(c), F.col(vector).cast("array<double>").alias("v"), *more) for d, c, more in ((queries, "q", []), (rows, "key", one)))
        return _best(_visited(asked.select("q", *one, F.lit(-(-n // block_rows)).alias("blocks")), asked, table, k, chunk, kind, own), k)
    marks = rows.orderBy(hash_order(seed, F.col(key)), key).limit(pivots).select(F.col(vector).cast("array<double>").alias("v")).collect()
    if not marks:
        return queries.sparkSession.createDataFrame([], f"q {kind}, key {own}, cosine double, place int")
    points = unit_rows(np.array([r.v for r in marks]))
    ring = F.least(F.floor(F.col("angle") / (np.pi / rings)), F.lit(rings - 1))
    table = store(_located(rows, key, vector, points).select("key", "v", "cell", ring.alias("ring"), "angle"), "neighbour-rows")
    sizes = table.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    # a row per cell and ring: pivots * rings at most
    cells = sizes.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
    asked = store(_located(queries, key, vector, points).select(F.col("key").alias("q"), "v", "angles"), "neighbour-queries")
    to_all = asked.select("q", F.col("angles").alias("a")).join(F.broadcast(cells))
    apart = F.greatest(F.get("a", F.col("cell").cast("int")) - F.col("high"), F.col("low") - F.get("a", F.col("cell").cast("int")), F.lit(0.0))
    bounds = to_all.select("q", "cell", "ring", "blocks", "n", apart.alias("bound"))
    near = Window.partitionBy("q").orderBy("bound", "cell", "ring").rowsBetween(Window.unboundedPreceding, -1)
    bounds = store(bounds.withColumn("before", F.coalesce(F.sum("n").over(near), F.lit(0))), "neighbour-bounds")
    first = bounds.where(F.col("before") < k)
    found = store(_visited(first, asked, table, k, chunk, kind, own), "neighbour-first")
    limit = _best(found, k).where(F.col("place") == k).select("q", (F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "cosine"))) + SLACK).alias("limit"))
    more = bounds.where(F.col("before") >= k).join(limit, "q", "left").where(F.col("limit").isNull() | (F.col("bound") <= F.col("limit")))
    return _best(found.union(_visited(more, asked, table, k, chunk, kind, own)), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "key"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _visited(visits: DataFrame, asked: DataFrame, table: DataFrame, k: int, chunk: int, kind: str, own: str) -> DataFrame:
    """(q, key, cosine): the best k rows of each block for each query that visits it."""
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    each = visits.select("q", "cell", "ring", "blocks", every)
    chunks = each.groupBy("cell", "ring", "block", "blocks").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    left = each.join(chunks.drop("blocks"), ["cell", "ring", "block"]).withColumn("part", F.pmod(F.xxhash64("q"), F.col("chunks")).cast("int")).join(asked.select("q", "v"), "q")
    right = table.join(chunks, ["cell", "ring"]).where(F.pmod(F.xxhash64("key"), F.col("blocks")) == F.col("block")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    on = ["cell", "ring", "block", "part"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": a["q"][:0], "key": b["key"][:0], "cosine": pd.Series([], dtype=float)})
        x, y = (unit_rows(np.stack(p["v"].to_list()).astype(float)) for p in (a, b))
        keys, m = b["key"].to_numpy(), min(k, len(b))
        best, cosine = np.empty((len(a), m), np.int64), np.empty((len(a), m))
        for start in range(0, len(a), AT_ONCE):
            cos = x[start : start + AT_ONCE] @ y.T
            edge = np.partition(cos, len(b) - m, axis=1)[:, len(b) - m] - SLACK
            for i, (row, least) in enumerate(zip(cos, edge, strict=True), start):
                at = np.flatnonzero(row >= least)
                exact = np.cumsum(x[i] * y[at], axis=1)[:, -1].clip(-1, 1)  # one order of additions, whatever the block
                order = np.lexsort((keys[at], -exact))[:m]
                best[i], cosine[i] = at[order], exact[order]
        return pd.DataFrame({"q": np.repeat(a["q"].to_numpy(), m), "key": keys[best.ravel()], "cosine": cosine.ravel()})

    return left.select(*on, "q", "v").groupBy(*on).cogroup(right.select(*[F.col(c).alias(f"r_{c}") for c in on], "key", "v").groupBy(*[f"r_{c}" for c in on])).applyInPandas(run, f"q {kind}, key {own}, cosine double")
