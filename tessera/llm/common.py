"""Shared helpers: shared-folder tables, joins that survive hot keys, distributed components, driver-side logistic fits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A table is broadcast only while it has at most so many rows (checked by a count first).
BROADCAST_ROWS = 100_000
#: The same for tables of keys, whose rows take under 100 bytes: 30 MB.
SENT_KEYS = 300_000
#: A key is hot if it has over one in HOT_SHARE of all rows, so there are fewer hot keys than that at any size.
HOT_SHARE = 4_096
#: Up to so many rows no key can overload a task, so hot keys aren't looked for.
FEW_ROWS = 1_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only in local mode, where all executors share one machine, a folder of our own is
    used if none is set; on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage; the files go to the shared folder and survive a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table (Parquet) into the shared folder and reads it again. Results read such tables lazily, so they stay
    until the folder is cleared, or ``scratch`` removes them."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of written tables by application, oldest first.
_written: dict[str, list[str]] = {}


def _tables(spark: SparkSession) -> list[str]:
    return _written.setdefault(spark.sparkContext.applicationId, [])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that were written within it, except the last one, which holds the result; all of
    them if it fails."""
    written, last = _tables(spark), -1
    start = len(written)
    try:
        yield
    except BaseException:
        last = None
        raise
    finally:
        remove_tables(spark, written[start:last])
        del written[start:last]


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def last_table(spark: SparkSession) -> str:
    """Path of the table written last."""
    return _tables(spark)[-1]


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(columns: list[str], wish: str) -> str:
    """``wish``, with underscores put before it until no column is called so (names differ by case only: taken)."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def nullable_key(col: Column) -> Column:
    """A string key that is never null: null has a key of its own, unlike any text's."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("-"))


class HotKeys:
    """The keys that hold over one in HOT_SHARE of a table's rows. They are found once, by partial counts, and are
    fewer than HOT_SHARE, so what belongs to them can be broadcast; all other keys are joined by a shuffle."""

    def __init__(self, rows: DataFrame, key: str, few: int = FEW_ROWS, share: int = HOT_SHARE, counted: DataFrame | None = None) -> None:
        self.rows, self.key, self.hot = rows, key, None
        known = rows if counted is None else counted
        counts = known.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
        total = counts.agg(F.sum("_n").alias("n")).first().n or 0
        if total > few:
            found = counts.where(F.col("_n") * share > total).select(key).collect()
            if found:
                self.hot = rows.sparkSession.createDataFrame(found, known.select(key).schema)

    def join(self, table: DataFrame, how: str = "inner") -> DataFrame:
        """Joins a table that is unique by the key: ``inner``, ``left`` or ``left_semi``. Null keys match nothing."""
        key, rows = self.key, self.rows
        if self.hot is None:
            return rows.join(table, key, how)
        hot = F.broadcast(self.hot)
        warm = rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key, how)
        cold = rows.where(F.col(key).isNotNull()).join(hot, key, "left_anti").join(table, key, how)
        if how != "left":
            return warm.unionByName(cold)
        return warm.unionByName(cold).unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def lookup_join(left: DataFrame, table: DataFrame, key: str, how: str = "left", limit: int = BROADCAST_ROWS, few: int = FEW_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Joins a table that is unique by ``key``. It is broadcast if a count finds it within ``limit``; otherwise only
    what belongs to hot keys is, and the rows of all others are dealt by key. ``left`` should be a written table, or
    ``counted`` one that holds its keys."""
    if table.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(table), key, how)
    return HotKeys(left, key, few, counted=counted).join(table, how)


def connected_components(edges: DataFrame, few: int = FEW_ROWS) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); component is the least node reachable.

    Alternating large-star and small-star steps, to the fixed point: after O(log n) rounds of them every node is linked
    to its component's least node. All steps are joins and grouped minima over the edge table, hot nodes apart; each
    round is checkpointed, nothing is collected but a count, a checksum and hot nodes. Self links and nulls are ignored;
    an empty table gives an empty result."""
    cur = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    cur = checkpoint(cur)
    seen = None
    while True:
        mark = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if not mark.n or mark == seen:
            break
        seen = mark

        def least(rows: DataFrame, n: int = mark.n) -> DataFrame:
            low = rows.groupBy("u").agg(F.min("v").alias("m"))
            return HotKeys(rows, "u", few).join(low) if 2 * n > few else rows.join(low, "u")

        both = cur.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        large = least(both).withColumn("m", F.least("u", "m")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if 2 * mark.n > few:
            large = checkpoint(large)
        # every link now points from the larger to the smaller node
        small = least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        cur = checkpoint(small.select("e.u", "e.v").where("u <> v").distinct())
    stars = cur.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.inline(F.array(F.struct(F.col("u").alias("node"), "component"), F.struct(F.col("component").alias("node"), "component")))).distinct()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int, k: int, y: np.ndarray, l2: float = 1.0, rounds: int = 300) -> np.ndarray:
    """Weights (k, then the intercept) of a logistic regression on a sparse matrix given as triples.

    Accelerated, diagonally scaled gradient descent; deterministic. One class only gives its prior."""
    rate = (y.sum() + 0.5) / (n + 1.0) if n else 0.5
    w = np.zeros(k + 1)
    w[k] = np.log(rate / (1 - rate))
    if n == 0 or y.min() == y.max():
        return w
    size = np.bincount(rows, np.abs(vals), n) + 1.0
    # the Hessian is at most this diagonal, so each weight has a safe step of its own
    bound = 0.25 * np.append(np.bincount(cols, np.abs(vals) * size[rows], k), size.sum()) + np.append(np.full(k, l2), 1e-9)
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        e = sigmoid(np.bincount(rows, vals * v[cols], n) + v[k]) - y
        nw = v - (np.append(np.bincount(cols, vals * e[rows], k) + l2 * v[:k], e.sum())) / bound
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = nw + (t - 1) / nt * (nw - w)
        w, t = nw, nt
    return w
