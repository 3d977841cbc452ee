"""Bootstrap, sign flips, folds, derangements, assignments and linear read-outs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import hash_index


#: Units of a group whose values are one array; CHUNKS tasks per group share its draws.
ARRAY_UNITS, CHUNKS = 100_000, 64


def bootstrap_ci(df: DataFrame, group: str, key: str, value: str, draws: int, seed: int, array_units: int = ARRAY_UNITS) -> DataFrame:
    """(group, n, mean, lo, hi): percentile interval of the mean over units drawn with replacement by hash.

    A draw picks, for each of as many slots as there are units, the unit at a place that a hash of group, draw and slot
    gives, in the order of ``key``. A group's values are one array; it is sent to CHUNKS tasks, which go through their
    draws without a join, and only the draws' means are shuffled. Groups of more than ``array_units`` units (counted
    first) look slots up by place instead. Rows with a null value are left out; a null group is a group."""
    known = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    sizes = known.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    largest = sizes.agg(F.max("n").alias("n")).first().n or 0

    def pick(n: Column, draw: Column, slot: Column) -> Column:
        return hash_index(F.concat_ws("|", F.lit(str(seed)), F.col("g").cast("string"), draw.cast("string"), slot.cast("string")), n)

    if largest <= array_units:
        u = known.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("v"))
        chunk = u.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1)))).repartition("g", "c")
        each = chunk.select("g", "v", F.size("v").cast("bigint").alias("n"), F.explode(F.filter(F.sequence(F.lit(0), F.lit(draws - 1)), lambda d: d % CHUNKS == F.col("c"))).alias("draw"))
        slots = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)
        total = F.aggregate(slots, F.lit(0.0), lambda s, j: s + F.get("v", pick(F.col("n"), F.col("draw"), j).cast("int")))
        means = each.select("g", "draw", (total / F.col("n")).alias("m"))
    else:
        w = Window.partitionBy("g")
        u = known.select("g", "v", (F.row_number().over(w.orderBy("k", "v")) - 1).cast("bigint").alias("idx"), F.count("*").over(w).alias("n"))
        slots = u.select("g", F.col("idx").alias("slot"), "n").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        picked = slots.select(F.col("g").alias("h"), "draw", pick(F.col("n"), F.col("draw"), F.col("slot")).alias("at"))
        means = picked.join(u.select("g", "idx", "v"), F.col("h").eqNullSafe(F.col("g")) & (F.col("at") == F.col("idx"))).groupBy("g", "draw").agg(F.avg("v").alias("m"))
    ci = means.groupBy(F.col("g").alias("h")).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    return sizes.join(ci, F.col("g").eqNullSafe(F.col("h"))).select(F.col("g").alias(group), "n", "mean", "lo", "hi")


def sign_flip(df: DataFrame, group: str, value: str, most: int = 20) -> DataFrame:
    """(group, n, p): exact two-sided sign-flip probability of the mean; zeros are dropped; more than ``most`` units
    give null (2**n sign vectors are gone through)."""
    d = df.where(F.abs(value) > 1e-15).groupBy(group).agg(F.array_sort(F.collect_list(value)).alias("x")).withColumn("n", F.size("x").cast("bigint"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, y: s + y)
    flips = d.where(F.col("n") <= most).select(group, "x", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.pow(F.lit(2), F.col("n")).cast("bigint") - 1)).alias("m"))
    signed = F.transform("x", lambda y, i: F.when(F.floor(F.col("m") / F.pow(F.lit(2), i)) % 2 == 1, -y).otherwise(y))
    p = flips.groupBy(group, "n").agg(F.avg((F.abs(total(signed) / F.col("n")) >= F.abs(total(F.col("x")) / F.col("n")) - 1e-15).cast("double")).alias("p"))
    return d.select(group, "n").join(p.select(group, "p"), group, "left")


def derangement(names: list[str], texts: list[str], seed: int, attempts: int = 2000) -> list[int] | None:
    """A permutation that gives no entry its own text (equal texts count as its own); by rejection; None if none is found."""
    rng = np.random.default_rng(seed)
    t = np.array(texts, dtype=object)
    for _ in range(attempts):
        p = rng.permutation(len(names))
        if not (t[p] == t).any():
            return p.tolist()
    return None


def assign(cost: np.ndarray) -> np.ndarray:
    """Least-cost assignment of rows to columns: shortest augmenting paths with potentials."""
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            row = match[j]
            free = np.flatnonzero(~used[1:]) + 1
            cur = cost[row - 1, free - 1] - u[row] - v[free]
            better = cur < low[free]
            low[free[better]], way[free[better]] = cur[better], j
            k = free[np.argmin(low[free])]
            delta = low[k]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j = k
            if match[j] == 0:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    out = np.zeros(n, int)
    out[match[1:][match[1:] > 0] - 1] = np.flatnonzero(match[1:] > 0)
    return out
