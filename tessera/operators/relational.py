"""Joins with contracts, deterministic windows, and control matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import hash_order, tri_state

from .order import hash_positions


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` itself; fails at run time if a key comes twice. The check is a window over the keys, so nothing is read twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).where(F.assert_true(F.col("_n") == 1, F.lit(f"keys {keys} are not unique")).isNull()).drop("_n")


def contract_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """Equi join that fails if a side promised to be unique isn't."""
    if validate == "one_to_one":
        left = assert_unique(left, *on)
    return left.join(assert_unique(right, *on), on, how)


def coverage(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """(key, side): both, left_only or right_only of each distinct key."""
    a, b = left.select(on).distinct().withColumn("_a", F.lit(True)), right.select(on).distinct().withColumn("_b", F.lit(True))
    return a.join(b, on, "full").select(on, F.when(F.col("_a").isNull(), "right_only").when(F.col("_b").isNull(), "left_only").otherwise("both").alias("side"))


def control_mask(df: DataFrame, column: str, control_value: str) -> DataFrame:
    """Adds ``is_control``: the column read as boolean if at least 95 % of it can be, else equality with a value."""
    share = df.agg(F.avg(tri_state(F.col(column)).isNotNull().cast("double")).alias("_share"))
    mask = F.when(F.col("_share") >= 0.95, F.coalesce(tri_state(F.col(column)), F.lit(False))).otherwise(F.coalesce(F.trim(column) == control_value, F.lit(False)))
    return df.join(F.broadcast(share)).withColumn("is_control", mask).drop("_share")  # one row is broadcast


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def role_by_order(df: DataFrame, keys: list[str], order: Column, name: str = "role") -> DataFrame:
    """Rows of a key alternate between A and B."""
    return df.withColumn(name, F.when(F.row_number().over(Window.partitionBy(*keys).orderBy(order)) % 2 == 1, "A").otherwise("B"))


def group_folds(df: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """(group, fold): distinct groups in hash order, dealt round-robin."""
    g = hash_positions(df.select(group).where(F.col(group).isNotNull()).distinct(), group, seed)
    return g.select(group, (F.col("position") % k).alias("fold"))


def landmarks(df: DataFrame, entity: str, key: str, count: int, seed: int) -> DataFrame:
    """``count`` rows: the first of each entity in hash order, then the rest in hash order."""
    h = df.withColumn("_h", hash_order(seed, F.col(key)))
    h = h.withColumn("_first", F.row_number().over(Window.partitionBy(entity).orderBy("_h", key)) == 1)
    return h.orderBy(F.col("_first").desc(), "_h", key).limit(count).drop("_h", "_first")


def balanced_sample(df: DataFrame, label: str, key: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows: up to most / classes of each class in hash order, then a global cap in hash order."""
    h = df.where(F.col(label).isNotNull()).withColumn("_h", hash_order(seed, F.col(key)))
    classes = h.agg(F.countDistinct(label).alias("_c"))
    h = h.join(F.broadcast(classes)).withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy("_h", key)))
    return h.where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("_c")))).orderBy("_h", key).limit(most).drop("_h", "_r", "_c")


def match_controls(rows: DataFrame, atom: str, donor: str, batch: str, is_control: str, per_stratum: int = 5, total: int = 20) -> DataFrame:
    """(atom, level, n_pert, n_controls): the finest level of control matching that holds for the whole atom.

    Donor and batch if every stratum of the atom has ``per_stratum`` controls and all have ``total``; else donor alone by
    the same rule; else unsupported. Counts are grouped before any join."""
    r = rows.withColumn("_c", F.col(is_control))
    pert = r.where(~F.col("_c")).groupBy(atom, donor, batch).agg(F.count(F.lit(1)).alias("n_pert"))
    ctrl = r.where("_c").groupBy(donor, batch).agg(F.count(F.lit(1)).alias("n_ctrl"))

    def level(keys: list[str], name: str) -> DataFrame:
        c = ctrl.groupBy(*keys).agg(F.sum("n_ctrl").alias("n_ctrl"))
        p = pert.groupBy(atom, *keys).agg(F.sum("n_pert").alias("n_pert")).join(c, keys, "left")
        n = F.coalesce("n_ctrl", F.lit(0))
        return p.groupBy(atom).agg((F.min(n) >= per_stratum).alias("_each"), F.sum(n).alias(f"n_{name}"), F.sum("n_pert").alias("n_pert")).select(atom, "n_pert", f"n_{name}", (F.col("_each") & (F.col(f"n_{name}") >= total)).alias(f"ok_{name}"))

    both = level([donor, batch], "donor_batch").join(level([donor], "donor").drop("n_pert"), atom)
    chosen = F.when(F.col("ok_donor_batch"), "donor_batch").when(F.col("ok_donor"), "donor").otherwise("unsupported")
    n = F.when(F.col("ok_donor_batch"), F.col("n_donor_batch")).when(F.col("ok_donor"), F.col("n_donor")).otherwise(F.lit(0))
    return both.select(atom, chosen.alias("level"), "n_pert", n.cast("bigint").alias("n_controls"))
