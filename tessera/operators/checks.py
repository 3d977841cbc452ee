"""Integrity checks. Each gives rows (check, observed, expected, ok) or the offending rows; none collects data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that come more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dependency_violations(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n) of keys with more than one value, null counted as a value."""
    return df.groupBy(key).agg((F.countDistinct(value) + F.max(F.col(value).isNull().cast("int"))).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys of the child that the parent lacks."""
    return child.select(key).where(F.col(key).isNotNull()).distinct().join(parent.select(key), key, "left_anti")


def check(df: DataFrame, name: str, observed: Column, expected: int | float) -> DataFrame:
    """One row: whether an aggregate equals what is expected."""
    return df.agg(observed.cast("double").alias("observed")).select(F.lit(name).alias("check"), "observed", F.lit(float(expected)).alias("expected"), F.coalesce(F.col("observed") == expected, F.lit(False)).alias("ok"))


def contiguous(df: DataFrame, column: str, start: int = 0) -> DataFrame:
    """One row: is the column start, start + 1, ... without gaps or repeats?"""
    c = F.col(column)
    return df.agg(F.count("*").alias("n"), F.coalesce((F.min(c) == start) & (F.max(c) == start + F.count("*") - 1) & (F.countDistinct(c) == F.count("*")), F.lit(False)).alias("contiguous"))


def conservation(df: DataFrame, part: str, name: str, keep: Column | None = None) -> DataFrame:
    """One row: do the parts of a table, after what each part keeps of it, add up to its rows?"""
    parts = (df if keep is None else df.where(keep)).groupBy(part).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("parts"))
    return df.agg(F.lit(name).alias("split"), F.count("*").alias("total")).crossJoin(parts).withColumn("conserved", F.col("total") == F.col("parts"))  # one row each


def overall(checks: DataFrame) -> DataFrame:
    """One row: PASS if every check is ok."""
    return checks.agg(F.count("*").alias("n_checks"), F.count_if(~F.col("ok")).alias("n_failed"), F.when(F.bool_and("ok"), "PASS").otherwise("FAIL").alias("status"))


def mismatches(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, n_compared, n_mismatched): null-safe comparison of two versions of a table, joined by key."""
    r = right.select(key, *[F.col(c).alias(f"{c}__r") for c in columns])
    j = left.select(key, *columns).join(r, key)
    per = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), (~F.col(c).eqNullSafe(F.col(f"{c}__r"))).cast("bigint").alias("bad")) for c in columns]))
    return j.select(per).groupBy("column").agg(F.count("*").alias("n_compared"), F.sum("bad").alias("n_mismatched"))


def table_digest(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row: order-free digest of a table, an exact sum of 60-bit row hashes, and the row count."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, *columns)]), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("digest"))


def expression_scale(df: DataFrame, value: str) -> DataFrame:
    """One row: finite, non-negative, at least 99 % whole, at least 99 % positive."""
    v = F.col(value)
    share = lambda c: F.avg(c.cast("double"))
    return df.agg(F.bool_and(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).alias("finite"), (F.min(v) >= 0).alias("non_negative"), (share(F.abs(v - F.round(v)) < 1e-6) >= 0.99).alias("counts_like"), (share(v > 0) >= 0.99).alias("positive"))
