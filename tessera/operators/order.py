"""Positions, running totals and ranks over orders that are too long for one task.

A long order is cut into bins; totals per bin are added up first (a row per bin), then each bin's rows are added up in a
task of their own and get their bin's start. Bins are either the partitions of a range shuffle, which follow the data and
are written down before anything is derived from them, or the leading digits of a hash, which need no shuffle to be known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import hash_order
from tessera.sources.shared import store

#: Rows of a group that are ranked by a window, in one task.
RANK_ROWS = 1_000_000
#: Hexadecimal digits of a hash that name a bin: 16 ** 3 bins.
BIN_DIGITS = 3


def running_totals(df: DataFrame, order: list[str], value: str, *group: str, name: str = "before") -> DataFrame:
    """Adds the total of ``value`` over the rows of the group that come before; ``order`` must be total within a group.

    Nulls in the order come first; null groups are a group; null values count as 0. The rows are written once."""
    spark_bin, start = "_bin", "_start"
    rows = store(df.repartitionByRange(*group, *order).withColumn(spark_bin, F.spark_partition_id()), "order")
    v = F.coalesce(F.col(value), F.lit(0))
    totals = rows.groupBy(*group, spark_bin).agg(F.sum(v).alias("_sum"))
    totals = totals.withColumn(start, F.sum("_sum").over(Window.partitionBy(*group).orderBy(spark_bin)) - F.col("_sum")).drop("_sum")
    inside = F.sum(v).over(Window.partitionBy(*group, spark_bin).orderBy(*order)) - v
    return _null_safe(rows.withColumn("_own", inside), totals, [*group, spark_bin]).withColumn(name, F.col(start) + F.col("_own")).select(*df.columns, name)


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys match one another; the keys come once."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys]
    return left.join(other, on).drop(*[f"_r_{k}" for k in keys])


def positions(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """Adds the place of each row in the whole table's order, from 0."""
    return running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), list(order), "_one", name=name).drop("_one")


def hash_positions(df: DataFrame, key: str, seed: int | str, name: str = "position") -> DataFrame:
    """Adds the place of each row in the order of its key's hash, from 0. Keys must be distinct and not null."""
    h = hash_order(seed, F.col(key))
    rows = df.withColumn("_h", h).withColumn("_bin", F.substring("_h", 1, BIN_DIGITS))
    # a row per bin, 16 ** BIN_DIGITS at most
    bins = rows.groupBy("_bin").agg(F.count("*").alias("_n"))
    bins = bins.select("_bin", (F.sum("_n").over(Window.orderBy("_bin")) - F.col("_n")).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_bin").orderBy("_h", key)) - 1
    return rows.withColumn("_own", own).join(F.broadcast(bins), "_bin").withColumn(name, (F.col("_start") + F.col("_own")).cast("bigint")).select(*df.columns, name)


def value_ranks(df: DataFrame, value: str, *group: str) -> DataFrame:
    """(group, value, n, below): how many rows of the group have each value, and how many a smaller one."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, [value], "n", *group, name="below")


def with_ranks(df: DataFrame, ranks: dict[str, str], *group: str, doubled: bool = False, descending: bool = False, largest: int | None = None, most: int = RANK_ROWS) -> DataFrame:
    """Adds average ranks from 1 (``doubled``: twice them, exact integers): ``ranks`` maps a new column to the one that
    is ranked, which holds no nulls.

    Groups of up to ``most`` rows are ranked by windows; ``largest`` says how many rows the largest has and may be left
    out where groups are small by nature. Larger ones are ranked by counts per value and running totals of these: equal
    values are one row before anything is sorted, and no task has more than a stretch of a group's values. The rows are
    then written once and joined with their values' ranks; AQE splits what a frequent value makes large."""
    if (largest or 0) <= most:
        out = df
        for name, value in ranks.items():
            w = Window.partitionBy(*group)
            place, ties = F.rank().over(w.orderBy(F.desc(value) if descending else F.asc(value))), F.count(F.lit(1)).over(Window.partitionBy(*group, value))
            out = out.withColumn(name, (2 * place + ties - 1).cast("bigint") if doubled else place + (ties - 1) / 2)
        return out
    out = rows = store(df, "ranked")
    for name, value in ranks.items():
        table = value_ranks(rows, value, *group)
        if descending:
            sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_all"))
            table = _null_safe(table, sizes, list(group)) if group else table.crossJoin(F.broadcast(sizes))
            table = table.withColumn("below", F.col("_all") - F.col("below") - F.col("n"))
        rank = (2 * F.col("below") + F.col("n") + 1).cast("bigint")
        table = table.select(*group, value, (rank if doubled else rank / 2).alias(name))
        out = _null_safe(out, table, [*group, value])
    return out.select(*df.columns, *ranks)
