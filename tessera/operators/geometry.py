"""Similarity of vectors as pair tables (group, i, j, sim) with i < j."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import dot, unit

from .order import RANK_ROWS, with_ranks
from .pairblocks import view_pairs

#: Rows of a group that are paired in one task.
BLOCK_ROWS = 4_096


def largest_group(df: DataFrame, group: str) -> int:
    """Rows of the largest group, nulls aside; 1 at least."""
    return df.where(F.col(group).isNotNull()).groupBy(group).count().agg(F.max("count").alias("n")).first().n or 1


def blocks_of(df: DataFrame, group: str, block_rows: int = BLOCK_ROWS) -> int:
    """Into how many blocks the rows of a group are to be cut, by a count of the largest group."""
    return -(-largest_group(df, group) // block_rows)


def unordered_pairs(df: DataFrame, group: str, key: str, blocks: int = 1) -> DataFrame:
    """Self join within a group to unordered pairs; the other columns come as ``_a`` and ``_b``.

    Pairs are keyed by the group, so the join is never a global nested loop. With one block, which is for groups of
    bounded size, a group is one task's; with more, each pair of a group's blocks is a key of its own."""
    rest = [c for c in df.columns if c not in (group, key)]
    a = df.select(group, F.col(key).alias("i"), *[F.col(c).alias(f"{c}_a") for c in rest])
    b = df.select(group, F.col(key).alias("j"), *[F.col(c).alias(f"{c}_b") for c in rest])
    if blocks == 1:
        return a.join(b, group).where("i < j")
    place, every = (lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = a.withColumn("_p", place("i")).withColumn("_q", every)
    b = b.withColumn("_q", place("j")).withColumn("_p", every)
    return a.join(b, [group, "_p", "_q"]).where("i < j").drop("_p", "_q")


def clipped_dot(a: str, b: str) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col(a), F.col(b))))


def cosine_pairs(df: DataFrame, group: str, key: str, vector: str, sim: str = "sim", blocks: int = 1) -> DataFrame:
    """Cosine of each pair within a group, clipped to [-1, 1]; zero vectors have cosine 0. Rows whose keys are whole
    numbers are compared block by block (``view_pairs``)."""
    if df.schema[key].dataType.simpleString() in ("int", "bigint"):
        return view_pairs(df, group, key, vector, {sim: (0, None)}, blocks * BLOCK_ROWS)
    units = df.select(group, key, unit(F.col(vector)).alias("u"))
    return unordered_pairs(units, group, key, blocks).select(group, "i", "j", clipped_dot("u_a", "u_b").alias(sim))


def distinct_cosine_pairs(df: DataFrame, group: str, key: str, vector: str, blocks: int = 1, largest: int | None = None, digits: int | None = None) -> DataFrame:
    """``cosine_pairs`` in which duplicates have bitwise equal similarities, 1 to each other; rows without a vector are
    left out. Rows whose keys are whole numbers are compared block by block, and rounded there to ``digits``; others by way
    of distinct vectors."""
    if df.schema[key].dataType.simpleString() in ("int", "bigint"):
        outputs = None if digits is None else {"sim": (lambda x: x, digits)}
        return view_pairs(df.where(F.col(vector).isNotNull()), group, key, vector, {"sim": (0, None)}, largest or blocks * BLOCK_ROWS, outputs, equal=True)
    first = df.groupBy(group, vector).agg(F.min(key).alias("rep"))
    member = df.join(first, [group, vector]).select(group, key, "rep")
    sims = cosine_pairs(first.select(group, "rep", vector), group, "rep", vector, blocks=blocks)
    p = unordered_pairs(member, group, key, blocks)
    p = p.withColumn("lo", F.least("rep_a", "rep_b")).withColumn("hi", F.greatest("rep_a", "rep_b"))
    out = p.join(sims.select(group, F.col("i").alias("lo"), F.col("j").alias("hi"), "sim"), [group, "lo", "hi"], "left")
    out = out.select(group, "i", "j", F.when(F.col("lo") == F.col("hi"), F.lit(1.0)).otherwise(F.col("sim")).alias("sim"))
    return out if digits is None else out.withColumn("sim", F.round("sim", digits) + F.lit(0.0))


def average_rank(value: Column | str, *partition: str, descending: bool = False) -> Column:
    """Ranks from 1 with ties averaged, within a partition; ties are exact."""
    v = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*partition).orderBy(v.desc() if descending else v.asc())
    ties = Window.partitionBy(*partition, v)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2


def doubled_rank(value: Column | str, *partition: str) -> Column:
    """Twice the average rank as an exact integer."""
    v = F.col(value) if isinstance(value, str) else value
    return (2 * F.rank().over(Window.partitionBy(*partition).orderBy(v)) + F.count(F.lit(1)).over(Window.partitionBy(*partition, v)) - 1).cast("bigint")


def vector_to_rows(df: DataFrame, key: list[str], vector: str) -> DataFrame:
    """(key, pos, value) of each element."""
    return df.select(*key, F.posexplode(vector).alias("pos", "value"))


def rows_to_vector(df: DataFrame, key: list[str], pos: str = "pos", value: str = "value", name: str = "vector") -> DataFrame:
    """Vectors in the order of ``pos``."""
    return df.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda x: x[value]).alias(name))


def mean_vector(df: DataFrame, key: list[str], vector: str, name: str = "vector") -> DataFrame:
    """Elementwise mean per key: partial sums per element are all that is shuffled."""
    long = df.select(*key, F.posexplode(vector).alias("pos", "value"))
    return rows_to_vector(long.groupBy(*key, "pos").agg(F.avg("value").alias("value")), key, name=name)


def rank_rows(df: DataFrame, key: list[str], vector: str) -> DataFrame:
    """Each vector's centred average ranks; vectors whose values are all alike are left out."""
    long = vector_to_rows(df, key, vector).withColumn("value", average_rank("value", *key))
    out = rows_to_vector(long, key, name="r")
    flat = F.array_max("r") - F.array_min("r") <= 1e-12
    mean = (F.size("r") + 1) / 2
    return out.where(~flat).select(*key, F.transform("r", lambda x: x - mean).alias("ranks"))


def spearman_pairs(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """Rank correlation of each pair of vectors within a group; constant vectors are excluded."""
    return cosine_pairs(rank_rows(df, [group, key], vector), group, key, "ranks")


def fuse_ranks(pairs: DataFrame, a: str, b: str, *group: str, largest: int | None = None, most: int = RANK_ROWS) -> DataFrame:
    """Rank fusion of two pair vectors: (2ra + 2rb - 4) / (4 (m - 1)), integers summed first; ``largest`` and ``most`` as
    in ``with_ranks``."""
    p = with_ranks(pairs, {"_a": a, "_b": b}, *group, doubled=True, largest=largest, most=most)
    if (largest or 0) <= most:
        p = p.withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    else:
        p = p.join(F.broadcast(p.groupBy(*group).agg(F.count(F.lit(1)).alias("_m"))), list(group))  # a row per group of over ``most`` rows
    return p.withColumn("fused", (F.col("_a") + F.col("_b") - 4) / F.nullif(4 * (F.col("_m") - 1), F.lit(0))).drop("_a", "_b", "_m")
