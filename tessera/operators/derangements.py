"""Length-balanced derangements of a bounded list of texts, and greedy choice of records that differ most.

A design is a seed, an amplitude of jitter and a number; each is one row, and gives one least-cost assignment of jittered
costs in some task. Designs that give the same texts are one mapping, of which the record of least cost is kept. Mappings
within the gate are candidates, from which a choice is made that keeps its least Hamming distance as large as it can be.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import remove, store

from .resampling import assign

#: Entities whose costs make one table of a task: the square of their number.
MAX_ENTITIES = 2_000
FORBIDDEN = 1e6


def length_costs(lengths: np.ndarray) -> np.ndarray:
    """Half the absolute log ratio of characters plus that of words, each plus one, from each entity to each other."""
    a = np.log(np.asarray(lengths, float) + 1)
    return 0.5 * np.abs(a[None, :, :] - a[:, None, :]).sum(2)


def own_text(texts: Sequence[str]) -> np.ndarray:
    """Where an entity would get its own text, or one that equals it."""
    t = np.array(texts, object)
    return t[:, None] == t[None, :]


def optimum(lengths: np.ndarray, texts: Sequence[str]) -> tuple[float, np.ndarray]:
    """Cost and assignment of the cheapest derangement; an error where some entity would keep its text."""
    if len(texts) > MAX_ENTITIES:
        raise ValueError(f"{len(texts)} entities; a list of up to {MAX_ENTITIES} is meant")
    same, cost = own_text(texts), length_costs(lengths)
    best = assign(np.where(same, FORBIDDEN, cost))
    if same[np.arange(len(texts)), best].any():
        raise ValueError("no complete derangement: more than half of the texts are alike")
    return float(cost[np.arange(len(texts)), best].sum()), best


def derangement_pool(spark: SparkSession, lengths: np.ndarray, texts: Sequence[str], seeds: Sequence[int], amplitudes: Sequence[float], reps: int) -> DataFrame:
    """(signature, cost, seed, amplitude, rep, given): the mapping of each design, one record per signature, which is the
    list of texts that entities get: the one of least cost, then seed, amplitude and number. ``given`` holds places.

    Designs in which an entity keeps its text are left out. The list of texts is sent to all tasks; designs are rows."""
    designs = spark.range(len(seeds) * len(amplitudes) * reps).repartition(spark.sparkContext.defaultParallelism)
    sent = spark.sparkContext.broadcast((length_costs(lengths), own_text(texts), list(texts), list(seeds), list(amplitudes)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cost, same, names, seeds, amplitudes = sent.value
        at, out = np.arange(len(names)), []
        for part in parts:
            for k in part["id"].tolist():
                design = seeds[k // (reps * len(amplitudes))], amplitudes[k // reps % len(amplitudes)], k % reps
                rng = np.random.default_rng([design[0], k // reps % len(amplitudes), design[2]])
                p = assign(np.where(same, FORBIDDEN, cost + design[1] * rng.random(cost.shape)))
                if not same[at, p].any():
                    out.append(([names[j] for j in p], float(cost[at, p].sum()), *design, p.tolist()))
        yield pd.DataFrame(out, columns=["signature", "cost", "seed", "amplitude", "rep", "given"])

    each = designs.mapInPandas(run, "signature array<string>, cost double, seed bigint, amplitude double, rep bigint, given array<bigint>")
    first = F.min(F.struct("cost", "seed", "amplitude", "rep", "given")).alias("r")
    return each.groupBy("signature").agg(first).select("signature", "r.*")


def diverse_selection(items: DataFrame, vector: str, cost: str, keep: int, *ties: str) -> DataFrame:
    """``keep`` of the items with their ``place`` from 0: the cheapest first, then again and again the one whose least
    Hamming distance to those chosen is largest; ties by lower cost, larger vector, lower ``ties``.

    Items with equal vectors are one. A round is a pass over the items; only the chosen ones reach the driver. Too few
    items are an error."""
    first = F.min(F.struct(cost, *ties, *[c for c in items.columns if c not in (vector, cost, *ties)])).alias("r")
    rows = store(items.groupBy(vector).agg(first).select(vector, "r.*").withColumn("_near", F.lit(None).cast("bigint")), "diverse")
    kind, chosen = rows.drop("_near").schema, []
    while len(chosen) < keep:
        order = [F.desc("_near"), F.asc(cost), F.desc(vector) if chosen else F.asc(vector), *[F.asc(c) for c in ties]]
        best = rows.orderBy(*order).first()
        if best is None:
            raise ValueError(f"{len(chosen)} different items, {keep} wanted")
        chosen.append(best)
        if len(chosen) < keep:
            other = F.lit(best[vector])
            apart = F.size(F.filter(F.zip_with(vector, other, lambda a, b: ~a.eqNullSafe(b)), lambda d: d)).cast("bigint")
            nearer = store(rows.withColumn("_near", F.least("_near", apart)).where(F.col(vector) != other), "diverse")
            remove(rows)
            rows = nearer
    return items.sparkSession.createDataFrame([(k, *[r[c] for c in kind.names]) for k, r in enumerate(chosen)], "place bigint, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind))


def balanced_derangements(spark: SparkSession, lengths: np.ndarray, texts: Sequence[str], keep: int, seeds: Sequence[int], amplitudes: Sequence[float], reps: int, gate: float = 1.10) -> DataFrame:
    """(place, signature, cost, seed, amplitude, rep, given, ratio): ``keep`` derangements whose cost is at most ``gate``
    times the optimum, as different as a greedy choice makes them. Too few within the gate are an error."""
    least, _ = optimum(lengths, texts)
    pool = derangement_pool(spark, lengths, texts, seeds, amplitudes, reps).where(F.col("cost") <= least * gate + 1e-12)
    return diverse_selection(pool, "signature", "cost", keep, "seed", "amplitude", "rep").withColumn("ratio", F.col("cost") / least)
