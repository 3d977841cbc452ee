"""Vectors from seeds and spectra: the few places where NumPy generators or linear algebra are needed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import store


def seeded_normal(text: str, size: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")
    return np.random.default_rng(seed).standard_normal(size)


def field_vectors(fields: DataFrame, key: str, field: str, value: str, size: int = 64, seed: int = 0) -> DataFrame:
    """(key, vector): per row of (key, field, value) a Gaussian vector seeded by its text; summed per key, L2-normalised.

    Each distinct (field, value) is drawn once."""

    @F.pandas_udf("array<double>")
    def draw(s: pd.Series) -> pd.Series:
        return s.map(lambda x: seeded_normal(x, size).tolist())

    drawn = fields.select(field, value).distinct().withColumn("_v", draw(F.concat_ws("=", F.lit(str(seed)), field, value)))
    # a sum per place: a key's partial sums are one row, and nothing is collected
    sums = fields.join(drawn, [field, value]).groupBy(key).agg(*[F.sum(F.get("_v", F.lit(i))).alias(f"_{i}") for i in range(size)])
    v = sums.select(key, F.array(*[f"_{i}" for i in range(size)]).alias("v"))
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return v.select(key, F.transform("v", lambda x: x / n).alias("vector"))


def group_gaussian(df: DataFrame, group: str, key: str, size: int = 16, seed: int = 0) -> DataFrame:
    """(group, key, vector): normals seeded by the group and the key, so a row's vector depends on no other row."""

    @F.pandas_udf("array<double>")
    def draw(s: pd.Series) -> pd.Series:
        return s.map(lambda x: seeded_normal(x, size).tolist())

    name = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (group, key)])
    return df.select(group, key, draw(name).alias("vector"))


#: Terms of a matrix whose range is looked for: a table of so many rows by the rank is sent to all tasks.
MOST_TERMS = 20_000
#: Tasks that add up products at most, and sparse values that one works on at a time.
PARTIALS, VALUES = 64, 20_000


def truncated_svd(weights: DataFrame, key: str, term: str, weight: str, rank: int, power: int = 4, extra: int = 10, seed: int = 0, most_terms: int = MOST_TERMS) -> DataFrame:
    """(key, vector): left singular vectors times values of a sparse (key, term, weight) matrix, its ``rank`` largest.

    A random table of rank + ``extra`` columns per term is multiplied by the matrix and its transpose in one pass over the
    keys' sparse rows, made orthonormal, and so on ``power`` times; within the range found, an eigenproblem of that size
    is left. Only that table (terms by columns) is gathered and sent; the terms must be bounded (``max_features``), more
    than ``most_terms`` are an error. Signs: the largest entry of each direction is positive. Rows with nulls are left
    out."""
    w = weights.select(F.col(key).alias("k"), F.col(term).alias("t"), F.col(weight).cast("double").alias("w")).dropna()
    terms = [r.t for r in w.select("t").distinct().orderBy("t").limit(most_terms + 1).collect()]
    if len(terms) > most_terms:
        raise ValueError(f"more than {most_terms} terms: bound them first")
    spark, v, r = weights.sparkSession, len(terms), min(rank + extra, len(terms))
    index = spark.createDataFrame(list(zip(terms, range(v), strict=True)), f"t {w.schema['t'].dataType.simpleString()}, i int")
    sparse = w.join(F.broadcast(index), "t").groupBy("k").agg(F.collect_list("i").alias("i"), F.collect_list("w").alias("w"))
    rows = store(sparse, "sparse-rows")

    def parts(pdf: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, row of each value, its term, its weight), VALUES values or one row at a time."""
        sizes = pdf["i"].map(len).to_numpy()
        at = 0
        while at < len(pdf):
            to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), VALUES, "right")))
            yield slice(at, to), np.repeat(np.arange(to - at), sizes[at:to]), np.concatenate(pdf["i"][at:to].to_list()), np.concatenate(pdf["w"][at:to].to_list())
            at = to

    def times(z: np.ndarray, row: np.ndarray, i: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(z[i] * x[:, None], np.flatnonzero(np.diff(row, prepend=-1)), axis=0)

    def product(z: np.ndarray) -> np.ndarray:
        """The transposed matrix times the matrix times ``z``."""
        sent = spark.sparkContext.broadcast(z)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(sent.value)
            for pdf in batches:
                for _, row, i, x in parts(pdf.reset_index(drop=True)):
                    y, order = times(sent.value, row, i, x), np.argsort(i, kind="stable")
                    first = np.flatnonzero(np.diff(i[order], prepend=-1))
                    total[i[order][first]] += np.add.reduceat(y[row[order]] * x[order, None], first, axis=0)
            at = np.flatnonzero(total.any(1))
            yield pd.DataFrame({"i": at, "v": total[at].tolist()})

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"i": pdf["i"][:1], "v": [np.sum(np.stack(pdf["v"].to_list()), 0)]})

        out = np.zeros_like(z)
        for got in rows.coalesce(PARTIALS).mapInPandas(run, "i bigint, v array<double>").groupBy("i").applyInPandas(added, "i bigint, v array<double>").collect():
            out[got.i] = got.v
        return out

    basis = np.zeros((v, 0))
    if v:
        q = np.linalg.qr(np.random.default_rng(seed).standard_normal((v, r)))[0]
        for _ in range(power):
            q = np.linalg.qr(product(q))[0]
        vals, vecs = np.linalg.eigh(q.T @ product(q))
        basis = q @ vecs[:, np.argsort(-vals)[:rank]]
        basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1.0, 1.0)
    sent = spark.sparkContext.broadcast(basis)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list = []
            for _, row, i, x in parts(pdf.reset_index(drop=True)):
                out += times(sent.value, row, i, x).tolist()
            yield pd.DataFrame({key: pdf["k"], "vector": out})

    return rows.mapInPandas(scored, f"`{key}` {w.schema['k'].dataType.simpleString()}, vector array<double>")


def numeric_rank(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, rank): rank by singular values over max(shape) * eps * the largest. A group's Gram matrix is summed
    in Spark from its vectors, so only width by width numbers reach a task."""
    long = df.select(group, F.posexplode(vector).alias("a", "x"), F.col(vector).alias("v")).select(group, "a", "x", F.posexplode("v").alias("b", "y"))
    g = long.groupBy(group, "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("s"), F.count("*").alias("n"))

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["a"].max()) + 1
        m = np.zeros((k, k))
        m[pdf["a"], pdf["b"]] = pdf["s"]
        vals = np.linalg.eigvalsh(m)
        n = int(pdf["n"].max())
        return pd.DataFrame({group: [pdf[group].iloc[0]], "n": [n], "rank": [int((vals > vals.max() * max(n, k) * np.finfo(float).eps).sum()) if len(vals) and vals.max() > 0 else 0]})

    return g.groupBy(group).applyInPandas(rank, f"`{group}` {df.schema[group].dataType.simpleString()}, n bigint, rank bigint")
