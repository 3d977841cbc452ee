"""Seeded vectors, truncated SVD and ranks against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import tfidf
from tessera.operators import kernels
from tessera.plans import registry

SF = "/root/testdata/sf0.001"


def cosines(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    return u @ u.T


@pytest.mark.parametrize("rank", [1, 6, 40])
def test_truncated_svd(spark, rank):
    rng = np.random.default_rng(rank)
    a = (rng.normal(0, 1, (70, 8)) * 2.0 ** -np.arange(8)) @ rng.normal(0, 1, (8, 40)) * (rng.random((70, 40)) < 0.6)
    rows = [(i, f"t{j:02d}", float(a[i, j])) for i in range(70) for j in range(40) if a[i, j]] + [(3, None, 1.0), (None, "t01", 1.0)]
    got = {r.k: r.vector for r in kernels.truncated_svd(spark.createDataFrame(rows, "k long, t string, w double").repartition(5), "k", "t", "w", rank, power=12).collect()}
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    x = np.array([got.get(i, [0.0] * rank) for i in range(70)])
    assert x.shape == (70, rank) and np.allclose(cosines(x), cosines(u[:, :rank] * s[:rank]), atol=1e-4)
    assert np.allclose(np.linalg.norm(x, axis=0), s[:rank], rtol=1e-4)


def test_truncated_svd_refuses_and_is_empty(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], "k long, t string, w double")
    with pytest.raises(ValueError):
        kernels.truncated_svd(df, "k", "t", "w", 1, most_terms=1)
    assert kernels.truncated_svd(df.limit(0), "k", "t", "w", 1).collect() == []


def test_svd_of_the_documents(spark):
    """With as many directions as the documents span, their cosines are those of the whole weights."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.vector for r in registry.queries()["g15_truncated_svd"](spark, SF).collect()}
    weights = tfidf(docs, "doc_id", "text", max_features=2_000).collect()
    keys, terms = sorted(got), sorted({w.term for w in weights})
    a = np.zeros((len(keys), len(terms)))
    for w in weights:
        a[keys.index(w.doc_id), terms.index(w.term)] = w.weight
    x = np.array([got[k] for k in keys])
    assert x.shape[1] == 256 > np.linalg.matrix_rank(a) and np.allclose(cosines(x), cosines(a), atol=1e-6)


def test_group_gaussian(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), "id")
    one = {r.id: r.vector for r in kernels.group_gaussian(df, "g", "id", 4).collect()}
    assert one == {r.id: r.vector for r in kernels.group_gaussian(df.repartition(7), "g", "id", 4).collect()}
    x = np.array(list(one.values()))
    assert abs(x.mean()) < 0.05 and abs(x.std() - 1) < 0.05 and np.abs(np.corrcoef(x.T) - np.eye(4)).max() < 0.08 and len(np.unique(x)) == x.size


def test_field_vectors(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (2, "b", "y"), (3, "a", "x")], "k int, f string, v string")
    got = {r.k: np.array(r.vector) for r in kernels.field_vectors(df, "k", "f", "v", 8, 5).collect()}
    want = kernels.seeded_normal("5=a=x", 8) + kernels.seeded_normal("5=b=y", 8)
    assert np.allclose(got[1], want / np.linalg.norm(want)) and (got[1] == got[2]).all() and np.isclose(np.linalg.norm(got[3]), 1)


def test_field_vector_query(spark):
    rows = {r.p_partkey: r for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    for r in registry.queries()["g13_field_vectors"](spark, SF).limit(20).collect():
        v = sum(kernels.seeded_normal(f"0={f}={x}", 16) for f, x in (("brand", rows[r.p_partkey].p_brand), ("type", rows[r.p_partkey].p_type)))
        assert np.allclose(r.vector, v / np.linalg.norm(v), atol=2e-6)


def test_numeric_rank(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, (3, 6))
    rows = [("full", v.tolist()) for v in rng.normal(0, 1, (9, 6))] + [("three", (rng.normal(0, 1, 3) @ base).tolist()) for _ in range(20)] + [("zero", [0.0] * 6)] * 2
    assert {r.g: (r.n, r["rank"]) for r in kernels.numeric_rank(spark.createDataFrame(rows, "g string, v array<double>"), "g", "v").collect()} == {"full": (9, 6), "three": (20, 3), "zero": (2, 0)}


def test_numeric_rank_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = {r.label: r["rank"] for r in registry.queries()["g16_numeric_rank"](spark, SF).collect()}
    for lb in {r.label for r in rows}:
        x = np.array([list(r.embedding) + list(r.embedding[:2]) for r in rows if r.label == lb], float)
        assert got[lb] == np.linalg.matrix_rank(x)
