"""Steps that hold a bounded part of their input, against what they gave when they held more."""

import numpy as np
import pyarrow as pa

from tessera.functions import text
from tessera.operators import kernels, linear
from tessera.operators import neighbours as nb


def test_terms_are_chosen_before_documents_are_dealt(spark, monkeypatch):
    d = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "the dog sat"), (3, ""), (4, "mat cat mat")], "k long, t string")
    got = [sorted(map(tuple, text.tfidf(d, "k", "t", max_features=4).collect()))]
    monkeypatch.setattr(text, "SENT_TERMS", 0)
    got.append(sorted(map(tuple, text.tfidf(d, "k", "t", max_features=4).collect())))
    assert got[0] and [g[:2] for g in got[0]] == [g[:2] for g in got[1]] and np.allclose([g[2:] for g in got[0]], [g[2:] for g in got[1]])


def test_field_vectors_collect_nothing(spark):
    f = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x")], "k long, f string, v string")
    plan = kernels.field_vectors(f, "k", "f", "v", 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "explode" not in plan


def test_slices():
    b = pa.RecordBatch.from_arrays([pa.array([[float(k)] for k in range(2500)])], names=["x"])
    sizes = [s.num_rows for s in linear._slices(iter([b, b.slice(0, 0)]))]
    assert sizes == [1024, 1024, 452]
    assert [linear._table(s.column("x"), "x")[0, 0] for s in linear._slices(iter([b]))] == [0.0, 1024.0, 2048.0]


def test_neighbours_some_queries_at_a_time(spark, monkeypatch):
    x = np.random.default_rng(1).normal(0, 1, (40, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, v array<double>")
    want = sorted(map(tuple, nb.nearest(df, df, "key", "v", 3).collect()))
    monkeypatch.setattr(nb, "AT_ONCE", 7)
    assert nb.FEW > 100_000 and sorted(map(tuple, nb.nearest(df, df, "key", "v", 3).collect())) == want
