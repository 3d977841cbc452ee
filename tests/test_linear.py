"""Ridge read-outs from sums against the closed form, landmark features, and what both refuse."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import linear as lin
from tessera.operators import metrics as met
from tessera.plans import registry, resampling
from tessera.plans.base import Tables

SF = "/root/testdata/sf0.001"


def closed_form(x, y, q, alpha=10.0):
    mu, sd = x.mean(0), x.std(0)
    sd = np.where(sd < 1e-8, 1.0, sd)
    z = (x - mu) / sd
    return (q - mu) / sd @ np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean(0))) + y.mean(0)


def rows_of(spark, x, y, models):
    return spark.createDataFrame([(i, a.tolist(), b.tolist(), m) for i, (a, b, m) in enumerate(zip(x, y, models, strict=True))], "k long, x array<double>, y array<double>, m array<int>")


def test_ridge_is_the_closed_form_per_model(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(5, 2, (60, 4))
    x[:, 2], x[:, 3] = 7.0, 1 + np.arange(60) * 1e-12  # constant, and constant but for noise
    y = rng.normal(0, 1, (60, 2)) + x[:, :1]
    trains = [[m for m in (0, 1, 2) if i % 3 != m] for i in range(60)]
    df = rows_of(spark, x, y, trains).repartition(5)
    got = {r.k: r.prediction for r in lin.LandmarkRidge(10).fit(df, "x", "y", F.col("m")).predict(df, "x", F.col("k") % 3).collect()}
    for m in range(3):
        own = np.arange(60) % 3 == m
        assert np.allclose([got[i] for i in np.flatnonzero(own)], closed_form(x[~own], y[~own], x[own]), atol=1e-9)


def test_ridge_on_a_whole_table(spark):
    rows = sorted(resampling.landmark_rows(Tables(spark, SF)).collect(), key=lambda r: r.vec_id)
    x, y, f = np.array([r.x for r in rows]), np.array([r.y for r in rows]), np.array([r.fold for r in rows])
    assert x.shape[1] == min(256, len(rows))
    got = {r.vec_id: r.prediction for r in registry.queries()["l09_landmark_ridge"](spark, SF).collect()}
    want = np.empty_like(y)
    for m in range(5):
        want[f == m] = closed_form(x[f != m], y[f != m], x[f == m])
    assert np.allclose([got[r.vec_id] for r in rows], want, atol=2e-6)


def test_interaction_ridge_on_a_whole_table(spark):
    rows = sorted(resampling.landmark_rows(Tables(spark, SF), "interaction").collect(), key=lambda r: r.vec_id)
    x, y, f = np.array([r.x for r in rows]), np.array([r.y for r in rows]), np.array([r.fold for r in rows])
    got = {r.vec_id: r.prediction for r in registry.queries()["l09c_interaction_ridge"](spark, SF).collect()}
    assert np.allclose([got[r.vec_id] for r in rows if r.fold == 2], closed_form(x[f != 2], y[f != 2], x[f == 2]), atol=2e-6)


def test_field_readout_on_a_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    names = sorted({str(r.label) for r in rows})
    x, f = np.array([r.embedding for r in rows], float), np.array([r.vec_id % 5 for r in rows])
    truth = np.array([str(r.label) for r in rows])
    y = (truth[:, None] == np.array(names)).astype(float)
    pred = np.empty(len(rows), object)
    for m in range(5):
        pred[f == m] = np.array(names)[closed_form(x[f != m], y[f != m], x[f == m]).argmax(1)]
    want = met.classification(spark.createDataFrame(list(zip(truth.tolist(), pred.tolist(), strict=True)), "t string, p string"), "t", "p").first()
    got = registry.queries()["l12_field_readout"](spark, SF).first()
    assert [got.accuracy, got.macro_f1] == pytest.approx([want.accuracy, want.macro_f1], abs=1e-6)


def test_product_interaction(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "p array<double>, c array<double>")
    marks, context = np.array([[1.0, 0], [1, 1]]), np.array([[0.0, 1], [1, 0]])
    got = [r.x for r in lin.landmark_features(df, "p", marks, "c", context, "interaction").collect()]
    assert np.allclose(got, [[1, 0], [0, 0]])
    assert np.allclose([r.x for r in lin.landmark_features(df, "p", marks * 1e200).collect()], [[1, 0.5**0.5], [0, 0]])


@pytest.mark.parametrize("bad", [{"mode": "sum"}, {"mode": "interaction"}, {"context": "c", "context_marks": np.eye(2)}, {"mode": "interaction", "context": "c", "context_marks": np.eye(3)}])
def test_features_refuse(spark, bad):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0])], "p array<double>, c array<double>")
    with pytest.raises(ValueError):
        lin.landmark_features(df, "p", np.eye(2), **bad)


def test_ridge_refuses(spark):
    good = rows_of(spark, np.arange(8.0).reshape(4, 2), np.arange(4.0).reshape(4, 1), [[0]] * 4)
    for alpha in (0, -1, float("nan"), "1", 1j):
        with pytest.raises(ValueError):
            lin.LandmarkRidge(alpha)
    with pytest.raises(RuntimeError):
        lin.LandmarkRidge(1).predict(good, "x", F.lit(0))
    model = lin.LandmarkRidge(1).fit(good, "x", "y", F.col("m"))
    with pytest.raises(RuntimeError):
        model.fit(good, "x", "y", F.col("m"))
    before = {m: [a.copy() for a in p] for m, p in model.models.items()}
    assert model.predict(good, "x", F.lit(7)).first().prediction is None
    assert all((a == b).all() for m in before for a, b in zip(before[m], model.models[m], strict=True))
    with pytest.raises(ValueError):
        lin.LandmarkRidge(1).fit(good.limit(0), "x", "y", F.col("m"))
    with pytest.raises(ValueError):
        lin.LandmarkRidge(1).fit(good, "x", "y", F.array().cast("array<int>"))
    for x in ([float("nan"), 1.0], [1.0], None, [1.0, None]):
        odd = good.union(spark.createDataFrame([(9, x, [1.0], [0])], good.schema))
        with pytest.raises(Exception, match="must"):
            lin.LandmarkRidge(1).fit(odd, "x", "y", F.col("m"))
    with pytest.raises(Exception, match="must be arrays"):
        model.predict(good.withColumn("x", F.array(F.lit(1.0))), "x", F.lit(0)).collect()


def test_equal_inputs_have_equal_predictions(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(0, 1, (7, 30)), 9, 0)
    df = rows_of(spark, x, rng.normal(0, 1, (63, 2)), [[0]] * 63).withColumn("f", F.lit(0))
    model = lin.LandmarkRidge(1).fit(df, "x", "y", F.col("m"))
    each = model.predict(df.repartition(9, "k"), "x", F.col("f")).groupBy("x").agg(F.countDistinct("prediction").alias("n")).collect()
    once = {r.k: r.prediction for r in model.predict_distinct(df, "x", "f").collect()}
    assert len(each) == 7 and all(r.n == 1 for r in each)
    assert once == {r.k: r.prediction for r in model.predict(df, "x", F.col("f")).collect()}
