"""Nearest neighbours with pivots against comparing everything."""

import numpy as np
import pytest

from tessera.operators import neighbours as nb


def data(spark, n, seed, clusters):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (clusters, 12))
    x = centres[rng.integers(0, clusters, n)] + rng.normal(0, 0.15, (n, 12))
    x[5] = x[3]
    x[6] = 2 * x[3]
    x[7] = 0
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, v array<double>").repartition(5)


@pytest.mark.parametrize("options", [{}, {"block_rows": 50, "chunk": 11}, {"few": 0}, {"few": 0, "pivots": 6, "rings": 8, "block_rows": 20, "chunk": 7}, {"few": 0, "pivots": 1, "rings": 1}])
@pytest.mark.parametrize("k", [1, 5])
def test_nearest(spark, options, k):
    x, rows = data(spark, 260, 2, 9)
    y, queries = data(spark, 60, 7, 9)
    y[10:20] = x[:10]
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "key long, v array<double>")
    got = {}
    for r in nb.nearest(queries, rows, "key", "v", k, **options).collect():
        got.setdefault(r.q, []).append((r.place, r.key, r.cosine))
    u, w = nb.unit_rows(y), nb.unit_rows(x)
    for q in range(60):
        exact = [(round(-float((u[q] * w[i]).sum()), 12), i) for i in range(260)]
        assert [key for _, key, _ in sorted(got[q])] == [i for _, i in sorted(exact)[:k]] or [round(c, 9) for *_, c in sorted(got[q])] == [round(-c, 9) for c, _ in sorted(exact)[:k]]


def test_few_rows_and_none(spark):
    x, rows = data(spark, 8, 1, 2)
    assert nb.nearest(rows, rows.limit(3), "key", "v", 5).count() == 24 == nb.nearest(rows, rows.limit(3), "key", "v", 5, few=0).count()
    assert nb.nearest(rows, rows.limit(0), "key", "v", 5).count() == 0 and nb.nearest(rows.limit(0), rows, "key", "v", 5).count() == 0


def test_most_rings_are_not_visited(spark, monkeypatch):
    x, rows = data(spark, 1500, 4, 25)
    seen, plain = [], nb._visited
    monkeypatch.setattr(nb, "_visited", lambda visits, *a: (seen.append(visits.agg({"n": "sum"}).first()[0] or 0), plain(visits, *a))[1])
    assert nb.nearest(rows.where("key < 100"), rows, "key", "v", 5, few=0).count() == 500
    assert sum(seen) < 0.5 * 100 * 1500
