"""Rank correlations over all pairs, dealt by ranges, against ranks of all of them at once."""

import numpy as np
import pytest

from tessera.operators import pairranks as pr
from tessera.operators.pairblocks import cosines, units


def ranks(v):
    _, at, n = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def plain(v, f, g):
    u, w = units(v[:, :5]), units(v[:, 3:])
    i, j = np.triu_indices(len(v), 1)
    c = cosines(u, np.ascontiguousarray(u.T))[i, j], cosines(w, np.ascontiguousarray(w.T))[i, j]
    return len(i), np.corrcoef(ranks(f(*c)), ranks(g(*c)))[0, 1]


@pytest.fixture(scope="module")
def data():
    """Vectors by group: different ones, many copies, and all but one alike."""
    rng = np.random.default_rng(3)
    few = rng.normal(0, 1, (6, 8))
    alike = np.ones((20, 8))
    alike[0, 4] = -3
    return {1: rng.normal(0, 1, (90, 8)), 2: np.concatenate([few[rng.integers(0, 6, 70)], few[:1].repeat(30, 0), rng.normal(0, 1, (9, 8))]), 3: alike, 4: rng.normal(0, 1, (2, 8)), 5: rng.normal(0, 1, (1, 8))}


MEASURES = {"x": lambda x, y: x, "mean": lambda x, y: (x + y) / 2}


@pytest.mark.parametrize("options", [{}, {"span": 100, "rows": 30, "sample": 20}, {"span": 7, "rows": 16}])
def test_rank_correlations(spark, data, options):
    rows = [(g, k, v.tolist()) for g, own in data.items() for k, v in enumerate(own)] + [(1, 999, None), (None, 5, [1.0] * 8)]
    df = spark.createDataFrame(rows, "g int, k long, v array<double>").repartition(5)
    got = {(r.g, r.measure): r for r in pr.rank_correlations(df, "g", "k", "v", {"x": (0, 5), "y": (3, 8)}, lambda x, y: y, MEASURES, 110, **options).collect()}
    assert set(got) == {(g, m) for g in (1, 2, 3, 4) for m in MEASURES}
    for g in (1, 2, 3):
        for m, f in MEASURES.items():
            n, rho = plain(data[g], f, lambda x, y: y)
            assert got[g, m].n == n and got[g, m].status == "ok" and abs(got[g, m].rho - rho) < 1e-12
    assert got[4, "x"].status == "too_few" and got[4, "x"].rho is None


def test_a_frequent_value_is_dealt(spark, data):
    """Copies give one value to most pairs; it has a range to itself, in as many parts as it takes."""
    cuts = pr._cuts(np.repeat([0.5, 0.7, 1.0], [3, 400, 7]), 20)
    r = pr._Ranges(cuts)
    for k, at in pr._split(np.repeat([0.5, 0.7, 0.9], [3, 400, 7]), cuts):
        r.n[k], r.flat[k] = len(at), len(at) == 400
    assert r.flat.sum() == 1 and {r.part(int(r.flat.argmax()), turn, 100) for turn in range(50)} == {0, 1, 2, 3}


def test_no_table_of_pairs_is_ranked(spark, monkeypatch):
    from tessera.operators import order
    from tessera.plans import registry

    def refuse(*_, **__):
        raise AssertionError("all pairs are written")

    monkeypatch.setattr(order, "store", refuse)
    monkeypatch.setattr(order, "RANK_ROWS", 10)
    for q in ("m01_rsa_status", "m30_fusion_delta", "l29_registry_evaluation"):
        plan = registry.queries()[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and " i#" not in plan
