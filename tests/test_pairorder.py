"""Pair order by counting against all pairs."""

import itertools
import random

import numpy as np
import pytest

from tessera.operators.pairorder import concordant, pair_order_accuracy


def brute(rows):
    pairs = [(a, b) for a, b in itertools.combinations(rows, 2) if a[0] != b[0]]
    return len(pairs), sum(0.5 if a[1] == b[1] else float((a[1] < b[1]) == (a[0] < b[0])) for a, b in pairs) / max(1, len(pairs))


@pytest.mark.parametrize("top", [1, 2, 3, 7, 1000])
def test_concordant(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 2, 17, 64):
        t, p, w = rng.integers(0, 5, n), rng.integers(0, top, n), rng.integers(1, 4, n)
        want = sum(int(w[i] * w[j]) for i in range(n) for j in range(n) if t[i] < t[j] and p[i] < p[j])
        assert concordant(t, p.astype(float), w) == want


@pytest.mark.parametrize("rows,blocks", [(10**6, 512), (0, 4), (0, 1), (0, 50)])
def test_pair_order_either_way(spark, rows, blocks):
    rnd = random.Random(blocks)
    data = [(g, rnd.choice([0.0, 1.0, 2.5, rnd.random()]), rnd.choice([1.0, -1.0, rnd.random()])) for g in ("a", "b", None) for _ in range(90)]
    data += [("hot", float(k % 3 if k < 60 else 1), float(k % 11)) for k in range(150)] + [("one", 1.0, 2.0)] * 3 + [("a", None, 1.0), ("a", 1.0, None)]
    got = {r.g: (r.n_pairs, r.accuracy) for r in pair_order_accuracy(spark.createDataFrame(data, "g string, t double, p double"), "t", "p", "g", group_rows=rows, blocks=blocks).collect()}
    for g in ("a", "b", None, "hot"):
        n, share = brute([(t, p) for q, t, p in data if q == g and t is not None and p is not None])
        assert got[g] == (n, pytest.approx(share))
    assert "one" not in got
