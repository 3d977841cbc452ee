"""Derangements and diverse choice against plain versions."""

import numpy as np
import pytest

from tessera.operators import derangements as der
from tessera.operators.resampling import assign
from tessera.plans import registry

SF = "/root/testdata/sf0.001"


def chosen(items, keep):
    """(signature, cost, seed, amplitude, rep) records by the rule, one after the other."""
    left = sorted(items, key=lambda x: (x[1], x[0], x[2:]))
    out = [left.pop(0)]
    while len(out) < keep:
        key = lambda x: (min(sum(a != b for a, b in zip(x[0], s[0], strict=True)) for s in out), -x[1], x[0], *[-v for v in x[2:]])
        out.append(left.pop(max(range(len(left)), key=lambda i: key(left[i]))))
    return out


def test_diverse_selection(spark):
    rng = np.random.default_rng(1)
    rows = list({tuple(map(str, rng.integers(0, 3, 5))): float(rng.integers(0, 4)) for _ in range(60)}.items())
    df = spark.createDataFrame([(list(s), c, k) for k, (s, c) in enumerate(rows)], "v array<string>, c double, k bigint").repartition(4)
    got = [(tuple(r.v), r.c, r.k) for r in sorted(der.diverse_selection(df, "v", "c", 12, "k").collect(), key=lambda r: r.place)]
    assert got == chosen([(s, c, k) for k, (s, c) in enumerate(rows)], 12)
    with pytest.raises(ValueError):
        der.diverse_selection(df.limit(3), "v", "c", 4, "k")


def test_balanced_derangements(spark):
    rng = np.random.default_rng(3)
    lengths, texts = rng.integers(5, 90, (14, 2)), [f"t{k // 2 if k < 6 else k}" for k in range(14)]
    seeds, amplitudes, reps = (5, 6), (0.02, 0.3), 4
    cost, same = der.length_costs(lengths), der.own_text(texts)
    assert cost[2, 5] == pytest.approx(sum(0.5 * abs(np.log((lengths[5, k] + 1) / (lengths[2, k] + 1))) for k in (0, 1)))
    best, pool = assign(np.where(same, 1e6, cost)), {}
    least = cost[np.arange(14), best].sum()
    for s in seeds:
        for a, amp in enumerate(amplitudes):
            for r in range(reps):
                p = assign(np.where(same, 1e6, cost + amp * np.random.default_rng([s, a, r]).random(cost.shape)))
                record = (tuple(texts[j] for j in p), cost[np.arange(14), p].sum(), s, amp, r)
                if not same[np.arange(14), p].any() and (record[0] not in pool or record[1:] < pool[record[0]][1:]):
                    pool[record[0]] = record
    inside = [r for r in pool.values() if r[1] <= 1.4 * least + 1e-12]
    got = sorted(der.balanced_derangements(spark, lengths, texts, 3, seeds, amplitudes, reps, 1.4).collect(), key=lambda r: r.place)
    assert [(tuple(r.signature), r.seed, r.amplitude, r.rep) for r in got] == [(x[0], *x[2:]) for x in chosen(inside, 3)]
    for r in got:
        assert sorted(r.given) == list(range(14)) and [texts[j] for j in r.given] == r.signature and all(texts[j] != texts[i] for i, j in enumerate(r.given))
    with pytest.raises(ValueError):
        der.balanced_derangements(spark, lengths, texts, len(inside) + 1, seeds, amplitudes, reps, 1.4)
    with pytest.raises(ValueError):
        der.optimum(lengths[:3], ["a", "a", "b"])


def test_mapping_queries(spark):
    rows = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    maps = registry.queries()["l15_balanced_derangements"](spark, SF).collect()
    quality = {r.perm: r for r in registry.queries()["l16_mapping_quality"](spark, SF).collect()}
    for p in range(5):
        own = [r for r in maps if r.perm == p]
        assert sorted(r.item_id for r in own) == sorted(r.given for r in own) == sorted(rows) and all(rows[r.item_id] != rows[r.given] for r in own)
        size = lambda k: np.array([len(rows[k]), len(rows[k].split())]) + 1
        cost = sum(0.5 * np.abs(np.log(size(r.given) / size(r.item_id))).sum() for r in own)
        assert quality[p].cost == pytest.approx(cost, abs=1e-6) and 1 <= quality[p].cost_ratio <= 1.1 and quality[p].n_fixed == 0
        others = [[r.given for r in sorted(maps, key=lambda r: r.item_id) if r.perm == q] for q in range(5)]
        assert quality[p].least_distance == min(sum(rows[a] != rows[b] for a, b in zip(others[p], others[q], strict=True)) for q in range(5) if q != p)


def test_diverse_query_spreads(spark):
    got = sorted(registry.queries()["k08_diverse_selection"](spark, SF).collect(), key=lambda r: r.place)
    all_rows = {(r.p_size, r.p_partkey % 7, r.p_partkey % 11) for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    assert [(r.a, r.b, r.c) for r in got] == [x[0] for x in chosen([(s, 0.0) for s in all_rows], 10)]
