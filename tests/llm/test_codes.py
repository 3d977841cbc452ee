"""Vector codes against plain Lloyd rounds in Python integers, SQL, and every odd table."""

import hashlib
import math

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from tessera.llm import codes

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, q int, id string"


def plain(rows, parts=4, entries=256, rounds=4):
    """(id, code, error, label) of each row and all entries, in Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], lb) for i, v, lb in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = [[q[p * w : (p + 1) * w] for p in range(parts)] for _, q, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            out.append([min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at, strict=True) if a[p][1] == k]
                if own:
                    books[p][k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return [(i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), lb) for (i, _, lb), a in zip(kept, assign(), strict=True)], books


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "c", 1, "x") for r in rows], SCHEMA).repartition(3)
    got = codes.compress(df, **options).collect()
    want, books = plain([(i, v and [None if x is None else float(np.float32(x)) for x in v], lb) for i, v, lb in rows], **options)
    total = {}
    for _, _, e, lb in want:
        total[lb] = total.get(lb, 0) + e
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == sorted(((i, c, e, total[lb]) for i, c, e, lb in want), key=repr)
    text = ",".join(str(x) for b in books for e in b for x in e)
    assert {r.codebooks_sha256 for r in got} <= {hashlib.sha256(text.encode()).hexdigest()}
    return got


@pytest.mark.parametrize("options", [{}, {"entries": 8}, {"entries": 5, "rounds": 9}, {"parts": 2, "entries": 3, "rounds": 0}])
def test_codes_are_plain_lloyd(spark, options):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (12, 8))
    rows = [(k * 3, (centres[k % 12] + rng.normal(0, 0.3, 8)).tolist(), None if k % 5 == 0 else k % 3) for k in range(150)]
    assert len(check(spark, rows, **options)) == 150


def test_codes_of_odd_tables(spark):
    bad = [None, [], [None] * 4, [1.0, float("nan"), 0, 0], [float("inf"), 0, 0, 0]]
    rows = [(k, v, 1) for k, v in enumerate(bad)] + [(7, [0.5, -0.5, 0.25, 0.0], None)] * 2 + [(7, [0.0, -0.0, 0.0, 0.0], 2), (None, [1.0, 2, 3, -4], None), (9, [0.0, 0.0, 0.0, 0.0], 2)]
    assert len(check(spark, [(i, v and [None if x is None else float(x) for x in v], lb) for i, v, lb in rows])) == 5
    assert check(spark, [(1, None, 1)]) == [] and check(spark, [(1, [0.5, 0.5, 0.5, 0.5], 1)])[0].error == 0
    df = spark.createDataFrame([(1, [0.5] * 4, 1, "", 1, ""), (2, [0.5] * 8, 1, "", 1, ""), (3, [0.1] * 4, 1, "", 1, "")], SCHEMA)
    assert {r.vec_id for r in codes.compress(df).collect()} == {1, 3}
    assert codes.compress(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        codes.compress(df.select("vec_id", F.slice("embedding", 1, 3).alias("embedding"), "label"))
    with pytest.raises(Exception, match="63 bits"):
        codes.compress(df.select("vec_id", F.transform("embedding", lambda x: x * 1e9).alias("embedding"), "label")).collect()


def test_only_changed_parts_are_shuffled(spark):
    """The second round's contributions are the differences between two assignments; sums of all of them are the sums."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(k, rng.normal(0, 1, 8).tolist(), 0, "", 0, "") for k in range(200)], SCHEMA)
    rows, d = codes.integers(df)
    first = codes.assigned(rows, np.array([r.q for r in rows.orderBy("id").limit(9).collect()]).reshape(9, 4, 2).transpose(1, 0, 2))
    n = {(r.part, r.entry): (r.n, r.sums) for r in codes.contributions(first, 4, 2).collect()}
    assert sum(v[0] for v in n.values()) == 800
    moved = first.withColumn("before", F.col("code")).withColumn("code", F.when(F.col("id") == 5, F.transform("code", lambda c: (c + 1) % 9)).otherwise(F.col("code")))
    change = codes.contributions(moved, 4, 2).collect()
    assert len(change) == 8 and sum(r.n for r in change) == 0 and codes.contributions(first.withColumn("before", F.col("code")), 4, 2).count() == 0


def test_codes_agree_with_sql(spark):
    assert compare(codes.compress(spark.read.parquet(f"{SF}/embeddings.parquet")), connect(SF), codes.ORACLE_SQL) == ""


def test_large_components_are_exact():
    q = np.array([[[2**26, -(2**26)]], [[2**26, -(2**26) + 1]]], np.int64)
    at, far = codes.nearest(q, np.array([[[2**26, -(2**26) + 1], [2**26, -(2**26)]]], np.int64))
    assert at.ravel().tolist() == [1, 0] and far.ravel().tolist() == [0, 0]
