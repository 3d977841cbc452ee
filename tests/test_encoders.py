"""Pooling and batched encoding against NumPy, text by text."""

import numpy as np
import pytest

from tessera.operators import encoders as enc


def test_pool():
    h = np.arange(24.0).reshape(2, 3, 4)
    mask = np.array([[1, 1, 0], [1, 1, 1]])
    assert np.allclose(enc.pool(h, mask, "mean"), [h[0, :2].mean(0), h[1].mean(0)])
    assert np.allclose(enc.pool(h, mask, "cls"), h[:, 0]) and np.allclose(enc.pool(h, mask, "last_token"), [h[0, 1], h[1, 2]])
    left = np.array([[0, 1, 1], [0, 0, 1]])
    assert np.allclose(enc.pool(h, left, "last_token"), h[:, 2]) and np.allclose(enc.pool(h, left, "mean"), [h[0, 1:].mean(0), h[1, 2]])
    for bad in ((h, mask, "max"), (h, mask[:, :2], "mean"), (h[0], mask, "mean"), (h, np.array([[0, 0, 0], [1, 1, 1]]), "mean"), (h, left, "cls")):
        with pytest.raises(ValueError):
            enc.pool(*bad)


def test_batches():
    lengths = [3, 50, 7, 7, 1, 900, 2]
    got = list(enc.batches_of(lengths, rows=3, tokens=100))
    assert sorted(k for b in got for k in b) == list(range(7)) and got[0] == [5]
    assert all(len(b) <= 3 and (len(b) == 1 or max(lengths[k] for k in b) * len(b) <= 100) for b in got)


@pytest.mark.parametrize("padding", ["right", "left"])
def test_encoding_is_pooling_of_each_text_alone(spark, padding):
    def make():
        return enc.HashedTokens(8, 40, padding)

    texts = ["the cat sat", "The cat", "", None, "a " * 100, "the cat sat", "zz"]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "k int, t string, other double").repartition(3)
    modes = ("mean", "last_token") if padding == "left" else enc.MODES
    got = {r.k: r for r in enc.encode_texts(df, "t", make, modes, rows=2, tokens=30).collect()}
    for k, t in enumerate(texts):
        v = np.array([make().vector(x) for x in ["<start>", *(t or "").lower().split()][:40]])
        h = np.array([x + 0.25 * (v[:i].mean(0) if i else 0) for i, x in enumerate(v)])
        for m, want in (("mean", h.mean(0)), ("cls", h[0]), ("last_token", h[-1])):
            if m in modes:
                assert np.allclose(got[k][m], want / np.linalg.norm(want))
    assert got[0].asDict()["other"] == 1.0 and got[0]["mean"] == got[5]["mean"] and got[2]["mean"] == got[3]["mean"]
    assert enc.encode_texts(df.limit(0), "t", make).collect() == []
    with pytest.raises(ValueError):
        enc.encode_texts(df, "t", make, ("max",))
