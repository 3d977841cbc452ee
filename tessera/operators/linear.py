"""Landmark features and ridge read-outs from sums, so that no fold is ever gathered.

A model needs of its training rows only the number of rows, and sums of products of features with features and targets.
Tasks add these up over their rows (at most PARTIALS tasks, however large the table), the partial sums are added row of
the matrix by row, and a system of as many equations as there are features is solved for each model. A row may train
several models: it says which in an array, rows with the same array are summed once, and a model's sums are those of all
arrays that hold it. Sums are taken about the table's means, then moved to each model's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import hash_order

#: Tasks that sum products at most; each gives one matrix for each set of models.
PARTIALS = 512
MODES = ("perturbation_only", "interaction")
#: Rows that a task works on at a time, whatever the size of Arrow's batches.
SLICE = 1_024


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE))


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero. Scaled by the largest component first, so large ones don't overflow."""
    top = np.abs(v).max(1, keepdims=True, initial=0)
    s = np.divide(v, top, out=np.zeros_like(v), where=top > 0)
    n = np.sqrt((s * s).sum(1, keepdims=True))
    return np.divide(s, n, out=np.zeros_like(s), where=n > 0)


def choose_landmarks(df: DataFrame, key: str, count: int, seed: int) -> list:
    """``count`` rows in hash order: a bounded set, held by the driver and sent to all tasks."""
    return df.orderBy(hash_order(seed, F.col(key)), key).limit(count).collect()


def _table(column: pa.Array, name: str, width: int | None = None) -> np.ndarray:
    """A column of arrays as a matrix of finite numbers."""
    out = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if column.null_count or not len(column) or len(out) % len(column) or (width is not None and len(out) != width * len(column)):
        raise ValueError(f"{name} must be arrays of {width or 'as many'} numbers each")
    if not np.isfinite(out).all():
        raise ValueError(f"{name} must contain only finite values")
    return out.reshape(len(column), -1)


def landmark_features(df: DataFrame, perturbation: str, marks: np.ndarray, context: str | None = None, context_marks: np.ndarray | None = None, mode: str = "perturbation_only", name: str = "x") -> DataFrame:
    """Adds an array: the cosine of ``perturbation`` with each landmark or, for ``interaction``, that times the cosine of
    ``context`` with the same landmark's context. A zero vector's cosines are 0."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if (mode == "interaction") != (context is not None) or (context is None) != (context_marks is None):
        raise ValueError("interaction needs a context and its landmarks; perturbation_only takes none")
    if context_marks is not None and len(context_marks) != len(marks):
        raise ValueError("both kernels need the same landmarks")
    sent = df.sparkSession.sparkContext.broadcast((unit_rows(marks), None if context_marks is None else unit_rows(context_marks)))
    sides = [c for c in (perturbation, context) if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            x = np.ones((b.num_rows, len(sent.value[0])))
            for side, m in zip(sides, sent.value, strict=False) if b.num_rows else ():
                x *= np.clip(unit_rows(_table(b.column(side), side, m.shape[1])) @ m.T, -1, 1)
            starts = pa.array(np.arange(b.num_rows + 1) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(starts, pa.array(x.ravel()))], names=[*b.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{name}` array<double>")


class LandmarkRidge:
    """Ridge read-outs, one per model: features standardised by the model's training rows (population deviation, scale 1
    where it is under 1e-8), targets centred, the intercept unpenalised.

    ``fit`` takes rows once; a second call is an error, as is ``predict`` before it. Inputs must be arrays of as many
    finite numbers each."""

    def __init__(self, alpha: float) -> None:
        if isinstance(alpha, bool) or not isinstance(alpha, (int, float, np.floating, np.integer)) or not np.isfinite(alpha) or alpha <= 0:
            raise ValueError("alpha must be a finite, strictly positive number")
        self.alpha, self.models = float(alpha), None

    def fit(self, rows: DataFrame, x: str, y: str, models: Column) -> LandmarkRidge:
        """``models``: array<int> of the models that a row trains."""
        if self.models is not None:
            raise RuntimeError("already fitted: use another instance for other rows")
        sums = product_sums(rows, x, y, models)
        found = {}
        for m in sorted({m for s in sums for m in s}):
            found[m] = self._solve([v for s, v in sums.items() if m in s])
        if not found:
            raise ValueError("no training rows")
        self.models = found
        return self

    def _solve(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(coefficients on raw features, intercepts) from (sums of (1, x, y) products, shift)."""
        total, shift = sum(p for p, _ in parts), parts[0][1]
        n, k = total[0, 0], total.shape[0] - 1
        mean = total[0, 1:] / n
        cov = total[1:, 1:] - n * np.outer(mean[:k], mean)
        sd = np.sqrt(np.maximum(np.diagonal(cov[:, :k]), 0) / n)
        sd = np.where(sd < 1e-8, 1.0, sd)
        b = np.linalg.solve(cov[:, :k] / np.outer(sd, sd) + self.alpha * np.eye(k), cov[:, k:] / sd[:, None]) / sd[:, None]
        if not np.isfinite(b).all():
            raise ValueError("the ridge solution isn't finite")
        centre = mean + shift
        return b, centre[k:] - centre[:k] @ b

    def predict(self, rows: DataFrame, x: str, model: Column, name: str = "prediction") -> DataFrame:
        """Adds an array of predictions of the row's model; null for a model that wasn't fitted. Equal inputs have bitwise
        equal predictions."""
        if self.models is None:
            raise RuntimeError("fit comes before predict")
        sent = rows.sparkSession.sparkContext.broadcast(self.models)
        width, outputs = next(iter(self.models.values()))[0].shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches):
                out: list = [None] * b.num_rows
                if b.num_rows:
                    v, which = _table(b.column(x), x, width), np.array([-1 if m is None else m for m in b.column("_model").to_pylist()])
                    for m in sent.value.keys() & set(which.tolist()):
                        at = np.flatnonzero(which == m)
                        coef, base = sent.value[m]
                        p = np.broadcast_to(base, (len(at), outputs)).copy()
                        for j in range(width):  # one order of additions, whatever the batch
                            p += v[at, j : j + 1] * coef[j]
                        for i, row in zip(at.tolist(), p.tolist(), strict=True):
                            out[i] = row
                kept = [b.column(c) for c in b.schema.names if c != "_model"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.list_(pa.float64()))], names=[*(c for c in b.schema.names if c != "_model"), name])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.withColumn("_model", model.cast("int")).mapInArrow(run, f"{fields}, `{name}` array<double>")

    def predict_distinct(self, rows: DataFrame, x: str, model: str, name: str = "prediction") -> DataFrame:
        """``predict`` on distinct inputs only, given back to all rows that have them."""
        once = self.predict(rows.select(model, x).distinct(), x, F.col(model), name)
        return rows.join(once, [model, x])


def product_sums(rows: DataFrame, x: str, y: str, models: Column) -> dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]]:
    """Per set of models: ((1 + k) x (1 + k + m) sums of products of (1, x) with (1, x, y) about a shift, the shift).

    Sets that train nothing are left out. Two passes: sums for the means, then products about them; the driver gets a
    matrix per set, whatever the number of rows."""
    base = rows.select(F.array_join(F.array_sort(models.cast("array<int>")), ",").alias("s"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")).where("s <> ''").coalesce(PARTIALS)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for b in _slices(batches):
            if b.num_rows:
                n, total = n + b.num_rows, total + np.concatenate([_table(b.column(c), c).sum(0) for c in ("x", "y")])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()])], names=["n", "total"])

    means = base.mapInArrow(totals, "n bigint, total array<double>").collect()
    if not means:
        return {}
    if len({len(r.total) for r in means}) > 1:
        raise ValueError("features and targets must be as many numbers in each row")
    shift = np.sum([r.total for r in means], 0) / sum(r.n for r in means)
    k = len(base.select("x").first().x)
    sent = rows.sparkSession.sparkContext.broadcast(shift)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in _slices(batches):
            if not b.num_rows:
                continue
            v = np.hstack([_table(b.column("x"), x, k), _table(b.column("y"), y, len(sent.value) - k)]) - sent.value
            v = np.hstack([np.ones((len(v), 1)), v])
            sets = np.array(b.column("s").to_pylist())
            for s in np.unique(sets).tolist():
                own = v[sets == s]
                held[s] = held.get(s, 0.0) + own[:, : k + 1].T @ own
        for s, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(m)), pa.array(np.arange(len(m))), pa.array(m.tolist())], names=["s", "i", "v"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": rows["s"][:1], "i": rows["i"][:1], "v": [np.sum(np.stack(rows["v"].to_list()), 0)]})

    parts = base.mapInArrow(products, "s string, i bigint, v array<double>").groupBy("s", "i").applyInPandas(added, "s string, i bigint, v array<double>").collect()
    out = {}
    for s in sorted({r.s for r in parts}):
        out[tuple(map(int, s.split(",")))] = (np.array([r.v for r in sorted((r for r in parts if r.s == s), key=lambda r: r.i)]), shift)
    return out
