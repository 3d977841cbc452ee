"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees on binned features learns one lookup table per feature, then one per interaction of
the pairs that explain most of what is left. Scoring bins the features and adds table entries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, quoted, sigmoid

FEATURES = ("log_words", "word_len", "symbols", "exclaims", "capitals", "digits", "distinct", "top_share", "runs", "dup_lines", "bare", "ended", "line_len", "non_ascii", "stops")
#: The model is fitted to at most so many labelled rows (those of the least hashes of their ids).
MAX_TRAIN = 20_000
_LETTERS_UP = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>"


def features(text: str | None) -> list[float]:
    """The FEATURES of a whole text; zeros for a null or empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), sum(map(len, words))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    bare = sum(c for w, c in seen.items() if len(w) < 3 and not w.isalnum() and w.isascii())
    return [
        float(np.log1p(n)), size / n, share(_SYMBOLS), share(b"!"), share(_LETTERS_UP), share(_DIGITS), len(seen) / n, max(seen.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, 1 - len(set(lines)) / len(lines), bare / n,
        sum(c for w, c in seen.items() if w[-1:] in b".,;:?!") / n, n / len(lines), 1 - len((text or "").encode("ascii", "ignore")) / len(raw), raw.count(b".") / n,
    ]


@dataclass
class Gam:
    cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]
        z = np.full(len(x), self.base)
        for b, t in zip(bins, self.tables, strict=True):
            z += t[b]
        for i, j, t in self.pairs:
            z += t[bins[i], bins[j]]
        return sigmoid(z)


def _split(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    """Best cut of binned gradients: (gain, first bin of the right side; 0 for none)."""
    if len(g) < 2:
        return 0.0, 0
    lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    tg, th = g.sum(), h.sum()
    gain = lg**2 / (lh + l2) + (tg - lg) ** 2 / (th - lh + l2) - tg**2 / (th + l2)
    k = int(np.argmax(gain))
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """A tree of up to three leaves over one feature's bins, as a step per bin."""
    out = np.zeros(len(g))
    edges = [0, len(g)]
    for _ in range(2):
        found = max((*_split(g[a:b], h[a:b], l2), a) for a, b in zip(edges, edges[1:], strict=False))
        if not found[1]:
            break
        edges = sorted({*edges, found[2] + found[1]})
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """A tree over two features' bins, one cut on the first and one cut of the second on each side: (gain, steps)."""
    best, plan = 0.0, None
    tg, th = g.sum(), h.sum()
    for a in range(1, g.shape[0]):
        sides, gain = [], -(tg**2) / (th + l2)
        for part in (slice(0, a), slice(a, None)):
            sg, sh = g[part].sum(0), h[part].sum(0)
            more, cut = _split(sg, sh, l2)
            gain += more + sg.sum() ** 2 / (sh.sum() + l2)
            sides.append((part, cut))
        if gain > best + 1e-9:
            best, plan = gain, sides
    out = np.zeros(g.shape)
    for part, cut in plan or []:
        for cols in (slice(0, cut), slice(cut, None)) if cut else (slice(None),):
            out[part, cols] = -g[part, cols].sum() / (h[part, cols].sum() + l2)
    return best, out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 24, rounds: int = 150, pair_rounds: int = 40, n_pairs: int = 5, rate: float = 0.15, l2: float = 2.0) -> Gam:
    """Fits the tables on a bounded sample. Without rows, or with one class, every score is the smoothed share of ones."""
    n, d = x.shape if x.size else (0, len(FEATURES))
    p = (float(y.sum()) + 0.5) / (n + 1.0)
    base = float(np.log(p / (1 - p)))
    if n == 0 or y.min() == y.max():
        return Gam([np.array([])] * d, base, [np.zeros(1)] * d, [])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    b = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    sizes = [len(c) + 1 for c in cuts]
    tables, z = [np.zeros(k) for k in sizes], np.full(n, base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = sigmoid(z)
        return q - y, q * (1 - q)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[j], g, sizes[j]), np.bincount(b[j], h, sizes[j]), l2)
            tables[j] += step
            z += step[b[j]]
    flat = {(i, j): b[i] * sizes[j] + b[j] for i, j in combinations(range(d), 2)}
    grid = lambda v, i, j: np.bincount(flat[i, j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
    g, h = slopes()
    gains = sorted(((-_pair_tree(grid(g, i, j), grid(h, i, j), l2)[0], i, j) for i, j in flat))[:n_pairs]
    pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in gains]
    for _ in range(pair_rounds):
        for i, j, t in pairs:
            g, h = slopes()
            step = rate * _pair_tree(grid(g, i, j), grid(h, i, j), l2)[1]
            t += step
            z += step[b[i], b[j]]
    return Gam(cuts, base, tables, pairs)


def is_held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that only measure: crc32 of the id as text leaves 1 by 3. A null id is no such row."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, limit: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of at most ``limit`` labelled ids that aren't held out, by hash. Of several labels of one id the
    larger counts; null ids and labels are left out. Bounded, so it may be broadcast."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~is_held_out(id_col))
    rows = rows.groupBy(id_col).agg(F.max(label).cast("int").alias("_y"))
    return rows.orderBy(F.xxhash64(id_col), id_col).limit(limit)


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], names=["y", "x"])

    return docs.select("_y", F.col(text_col).alias("t")).mapInArrow(run, "y int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> Gam:
    """Fits the model; the driver sees FEATURES of at most ``limit`` rows, never texts."""
    sample = labelled_sample(labels, label, limit, id_col)
    joined = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)
    # repeated rows of one id can exceed the sample, so the bound is put again
    rows = sorted((tuple(r.x), r.y) for r in _measured(joined, id_col, text_col).orderBy(F.xxhash64("x"), "x", "y").limit(limit).collect())
    return fit(np.array([r[0] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], float))


def score_name(columns: list[str]) -> str:
    """The score's column name, unlike any of ``columns``."""
    return free_name(columns, "__score")


def score(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(columns ``keep``, id, a score as ``score_name`` calls it) of every row; null and empty texts score as a text
    without words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cols = [*keep, id_col]
    name = score_name(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(b.num_columns - 1)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sent.value.score(x))], names=[*b.schema.names[:-1], name])

    schema = T.StructType([*(docs.schema[c] for c in cols), T.StructField(name, T.DoubleType())])
    return docs.select(*map(quoted, cols), quoted(text_col).alias(free_name(cols, "__scored_text"))).mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted (1 if score >= 0.5).

    Null and empty texts score as a text without words; a null id isn't held out; repeated rows each come back with the
    same score; an empty table gives none; other columns are left out, whatever they are called."""
    scored = score(docs, train(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    points = quoted(score_name([id_col]))
    return scored.select(id_col, is_held_out(id_col).alias("held_out"), points.alias("score"), (points >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their columns, whatever those are called. Null and
    empty texts score as a text without words; repeated rows stay or go together; an empty table gives none."""
    cols = [c for c in docs.columns if c != id_col]
    scored = score(docs, train(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col, tuple(cols))
    return scored.where(quoted(score_name([*cols, id_col])) >= threshold).select(*map(quoted, docs.columns))
