"""Toxicity by classifier chains: categories are predicted one after the other, each linear model seeing the earlier
categories' probabilities. In training these are out-of-fold predictions, so later models meet honest inputs.

Features are the presence of lower-cased words and of their beginnings (4 and 5 letters), which also catch unseen
inflections. Those that tell toxic documents best are chosen in Spark from counts; only they reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fit_logistic, free_name, materialize, quoted, sigmoid
from .gam import labelled_sample

#: The labels hold one overall mark and no types of toxicity, so the chain's narrower categories are the mark's parts by
#: language: the languages that occur among toxic training rows, the most frequent first, so many at most.
MAX_CATEGORIES = 8
#: The models are fitted to at most so many labelled rows, on at most so many features.
MAX_TRAIN = 16_000
MAX_FEATURES = 4_000
MIN_COUNT = 3
L2 = 0.05
#: A feature is of use if toxic documents have it so many times as often as others.
LIFT = 2.0
#: A feature counts in full from so many toxic rows on, in proportion below: rare ones are often chance.
FULL_EVIDENCE = 20
FOLDS = 3
#: The decision point is moved by out-of-fold results, but not below this probability.
LEAST_POINT = 0.2
THRESHOLD = 0.5
PREFIXES = (4, 5)
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> set[str]:
    """Distinct features of a whole text; a beginning is marked by a trailing hyphen."""
    words = set(_WORD.findall((text or "").lower()))
    return words.union(*({w[:k] + "-" for w in words if len(w) >= k} for k in PREFIXES))


@dataclass
class Chain:
    names: tuple[str, ...]
    index: dict[str, int]
    weights: list[np.ndarray]  # of the features, the earlier categories, the intercept

    def score(self, found: list[list[int]]) -> np.ndarray:
        n, k = len(found), len(self.index)
        rows = np.repeat(np.arange(n), [len(f) for f in found])
        cols = np.array([c for f in found for c in f], dtype=np.int64)
        out = np.zeros((n, len(self.names)))
        for j, w in enumerate(self.weights):
            z = np.bincount(rows, w[cols], n) if n else np.zeros(0)
            out[:, j] = sigmoid(z + out[:, :j] @ w[k : k + j] + w[-1])
        return out


def _fit(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, prior: np.ndarray, k: int, y: np.ndarray, take: np.ndarray) -> np.ndarray:
    n, j = prior.shape
    if not take.any():  # nothing is known: nothing is toxic
        return np.append(np.zeros(k + j), -10.0)
    new = np.cumsum(take) - 1
    m = take[rows]
    r, c = np.nonzero(np.ones((int(take.sum()), j)))
    w = fit_logistic(np.concatenate([new[rows[m]], r]), np.concatenate([cols[m], k + c]), np.concatenate([scale[cols[m]], prior[take][r, c]]), int(take.sum()), k + j, y[take].astype(float), l2=L2)
    w[:k] *= scale
    return w


def _predict(rows: np.ndarray, cols: np.ndarray, prior: np.ndarray, k: int, w: np.ndarray) -> np.ndarray:
    n, j = prior.shape
    return sigmoid(np.bincount(rows, w[cols], n) + prior @ w[k : k + j] + w[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Chain:
    """Fits the chain on at most ``limit`` rows that aren't held out (of the least hashes; the bound holds for rows, also
    where ids repeat). A category ``label_x`` is the label's part in language x, as found among those rows; the last of
    the chain is the label itself. Without labels every probability is next to none."""
    sample = labelled_sample(labels, label, limit, id_col)
    joined = docs.select(id_col, F.col(text_col).alias("_t"), F.coalesce(F.col(lang_col), F.lit("")).alias("_l")).join(F.broadcast(sample), id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([sorted(tokens(t.as_py())) for t in b.column(b.num_columns - 1)], pa.list_(pa.string()))], names=["id", "y", "lang", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    if joined.limit(limit + 1).count() > limit:  # repeated rows of one id can exceed the sample
        joined = joined.orderBy(F.xxhash64(id_col, "_y", "_l", "_t"), id_col, "_t").limit(limit)
    seen = materialize(joined.select(F.col(id_col).alias("id"), F.col("_y").alias("y"), F.col("_l").alias("lang"), "_t").mapInArrow(run, f"id {kind}, y int, lang string, f array<string>"), "toxicity-sample")
    total = seen.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    n, p = max(total.n, 1), max(total.p, 1)
    counts = seen.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("c"), F.sum("y").alias("c1")).where(F.col("c") >= MIN_COUNT)
    toxic, clean = F.col("c1") / F.lit(float(p)), (F.col("c") - F.col("c1")) / F.lit(float(max(n - p, 1)))
    lift = (toxic + F.lit(0.5 / p)) / (clean + F.lit(0.5 / p))
    counts = counts.where(lift >= LIFT)
    gain = (toxic - clean) * F.log(lift)
    chosen = counts.orderBy(gain.desc(), "f").limit(MAX_FEATURES).collect()
    index = {r.f: i for i, r in enumerate(chosen)}
    scale = np.minimum(1.0, np.array([r.c1 for r in chosen], float) / FULL_EVIDENCE)
    data = sorted(seen.select("id", "y", "lang", _hits_udf(seen, index)).collect(), key=lambda r: (r.id, r.y, r.lang, r.hits))
    (chain, weights), prior = fit_chain([(r.id, r.y, r.lang, r.hits) for r in data], len(index), scale, label)
    y = np.array([r.y for r in data], dtype=int)
    if len(data) and 0 < y.sum() < len(y):
        at = decision_point(prior[:, -1], y)
        weights[-1][-1] -= np.log(at / (1 - at))
    return Chain(chain, index, weights)


def fit_chain(data: list[tuple], k: int, scale: np.ndarray, label: str) -> tuple[tuple[tuple[str, ...], list[np.ndarray]], np.ndarray]:
    """((categories, their weights), out-of-fold probabilities by category) from rows (id, label, language, features).

    A category's inputs from earlier categories are out-of-fold predictions, in training rows only."""
    y = np.array([r[1] for r in data], dtype=int)
    lang = np.array([r[2] for r in data], dtype=object)
    rows = np.repeat(np.arange(len(data)), [len(r[3]) for r in data]).astype(np.int64)
    cols = np.array([c for r in data for c in r[3]], dtype=np.int64)
    fold = np.arange(len(data)) % FOLDS
    parts = Counter(lang[y == 1].tolist())
    chain = (*(f"{label}_{p}" for p, _ in sorted(parts.items(), key=lambda x: (-x[1], x[0]))[:MAX_CATEGORIES]), label)
    prior, weights = np.zeros((len(data), 0)), []
    for name in chain:
        target = y if name == label else y * (lang == name.removeprefix(f"{label}_")).astype(int)
        apart = np.zeros(len(data))
        for i in range(FOLDS):
            w = _fit(rows, cols, scale, prior, k, target, fold != i)
            apart[fold == i] = _predict(rows, cols, prior, k, w)[fold == i]
        weights.append(_fit(rows, cols, scale, prior, k, target, np.ones(len(data), bool)))
        prior = np.column_stack([prior, apart])
    return (chain, weights), prior


def decision_point(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that parts out-of-fold rows with the best F1 (midway, in log odds, if a stretch does), at least
    LEAST_POINT and at most one half."""
    order = np.argsort(-p, kind="stable")
    q, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(q) + 1) + y.sum())
    last = int(np.flatnonzero(f1 == f1.max())[-1])
    low = q[last + 1] if last + 1 < len(q) else q[last] / 2
    logit = lambda v: np.log(np.clip(v, 1e-9, 1 - 1e-9) / (1 - np.clip(v, 1e-9, 1 - 1e-9)))
    return float(np.clip(sigmoid((logit(q[last]) + logit(low)) / 2), LEAST_POINT, 0.5))


def _hits_udf(seen: DataFrame, index: dict[str, int]) -> F.Column:
    sent = seen.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("array<int>")
    def hits(f):  # noqa: ANN001, ANN202
        return f.map(lambda x: [sent.value[t] for t in x if t in sent.value])

    return hits("f").alias("hits")


def probability_names(model: Chain, columns: list[str]) -> list[str]:
    """Column names of the probabilities, unlike any of ``columns``."""
    return [free_name(columns, f"__p_{c}") for c in model.names]


def score(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(columns ``keep``, id, a probability per category as ``probability_names`` calls them) of every row, over whole
    texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cols = [*keep, id_col]
    names = probability_names(model, cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = sent.value.index
            p = sent.value.score([[index[t] for t in tokens(x.as_py()) if t in index] for x in b.column(b.num_columns - 1)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(p[:, j]) for j in range(p.shape[1]))], names=[*b.schema.names[:-1], *names])

    schema = T.StructType([*(docs.schema[c] for c in cols), *(T.StructField(c, T.DoubleType()) for c in names)])
    return docs.select(*map(quoted, cols), quoted(text_col).alias(free_name(cols, "__scored_text"))).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, toxic (the chain's last verdict), p_toxic, and categories, a list of (name,
    probability) in the chain's order. The categories are the label's parts by language, not types of toxicity.

    Null and empty texts have no features; repeated rows each come back; an empty table gives none; other columns are
    left out, whatever they are called."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    scored, names = score(docs, model, id_col, text_col), probability_names(model, [id_col])
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.round(quoted(n), 6).alias("probability")) for c, n in zip(model.names, names, strict=True)])
    return scored.select(id_col, (quoted(names[-1]) >= THRESHOLD).alias("toxic"), F.round(quoted(names[-1]), 6).alias("p_toxic"), each.alias("categories"))


def keep_civil(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the chain doesn't call toxic, with their columns, whatever those are called. Null and
    empty texts have no features; repeated rows stay or go together; an empty table gives none."""
    cols = tuple(c for c in docs.columns if c != id_col)
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    scored, last = score(docs, model, id_col, text_col, cols), probability_names(model, [*cols, id_col])[-1]
    return scored.where(quoted(last) < THRESHOLD).select(*map(quoted, docs.columns))
