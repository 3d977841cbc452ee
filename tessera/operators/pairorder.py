"""How many pairs of a group two columns order alike, without making pairs.

Equal (truth, prediction) rows are one row with a number. Pairs that differ in truth, and those of them that tie in
prediction, are counted from sums of squares. What is left are concordant pairs. A small group is counted in one task, by
going through the bits of the predictions' ranks. A large one is cut into BLOCKS blocks by truth and as many by
prediction, at equal numbers of rows; a value with more rows than a block is a block of its own. A pair lies in one block
of truth, or in one block of prediction and two of truth, or in two of each; the first two are counted block by block, the
last from the table of block pairs, which has at most (2 * BLOCKS) ** 2 rows, whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import store

from .order import _null_safe, running_totals

BLOCKS = 512
#: Distinct rows of a group that are counted in one task.
GROUP_ROWS = 1_000_000


def concordant(truth: np.ndarray, pred: np.ndarray, n: np.ndarray) -> int:
    """Pairs of rows, each counted n times, that differ in both columns and are ordered alike by both."""
    t, p = (np.unique(v, return_inverse=True)[1].ravel() for v in (truth, pred))
    at = np.argsort(t, kind="stable")
    t, p, w, total = t[at], p[at], n.astype(np.int64)[at], 0
    for bit in range(int(p.max(initial=0)).bit_length() - 1, -1, -1):
        # rows of equal higher bits stand together, in the order of truth; a pair's order is decided at the first bit that differs
        at = np.argsort(p >> (bit + 1), kind="stable")
        t, p, w = t[at], p[at], w[at]
        node, one = p >> (bit + 1), (p >> bit & 1).astype(bool)
        zeros = np.concatenate(([0], np.cumsum(np.where(one, 0, w))))
        new_node = np.append(True, node[1:] != node[:-1])
        new_run = new_node | np.append(True, t[1:] != t[:-1])
        start = lambda new: np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
        before = zeros[start(new_run)] - zeros[start(new_node)]
        total += int((w * before)[one].sum())
        t, p, w = (v[np.lexsort((t, node))] for v in (t, p, w))
    return total


def _counted(keys: list[str], t: str, p: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[keys].head(1).assign(c=concordant(rows[t].to_numpy(), rows[p].to_numpy(), rows["n"].to_numpy()))

    return run


def pair_order_accuracy(df: DataFrame, truth: str, pred: str, *group: str, group_rows: int = GROUP_ROWS, blocks: int = BLOCKS) -> DataFrame:
    """(group, n_pairs, accuracy): share of truth-ordered pairs that predictions order alike; predicted ties are half.

    Rows with a null in either column are left out; groups without two different truths have no row. Null groups are a
    group."""
    g = list(group)
    ok = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).select(*g, F.col(truth).alias("_t"), F.col(pred).alias("_p"))
    counts = store(ok.groupBy(*g, "_t", "_p").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    kind = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in g) + ", c bigint"
    per = {v: counts.groupBy(*g, v).agg(F.sum("n").alias("n")) for v in ("_t", "_p")}
    square = lambda d, name: d.groupBy(*g).agg(F.sum(F.col("n") * F.col("n")).alias(name))
    sums = counts.groupBy(*g).agg(F.sum("n").alias("all"), F.count("*").alias("distinct"), F.sum(F.col("n") * F.col("n")).alias("s"))
    sums = store(_null_safe(_null_safe(sums, square(per["_t"], "st"), g), square(per["_p"], "sp"), g), "pair-sums")
    most = sums.agg(F.max("distinct").alias("n")).first().n or 0
    if most <= group_rows:
        found = counts.groupBy(*g).applyInPandas(_counted(g, "_t", "_p"), kind)
    else:
        placed = counts
        for v, name in (("_t", "_tb"), ("_p", "_pb")):
            rows = _null_safe(running_totals(per[v], [v], "n", *g), sums.select(*g, "all"), g)
            hot = F.col("n") * blocks > F.col("all")
            block = 2 * F.floor(F.col("before") * blocks / F.col("all")) + hot.cast("int")
            placed = _null_safe(placed, rows.select(*g, v, block.cast("bigint").alias(name)), [*g, v])
        placed = store(placed, "pair-blocks")
        one = placed.where("_tb % 2 = 0").groupBy(*g, "_tb").applyInPandas(_counted(g, "_t", "_p"), kind)
        two = placed.where("_pb % 2 = 0").groupBy(*g, "_pb").applyInPandas(_counted(g, "_tb", "_p"), kind)
        cells = placed.groupBy(*g, "_tb", "_pb").agg(F.sum("n").alias("n"))
        found = one.union(two).union(cells.groupBy(*g).applyInPandas(_counted(g, "_tb", "_pb"), kind))
    right = found.groupBy(*g).agg(F.sum("c").alias("c"))
    n_pairs, tied = (F.col("all") * F.col("all") - F.col("st")) / 2, (F.col("sp") - F.col("s")) / 2
    return _null_safe(sums, right, g).where(n_pairs > 0).select(*g, n_pairs.cast("bigint").alias("n_pairs"), ((F.col("c") + 0.5 * tied) / n_pairs).alias("accuracy"))
