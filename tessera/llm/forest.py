"""Near-duplicate embeddings by a forest of random-projection trees.

Equal vectors of a label are one class before anything is compared. The trees split recursively along random directions,
each cut near the middle where the fewest points are near; points closer to a cut than a linked pair's usual distance go
to both sides (spill overlap) until a tree has doubled its points, so copies don't grow with the depth. A node whose
points are mostly linked to each other isn't cut any more.

The forest has two tiers. The upper one deals a label's classes to groups of about GROUP_ROWS; it is fitted to a bounded
sample, has a bounded number of nodes and shares one direction per level, so what is broadcast doesn't grow with the
rows. Within a group, in one task, a forest of its own goes down to leaves of LEAF_ROWS, fitted to the group's own rows;
its leaves are compared and their links verified. A group that stays too large is dealt as pairs of blocks. A pair that
shares several groups counts in the first of them only, so neither pairs nor links are ever gathered: a group gives,
per class, how many links it has there, and the least class reached.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lookup_join, materialize

THRESHOLD = 0.93
#: Trees of a group's own forest; the upper tier has two, and one more for every two levels of its depth.
TREES = 6
#: Classes of a leaf, of which all pairs are compared, at most (unless most of its pairs are links).
LEAF_ROWS = 48
#: Classes of a label that a group has on average, and at most before it is dealt as pairs of blocks.
GROUP_ROWS, BLOCK_ROWS = 6_000, 4_096
#: Levels of the upper tier, at most.
MAX_DEPTH = 12
#: Half the width of the overlap, in units of a linked pair's distance along a random direction.
SPILL = 0.5
#: Points of a tree with their copies, as a multiple of the points, at most.
GROWTH = 2.0
#: A node isn't cut if at least this share of sampled pairs in it are links.
DENSE, DENSE_SAMPLE = 0.1, 48
#: The upper tier is fitted to at most so many vectors (of the least hashes), and so many numbers.
SAMPLE, SAMPLE_VALUES = 20_000, 2_000_000
#: Numbers of routed copies that a Python worker holds at once.
ROUTED_VALUES = 8_000_000
#: Cosines of different summation orders may differ in the last digits; links are decided by one fixed expression.
CANDIDATE_SLACK = 1e-6


def reach(width: int, threshold: float) -> float:
    """Distance of a just linked pair of unit vectors along a random direction (one standard deviation)."""
    return float(np.sqrt(2 - 2 * min(threshold, 1.0)) / np.sqrt(width))


def is_dense(points: np.ndarray, threshold: float) -> bool:
    if len(points) < 2:
        return True
    few = points[np.linspace(0, len(points) - 1, min(len(points), DENSE_SAMPLE)).astype(int)]
    n = len(few)
    return ((few @ few.T >= threshold).sum() - n) / (n * (n - 1)) >= DENSE


def choose_cut(proj: np.ndarray, half: float, room: float) -> tuple[float, float, float]:
    """(cut, half width, room left): the emptiest place between the 35 and 65 % points, nearest to the median of those.
    ``room`` is how many times its points the node may still grow to; an overlap beyond that is left out."""
    line = np.sort(proj)
    tries = np.quantile(line, np.linspace(0.35, 0.65, 13))
    near = np.searchsorted(line, tries + half, "right") - np.searchsorted(line, tries - half, "left")
    at = int(np.lexsort((np.abs(np.arange(13) - 6), near))[0])
    growth = 1 + near[at] / len(line)
    return (float(tries[at]), half, room / growth) if growth <= room else (float(tries[at]), 0.0, room)


@dataclass
class Tree:
    """An upper tree: one direction per level, nodes in preorder with cut, half width and children (a leaf if negative,
    numbered from -1 down)."""

    directions: np.ndarray
    cuts: list[tuple[float, float]] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0

    def grow(self, points: np.ndarray, half: float, threshold: float, room: float = GROWTH, level: int = 0) -> int:
        """Adds a node for the sample's ``points`` and returns its number; points too few to cut give a leaf."""
        if level == len(self.directions) or len(points) < 4 or is_dense(points, threshold):
            self.leaves += 1
            return -self.leaves
        proj = points @ self.directions[level]
        cut, half_here, room = choose_cut(proj, half, room)
        me = len(self.cuts)
        self.cuts.append((cut, half_here))
        self.children.append([0, 0])
        self.children[me] = [self.grow(points[proj <= cut + half_here], half, threshold, room, level + 1), self.grow(points[proj > cut - half_here], half, threshold, room, level + 1)]
        return me

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each point reaches."""
        proj = points @ self.directions.T
        rows, leaves = [], []
        todo = [(0 if self.cuts else -1, np.arange(len(points)), 0)]
        while todo:
            node, idx, level = todo.pop()
            if node < 0:
                rows.append(idx)
                leaves.append(np.full(len(idx), -node))
                continue
            cut, half = self.cuts[node]
            at = proj[idx, level]
            todo += [(self.children[node][0], idx[at <= cut + half], level + 1), (self.children[node][1], idx[at > cut - half], level + 1)]
        return np.concatenate(rows), np.concatenate(leaves)


def leaves_of(points: np.ndarray, threshold: float, rng: np.random.Generator, leaf_rows: int = LEAF_ROWS) -> list[np.ndarray]:
    """A tree of a group's own: the rows of each leaf, none larger than ``leaf_rows`` unless dense or of no extent."""
    half, out = SPILL * reach(points.shape[1], threshold), []
    todo = [(np.arange(len(points)), GROWTH)]
    while todo:
        idx, room = todo.pop()
        if len(idx) <= leaf_rows or is_dense(points[idx], threshold):
            out.append(idx)
            continue
        u = rng.standard_normal(points.shape[1])
        proj = points[idx] @ (u / np.linalg.norm(u))
        cut, half_here, left = choose_cut(proj, half, room)
        low, high = idx[proj <= cut + half_here], idx[proj > cut - half_here]
        if min(len(low), len(high)) == 0 or max(len(low), len(high)) == len(idx):
            low, high, left = idx[proj <= cut], idx[proj > cut], room
        if min(len(low), len(high)) == 0:
            out.append(idx)
            continue
        todo += [(low, left), (high, left)]
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    if not len(v):
        return v
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def decoded(column: pd.Series, size: int) -> np.ndarray:
    """Vectors from their bytes; single or double precision shows in the length."""
    if (column.str.len() == 4 * size).all():
        return np.frombuffer(b"".join(column), "<f4").reshape(-1, size).astype(float)
    return np.array([np.frombuffer(b, "<f4" if len(b) == 4 * size else "<f8").astype(float) for b in column]).reshape(-1, size)


def keyed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, key, label, size, v) of every row: v in bytes, key a digest of label and v; null for rows that can't link
    (no id or label; a vector that is null, empty, zero, or holds null or what isn't finite)."""
    kind = vectors.schema[id_col].dataType.simpleString()
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"), F.col(label_col).cast("string").alias("label"))
    rows = rows.select("id", "label", F.when(sound, F.col("v")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [None if x is None else np.array(x, "<f8") for x in b.column(2).to_pylist()]
            short = [None if x is None else x.astype("<f4") for x in raw]
            sent = [None if x is None else (s if (s == x).all() else x).tobytes() for x, s in zip(raw, short, strict=True)]  # floats travel as floats, exactly
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([None if x is None else len(x) for x in raw], pa.int32()), pa.array(sent, pa.binary())], names=["id", "label", "size", "v"])

    sent = rows.mapInArrow(run, f"id {kind}, label string, size int, v binary")
    return sent.withColumn("key", F.when(F.col("v").isNotNull(), F.unhex(F.sha2(F.concat(F.encode(F.concat_ws("|", "size", "label"), "UTF-8"), F.lit(b"\0"), "v"), 256))))


def classes(rows: DataFrame) -> DataFrame:
    """(key, least, weight, label, size, v): equal vectors of a label once, with their ids' least and number."""
    sound = rows.where("key is not null")
    ids = sound.select("key", "id").distinct().groupBy("key").agg(F.count("*").alias("weight"), F.min("id").alias("least"))
    first = sound.groupBy("key").agg(F.any_value("label").alias("label"), F.any_value("size").alias("size"), F.any_value("v").alias("v"))
    return ids.join(first, "key")


def build(rows: DataFrame, threshold: float = THRESHOLD, group_rows: int = GROUP_ROWS, seed: int = 7) -> dict[int, list[Tree]]:
    """Upper trees for each length of vectors, deep enough for the largest label; no tree has more than 2**MAX_DEPTH
    leaves. A label that fits a group needs none."""
    per = rows.groupBy("label", "size").agg(F.count("*").alias("n"))
    top = per.agg(F.max("n").alias("n"), F.max("size").alias("width")).first()
    if not top.n or top.n <= group_rows:
        return {}
    depth = int(min(MAX_DEPTH, np.ceil(np.log2(top.n / group_rows))))
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(max(500, min(SAMPLE, SAMPLE_VALUES // top.width))).select("size", "v").toPandas()
    out: dict[int, list[Tree]] = {}
    for size, part in sorted(sample.groupby("size")):
        points, rng = _unit(decoded(part["v"], size)), np.random.default_rng([seed, size])
        out[int(size)] = []
        for _ in range(2 + (depth + 1) // 2):
            u = rng.standard_normal((depth, size))
            tree = Tree(u / np.linalg.norm(u, axis=1, keepdims=True))
            tree.grow(points, SPILL * reach(size, threshold), threshold)
            out[int(size)].append(tree)
    return out


def routed(rows: DataFrame, forest: dict[int, list[Tree]]) -> DataFrame:
    """(g, leaf, key, weight, size, v, leaves) of every class and upper leaf; ``g`` names the label's group there,
    ``leaves`` lists all of a class's leaves in order."""
    base = rows.select("key", "weight", "label", "size", "v")
    name = F.concat_ws("/", F.col("leaf").cast("string"), F.col("size").cast("string"), "label")
    if not forest:
        return base.withColumn("leaf", F.lit(1).cast("bigint")).select(name.alias("g"), "leaf", "key", "weight", "size", "v", F.lit(None).cast("binary").alias("leaves"))
    sent = rows.sparkSession.sparkContext.broadcast(forest)

    def part(b: pa.RecordBatch, take: np.ndarray, size: int, trees: list[Tree]) -> pa.RecordBatch:
        points = _unit(decoded(pd.Series(b.column(4).take(pa.array(take)).to_pylist()), size))
        parts = [t.route(points) for t in trees] or [(np.arange(len(take)), np.ones(len(take), np.int64))]
        who = np.concatenate([r for r, _ in parts])
        leaf = np.concatenate([np.int64(k << 32) + lf for k, (_, lf) in enumerate(parts)])
        order = np.lexsort((leaf, who))
        who, leaf = who[order], leaf[order]
        starts = np.searchsorted(who, np.arange(len(take) + 1))
        own = [leaf[a:z].astype("<i8").tobytes() for a, z in zip(starts, starts[1:], strict=False)]
        at = pa.array(take[who])
        return pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), pa.array(leaf, pa.int64()), pa.array([own[i] for i in who], pa.binary())], names=[*b.schema.names, "leaf", "leaves"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array(b.column(3).to_pylist(), dtype=np.int64)
            for size in np.unique(sizes):
                trees = sent.value.get(int(size), [])
                same = np.flatnonzero(sizes == size)
                step = max(16, ROUTED_VALUES // (int(size) * max(1, len(trees))))
                for lo in range(0, len(same), step):
                    yield part(b, same[lo : lo + step], int(size), trees)

    out = base.mapInArrow(run, "key binary, weight bigint, label string, size int, v binary, leaf bigint, leaves binary")
    return out.select(name.alias("g"), "leaf", "key", "weight", "size", "v", "leaves")


def linked(x: np.ndarray, split: int, threshold: float, seed: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, int]:
    """(links, pairs compared): a symmetric table of the links that a forest of the group's own finds. With ``split``,
    only pairs of a row before and a row from it on are compared."""
    rng, found, compared = np.random.default_rng(seed), np.zeros((len(x), len(x)), bool), 0
    known = np.zeros_like(found)  # pairs of large leaves, which aren't compared again
    few = len(x) <= max(leaf_rows, trees * leaf_rows * GROWTH)  # all pairs are fewer than those of the trees' leaves
    for _ in range(1 if few else trees):
        for idx in [np.arange(len(x))] if few else leaves_of(x, threshold, rng, leaf_rows):
            idx.sort()
            compared += compare_leaf(x, idx, split, threshold, found, known if len(idx) > leaf_rows else None)
    found |= found.T
    np.fill_diagonal(found, False)
    return found, compared


def compare_leaf(x: np.ndarray, idx: np.ndarray, split: int, threshold: float, found: np.ndarray, known: np.ndarray | None = None) -> int:
    """Compares all pairs of a leaf's rows and adds its links to ``found``; rows whose pairs are all ``known`` are left
    out. Gives the number of pairs compared."""
    compared, (a, b) = 0, (idx[idx < split], idx[idx >= split]) if split else (idx, idx)
    if known is not None:
        a = a[~known[np.ix_(a, b)].all(1)]
        known[np.ix_(a, b)] = True
    step = max(1, 4_000_000 // max(1, len(b)))
    for lo in range(0, len(a), step):
        rows = a[lo : lo + step]
        cos = x[rows] @ x[b].T
        near = cos >= threshold
        for i, j in np.argwhere(np.abs(cos - threshold) <= CANDIDATE_SLACK):
            near[i, j] = np.einsum("i,i->", x[rows[i]], x[b[j]]) >= threshold
        found[np.ix_(rows, b)] |= near
        compared += near.size if split else near.size // 2
    return compared


def roots(found: np.ndarray) -> np.ndarray:
    """The least row that links reach from each row."""
    root = np.arange(len(found))
    open_rows = found.any(1)
    for start in np.flatnonzero(open_rows):
        if not open_rows[start]:
            continue
        front = np.array([start])
        open_rows[start] = False
        while len(front):
            front = np.flatnonzero(found[front].any(0) & open_rows)
            open_rows[front] = False
            root[front] = start
    return root


def compare(pdf: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """Links within one group (or between two of its blocks): per class its links to classes that share no earlier group
    with it, by their weights, and the least class that links reach here; so a group's rows grow with its classes and
    not with its links.

    The forest of one group may find a link that another's has missed. So pairs that share a later group too are all
    compared here, in the first group that they share: whatever any group finds is counted, and counted once."""
    pdf = pdf.sort_values(["side", "key"], kind="stable")
    size, leaf = int(pdf["size"].iloc[0]), int(pdf["leaf"].iloc[0])
    split = int((pdf["side"] == 1).sum())
    if split in (0, len(pdf)) and pdf["side"].iloc[0] != 0:
        return pd.DataFrame({"key": [], "links": [], "low": []})
    x = _unit(decoded(pdf["v"], size))
    found, _ = linked(x, split, threshold, seed=leaf)
    if pdf["leaves"].iloc[0] is not None:
        lists = [np.frombuffer(b, "<i8") for b in pdf["leaves"]]
        flat, who = np.concatenate(lists), np.repeat(np.arange(len(x)), [len(k) for k in lists])
        known = np.zeros_like(found)
        for later in np.unique(flat[flat > leaf]):
            compare_leaf(x, who[flat == later], split, threshold, found, known)
        found |= found.T
        np.fill_diagonal(found, False)
    got = np.flatnonzero(found.any(1))
    if not len(got):
        return pd.DataFrame({"key": [], "links": [], "low": []})
    keys = pdf["key"].to_numpy()[got]
    found = found[np.ix_(got, got)]
    order = np.argsort(keys, kind="stable")
    root = roots(found[np.ix_(order, order)])
    low = np.empty(len(got), object)
    low[order] = keys[order][root]
    new = found
    if pdf["leaves"].iloc[0] is not None:
        place = np.full(len(x), -1)
        place[got] = np.arange(len(got))
        new = found.copy()
        for other in np.unique(flat[flat < leaf]):
            same = place[who[flat == other]]
            same = same[same >= 0]
            new[np.ix_(same, same)] = False
    weight = pdf["weight"].to_numpy(np.int64)[got]
    links = np.concatenate([new[lo : lo + 512] @ weight for lo in range(0, len(got), 512)])
    return pd.DataFrame({"key": keys, "links": links, "low": low})


def group_links(groups: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, links, low) from every group; groups over two blocks' rows are dealt as pairs of blocks."""
    counts = groups.groupBy("g").count().where(F.col("count") > 2 * block_rows).select("g", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks"))
    big = lookup_join(groups, counts, "g").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = big.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    side = F.when(F.col("p") == F.col("q"), 0).when(F.col("block") == F.col("p"), 1).otherwise(2)
    return dealt.withColumn("side", side).drop("block", "other", "blocks").groupBy("g", "p", "q").applyInPandas(lambda pdf: compare(pdf, threshold), "key binary, links bigint, low binary")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, group_rows: int = GROUP_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id (least id reachable), kept (id = component_id).

    Rows with a null label, null id, or a vector that is null, empty, zero or not finite link with nothing and are
    components of their own. Rows alike in id, label and vector are one vector: none counts as another's link, and each
    comes back with the same result; rows of one id with different vectors are different vectors. An empty table gives
    none; other columns are left out, whatever they are called."""
    rows = materialize(keyed(vectors, id_col, vector_col, label_col), "forest-rows")
    each = materialize(classes(rows), "forest-classes")
    forest = build(each, threshold, group_rows)
    groups = routed(each, forest)
    groups = materialize(groups, "forest-groups") if forest else groups
    found = materialize(group_links(groups, threshold, block_rows), "forest-links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("key").alias("src"), F.col("low").alias("dst"))).withColumnRenamed("node", "key")
    own = materialize(each.select("key", "least", "weight").join(links, "key", "left").join(comp, "key", "left").withColumn("component", F.coalesce("component", "key")), "forest-components")
    names = own.groupBy("component").agg(F.min("least").alias("component_id"))
    result = lookup_join(own, names, "component", "inner").select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = lookup_join(rows.select("id", "key"), result, "key")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"))


ORACLE_SQL = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
p as (select a.vec_id as i, b.vec_id as j from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93),
r(i, j) as (select i, j from p union select r.i, p.j from r join p on r.j = p.i),
c as (select i, least(i, min(j)) as c from r group by i),
n as (select i, count(*) as n from p group by i)
select vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(c.c, vec_id)::bigint as component_id, coalesce(c.c, vec_id) = vec_id as kept
from embeddings left join n on n.i = vec_id left join c on c.i = vec_id
"""
