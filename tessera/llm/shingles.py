"""Sets of word shingles: their names, min-hash bands, and the exact comparison of candidates for near-duplicates.

Texts that agree in all ROWS min-hashes of one of BANDS bands share a bucket. A pair of similarity 0.8 shares none with
probability (1 - 0.8**5)**24 = 7e-5, a likelier pair more seldom. Within a bucket the similarity is computed exactly,
from whole sets of shingles, until each text is linked to every group that holds one like it; texts of one group aren't
compared further, so copies of one text cost one comparison each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENT_KEYS, connected_components, lookup_join, materialize

SEED = 42
WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
BLOCK = 1024
#: Sets, and shingles in all, of a block of a bucket; sets that are in each of its blocks.
BLOCK_SETS, BLOCK_HASHES, PIVOTS = 512, 4_000_000, 8
_MULTIPLY, _ADD = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
_MULTIPLY |= np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's runs of words; a shorter text is one run, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ends = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: len(ends)].tolist(), ends.tolist(), strict=True)])
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key per band; none for an empty set."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(low, (hashes[None, at : at + BLOCK] * _MULTIPLY + _ADD).min(1), out=low)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(low.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def name_of(hashes: np.ndarray) -> int:
    """A set's own key; zero for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)) if len(hashes) else 0


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sorted sets reach the similarity, exactly."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-6:
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) >= similarity


def _link(names: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join exactly the sets that chains of similar ones join."""
    groups: list[list[int]] = []
    out = []
    for i, s in enumerate(sets):
        met, rest = [i], []
        for g in groups:
            j = next((j for j in g if similar(s, sets[j], similarity)), None)
            if j is None:
                rest.append(g)
            else:
                out.append((names[j], names[i]))
                met = g + met if len(g) >= len(met) else met + g
        groups = [*rest, met]
    return out


def _cross(left: list[tuple[int, int, np.ndarray]], right: list[tuple[int, int, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """Links between (name, component, set) of ``left`` and ``right`` that join components not joined yet."""
    lead: dict[int, int] = {}

    def top(c: int) -> int:
        while lead.get(c, c) != c:
            c = lead[c]
        return c

    out = []
    for a, ca, x in left:
        for b, cb, y in right:
            if top(ca) != top(cb) and similar(x, y, similarity):
                out.append((a, b))
                lead[top(ca)] = top(cb)
    return out


def buckets_of(spread: DataFrame) -> DataFrame:
    """(bucket, name, blocks, block, pivot) from (key, name, n shingles), of the keys that bring two sets or
    more together. Keys that bring the same sets together are one bucket, told by its count and two sums of its names'
    hashes; one that lies within another goes. A bucket of more than BLOCK_SETS sets, or BLOCK_HASHES shingles, is dealt
    to blocks; about PIVOTS of its sets are in every block."""
    keys = spread.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("hashes"), F.sum(F.xxhash64("name").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "name")).alias("x")).where("size > 1")
    kept = keys.groupBy("size", "hashes", "s", "x").agg(F.min("key").alias("key")).select("key", "size", F.greatest(F.ceil(F.col("size") / BLOCK_SETS), F.ceil(F.col("hashes") / BLOCK_HASHES)).cast("int").alias("blocks"))
    rows = materialize(lookup_join(spread.select("key", "name"), materialize(kept, "shingles-keys"), "key", "inner"), "shingles-members")
    # a bucket goes if one and the same larger one is the largest of all its members: that holds all of it
    top = rows.groupBy("name").agg(F.max(F.struct("size", "key")).alias("top"))
    outer = rows.join(top, "name").groupBy("key").agg(F.min("top").alias("a"), F.max("top").alias("b")).where((F.col("a") != F.col("b")) | (F.col("a.key") == F.col("key")))
    rows = lookup_join(rows, materialize(outer.select("key"), "shingles-outer"), "key", "inner")
    block, pivot = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"), (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit(2), "name"), F.col("size")) < PIVOTS)
    return rows.select(F.col("key").alias("bucket"), "name", "blocks", block.alias("block"), pivot.alias("pivot"))


def components(docs: DataFrame, marked: DataFrame, spread: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """(node, component) of sets that links of at least ``similarity`` join, from ``docs`` (id, t), ``marked`` (name,
    number n of shingles, least id) and ``spread`` (key, name, n), which says what is compared.

    A bucket's blocks are joined within themselves first; pivots join the blocks of a group of near copies. What is then
    still apart from its bucket's largest component is compared with all the bucket, block by block, so no task holds
    more than two blocks and no link is lost."""
    buckets = materialize(buckets_of(spread), "shingles-buckets")
    wanted = materialize(marked.select("name", "least.id").join(buckets.select("name").distinct(), "name", "left_semi").select("id").distinct(), "shingles-wanted")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), width) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(map(name_of, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["name", "hashes"])

    sets = lookup_join(docs, wanted, "id", "left_semi", limit=SENT_KEYS, counted=docs.select("id")).select("t").mapInArrow(hashed, "name bigint, hashes binary")
    sets = materialize(sets.dropDuplicates(["name"]), "shingles-sets")

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("name")
        return pd.DataFrame(_link(rows["name"].tolist(), [np.frombuffer(h, np.uint64) for h in rows["hashes"]], similarity), columns=["src", "dst"]).astype("int64")

    dealt = buckets.select("bucket", "name", F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))).alias("block"))
    near = materialize(dealt.join(sets, "name").groupBy("bucket", "block").applyInPandas(within, "src bigint, dst bigint"), "shingles-links")
    comp = connected_components(near)
    large = buckets.where("blocks > 1").select("bucket", "name", "blocks", "block")
    if large.isEmpty():
        return comp
    placed = materialize(large.join(comp.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name")), "shingles-placed")
    main = placed.groupBy("bucket", "component").count().groupBy("bucket").agg(F.max(F.struct("count", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1").select("bucket", "main")
    apart = materialize(lookup_join(placed, main, "bucket", "inner"), "shingles-apart")
    lone = apart.where("component <> main")
    if lone.isEmpty():
        return comp
    blocks = lone.select("bucket", F.col("block").alias("lb")).distinct()
    left = lone.select("bucket", "name", "component", F.col("block").alias("lb"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("rb"), F.lit(0).alias("side"))
    right = apart.join(blocks, "bucket").select("bucket", "name", "component", "lb", F.col("block").alias("rb"), F.lit(1).alias("side"))

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("name")
        one, two = ([(n, c, np.frombuffer(h, np.uint64)) for n, c, h, s in zip(rows["name"].tolist(), rows["component"].tolist(), rows["hashes"], rows["side"], strict=True) if s == k] for k in (0, 1))
        return pd.DataFrame(_cross(one, two, similarity), columns=["src", "dst"]).astype("int64")

    more = left.union(right).join(sets, "name").groupBy("bucket", "lb", "rb").applyInPandas(across, "src bigint, dst bigint")
    return connected_components(materialize(near.union(more), "shingles-all-links"))
