"""Near-duplicate documents by 64-bit SimHash and anchor-point covering.

Fingerprints that differ in at most 3 bits agree up to 1 bit in at least one 32-bit half. Within each half the first 31
bits are covered by the perfect (31, 26) code, whose covering radius is 1: the anchors are its codewords. A fingerprint
stays at home with the one anchor within 1 and is replicated to every anchor within 1 + 1 = 2 of it (15 more, or none
when it is an anchor itself). Of two fingerprints that differ in at most 1 bit of a half, each is a replica at the
other's home, so comparing home rows with replicas anchor by anchor finds every link. Exact copies are one fingerprint
before any comparison. There are 2 * 2**26 anchors; with n fingerprints an anchor has n / 2**26 homes and 16 times as
many replicas, so pairs compared grow as n * n / 2**23. Beyond CROWDED fingerprints anchors are split further: the other
half differs in at most 3 bits, so one of its four bytes is equal; rows go to each (anchor, byte), four copies for a
64th of the comparisons.

``keep_representatives`` is the operator for whole texts: runs of five words, similarity 0.8. There linked texts differ
in about ten of 64 bits, which no anchors can cover; min-hash bands beside the anchors give the other candidates, and
all are checked by their exact Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SENT_KEYS, connected_components, free_name, lookup_join, materialize, quoted, scratch
from .shingles import SIMILARITY, WIDTH, band_keys, components, name_of, shingles

SEED = 42
BLOCK = 1 << 15
#: Fingerprints from which anchors are split by a byte of the other half: 64 homes at an anchor.
CROWDED = 1 << 32


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of a whole text; zero for a text without words (null and empty ones too)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    ends = ends[min(width, len(words)) - 1 :]
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        pairs = zip(starts[at : min(at + BLOCK, n)].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        raw = b"".join([digest(joined[a:b], SEED) for a, b in pairs])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) with fp as a signed 64-bit integer of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp bigint")


def _half(fp: Column, which: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if which == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _syndrome(word: Column) -> Column:
    """Position (1 to 31) of the bit that leads to the nearest codeword; 0 for a codeword."""
    masks = [sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1) for j in range(5)]
    parts = [(F.bit_count(word.bitwiseAND(F.lit(m))) % 2) * (1 << j) for j, m in enumerate(masks)]
    return sum(parts[1:], parts[0]).cast("int")


def _flip(word: Column, position: Column) -> Column:
    return F.when(position > 0, word.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), position - 1))).otherwise(word)


def anchors(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Homes and replicas, (anchor, fp) each, of distinct fingerprints; anchor holds the half in its top bit."""
    homes, replicas = [], []
    for which in (0, 1):
        own = fps.select("fp", _half(F.col("fp"), which).bitwiseAND(F.lit(0x7FFFFFFF)).alias("w")).withColumn("s", _syndrome(F.col("w")))
        tag = F.lit(which << 31).cast("bigint")
        near = _flip(F.col("w"), F.col("s"))
        homes.append(own.select(near.bitwiseOR(tag).alias("anchor"), "fp"))
        far = F.transform(
            F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: (F.col("s") > 0) & (i.bitwiseXOR(F.col("s")) > i)),
            lambda i: _flip(_flip(F.col("w"), i), i.bitwiseXOR(F.col("s"))),
        )
        both = F.concat(F.array(near), far)
        replicas.append(own.select(F.explode(both).alias("a"), "fp").select(F.col("a").bitwiseOR(tag).alias("anchor"), "fp"))
    return homes[0].union(homes[1]), replicas[0].union(replicas[1])


def links(fps: DataFrame, distance: int = 3, crowded: bool = False) -> DataFrame:
    """(src, dst), src < dst, for every two distinct fingerprints within ``distance`` (at most 3) bits; each once.
    ``crowded`` splits anchors by a byte of the other half; the links are the same."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves with one bit of slack each cover distances up to 3")
    homes, replicas = anchors(fps)
    x = F.col("src").bitwiseXOR(F.col("dst"))
    left = F.col("anchor") < F.lit(1 << 31)
    first = F.bit_count(_half(x, 0).bitwiseAND(F.lit(0x7FFFFFFF)))
    # a pair is taken from the first half if that agrees up to 1 bit, else from the second, so from one of them only
    once = (F.bit_count(x) <= distance) & (left == (first <= 1))
    on = ["anchor"]
    if crowded:
        other = lambda v: F.when(left, _half(v, 1)).otherwise(_half(v, 0))
        at = lambda v, i: F.shiftright(v, 8 * i).bitwiseAND(F.lit(0xFF))
        byte = F.posexplode(F.array(*[at(other(F.col("fp")), i) for i in range(4)])).alias("place", "byte")
        homes, replicas = homes.select("anchor", "fp", byte), replicas.select("anchor", "fp", byte)
        equal = F.coalesce(*[F.when(at(other(x), i) == 0, F.lit(i)) for i in range(4)])
        once, on = once & (F.col("place") == equal), ["anchor", "place", "byte"]
    pairs = homes.withColumnRenamed("fp", "src").join(replicas.withColumnRenamed("fp", "dst"), on).where("src < dst")
    return pairs.where(once).select("src", "dst")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id, the least id reachable by links.

    Null and empty texts have fingerprint zero and link like any other; rows with a null id link too but never name a
    component unless all its ids are null. Repeated rows each come back. An empty table gives none; other columns are
    left out, whatever they are called."""
    rows = materialize(with_fingerprints(docs, id_col, text_col), "simhash")
    least = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    comp = connected_components(links(least.select("fp"), distance, least.count() > CROWDED)).select(F.col("node").alias("fp"), "component")
    own = materialize(least.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "simhash-components")
    names = own.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = lookup_join(own, names, "component", "inner").select("fp", "component_id")
    out = lookup_join(rows, ids, "fp", "inner")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed integer; zero for an empty set."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        counts += np.unpackbits(hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """``docs`` with one document of each group that links of at least ``similarity`` join: the one with the least id
    and, of rows with that id, the least digest of its text. Texts without words, null ones too, are alike.

    Of rows alike in id and text one stays, the same in every run. Rows with a null id have nothing to be named by and
    pass through unchanged. An empty table gives none. All columns come back, whatever they are called; texts are
    shuffled by id and again by name only above what ``lookup_join`` sends to all tasks."""
    tag, copies, place = (free_name(docs.columns, n) for n in ("_tag", "_copies", "_place"))
    named = docs.where(quoted(id_col).isNotNull()).withColumn(tag, F.struct(quoted(id_col).alias("id"), F.md5(F.coalesce(quoted(text_col), F.lit(""))).alias("digest")))
    plain = named.select(F.col(f"{tag}.id").alias("id"), F.col(f"{tag}.digest").alias("digest"), quoted(text_col).alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), width) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(map(name_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(set_fingerprint, sets), pa.int64()), pa.array(map(band_keys, sets), pa.list_(pa.int64()))],
                names=["id", "digest", "name", "n", "fp", "keys"],
            )

    with scratch(docs.sparkSession):
        rows = materialize(plain.mapInArrow(marks, f"id {kind}, digest string, name bigint, n bigint, fp bigint, keys array<bigint>"), "shingles")
        first = rows.groupBy("name").agg(F.min(F.struct("id", "digest")).alias("least"))
        marked = materialize(rows.dropDuplicates(["name"]).select("name", "n", "fp", "keys").join(first, "name"), "shingles-marked")
        fps = marked.select("fp").distinct()
        near = links(fps, crowded=marked.count() > CROWDED).withColumn("key", F.xxhash64("src", "dst"))
        near = near.select("key", F.explode(F.array("src", "dst")).alias("fp")).join(marked.select("fp", "name", "n"), "fp").select("key", "name", "n")
        spread = marked.select(F.explode(F.concat("keys", F.array(F.xxhash64("fp")))).alias("key"), "name", "n").union(near)
        comp = components(plain.select("id", "t"), marked, spread, similarity, width).withColumnRenamed("node", "name")
        found = marked.select("name", "least").join(comp, "name", "left").groupBy(F.coalesce("component", "name").alias("component")).agg(F.min("least").alias(tag))
        found = materialize(found.join(rows.groupBy(F.struct("id", "digest").alias(tag)).agg(F.count("*").alias(copies)), tag), "shingles-kept")
        kept = lookup_join(named, found, tag, "inner", limit=SENT_KEYS, counted=rows.select(F.struct("id", "digest").alias(tag)))
    if not found.where(F.col(copies) > 1).isEmpty():
        order = Window.partitionBy(tag).orderBy(F.xxhash64(*map(quoted, docs.columns)))
        kept = kept.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return kept.select(*map(quoted, docs.columns)).unionByName(docs.where(quoted(id_col).isNull()))
