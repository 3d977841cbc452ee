"""Fingerprints of documents from improbable features.

A text's bytes are read in windows of WINDOW bytes, one ending at each byte (before the text stand zero bytes). A window's
entropy falls into one of BINS classes; how many windows of the whole corpus each class has says how improbable its
windows are. Of every ``span`` neighbouring windows the most improbable one is a feature (equal classes: the least hash).
Windows of little entropy are features only in the shortest texts and in those that have no others. Short texts have a shorter span: what a longer
span selects, a shorter one selects too, so texts on either side of a limit still compare.

A text's distinct features, in their order, go into a chain of Bloom filters of FILTER bits, CAPACITY features each. The
likeness of two fingerprints is the mean over the filters of the one with fewer bits, weighted by their bits, of the
largest overlap with a filter of the other: the bits in common beyond those expected by chance, divided by the most that
could be; nothing where chance may explain them.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted

WINDOW, BINS = 32, 1000
#: Classes below this one are windows of little entropy.
WEAK = 350
#: (up to so many bytes, span).
SPANS = ((128, 1), (512, 4), (4_096, 16), (1 << 62, 64))
FILTER, HASHES, CAPACITY = 2_048, 5, 160
#: Standard deviations above chance from which an overlap counts.
ABOVE = 4.0
#: Bytes that are worked on at once.
CHUNK = 1 << 18
_NONE = np.uint64(2**64 - 1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_TOP = np.uint64(54)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the rolling hash's base and of its inverse."""
    out = []
    for b in (_BASE, _INVERSE):
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@cache
def _weights() -> tuple[np.ndarray, int]:
    """Steps of n * log2(n) in fixed point, from n to n + 1, and its value at WINDOW."""
    f = [round(n * np.log2(n) * 2**16) if n else 0 for n in range(WINDOW + 2)]
    return np.diff(np.array(f, np.int32)), f[WINDOW]


def classes(data: np.ndarray) -> np.ndarray:
    """Entropy class, 0 to BINS - 1, of the window that ends at each byte; zero bytes stand before the first.

    The sum of n * log2(n) over a window's bytes changes by the counts of the byte that enters and of the one that
    leaves, which are counted for all positions at once, one distance after the other."""
    x = np.concatenate((np.zeros(WINDOW, np.uint8), data))
    back, ahead = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)
    for k in range(1, WINDOW):
        same = (x[k:] == x[:-k]).view(np.uint8)
        back[k:] += same
        ahead[:-k] += same
    step, full = _weights()
    change = step[back[WINDOW:]] - step[ahead[:-WINDOW]]
    s = full + np.cumsum(change, dtype=np.int64)
    return np.minimum((full - s) * BINS // full, BINS - 1)


def keys(data: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """What windows are chosen by, the least first: the rank of the class in the top ten bits, then a hash of the bytes."""
    n = len(data)
    up, down = _powers(max(CHUNK, 1 << int(n + WINDOW).bit_length()) + 256)
    total = np.zeros(n + WINDOW + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[WINDOW : n + WINDOW], out=total[WINDOW + 1 :])
    h = _mix((total[WINDOW + 1 :] - total[1 : n + 1]) * up[WINDOW : n + WINDOW])
    return (ranks[classes(data)].astype(np.uint64) << _TOP) | (h >> np.uint64(10))


def _pieces(data: bytes, span: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, last) places of span windows and (from, to) bytes that they need."""
    at = 1 - span
    while at < len(data):
        to = min(at + CHUNK, len(data))
        yield at, to, at - WINDOW + 1, to + span - 1
        at = to


def features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct features in their order, as hashes. Texts are laid one after the other, apart, and worked on
    together up to CHUNK bytes; a long text is cut into pieces that overlap."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    jobs: dict[int, list[tuple[int, tuple[int, int, int, int]]]] = {}
    for i, t in enumerate(texts):
        if t:
            span = next(s for top, s in SPANS if len(t) <= top)
            jobs.setdefault(span, []).extend((i, p) for p in _pieces(t, span))
    for span, todo in jobs.items():
        at = 0
        while at < len(todo):
            to, size = at, 0
            while to < len(todo) and (to == at or size + todo[to][1][3] - todo[to][1][2] <= CHUNK):
                size += todo[to][1][3] - todo[to][1][2]
                to += 1
            _chosen(texts, todo[at:to], size, span, ranks, found)
            at = to
    out = []
    for t, parts in zip(texts, found, strict=True):
        chosen = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        strong = chosen[(chosen >> _TOP) < BINS]
        chosen = strong if len(strong) and len(t) > SPANS[0][0] else chosen
        _, first = np.unique(chosen, return_index=True)
        out.append(chosen[np.sort(first)])
    return out


def _chosen(texts: list[bytes], todo: list[tuple[int, tuple[int, int, int, int]]], size: int, span: int, ranks: np.ndarray, found: list[list[np.ndarray]]) -> None:
    data, inside, base, places = np.zeros(size, np.uint8), np.zeros(size, bool), 0, []
    for i, (first, last, low, high) in todo:
        a, b = max(low, 0), min(high, len(texts[i]))
        data[base + a - low : base + b - low] = np.frombuffer(texts[i], np.uint8, b - a, a)
        # windows that begin before a piece's first byte aren't its own
        own = max(first, 0)
        inside[base + own - low : base + b - low] = True
        places.append((i, base + WINDOW - 1, base + WINDOW - 1 + last - first))
        base += high - low
    least = np.where(inside, keys(data, ranks), _NONE)
    have = 1
    while have < span:
        step = min(have, span - have)
        least[: len(least) - step] = np.minimum(least[: len(least) - step], least[step:])
        have += step
    for i, a, b in places:
        run = least[a:b]
        run = run[np.append(True, run[1:] != run[:-1])]
        found[i].append(run[run != _NONE])


def chain(chosen: np.ndarray) -> np.ndarray:
    """The Bloom filters of a text's features, as rows of bytes."""
    n = -(-len(chosen) // CAPACITY)
    bits, h = np.zeros((n, FILTER), bool), _mix(chosen ^ np.uint64(_BASE))
    row = np.arange(len(chosen)) // CAPACITY
    for k in range(HASHES):
        bits[row, (h >> np.uint64(11 * k)).astype(np.int64) % FILTER] = True
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for two chains without filters, 0 if only one has none."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    x, y = a.view(np.uint64), b.view(np.uint64)
    nx, ny = (np.bitwise_count(v).sum(1, dtype=np.int64) for v in (x, y))
    if nx.sum() > ny.sum():
        x, y, nx, ny = y, x, ny, nx
    best, at_once = np.zeros(len(x)), max(1, (1 << 20) // y.size)
    for i in range(0, len(x), at_once):
        common = np.bitwise_count(x[i : i + at_once, None] & y).sum(2, dtype=np.int64)
        own, other = nx[i : i + at_once, None], ny[None]
        chance = own * other / FILTER
        most = np.minimum(own, other)
        noise = ABOVE * np.sqrt(chance * (1 - np.maximum(own, other) / FILTER))
        score = np.where(common > chance + noise, (common - chance) / np.maximum(most - chance, 1e-9), 0.0)
        best[i : i + at_once] = score.max(1)
    return float(min(1.0, (best * nx).sum() / nx.sum()))


def written(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, FILTER // 8)


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of each entropy class, the one with the fewest windows in all texts first (equal: the higher class); classes
    of little entropy have ranks from BINS on. At most BINS counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BINS, np.int64)
        for b in batches:
            for laid, own in _grouped([(t.as_py() or "").encode("utf-8") for t in b.column(0)]):
                n += np.bincount(classes(laid)[own], minlength=BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["c", "n"])

    counts = docs.select(quoted(text_col).alias("t")).where("t <> ''").mapInArrow(run, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(BINS, np.int64)
    for r in counts:
        n[r.c] = r.n
    ranks = np.empty(BINS, np.int64)
    ranks[np.lexsort((-np.arange(BINS), n))] = np.arange(BINS)
    ranks[:WEAK] = np.minimum(BINS + np.arange(WEAK) // 16, 1022)
    return ranks


def _grouped(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts laid one after the other to about CHUNK bytes, zero bytes before each, and which bytes count; a longer text
    comes in pieces that begin with the end of the one before."""
    held: list[bytes] = []
    own: list[bool] = []
    lengths: list[int] = []
    size = 0
    for t in texts:
        for at in range(0, len(t), CHUNK):
            before = t[max(0, at - WINDOW) : at].rjust(WINDOW, b"\0")
            held += [before, t[at : at + CHUNK]]
            own += [False, True]
            lengths += [WINDOW, len(held[-1])]
            size += len(held[-1])
            if size > CHUNK:
                yield np.frombuffer(b"".join(held), np.uint8), np.repeat(own, lengths)
                held, own, lengths, size = [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.repeat(own, lengths)


def fingerprints(docs: DataFrame, ranks: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row; without ranks the corpus' own. Null and empty texts have an empty fingerprint."""
    sent = docs.sparkSession.sparkContext.broadcast(rarity(docs, text_col) if ranks is None else ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [written(chain(f)) for f in features([(t.as_py() or "").encode("utf-8") for t in b.column(1)], sent.value)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.string())], names=[id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def _order(key: tuple) -> tuple:
    """Ascending, null ids last."""
    return (key[0] is None, 0 if key[0] is None else key[0], key[1])


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, guest, id, digest, t): the rows in stretches of ascending (id, digest of the text), each stretch sorted and
    in one partition. Behind a stretch's own rows stands the first row of the next one (guest = 1), behind the last
    stretch's the first of all, so every row but guests is followed by the next document.

    The stretches' first keys are found over keys alone; they are as many as four times the shuffle's partitions."""
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = quoted(text_col)
    rows = docs.select(quoted(id_col).alias("id"), F.md5(F.coalesce(text, F.lit(""))).alias("digest"), text.alias("t"))
    order = [F.asc_nulls_last("id"), "digest"]
    found = rows.select("id", "digest").repartitionByRange(n, *order).groupBy(F.spark_partition_id().alias("p"))
    firsts = found.agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("k")).collect()
    cuts = spark.sparkContext.broadcast(sorted({_order((r.k.id, r.k.digest)) for r in firsts}))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = cuts.value
        for b in batches:
            keyed = [_order(k) for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            part = [max(bisect.bisect_right(first, k) - 1, 0) for k in keyed]
            guests = [i for i, (k, p) in enumerate(zip(keyed, part, strict=True)) if k == first[p]]
            both = pa.Table.from_batches([b]).take(pa.array([*range(b.num_rows), *guests], pa.int64()))
            where = [*part, *((part[i] - 1) % len(first) for i in guests)]
            marks = [*[0] * b.num_rows, *[1] * len(guests)]
            out = pa.table([pa.array(where, pa.int64()), pa.array(marks, pa.int32()), *both.columns], names=["part", "guest", "id", "digest", "t"])
            yield from out.to_batches()

    dealt = rows.mapInArrow(run, f"part bigint, guest int, id {kind}, digest string, t string")
    return dealt.repartition("part").sortWithinPartitions("part", "guest", F.asc_nulls_last("id"), "digest")


def edited(text: str, following: str) -> str:
    """The text with the last quarter of its code points replaced by the first as many of ``following``."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def near_edited(docs: DataFrame, ranks: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next row in the order of id (null ids last) and digest of the text; the last row's is the
    first. Null and empty texts have an empty fingerprint, alike to one another (1) and to no other text (0). Repeated
    rows follow one another and each come back; one row alone follows itself. An empty table gives none; other columns
    are left out, whatever they are called."""
    sent = docs.sparkSession.sparkContext.broadcast(rarity(docs, text_col) if ranks is None else ranks)
    rows = with_next(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # a row whose next one hasn't come: part, id, text, filters
        for b in batches:
            out: list[tuple] = []
            got = list(zip(b.column("part").to_pylist(), b.column("guest").to_pylist(), b.column("id").to_pylist(), (t or "" for t in b.column("t").to_pylist()), strict=True))
            marks = list(map(chain, features([t.encode("utf-8") for *_, t in got], sent.value)))
            pairs = []
            for (part, guest, key, text), mark in zip(got, marks, strict=True):
                if last is not None and last[0] == part:
                    pairs.append((last[1], last[2], last[3], edited(last[2], text), mark))
                last = None if guest else (part, key, text, mark)
            for (key, text, mark, new, following), changed in zip(pairs, map(chain, features([p[3].encode("utf-8") for p in pairs], sent.value)), strict=True):
                sha = hashlib.sha256(new.encode("utf-8")).hexdigest()
                out.append((key, len(text), sha, written(mark), written(changed), likeness(mark, changed), likeness(mark, following)))
            types = [b.schema.field("id").type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 7, types, strict=True)], names=names)

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
