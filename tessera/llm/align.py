"""Alignment of two tokenizers' tokens by an event sweep.

Every token ends at a byte offset; that is an event. The end events of both tokenizers are united, dealt by document,
sorted by offset within a partition, and swept: where an event of either side falls on the same offset, all tokens since
the last such offset form a group, and every A token of it is linked with every B token. Between two blocks of events the
sweep holds nothing but the tokens of the group that is still open, and sums.

An event is stored as its token's id: with a block's first offset the ids' byte lengths give the others. A row of the
event table holds a side's events within one stretch of BLOCK bytes, so a long text is many rows, and two rows of a
document meet in the sweep only if they are about the same stretch.

How many documents hold a pair of ids linked is counted over the distinct pairs of each document, added up within a task
first. Documents then look their pairs up: in a sent table while there are at most SENT_PAIRS of them (counted first),
otherwise by a join on the pair, hot pairs apart.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import byte_symbols
from .common import HotKeys, materialize, nullable_key, quoted

#: Bytes of text whose events are in one row.
BLOCK = 1 << 16
#: Up to so many pairs of ids the counts are sent to the workers.
SENT_PAIRS = 4_000_000
#: Pairs that a task counts before it gives the counts on; pairs of one group that are spelled out at once.
TALLY, GROUP_PAIRS = 4_000_000, 1 << 20
#: The pattern that splits texts before byte-level merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"


#: Bytes that a worker keeps of stretches of text and their ids, about; an entry takes ENTRY besides.
KEPT_BYTES, ENTRY = 150_000_000, 160


class Kept:
    """Ids of stretches of text, as bytes. Two generations: when the younger takes half the bytes it becomes the older,
    whose stretches come back when they are met and else go with it."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]) -> None:
        self.encode, self.young, self.older, self.bytes = encode, {}, {}, 0

    def joined(self, parts: list[str]) -> bytes:
        lacking = set(parts).difference(self.young)
        if lacking:
            if self.bytes > KEPT_BYTES // 2:
                self.young, self.older, self.bytes = {}, self.young, 0
                lacking = set(parts)
            found = {p: self.older.pop(p) for p in lacking & self.older.keys()}
            new = [p for p in lacking if p not in found]
            found.update(zip(new, self.encode(new), strict=True))
            self.young.update(found)
            self.bytes += sum(ENTRY + 2 * len(p) + len(i) for p, i in found.items())
        return b"".join(map(self.young.__getitem__, parts))


class ByteTokens:
    """A byte-level BPE file (JSON). ``encode`` gives the ids of space + text; special tokens' strings are plain text."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        special, byte = {t["content"] for t in data["added_tokens"]}, {c: b for b, c in byte_symbols().items()}
        self.bytes = {i: bytes(byte[c] for c in t) for t, i in data["model"]["vocab"].items() if t not in special}
        self.lengths = _lengths(self.bytes)

    def __getstate__(self) -> dict:
        return {"bytes": self.bytes, "lengths": self.lengths}

    @cached_property
    def _encoding(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})

    def encode(self, text: str) -> np.ndarray | None:
        ids = np.array(self._encoding.encode_ordinary(" " + text), _kind(len(self.lengths)))
        return ids if self.lengths[ids].sum() == len(text.encode("utf-8")) + 1 else None


class PieceTokens:
    """A sentence-piece BPE model. ``encode`` gives the ids of a text, to which the model adds a space; None where the
    tokens' bytes aren't those of space + text.

    No merge leads from another character to a space mark, or past a line end, if no piece does; then stretches between
    such places are encoded one by one and kept."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.proto = f.read()
        sp = self._model
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {i: bytes([int(n[3:5], 16)]) if sp.is_byte(i) else n.replace(SPACE, " ").encode("utf-8") for i, n in enumerate(names) if not (sp.is_control(i) or sp.is_unknown(i))}
        self.lengths = _lengths(self.bytes)
        plain = [n for i, n in enumerate(names) if i in self.bytes]
        self.apart = [self.bytes.get(i) for i in sp.encode("\n")] == [b" ", b"\n"] and not any("\n" in n or SPACE in n.lstrip(SPACE) for n in plain)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("proto", "bytes", "lengths", "apart")}

    @cached_property
    def _model(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.proto)

    @cached_property
    def _kept(self) -> Kept:
        return Kept(self._stretches)

    def _stretches(self, parts: list[str]) -> list[bytes]:
        """All in one call: a line end before each part, which is a token of its own."""
        ids = np.array(self._model.encode("\n" + "\n".join(parts)), _kind(len(self.lengths)))
        if b"".join(map(self.bytes.get, ids.tolist(), itertools.repeat(b""))) != (" \n" + "\n".join(parts)).encode("utf-8"):
            raise _Differs
        ends = np.flatnonzero(ids == ids[1]).tolist()
        whole = iter(zip(ends, [*ends[1:], len(ids)], strict=True))
        out = []
        for part in parts:
            i, j = next(whole)
            if part == "\n":
                i, j = j - 1, next(whole)[1]
            out.append(ids[i + 1 : j].tobytes())
        return out

    def encode(self, text: str) -> np.ndarray | None:
        if SPACE in text:
            return None
        kind = _kind(len(self.lengths))
        if not self.apart:
            ids = self._model.encode(text)
            same = b"".join(self.bytes.get(i, b"") for i in ids) == (" " + text).encode("utf-8")
            return np.array(ids, kind) if same else None
        try:
            return np.frombuffer(self._kept.joined(re.findall(r" +[^ \n]*|[^ \n]+|\n", " " + text)), kind)
        except _Differs:
            return None


Tokens = ByteTokens | PieceTokens


class _Differs(ValueError):
    """The tokens of a stretch don't spell it."""


def _kind(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def _lengths(spelled: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(spelled, default=-1) + 1, np.int64)
    for i, b in spelled.items():
        out[i] = len(b)
    return out


def pack(values: np.ndarray) -> bytes:
    """An array of unsigned integers, the bytes of equal weight together."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return values.dtype.char.encode() + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def unpack(packed: bytes) -> np.ndarray:
    kind = np.dtype(packed[:1].decode())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def events(docs: DataFrame, tokens: Tokens, side: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, block, side, copies, start, ids): a side's end events, block by block. A text without tokens is a row
    with block -1. Rows of a batch that are alike in id and text are one row with their number in ``copies``."""
    sent = docs.sparkSession.sparkContext.broadcast(tokens)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for b in batches:
            seen: dict[tuple, int] = {}
            first: dict[str, list] = {}
            ids, digests, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            for k, key in enumerate(zip(ids, digests, strict=True)):
                seen[key] = seen.get(key, 0) + 1
                if key[1] not in first:
                    first[key[1]] = blocks(t, texts[k].as_py())
            out = [(i, d, block, side, n, start, packed) for (i, d), n in seen.items() for block, start, packed in first[d]]
            cols = zip(*out, strict=True) if out else [()] * 7
            types = [b.schema.field(0).type, pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types, strict=True)], names=["id", "digest", "block", "side", "copies", "start", "ids"])

    def blocks(t: Tokens, text: str | None) -> list[tuple[int, int, bytes]]:
        ids = t.encode(text) if text else None
        if ids is None:
            return [(-1, 0, b"")]
        ends = np.cumsum(t.lengths[ids])
        cuts = np.searchsorted(ends, np.arange(0, ends[-1] + BLOCK, BLOCK), "right")
        return [(k, int(ends[i - 1]) if i else 0, pack(ids[i:j])) for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if i < j]

    text = quoted(text_col)
    return docs.select(quoted(id_col).alias("id"), F.md5(F.coalesce(text, F.lit(""))).alias("digest"), text.alias("t")).mapInArrow(run, f"id {kind}, digest string, block bigint, side int, copies bigint, start bigint, ids binary")


class Sweep:
    """The state between two blocks of one document: the tokens since the last offset at which both sides ended."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray]) -> None:
        self.lengths, self.open = lengths, ([], [])

    def block(self, ids: tuple[np.ndarray, np.ndarray], starts: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Takes both sides' events of a stretch; gives the groups that it closes: A ids, B ids, numbers of both per
        group, and the groups' ends."""
        ends = [s + np.cumsum(n[i]) for i, n, s in zip(ids, self.lengths, starts, strict=True)]
        none = np.zeros(0, np.int64)
        low = min((int(e[0]) for e in ends if len(e)), default=0)
        mark = np.zeros(max((int(e[-1]) - low + 1 for e in ends if len(e)), default=0), np.uint8)
        for k, e in enumerate(ends):
            mark[e - low] |= 1 << k
        at = [np.flatnonzero(mark[e - low] == 3) for e in ends]
        if not len(at[0]):
            for held, i in zip(self.open, ids, strict=True):
                held.append(i)
            return none.astype(np.uint16), none.astype(np.uint16), none, none, none
        out, numbers = [], []
        for side in (0, 1):
            before = sum(map(len, self.open[side]))
            out.append(np.concatenate([*self.open[side], ids[side][: at[side][-1] + 1]]))
            n = np.diff(at[side], prepend=-1)
            n[0] += before
            numbers.append(n)
            self.open[side][:] = [ids[side][at[side][-1] + 1 :]]
        return out[0], out[1], numbers[0], numbers[1], ends[0][at[0]]


def swept(rows: Iterator[tuple], lengths: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple]:
    """Per document (id, digest, copies, closed groups of one block after the other) from events sorted by document,
    block and side; the groups are an iterator, to be used up before the next document. A row that comes again is a copy."""
    row = next(rows, None)
    while row is not None:
        key, total = row[:2], [0]
        spare: list[tuple | None] = [row]

        def parts(key: tuple = key, total: list[int] = total, spare: list = spare) -> Iterator[tuple]:
            state, empty = Sweep(lengths), np.zeros(0, np.uint16)
            bad, block, two, starts = False, None, [empty, empty], [0, 0]
            row, last, first = spare[0], None, None
            while row is not None and row[:2] == key:
                _, _, at, side, copies, start, ids = row
                if first is None:
                    first = (at, side)
                if (at, side) == first:
                    total[0] += copies
                if (at, side) != last:
                    last = (at, side)
                    bad = bad or at < 0
                    if not bad:
                        if at != block and block is not None:
                            yield state.block((two[0], two[1]), (starts[0], starts[1]))
                            two = [empty, empty]
                        block, two[side], starts[side] = at, unpack(ids), start
                row = next(rows, None)
            if block is not None and not bad:
                yield state.block((two[0], two[1]), (starts[0], starts[1]))
            spare[0] = row

        yield key[0], key[1], total, parts()
        row = spare[0]


def sorted_events(docs: DataFrame, a: Tokens, b: Tokens, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both sides' events, dealt by document and sorted by offset within a partition."""
    both = events(docs, a, 0, id_col, text_col).unionByName(events(docs, b, 1, id_col, text_col))
    return both.repartition("id", "digest").sortWithinPartitions("id", "digest", "block", "side")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def group_table(docs: DataFrame, a: Tokens, b: Tokens, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups themselves: (id, copies, place, start, end, a_ids, b_ids), one row per group; bytes are those of space +
    text. Texts without tokens on either side have no rows; rows alike in id and text are one with their number."""
    sent = docs.sparkSession.sparkContext.broadcast((a.lengths, b.lengths))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, copies, parts in swept(_rows(batches), sent.value):
            place = last = 0
            for ia, ib, na, nb, ends in parts:
                n = len(na)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(m))), pa.int32()), pa.array(i.astype(np.int32))) for i, m in ((ia, na), (ib, nb))]
                starts = np.concatenate(([last], ends[:-1])) if n else ends
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, kinds), pa.array([copies[0]] * n, pa.int64()), pa.array(np.arange(place, place + n)), pa.array(starts), pa.array(ends), *lists], names=["id", "copies", "place", "start", "end", "a_ids", "b_ids"])
                place, last = place + n, int(ends[-1]) if n else last

    kinds = to_arrow_type(docs.schema[id_col].dataType)
    return sorted_events(docs, a, b, id_col, text_col).mapInArrow(run, f"id {kind}, copies bigint, place bigint, start bigint, end bigint, a_ids array<int>, b_ids array<int>").withColumnRenamed("id", id_col)


def _spellings(size: int) -> np.ndarray:
    """For id * 3 + k the decimal id and a comma, bar or semicolon, filled up with zero bytes."""
    width = len(str(size)) + 1
    return np.frombuffer(b"".join((str(i) + s).encode().ljust(width, b"\0") for i in range(size) for s in ",|;"), np.uint8).reshape(-1, width)


def spelled(ia: np.ndarray, ib: np.ndarray, na: np.ndarray, nb: np.ndarray, table: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3;`` for groups of na and nb ids."""
    ca, cb = ia.astype(np.int64) * 3, ib.astype(np.int64) * 3
    ca[np.cumsum(na) - 1] += 1
    cb[np.cumsum(nb) - 1] += 2
    order = np.empty(len(ca) + len(cb), np.int64)
    order[np.arange(len(ca)) + np.repeat(np.cumsum(nb) - nb, na)] = ca
    order[np.arange(len(cb)) + np.repeat(np.cumsum(na), nb)] = cb
    flat = table[order].ravel()
    return flat[flat != 0].tobytes()


def linked(ia: np.ndarray, ib: np.ndarray, na: np.ndarray, nb: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(pairs a * width + b, how often or None for once each) of all links, in parts of bounded size unless one group has more."""
    ends_a, ends_b = np.cumsum(na), np.cumsum(nb)
    cut = np.flatnonzero(np.diff(np.cumsum(na * nb) // GROUP_PAIRS, prepend=0)) if len(na) else na
    bounds = [0, *(cut + 1).tolist()]
    if bounds[-1] != len(na):
        bounds.append(len(na))
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        if j == i + 1 and na[i] * nb[i] > GROUP_PAIRS:
            (ua, ta), (ub, tb) = (np.unique(x[e[i] - n[i] : e[i]].astype(np.int64), return_counts=True) for x, e, n in ((ia, ends_a, na), (ib, ends_b, nb)))
            yield (ua[:, None] * width + ub).ravel(), (ta[:, None] * tb).ravel()
            continue
        of = np.repeat(nb[i:j], na[i:j])  # partners of each A token
        start = np.repeat(ends_b[i:j] - nb[i:j], na[i:j])
        b_at = np.arange(of.sum()) + np.repeat(start - (np.cumsum(of) - of), of)
        first = ends_a[i] - na[i]
        yield np.repeat(ia[first : first + len(of)].astype(np.int64) * width, of) + ib[b_at], None


def _counted(parts: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how often each."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = np.concatenate([k for k, _ in parts])
    if all(n is None for _, n in parts):
        return np.unique(keys, return_counts=True)
    found, place = np.unique(keys, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, place, np.concatenate([np.ones(len(k), np.int64) if n is None else n for k, n in parts]))
    return found, total


def documents_aligned(docs: DataFrame, a: Tokens, b: Tokens, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, copies, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times), a row per distinct (id, text): the
    sweep's sums, the document's distinct linked pairs in order (packed differences of a * size of B + b) and how often
    it links each."""
    sent = docs.sparkSession.sparkContext.broadcast((a.lengths, b.lengths))
    width, kind = len(b.lengths), docs.schema[id_col].dataType.simpleString()
    small = np.uint32 if len(a.lengths) * width <= 1 << 32 else np.uint64
    types = [to_arrow_type(docs.schema[id_col].dataType), pa.string(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]
    names = ["id", "digest", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, out, held = _spellings(max(map(len, sent.value))), [], 0
        for key, digest, copies, groups in swept(_rows(batches), sent.value):
            sums, sha, parts, waiting = np.zeros(4, np.int64), hashlib.sha256(), [], 0
            for ia, ib, na, nb, _ in groups:
                if not len(na):
                    continue
                sha.update((b";" if sums[2] else b"") + spelled(ia, ib, na, nb, table)[:-1])
                sums += (len(ia), len(ib), len(na), int((na * nb).sum()))
                for p in linked(ia, ib, na, nb, width):
                    parts.append(p)
                    waiting += len(p[0])
                    if waiting > TALLY:
                        parts, waiting = [_counted(parts)], 0
            pairs, times = _counted(parts)
            packed = pack(np.diff(pairs, prepend=0).astype(small)), pack(times.astype(np.min_scalar_type(int(times.max(initial=0)))))
            out.append((key, digest, copies[0], *sums.tolist(), sha.hexdigest() if sums[0] else "", *packed))
            held += len(packed[0]) + len(packed[1]) + 500
            if held > 16_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return sorted_events(docs, a, b, id_col, text_col).mapInArrow(run, f"id {kind}, digest string, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary")


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): how many documents hold a pair linked, and whether that is the most of all pairs of its A id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0

        def flush() -> pa.RecordBatch:
            found, n = _counted(parts)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pair", "n"])

        for b in batches:
            for packed, copies in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                keys = np.cumsum(unpack(packed.as_py()), dtype=np.int64)
                parts.append((keys, None if copies == 1 else np.full(len(keys), copies)))
                waiting += len(keys)
                if waiting > TALLY:
                    yield flush()
                    parts, waiting = [], 0
        yield flush()

    counts = materialize(aligned.where("n_links > 0").select("pairs", "copies").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "align-counts")
    own = F.floor(F.col("pair") / width).alias("a")
    # one row per id of the vocabulary at most
    most = counts.groupBy(own).agg(F.max("n").alias("most"))
    return counts.select("pair", "n", own).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` with n_best and count_sum, by a table of counts that every worker holds."""
    table = counts.orderBy("pair").toArrow()
    spark = aligned.sparkSession
    sent = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for b in batches:
            out = []
            for packed, often in zip(b.column("pairs"), b.column("times"), strict=True):
                at, times = np.searchsorted(pair, np.cumsum(unpack(packed.as_py()), dtype=np.int64)), unpack(often.as_py()).astype(np.int64)
                out.append((int(times[best[at]].sum()), int((times * n[at]).sum())))
            kept = [c for c in b.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array([o[k] for o in out], pa.int64()) for k in (0, 1))], names=[*kept, "n_best", "count_sum"])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name not in ("pairs", "times")]
    return aligned.mapInArrow(run, ", ".join([*kept, "n_best bigint", "count_sum bigint"]))


def _joined(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` with n_best and count_sum, by a join on the pair, hot pairs apart."""
    key = F.concat_ws(":", "digest", nullable_key(F.col("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, packed, often in zip(b.column(0), b.column(1), b.column(2), strict=True):
                keys = np.cumsum(unpack(packed.as_py()), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(row, len(keys)), pa.array(keys), pa.array(unpack(often.as_py()).astype(np.int64))], names=["row", "pair", "times"])

    pairs = aligned.where("n_links > 0").select(key.alias("row"), "pairs", "times").mapInArrow(run, "row string, pair bigint, times bigint")
    found = HotKeys(pairs, "pair", counted=pairs.select("pair")).join(counts)
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = aligned.drop("pairs", "times").withColumn("row", key).join(sums, "row", "left").drop("row")
    return out.fillna(0, ["n_best", "count_sum"])


def align(docs: DataFrame, a: Tokens, b: Tokens, id_col: str = "doc_id", text_col: str = "text", sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their A
    id), count_sum (counts summed over links), groups_sha256 of ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and those whose A or B bytes differ from space + text (one with the space mark in it), have no
    tokens: zeros and ''. Rows alike in id and text are swept once, counted as often as they come, and each come back;
    null ids are ids like any other. An empty table gives none; other columns are left out, whatever they are called."""
    aligned = materialize(documents_aligned(docs, a, b, id_col, text_col), "align")
    counts = materialize(pair_counts(aligned, len(b.lengths)), "align-pairs")
    out = _looked_up(aligned, counts) if counts.limit(sent_pairs + 1).count() <= sent_pairs else _joined(aligned, counts)
    again = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return again.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
