"""Pairs of a group's rows, block against block, for groups whose pairs are many.

Rows are dealt to blocks of a bounded number of rows by a hash of their key, and each pair of a group's blocks is a group of
its own in a shuffle, so no task holds more than two blocks. A pair's cosine is the sum from the first dimension on, as in
``columns.dot``, so it doesn't depend on where the pair stands and equal vectors have equal ones. Where only a rounded value
is wanted a matrix product gives it; what comes near an edge between two roundings is added up in that order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, pairs that are worked on at a time (they fit a core's cache), rows of a batch of results.
PAIR_ROWS, TILE, BATCH = 1_024, 16_384, 131_072
#: Blocks of a group while they hold no more than so many rows: a row is dealt once per block, so this bounds its copies.
BLOCKS, MOST_ROWS = 8, 32_768
#: Rows of a piece of a block, whose pairs with one row are made one after the other, and kinds of rows compared at a time.
PIECE, KINDS = 512, 2_048
#: More partitions than any table here has.
MOST_PARTITIONS = 1_000_000
#: Rows on the other side of a block whose neighbours are counted.
COUNT_ROWS = 32_768
#: Cosines of different orders of additions differ by less.
SLACK = 1e-12


def block_rows(largest: int) -> int:
    """Rows of a block of a group of ``largest`` rows."""
    return max(PAIR_ROWS, min(MOST_ROWS, -(-largest // BLOCKS)))


def _blocks(df: DataFrame, group: str, key: str, largest: int, rows: int) -> tuple[DataFrame, int]:
    n = max(1, -(-largest // rows))
    return df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def block_pairs(df: DataFrame, group: str, key: str, largest: int, rows: int) -> DataFrame:
    """Each row with its block ``_b``, once per pair of blocks ``_p`` and ``_q`` that it is in."""
    dealt, n = _blocks(df, group, key, largest, rows)
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = dealt.withColumn("_p", F.least("_b", "_o")).withColumn("_q", F.greatest("_b", "_o")).drop("_o")
    # pairs are many where rows are few, so partitions must not be joined by their bytes
    return dealt if n == 1 else dealt.repartition(_tasks(df), group, "_p", "_q")


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * df.sparkSession.sparkContext.defaultParallelism)


def vectors_of(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column as rows, all of one length and without nulls inside, and which rows have none."""
    lists = pa.chunked_array(table.column(column).chunks, table.schema.field(column).type).combine_chunks()
    none = lists.is_null().to_numpy(zero_copy_only=False)
    have = lists.drop_null()
    values, sizes = have.flatten(), have.value_lengths().to_numpy(zero_copy_only=False)
    width = int(sizes[0]) if len(sizes) else 0
    if values.null_count or (sizes != width).any():
        raise ValueError("vectors must be of one length and hold no nulls")
    out = np.zeros((len(lists), width))
    out[~none] = values.to_numpy(zero_copy_only=False).astype(float).reshape(len(sizes), width)
    return out, none


def units(v: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero."""
    n = np.zeros(len(v))
    for x in v.T:
        n += x * x
    n = np.sqrt(n)[:, None]
    return np.divide(v, n, out=v * 0.0, where=n > 0)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All dot products, added up from the first dimension on, clipped to [-1, 1]."""
    out, part = np.zeros((len(a), b.shape[1])), np.empty((len(a), b.shape[1]))
    for x, y in zip(a.T, b, strict=True):
        np.multiply(x[:, None], y[None, :], out=part)
        out += part
    return _clipped(out)


def _clipped(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.fmin(x, 1, out=x), -1, out=x)


def _half_up(x: float, digits: int) -> int:
    """As Spark's ``round``: on the shortest decimal text, halves away from zero."""
    n = int(Decimal(repr(abs(x))).scaleb(digits).to_integral_value(ROUND_HALF_UP))
    return -n if x < 0 else n


def rounded_cosines(a: list[np.ndarray], b: list[np.ndarray], outputs: dict[str, tuple[Callable, int]]) -> list[np.ndarray]:
    """Each output's values in units of its last digit: ``outputs`` maps a name to a function of the views' cosines, which
    changes by no more than they do together, and its digits. ``a`` holds rows, ``b`` columns."""
    flat, out = [_clipped(x @ y) for x, y in zip(a, b, strict=True)], []
    for f, digits in outputs.values():
        z = f(*flat) * 10.0**digits
        r = np.rint(z)
        near = np.abs(z - r) > 0.5 - (1e-9 + len(flat) * SLACK * 10**digits)
        if near.any():
            i, j = np.nonzero(near)
            exact = [_clipped(np.cumsum(x[i] * y.T[j], axis=1)[:, -1]) for x, y in zip(a, b, strict=True)]
            r[i, j] = [_half_up(float(v), digits) for v in f(*exact)]
        out.append(r)
    return out


def tiles(n: int, m: int) -> Iterator[slice]:
    step = max(1, TILE // max(m, 1))
    return (slice(k, min(k + step, n)) for k in range(0, n, step))


def paired(df: DataFrame, group: str, key: str, largest: int, prepare: Callable, compare: Callable, columns: dict[str, str], rows: int | None = None) -> DataFrame:
    """(group, i, j, columns) of each unordered pair within a group; keys are whole numbers, null groups have no pairs.

    ``prepare`` makes what is compared of a table of rows; ``compare(a, b)`` gives a function of a slice of the first
    table's rows, which gives a matrix per column for these against all of the second. ``largest``: rows of the largest
    group."""
    dealt = block_pairs(df.where(F.col(group).isNotNull() & F.col(key).isNotNull()), group, key, largest, rows or block_rows(largest))
    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, key)}
    schema = f"`{group}` {kinds[group]}, i {kinds[key]}, j {kinds[key]}, " + ", ".join(f"`{c}` {k}" for c, k in columns.items())
    names = [group, "i", "j", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        own, p, q = table.column(group)[0], table.column("_p")[0].as_py(), table.column("_q")[0].as_py()
        block = table.column("_b").to_numpy()
        one, two = (table.filter(pa.array(block == k)) for k in (p, q))
        compared = compare(prepare(one), prepare(two))
        left, right = one.column(key).to_numpy(), two.column(key).to_numpy()
        held: list[list[np.ndarray]] = []

        def batch() -> pa.RecordBatch:
            cols = [(np.ma if any(map(np.ma.isMaskedArray, c)) else np).concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            first = pa.repeat(own, len(cols[0]))
            return pa.RecordBatch.from_arrays([first, *[pa.array(c) for c in cols]], names=names)

        size = 0
        for at in tiles(len(left), len(right)):
            values = compared(at)
            x, y = np.broadcast_arrays(left[at, None], right[None, :])
            keep = (x < y) if p == q else x != y
            i, j = x[keep], y[keep]
            held.append([np.minimum(i, j), np.maximum(i, j), *[v[keep] for v in values]])
            size += len(i)
            if size >= BATCH:
                yield batch()
                size = 0
        if size:
            yield batch()

    return dealt.groupBy(group, "_p", "_q").applyInArrow(run, schema)


def view_pairs(df: DataFrame, group: str, key: str, vector: str, views: dict[str, tuple[int, int]], largest: int, outputs: dict[str, tuple[Callable, int]] | None = None, rows: int | None = None, equal: bool = False) -> DataFrame:
    """(group, i, j, a cosine per view): ``views`` names stretches (start, stop) of the vector, (0, None) being all of it.
    With ``outputs`` their rounded values stand instead (as in ``rounded_cosines``; functions take the views in order).
    Rows without a vector have nulls. With ``equal`` a value of two equal vectors is exactly 1, of zero vectors too."""

    def prepare(t: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, list[bytes]]:
        v, none = vectors_of(t, vector)
        parts = [units(v[:, lo:hi]) for lo, hi in views.values()]
        return parts, [np.ascontiguousarray(x.T) for x in parts], none, [x.tobytes() for x in v + 0.0] if equal else []

    def compare(a: tuple, b: tuple) -> Callable:
        place: dict[bytes, int] = {}
        one, two = (np.array([place.setdefault(x, len(place)) for x in side[3]], np.int64) for side in (a, b))

        def values(at: slice) -> list[np.ndarray]:
            none = a[2][at, None] | b[2][None, :]
            if none.all():
                got = [np.zeros(none.shape) for _ in outputs or views]
            elif outputs:
                got = [(r + 0.0) / 10.0**d for r, (_, d) in zip(rounded_cosines([x[at] for x in a[0]], b[1], outputs), outputs.values(), strict=True)]
            else:
                got = [cosines(x[at], y) for x, y in zip(a[0], b[1], strict=True)]
            if equal:
                same = one[at, None] == two[None, :]
                for x in got:
                    x[same] = 1.0
            return [np.ma.masked_array(x, none) for x in got] if none.any() else got

        return values

    return paired(df.select(group, key, vector), group, key, largest, prepare, compare, dict.fromkeys(outputs or views, "double"), rows)


def value_counts(df: DataFrame, group: str, key: str, vector: str, views: dict[str, tuple[int, int]], largest: int, digits: int, rows: int | None = None) -> DataFrame:
    """(group, view, value, n): how many unordered pairs of a group have each rounded cosine, in units of the last digit.
    Pairs without a cosine aren't counted; no pair leaves its task."""
    known = df.select(group, key, vector).where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(vector).isNotNull())
    dealt = block_pairs(known, group, key, largest, rows or block_rows(largest))
    outputs = {v: (lambda *c, k=k: c[k], digits) for k, v in enumerate(views)}
    scale = 10**digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        p, q = table.column("_p")[0].as_py(), table.column("_q")[0].as_py()
        block = table.column("_b").to_numpy()
        one, two = (table.filter(pa.array(block == k)) for k in (p, q))
        if not one.num_rows or not two.num_rows:
            return
        (v, _), (w, _) = vectors_of(one, vector), vectors_of(two, vector)
        left, right = one.column(key).to_numpy(), two.column(key).to_numpy()
        a, b = [units(v[:, lo:hi]) for lo, hi in views.values()], [np.ascontiguousarray(units(w[:, lo:hi]).T) for lo, hi in views.values()]
        total = np.zeros((len(views), 2 * scale + 1), np.int64)
        for at in tiles(len(left), len(right)):
            keep = left[at, None] < right[None, :] if p == q else left[at, None] != right[None, :]
            for k, r in enumerate(rounded_cosines([x[at] for x in a], b, outputs)):
                total[k] += np.bincount(r[keep].astype(np.int64) + scale, minlength=2 * scale + 1)
        k, value = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.repeat(table.column(group)[0], len(k)), pa.array(np.array(list(views))[k]), pa.array(value - scale), pa.array(total[k, value])], names=[group, "view", "value", "n"])

    kind = df.schema[group].dataType.simpleString()
    got = dealt.groupBy(group, "_p", "_q").applyInArrow(run, f"`{group}` {kind}, view string, value bigint, n bigint")
    return got.groupBy(group, "view", "value").agg(F.sum("n").alias("n"))


def kind_pairs(df: DataFrame, group: str, key: str, columns: list[str], output: Callable, largest: int, name: str = "sim", digits: int = 6, rows: int | None = None) -> DataFrame:
    """(group, i, j, ``name``) where the value depends only on some columns, which rows share: ``output`` gets the distinct
    rows of these of either side, as lists of tuples (arrays as sets), and gives a matrix, masked where a value is null. So
    a value is computed once per two kinds of rows of two blocks. Tasks of Python give, per kind of one side and piece of the
    other, their keys and values as lists, and only built-in functions make rows of pairs."""

    def places(t: pa.Table) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """The kinds, and the rows' kinds and keys by kind and key."""
        cols = [[frozenset(v) if isinstance(v, list) else v for v in t.column(c).to_pylist()] for c in columns]
        place: dict[tuple, int] = {}
        of = np.array([place.setdefault(k, len(place)) for k in zip(*cols, strict=True)], np.int64)
        keys = t.column(key).to_numpy()
        order = np.lexsort((keys, of))
        return list(place), of[order], keys[order]

    def rounded(m: np.ndarray) -> np.ndarray:
        flat = np.ma.getdata(m)
        r = np.rint(flat * 10.0**digits)
        for i, j in np.argwhere(np.abs(flat * 10.0**digits - r) > 0.5 - 1e-6):
            r[i, j] = _half_up(float(flat[i, j]), digits)
        table = (r + 0.0) / 10.0**digits
        return np.ma.masked_array(table, np.ma.getmaskarray(m)) if np.ma.isMaskedArray(m) else table

    def lists(flat: pa.Array, sizes: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        own, p, q = table.column(group)[0], table.column("_p")[0].as_py(), table.column("_q")[0].as_py()
        block = table.column("_b").to_numpy()
        (left, of_left, i), (right, of_right, j) = (places(table.filter(pa.array(block == k))) for k in (p, q))
        for u in range(0, len(left), KINDS):
            for v in range(0, len(right), KINDS):
                values = rounded(output(left[u : u + KINDS], right[v : v + KINDS]))
                ours, theirs = (slice(*np.searchsorted(of, [at, at + KINDS])) for of, at in ((of_left, u), (of_right, v)))
                by_key = np.argsort(j[theirs], kind="stable")
                x, kind_x, y, kind_y = i[ours], of_left[ours] - u, j[theirs][by_key], of_right[theirs][by_key] - v
                for at in range(0, len(y), PIECE):
                    some, kind = y[at : at + PIECE], kind_y[at : at + PIECE]
                    lower = x < some[-1] if p == q else np.ones(len(x), bool)  # in one block, keys that have larger ones here
                    a, n = x[lower], np.bincount(kind_x[lower])
                    # so many keys of a kind at a time meet the piece
                    sizes = np.concatenate([np.full(-(-m // PIECE), PIECE) - np.append(np.zeros(-(-m // PIECE) - 1, int), -m % PIECE) for m in n[n > 0]]) if len(a) else n[:0]
                    own_kind, start = np.repeat(np.flatnonzero(n), -(-n[n > 0] // PIECE)), np.cumsum(sizes) - sizes
                    for lo in range(0, len(sizes), PIECE):
                        size, got = sizes[lo : lo + PIECE], values[own_kind[lo : lo + PIECE, None], kind[None, :]]
                        m, first = len(size), start[lo]
                        each, flat = np.full(m, len(some)), np.ma.getdata(got).ravel()
                        cells = pa.array(flat, mask=np.ma.getmaskarray(got).ravel()) if np.ma.isMaskedArray(got) else pa.array(flat)
                        yield pa.RecordBatch.from_arrays([pa.repeat(own, m), pa.array([p == q] * m), lists(pa.array(a[first : first + size.sum()]), size), lists(pa.array(np.tile(some, m)), each), lists(cells, each)], names=[group, "_same", "_a", "_c", "_v"])

    dealt = block_pairs(df.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select(group, key, *columns), group, key, largest, rows or block_rows(largest))
    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, key)}
    met = dealt.groupBy(group, "_p", "_q").applyInArrow(run, f"`{group}` {kinds[group]}, _same boolean, _a array<{kinds[key]}>, _c array<{kinds[key]}>, _v array<double>")
    # a row of its own per key on one side before the other side's are made: what a row gives is held until it is passed on
    one = met.select(group, "_same", F.explode("_a").alias("_i"), "_c", "_v").coalesce(MOST_PARTITIONS)
    two = one.select(group, "_same", "_i", "_v", F.posexplode("_c").alias("_at", "_j")).where("not _same or _i < _j")
    return two.select(group, F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), F.get("_v", F.col("_at")).alias(name))


def jaccards(a: list[frozenset], b: list[frozenset], empty: float | None = 1.0) -> np.ndarray:
    """Overlaps of all sets of one list with all of another; ``empty`` for two empty ones (None: null)."""
    place = {x: k for k, x in enumerate(frozenset().union(*a, *b))}

    def holds(sets: list[frozenset]) -> np.ndarray:
        m = np.zeros((len(sets), len(place)))
        for k, one in enumerate(sets):
            m[k, [place[x] for x in one]] = 1
        return m

    x, y = holds(a), holds(b)
    both = x @ y.T
    union = x.sum(1)[:, None] + y.sum(1)[None, :] - both
    out = np.divide(both, union, out=np.full(both.shape, 0.0 if empty is None else empty), where=union > 0)
    return np.ma.masked_array(out, union == 0) if empty is None else out


def alike(a: list, b: list) -> np.ndarray:
    """Whether values are equal, as 1 and 0; null where either is."""
    place = {x: k for k, x in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([place[v] for v in side]) for side in (a, b))
    none = np.array([v is None for v in a])[:, None] | np.array([v is None for v in b])[None, :]
    return np.ma.masked_array((x[:, None] == y[None, :]).astype(float), none)


def _dealt_asks(known: DataFrame, group: str, key: str, largest: int, rows: int, others: int, cells: list[str], own: list[str]) -> tuple[DataFrame, int]:
    """Rows as queries, once per stretch of their group's blocks, and as what these meet, once per block of queries; a
    stretch has some ``others`` rows. Columns ``own`` are the queries'. Also the number of stretches."""
    dealt, n = _blocks(known, group, key, largest, rows)
    per = max(1, others // rows)
    parts = -(-n // per)
    upto = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    asks = F.transform(upto(parts), lambda k: F.struct(F.lit(True).alias("asks"), F.col("_b").alias("p"), k.alias("r")))
    met = F.transform(upto(n), lambda p: F.struct(F.lit(False).alias("asks"), p.alias("p"), F.floor(F.col("_b") / per).cast("int").alias("r")))
    dealt = dealt.select(group, key, *cells, *own, F.inline(F.concat(asks, met)))
    return dealt.select(group, key, *cells, *[F.when(F.col("asks"), F.col(c)).alias(c) for c in own], "asks", "p", "r"), parts


#: Stands for the rounded cosine of a row without a vector: it comes after all others.
NO_COSINE = -(2**15)


def asked(df: DataFrame, group: str, key: str, vector: str, views: dict[str, tuple[int, int, int]], largest: int, answer: Callable, columns: dict[str, str], own: tuple[str, ...] = (), rows: int = PAIR_ROWS, others: int = COUNT_ROWS) -> DataFrame:
    """(group, q, columns): what ``answer`` gives for each row as a query against a stretch of the other rows of its group,
    so a row comes once per stretch, of which there is one up to ``others`` rows; nothing of a pair leaves its task.

    ``answer(q, own values, keys, cosines)`` gets the query's key, its row of the columns ``own``, the other rows' keys in
    ascending order and per view their rounded cosines in units of the last digit (NO_COSINE without a vector); it gives a
    list of rows."""
    known = df.where(F.col(group).isNotNull() & F.col(key).isNotNull())
    dealt, _ = _dealt_asks(known, group, key, largest, rows, others, [vector], list(own))
    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, key)}
    outputs = {v: (lambda *c, k=k: c[k], d) for k, (v, (_, _, d)) in enumerate(views.items())}
    names = ["q", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        ask = table.column("asks").to_numpy()
        one, two = table.filter(pa.array(ask)), table.filter(pa.array(~ask)).sort_by(key)
        if not one.num_rows or not two.num_rows:
            return
        (v, no_left), (w, no_right) = vectors_of(one, vector), vectors_of(two, vector)
        if v.shape[1] != w.shape[1]:  # one side has no vector at all
            width = max(v.shape[1], w.shape[1])
            v, w = (x if x.shape[1] else np.zeros((len(x), width)) for x in (v, w))
        left, right, given = one.column(key).to_pylist(), two.column(key).to_numpy(), [one.column(c).to_pylist() for c in own]
        a, b = [units(v[:, lo:hi]) for lo, hi, _ in views.values()], [np.ascontiguousarray(units(w[:, lo:hi]).T) for lo, hi, _ in views.values()]
        got: list[tuple] = []
        step = 16
        for start in range(0, len(left), step):
            at = slice(start, start + step)
            codes = [np.empty((len(left[at]), len(right)), np.int16) for _ in views]
            for lo in range(0, len(right), TILE // step):
                some = slice(lo, lo + TILE // step)
                for code, r in zip(codes, rounded_cosines([x[at] for x in a], [y[:, some] for y in b], outputs), strict=True):
                    code[:, some] = r
            for code in codes:
                code[no_left[at, None] | no_right[None, :]] = NO_COSINE
            for k, q in enumerate(left[at]):
                other = right != q
                got += [(q, *row) for row in answer(q, tuple(c[start + k] for c in given), right[other], [code[k][other] for code in codes])]
        if got:
            schema = pa.schema([(c, {"bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}[kind]) for c, kind in zip(names, [kinds[key], *columns.values()], strict=True)])
            out = [pa.array(list(c), f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.repeat(table.column(group)[0], len(got)), *out], names=[group, *names])

    return dealt.groupBy(group, "p", "r").applyInArrow(run, f"`{group}` {kinds[group]}, q {kinds[key]}, " + ", ".join(f"`{c}` {k}" for c, k in columns.items()))


def neighbour_counts(df: DataFrame, group: str, key: str, vector: str, views: dict[str, tuple[int, int, int]], largest: int, kind: str | None = None, rows: int = PAIR_ROWS, others: int = COUNT_ROWS) -> DataFrame:
    """(group, q, a value per view, n): how many other rows of its group have these cosines to row q, each view's rounded
    to its number of digits: (start, stop, digits). Rows without a vector are left out. With ``kind``, a whole number of each row, of
    which there are few, the other rows count apart by it, and it is a column.

    A block of queries meets some ``others`` rows in a task; the counts of a group's stretches are then added up."""
    more = [kind] if kind else []
    known = df.select(group, key, vector, *more).where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(vector).isNotNull())
    dealt, parts = _dealt_asks(known, group, key, largest, rows, others, [vector, *more], [])
    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, key)}
    schema = f"`{group}` {kinds[group]}, q {kinds[key]}, " + ", ".join(f"`{v}` double" for v in views) + "".join(f", `{c}` bigint" for c in more) + ", n bigint"
    names = [group, "q", *views, *more, "n"]
    scales = [10**d for _, _, d in views.values()]
    sides = [2 * s + 1 for s in scales]
    bins = int(np.prod(sides))
    outputs = {v: (lambda *c, k=k: c[k], d) for k, (v, (_, _, d)) in enumerate(views.items())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        ask = table.column("asks").to_numpy()
        if ask.all() or not ask.any():
            return
        keys, (v, _) = table.column(key).to_numpy(), vectors_of(table, vector)
        left, right = keys[ask], keys[~ask]
        parted = [units(v[:, lo:hi]) for lo, hi, _ in views.values()]
        a, b = [x[ask] for x in parted], [np.ascontiguousarray(x[~ask].T) for x in parted]
        known, of = np.unique(table.column(kind).to_numpy()[~ask] if kind else np.zeros(len(right), np.int64), return_inverse=True)
        step, places = 16, bins * len(known)
        for start in range(0, len(left), step):
            at = slice(start, start + step)
            m = len(left[at])
            code = np.empty((m, len(right)), np.int64)
            for lo in range(0, len(right), TILE // step):
                some = slice(lo, lo + TILE // step)
                c = np.arange(m)[:, None] * len(known) + of[None, some]
                for r, scale, side in zip(rounded_cosines([x[at] for x in a], [y[:, some] for y in b], outputs), scales, sides, strict=True):
                    c = c * side + (r.astype(np.int64) + scale)
                code[:, some] = c
            total = np.bincount(code[left[at, None] != right[None, :]], minlength=m * places)
            cell = np.flatnonzero(total)
            i, c = np.divmod(cell, places)
            own_kind, c = np.divmod(c, bins)
            values = []
            for scale, side in reversed(list(zip(scales, sides, strict=True))):
                values.append(pa.array((c % side - scale) / scale))
                c = c // side
            yield pa.RecordBatch.from_arrays([pa.repeat(table.column(group)[0], len(cell)), pa.array(left[at][i]), *reversed(values), *[pa.array(known[own_kind].astype(np.int64)) for _ in more], pa.array(total[cell])], names=names)

    got = dealt.groupBy(group, "p", "r").applyInArrow(run, schema)
    return got if parts == 1 else got.groupBy(group, "q", *views, *more).agg(F.sum("n").alias("n"))
