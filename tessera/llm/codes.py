"""Vector codes by product quantisation, with codebooks from Lloyd rounds that are maintained by differences.

Vectors become integers and are cut into PARTS equal parts, each with a codebook of up to ENTRIES entries. All is integer
arithmetic, so results don't depend on order or partitioning. The assignments of a round are written beside the vectors;
the next round compares its own with them, and only parts whose assignment has changed give a contribution: minus at the
old entry, plus at the new one. These are added up in tasks, then by entry, and added to running sums; PARTS * ENTRIES
rows at most reach the driver. A round in which nothing changes ends the search, as all later ones would be alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import last_table, lookup_join, materialize, nullable_key, quoted, remove_tables

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024


def integers(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, int]:
    """(id, label, q) of the usable vectors with components floor(scale * x), and their length.

    Vectors that are null, or hold a null or non-finite component, go. So do those without components and those of
    another length than most have (of two lengths as frequent the longer). Squared distances must fit in 63 bits, and the
    parts must be equal: other tables are refused with an error."""
    v = quoted(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select(quoted(id_col).alias("id"), quoted(label_col).alias("label"), v.alias("v")).where(v.isNotNull() & ~bad & (F.size(v) > 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes.d if sizes else 0
    if d % parts:
        raise ValueError(f"vectors of {d} components can't be cut into {parts} equal parts")
    most = int((2**62 / max(d, 1)) ** 0.5) // 2
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(F.col("v"), lambda x: F.abs(x.cast("double") * scale) <= most)
    q = F.when(fits, whole).otherwise(F.raise_error(F.lit(f"components beyond {most} / {scale} have distances of over 63 bits")))
    return rows.where(F.size("v") == d).select("id", "label", q.cast("array<bigint>").alias("q")), d


def nearest(q: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry of each part; ties to the lower index. q: rows x parts x width."""
    top = (np.abs(q).max(initial=0) + np.abs(books).max(initial=0)) ** 2 * q.shape[2]
    kind = np.float64 if top < 2**52 else np.int64  # both exact
    at, far = np.empty(q.shape[:2], np.int64), np.empty(q.shape[:2], np.int64)
    for p in range(q.shape[1]):
        x, c = q[:, p].astype(kind), books[p].astype(kind)
        dist = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        at[:, p] = dist.argmin(1)
        far[:, p] = np.take_along_axis(dist, at[:, p : p + 1], 1)[:, 0]
    return at, far


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` (id, label, q, and code if there was a round before) as (id, label, q, before, code, error)."""
    sent = rows.sparkSession.sparkContext.broadcast(books)
    parts, width = books.shape[0], books.shape[2]
    old = "code" in rows.columns
    given = rows.select("id", "label", "q", F.col("code" if old else "q").alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, parts, width)
            code, error = nearest(q, sent.value)
            starts = pa.array(np.arange(b.num_rows + 1) * parts, pa.int32())
            code = pa.ListArray.from_arrays(starts, pa.array(code.ravel().astype(np.int32)))
            before = b.column(3) if old else pa.nulls(b.num_rows, code.type)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), before, code, pa.array(error.sum(1))], names=["id", "label", "q", "before", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return given.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, q array<bigint>, before array<int>, code array<int>, error bigint")


def contributions(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """(part, entry, n, sums): what parts whose assignment has changed take from their old entry and add to their new one."""
    at = rows.select("q", "before", "code", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    old, new = F.get("before", "part"), F.get("code", "part")
    moved = at.select("part", F.slice("q", F.col("part") * width + 1, width).alias("x"), old.alias("old"), new.alias("new")).where(~old.eqNullSafe(new))
    signed = moved.select("part", "x", F.inline(F.array(F.struct(F.col("old").alias("entry"), F.lit(-1).cast("bigint").alias("sign")), F.struct(F.col("new").alias("entry"), F.lit(1).cast("bigint").alias("sign"))))).where("entry is not null")
    sums = [F.sum(F.get("x", F.lit(k)) * F.col("sign")).alias(f"s{k}") for k in range(width)]
    return signed.groupBy("part", "entry").agg(F.sum("sign").alias("n"), *sums).select("part", "entry", "n", F.array(*[f"s{k}" for k in range(width)]).alias("sums"))


def train(rows: DataFrame, d: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """Codebooks (parts x entries x width) and the written vectors with the last round's assignments. The first entries
    are the parts of the vectors with the smallest ids (null ids last, equal ids by vector)."""
    width = d // parts
    first = rows.orderBy(F.asc_nulls_last("id"), "q").limit(entries).collect()
    books = np.array([r.q for r in first], np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    n, sums, held = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64), None
    for _ in range(rounds):
        rows = materialize(assigned(rows, books), "codes")
        if held:
            remove_tables(rows.sparkSession, [held])
        held = last_table(rows.sparkSession)
        changes = contributions(rows, parts, width).collect()
        if not changes:
            break
        for r in changes:
            n[r.part, r.entry] += r.n
            sums[r.part, r.entry] += np.array(r.sums, np.int64)
        used = n > 0
        books[used] = sums[used] // n[used][:, None]
    return books, rows


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per usable vector (``integers``): id, code (two hex digits per part), error (squared distances to its
    entries), label_error (error summed over the label, null labels together), codebooks_sha256.

    Repeated rows and ids each come back and count each; null ids come last where the first entries are chosen. With
    fewer vectors than entries the codebooks are shorter. An empty table gives none; other columns are left out."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits, so a codebook up to 256 entries")
    rows, d = integers(vectors, scale, parts, id_col, vector_col, label_col)
    books, rows = train(rows, d, parts, entries, rounds) if d else (np.zeros((parts, 0, 0), np.int64), rows)
    if not d:
        out = rows.select("id", "label", F.array().cast("array<int>").alias("code"), F.lit(0).cast("bigint").alias("error"))
    else:
        out = assigned(rows, books).select("id", "label", "code", "error")
    out = materialize(out.withColumn("key", nullable_key(F.col("label"))), "codes-final")
    labels = out.groupBy("key").agg(F.sum("error").alias("label_error"))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return lookup_join(out, materialize(labels, "codes-labels"), "key", "inner").select(F.col("id").alias(id_col), code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same rounds in SQL, all parts against all entries in each."""
    w, steps = "(select d // 4 from size)", []
    for r in range(ROUNDS + 1):
        steps.append(
            f"""a{r} as materialized (select rid, part, any_value(p.x) as x, min((xx - 2 * list_inner_product(p.x, c.x) + cc)::bigint * 256 + entry) as best
  from p join (select *, list_inner_product(x, x) as cc from c{r}) c using (part) group by rid, part)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""m{r} as (select part, best % 256 as entry, k, floor(sum(x[k]) / count(*)) as y from a{r}, (select unnest(range(1, {w} + 1)) as k) group by 1, 2, 3),
c{r + 1} as materialized (select c.part, c.entry, coalesce(y, c.x) as x from c{r} c left join (select part, entry, list(y order by k) as y from m{r} group by 1, 2) m on c.part = m.part and c.entry = m.entry)"""
            )
    return f"""
with good as (select vec_id, label, embedding from embeddings where len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
size as (select len(embedding) as d from good group by d order by count(*) desc, d desc limit 1),
v as materialized (select row_number() over (order by vec_id nulls last, q) as rid, * from (select vec_id, label, list_transform(embedding, lambda x: floor(x::double * 1024)) as q
  from good where len(embedding) = (select d from size))),
p as materialized (select rid, part, q[part * {w} + 1 : part * {w} + {w}] as x, list_inner_product(q[part * {w} + 1 : part * {w} + {w}], q[part * {w} + 1 : part * {w} + {w}]) as xx from v, range(4) r(part)),
c0 as (select part, rid - 1 as entry, x from p where rid <= 256),
{''',
'''.join(steps)},
h as (select sha256(string_agg(y::bigint::varchar, ',' order by part, entry, k)) as s from (select part, entry, unnest(x) as y, generate_subscripts(x, 1) as k from c{ROUNDS})),
f as (select rid, string_agg(printf('%02x', best % 256), '' order by part) as code, sum(best // 256)::bigint as error from a{ROUNDS} group by rid)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select s from h) as codebooks_sha256 from f join v using (rid)
"""


ORACLE_SQL = _sql()
