"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document has a place in its source's shuffled queue. Its virtual finish time is the source's cumulative words up
to and with it, divided by the source's target. A queue is gone through up to three times. Entries are taken in the
order of their finish times, all sources together, up to the total budget.

No queue stands in one task: a source is cut into bins of the shuffle's hash, so many that each has about BIN_ROWS
documents, and sums run over the bins' totals first. The global order is cut into bins of virtual time in the same way;
only the bin in which the budget ends is looked at entry by entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SENT_KEYS, free_name, lookup_join, materialize, nullable_key, quoted, scratch

WEIGHTS = (5, 2, 1)
#: A document is taken so many times at most.
MAX_REPEATS = 3
BIN_ROWS = 4_000
TIME_BINS = 1 << 12
SPREAD = 1 << 60


def size_of(text: Column) -> Column:
    """Number of words: runs of anything but the six ASCII white space characters; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def spread(key: Column) -> Column:
    """15 hexadecimal digits of MD5 as a number: the shuffle's order, the same in any engine."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0) -> DataFrame:
    """(source, source_size, n_docs, target, rank) of each source, from rows (source, size).

    Sources in code point order, null last, have the weights in turn. The budget is ``share`` of all sizes; a target is
    at most MAX_REPEATS times its source's size and what is over is shared again by weight. In the order of size by
    weight, a source is capped just if its cap is within its part of what the sources before it left."""
    w = F.lit(list(weights))
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    src = src.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    src = src.withColumn("w", F.element_at(w, (F.col("rank") % len(weights) + 1).cast("int")).cast("double")).withColumn("cap", (MAX_REPEATS * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before, rest, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = src.withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    src = src.withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("rank"), F.col("level")))).over(everything)
    src = src.withColumn("free", level["level"])
    return src.select("source", "source_size", "n_docs", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("free") * F.col("w"))).alias("target"), "rank")


def queued(docs: DataFrame, tie: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row's id, size and tie with its source's size and target, and ``cum``, the words of its queue up to and with
    it. ``tie`` tells rows apart that are alike in id and size. No text goes further than its size."""
    tie = F.lit(0).cast("bigint") if tie is None else tie
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), tie.alias("tie"))
    key = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size").cast("string"))
    rows = materialize(sized.withColumn("h", spread(key)), "mixing")
    sources = materialize(source_targets(rows, weights, share), "mixing-sources").withColumn("key", nullable_key(F.col("source"))).drop("source")
    rows = lookup_join(rows.withColumn("key", nullable_key(F.col("source"))), sources, "key")
    bins = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BIN_ROWS))
    rows = rows.withColumn("bin", F.floor(F.col("h") / (F.lit(SPREAD) / bins)).cast("long"))
    totals = rows.groupBy("rank", "bin").agg(F.sum("size").alias("sum"))
    start = totals.withColumn("start", F.sum("sum").over(Window.partitionBy("rank").orderBy("bin")) - F.col("sum")).drop("sum")
    inside = Window.partitionBy("rank", "bin").orderBy("h", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.sum("size").over(inside)).join(start, ["rank", "bin"])
    return rows.withColumn("cum", F.col("start") + F.col("own"))


def entries(queue: DataFrame) -> DataFrame:
    """(rank, size, place, time) of each entry that could be taken: sized rows, once for each time through the queue."""
    once = queue.where("size > 0 and target > 0").select("rank", "size", "cum", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))).alias("e"))
    place = F.col("e") * F.col("source_size") + F.col("cum")
    return once.select("rank", "size", place.alias("place"), (place / F.col("target")).alias("time")).where("place - size < 2 * target")


def last_taken(queue: DataFrame, budget: int) -> tuple[float, int]:
    """(time, rank) of the last entry that the budget holds, in the order of time and then rank.

    Two histograms of virtual time find the stretch in which the budget ends; each collects TIME_BINS rows at most."""
    rows = entries(queue)
    low, width, used = 0.0, 2.0 / TIME_BINS, 0
    for _ in range(2):
        part = rows.where((F.col("time") >= low) & (F.col("time") < low + width * TIME_BINS))
        bins = part.groupBy(F.least(F.floor((F.col("time") - low) / width), F.lit(TIME_BINS - 1)).alias("b")).agg(F.sum("size").alias("s"), F.min("time").alias("from"), F.max("time").alias("to"))
        for r in sorted(bins.collect(), key=lambda r: r.b):
            if used + r.s > budget:
                low, high = r["from"], r["to"]
                break
            used += r.s
        else:
            return float("inf"), 0
        width = max((high - low) * (1 + 1e-9) / TIME_BINS, 1e-300)
        if high == low:
            break
    # what is left is a thin stretch of virtual time
    tail = rows.where((F.col("time") >= low) & (F.col("time") <= high))
    run = tail.withColumn("run", F.lit(used) + F.sum("size").over(Window.orderBy("time", "rank").rowsBetween(Window.unboundedPreceding, 0)))
    first = run.where(F.col("run") > budget).orderBy("time", "rank").select("time", "rank").first()
    return (first["time"], first["rank"] - 1) if first else (high, 1 << 30)


def queue_of(docs: DataFrame, tie: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``queued`` with ``times``: how often the mix takes a row."""
    queue = materialize(queued(docs, tie, weights, share, id_col, text_col, source_col), "mixing-queue")
    total = queue.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    time, rank = last_taken(queue, int(total * share))
    place = lambda e: F.lit(e) * F.col("source_size") + F.col("cum")
    at = lambda e: place(e) / F.nullif(F.col("target"), F.lit(0.0))
    times = sum(((F.coalesce((at(e) < time) | ((at(e) == time) & (F.col("rank") <= rank)), F.lit(False)) & (place(e) - F.col("size") < 2 * F.col("target"))).cast("long") for e in range(MAX_REPEATS)), F.lit(0).cast("long"))
    return queue.withColumn("times", F.when(F.col("size") > 0, times).otherwise(0))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken (words, repeats counted).

    Null sources are a source of their own, the last. Texts without words take nothing. Repeated rows have places of
    their own, in the order of id and size, so runs agree. An empty table gives none."""
    queue = queue_of(docs, None, weights, share, id_col, text_col, source_col)
    return queue.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns.

    The queue knows rows by a key of id and a hash of all other columns; what is taken comes back to the rows by that
    key. A row's texts are shuffled only if over SENT_KEYS keys are taken. Rows alike in everything are one
    key: one of them comes back as often as all of them are taken."""
    key, times, alike = (free_name(docs.columns, n) for n in ("_key", "_times", "_alike"))
    tie = F.xxhash64(*[quoted(c) for c in docs.columns if c != id_col])
    with scratch(docs.sparkSession):
        queue = queue_of(docs, tie, weights, share, id_col, text_col, source_col).select(_row_key(F.col("id"), F.col("tie")).alias(key), "times")
        taken = materialize(queue.groupBy(key).agg(F.sum("times").cast("int").alias(times), F.count("*").alias(alike)).where(F.col(times) > 0), "mixing-taken")
        rows = lookup_join(docs.withColumn(key, _row_key(quoted(id_col), tie)), taken, key, "inner", limit=SENT_KEYS, counted=queue.select(key))
    if not taken.where(F.col(alike) > 1).isEmpty():
        rows = rows.where(F.col(alike) == 1).unionByName(rows.where(F.col(alike) > 1).dropDuplicates([key]))
    return rows.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*map(quoted, docs.columns))


def _row_key(key: Column, tie: Column) -> Column:
    return F.concat(nullable_key(key), F.lit(":"), tie.cast("string"))


ORACLE_SQL = r"""
with d as (select row_number() over () as row, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s0 as (select source, sum(size)::bigint as ss from d group by source),
s1 as (select *, row_number() over (order by source nulls last) - 1 as rank from s0),
s2 as (select *, [5.0, 2.0, 1.0][(rank % 3 + 1)::int]::double as w, (3 * ss)::double as cap from s1),
s3 as (select *, (sum(ss) over ()::double - coalesce(sum(cap) over (order by cap / w, rank rows between unbounded preceding and 1 preceding), 0.0))
  / sum(w) over (order by cap / w, rank rows between current row and unbounded following) as level from s2),
s4 as (select *, cap <= level * w as capped from s3),
f as (select level from s4 where not capped order by cap / w, rank limit 1),
s as (select source, ss, rank, case when capped then cap else least(cap, (select level from f) * w) end as target from s4),
q as (select d.*, ss, rank, target, sum(size) over (partition by rank order by ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || size), 1, 15))::bigint, doc_id nulls first, size
  rows unbounded preceding) as cum from d join s on d.source is not distinct from s.source),
e as (select row, size, rank, (e * ss + cum) as place, (e * ss + cum) / target as time, target from q, range(0, 3) r(e) where size > 0 and target > 0),
t as (select row, size, sum(size) over (order by time, rank rows unbounded preceding) as run from e where place - size < 2 * target),
k as (select row, count(*) as n from t where run <= (select sum(size) from d) group by row)
select doc_id, size, ss as source_size, target, (size * coalesce(n, 0))::bigint as taken from q left join k on q.row = k.row
"""
