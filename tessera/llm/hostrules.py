"""Quality rules by host: base rules per document, failure rates per host shrunk by an empirical beta prior."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, materialize, nullable_key

MIN_WORDS = 50
#: Base rule: more than this share of the words stands in 3-word windows that come twice or more.
MAX_REPEAT = 0.5
#: A host is rejected if its shrunken failure rate is over this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's strength, in documents.
STRENGTH = (1.0, 1000.0)
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """The five counts of NAMES over a whole text; zeros for a null or empty one."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the six ASCII white space characters
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    covered = last = 0
    if len(seen) < len(windows):
        for i, w in enumerate(windows):
            if seen[w] > 1:
                covered += i + 3 - max(i, last)
                last = i + 3
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), covered


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, the five counts, base_failed) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = list(zip(*(base_counts(t.as_py()) for t in b.column(2)), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in counts)], names=["id", "host", *NAMES])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), nullable_key(F.col(host_col)).alias("host"), F.col(text_col).alias("t"))
    out = picked.mapInArrow(run, f"id {kind}, host string, " + ", ".join(f"{c} bigint" for c in NAMES))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > F.lit(round(100 * MAX_REPEAT)) * F.col("n_words")))


def host_verdicts(failures: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, host_rate, host_kept) from rows (host, base_failed).

    The prior Beta(m s, (1 - m) s) has the pooled rate m; its strength s comes from the hosts' spread beyond sampling
    noise (method of moments), held within STRENGTH. Only one row per host and task is shuffled."""
    hosts = failures.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("k"))
    total = hosts.agg(F.sum("n").alias("nn"), F.sum("k").alias("kk"), F.count("*").alias("hh"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("sq"))
    m = F.col("kk") / F.col("nn")
    total = total.withColumn("m", m).withColumn("between", F.col("sq") / F.col("nn") - m * m - m * (1 - m) * F.col("hh") / F.col("nn"))
    s = F.when(F.col("between") > 0, F.least(F.lit(STRENGTH[1]), F.greatest(F.lit(STRENGTH[0]), F.col("m") * (1 - F.col("m")) / F.nullif(F.col("between"), F.lit(0.0)) - 1))).otherwise(F.lit(STRENGTH[1]))
    prior = total.select("m", s.alias("s"))  # a single row
    rate = F.round((F.col("k") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s")), 6)
    return hosts.join(F.broadcast(prior)).select("host", rate.alias("host_rate")).withColumn("host_kept", F.col("host_rate") <= max_rate)


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, the five counts, base_failed, host_rate, kept.

    A null host is a host of its own; null and empty texts have no words and fail. Repeated rows each count and come
    back. An empty table gives none."""
    rows = materialize(base_rules(docs, id_col, text_col, host_col), "hostrules")
    out = lookup_join(rows, materialize(host_verdicts(rows), "hostrules-hosts"), "host")
    return out.select(F.col("id").alias(id_col), *NAMES, "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"), "host_rate")


ORACLE_SQL = r"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
tri as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from tri) where c > 1),
cov as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from rep) group by rid),
b as (select w.rid, doc_id, source, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
  coalesce(cov.n, 0)::bigint as n_repeat_words from w left join cov on w.rid = cov.rid),
f as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from b),
h as (select source, count(*)::double as n, sum(base_failed::int)::double as k from f group by source),
t as (select sum(k) / sum(n) as m, sum(k * k / n) / sum(n) as q, count(*) / sum(n) as r from h),
v as (select m, q - m * m - m * (1 - m) * r as between_ from t),
s as (select m, case when between_ > 0 then least(1000.0, greatest(1.0, m * (1 - m) / between_ - 1)) else 1000.0 end as s from v),
rates as (select source, round((k + m * s) / (n + s), 6)::double as host_rate from h, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and host_rate <= 0.5) as kept, host_rate
from f join rates on f.source is not distinct from rates.source
"""
