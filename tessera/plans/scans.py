"""S: scans, sources and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import unit
from tessera.operators import checks as chk
from tessera.sources import blocks as blk
from tessera.sources import tables as src
from tessera.sources.shared import new_path, store

from .base import Tables, query, r6


def scratch(t: Tables, name: str) -> str:
    """A new path in the folder that all executors share."""
    return new_path(t.spark, f"scratch-{name}")


@query("s01_csv_scan", "select n_nationkey::bigint as n_nationkey, n_name from nation")
def s01(t: Tables) -> DataFrame:
    path = scratch(t, "csv")
    t.nation.write.csv(path, header=True)
    return src.read_csv(t.spark, path, "n_nationkey bigint, n_name string, n_regionkey bigint").select("n_nationkey", "n_name")


@query("s02_text_table", "select r_regionkey::varchar as r_regionkey, r_name, '' as note from region")
def s02(t: Tables) -> DataFrame:
    path = scratch(t, "tsv")
    src.write_table(t.region.withColumn("note", F.lit("")), path)
    return src.read_text_table(t.spark, path).select("r_regionkey", "r_name", "note")


#: Sides of the blocks of the order-by-line matrix.
ROWS, LINES = 1_024, 4


def order_blocks(t: Tables) -> tuple[DataFrame, int]:
    """The matrix of orders by line numbers as written blocks, and its number of rows."""
    n = (t.lineitem.agg(F.max("l_orderkey").alias("m")).first().m or 0) + 1
    path = scratch(t, "blocks")
    blk.write_blocks(blk.to_blocks(t.lineitem, "l_orderkey", "l_linenumber", "l_quantity", n, ROWS, LINES), path)
    return blk.read_blocks(t.spark, path), n


@query("s03_long_matrix", "select l_orderkey as cell, l_linenumber::bigint as feature, l_quantity as value from lineitem where l_quantity <> 0")
def s03(t: Tables) -> DataFrame:
    return blk.to_long(order_blocks(t)[0]).toDF("cell", "feature", "value")


@query("s04_row_selection", "select l_orderkey, l_linenumber::bigint as l_linenumber, l_quantity from lineitem where l_quantity <> 0 and l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT')")
def s04(t: Tables) -> DataFrame:
    wanted = t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return blk.select_majors(order_blocks(t)[0], wanted, "o_orderkey", ROWS).toDF("l_orderkey", "l_linenumber", "l_quantity")


@query("s04b_row_range", "select l_orderkey, l_linenumber::bigint as l_linenumber, l_quantity from lineitem where l_quantity <> 0 and l_orderkey >= 700 and l_orderkey < 3100")
def s04b(t: Tables) -> DataFrame:
    return blk.row_range(order_blocks(t)[0], 700, 3100).toDF("l_orderkey", "l_linenumber", "l_quantity")


@query("s05_column_selection", "select l_orderkey, l_linenumber::bigint as feature, l_quantity from lineitem where l_quantity <> 0 and l_linenumber in (1, 3)")
def s05(t: Tables) -> DataFrame:
    return blk.select_minors(order_blocks(t)[0], [1, 3], LINES).toDF("l_orderkey", "feature", "l_quantity")


@query("s06_layout_check", f"""with b as (select distinct l_orderkey // {ROWS} as k from lineitem where l_quantity <> 0 and l_linenumber < {LINES}), n as (select max(l_orderkey) // {ROWS} as last from lineitem), k as (select unnest(range(0, last + 1)) as k from n)
  select 'canonical' as layout, 'none' as problem, 0::bigint as n union all select 'planted', 'bounds', count(*)::bigint from b where k % 5 = 1 having count(*) > 0
  union all select 'planted', 'gap', count(*)::bigint from k, n where k % 5 <> 2 and ((k > 0 and (k - 1) % 5 = 2) or (k = last - 1 and last % 5 = 2)) having count(*) > 0""")
def s06(t: Tables) -> DataFrame:
    # the table as written has no fault; with minors moved in some blocks and other blocks taken out, those are reported
    table, n = order_blocks(t)
    k = F.col("major_block") % 5
    planted = table.where(k != 2).withColumn("minors", F.when((k == 1) & (F.col("minor_block") == 0), F.transform("minors", lambda j: j + 1_000)).otherwise(F.col("minors")))
    good, bad = (blk.layout_problems(x, n, 1_000) for x in (table, planted))
    total = good.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("canonical").alias("layout"), F.when(F.col("n") == 0, "none").otherwise("some").alias("problem"), "n")
    return total.unionByName(bad.select(F.lit("planted").alias("layout"), "problem", "n"))


@query("s07_category_decode", "select o_orderkey, o_orderpriority as priority from orders")
def s07(t: Tables) -> DataFrame:
    cats = t.orders.select(F.col("o_orderpriority").alias("category")).distinct().withColumn("code", F.crc32("category"))
    codes = t.orders.select("o_orderkey", F.crc32("o_orderpriority").alias("code"))
    return src.decode_categories(codes, cats, "code", "priority").select("o_orderkey", "priority")


@query("s08_bundle_read", "select vec_id, label::bigint as label, len(embedding)::bigint as size, 'test' as kind from embeddings")
def s08(t: Tables) -> DataFrame:
    path = scratch(t, "bundle")
    src.write_bundle(t.embeddings, path, {"kind": "test"})
    values, meta = src.read_bundle(t.spark, path)
    return values.select("vec_id", F.col("label").cast("bigint").alias("label"), F.size("embedding").cast("bigint").alias("size"), F.lit(meta["kind"]).alias("kind"))


@query("s09_bundle_write", "select count(*)::bigint as n_ids, max(len(embedding))::bigint as width from embeddings")
def s09(t: Tables) -> DataFrame:
    path = scratch(t, "bundle")
    src.write_bundle(t.embeddings.select("vec_id", "embedding"), path, {"axis": "vec_id"})
    return src.read_bundle(t.spark, path)[0].agg(F.count("vec_id").alias("n_ids"), F.max(F.size("embedding")).cast("bigint").alias("width"))


@query("s10_exclusive_sink", "select 'new' as target, 'written' as outcome, count(*)::bigint as n, sum(r_regionkey)::bigint as keys from region union all select 'taken', 'refused', count(*), sum(r_regionkey) from region")
def s10(t: Tables) -> DataFrame:
    # a second, different table is refused and leaves what the first one wrote
    path, out = scratch(t, "once"), []
    for target, rows in (("new", t.region), ("taken", t.nation.select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name")))):
        try:
            src.write_json(rows, path)
            outcome = "written"
        except AnalysisException:
            outcome = "refused"
        out.append(t.spark.read.json(path).agg(F.lit(target).alias("target"), F.lit(outcome).alias("outcome"), F.count("*").alias("n"), F.sum("r_regionkey").alias("keys")))
    return out[0].union(out[1])


@query("s11_sorted_gzip", "select n_name, n_nationkey::varchar as n_nationkey from nation")
def s11(t: Tables) -> DataFrame:
    path = scratch(t, "gz")
    src.write_sorted_gzip(t.nation.select("n_name", "n_nationkey"), path, "n_nationkey")
    return src.read_text_table(t.spark, path).select("n_name", "n_nationkey")


@query("s12_config", "select p_partkey, '/data/' || p_brand || '/' || p_type || '/${OTHER}' as path from part")
def s12(t: Tables) -> DataFrame:
    # known tokens of each row's setting are replaced, unknown ones stay
    setting = F.concat(F.lit("${ROOT}/${BRAND}/"), "p_type", F.lit("/${OTHER}"))
    return t.part.select("p_partkey", src.expand_tokens(setting, {"ROOT": F.lit("/data"), "BRAND": F.col("p_brand")}).alias("path"))


@query("s13_path_readiness", "select r_regionkey::varchar as key, coalesce(bool_or(n_nationkey % 7 = 0), false) as ready from region left join nation on n_regionkey = r_regionkey group by r_regionkey")
def s13(t: Tables) -> DataFrame:
    # one folder per region, written where the region has such a nation
    top = scratch(t, "ready")
    t.nation.where("n_nationkey % 7 = 0").write.partitionBy("n_regionkey").parquet(top)
    return src.path_readiness(t.region.select(F.col("r_regionkey").cast("string").alias("key"), F.concat(F.lit(f"{top}/n_regionkey="), "r_regionkey").alias("path")))


@query("s14_cached_lookup", """select p_partkey, case when p_partkey % 7 in (1, 2) then p_name end as value,
  case when p_partkey % 7 = 0 then 'miss' when p_partkey % 7 = 3 then 'failed' when p_partkey % 7 in (1, 2) then 'hit' else 'miss' end as state from part""")
def s14(t: Tables) -> DataFrame:
    cache = t.part.where("p_partkey % 7 in (1, 2, 3)").select("p_partkey", F.col("p_name").alias("value"), (F.col("p_partkey") % 7 == 3).alias("failed"))
    return src.cached_lookup(t.part.select("p_partkey"), cache, "p_partkey")


@query("s16_normalized_store", "select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) + 0.0 as before, 1.0::double as after from embeddings")
def s16(t: Tables) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return t.embeddings.select("vec_id", r6(length(v)).alias("before"), r6(length(unit(v, "clamp"))).alias("after"))


@query("s17_value_sample", "select event_id, value from events where ('0x' || substr(sha256('3|' || event_id), 1, 8))::bigint < (0.1 * 4294967296)::bigint")
def s17(t: Tables) -> DataFrame:
    return src.sample_by_hash(t.events.select("event_id", "value"), 3, "event_id", 0.1)


@query("s15_verified_file", "select 'pinned' as copy, count(*)::bigint as n, true as ok from customer union all select 'changed', count(*) filter (c_custkey <> 5), count(*) filter (c_custkey = 5) = 0 from customer")
def s15(t: Tables) -> DataFrame:
    # copies of a table against its pinned digest; the second lacks a row
    pinned, out = chk.table_digest(t.customer, "c_custkey", "c_name").first().digest, []
    for name, rows in (("pinned", t.customer), ("changed", t.customer.where("c_custkey <> 5"))):
        copy = store(rows, f"copy-{name}")
        out.append(chk.table_digest(copy, "c_custkey", "c_name").select(F.lit(name).alias("copy"), "n", (F.col("digest") == pinned).alias("ok")))
    return out[0].union(out[1])


LINES_SQL = "count(*)::bigint as n_lines, sum(('0x' || substr(sha256(l), 1, 15))::hugeint)::varchar as digest, true as intact"


@query("s18_package", f"with n as (select n_nationkey || chr(9) || n_name || chr(9) || n_regionkey as l from nation), r as (select r_regionkey || chr(9) || r_name as l from region) select 'nation' as name, {LINES_SQL} from n union all select 'region', {LINES_SQL} from r")
def s18(t: Tables) -> DataFrame:
    # text tables in one folder with a manifest of lines and digests, read again and checked against it
    path = scratch(t, "package")
    src.write_package({"nation": t.nation, "region": t.region}, path)
    return src.read_manifest(t.spark, path)
