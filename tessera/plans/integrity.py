"""H: integrity and governance."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import checks as chk
from tessera.operators.metrics import equal_weight

from .base import EFFECTS, Tables, effects, query, r6
from .scans import scratch


@query("h01_required_columns", "select 'missing columns: [''no_such'']' as message")
def h01(t: Tables) -> DataFrame:
    chk.require_columns(t.orders, ["o_orderkey", "o_custkey"])
    try:
        chk.require_columns(t.orders, ["o_orderkey", "no_such"])
        message = "none"
    except ValueError as e:
        message = str(e)
    return t.spark.range(1).select(F.lit(message).alias("message"))


@query("h02_unique_keys", "select l_orderkey, l_partkey, count(*)::bigint as n from lineitem group by all having count(*) > 1")
def h02(t: Tables) -> DataFrame:
    return chk.duplicates(t.lineitem, "l_orderkey", "l_partkey")


@query("h03_functional_dependency", "select p_type, count(distinct p_brand)::bigint as n from part group by 1 having count(distinct p_brand) > 1")
def h03(t: Tables) -> DataFrame:
    return chk.dependency_violations(t.part, "p_type", "p_brand")


@query("h04_reference_coverage", "select (select count(*) from (select distinct l_orderkey from lineitem) where l_orderkey not in (select o_orderkey from orders))::bigint as n_orphans, (select count(*) from orders where o_orderkey not in (select l_orderkey from lineitem))::bigint as n_unused")
def h04(t: Tables) -> DataFrame:
    o, li = t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k"))
    n = lambda d, name: d.agg(F.count("*").alias(name))
    return n(chk.orphans(li, o, "k"), "n_orphans").crossJoin(n(chk.orphans(o, li, "k"), "n_unused"))


@query("h05_row_contract", """select 'nations' as "check", count(*)::double as observed, 25.0::double as expected, count(*) = 25 as ok from nation
  union all select 'urgent orders', count(*) filter (o_orderpriority = '1-URGENT')::double, 10.0::double, count(*) filter (o_orderpriority = '1-URGENT') = 10 from orders""")
def h05(t: Tables) -> DataFrame:
    # the second contract is broken by any table of more than a few orders
    return chk.check(t.nation, "nations", F.count("*"), 25).union(chk.check(t.orders.where("o_orderpriority = '1-URGENT'"), "urgent orders", F.count("*"), 10))


@query("h06_contiguous_index", "select count(*)::bigint as n, min(vec_id) = 0 and max(vec_id) = count(*) - 1 and count(distinct vec_id) = count(*) as contiguous from embeddings")
def h06(t: Tables) -> DataFrame:
    return chk.contiguous(t.embeddings, "vec_id")


@query("h07_count_conservation", """select 'all' as split, count(*)::bigint as total, count(*)::bigint as parts, true as conserved from events
  union all select 'large', count(*)::bigint, count(*) filter (value > 50)::bigint, count(*) = count(*) filter (value > 50) from events""")
def h07(t: Tables) -> DataFrame:
    # the second split loses what it filters
    return chk.conservation(t.events, "event_type", "all").union(chk.conservation(t.events, "event_type", "large", F.col("value") > 50))


@query("h08_table_digest", "select count(*)::bigint as n, sum(('0x' || substr(sha256(concat_ws('|', c_custkey::varchar, c_name, c_mktsegment)), 1, 15))::hugeint)::varchar as digest from customer")
def h08(t: Tables) -> DataFrame:
    return chk.table_digest(t.customer, "c_custkey", "c_name", "c_mktsegment")


@query("h09_resume_marker", "select 'first' as run, 'written' as outcome, count(*)::bigint as n from region union all select 'again', 'skipped', count(*) from region union all select 'other input', 'written', count(*) filter (r_regionkey > 0) from region")
def h09(t: Tables) -> DataFrame:
    # a finished output lies under its inputs' digest: a rerun with the same digest writes nothing, another input is written
    top, out = scratch(t, "resume"), []
    for run, rows in (("first", t.region), ("again", t.region), ("other input", t.region.where("r_regionkey > 0"))):
        path = f"{top}/{chk.table_digest(rows, 'r_regionkey', 'r_name').first().digest}"
        try:
            rows.write.mode("errorifexists").parquet(path)
            outcome = "written"
        except AnalysisException:
            outcome = "skipped"
        out.append(t.spark.read.parquet(path).agg(F.lit(run).alias("run"), F.lit(outcome).alias("outcome"), F.count("*").alias("n")))
    return out[0].union(out[1]).union(out[2])


@query("h10_sealed_predictions", f"with {EFFECTS}, p as (select entity, feature, avg(effect) as p from effects where context <> 'ASIA' group by all) select round(avg(abs(effect - p)), 6) + 0.0 as mae, count(*)::bigint as n from effects join p using (entity, feature) where context = 'ASIA'")
def h10(t: Tables) -> DataFrame:
    e = effects(t)
    path = scratch(t, "sealed")
    e.where("context <> 'ASIA'").groupBy("entity", "feature").agg(F.avg("effect").alias("p")).write.mode("errorifexists").parquet(path)
    sealed = t.spark.read.parquet(path)  # the truth is joined only to what was written
    return e.where("context = 'ASIA'").join(sealed, ["entity", "feature"]).agg(r6(F.avg(F.abs(F.col("effect") - F.col("p")))).alias("mae"), F.count("*").alias("n"))


@query("h11_overall_status", """with c as (select 'reference' as suite, (select count(*) from nation) = 25 as ok union all select 'reference', (select count(*) from region) = 5
  union all select 'orders', (select count(*) from region) = 5 union all select 'orders', (select count(*) from orders where o_totalprice < 0) = 0 union all select 'orders', (select max(o_orderkey) from orders) = 7)
  select suite, count(*)::bigint as n_checks, count(*) filter (not ok)::bigint as n_failed, case when bool_and(ok) then 'PASS' else 'FAIL' end as status from c group by 1""")
def h11(t: Tables) -> DataFrame:
    good = chk.check(t.nation, "nations", F.count("*"), 25).union(chk.check(t.region, "regions", F.count("*"), 5))
    bad = chk.check(t.region, "regions", F.count("*"), 5).union(chk.check(t.orders.where("o_totalprice < 0"), "negative", F.count("*"), 0)).union(chk.check(t.orders, "last", F.max("o_orderkey"), 7))
    return chk.overall(good).withColumn("suite", F.lit("reference")).union(chk.overall(bad).withColumn("suite", F.lit("orders")))


@query("h12_expected_values", """select 'brands' as "check", count(distinct p_brand)::double as observed, 25.0::double as expected, count(distinct p_brand) = 25 as ok from part union all select 'statuses', count(distinct o_orderstatus)::double, 3.0::double, count(distinct o_orderstatus) = 3 from orders""")
def h12(t: Tables) -> DataFrame:
    return chk.check(t.part, "brands", F.countDistinct("p_brand"), 25).union(chk.check(t.orders, "statuses", F.countDistinct("o_orderstatus"), 3))


@query("h13_rederivation", f"""with {EFFECTS}, a as (select context, avg(m) as a from (select context, entity, avg(effect) as m from effects group by all) group by 1), b as (select context, sum(s / k) / count(*) as b from (select context, entity, sum(effect) as s, count(*) as k from effects group by all) group by 1),
  p as (select context, avg(effect) as p from effects group by 1) select context, abs(a - b) <= 2e-12 as agree, abs(a - p) <= 2e-12 as pooled_agrees from a join b using (context) join p using (context)""")
def h13(t: Tables) -> DataFrame:
    # the mean of means agrees with its derivation from sums, and not with the pooled mean
    e = effects(t)
    a = equal_weight(e, "effect", [["context", "entity"], ["context"]]).select("context", F.col("effect").alias("a"))
    per = e.groupBy("context", "entity").agg(F.sum("effect").alias("s"), F.count("*").alias("k"))
    per = per.groupBy("context").agg((F.sum(F.col("s") / F.col("k")) / F.count("*")).alias("b"), (F.sum("s") / F.sum("k")).alias("p"))
    return a.join(per, "context").select("context", *[(F.abs(F.col("a") - F.col(c)) <= 2e-12).alias(n) for c, n in (("b", "agree"), ("p", "pooled_agrees"))])


@query("h14_column_comparison", """select 'c_name' as "column", count(*)::bigint as n_compared, 0::bigint as n_mismatched from customer union all select 'c_mktsegment', count(*), count(*) filter (c_custkey % 100 = 0 and c_mktsegment is not null) from customer""")
def h14(t: Tables) -> DataFrame:
    other = t.customer.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 100 != 0, F.col("c_mktsegment")))
    return chk.mismatches(t.customer, other, "c_custkey", ["c_name", "c_mktsegment"])


@query("h15_independent_recount", "with k as (select l_returnflag, l_orderkey, l_linenumber, count(*) as n from lineitem group by all) select l_returnflag, sum(n)::bigint as n, true as agree, sum(n) = count(*) as distinct_agree from k group by 1")
def h15(t: Tables) -> DataFrame:
    # a recount by another way agrees; one that takes lines of one order and number for one doesn't where there are such
    a = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"))
    lines = t.lineitem.groupBy("l_returnflag", "l_orderkey", "l_linenumber").agg(F.sum(F.lit(1)).alias("k"))
    b = lines.groupBy("l_returnflag").agg(F.sum("k").alias("k"), F.count("*").alias("d"))
    return a.join(b, "l_returnflag").select("l_returnflag", "n", (F.col("n") == F.col("k")).alias("agree"), (F.col("n") == F.col("d")).alias("distinct_agree"))


@query("h16_expression_scale", "select bool_and(isfinite(l_quantity)) as finite, min(l_quantity) >= 0 as non_negative, avg((abs(l_quantity - round(l_quantity)) < 1e-6)::int) >= 0.99 as counts_like, avg((l_quantity > 0)::int) >= 0.99 as positive from lineitem")
def h16(t: Tables) -> DataFrame:
    return chk.expression_scale(t.lineitem, "l_quantity")
