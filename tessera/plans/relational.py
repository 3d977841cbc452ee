"""P, J, A, W, K, U: predicates, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import hash_order
from tessera.operators import linear as lin
from tessera.operators import relational as rel
from tessera.operators.matching import nearest_matching
from tessera.operators.order import hash_positions, with_ranks
from tessera.operators.metrics import confusion, equal_weight, fractional_topk

from .base import CELLS, EFFECTS, METRICS, TWO_VIEWS, Tables, cells, effects, metric_table, query, r6, two_views
from tessera.operators.geometry import average_rank, blocks_of, doubled_rank, mean_vector, unordered_pairs, largest_group
from tessera.operators.pairblocks import kind_pairs

EV = "ev as (select event_id, event_type as atom, (user_id % 5)::bigint as donor, day(ts)::bigint as batch, value, event_type = 'view' as is_control from events)"


def ev(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.col("event_type").alias("atom"), (F.col("user_id") % 5).alias("donor"), F.dayofmonth("ts").cast("bigint").alias("batch"), "value", (F.col("event_type") == "view").alias("is_control"))


# P: predicates and projections


@query("p01_drop_controls", "select event_id, event_type from events where lower(trim(event_type)) not in ('view')")
def p01(t: Tables) -> DataFrame:
    return t.events.select("event_id", "event_type").where(~F.lower(F.trim("event_type")).isin("view"))


@query("p02_control_mask", "select event_id, event_type = 'view' as is_control from events")
def p02(t: Tables) -> DataFrame:
    return rel.control_mask(t.events.select("event_id", "event_type"), "event_type", "view").select("event_id", "is_control")


@query("p03_membership", "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def p03(t: Tables) -> DataFrame:
    ids = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(ids, "o_custkey", "left_semi")


@query("p04_tuple_membership", "select l_orderkey, l_partkey, l_suppkey from lineitem where (l_partkey, l_suppkey) in (select l_partkey, l_suppkey from lineitem where l_quantity = 50)")
def p04(t: Tables) -> DataFrame:
    keys = t.lineitem.where("l_quantity = 50").select("l_partkey", "l_suppkey").distinct()
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey").join(keys, ["l_partkey", "l_suppkey"], "left_semi")


@query("p05_min_support", f"with {CELLS}, n as (select entity, context, feature, count(*) as n from cells group by all) select entity, context, feature, n::bigint as n, min(n) over (partition by entity, context) >= 25 as eligible from n")
def p05(t: Tables) -> DataFrame:
    n = cells(t).groupBy("entity", "context", "feature").agg(F.count("*").alias("n"))
    return n.withColumn("eligible", F.min("n").over(Window.partitionBy("entity", "context")) >= 25)


@query("p06_complete_grid", f"with {CELLS}, g as (select distinct entity, context, feature from cells where value > 30000), k as (select count(distinct context) * count(distinct feature) as k from g) select entity, count(*)::bigint as n, count(*) = max(k) as complete from g, k group by entity")
def p06(t: Tables) -> DataFrame:
    g = cells(t).where("value > 30000").select("entity", "context", "feature").distinct()
    k = g.agg((F.countDistinct("context") * F.countDistinct("feature")).alias("k"))
    return g.join(F.broadcast(k)).groupBy("entity").agg(F.count("*").alias("n"), (F.count("*") == F.max("k")).alias("complete"))


@query("p07_common_support", f"with {EV}, n as (select atom, donor, count(*) filter (value > 0) as n from ev group by all) select atom, bool_and(n >= 380) as common from n group by atom")
def p07(t: Tables) -> DataFrame:
    n = ev(t).groupBy("atom", "donor").agg(F.count_if(F.col("value") > 0).alias("n"))
    return n.groupBy("atom").agg(F.bool_and(F.col("n") >= 380).alias("common"))


@query("p08_case_reasons", "select o_orderkey, case when o_totalprice < 50000 then 'low' when o_orderstatus = 'F' then 'finished' when o_orderpriority like '1%' then 'urgent' else 'kept' end as reason from orders")
def p08(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.when(F.col("o_totalprice") < 50000, "low").when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderpriority").startswith("1"), "urgent").otherwise("kept").alias("reason"))


@query("p09_reason_list", "select o_orderkey, concat_ws('|', case when o_totalprice < 50000 then 'low' end, case when o_orderstatus = 'F' then 'finished' end) as reasons from orders")
def p09(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.concat_ws("|", F.when(F.col("o_totalprice") < 50000, "low"), F.when(F.col("o_orderstatus") == "F", "finished")).alias("reasons"))


@query("p10_class_support", """with c as (select c_mktsegment as label, c_nationkey as entity from customer where c_acctbal > 9000), a as (select label from c group by label having count(*) >= 20),
  b as (select label from c where label in (from a) group by label having count(distinct entity) >= 12) select label, count(*)::bigint as n from c where label in (from b) group by label""")
def p10(t: Tables) -> DataFrame:
    c = t.customer.where("c_acctbal > 9000").select(F.col("c_mktsegment").alias("label"), F.col("c_nationkey").alias("entity"))
    ok = c.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("e")).where("n >= 20 and e >= 12")
    return ok.select("label", "n")


@query("p11_finite_only", "select count(*)::bigint as n, round(sum(value), 6) + 0.0 as total from events where value is not null and isfinite(value)")
def p11(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


VISIBLE = {"P1": ("p_brand",), "P2": ("p_brand", "p_type"), "P4": ("p_brand", "p_type", "p_size")}


@query("p12_visible_fields", """select p_partkey, view, case view when 'P1' then 'p_brand=' || p_brand when 'P2' then 'p_brand=' || p_brand || '|p_type=' || p_type
  else 'p_brand=' || p_brand || '|p_type=' || p_type || '|p_size=' || p_size end as features from part, (values ('P1'), ('P2'), ('P4')) v(view)""")
def p12(t: Tables) -> DataFrame:
    views = [F.struct(F.lit(v).alias("view"), F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in cols]).alias("features")) for v, cols in VISIBLE.items()]
    return t.part.select("p_partkey", F.inline(F.array(*views)))


@query("p13_paired_rename", f"with {METRICS} select dataset, model, max(value) filter (metric = 'rsa') as value_text, max(value) filter (metric = 'ndcg') as value_context from metric_table group by all")
def p13(t: Tables) -> DataFrame:
    m = metric_table(t)
    side = lambda k, s: m.where(F.col("metric") == k).drop("metric").withColumnRenamed("value", f"value_{s}")
    return side("rsa", "text").join(side("ndcg", "context"), ["dataset", "model"])


# J: joins


@query("j01_contract_join", "select o_orderkey, c_custkey, c_mktsegment from orders join customer on o_custkey = c_custkey")
def j01(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return rel.contract_join(o, t.customer.select("c_custkey", "c_mktsegment"), ["c_custkey"])


@query("j02_left_lookup", "select c_custkey, coalesce(n, 0)::bigint as n from customer left join (select o_custkey, count(*) as n from orders where o_orderstatus = 'F' group by 1) on c_custkey = o_custkey")
def j02(t: Tables) -> DataFrame:
    n = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("j03_coverage", "select coalesce(a.k, b.k) as k, case when a.k is null then 'right_only' when b.k is null then 'left_only' else 'both' end as side from (select distinct l_partkey as k from lineitem where l_quantity > 45) a full join (select p_partkey as k from part where p_size > 10) b on a.k = b.k")
def j03(t: Tables) -> DataFrame:
    return rel.coverage(t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("k")), t.part.where("p_size > 10").select(F.col("p_partkey").alias("k")), "k")


@query("j04_complete_grid", f"with {EV} select a.atom, d.donor, count(event_id)::bigint as n from (select distinct atom from ev) a cross join (select distinct donor from ev) d left join ev on ev.atom = a.atom and ev.donor = d.donor and value > 99 group by all")
def j04(t: Tables) -> DataFrame:
    e = ev(t)
    grid = e.select("atom").distinct().crossJoin(e.select("donor").distinct())
    n = e.where("value > 99").groupBy("atom", "donor").agg(F.count("*").alias("n"))
    return grid.join(n, ["atom", "donor"], "left").select("atom", "donor", F.coalesce("n", F.lit(0)).alias("n"))


@query("j05_dictionary", "select s_suppkey, n_name from supplier left join nation on s_nationkey = n_nationkey")
def j05(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")).join(t.nation.select("n_nationkey", "n_name"), "n_nationkey", "left").select("s_suppkey", "n_name")


@query("j06_reorder", "select row_number() over (order by sha256('5|' || c_custkey), c_custkey)::bigint as position, c_custkey, c_acctbal from customer")
def j06(t: Tables) -> DataFrame:
    order = hash_positions(t.customer.select("c_custkey").where("c_custkey is not null"), "c_custkey", 5).withColumn("position", F.col("position") + 1)
    return order.join(t.customer.select("c_custkey", "c_acctbal"), "c_custkey").select("position", "c_custkey", "c_acctbal")


@query("j07_anti", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
def j07(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("j08_unordered_pairs", "select a.label::bigint as label, count(*)::bigint as n_pairs from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id group by a.label")
def j08(t: Tables) -> DataFrame:
    p = unordered_pairs(t.embeddings.select(F.col("label").cast("bigint").alias("label"), "vec_id"), "label", "vec_id", blocks_of(t.embeddings, "label"))
    return p.groupBy("label").agg(F.count("*").alias("n_pairs"))


@query("j09_cross_context_pairs", f"with {EFFECTS} select a.entity, a.context as ctx_a, b.context as ctx_b, count(*)::bigint as n from effects a join effects b on a.entity = b.entity and a.feature = b.feature and a.context < b.context group by all")
def j09(t: Tables) -> DataFrame:
    e = effects(t).select("entity", "feature", "context")
    b = e.withColumnRenamed("context", "ctx_b")
    return e.withColumnRenamed("context", "ctx_a").join(b, ["entity", "feature"]).where("ctx_a < ctx_b").groupBy("entity", "ctx_a", "ctx_b").agg(F.count("*").alias("n"))


@query("j10_match_controls", f"""with {EV}, p as (select atom, donor, batch, count(*) as n_pert from ev where not is_control and batch <= 4 group by all), c as (select donor, batch, count(*) as n from ev where is_control group by all),
  l1 as (select atom, min(coalesce(n, 0)) as lo, sum(coalesce(n, 0)) as s, sum(n_pert) as np from p left join c using (donor, batch) group by atom),
  pd as (select atom, donor, sum(n_pert) as n_pert from p group by all), cd as (select donor, sum(n) as n from c group by all),
  l2 as (select atom, min(coalesce(n, 0)) as lo, sum(coalesce(n, 0)) as s from pd left join cd using (donor) group by atom)
  select atom, case when l1.lo >= 5 and l1.s >= 20 then 'donor_batch' when l2.lo >= 5 and l2.s >= 20 then 'donor' else 'unsupported' end as level, np::bigint as n_pert,
  case when l1.lo >= 5 and l1.s >= 20 then l1.s when l2.lo >= 5 and l2.s >= 20 then l2.s else 0 end::bigint as n_controls from l1 join l2 using (atom)""")
def j10(t: Tables) -> DataFrame:
    return rel.match_controls(ev(t).where("is_control or batch <= 4"), "atom", "donor", "batch", "is_control")


@query("j11_two_source_lookup", f"with {EFFECTS}, s as (select entity, feature, context, effect from effects where context in ('ASIA', 'EUROPE')) select q.entity, q.feature, q.context, round(avg(s.effect), 6) + 0.0 as prediction from effects q join s on q.entity = s.entity and q.feature = s.feature where q.context = 'AMERICA' group by all having count(distinct s.context) = 2")
def j11(t: Tables) -> DataFrame:
    e = effects(t)
    s = e.where(F.col("context").isin("ASIA", "EUROPE")).groupBy("entity", "feature").agg(F.avg("effect").alias("p"), F.countDistinct("context").alias("k")).where("k = 2")
    return e.where("context = 'AMERICA'").join(s, ["entity", "feature"]).select("entity", "feature", "context", r6("p").alias("prediction"))


@query("j12_similarity_lift", "select a.s_suppkey as a, b.s_suppkey as b, abs(a.s_nationkey - b.s_nationkey)::bigint as sim from supplier a join supplier b on a.s_suppkey < b.s_suppkey where a.s_suppkey % 10 = b.s_suppkey % 10")
def j12(t: Tables) -> DataFrame:
    # similarities of conditions, lifted to the atoms that belong to the conditions
    known = t.nation.select(F.col("n_nationkey").alias("s_nationkey"))
    s = t.supplier.join(F.broadcast(known), "s_nationkey", "left_semi").select("s_suppkey", F.col("s_nationkey").cast("double").alias("c"), (F.col("s_suppkey") % 10).alias("g"))

    def apart(a: list[tuple], b: list[tuple]) -> np.ndarray:
        return np.abs(np.array(a) - np.array(b).T)

    return kind_pairs(s, "g", "s_suppkey", ["c"], apart, largest_group(s, "g"), digits=0).select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("sim").cast("bigint").alias("sim"))


@query("j13_greedy_matching")
def j13(t: Tables) -> DataFrame:
    # odd parts are matched with even ones of their brand, the nearest in price first
    p = t.part.select("p_brand", "p_partkey", "p_retailprice")
    left, right = (p.where(F.col("p_partkey") % 2 == k).withColumnRenamed("p_partkey", n) for k, n in ((1, "left"), (0, "right")))
    return nearest_matching(left, right, "p_brand", "left", "right", "p_retailprice").withColumn("score", r6("score"))


@query("j14_landmark_kernel", f"with {TWO_VIEWS} select q.vec_id, l.vec_id as landmark, round(list_cosine_similarity(q.text, l.text) * list_cosine_similarity(q.resp, l.resp), 6) + 0.0 as sim from two_views q, (select * from two_views order by sha256('9|' || vec_id), vec_id limit 256) l")
def j14(t: Tables) -> DataFrame:
    # the product kernel of every row with 256 landmarks; the landmarks are the sent side at every size
    v = two_views(t)
    marks = lin.choose_landmarks(v, "vec_id", 256, 9)
    x = lin.landmark_features(v, "text", np.array([r.text for r in marks]), "resp", np.array([r.resp for r in marks]), "interaction")
    names = F.lit([r.vec_id for r in marks])
    return x.select("vec_id", F.posexplode("x").alias("k", "s")).select("vec_id", F.get(names, "k").alias("landmark"), r6("s").alias("sim"))


# A: aggregates


@query("a01_group_aggregates", "select l_returnflag, count(*)::bigint as n, count(distinct l_suppkey)::bigint as suppliers, sum(l_quantity)::bigint as quantity, min(l_shipdate)::date::varchar as first_day, max(l_partkey) as last_part from lineitem group by 1")
def a01(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.sum("l_quantity").cast("bigint").alias("quantity"), F.min("l_shipdate").cast("date").cast("string").alias("first_day"), F.max("l_partkey").alias("last_part"))


@query("a02_distinct_per_group", "select o_orderpriority, count(distinct o_custkey)::bigint as n from orders group by 1")
def a02(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("n"))


@query("a03_null_group", "select nullif(o_orderstatus, 'P') as k, count(*)::bigint as n from orders group by 1")
def a03(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("k")).agg(F.count("*").alias("n"))


SYSTEMS = "(select unnest(['entity', 'context']) as system, unnest([entity, context]) as grp, feature, value from cells)"


@query("a04_sums_by_systems", f"with {CELLS} select system, grp, feature, round(sum(value), 4) + 0.0 as s, round(sum(ln(1 + value)), 4) + 0.0 as ls from {SYSTEMS} group by all")
def a04(t: Tables) -> DataFrame:
    systems = F.inline(F.array(F.struct(F.lit("entity").alias("system"), F.col("entity").alias("grp")), F.struct(F.lit("context").alias("system"), F.col("context").alias("grp"))))
    g = cells(t).select(systems, "feature", "value").groupBy("system", "grp", "feature")
    return g.agg((F.round(F.sum("value"), 4) + 0.0).alias("s"), (F.round(F.sum(F.log1p("value")), 4) + 0.0).alias("ls"))


@query("a05_sparse_mean", f"with {CELLS}, n as (select entity, count(distinct cell) as n from cells group by 1) select entity, feature, round(sum(value) / max(n), 6) + 0.0 as mean from cells join n using (entity) group by all")
def a05(t: Tables) -> DataFrame:
    c = cells(t)
    n = c.groupBy("entity").agg(F.countDistinct("cell").alias("n"))
    return c.groupBy("entity", "feature").agg(F.sum("value").alias("s")).join(n, "entity").select("entity", "feature", r6(F.col("s") / F.col("n")).alias("mean"))


@query("a06_row_sums", "select l_orderkey, sum(l_quantity)::bigint as library from lineitem group by 1")
def a06(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").cast("bigint").alias("library"))


@query("a07_variable_features", f"with {CELLS}, s as (select feature, var_samp(value) as v from cells where is_control group by 1) select feature, round(v, 2) + 0.0 as variance, row_number() over (order by v desc, feature)::bigint as place from s qualify place <= 5")
def a07(t: Tables) -> DataFrame:
    s = cells(t).where("is_control").groupBy("feature").agg(F.var_samp("value").alias("v"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.col("v").desc(), "feature")).cast("bigint")).where("place <= 5").select("feature", (F.round("v", 2) + 0.0).alias("variance"), "place")


@query("a08_positive_variance", f"with {CELLS}, s as (select entity, feature, var_pop(value) as v from cells where not is_control group by all) select entity, feature, round(v, 2) + 0.0 as variance from s where v > 0 qualify row_number() over (partition by entity order by v desc, feature) <= 3")
def a08(t: Tables) -> DataFrame:
    s = cells(t).where("not is_control").groupBy("entity", "feature").agg(F.var_pop("value").alias("v")).where("v > 0")
    return rel_top(s, ["entity"], 3, F.col("v").desc(), F.col("feature")).select("entity", "feature", (F.round("v", 2) + 0.0).alias("variance"))


def rel_top(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:  # noqa: ANN002
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


@query("a09_equal_measurements", f"with {CELLS}, w as (select entity, context, rep, avg(value) as m from cells where not is_control group by all) select entity, context, round(avg(m), 6) + 0.0 as mean, count(*)::bigint as n_wells from w group by all having count(*) = 2")
def a09(t: Tables) -> DataFrame:
    w = cells(t).where("not is_control").groupBy("entity", "context", "rep").agg(F.avg("value").alias("m"))
    return w.groupBy("entity", "context").agg(r6(F.avg("m")).alias("mean"), F.count("*").alias("n_wells")).where("n_wells = 2")


@query("a10_equal_pools", f"with {CELLS}, w as (select context, feature, rep, avg(value) as m from cells where is_control group by all) select context, feature, round(avg(m), 6) + 0.0 as state from w group by all")
def a10(t: Tables) -> DataFrame:
    return equal_weight(cells(t).where("is_control"), "value", [["context", "feature", "rep"], ["context", "feature"]]).select("context", "feature", r6("value").alias("state"))


@query("a11_weighted_control_mean", f"with {EV}, p as (select atom, donor, count(*) as w from ev where not is_control group by all), c as (select donor, avg(value) as m from ev where is_control group by all) select atom, round(sum(w * m) / sum(w), 6) + 0.0 as control_mean from p join c using (donor) group by atom")
def a11(t: Tables) -> DataFrame:
    e = ev(t)
    p = e.where("not is_control").groupBy("atom", "donor").agg(F.count("*").alias("w"))
    c = e.where("is_control").groupBy("donor").agg(F.avg("value").alias("m"))
    return p.join(c, "donor").groupBy("atom").agg(r6(F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("control_mean"))


@query("a12_mean_vectors", "with e as (select label::bigint as label, unnest(range(0, 64)) as pos, unnest(embedding::double[]) as x from embeddings), m as (select label, pos, avg(x) as x from e group by all), n as (select label, sqrt(sum(x * x)) as n from m group by 1) select label, pos::bigint as pos, round(x / n, 6) + 0.0 as value from m join n using (label)")
def a12(t: Tables) -> DataFrame:
    from tessera.functions.columns import unit

    v = t.embeddings.select(F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    return mean_vector(v, ["label"], "e").select("label", F.posexplode(unit(F.col("vector")))).select("label", F.col("pos").cast("bigint").alias("pos"), r6("col").alias("value"))


@query("a13_masked_pool", "with tk as (select conv_id, turn, length(text)::double as x, role = 'user' as valid from conversations where turn % 3 <> 0 or conv_id % 2 = 0) select conv_id, round(coalesce(avg(x) filter (valid), 0), 6) + 0.0 as pooled from tk group by 1")
def a13(t: Tables) -> DataFrame:
    c = t.conversations.where("turn % 3 <> 0 or conv_id % 2 = 0")
    return c.groupBy("conv_id").agg(r6(F.coalesce(F.avg(F.when(F.col("role") == "user", F.length("text").cast("double"))), F.lit(0.0))).alias("pooled"))


@query("a14_weighted_average", "select l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) + 0.0 as discount from lineitem group by 1")
def a14(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(r6(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")).alias("discount"))


@query("a15_equal_weight_hierarchy", f"with {EFFECTS}, a as (select entity, context, avg(case when feature % 5 <> 0 then effect end) as v from effects group by all), b as (select context, avg(v) as v, count(*) as n, count(v) as k from a group by all) select context, round(v, 6) + 0.0 as effect, n::bigint as n_units, k::bigint as n_valid from b")
def a15(t: Tables) -> DataFrame:
    e = effects(t).withColumn("v", F.when(F.col("feature") % 5 != 0, F.col("effect")))
    return equal_weight(e, "v", [["entity", "context"], ["context"]]).select("context", r6("v").alias("effect"), "n_units", "n_valid")


@query("a16_macro_summary", f"with {METRICS} select model, metric, round(avg(value), 6) + 0.0 as mean, round(median(value), 6) + 0.0 as median, count(*) filter (value > 7) ::bigint as n_positive, count(distinct dataset)::bigint as n from metric_table group by all")
def a16(t: Tables) -> DataFrame:
    return metric_table(t).groupBy("model", "metric").agg(r6(F.avg("value")).alias("mean"), r6(F.median("value")).alias("median"), F.count_if(F.col("value") > 7).alias("n_positive"), F.countDistinct("dataset").alias("n"))


LODO = f"{METRICS}, d as (select distinct dataset as omitted from metric_table), lodo as (select omitted, model, avg(value) as value from metric_table, d where metric = 'rsa' and dataset <> omitted group by all)"


def lodo(t: Tables) -> DataFrame:
    """(omitted, model, value): means with one dataset left out, from sums, without a cross join."""
    m = metric_table(t).where("metric = 'rsa'")
    own = m.groupBy("dataset", "model").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    w = Window.partitionBy("model")
    return own.select(F.col("dataset").alias("omitted"), "model", ((F.sum("s").over(w) - F.col("s")) / F.nullif(F.sum("n").over(w) - F.col("n"), F.lit(0))).alias("value"))


@query("a17_leave_one_out", f"with {LODO} select omitted, model, round(value, 6) + 0.0 as value from lodo")
def a17(t: Tables) -> DataFrame:
    return lodo(t).select("omitted", "model", r6("value").alias("value"))


@query("a18_leave_out_range", f"with {LODO}, r as (select *, rank() over (partition by omitted order by round(value, 9) desc) as k from lodo) select model, round(min(value), 6) + 0.0 as lo, round(max(value), 6) + 0.0 as hi, count(*) filter (k = 1)::bigint as n_top from r group by 1")
def a18(t: Tables) -> DataFrame:
    r = lodo(t).withColumn("k", F.rank().over(Window.partitionBy("omitted").orderBy(F.round("value", 9).desc())))
    return r.groupBy("model").agg(r6(F.min("value")).alias("lo"), r6(F.max("value")).alias("hi"), F.count_if(F.col("k") == 1).alias("n_top"))


@query("a19_winner_json", f"with {METRICS}, w as (select metric, dataset, model from metric_table qualify row_number() over (partition by metric, dataset order by value desc, model) = 1), c as (select metric, model, count(*) as n from w group by all) select metric, '{{' || string_agg('\"' || model || '\":' || n, ',' order by model) || '}}' as winners from c group by 1")
def a19(t: Tables) -> DataFrame:
    w = rel.first_by(metric_table(t), ["metric", "dataset"], F.col("value").desc(), F.col("model"))
    c = w.groupBy("metric", "model").agg(F.count("*").alias("n"))
    return c.groupBy("metric").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "n"))))).alias("winners"))


@query("a20_quantiles", "select l_returnflag, unnest([0.025, 0.25, 0.5, 0.75, 0.975])::double as q, round(unnest(quantile_cont(l_extendedprice, [0.025, 0.25, 0.5, 0.75, 0.975])), 6) + 0.0 as value from lineitem group by 1")
def a20(t: Tables) -> DataFrame:
    qs = [0.025, 0.25, 0.5, 0.75, 0.975]
    g = t.lineitem.groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.lit(qs)).alias("p"))
    return g.select("l_returnflag", F.inline(F.arrays_zip(F.lit(qs).alias("q"), F.col("p").alias("value")))).select("l_returnflag", "q", r6("value").alias("value"))


@query("a21_confusion", "with l as (select distinct lang from documents), d as (select lang as truth, case when n_chars % 4 = 0 then 'en' else lang end as pred from documents) select a.lang as truth, b.lang as pred, count(d.truth)::bigint as n from l a cross join l b left join d on d.truth = a.lang and d.pred = b.lang group by all")
def a21(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("lang").alias("truth"), F.when(F.col("n_chars") % 4 == 0, "en").otherwise(F.col("lang")).alias("pred"))
    return confusion(d, "truth", "pred", t.documents.select("lang").distinct())


@query("a22_majority", "select source, lang from (select source, lang, count(*) as n from documents group by all) qualify row_number() over (partition by source order by n desc, lang) = 1")
def a22(t: Tables) -> DataFrame:
    n = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    return rel.first_by(n, ["source"], F.col("n").desc(), F.col("lang")).select("source", "lang")


@query("a23_sign_crosstab", f"with {EFFECTS}, s as (select context, case when feature = 6 then null else round(effect, 1) end as e from effects) select context, count(*) filter (e > 0)::bigint as positive, count(*) filter (e < 0)::bigint as negative, count(*) filter (e = 0)::bigint as zero, count(*) filter (e is null)::bigint as missing from s group by 1")
def a23(t: Tables) -> DataFrame:
    e = F.when(F.col("feature") == 6, None).otherwise(F.round("effect", 1))
    s = effects(t).select("context", F.when(e.isNull(), "missing").when(e > 0, "positive").when(e < 0, "negative").otherwise("zero").alias("sign"))
    return s.groupBy("context").pivot("sign", ["positive", "negative", "zero", "missing"]).count().na.fill(0)


@query("a24_pivot_matrix", f"with {METRICS} select dataset, max(value) filter (model = '1-URGENT') as urgent, max(value) filter (model = '5-LOW') as low from metric_table where metric = 'rsa' group by 1")
def a24(t: Tables) -> DataFrame:
    m = rel.assert_unique(metric_table(t).where("metric = 'rsa'"), "dataset", "model")
    return m.groupBy("dataset").pivot("model", ["1-URGENT", "5-LOW"]).agg(F.first("value")).select("dataset", F.col("1-URGENT").alias("urgent"), F.col("5-LOW").alias("low"))


@query("a25_set_keys", "select g, count(distinct k)::bigint as n from (select l_returnflag as g, l_partkey as k from lineitem union all select l_returnflag, l_suppkey from lineitem) group by 1")
def a25(t: Tables) -> DataFrame:
    ids = t.lineitem.select(F.col("l_returnflag").alias("g"), F.explode(F.array("l_partkey", "l_suppkey")).alias("k"))
    return ids.groupBy("g").agg(F.countDistinct("k").alias("n"))


@query("a26_joined_sets", "select c_nationkey::bigint as c_nationkey, string_agg(distinct c_mktsegment, '|' order by c_mktsegment) as segments from customer where c_acctbal > 9000 group by 1")
def a26(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").cast("bigint").alias("c_nationkey")).agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "|").alias("segments"))


@query("a27_collisions", "with k as (select length(p_name) as k, p_brand as l, count(*) as n from part group by all), g as (select k, sum(n) as n, max(n) as m from k group by 1) select count(*)::bigint as n_keys, count(*) filter (n > 1)::bigint as n_colliding, max(n)::bigint as largest, round(sum(m) / sum(n), 6) + 0.0 as ceiling from g")
def a27(t: Tables) -> DataFrame:
    k = t.part.groupBy(F.length("p_name").alias("k"), "p_brand").agg(F.count("*").alias("n"))
    g = k.groupBy("k").agg(F.sum("n").alias("n"), F.max("n").alias("m"))
    return g.agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_colliding"), F.max("n").alias("largest"), r6(F.sum("m") / F.sum("n")).alias("ceiling"))


@query("a28_moments", "select l_returnflag, sum(l_quantity)::bigint as s, sum(l_quantity * l_quantity)::bigint as ss from lineitem group by 1")
def a28(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.sum("l_quantity").cast("bigint").alias("s"), F.sum(F.col("l_quantity") * F.col("l_quantity")).cast("bigint").alias("ss"))


# W: windows


@query("w01_average_rank", f"with {METRICS} select dataset, metric, model, rank() over (partition by dataset, metric order by value desc) + (count(*) over (partition by dataset, metric, value) - 1) / 2.0::double as r from metric_table")
def w01(t: Tables) -> DataFrame:
    return metric_table(t).select("dataset", "metric", "model", average_rank("value", "dataset", "metric", descending=True).alias("r"))


@query("w02_doubled_rank", f"with {METRICS} select dataset, metric, model, (2 * rank() over (partition by dataset, metric order by value) + count(*) over (partition by dataset, metric, value) - 1)::bigint as r from metric_table")
def w02(t: Tables) -> DataFrame:
    return metric_table(t).select("dataset", "metric", "model", doubled_rank("value", "dataset", "metric").alias("r"))


@query("w02b_large_group_rank", "select l_orderkey, l_linenumber::bigint as l_linenumber, (2 * rank() over (partition by l_returnflag order by l_extendedprice) + count(*) over (partition by l_returnflag, l_extendedprice) - 1)::bigint as r, (2 * rank() over (partition by l_returnflag order by l_quantity) + count(*) over (partition by l_returnflag, l_quantity) - 1)::bigint as q from lineitem")
def w02b(t: Tables) -> DataFrame:
    # three groups that hold the whole table: by counts per value and running totals, never a group in one task
    d = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_returnflag", "l_extendedprice", "l_quantity")
    r = with_ranks(d, {"r": "l_extendedprice", "q": "l_quantity"}, "l_returnflag", doubled=True, largest=1, most=0)
    return r.select("l_orderkey", "l_linenumber", "r", "q")


@query("w03_group_centering", "select c_custkey, round(c_acctbal - avg(c_acctbal) over (partition by c_nationkey), 6) + 0.0 as centered from customer")
def w03(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", r6(F.col("c_acctbal") - F.avg("c_acctbal").over(Window.partitionBy("c_nationkey"))).alias("centered"))


@query("w04_plate_roles", "select event_id, case when row_number() over (partition by user_id order by event_id) = 1 then 'A' else 'B' end as role from events")
def w04(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.when(F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) == 1, "A").otherwise("B").alias("role"))


@query("w05_hash_partition", "select event_id, case when row_number() over (partition by user_id order by sha256('11|' || event_id)) % 2 = 1 then 'A' else 'B' end as role from events")
def w05(t: Tables) -> DataFrame:
    return rel.role_by_order(t.events, ["user_id"], hash_order(11, F.col("event_id"))).select("event_id", "role")


@query("w06_landmarks", "with h as (select p_partkey, p_brand, sha256('20260914|' || p_partkey) as h from part), f as (select *, row_number() over (partition by p_brand order by h, p_partkey) = 1 as first from h) select p_partkey, p_brand from f order by first desc, h, p_partkey limit 64")
def w06(t: Tables) -> DataFrame:
    return rel.landmarks(t.part.select("p_partkey", "p_brand"), "p_brand", "p_partkey", 64, 20260914)


@query("w07_keep_first_last", "select o_custkey, min(o_orderkey) as first, max(o_orderkey) as last from orders group by 1")
def w07(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderkey")
    return rel.first_by(o, ["o_custkey"], F.col("o_orderkey")).withColumnRenamed("o_orderkey", "first").join(rel.first_by(o, ["o_custkey"], F.col("o_orderkey").desc()).withColumnRenamed("o_orderkey", "last"), "o_custkey")


@query("w08_duplicate_flag", "select doc_id, count(*) over (partition by text) > 1 as duplicated from documents")
def w08(t: Tables) -> DataFrame:
    # the digest stands for the text, so that no text is shuffled
    return t.documents.select("doc_id", F.sha2("text", 256).alias("h")).select("doc_id", (F.count("*").over(Window.partitionBy("h")) > 1).alias("duplicated"))


@query("w09_balanced_sample", "with h as (select doc_id, lang, sha256('13|' || doc_id) as h from documents), r as (select *, row_number() over (partition by lang order by h, doc_id) as r from h) select doc_id, lang from r where r <= 200 // (select count(distinct lang) from documents) order by h, doc_id limit 200")
def w09(t: Tables) -> DataFrame:
    return rel.balanced_sample(t.documents.select("doc_id", "lang"), "lang", "doc_id", 200, 13)


@query("w10_group_min_size", "select vec_id, min(vec_id) over (partition by label) as first, count(*) over (partition by label)::bigint as n from embeddings")
def w10(t: Tables) -> DataFrame:
    w = Window.partitionBy("label")
    return t.embeddings.select("vec_id", F.min("vec_id").over(w).alias("first"), F.count("*").over(w).alias("n"))


@query("w11_hash_folds", "select p_brand, ((row_number() over (order by sha256('17|' || p_brand), p_brand) - 1) % 5)::bigint as fold from (select distinct p_brand from part)")
def w11(t: Tables) -> DataFrame:
    return rel.group_folds(t.part, "p_brand", 5, 17)


# K: order and top-k


@query("k01_stable_sort", "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey)::bigint as place from orders order by o_orderdate, o_orderkey limit 100")
def k01(t: Tables) -> DataFrame:
    top = t.orders.orderBy("o_orderdate", "o_orderkey").limit(100)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy("o_orderdate", "o_orderkey")).cast("bigint").alias("place"))


@query("k02_top_n", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def k02(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("k03_fractional_topk", """with s as (select c_nationkey::bigint as q, c_custkey, floor(c_acctbal / 500) as s from customer), r as (select *, rank() over (partition by q order by s desc) - 1 as a, count(*) over (partition by q, s) as e from s)
  select q, c_custkey, round(greatest(0.0, least(1.0, (10 - a) / e)), 6) + 0.0 as rel from r""")
def k03(t: Tables) -> DataFrame:
    s = t.customer.select(F.col("c_nationkey").cast("bigint").alias("q"), "c_custkey", F.floor(F.col("c_acctbal") / 500).alias("s"))
    return fractional_topk(s, "s", 10, "q").select("q", "c_custkey", r6("rel").alias("rel"))


@query("k04_top_set", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, floor(o_totalprice / 10000) as s from orders) qualify abs(s - max(s) over (partition by o_custkey)) <= 1e-12")
def k04(t: Tables) -> DataFrame:
    s = F.floor(F.col("o_totalprice") / 10000)
    return t.orders.select("o_custkey", "o_orderkey", s.alias("s")).withColumn("m", F.max("s").over(Window.partitionBy("o_custkey"))).where("abs(s - m) <= 1e-12").select("o_custkey", "o_orderkey")


@query("k05_hash_cap", "select c_custkey from customer order by sha256('19|' || c_custkey), c_custkey limit 250")
def k05(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").orderBy(hash_order(19, F.col("c_custkey")), "c_custkey").limit(250)


@query("k06_stratified_selection", """with r as (select event_id, user_id, event_type, sha256('23|' || event_id) as h from events), w as (select *, row_number() over (partition by event_type, user_id order by h) as k from r),
  u as (select event_type, user_id, row_number() over (partition by event_type order by sha256('29|' || user_id)) as g from (select distinct event_type, user_id from r)) select event_id from w join u using (event_type, user_id) where k <= 2 and g <= 10""")
def k06(t: Tables) -> DataFrame:
    r = rel_top(t.events.select("event_id", "user_id", "event_type"), ["event_type", "user_id"], 2, hash_order(23, F.col("event_id")))
    u = rel_top(t.events.select("event_type", "user_id").distinct(), ["event_type"], 10, hash_order(29, F.col("user_id")))
    return r.join(u, ["event_type", "user_id"], "left_semi").select("event_id")


@query("k07_longest", "select lang, doc_id from documents qualify row_number() over (partition by lang order by n_chars desc, doc_id) <= 5")
def k07(t: Tables) -> DataFrame:
    return rel_top(t.documents.select("lang", "doc_id", "n_chars"), ["lang"], 5, F.col("n_chars").desc(), F.col("doc_id")).select("lang", "doc_id")


# U: set operations


@query("u01_union_all", "select 'customer' as kind, c_nationkey::bigint as nation, c_acctbal as balance from customer union all select 'supplier', s_nationkey, s_acctbal from supplier")
def u01(t: Tables) -> DataFrame:
    a = t.customer.select(F.lit("customer").alias("kind"), F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_nationkey").cast("bigint").alias("nation"), F.col("s_acctbal").alias("balance")))


@query("u02_distinct_union", "select p_brand as x from part union select c_mktsegment from customer")
def u02(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_brand").alias("x")).union(t.customer.select("c_mktsegment")).distinct()


@query("u03_common_features", f"with {CELLS} select feature from cells where value > 60000 group by 1 having count(distinct context) = 5")
def u03(t: Tables) -> DataFrame:
    return cells(t).where("value > 60000").groupBy("feature").agg(F.countDistinct("context").alias("n")).where("n = 5").select("feature")


@query("u04_except", "select p_partkey as k from part except select l_partkey from lineitem where l_quantity > 40")
def u04(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("k")).subtract(t.lineitem.where("l_quantity > 40").select("l_partkey"))


@query("u05_multiset_equality", """with s as (select count(*) as n from (select o_orderkey from orders except select l_orderkey from lineitem)), e as (select (select n from s) = 0 and count(*) = 0 as eq from (select l_orderkey from lineitem except select o_orderkey from orders))
  select 'orders and their lines' as pair, (select eq from e) as equal_sets, (select count(*) from orders) = (select count(*) from lineitem) and (select eq from e) and (select count(distinct l_orderkey) = count(*) from lineitem) as equal_multisets
  union all select 'orders shuffled', true, true""")
def u05(t: Tables) -> DataFrame:
    orders, lines = t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k"))
    n = lambda x, name: x.agg((F.count("*") == 0).alias(name))

    def pair(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
        sets, multisets = a.subtract(b).union(b.subtract(a)), a.exceptAll(b).union(b.exceptAll(a))
        return n(sets, "equal_sets").crossJoin(n(multisets, "equal_multisets")).withColumn("pair", F.lit(name))  # one row each

    return pair("orders and their lines", orders, lines).unionByName(pair("orders shuffled", orders, orders.repartition(5, F.xxhash64("k"))))


@query("u06_fold_leakage", "select 0::bigint as n_shared, 25::bigint as n_brands")
def u06(t: Tables) -> DataFrame:
    f = rel.group_folds(t.part, "p_brand", 5, 17)
    test, train = f.where("fold = 0").select("p_brand"), f.where("fold <> 0").select("p_brand")
    return test.intersect(train).agg(F.count("*").alias("n_shared")).crossJoin(f.agg(F.count("*").alias("n_brands")))


