"""V: vector geometry."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import dot, norm, unit
from tessera.operators import geometry as geo
from tessera.operators import pairblocks as pb
from tessera.operators.pairblocks import view_pairs
from tessera.sources.shared import store

from .base import EFFECTS, PAIRS, TWO_VIEWS, VIEWS, Tables, effects, labelled, query, r6, rep_pairs, rounded_pairs, two_views


@query("v01_cosine_pairs", f"with {PAIRS} select label, i, j, round(x, 6) + 0.0 as sim from rep_pairs")
def v01(t: Tables) -> DataFrame:
    return view_pairs(labelled(t), "label", "vec_id", "embedding", {"x": VIEWS["x"]}, t.largest("embeddings", "label"), {"sim": (lambda x: x, 6)})


DUPLICATED = "dup as (select label, vec_id, text, vec_id - (vec_id % 2) as rep from two_views), d2 as (select a.label, a.vec_id, coalesce(b.text, a.text) as text from dup a left join dup b on b.vec_id = a.rep and b.label = a.label)"


@query("v02_distinct_cosine", f"with {TWO_VIEWS}, {DUPLICATED} select a.label, a.vec_id as i, b.vec_id as j, round(list_cosine_similarity(a.text, b.text), 6) + 0.0 as sim from d2 a join d2 b on a.label = b.label and a.vec_id < b.vec_id")
def v02(t: Tables) -> DataFrame:
    v = two_views(t).select("label", "vec_id", "text")
    other = v.select("label", F.col("vec_id").alias("rep"), F.col("text").alias("shared"))
    d = v.withColumn("rep", F.col("vec_id") - F.col("vec_id") % 2).join(other, ["label", "rep"], "left").select("label", "vec_id", F.coalesce("shared", "text").alias("text"))
    return geo.distinct_cosine_pairs(d, "label", "vec_id", "text", largest=t.largest("embeddings", "label"), digits=6)


EFFECT_RANKS = f"""{EFFECTS}, rk as (select entity, context, feature, rank() over (partition by entity, context order by effect) + (count(*) over (partition by entity, context, effect) - 1) / 2.0::double as r,
  count(*) over (partition by entity, context) as n from effects)"""


@query("v03_spearman_pairs", f"with {EFFECT_RANKS} select a.context, a.entity as i, b.entity as j, round(corr(a.r, b.r), 6) + 0.0 as sim from rk a join rk b on a.context = b.context and a.feature = b.feature and a.entity < b.entity where a.n = 12 and b.n = 12 group by all")
def v03(t: Tables) -> DataFrame:
    v = geo.rows_to_vector(effects(t), ["context", "entity"], "feature", "effect", "v").where(F.size("v") == 12)
    return geo.spearman_pairs(v, "context", "entity", "v").select("context", "i", "j", r6("sim").alias("sim"))


BITS = "bits as (select c_custkey, c_nationkey::bigint as g, list_distinct(list_filter([c_custkey % 3, c_custkey % 5 + 3, c_custkey % 7 + 8], lambda x: x % 4 <> 0)) as b from customer)"


def bits(t: Tables) -> DataFrame:
    b = F.filter(F.array(F.col("c_custkey") % 3, F.col("c_custkey") % 5 + 3, F.col("c_custkey") % 7 + 8), lambda x: x % 4 != 0)
    return t.customer.select("c_custkey", F.col("c_nationkey").cast("bigint").alias("g"), F.array_distinct(b).alias("b"))


JACCARD = "case when len(list_distinct(list_concat(a.b, b.b))) = 0 then {empty} else len(list_intersect(a.b, b.b))::double / len(list_distinct(list_concat(a.b, b.b))) end"


@query("v04_jaccard", f"with {BITS} select a.g, a.c_custkey as i, b.c_custkey as j, round({JACCARD.format(empty='1.0')}, 6) + 0.0 as sim from bits a join bits b on a.g = b.g and a.c_custkey < b.c_custkey")
def v04(t: Tables) -> DataFrame:
    return pb.kind_pairs(bits(t), "g", "c_custkey", ["b"], overlaps(), t.largest("customer", "c_nationkey"))


def overlaps(empty: float | None = 1.0) -> Callable:
    return lambda a, b: pb.jaccards([k[0] for k in a], [k[0] for k in b], empty)


@query("v05_jaccard_nonempty", f"with {BITS} select a.g, a.c_custkey as i, b.c_custkey as j, round({JACCARD.format(empty='null')}, 6) + 0.0 as sim from bits a join bits b on a.g = b.g and a.c_custkey < b.c_custkey where len(a.b) > 0 and len(b.b) > 0")
def v05(t: Tables) -> DataFrame:
    ok = bits(t).where(F.size("b") > 0).where(F.assert_true(F.size("b") > 0).isNull())  # an empty set that got here would fail the run
    return pb.kind_pairs(ok, "g", "c_custkey", ["b"], overlaps(None), t.largest("customer", "c_nationkey"))


KERNEL = f"with {BITS}, d as (select bits.*, (c_custkey % 12) // 4 as dose from bits), k as (select a.g, a.c_custkey as i, b.c_custkey as j, {JACCARD.format(empty='1.0')} as jac, (a.dose = b.dose)::int as same from d a join d b on a.g = b.g and a.c_custkey < b.c_custkey)"


def kernel(t: Tables, combined: Callable) -> DataFrame:
    """(g, i, j, sim): a function of the overlap and of whether the dose is the same."""
    d = bits(t).withColumn("dose", F.floor(F.col("c_custkey") % 12 / 4))

    def output(a: list[tuple], b: list[tuple]) -> np.ndarray:
        return combined(overlaps()(a, b), pb.alike([k[1] for k in a], [k[1] for k in b]))

    return pb.kind_pairs(d, "g", "c_custkey", ["b", "dose"], output, t.largest("customer", "c_nationkey"))


@query("v06_structure_dose_kernel", f"{KERNEL} select g, i, j, round(0.5 * (jac + same), 6) + 0.0 as sim from k")
def v06(t: Tables) -> DataFrame:
    return kernel(t, lambda jac, same: 0.5 * (jac + same))


@query("v07_product_kernel", f"{KERNEL} select g, i, j, round(jac * (0.5 + 0.5 * same), 6) + 0.0 as sim from k")
def v07(t: Tables) -> DataFrame:
    return kernel(t, lambda jac, same: jac * (0.5 + 0.5 * same))


@query("v08_additive_kernel", f"with {PAIRS} select label, i, j, round((x + y) / 2, 6) + 0.0 as sim, round((case when i % 2 = 1 then y else x end + x) / 2, 6) + 0.0 as swapped from rep_pairs")
def v08(t: Tables) -> DataFrame:
    p = rounded_pairs(t, sim=(lambda x, y: (x + y) / 2, 6), x=(lambda x, y: (x + x) / 2, 6))
    return p.select("label", "i", "j", "sim", F.when(F.col("i") % 2 == 1, F.col("sim")).otherwise(F.col("x")).alias("swapped"))


@query("v09_affine_fusion", f"with {PAIRS} select label, i, j, round(0.5 * ((x + 1) / 2) + 0.5 * y, 6) + 0.0 as fused from rep_pairs")
def v09(t: Tables) -> DataFrame:
    return rounded_pairs(t, fused=(lambda x, y: 0.5 * ((x + 1) / 2) + 0.5 * y, 6))


#: Tables of ranks of up to so many labels are sent to all tasks; where labels are more, their pairs are dealt by label.
SENT_LABELS = 2_000


@query("v10_rank_fusion", f"""with {PAIRS}, q as (select label, i, j, round(x, 2) as x, round(y, 2) as y from rep_pairs), r as (select *, 2 * rank() over (partition by label order by x) + count(*) over (partition by label, x) - 1 as ra,
  2 * rank() over (partition by label order by y) + count(*) over (partition by label, y) - 1 as rb, count(*) over (partition by label) as m from q) select label, i, j, round((ra + rb - 4) / (4 * (m - 1)), 6) + 0.0 as fused from r""")
def v10(t: Tables) -> DataFrame:
    p = rounded_pairs(t, x=(lambda x, y: x, 2), y=(lambda x, y: y, 2))
    n = pb.value_counts(labelled(t), "label", "vec_id", "embedding", VIEWS, t.largest("embeddings", "label"), 2)
    # a label has at most 201 values a view: their ranks are one row, sent to the pairs by label
    w = Window.partitionBy("label", "view")
    n = n.withColumn("rank", 2 * F.sum("n").over(w.orderBy("value")) - F.col("n") + 1).withColumn("m", F.sum("n").over(w))
    table = n.groupBy("label").agg(F.max("m").alias("m"), *[F.map_from_entries(F.collect_list(F.when(F.col("view") == v, F.struct("value", "rank")))).alias(v) for v in VIEWS])
    spread = lambda v: F.transform(F.sequence(F.lit(-100), F.lit(100)), lambda k: F.try_element_at(F.col(v), k.cast("bigint")))
    table = table.select("label", "m", *[spread(v).alias(f"r{v}") for v in VIEWS])
    rank = lambda v: F.get(f"r{v}", F.rint(F.col(v) * 100).cast("int") + 100)
    fused = (rank("x") + rank("y") - 4) / F.nullif(4 * (F.col("m") - 1), F.lit(0))
    table = store(table, "label-ranks")
    few = table.count() <= SENT_LABELS
    return p.join(F.broadcast(table) if few else table, "label", "left").select("label", "i", "j", r6(fused).alias("fused"))


@query("v11_identity_exposure", "select a.p_partkey as i, b.p_partkey as j, round(((a.p_brand = b.p_brand)::int + (a.p_size = b.p_size)::int) / 2, 6) + 0.0 as sim from part a join part b on a.p_type = b.p_type and a.p_partkey < b.p_partkey")
def v11(t: Tables) -> DataFrame:
    def output(a: list[tuple], b: list[tuple]) -> np.ndarray:
        brand, size = (pb.alike([k[c] for k in a], [k[c] for k in b]) for c in (0, 1))
        return (brand + size) / 2

    return pb.kind_pairs(t.part, "p_type", "p_partkey", ["p_brand", "p_size"], output, t.largest("part", "p_type")).select("i", "j", "sim")


@query("v12_source_one_hot", "with v as (select distinct p_brand as f from part where p_partkey % 4 = 0 and p_brand <> 'Brand#11') select p_partkey, p_brand as feature, (f is not null)::int::bigint as known from part left join v on f = p_brand where p_partkey % 4 <> 0")
def v12(t: Tables) -> DataFrame:
    fitted = t.part.where("p_partkey % 4 = 0 and p_brand <> 'Brand#11'").select("p_brand").distinct().withColumn("known", F.lit(1))
    return t.part.where("p_partkey % 4 <> 0").join(fitted, "p_brand", "left").select("p_partkey", F.col("p_brand").alias("feature"), F.coalesce("known", F.lit(0)).cast("bigint").alias("known"))


@query("v13_matrix_qc", f"with {PAIRS} select label, count(*)::bigint as n_pairs, round(avg(isfinite(x)::int), 6) + 0.0 as finite, round(min(x), 6) + 0.0 as lo, round(max(x), 6) + 0.0 as hi, round(avg(x), 6) + 0.0 as mean, round(stddev_pop(x), 6) + 0.0 as sd, max(x) - min(x) <= 1e-12 as constant from rep_pairs group by 1")
def v13(t: Tables) -> DataFrame:
    x = F.col("x")
    return rep_pairs(t, "x").groupBy("label").agg(F.count("*").alias("n_pairs"), r6(F.avg((~F.isnan(x) & (F.abs(x) < float("inf"))).cast("int"))).alias("finite"), r6(F.min(x)).alias("lo"), r6(F.max(x)).alias("hi"), r6(F.avg(x)).alias("mean"), r6(F.stddev_pop(x)).alias("sd"), (F.max(x) - F.min(x) <= 1e-12).alias("constant"))


@query("v14_submatrix", f"with {PAIRS} select label, i, j, round(x, 6) + 0.0 as sim from rep_pairs where i % 3 = 0 and j % 3 = 0")
def v14(t: Tables) -> DataFrame:
    # the members are chosen before they are paired; the choice of rows is what the operator is for
    v = labelled(t).where("vec_id % 3 = 0")
    return view_pairs(v, "label", "vec_id", "embedding", {"x": VIEWS["x"]}, t.largest("embeddings", "label"), {"sim": (lambda x: x, 6)})


@query("v15_norm_audit", "select count(*)::bigint as n, bool_and(abs(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) - 1) <= 5e-4) as unit_rows, bool_and(len(embedding) = 64) as one_width from embeddings")
def v15(t: Tables) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return t.embeddings.agg(F.count("*").alias("n"), (F.max(F.abs(norm(v) - 1)) <= 5e-4).alias("unit_rows"), F.bool_and(F.size(v) == 64).alias("one_width"))


@query("v16_reproduction_diff", "with f as (select vec_id, embedding::double[] as a, list_transform(embedding::double[], lambda x: round(x, 3)) as b from embeddings) select vec_id, round(list_max(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))), 6) + 0.0 as max_abs, round(list_cosine_similarity(a, b), 6) + 0.0 as cosine from f")
def v16(t: Tables) -> DataFrame:

    frozen = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    new = frozen.select("vec_id", F.transform("a", lambda x: F.round(x, 3)).alias("b"))
    j = frozen.join(new, "vec_id")
    return j.select("vec_id", r6(F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))).alias("max_abs"), r6(dot(unit(F.col("a")), unit(F.col("b")))).alias("cosine"))


@query("v17_view_invariance", f"with {TWO_VIEWS} select label, true as multiples_alike, max(abs(list_cosine_similarity(text, resp) - 1)) <= 1e-5 as views_alike from two_views group by 1")
def v17(t: Tables) -> DataFrame:
    # views that are positive multiples of each other have cosine one within a condition; two different views don't
    u = lambda c: unit(F.col(c))
    v = two_views(t).withColumn("triple", F.transform("text", lambda x: x * 3))
    far = lambda c: F.max(F.abs(dot(u("text"), u(c)) - 1)) <= 1e-5
    return v.groupBy("label").agg(far("triple").alias("multiples_alike"), far("resp").alias("views_alike"))


@query("v18_multi_hot", """with m as (select o_custkey, list_sort(list(distinct o_orderpriority)) as b from orders group by 1), s as (select c_nationkey::bigint as g, c_custkey, b from customer join m on c_custkey = o_custkey)
  select a.g, a.c_custkey as i, b.c_custkey as j, round(len(list_intersect(a.b, b.b)) / len(list_distinct(list_concat(a.b, b.b))), 6) + 0.0 as sim from s a join s b on a.g = b.g and a.c_custkey < b.c_custkey""")
def v18(t: Tables) -> DataFrame:
    member = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("b"))
    s = t.customer.select("c_custkey", F.col("c_nationkey").cast("bigint").alias("g")).join(member, "c_custkey").select("g", "c_custkey", "b")
    return pb.kind_pairs(s, "g", "c_custkey", ["b"], overlaps(None), t.largest("customer", "c_nationkey"))


