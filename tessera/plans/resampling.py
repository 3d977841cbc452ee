"""L and J15, K08: folds, bootstrap, sign flips, references, controls and models."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import joined_hash, length_cost, unit
from tessera.operators import derangements as der
from tessera.operators import linear as lin
from tessera.operators import metrics as met
from tessera.operators import relational as rel
from tessera.operators import resampling as res
from tessera.operators.encoders import MODES, encode_texts
from tessera.operators.geometry import unordered_pairs
from tessera.operators.matching import stratified_group_folds
from tessera.operators.order import hash_positions

from .base import EFFECTS, METRICS, PAIRS, Tables, effects, metric_table, query, r6, view_correlations

WIDE = f"{METRICS}, wd as (select dataset, max(value) filter (model = '1-URGENT' and metric = 'rsa') - max(value) filter (model = '5-LOW' and metric = 'rsa') as d, max(value) filter (model = '1-URGENT' and metric = 'ndcg') - max(value) filter (model = '5-LOW' and metric = 'ndcg') as e from metric_table group by 1)"


def wide(t: Tables) -> DataFrame:
    """(dataset, d, e): differences of the first and the last model by both metrics."""
    v = lambda m, k: F.max(F.when((F.col("model") == m) & (F.col("metric") == k), F.col("value")))
    return metric_table(t).groupBy("dataset").agg((v("1-URGENT", "rsa") - v("5-LOW", "rsa")).alias("d"), (v("1-URGENT", "ndcg") - v("5-LOW", "ndcg")).alias("e"))


def boot_sql(source: str, group: str, key: str, value: str, draws: int, seed: int) -> str:
    return f"""u as (select {group} as g, {value} as v, row_number() over (partition by {group} order by {key}) - 1 as idx, count(*) over (partition by {group}) as n from {source} where {value} is not null),
  sl as (select g, idx as slot, n, unnest(range(0, {draws})) as draw from u), pk as (select g, draw, ('0x' || substr(sha256(concat_ws('|', '{seed}', g::varchar, draw::varchar, slot::varchar)), 1, 8))::bigint % n as idx from sl),
  mn as (select g, draw, avg(v) as m from pk join u using (g, idx) group by all), ci as (select g, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from mn group by 1), me as (select g, count(*) as n, avg(v) as mean from u group by 1)"""


@query("l01_bootstrap_ci", f"with {METRICS}, src as (select * from metric_table where metric = 'rsa'), {boot_sql('src', 'model', 'dataset', 'value', 200, 7)} select g as model, n::bigint as n, round(mean, 6) + 0.0 as mean, round(lo, 6) + 0.0 as lo, round(hi, 6) + 0.0 as hi from me join ci using (g)")
def l01(t: Tables) -> DataFrame:
    b = res.bootstrap_ci(metric_table(t).where("metric = 'rsa'"), "model", "dataset", "value", 200, 7)
    return b.select("model", "n", r6("mean").alias("mean"), r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("l02_entity_bootstrap", f"with {WIDE}, src as (select 'all' as k, * from wd), {boot_sql('src', 'k', 'dataset', 'd', 500, 11)} select n::bigint as n, round(mean, 6) + 0.0 as mean, round(lo, 6) + 0.0 as lo, round(hi, 6) + 0.0 as hi from me join ci using (g)")
def l02(t: Tables) -> DataFrame:
    b = res.bootstrap_ci(wide(t).withColumn("k", F.lit("all")), "k", "dataset", "d", 500, 11)
    return b.select("n", r6("mean").alias("mean"), r6("lo").alias("lo"), r6("hi").alias("hi"))


FLIPS = """x as (select g, list_sort(list(v)) as x, count(*) as n from fl where abs(v) > 1e-15 group by 1), m as (select g, x, n, unnest(range(0, (2 ** n)::bigint)) as m from x),
  s as (select g, n, abs(list_sum([case when (m // (2 ** (i - 1))::bigint) % 2 = 1 then -x[i] else x[i] end for i in range(1, n + 1)]) / n) >= abs(list_sum(x) / n) - 1e-15 as ge from m)"""


@query("l03_sign_flip", f"with {EFFECTS}, fl as (select entity as g, round(avg(effect), 2) as v, context from effects group by all), {FLIPS} select g as entity, n::bigint as n, round(avg(ge::int), 6) + 0.0 as p from s group by all")
def l03(t: Tables) -> DataFrame:
    d = effects(t).groupBy("entity", "context").agg(F.round(F.avg("effect"), 2).alias("v"))
    return res.sign_flip(d, "entity", "v").select("entity", "n", r6("p").alias("p"))


@query("l04_model_closure", f"""with {METRICS}, p as (select a.model as one, b.model as two, a.dataset, round(a.value - b.value, 6) as d from metric_table a join metric_table b on a.dataset = b.dataset and a.metric = b.metric and a.model < b.model where a.metric = 'rsa')
  select one, two, round(avg(d), 6) + 0.0 as mean, round(median(d), 6) + 0.0 as median, count(*) filter (d > 0)::bigint as wins, count(*) filter (d < 0)::bigint as losses, count(*) filter (d = 0)::bigint as ties from p group by all""")
def l04(t: Tables) -> DataFrame:
    p = unordered_pairs(metric_table(t).where("metric = 'rsa'").select("dataset", "model", "value"), "dataset", "model").withColumn("d", F.round(F.col("value_a") - F.col("value_b"), 6))
    n = lambda c: F.count_if(c)
    return p.groupBy(F.col("i").alias("one"), F.col("j").alias("two")).agg(r6(F.avg("d")).alias("mean"), r6(F.median("d")).alias("median"), n(F.col("d") > 0).alias("wins"), n(F.col("d") < 0).alias("losses"), n(F.col("d") == 0).alias("ties"))


@query("l05_grouped_folds", "with f as (select p_brand, (row_number() over (order by sha256('43|' || p_brand), p_brand) - 1) % 4 as fold from (select distinct p_brand from part)) select fold::bigint as fold, count(*)::bigint as n_rows, count(distinct p_brand)::bigint as n_groups from part join f using (p_brand) group by 1")
def l05(t: Tables) -> DataFrame:
    f = rel.group_folds(t.part, "p_brand", 4, 43)
    return t.part.join(f, "p_brand").groupBy("fold").agg(F.count("*").alias("n_rows"), F.countDistinct("p_brand").alias("n_groups"))


L06 = """c as (select source as g, lang, count(*) as n from documents where source is not null and lang is not null group by all), t as (select lang, sum(n)::double as n from c group by 1),
  cl as (select list(lang order by lang) as cs, list(n order by lang) as ts from t), f as (select g, list(coalesce(c.n, 0)::double order by t.lang) as ns from (select distinct g from c) g cross join t left join c using (g, lang) group by g),
  o as (select g, ns, row_number() over (order by -round(list_sum(list_transform(list_zip(ns, ts), lambda z: (z[1] / z[2]) ** 2)), 12), sha256('47|' || g)) as k from f, cl),
  p as (select 0::bigint as k, null::varchar as g, 0 as fold, [list_transform(cs, lambda x: 0.0::double) for i in range(3)] as loads from cl
    union all select k, g, fold, [case when i = fold then list_transform(list_zip(loads[i + 1], ns), lambda z: z[1] + z[2]) else loads[i + 1] end for i in range(3)] from (
      select o.k, o.g, o.ns, p.loads, list_sort([{'c': round(list_sum(list_transform(list_zip(p.loads[i + 1], o.ns, cl.ts), lambda z: z[1] * z[2] / z[3] ** 2)), 12), 's': list_sum(p.loads[i + 1]), 'f': i} for i in range(3)])[1].f as fold
      from p join o on o.k = p.k + 1, cl))"""


@query("l06_stratified_group_folds", f"with recursive {L06} select d.lang, p.fold::bigint as fold, count(*)::bigint as n_rows, count(distinct d.source)::bigint as n_groups, 0::bigint as n_split from documents d join p on d.source = p.g group by 1, 2")
def l06(t: Tables) -> DataFrame:
    f = stratified_group_folds(t.documents, "source", "lang", 3, 47)
    split = f.groupBy("source").agg(F.countDistinct("fold").alias("k"))
    d = t.documents.join(f, "source").join(split, "source")
    return d.groupBy("lang", "fold").agg(F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_groups"), F.countDistinct(F.when(F.col("k") > 1, F.col("source"))).alias("n_split"))


@query("l07_context_out", f"with {EFFECTS}, c as (select distinct context as target from effects), r as (select target, entity, count(distinct context) filter (context <> target) as k, bool_or(context = target) as has from effects, c group by all) select target, count(*) filter (has and k >= 2)::bigint as n_supported, count(*)::bigint as n_entities from r group by 1")
def l07(t: Tables) -> DataFrame:
    # an entity supports a target that is one of its contexts if two others are left; all entities count for each target
    e = effects(t).groupBy("entity").agg(F.collect_set("context").alias("ctx"))
    own = e.select("entity", F.size("ctx").alias("k"), F.explode("ctx").alias("target"))
    return own.groupBy("target").agg(F.count_if(F.col("k") > 2).alias("n_supported")).join(e.agg(F.count("*").alias("n_entities")))


@query("l08_double_hold_out", f"with {EFFECTS}, f as (select entity, (row_number() over (order by sha256('53|' || entity), entity) - 1) % 5 as fold from (select distinct entity from effects)) select case when fold = 0 and context = 'ASIA' then 'query' when fold <> 0 and context <> 'ASIA' then 'source' else 'unused' end as role, count(*)::bigint as n from effects join f using (entity) group by 1")
def l08(t: Tables) -> DataFrame:
    e = effects(t)
    j = e.join(rel.group_folds(e, "entity", 5, 53), "entity")
    role = F.when((F.col("fold") == 0) & (F.col("context") == "ASIA"), "query").when((F.col("fold") != 0) & (F.col("context") != "ASIA"), "source").otherwise("unused")
    return j.groupBy(role.alias("role")).agg(F.count("*").alias("n"))


FOLDS, LANDMARKS = 5, 256


def landmark_rows(t: Tables, mode: str = "perturbation_only") -> DataFrame:
    """(vec_id, fold, others, x, y): features by 256 landmarks in hash order, three dimensions as targets, and the folds
    that a row trains."""
    v = t.embeddings.select("vec_id", unit(F.col("embedding").cast("array<double>")).alias("u"))
    v = v.select("vec_id", "u", F.slice("u", 1, 48).alias("text"), F.slice("u", 17, 48).alias("resp"), F.slice("u", 1, 3).alias("y"), (F.col("vec_id") % FOLDS).alias("fold"))
    marks = lin.choose_landmarks(v, "vec_id", LANDMARKS, 59)
    side = lambda c: np.array([r[c] for r in marks])
    if mode == "interaction":
        x = lin.landmark_features(v, "text", side("text"), "resp", side("resp"), mode)
    else:
        x = lin.landmark_features(v, "u", side("u"))
    return x.select("vec_id", "fold", other_folds().alias("others"), "x", "y")


def other_folds() -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(FOLDS - 1)), lambda m: m != F.col("fold"))


def _predicted(rows: DataFrame) -> DataFrame:
    p = lin.LandmarkRidge(10.0).fit(rows, "x", "y", F.col("others")).predict(rows, "x", F.col("fold"))
    return p.select("fold", "vec_id", F.transform("prediction", lambda v: F.round(v, 6) + 0.0).alias("prediction"))


@query("l09_landmark_ridge")
def l09(t: Tables) -> DataFrame:
    return _predicted(landmark_rows(t))


@query("l09c_interaction_ridge")
def l09c(t: Tables) -> DataFrame:
    # features are products of two kernels
    return _predicted(landmark_rows(t, "interaction"))


@query("l09b_one_landmark", "with d as (select event_id % 2 as fold, value as x, value * 2 + event_id % 3 as y, event_id % 10 > 0 as train from events), m as (select fold, avg(x) as mx, avg(y) as my, stddev_pop(x) as sd, sum(1) as n from d where train group by 1), b as (select d.fold, max(mx) as mx, max(my) as my, max(sd) as sd, sum((x - mx) / sd * (y - my)) / (sum(((x - mx) / sd) ** 2) + 10) as b from d join m using (fold) where train group by 1) select fold, round(avg(my + (x - mx) / sd * b), 6) + 0.0 as mean_prediction from d join b using (fold) where not train group by 1")
def l09b(t: Tables) -> DataFrame:
    d = t.events.select((F.col("event_id") % 2).alias("fold"), F.array("value").alias("x"), F.array(F.col("value") * 2 + F.col("event_id") % 3).alias("y"), (F.col("event_id") % 10 > 0).alias("train"))
    model = lin.LandmarkRidge(10.0).fit(d, "x", "y", F.when(F.col("train"), F.array("fold")))
    return model.predict(d.where("not train"), "x", F.col("fold")).groupBy("fold").agg(r6(F.avg(F.col("prediction")[0])).alias("mean_prediction"))


@query("l10_predict_distinct", """with v as (select vec_id, vec_id % 5 as fold, embedding::double[] as u from embeddings), m as (select u as w, row_number() over (order by sha256('59|' || vec_id), vec_id) as k from v qualify k <= 256),
  f as (select vec_id, fold, list(round(list_cosine_similarity(u, w)) + 0.0 order by k) as x from v, m group by all) select fold, x, count(*)::bigint as n, 1::bigint as n_predictions from f group by all""")
def l10(t: Tables) -> DataFrame:
    # equal inputs are predicted once and have bitwise equal predictions
    d = landmark_rows(t).withColumn("x", F.transform("x", lambda v: F.round(v, 0) + 0.0))
    p = lin.LandmarkRidge(10.0).fit(d, "x", "y", F.col("others")).predict_distinct(d.select("vec_id", "fold", "x"), "x", "fold")
    return p.groupBy("fold", "x").agg(F.count("*").alias("n"), F.countDistinct("prediction").alias("n_predictions"))


@query("l11_references", f"with {EFFECTS}, s as (select * from effects where context <> 'ASIA'), g as (select feature, avg(effect) as m, median(effect) as md from s group by 1), d as (select entity, feature, avg(effect) as m from s group by all) select e.entity, e.feature, 0.0::double as zero, round(g.m, 6) + 0.0 as source_mean, round(g.md, 6) + 0.0 as source_median, round(d.m, 6) + 0.0 as same_entity from effects e join g using (feature) left join d on d.entity = e.entity and d.feature = e.feature where e.context = 'ASIA'")
def l11(t: Tables) -> DataFrame:
    e = effects(t)
    s = e.where("context <> 'ASIA'")
    g = s.groupBy("feature").agg(F.avg("effect").alias("m"), F.median("effect").alias("md"))
    d = s.groupBy("entity", "feature").agg(F.avg("effect").alias("dm"))
    return e.where("context = 'ASIA'").join(g, "feature").join(d, ["entity", "feature"], "left").select("entity", "feature", F.lit(0.0).alias("zero"), r6("m").alias("source_mean"), r6("md").alias("source_median"), r6("dm").alias("same_entity"))


@query("l12_field_readout")
def l12(t: Tables) -> DataFrame:
    labels = sorted(str(r.label) for r in t.embeddings.where("label is not null").select("label").distinct().collect())
    truth = F.col("label").cast("string")
    v = t.embeddings.where("label is not null").select(truth.alias("truth"), F.col("embedding").alias("x"), F.array(*[(truth == k).cast("double") for k in labels]).alias("y"), (F.col("vec_id") % FOLDS).alias("fold"))
    p = lin.LandmarkRidge(10.0).fit(v, "x", "y", other_folds()).predict(v, "x", F.col("fold"))
    # the first of equal predictions is the lexically least label
    best = F.element_at(F.lit(labels), F.array_position("prediction", F.array_max("prediction")).cast("int"))
    return met.classification(p.select("truth", best.alias("pred")), "truth", "pred").select(*[r6(c).alias(c) for c in ("accuracy", "macro_f1", "balanced_accuracy")])


@query("l13_registry", f"with {METRICS}, m as (select distinct model from metric_table), k as (select distinct metric from metric_table) select a.model as method, metric, b.model as baseline, substr(sha256(concat_ws(chr(31), a.model, metric, b.model)), 1, 16) as id from m a, k, m b where a.model <> b.model")
def l13(t: Tables) -> DataFrame:
    # every method against every other by every metric that the table has: two short lists of names
    m = metric_table(t)
    methods = m.select(F.col("model").alias("method")).distinct()
    pairs = methods.crossJoin(F.broadcast(methods.withColumnRenamed("method", "baseline"))).where("method <> baseline")
    return pairs.crossJoin(F.broadcast(m.select("metric").distinct())).select("method", "metric", "baseline", joined_hash(F.col("method"), F.col("metric"), F.col("baseline"), digits=16).alias("id"))


@query("l14_derangement", "with b as (select p_brand, row_number() over (order by sha256('61|' || p_brand), p_brand) as k, count(*) over () as n from (select distinct p_brand from part)) select a.p_brand as entity, b.p_brand as given from b a join b on b.k = a.k % a.n + 1")
def l14(t: Tables) -> DataFrame:
    # rotation in hash order: no entity keeps its own text
    b = hash_positions(t.part.select("p_brand").where("p_brand is not null").distinct(), "p_brand", 61, "k").withColumn("k", F.col("k") + 1)
    n = b.agg(F.count("*").alias("n"))
    return b.join(F.broadcast(n)).select(F.col("p_brand").alias("entity"), (F.col("k") % F.col("n") + 1).alias("k")).join(b.withColumnRenamed("p_brand", "given"), "k").select("entity", "given")


def _mapping(t: Tables) -> tuple[list, DataFrame]:
    """The list of test items and five derangements of their texts."""
    rows = t.benchmark.orderBy("item_id").select("item_id", "text").limit(der.MAX_ENTITIES + 1).collect()
    lengths = np.array([(len(r.text), len(r.text.split())) for r in rows])
    return rows, der.balanced_derangements(t.spark, lengths, [hashlib.sha256(r.text.encode()).hexdigest() for r in rows], 5, (67, 68), (0.01, 0.05), 20)


def _named(t: Tables, rows: list, maps: DataFrame) -> DataFrame:
    """(perm, item_id, given, text) with the items' ids."""
    ids = F.lit([r.item_id for r in rows])
    m = maps.select(F.col("place").alias("perm"), F.posexplode(F.arrays_zip("given", "signature")).alias("k", "g"))
    return m.select("perm", F.get(ids, "k").alias("item_id"), F.get(ids, F.col("g.given").cast("int")).alias("given"), F.col("g.signature").alias("text"))


@query("l15_balanced_derangements")
def l15(t: Tables) -> DataFrame:
    return _named(t, *_mapping(t)).select("perm", "item_id", "given")


@query("l16_mapping_quality")
def l16(t: Tables) -> DataFrame:
    rows, maps = _mapping(t)
    m = _named(t, rows, maps)
    size = t.benchmark.select("item_id", F.length("text").alias("n"), F.size(F.split(F.trim("text"), r"\s+")).alias("w"))
    j = m.join(size, "item_id").join(size.select(F.col("item_id").alias("given"), F.col("n").alias("gn"), F.col("w").alias("gw")), "given")
    ratio = lambda a, b: F.greatest(F.col(a) / F.col(b), F.col(b) / F.col(a))
    cost = length_cost(F.col("n"), F.col("gn")) + length_cost(F.col("w"), F.col("gw"))
    per = j.groupBy("perm").agg(r6(F.sum(cost)).alias("cost"), r6(F.max(ratio("n", "gn"))).alias("worst_ratio"), r6(F.median(ratio("w", "gw"))).alias("median_word_ratio"), F.count_if(F.col("item_id") == F.col("given")).alias("n_fixed"))
    apart = m.alias("a").join(m.alias("b"), "item_id").where("a.perm <> b.perm").groupBy(F.col("a.perm").alias("perm"), F.col("b.perm").alias("other")).agg(F.count_if(F.col("a.text") != F.col("b.text")).alias("d"))
    out = per.join(apart.groupBy("perm").agg(F.min("d").alias("least_distance")), "perm")
    return out.join(maps.select(F.col("place").alias("perm"), r6("ratio").alias("cost_ratio")), "perm")


@query("j15_assignment")
def j15(t: Tables) -> DataFrame:
    def nation(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("s_suppkey")
        a = p["s_acctbal"].to_numpy()
        return pd.DataFrame({"s_suppkey": p["s_suppkey"], "slot": res.assign(np.abs(a[:, None] - np.roll(a, 1)[None, :]))})

    return t.supplier.select("s_nationkey", "s_suppkey", "s_acctbal").groupBy("s_nationkey").applyInPandas(nation, "s_suppkey bigint, slot bigint")


@query("k08_diverse_selection")
def k08(t: Tables) -> DataFrame:
    v = F.array(F.col("p_size").cast("bigint"), F.col("p_partkey") % 7, F.col("p_partkey") % 11)
    got = der.diverse_selection(t.part.select(v.alias("v"), F.lit(0.0).alias("cost")), "v", "cost", 10)
    return got.select("place", *[F.col("v")[k].alias(n) for k, n in enumerate("abc")])


@query("l17_prompt_registry", "with p as (select p_partkey, p_brand, p_type from part) select perm::bigint as perm, p_partkey, substr(sha256(concat_ws(chr(31), perm::varchar, p_brand, p_type)), 1, 16) as prompt_id from p, range(0, 3) r(perm)")
def l17(t: Tables) -> DataFrame:
    p = t.part.withColumn("perm", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))))
    return p.select("perm", "p_partkey", joined_hash(F.col("perm"), F.col("p_brand"), F.col("p_type"), digits=16).alias("prompt_id"))


@query("l18_correct_vs_shuffled", f"with {METRICS}, m as (select metric, dataset, max(value) filter (model = '1-URGENT') as correct, list(value) filter (model <> '1-URGENT') as sh from metric_table group by all) select metric, round(avg(correct - list_avg(sh)), 6) + 0.0 as gain, round(quantile_cont(correct - list_avg(sh), 0.5), 6) + 0.0 as median, sum(len(list_filter(sh, lambda x: x >= correct)))::bigint as n_as_good from m group by 1")
def l18(t: Tables) -> DataFrame:
    one = F.col("model") == "1-URGENT"
    m = metric_table(t).groupBy("metric", "dataset").agg(F.max(F.when(one, F.col("value"))).alias("c"), F.avg(F.when(~one, F.col("value"))).alias("s"), F.collect_list(F.when(~one, F.col("value"))).alias("sh"))
    m = m.withColumn("k", F.size(F.filter("sh", lambda x: x >= F.col("c"))))
    return m.groupBy("metric").agg(r6(F.avg(F.col("c") - F.col("s"))).alias("gain"), r6(F.percentile(F.col("c") - F.col("s"), F.lit(0.5))).alias("median"), F.sum("k").alias("n_as_good"))


DELTAS = (("1-URGENT", "2-HIGH"), ("1-URGENT", "3-MEDIUM"), ("2-HIGH", "5-LOW"), ("3-MEDIUM", "5-LOW"))


@query("l19_view_deltas", f"with {METRICS} select a.dataset, a.metric, a.model as source, b.model as target, round(b.value - a.value, 6) + 0.0 as delta from metric_table a join metric_table b on a.dataset = b.dataset and a.metric = b.metric where (a.model, b.model) in (('1-URGENT', '2-HIGH'), ('1-URGENT', '3-MEDIUM'), ('2-HIGH', '5-LOW'), ('3-MEDIUM', '5-LOW'))")
def l19(t: Tables) -> DataFrame:
    m = metric_table(t)
    steps = F.inline(F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in DELTAS]))
    one = m.select("dataset", "metric", "model", "value", steps).where("model = source").select("dataset", "metric", "source", "target", F.col("value").alias("v"))
    return one.join(m.select("dataset", "metric", F.col("model").alias("target"), "value"), ["dataset", "metric", "target"]).select("dataset", "metric", "source", "target", r6(F.col("value") - F.col("v")).alias("delta"))


@query("l20_paired_conditions", f"with {WIDE}, src as (select 'e' as k, * from wd), {boot_sql('src', 'k', 'dataset', 'e', 300, 13)} select n::bigint as n, round(mean, 6) + 0.0 as mean, round(lo, 6) + 0.0 as lo, round(hi, 6) + 0.0 as hi from me join ci using (g)")
def l20(t: Tables) -> DataFrame:
    m = metric_table(t).where("metric = 'ndcg'").groupBy("dataset").pivot("model", ["1-URGENT", "5-LOW"]).agg(F.first("value"))
    d = m.select("dataset", F.lit("e").alias("k"), (F.col("1-URGENT") - F.col("5-LOW")).alias("e"))
    return res.bootstrap_ci(d, "k", "dataset", "e", 300, 13).select("n", r6("mean").alias("mean"), r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("l21_identity_gain", f"with {METRICS} select a.dataset, round(a.value - b.value, 6) + 0.0 as gain from metric_table a join metric_table b on a.dataset = b.dataset and a.metric = b.metric where a.metric = 'ndcg' and a.model = '2-HIGH' and b.model = '3-MEDIUM'")
def l21(t: Tables) -> DataFrame:
    m = metric_table(t).where("metric = 'ndcg'")
    a, b = (m.where(F.col("model") == k).select("dataset", F.col("value").alias(n)) for k, n in (("2-HIGH", "x"), ("3-MEDIUM", "y")))
    return rel.contract_join(a, b, ["dataset"], validate="one_to_one").select("dataset", r6(F.col("x") - F.col("y")).alias("gain"))


@query("l22_group_contrast", f"with {METRICS} select dataset, metric, round(avg(value) filter (model in ('1-URGENT', '2-HIGH', '3-MEDIUM')) - avg(value) filter (model in ('4-NOT SPECIFIED', '5-LOW')), 6) + 0.0 as contrast from metric_table group by all")
def l22(t: Tables) -> DataFrame:
    side = lambda *k: F.avg(F.when(F.col("model").isin(*k), F.col("value")))
    return metric_table(t).groupBy("dataset", "metric").agg(r6(side("1-URGENT", "2-HIGH", "3-MEDIUM") - side("4-NOT SPECIFIED", "5-LOW")).alias("contrast"))


STATES = f"{EFFECTS}, p as (select entity, feature, context, effect, avg(effect) over (partition by feature, context) as direct, avg(effect) over (partition by feature) as state from effects)"


@query("l23_state_gain", f"with {STATES} select context, round(avg(abs(effect - direct)), 6) + 0.0 as direct_mae, round(avg(abs(effect - state)), 6) + 0.0 as state_mae, round(avg(abs(effect - direct) - abs(effect - state)), 6) + 0.0 as gain from p group by 1")
def l23(t: Tables) -> DataFrame:
    e = effects(t).select("entity", "feature", "context", "effect")
    p = e.withColumn("direct", F.avg("effect").over(Window.partitionBy("feature", "context"))).withColumn("state", F.avg("effect").over(Window.partitionBy("feature")))
    a, b = F.abs(F.col("effect") - F.col("direct")), F.abs(F.col("effect") - F.col("state"))
    return p.groupBy("context").agg(r6(F.avg(a)).alias("direct_mae"), r6(F.avg(b)).alias("state_mae"), r6(F.avg(a - b)).alias("gain"))


@query("l24_paired_table", f"with {METRICS}, a as (select * from metric_table where model = '1-URGENT' and dataset <> 3), b as (select * from metric_table where model = '4-NOT SPECIFIED' and dataset <> 5), j as (select coalesce(a.dataset, b.dataset) as dataset, coalesce(a.metric, b.metric) as metric, a.value - b.value as d, case when a.dataset is null then 'right_only' when b.dataset is null then 'left_only' else 'both' end as side from a full join b on a.dataset = b.dataset and a.metric = b.metric) select metric, round(avg(d), 6) + 0.0 as difference, count(*)::bigint as n_total, count(d)::bigint as n_valid, count(*) filter (side = 'left_only')::bigint as n_left_only from j group by 1")
def l24(t: Tables) -> DataFrame:
    m = metric_table(t)
    a = m.where("model = '1-URGENT' and dataset <> 3").select("dataset", "metric", F.col("value").alias("a"))
    b = m.where("model = '4-NOT SPECIFIED' and dataset <> 5").select("dataset", "metric", F.col("value").alias("b"))
    j = a.join(b, ["dataset", "metric"], "full").withColumn("d", F.col("a") - F.col("b"))
    return j.groupBy("metric").agg(r6(F.avg("d")).alias("difference"), F.count("*").alias("n_total"), F.count("d").alias("n_valid"), F.count_if(F.col("b").isNull()).alias("n_left_only"))


@query("l25_text_encoder")
def l25(t: Tables) -> DataFrame:
    v = encode_texts(t.conversations.select("conv_id", "turn", "text"), "text", modes=MODES)
    return v.select("conv_id", "turn", *[F.transform(m, lambda x: F.round(x, 6) + 0.0).alias(m) for m in MODES])


@query("l26_cache_plan", "with m as (select unnest(['a', 'b']) as model), x as (select model, sha256(text) as sha from (select distinct text from benchmark), m), c as (select 'a' as model, sha256(text) as sha from benchmark where item_id % 2 = 0) select x.model, x.sha, c.sha is not null as hit from x left join c on x.model = c.model and x.sha = c.sha")
def l26(t: Tables) -> DataFrame:
    texts = t.benchmark.select(F.sha2("text", 256).alias("sha")).distinct().withColumn("model", F.explode(F.lit(["a", "b"])))
    cache = t.benchmark.where("item_id % 2 = 0").select(F.lit("a").alias("model"), F.sha2("text", 256).alias("sha")).distinct().withColumn("hit", F.lit(True))
    return texts.join(cache, ["model", "sha"], "left").select("model", "sha", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("l27_fixed_contrasts", f"with {METRICS}, w as (select dataset, model, max(value) filter (metric = 'rsa') as readout, max(value) filter (metric = 'ndcg') as geometry from metric_table group by all) select a.dataset, b.model, round(b.readout - a.readout, 6) + 0.0 as d_readout, round(b.geometry - a.geometry, 6) + 0.0 as d_geometry, sign(b.readout - a.readout) = sign(round(b.geometry - a.geometry, 6)) as same_sign from w a join w b on a.dataset = b.dataset and a.model = '1-URGENT' and b.model <> '1-URGENT'")
def l27(t: Tables) -> DataFrame:
    w = metric_table(t).groupBy("dataset", "model").pivot("metric", ["rsa", "ndcg"]).agg(F.max("value"))
    base = w.where("model = '1-URGENT'").select("dataset", F.col("rsa").alias("r0"), F.col("ndcg").alias("g0"))
    j = w.where("model <> '1-URGENT'").join(base, "dataset")
    r, g = F.round(F.col("rsa") - F.col("r0"), 6), F.round(F.col("ndcg") - F.col("g0"), 6)
    return j.select("dataset", "model", (r + 0.0).alias("d_readout"), (g + 0.0).alias("d_geometry"), (F.signum(r) == F.signum(g)).alias("same_sign"))


@query("l28_baseline_pairs", f"with {EFFECTS}, p as (select entity, context, feature, abs(effect) as err from effects), b as (select context, feature, avg(err) as base, max(err) - min(err) > 0.05 as valid from p group by all) select context, round(avg(base - err) filter (valid), 6) + 0.0 as gain, count(*) filter (valid)::bigint as n_valid, count(*)::bigint as n_total from p join b using (context, feature) group by 1")
def l28(t: Tables) -> DataFrame:
    p = effects(t).select("context", "feature", F.abs("effect").alias("err"))
    b = p.groupBy("context", "feature").agg(F.avg("err").alias("base"), (F.max("err") - F.min("err") > 0.05).alias("valid"))
    j = p.join(b, ["context", "feature"])
    return j.groupBy("context").agg(r6(F.avg(F.when(F.col("valid"), F.col("base") - F.col("err")))).alias("gain"), F.count_if("valid").alias("n_valid"), F.count("*").alias("n_total"))


@query("l29_registry_evaluation", f"""with {PAIRS}, u as (select label, 'text' as object, x as s, y from rep_pairs union all select label, 'fused', (x + y) / 2, y from rep_pairs), r as (select label, object, rank() over (partition by label, object order by s) + 0.0::double as a, rank() over (partition by label, object order by y) + 0.0::double as b from u),
  c as (select label, object, corr(a, b) as rho from r group by all) select a.label, round(a.rho, 6) + 0.0 as text_rho, round(b.rho - a.rho, 6) + 0.0 as contrast from c a join c b on a.label = b.label and a.object = 'text' and b.object = 'fused'""")
def l29(t: Tables) -> DataFrame:
    s = view_correlations(t, lambda x, y: y, text=lambda x, y: x, fused=lambda x, y: (x + y) / 2)
    w = s.groupBy("label").pivot("measure", ["text", "fused"]).agg(F.first("rho"))
    return w.select("label", r6("text").alias("text_rho"), r6(F.col("fused") - F.col("text")).alias("contrast"))


