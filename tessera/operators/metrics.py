"""Agreement, ranking and prediction metrics. Undefined values are null, with a status; ties are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import try_ratio

from .order import RANK_ROWS, with_ranks


def pearson(x: str, y: str) -> Column:
    """Pearson's r as an aggregate of sums; null where either side has no variance."""
    a, b = F.col(x), F.col(y)
    n = F.count(F.lit(1))
    sxy, sxx, syy = F.sum(a * b) - F.sum(a) * F.sum(b) / n, F.sum(a * a) - F.sum(a) * F.sum(a) / n, F.sum(b * b) - F.sum(b) * F.sum(b) / n
    tiny = F.lit(1e-12)
    return F.when((sxx > tiny * F.abs(F.sum(a * a))) & (syy > tiny * F.abs(F.sum(b * b))), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), try_ratio(sxy, F.sqrt(F.greatest(sxx, F.lit(0.0)) * F.greatest(syy, F.lit(0.0)))))))


def spearman(df: DataFrame, x: str, y: str, *group: str, minimum: int = 3, name: str = "rho", largest: int | None = None, most: int = RANK_ROWS, constant: tuple[str, ...] = ()) -> DataFrame:
    """(group, n, rho, status): rank correlation over the rows where both sides are known; ``largest`` and ``most`` as in
    ``with_ranks``. Where ``constant`` names ``x``, a literal that has no order, nothing is ranked."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    flat = lambda c: F.max(c) - F.min(c) <= 1e-12
    n = F.count(F.lit(1))
    status = F.when(n < minimum, "too_few").when(flat(x), "constant_text").when(flat(y), "constant_response").otherwise("ok")
    if x in constant:
        # without any order on a side there is nothing to rank
        return ok.groupBy(*group).agg(n.alias("n"), status.alias("status")).select(*group, "n", F.lit(None).cast("double").alias(name), "status")
    r = with_ranks(ok, {"_x": x, "_y": y}, *group, largest=largest, most=most)
    return r.groupBy(*group).agg(n.alias("n"), pearson("_x", "_y").alias("_r"), status.alias("status")).select(*group, "n", F.when(F.col("status") == "ok", F.col("_r")).alias(name), "status")


def both_ways(pairs: DataFrame, group: str) -> DataFrame:
    """Each unordered pair as (query, candidate) both ways."""
    rest = [c for c in pairs.columns if c not in (group, "i", "j")]
    return pairs.select(group, F.explode(F.array(F.struct(F.col("i").alias("q"), F.col("j").alias("c")), F.struct(F.col("j").alias("q"), F.col("i").alias("c")))).alias("_e"), *rest).select(group, "_e.q", "_e.c", *rest)


def fractional_topk(df: DataFrame, score: str, k: int, *query: str, name: str = "rel", times: str | None = None) -> DataFrame:
    """Top-k mass: 1 above the k-th value, an equal share of the open places at it, 0 below. With ``times`` a row stands
    for so many candidates, and has the mass of each."""
    s = F.col(score)
    if times:
        # the sum up to and with equal values, less theirs, is what lies above
        equal = F.sum(times).over(Window.partitionBy(*query, s))
        above = F.sum(times).over(Window.partitionBy(*query).orderBy(s.desc()).rangeBetween(Window.unboundedPreceding, 0)) - equal
        return df.withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k - above) / equal)))
    above = F.rank().over(Window.partitionBy(*query).orderBy(s.desc())) - 1
    equal = F.count(F.lit(1)).over(Window.partitionBy(*query, s))
    return df.withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k - above) / equal)))


def discount_sum(n: Column, k: int) -> Column:
    """Sum of the first min(n, k) discounts."""
    table = F.lit([0.0, *_discounts(k)])
    return F.element_at(table, (F.least(n, F.lit(k)) + 1).cast("int"))


def _discounts(k: int) -> list[float]:
    import math

    out = []
    for r in range(1, k + 1):
        out.append((out[-1] if out else 0.0) + 1 / math.log2(r + 1))
    return out


def expected_ndcg(df: DataFrame, truth: str, score: str, k: int, *query: str, minimum: int = 12, times: str | None = None) -> DataFrame:
    """(query, n, ndcg, random, excess, status): NDCG@k of the fractional top-k of ``truth`` under ``score``, expected
    over all orders of tied scores. Without any order in the truth or with too few candidates it is null. With ``times`` a
    row stands for so many candidates."""
    rel = fractional_topk(df, truth, k, *query, times=times)
    n = F.col(times) if times else F.lit(1)
    # the ideal order: a row's candidates take the next places, of which the first k count
    last = F.sum(n).over(Window.partitionBy(*query).orderBy(F.col("rel").desc(), F.col(truth).desc()).rowsBetween(Window.unboundedPreceding, 0))
    rel = rel.withColumn("_last", last).withColumn("_n", n)
    gain = F.col("rel") * (discount_sum(F.col("_last"), k) - discount_sum(F.col("_last") - F.col("_n"), k))
    total = F.sum("_n")
    ideal = rel.groupBy(*query).agg(F.sum(gain).alias("idcg"), (F.sum(F.col("rel") * F.col("_n")) / total).alias("mean_rel"), total.alias("n"), F.max(truth).alias("hi"), F.min(truth).alias("lo"))
    block = rel.groupBy(*query, score).agg((F.sum(F.col("rel") * F.col("_n")) / total).alias("m"), total.alias("sz"))
    block = block.withColumn("st", F.sum("sz").over(Window.partitionBy(*query).orderBy(F.col(score).desc())) - F.col("sz"))
    dcg = block.groupBy(*query).agg(F.sum(F.col("m") * (discount_sum(F.col("st") + F.col("sz"), k) - discount_sum(F.col("st"), k))).alias("dcg"))
    out = ideal.join(dcg, list(query))
    status = F.when((F.col("n") + 1 < minimum) | (F.col("n") <= k), "INSUFFICIENT_CANDIDATES").when(F.col("hi") == F.col("lo"), "UNINFORMATIVE_TRUTH").otherwise("ok")
    ndcg, rnd = try_ratio(F.col("dcg"), F.col("idcg")), try_ratio(F.col("mean_rel") * F.lit(_discounts(k)[-1]), F.col("idcg"))
    out = out.withColumn("status", status)
    ok = F.col("status") == "ok"
    return out.select(*query, "n", F.when(ok, ndcg).alias("ndcg"), F.when(ok, rnd).alias("random"), F.when(ok, ndcg - rnd).alias("excess"), "status")


#: Harmonic numbers up to this one are added up; above, an expansion is exact to the last digits of a double.
HARMONICS = 256


def harmonic(n: Column) -> Column:
    """The sum of the first n reciprocals; 0 for 0."""
    table = [0.0]
    for i in range(1, HARMONICS + 1):
        table.append(table[-1] + 1 / i)
    x = n.cast("double")
    far = F.ln(x) + F.lit(0.5772156649015329) + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(n <= HARMONICS, F.get(F.lit(table), n.cast("int"))).otherwise(far)


def expected_tie_retrieval(df: DataFrame, score: str, is_target: str, *query: str) -> DataFrame:
    """(query, n, mrr, hit1, random_mrr): reciprocal rank and Hit@1 of the one target, expected over tie orders."""
    t = df.groupBy(*query).agg(F.max(F.when(F.col(is_target), F.col(score))).alias("_t"))
    s = df.join(t, list(query))
    g = s.groupBy(*query).agg(F.sum((F.col(score) > F.col("_t")).cast("bigint")).alias("a"), F.sum((F.col(score) == F.col("_t")).cast("bigint")).alias("e"), F.count(F.lit(1)).alias("n"))
    return tie_retrieval(g, *query)


def tie_retrieval(counts: DataFrame, *query: str) -> DataFrame:
    """``expected_tie_retrieval`` from (query, a, e, n): candidates above the target, those level with it, itself
    included, and all."""
    a, e, n = F.col("a"), F.nullif(F.col("e"), F.lit(0)), F.col("n")  # a target without a score is level with none
    return counts.select(*query, "n", ((harmonic(a + e) - harmonic(a)) / e).alias("mrr"), F.when(a == 0, 1.0 / e).otherwise(0.0).alias("hit1"), (harmonic(n) / n).alias("random_mrr"))


def confusion(df: DataFrame, truth: str, pred: str, labels: DataFrame) -> DataFrame:
    """(truth, pred, n) over the whole label set (one column), zero counts included."""
    c = labels.columns[0]
    grid = labels.select(F.col(c).alias("truth")).join(F.broadcast(labels.select(F.col(c).alias("pred"))))
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def classification(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: accuracy, macro_f1 (0 where undefined), balanced_accuracy (over classes that occur)."""
    per = df.select(F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"), (F.col(truth) == F.col(pred)).cast("int").alias("ok"))
    per = per.groupBy("x.c").agg(F.sum("x.t").alias("t"), F.sum("x.p").alias("p"), F.sum(F.col("ok") * F.col("x.t")).alias("tp"))
    f1 = F.coalesce(try_ratio(2.0 * F.col("tp"), (F.col("t") + F.col("p")).cast("double")), F.lit(0.0))
    return per.agg((F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(f1).alias("macro_f1"), F.avg(try_ratio(F.col("tp").cast("double"), F.col("t").cast("double"))).alias("balanced_accuracy"))


def equal_weight(df: DataFrame, value: str, levels: list[list[str]]) -> DataFrame:
    """Means of means: the value is averaged over the first keys, that over the next, and so on (never pooled).

    Nulls are left out of means; n_units and n_valid of the last level say how many there were."""
    out, v = df, F.col(value)
    for keys in levels:
        out = out.groupBy(*keys).agg(F.avg(v).alias("_v"), F.count(F.lit(1)).alias("n_units"), F.count(v).alias("n_valid"))
        v = F.col("_v")
    return out.withColumnRenamed("_v", value)
