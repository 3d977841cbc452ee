"""Registration of queries, and the analogue tables that most of them start from (in Spark and in SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.geometry import largest_group
from tessera.operators.pairblocks import view_pairs
from tessera.operators.pairranks import rank_correlations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """``t.orders`` is the table's DataFrame; ``t.dir`` its folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

        self._largest: dict[tuple[str, str], int] = {}

    def largest(self, table: str, group: str) -> int:
        """Rows of the largest group of a table, counted once."""
        if (table, group) not in self._largest:
            self._largest[table, group] = largest_group(getattr(self, table), group)
        return self._largest[table, group]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables under an operator's id, with its SQL if there is any."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Six decimals; never a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def cells(t: Tables) -> DataFrame:
    """Measured cells: (entity, context, feature, value, is_control, rep) from line items."""
    li = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    li = li.join(t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return li.select(F.col("p_brand").alias("entity"), F.col("r_name").alias("context"), F.month("l_shipdate").cast("bigint").alias("feature"), F.col("l_extendedprice").alias("value"), (F.col("l_returnflag") == "N").alias("is_control"), (F.col("l_linenumber") % 2).cast("bigint").alias("rep"), F.col("l_orderkey").alias("cell"))


CELLS = """cells as (select p_brand as entity, r_name as context, month(l_shipdate)::bigint as feature, l_extendedprice as value,
  l_returnflag = 'N' as is_control, (l_linenumber % 2)::bigint as rep, l_orderkey as cell from lineitem join part on l_partkey = p_partkey
  join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def effects(t: Tables) -> DataFrame:
    """(entity, context, feature, mean_t, mean_c, n_t, n_c, effect): log2 ratio of arm means, where both arms have rows."""
    g = cells(t).groupBy("entity", "context", "feature").agg(
        F.avg(F.when(~F.col("is_control"), F.col("value"))).alias("mean_t"), F.avg(F.when(F.col("is_control"), F.col("value"))).alias("mean_c"),
        F.sum((~F.col("is_control")).cast("bigint")).alias("n_t"), F.sum(F.col("is_control").cast("bigint")).alias("n_c"),
    )
    return g.where("mean_t is not null and mean_c is not null").withColumn("effect", F.log2((F.col("mean_t") + 1) / (F.col("mean_c") + 1)))


EFFECTS = (
    CELLS
    + """, effects as (select *, log2((mean_t + 1) / (mean_c + 1)) as effect from (select entity, context, feature,
  avg(value) filter (not is_control) as mean_t, avg(value) filter (is_control) as mean_c, count(*) filter (not is_control) as n_t,
  count(*) filter (is_control) as n_c from cells group by all) where mean_t is not null and mean_c is not null)"""
)


def two_views(t: Tables) -> DataFrame:
    """(vec_id, label, text, resp): dimensions 1-48 and 17-64 of each embedding, which overlap."""
    v = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", F.col("label").cast("bigint").alias("label"), F.slice(v, 1, 48).alias("text"), F.slice(v, 17, 48).alias("resp"))


TWO_VIEWS = "two_views as (select vec_id, label::bigint as label, (embedding::double[])[1:48] as text, (embedding::double[])[17:64] as resp from embeddings)"


#: The views as stretches of an embedding.
VIEWS = {"x": (0, 48), "y": (16, 64)}


def labelled(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.col("label").cast("bigint").alias("label"), "embedding")


def rep_pairs(t: Tables, *views: str) -> DataFrame:
    """(label, i, j, x, y): cosines of both views (or of those named) for each unordered pair within a label, in one pass
    over the pairs."""
    return view_pairs(labelled(t), "label", "vec_id", "embedding", {v: VIEWS[v] for v in views or VIEWS}, t.largest("embeddings", "label"))


def rounded_pairs(t: Tables, **outputs: tuple[Callable, int]) -> DataFrame:
    """(label, i, j, outputs): functions of the views' cosines x and y, rounded to so many digits where they are computed."""
    return view_pairs(labelled(t), "label", "vec_id", "embedding", VIEWS, t.largest("embeddings", "label"), outputs)


def view_correlations(t: Tables, against: Callable, **measures: Callable) -> DataFrame:
    """(label, measure, n, rho, status): rank correlations over all pairs of a label; functions of the views' cosines x and y."""
    return rank_correlations(labelled(t), "label", "vec_id", "embedding", VIEWS, against, measures, t.largest("embeddings", "label"))


PAIRS = (
    TWO_VIEWS
    + """, rep_pairs as (select a.label, a.vec_id as i, b.vec_id as j, list_cosine_similarity(a.text, b.text) as x,
  list_cosine_similarity(a.resp, b.resp) as y from two_views a join two_views b on a.label = b.label and a.vec_id < b.vec_id)"""
)


def metric_table(t: Tables) -> DataFrame:
    """(dataset, model, metric, value): four simple representations by nation and two measures, in cents so that values tie."""
    c = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("dataset", F.col("c_nationkey").cast("bigint"))
    g = c.groupBy("dataset", F.col("o_orderpriority").alias("model")).agg(F.floor(F.avg("o_totalprice") / 20000).cast("double").alias("rsa"), F.round(F.avg("c_acctbal") / 1000, 1).alias("ndcg"))
    return g.select("dataset", "model", F.expr("stack(2, 'rsa', rsa, 'ndcg', ndcg) as (metric, value)"))


METRICS = """metric_table as (select dataset, model, unnest(['rsa', 'ndcg']) as metric, unnest([rsa, ndcg]) as value from (select c_nationkey::bigint as dataset,
  o_orderpriority as model, floor(avg(o_totalprice) / 20000)::double as rsa, round(avg(c_acctbal) / 1000, 1)::double as ndcg
  from orders join customer on o_custkey = c_custkey group by all))"""
