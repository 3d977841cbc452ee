"""Collects the queries of all sections and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import metrics as met

from . import base, integrity, relational, resampling, scalars, scans, scores, vectors

SECTIONS = (scans, relational, scalars, vectors, scores, resampling, integrity)

FLAGSHIP_SQL = f"""with {scores.NDCG}, rsa as (select label, corr(rx, ry) as rho, count(*) as n_pairs from (select label, rank() over (partition by label order by x) + (count(*) over (partition by label, x) - 1) / 2.0::double as rx,
  rank() over (partition by label order by y) + (count(*) over (partition by label, y) - 1) / 2.0::double as ry from rep_pairs) group by 1), e as (select label, avg(ndcg - rnd) as excess from nd group by 1)
  select label, n_pairs::bigint as n_pairs, round(rho, 6) + 0.0 as rsa, round(excess, 6) + 0.0 as excess_ndcg from rsa join e using (label)"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two views of the embeddings per label: rank correlation of pair similarities, and how far the
    nearest neighbours in one view find those in the other (NDCG@10 over chance). Neither measure makes a table of pairs."""
    t = base.Tables(spark, sf_dir)
    rsa = base.view_correlations(t, lambda x, y: y, rho=lambda x, y: x).select("label", F.col("n").alias("n_pairs"), F.col("rho").alias("rsa"))
    excess = met.expected_ndcg(scores.counted(t), "truth", "score", 10, "label", "q", times="n").groupBy("label").agg(F.avg("excess").alias("excess_ndcg"))
    return rsa.join(excess, "label").select("label", "n_pairs", base.r6("rsa").alias("rsa"), base.r6("excess_ndcg").alias("excess_ndcg"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"flagship_agreement": flagship, **base.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"flagship_agreement": FLAGSHIP_SQL, **base.ORACLE}
