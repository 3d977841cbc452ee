"""A corpus in five stages: quality, toxicity, near-duplicates, mixture, tokens.

Each stage is written as Parquet into the cluster's shared folder and read again by the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, gam, mixing, simhash, toxicity
from tessera.llm.common import last_table, materialize, remove_tables, scratch
from tessera.llm.queries import table, tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score 0.5 or more), with all their columns.

    Null and empty texts score as texts without words; repeated rows stay or go together; rows with a null id are judged
    like any other; an empty table gives none."""
    return gam.keep_good(docs, table(spark, sf_dir, "labels"))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain doesn't reject (probability under 0.5), with all their columns.

    Null and empty texts have no features and stay unless most labelled documents are toxic; repeated rows stay or go
    together; an empty table gives none."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: runs of five words, similarity 0.8 or more.

    The least id stays, of rows alike in id and text one. Texts without words are alike, null ones too; rows with a null
    id pass through; an empty table gives none."""
    return simhash.keep_representatives(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, up to three times.

    A null source is a source of its own, the last; texts without words aren't taken; repeated rows have places of their
    own; reruns agree, whatever the order of the rows; an empty table gives none."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row per row of the mixture.

    Null and empty texts have no tokens; repeated rows each come back; an empty table gives none."""
    return bpe.digest_table(docs, tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", civil),
    ("near_duplicates", distinct),
    ("mixing", mixture),
    ("bpe", tokens),
]

#: SQL can express neither the trained stages nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. A stage's table and all it wrote on the way go when the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        remove_tables(spark, before)
        before = [last_table(spark)]
    return STAGES[-1][1](spark, docs, sf_dir)
