"""The queries that the repository's entry point registers: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import align, bpe, codes, digests, dom, forest, gam, hostrules, licenses, mixing, simhash, toxicity, urlgraph

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> bpe.WordTokenizer:
    return bpe.WordTokenizer.from_file(os.environ.get("WORD_BPE_FILE") or public_tokenizers.path("word_bpe_49k.json"))


def token_files() -> tuple[align.ByteTokens, align.PieceTokens]:
    """The two tokenizers that are aligned."""
    byte, piece = os.environ.get("BYTE_BPE_FILE"), os.environ.get("PIECE_BPE_FILE")
    return align.ByteTokens(byte or public_tokenizers.path("byte_bpe_50k.json")), align.PieceTokens(piece or public_tokenizers.path("piece_bpe_32k.model"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.host_rules(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_table(table(spark, sf_dir, "documents"), tokenizer())


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.extract_table(table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.url_filter(table(spark, sf_dir, "pages"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.near_edited(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), *token_files())


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_host_rules": op2_host_rules,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_bpe": op4_bpe,
    "op5_html_extraction": op5_html_extraction,
    "op6_url_filter": op6_url_filter,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_alignment": op13_token_alignment,
}

#: Only what SQL can express over whole tables; the others are tested against brute force or held-out rows.
ORACLE_SQL: dict[str, str] = {"op2_host_rules": hostrules.ORACLE_SQL, "op7_embedding_near_dedup": forest.ORACLE_SQL, "op10_mixing": mixing.ORACLE_SQL, "op12_vector_codes": codes.ORACLE_SQL}
