"""Reading and writing: text tables, array bundles, exclusive sinks, cached lookups, selections."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import hash_order


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """CSV with a header and a declared schema; gzip by the file's name."""
    return spark.read.csv(path, schema=schema, header=True, sep=sep)


def read_text_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """TSV or TSV.gz with all columns as strings; an empty cell is an empty string, not null."""
    return spark.read.csv(path, header=True, sep=sep, inferSchema=False, nullValue="\u0000", emptyValue="").na.fill("")


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Exclusive TSV sink: refuses to overwrite."""
    df.write.mode("errorifexists").csv(path, header=True, sep=sep, emptyValue="")


def write_sorted_gzip(df: DataFrame, path: str, *keys: str) -> None:
    """One sorted, gzipped TSV part: equal tables give equal lines. For small published tables only."""
    df.orderBy(*keys).coalesce(1).write.mode("errorifexists").csv(path, header=True, sep="\t", compression="gzip", emptyValue="")


def write_bundle(df: DataFrame, path: str, meta: dict) -> None:
    """Array bundle: ids and vectors as Parquet, metadata as JSON in one row beside them. Refuses to overwrite."""
    df.write.mode("errorifexists").parquet(f"{path}/values")
    df.sparkSession.range(1).select(F.lit(json.dumps(meta, sort_keys=True)).alias("meta")).write.mode("errorifexists").parquet(f"{path}/meta")


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/values"), json.loads(spark.read.parquet(f"{path}/meta").first().meta)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def decode_categories(codes: DataFrame, categories: DataFrame, code: str, name: str) -> DataFrame:
    """Categorical column stored as codes (-1 for missing) and a category table."""
    return codes.join(categories, code, "left").drop(code).withColumnRenamed("category", name)


def sample_by_hash(df: DataFrame, seed: int, key: str, share: float) -> DataFrame:
    """Deterministic sample of about ``share`` of the rows, whatever the partitioning."""
    return df.where(F.conv(F.substring(hash_order(seed, F.col(key)), 1, 8), 16, 10).cast("bigint") < int(share * 2**32))


def cached_lookup(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """(key, value, state): hit, failed (a cached failure), or miss, from a cache (key, value, failed). Fetches nothing."""
    j = keys.join(cache, key, "left")
    return j.select(key, F.when(~F.col("failed"), F.col("value")).alias("value"), F.when(F.col("failed").isNull(), "miss").when(F.col("failed"), "failed").otherwise("hit").alias("state"))


def expand_tokens(text: Column, variables: dict[str, Column]) -> Column:
    """Replaces ${NAME} of the given names; other tokens stay, a null value gives null."""
    for name, value in variables.items():
        text = F.replace(text, F.lit("${" + name + "}"), value)
    return text


def path_readiness(paths: DataFrame) -> DataFrame:
    """(key, ready) of a configuration's paths (key, path): a bounded list, looked up by Spark's own file systems."""
    spark = paths.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def exists(path: str) -> bool:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    return spark.createDataFrame([(r.key, exists(r.path)) for r in paths.collect()], "key string, ready boolean")


def _lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))


def _manifest(lines: DataFrame, name: str) -> DataFrame:
    h = F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return lines.agg(F.lit(name).alias("name"), F.count("*").alias("n_lines"), F.sum(h).cast("string").alias("digest"))


def write_package(tables: dict[str, DataFrame], path: str) -> None:
    """Result tables as text lines in one folder, with a manifest (name, n_lines, digest). Refuses to overwrite."""
    manifest = None
    for name, df in sorted(tables.items()):
        _lines(df).write.mode("errorifexists").text(f"{path}/{name}")
        own = _manifest(_lines(df), name)
        manifest = own if manifest is None else manifest.union(own)
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/MANIFEST")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, n_lines, digest, intact): a package's manifest, and whether each table still has those lines."""
    m = spark.read.schema("name string, n_lines bigint, digest string").json(f"{path}/MANIFEST")
    found = None
    for r in m.select("name").collect():  # the package's few tables
        own = _manifest(spark.read.text(f"{path}/{r.name}"), r.name).toDF("name", "n", "d")
        found = own if found is None else found.union(own)
    same = F.coalesce((F.col("n") == F.col("n_lines")) & (F.col("d") == F.col("digest")), F.lit(False))
    return m.join(found, "name", "left").select("name", "n_lines", "digest", same.alias("intact"))
