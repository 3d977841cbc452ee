"""Text views: rendering, parsing by sections, entities, and TF-IDF. JVM functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import section, squeeze

#: Section headings of a prompt, in their order.
SECTIONS = (("P1", "Identity:"), ("P2", "Biology:"), ("P3", "Technology:"))
#: Word beginnings that tell a perturbation family.
FAMILIES = (("genetic", "crispr|knockout|knockdown|sirna|overexpress"), ("cytokine", "cytokine|interleukin|interferon|ligand"), ("chemical", "drug|compound|inhibitor|chem|small molecule"))


def family(c: Column) -> Column:
    """Keyword classifier; the first family that matches, else ``other``."""
    out = F.lit("other")
    for name, pattern in reversed(FAMILIES):
        out = F.when(F.lower(c).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def canonical_entities(c: Column) -> Column:
    """Sorted distinct parts of a delimited list, joined by ``+``."""
    parts = F.filter(F.transform(F.split(c, r"[|;,+]"), lambda p: F.trim(p)), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(parts)), "+")


def split_ids(c: Column) -> Column:
    """Ids from a JSON array, or a list delimited by the first of | ; , + that occurs."""
    x = F.trim(c)
    one = F.when(x.contains("|"), F.split(x, r"\|")).when(x.contains(";"), F.split(x, ";")).when(x.contains(","), F.split(x, ",")).otherwise(F.split(x, r"\+"))
    ids = F.when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(one)
    return F.filter(F.transform(ids, lambda p: F.trim(p)), lambda i: i != "")


def views(text: Column) -> Column:
    """Struct of views P1 (identity), P2 (with biology), P3 (with technology), P4 (all), and a status."""
    at = [F.instr(text, head) for _, head in SECTIONS]
    parts = [section(text, head, SECTIONS[i + 1][1] if i + 1 < len(SECTIONS) else None) for i, (_, head) in enumerate(SECTIONS)]
    ok = (at[0] > 0) & (at[1] > at[0]) & (at[2] > at[1])
    join = lambda *p: F.when(ok, F.concat_ws(" ", *p))
    status = F.when(ok, "ok").when(F.least(*at) == 0, "missing_section").otherwise("wrong_order")
    return F.struct(join(parts[0]).alias("P1"), join(parts[0], parts[1]).alias("P2"), join(parts[0], parts[2]).alias("P3"), join(*parts).alias("P4"), status.alias("status"))


def humanize(c: Column) -> Column:
    """Underscores and doubled spaces gone, version suffixes cut."""
    return squeeze(F.regexp_replace(F.regexp_replace(c, r"\.\d+$", ""), "_+", " "))


def tokens(c: Column) -> Column:
    """Lower-case words of two or more word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def grams(c: Column) -> Column:
    """Tokens and pairs of neighbours."""
    w = tokens(c)
    n = F.greatest(F.size(w) - 1, F.lit(1))
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


#: A list of up to so many terms is sent to all tasks.
SENT_TERMS = 100_000


def tfidf(docs: DataFrame, key: str, text: str, min_df: int = 1, max_features: int | None = None, sublinear: bool = False) -> DataFrame:
    """(key, term, weight): term counts times ln((1 + n) / (1 + df)) + 1, each document L2-normalised."""
    words = docs.select(key, F.explode(grams(F.col(text))).alias("term"))
    if max_features and max_features <= SENT_TERMS and min_df <= 1:
        # the terms are known by their totals, so those of no other are dealt by document
        often = words.groupBy("term").agg(F.count("*").alias("total")).orderBy(F.col("total").desc(), "term").limit(max_features)
        words = words.join(F.broadcast(often.select("term")), "term")
    tf = words.groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    if max_features:
        df = df.orderBy(F.col("total").desc(), "term").limit(max_features)
    n = docs.agg(F.count("*").alias("n"))
    idf = df.join(F.broadcast(n)).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row is broadcast
    raw = (1 + F.ln("tf")) if sublinear else F.col("tf").cast("double")
    w = tf.join(idf, "term").select(key, "term", (raw * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.withColumn("weight", F.col("w") / length).drop("w")
