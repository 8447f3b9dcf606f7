"""A stored word index: a row for each document, field and word, dealt by word, so that a query reads its words only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import tokens

BUCKETS = 64
#: Files that the words of one bucket are dealt over, so that a frequent word isn't one task's.
SPREAD = 4


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def rows(docs: DataFrame, key: str, fields: Mapping[str, Column]) -> DataFrame:
    """key, field, term, f (how often) and n (words of the field) of all documents."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), tokens(text).alias("t")) for name, text in fields.items()]))
    words = docs.select(key, each.alias("x")).select(key, "x.field", F.size("x.t").alias("n"), F.explode("x.t").alias("term"))
    return words.groupBy(key, "field", "term").agg(F.count("*").alias("f"), F.first("n").alias("n"))


def totals(docs: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """field, documents and mean length; documents with an empty field count."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.size(tokens(text)).alias("n")) for name, text in fields.items()]))
    return docs.select(each.alias("x")).groupBy("x.field").agg(F.count("*").alias("docs"), F.avg("x.n").alias("mean"))


def build(docs: DataFrame, key: str, fields: Mapping[str, Column], path: str, *, buckets: int = BUCKETS, spread: int = SPREAD) -> None:
    """Writes the index of docs (unique keys) to a folder: words by bucket, in order within files, and totals."""
    dealt = rows(docs, key, fields).withColumn("bucket", bucket(F.col("term"), buckets))
    dealt = dealt.repartition(buckets * spread, "bucket", F.pmod(F.xxhash64(key), F.lit(spread))).sortWithinPartitions("bucket", "term", "field", key)
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/words")
    totals(docs, fields).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/totals")


def search(spark: SparkSession, path: str, key: str, query: Sequence[str], weights: Mapping[str, float], *, every: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score (BM25 by field, weighted) and matched (fields) of documents with a word of the query, or with every word in some field.

    Only the words' buckets are read (partition filters), and of them only the words (pushed filters).
    """
    terms = list(dict.fromkeys(query))
    sums = spark.read.parquet(f"{path}/totals").where(F.col("field").isin(*weights))
    size = sums.agg(F.max("buckets")).first()[0] or BUCKETS
    own = [r[0] for r in spark.range(1).select(F.explode(F.array(*[bucket(F.lit(t), size) for t in terms]))).collect()] if terms else []
    found = spark.read.parquet(f"{path}/words").where(F.col("bucket").isin(*own) & F.col("term").isin(*terms) & F.col("field").isin(*weights))
    counts = found.groupBy("field", "term").agg(F.count("*").alias("d"))  # words of the query times fields
    known = found.join(F.broadcast(counts), ["field", "term"]).join(F.broadcast(sums), "field")
    idf = F.log(1 + (F.col("docs") - F.col("d") + 0.5) / (F.col("d") + 0.5))
    part = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    weight = reduce(lambda w, x: w.when(F.col("field") == x[0], x[1]), list(weights.items())[1:], F.when(F.col("field") == next(iter(weights)), next(iter(weights.values()))))
    hits = known.groupBy(key).agg(F.sum(weight * part).alias("score"), F.array_sort(F.collect_set("field")).alias("matched"), F.count_distinct("term").alias("have"))
    return hits.where(F.col("have") == len(terms) if every else F.lit(True)).select(key, "score", "matched")
