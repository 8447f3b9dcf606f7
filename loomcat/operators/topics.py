"""Topic counts, same-topic groups and what has no topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def topic_counts(rows: DataFrame) -> DataFrame:
    """topic, subtopic (blank as null), n, and the topic's total."""
    sub = F.when(F.col("subtopic") != "", F.col("subtopic"))
    counts = rows.groupBy("topic", sub.alias("subtopic")).agg(F.count("*").alias("n"))
    return counts.withColumn("topic_total", F.sum("n").over(W.partitionBy("topic")))


def same_topic(rows: DataFrame, topic: str, n: int) -> DataFrame:
    """The first n assets of each subtopic of a topic by id, with the subtopic's and the topic's number."""
    own = rows.where(F.col("topic") == topic)
    total = own.agg(F.count("*").alias("total"))
    sizes = own.groupBy("subtopic").agg(F.count("*").alias("size"))
    rank = F.row_number().over(W.partitionBy("subtopic").orderBy("asset_id"))
    first = own.select("subtopic", "asset_id").withColumn("rank", rank).where(F.col("rank") <= n)
    return first.join(F.broadcast(sizes.withColumnRenamed("subtopic", "_s")), F.col("subtopic").eqNullSafe(F.col("_s"))).drop("_s").join(F.broadcast(total))


def unclassified(assets: DataFrame, topics: DataFrame) -> DataFrame:
    """Assets without a topic."""
    return assets.join(topics.select("asset_id"), "asset_id", "left_anti")
