"""Nearest registered vectors against the join of all pairs, on odd vectors and several blocks."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcat.functions.scalars import cosine
from loomcat.operators import canon, nearest

VECTORS = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1e200, 1e200], [1e-200, 0.0], [3.0], [-2.0]]


def all_pairs(labels, registry, k):
    have = registry.select(F.col("parent").alias("_parent"), "topic_ko", F.col("vector").alias("_vector"))
    near = labels.join(have, F.col("parent").eqNullSafe(F.col("_parent"))).select("parent", "raw", "topic_ko", cosine(F.col("vector"), F.col("_vector")).alias("cosine")).where("cosine is not null")
    return near.withColumn("rank", F.row_number().over(W.partitionBy("parent", "raw").orderBy(F.desc("cosine"), "topic_ko"))).where(F.col("rank") <= k)


def values(rows):
    return sorted(repr(tuple(r)) for r in rows.select("parent", "raw", "topic_ko", "cosine", "rank").collect())


@pytest.mark.parametrize("size,block", [(2, 7), (12, 7), (2, 4096)])
def test_nearest_topics_is_the_join_of_all_pairs(spark, monkeypatch, size, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    vector = lambda i, s: [float((i * (7 + 3 * j) + s) % 5 - 2) for j in range(size)]
    parents = [None, "p", "p", "q"]
    labels = [(parents[i % 4], f"r{i % 50}", v) for i, v in enumerate([*VECTORS, *(vector(i, 1) for i in range(60))])]
    registry = [(parents[i % 3], None if i == 20 else f"t{i % 40:02d}", v) for i, v in enumerate([*VECTORS, *(vector(i, 2) for i in range(60))])]
    labels = spark.createDataFrame(labels, "parent string, raw string, vector array<double>")
    registry = spark.createDataFrame(registry, "parent string, topic_ko string, vector array<double>")
    assert values(canon.nearest_topics(labels, registry, 4)) == values(all_pairs(labels, registry, 4))


def test_nearest_topics_of_nothing(spark):
    none = lambda name: spark.createDataFrame([], f"parent string, {name} string, vector array<float>")
    assert canon.nearest_topics(none("raw"), none("topic_ko")).collect() == []


def test_pairs_under_a_parent_are_no_rows(spark):
    """3000 labels and 3000 registered ones of one parent make one row of a pair of blocks, not nine million."""
    rows = lambda name: spark.range(3000).select(F.lit(1).alias("parent"), F.col("id").cast("string").alias(name), F.array(F.col("id").cast("double"), F.lit(1000.0)).alias("vector"))
    found = canon.nearest_topics(rows("raw"), rows("topic_ko"), 1)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    assert found.where("raw = topic_ko").count() >= 2990
