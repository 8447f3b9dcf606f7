"""Set operations on identifiers, names and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def isolated(registered: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """Registered keys that no linked row has."""
    return registered.select(key).distinct().join(linked.select(key), key, "left_anti")


def differing(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows on one side only, with that side; none where both hold the same set. Nulls equal nulls."""
    sides = left.select(*columns, F.lit(1).alias("_side")).unionByName(right.select(*columns, F.lit(2).alias("_side")))
    seen = sides.groupBy(*columns).agg(F.min("_side").alias("least"), F.max("_side").alias("most")).where("least = most")
    return seen.select(*columns, F.when(F.col("least") == 1, "left").otherwise("right").alias("side"))


def merged_names(first: Column, second: Column) -> Column:
    """Both lists in order, each value once; a null list is empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(first, empty), F.coalesce(second, empty)))


def best_of_buckets(buckets: list[DataFrame], key: str, score: str) -> DataFrame:
    """key and its best score over all buckets; null scores count only where a key has no other."""
    rows = buckets[0].select(key, score)
    for b in buckets[1:]:
        rows = rows.unionByName(b.select(key, score))
    return rows.groupBy(key).agg(F.max(score).alias(score))
