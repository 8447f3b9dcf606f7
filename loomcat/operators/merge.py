"""Keyed merges and the choice of what is stale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_edges(old: DataFrame, new: DataFrame, kinds: DataFrame, allowed: DataFrame, *, least_similarity: float = 0.0, similarity: Sequence[str] = ("duplicate_near", "same_domain")) -> DataFrame:
    """Edges after proposals: known kinds and allowed targets only, no loops, symmetric pairs in order.

    On a known edge the higher confidence stays, topic and reason come from the strictly
    more confident side, and the status never changes.
    """
    fresh = new.join(F.broadcast(kinds.where("active").select("kind", "is_symmetric")), "kind").join(allowed, new["dst"] == allowed["node"], "left_semi").where(F.col("src") != F.col("dst"))
    fresh = fresh.where(~F.col("kind").isin(*similarity) | (F.coalesce("confidence", F.lit(0.0)) >= least_similarity))
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    fresh = fresh.select(F.when(F.col("is_symmetric"), a).otherwise(F.col("src")).alias("src"), F.when(F.col("is_symmetric"), b).otherwise(F.col("dst")).alias("dst"), "kind", "confidence", "reason", F.lit("proposed").alias("status"), F.lit(1).alias("age"))
    both = old.select("src", "dst", "kind", "confidence", "reason", "status", F.lit(0).alias("age")).unionByName(fresh)
    order = F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("age")).alias("a"), F.col("reason").alias("r"))
    return both.groupBy("src", "dst", "kind").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.max_by("reason", order).alias("reason"), F.min_by("status", "age").alias("status"))


def replace_for(old: DataFrame, new: DataFrame, owner: Sequence[str], owners: DataFrame) -> DataFrame:
    """Full replacement of all rows of the given owners."""
    return old.join(owners.select(*owner).distinct(), list(owner), "left_anti").unionByName(new)


def stale(now: DataFrame, state: DataFrame, key: Sequence[str], *, material: str, version: str) -> DataFrame:
    """Rows that need work with the first reason that holds: new, no_hash, changed, version."""
    known = state.select(*key, F.col(material).alias("_m"), F.col(version).alias("_v"), F.lit(True).alias("_known"))
    reason: Column = (
        F.when(F.col("_known").isNull(), "new").when(F.col("_m").isNull(), "no_hash").when(F.col("_m") != F.col(material), "changed").when(~F.col("_v").eqNullSafe(F.col(version)), "version")
    )
    return now.join(known, list(key), "left").withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_m", "_v", "_known")


def resolved(state: DataFrame, most: int = 3) -> DataFrame:
    """Next status and attempts from (attempts, error, edges)."""
    tries = F.coalesce("attempts", F.lit(0)) + F.when(F.col("error"), 1).otherwise(0)
    status = F.when(F.col("error"), F.when(tries >= most, "failed").otherwise("pending")).otherwise(F.when(F.col("edges") >= 1, "resolved").otherwise("isolated"))
    return state.withColumns({"attempts": tries, "status": status})
