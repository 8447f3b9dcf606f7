"""What waits for work, what lacks vectors, and candidates by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import basename

#: One suffix of a version or derivative, cut from a stem.
SUFFIX = r"(?i)(?:_v\d+|_\d+부|_summary|_요약|_번역|_전사|_copy|_사본)$"


def pending(assets: DataFrame, labels: DataFrame, skill: str, version: int) -> DataFrame:
    """Assets that no label row of the skill has in this version or a later one."""
    done = labels.where((F.col("skill") == skill) & (F.col("skill_version") >= version))
    return assets.join(done.select("asset_id"), "asset_id", "left_anti")


def unresolved(assets: DataFrame, vectors: DataFrame, state: DataFrame) -> DataFrame:
    """Assets with vectors that wait or were never tried, with their attempts."""
    own = state.select("asset_id", F.col("status").alias("_status"), "attempts", F.lit(True).alias("_known"))
    return assets.join(vectors.select("asset_id"), "asset_id", "left_semi").join(own, "asset_id", "left").where((F.col("_status") == "pending") | F.col("_known").isNull()).drop("_status", "_known")


def unresolved_order() -> list[Column]:
    """Never tried ones first, then fewest attempts, oldest, smallest id."""
    return [F.asc_nulls_first("attempts"), F.asc_nulls_last("created_at"), F.asc("asset_id")]


def hollow(assets: DataFrame, vectors: DataFrame) -> DataFrame:
    """modality, n, hollow: assets without vectors; those of unknown modality are exempt."""
    counted = vectors.groupBy("asset_id").agg(F.count("*").alias("_n"))
    rows = assets.where(F.col("modality") != "unknown").join(counted, "asset_id", "left")
    return rows.groupBy("modality").agg(F.count("*").alias("n"), F.count_if(F.coalesce("_n", F.lit(0)) == 0).alias("hollow"))


def raw_stem(path: Column) -> Column:
    """The lower-case base name without its last extension; leading dots don't start one."""
    return F.lower(F.regexp_replace(basename(path), r"^(\.*[^.].*)\.[^.]*$", "$1"))


def folder(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"(?<=[^/])/+$", "")


def by_place(sources: DataFrame, assets: DataFrame, limit: int) -> DataFrame:
    """source, asset_id, proximity, rank: assets of the source's folder with its stem (2) or its stem without suffix (1).

    Equal stems have equal stems without suffix, so one equi-join on folder and short stem finds both.
    """
    stems = lambda df, key: df.select(F.col("asset_id").alias(key), folder(F.col("path")).alias("_dir"), raw_stem(F.col("path")).alias(f"_raw_{key}"), F.regexp_replace(raw_stem(F.col("path")), SUFFIX, "").alias("_norm"))
    pairs = stems(assets, "asset_id").join(stems(sources, "source"), ["_dir", "_norm"]).where(F.col("asset_id") != F.col("source"))
    same = (F.col("_raw_source") != "") & (F.col("_raw_source") == F.col("_raw_asset_id"))
    found = pairs.select("source", "asset_id", F.when(same, 2).when(F.col("_norm") != "", 1).alias("proximity")).where(F.col("proximity").isNotNull())
    return found.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(F.desc("proximity"), "asset_id"))).where(F.col("rank") <= limit)
