"""Index documents of assets and entities, work targets, assets of a topic, and rates of verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, scalars, texts


def asset_documents(assets: DataFrame, labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """A wide row of each asset (asset_id, path, summary, keywords, topics); labels (asset_id, labels) and vectors (asset_id, vector), one row an asset.

    A vector of zeros is none, and so is an empty list of keyword keys.
    """
    rows = assets.join(labels.select("asset_id", "labels"), "asset_id", "left").join(vectors.select("asset_id", "vector"), "asset_id", "left")
    keys = scalars.distinct_in_order(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.lower(F.regexp_replace(k, r"\s+", ""))))
    real = F.exists("vector", lambda x: x != 0)
    return rows.select(
        "asset_id", names.cleaned_name(scalars.display_name(F.col("path"))).alias("file_name"), scalars.file_ext(F.col("path")).alias("file_ext"), "summary", "keywords",
        F.when(F.size(keys) > 0, keys).alias("keywords_norm"), scalars.distinct_in_order(F.transform("topics", lambda t: t["topic"])).alias("topics"),
        scalars.distinct_in_order(F.transform("topics", lambda t: t["subtopic"])).alias("subtopics"), texts.topic_pairs(F.col("topics")).alias("topic_pairs"),
        texts.label_keys(F.coalesce("labels", F.array().cast("array<struct<skill:string,label:string>>"))).alias("label_keys"), F.when(real, F.col("vector")).alias("embedding"),
    )


def entity_documents(entities: DataFrame, members: DataFrame, vectors: DataFrame) -> DataFrame:
    """A row of each entity (entity_type, entity_uid, name, keywords, description) with its id, the texts of its members (summary, keywords) and vector."""
    key = ["entity_type", "entity_uid"]
    said = F.concat_ws(" ", F.array_join(F.array_sort(F.collect_set("summary")), " "), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))), " "))
    own = members.groupBy(*key).agg(said.alias("member"))
    rows = entities.join(own, key, "left").join(vectors.select(*key, "vector"), key, "left")
    return rows.withColumns({"doc_id": F.concat_ws("/", *key), "member": F.coalesce("member", F.lit("")), "embedding": F.when(F.exists("vector", lambda x: x != 0), F.col("vector"))}).drop("vector")


def embedding_targets(members: DataFrame, entity: Sequence[str], *, least: int) -> DataFrame:
    """Entities with at least so many distinct assets, with the keywords of their stamps."""
    keyword = texts.reason_keyword(F.col("reason"))
    return members.groupBy(*entity).agg(F.count_distinct("asset").alias("members"), F.array_sort(F.collect_set(keyword)).alias("keywords")).where(F.col("members") >= least)


def topic_assets(rows: DataFrame, topic: str, *, subtopic: str | None = None, unassigned: bool = False, modality: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of a topic's assets by id with their total, and the counts by modality before that filter."""
    own = rows.where(F.col("topic") == topic)
    if unassigned:
        own = own.where(F.coalesce("subtopic", F.lit("")) == "")
    elif subtopic is not None:
        own = own.where(F.col("subtopic") == subtopic)
    own = own.select("asset_id", "modality").distinct()
    counts = own.groupBy("modality").agg(F.count("*").alias("n"))
    page = own if modality is None else own.where(F.col("modality") == modality)
    total = page.agg(F.count("*").alias("total"))  # one row
    return page.orderBy("asset_id").offset(offset).limit(limit).join(F.broadcast(total)), counts


def verdict_rates(verdicts: DataFrame) -> DataFrame:
    """verdict, n and share of all that isn't blank."""
    counts = verdicts.where(F.trim("verdict") != "").groupBy("verdict").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("verdict", "n", (F.col("n") / F.col("total")).alias("share"))
