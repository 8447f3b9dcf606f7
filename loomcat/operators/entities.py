"""Entity screens over member rows (entity_type, entity_uid, asset, modality, status)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import search

KEY = ["entity_type", "entity_uid"]
ORDER = [("tier", False), ("members", False), ("entity_uid", True), ("entity_type", True)]


def shown(members: DataFrame, least: int, statuses: Sequence[str] = ("active", "proposed")) -> DataFrame:
    """Entities with at least so many distinct members."""
    return members.where(F.col("status").isin(*statuses)).groupBy(*KEY).agg(F.count_distinct("asset").alias("members")).where(F.col("members") >= least)


def tiered(entities: DataFrame, first: DataFrame | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """tier: 2 for entities found by name, 1 by meaning, else 0."""
    out, tier = entities, F.lit(0)
    for rank, found in ((1, semantic), (2, first)):
        if found is not None:
            out = out.join(found.select(*KEY, F.lit(True).alias(f"_t{rank}")).distinct(), KEY, "left")
            tier = F.when(F.col(f"_t{rank}"), rank).otherwise(tier)
    return out.withColumn("tier", tier).drop("_t1", "_t2")


def entity_page(entities: DataFrame, limit: int, bookmark: Sequence | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """A page by tier, members, uid and type; allowed None sets no limit, an empty one leaves no rows."""
    rows = entities if allowed is None else entities.join(allowed, KEY, "left_semi")
    return search.page(rows, ORDER, limit, bookmark)


def label_counts(labels: DataFrame, tagged: DataFrame, entities: DataFrame) -> DataFrame:
    """skill, label, n of labels (skill, label, ord) without the one for unassigned; labels that no entity has count 0."""
    hits = tagged.join(entities.select(*KEY), KEY, "left_semi").groupBy("skill", "label").agg(F.count("*").alias("n"))
    return labels.where(F.col("label") != "unassigned").join(hits, ["skill", "label"], "left").na.fill(0, ["n"])


def entity_facets(members: DataFrame, labels: DataFrame, tagged: DataFrame, codes: Sequence[str], *, least: int, kind: str | None = None, areas: Sequence[str] = (), picked: Sequence[str] = (), statuses: Sequence[str] = ("active", "proposed")) -> DataFrame:
    """axis, name, n: types without the type chosen, labels and modalities as each would count if it were chosen too."""
    base = shown(members, least, statuses).select(*KEY)
    scoped = base
    if areas:
        wanted = sorted(set(areas))
        every = tagged.where(F.col("label").isin(wanted)).groupBy(*KEY).agg(F.count_distinct("label").alias("n")).where(F.col("n") == len(wanted))
        scoped = base.join(every, KEY, "left_semi")
    live = members.where(F.col("status").isin(*statuses) & F.col("modality").isin(*codes))
    have = live.join(scoped, KEY, "left_semi").groupBy(*KEY).agg(F.collect_set("modality").alias("mods"))
    holds = lambda extra: F.size(F.array_intersect("mods", F.array(*map(F.lit, extra)))) == len(set(extra))
    chosen = have.where(holds(picked)).select(*KEY) if picked else scoped
    own = chosen if kind is None else chosen.where(F.col("entity_type") == kind)
    by_type = chosen.groupBy("entity_type").agg(F.count("*").alias("n")).select(F.lit("type").alias("axis"), F.col("entity_type").alias("name"), "n")
    by_area = label_counts(labels, tagged, own).select(F.lit("area").alias("axis"), F.col("label").alias("name"), "n")
    counted = (have if kind is None else have.where(F.col("entity_type") == kind)).agg(*[F.count_if(holds({*picked, c})).alias(c) for c in codes])
    by_mod = counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in codes])).alias("x")).select(F.lit("modality").alias("axis"), "x.name", "x.n")
    return by_type.unionByName(by_area).unionByName(by_mod)


def bundle(members: DataFrame, kind: str, uid: str, most: int, statuses: Sequence[str] = ("active", "proposed")) -> DataFrame:
    """modality, rank, asset of the first members of each modality of one entity, with the modality's number."""
    own = members.where((F.col("entity_type") == kind) & (F.col("entity_uid") == uid) & F.col("status").isin(*statuses)).select("modality", "asset").distinct()
    part = W.partitionBy("modality")
    return own.withColumns({"rank": F.row_number().over(part.orderBy("asset")), "n": F.count("*").over(part)}).where(F.col("rank") <= most)


def member_assets(members: DataFrame, entities: DataFrame, *, without: str | None = None, statuses: Sequence[str] = ("active", "proposed")) -> DataFrame:
    """The distinct assets of the entities."""
    rows = members.where(F.col("status").isin(*statuses)).join(entities, KEY, "left_semi")
    return (rows if without is None else rows.where(F.col("modality") != without)).select("asset").distinct()


def label_state(rows: DataFrame) -> DataFrame:
    """Per entity and skill: the stamps found, whether a hash is missing, and whether stamps are mixed."""
    kinds = lambda c: F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("")))
    found = rows.groupBy(*KEY, "skill").agg(
        kinds("material_hash").alias("_h"), kinds("skill_version").alias("_s"), kinds("prompt_version").alias("_p"),
        F.bool_or(F.col("material_hash").isNull()).alias("no_hash"), F.max("material_hash").alias("material_hash"), F.max("skill_version").alias("skill_version"), F.max("prompt_version").alias("prompt_version"),
    )
    return found.withColumn("mixed", F.greatest("_h", "_s", "_p") > 1).drop("_h", "_s", "_p")


def description_reason(stored: Column, prompt: Column, members: Column, version: str, ratio: float = 0.2) -> Column:
    """Why a description is due: missing, member_count or prompt_version; null if it isn't."""
    moved = stored.isNull() | F.when(stored <= 0, True).otherwise(F.abs(members - stored) / stored >= ratio)
    return F.when(prompt.isNull(), "missing").when(moved, "member_count").when(prompt != version, "prompt_version")
