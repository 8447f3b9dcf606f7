"""Registries and their rules: nodes made when missing, versions, replaced labels, reviewed edges, kinds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import kind_code
from ..functions.scalars import let

UNASSIGNED = "unassigned"
RESERVED = ("mm_member",)


def ensured(old: DataFrame, wanted: DataFrame, key: Sequence[str], identity: str) -> DataFrame:
    """Rows of the wanted keys (null equals null) with the identity they have, or a new one by their values; old rows stay."""
    new = wanted.select(*key).distinct().join(old.select(*[F.col(c).alias(f"_{c}") for c in key]), _same(key), "left_anti")
    made = new.withColumn(identity, F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256))
    return old.select(*key, identity).unionByName(made.select(*key, identity))


def _same(key: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in key:
        out = out & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out


def versioned(old: DataFrame, new: DataFrame, key: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Definitions after an upsert, with what was done: registered in version 1, updated to the next version where the content changed, or unchanged."""
    digest = lambda: F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    before = old.select(*key, F.col("version").alias("_v"), digest().alias("_d"))
    both = new.select(*key, *content, digest().alias("_new")).join(before, list(key), "left")
    changed = F.col("_d") != F.col("_new")
    version = F.when(F.col("_v").isNull(), 1).otherwise(F.col("_v") + F.when(changed, 1).otherwise(0))
    done = F.when(F.col("_v").isNull(), "registered").when(changed, "updated").otherwise("unchanged")
    rest = old.join(new.select(*key), list(key), "left_anti").select(*key, *content, "version", F.lit("kept").alias("done"))
    return both.select(*key, *content, version.cast("int").alias("version"), done.alias("done")).unionByName(rest.withColumn("version", F.col("version").cast("int")))


def replaced_labels(old: DataFrame, judged: DataFrame, owner: Sequence[str]) -> DataFrame:
    """Label rows (owner, skill, label, ...) after judgements (owner, skill, ok, labels): one that is ok replaces all rows of its owner and skill.

    A judgement that failed changes nothing; repeated labels, or unassigned beside others, are an error.
    """
    good = judged.where("ok")
    odd = (F.size(F.array_distinct("labels")) < F.size("labels")) | ((F.size("labels") > 1) & F.array_contains("labels", UNASSIGNED))
    if not good.where(odd).isEmpty():
        raise ValueError("a judgement repeats a label or has unassigned beside another")
    rest = old.join(good.select(*owner, "skill"), [*owner, "skill"], "left_anti")
    fresh = good.select(*owner, "skill", F.explode("labels").alias("label"), *[c for c in old.columns if c not in (*owner, "skill", "label")])
    return rest.select(*old.columns).unionByName(fresh.select(*old.columns))


def decided(edges: DataFrame, decisions: DataFrame, *, revise: bool = False) -> DataFrame:
    """Edges after reviews (edge_id, reviewer, status): only proposed ones are decided, a revision takes any. done says which were."""
    own = decisions.select("edge_id", F.col("reviewer").alias("_by"), F.col("status").alias("_to"))
    rows = edges.join(own, "edge_id", "left")
    hit = F.col("_to").isNotNull() & (F.lit(revise) | (F.col("status") == "proposed"))
    return rows.withColumns({"done": hit, "reviewed_by": F.when(hit, F.col("_by")).otherwise(F.col("reviewed_by")), "status": F.when(hit, F.col("_to")).otherwise(F.col("status"))}).drop("_by", "_to")


def promoted(kinds: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Kinds after the inactive ones among the codes became active."""
    return kinds.withColumn("status", F.when(F.col("kind").isin(*codes) & (F.col("status") == "inactive"), "active").otherwise(F.col("status")))


def upserted_kinds(old: DataFrame, new: DataFrame) -> DataFrame:
    """Kinds (kind, name, description, status): new ones come inactive; of a known one only what isn't blank is taken, never the status."""
    filled = lambda c: F.coalesce(F.when(F.trim(f"_{c}") != "", F.col(f"_{c}")), F.col(c)).alias(c)
    fresh = new.select("kind", F.col("name").alias("_name"), F.col("description").alias("_description"))
    return old.join(fresh, "kind", "full_outer").select("kind", filled("name"), filled("description"), F.coalesce("status", F.lit("inactive")).alias("status"))


def new_kinds(proposed: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Valid codes among the proposed that no known kind has, each once."""
    codes = proposed.select(kind_code(F.col(column), RESERVED).alias("kind")).where(F.col("kind").isNotNull()).distinct()
    return codes.join(known.select("kind"), "kind", "left_anti")


def refreshed_vectors(old: DataFrame, wanted: DataFrame, key: Sequence[str]) -> DataFrame:
    """wanted (key, material_hash, model, version) with what is to be done: created, updated, or reused where all three are the same."""
    have = old.select(*key, F.struct("material_hash", "model", "version").alias("_have"))
    now = F.struct("material_hash", "model", "version")
    return wanted.join(have, list(key), "left").withColumn("done", F.when(F.col("_have").isNull(), "created").when(F.col("_have") == now, "reused").otherwise("updated")).drop("_have")


def merged_aliases(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Entities (key, aliases) after registrations: aliases of both, one for each spelling but for case and white space, and what was done."""
    norm = lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))
    none = F.array().cast("array<string>")
    both = old.select(*key, F.col("aliases").alias("_old")).join(new.select(*key, F.col("aliases").alias("_new")), list(key), "full_outer")
    every = F.filter(F.concat(F.coalesce("_old", none), F.transform(F.coalesce("_new", none), lambda x: F.trim(x))), lambda x: x != "")
    first = let(every, lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda y: norm(y) == norm(x))))
    done = F.when(F.col("_old").isNull(), "registered").when(F.col("_new").isNull() | (F.size("aliases") == F.size("_old")), "unchanged").otherwise("updated")
    return both.withColumn("aliases", first).withColumn("done", done).drop("_old", "_new")
