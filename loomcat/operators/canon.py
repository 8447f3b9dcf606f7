"""Names resolved to registered ones: aliases, contained names, official forms, topics and subtopics.

Where a model has to answer, the caller passes a function of distinct rows; what it answered is
returned as rows to be stored, so that the next run finds them as aliases.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.scalars import text_key
from .nearest import nearest_topics  # noqa: F401

#: A contained name's least length, the type that may be shorter at the front, words that are no subtopic.
CONTAINED_MIN = 3
PERSON = "인물"
MEDIA_WORDS = ("텍스트", "오디오", "영상", "이미지", "text", "audio", "video", "image")
#: What an official name ends in, longest first, and the type that has such names.
OFFICIAL_ENDS = ("특별자치도", "특별자치시", "특별시", "광역시", "시", "군", "도")
PLACE, BASE_MIN = "장소", 2
UNCLASSIFIED, GENERAL = "미분류", "general"

Answer = Callable[[pd.DataFrame], Sequence[str | None]]


def filled(text: Column) -> Column:
    """The text without white space at its ends; null for a blank one."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(bare != "", bare)


def spellings(entities: DataFrame) -> DataFrame:
    """entity_type, key, spelling, alias, uid: the name (or else the uid) and the aliases of entities (entity_type, uid, name, aliases)."""
    own = F.array(F.struct(F.coalesce(filled(F.col("name")), F.col("uid")).alias("spelling"), F.lit(False).alias("alias")))
    more = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.struct(x.alias("spelling"), F.lit(True).alias("alias")))
    rows = entities.select("entity_type", "uid", F.inline(F.concat(own, more)))
    return rows.withColumn("key", text_key(F.col("spelling"))).where(F.col("key") != "")


def alias_index(entities: DataFrame) -> DataFrame:
    """entity_type, key and the registered name it leads to: a name goes before an alias, then the smaller uid."""
    every = spellings(entities).join(entities.select("entity_type", "uid", F.coalesce(filled(F.col("name")), F.col("uid")).alias("name")), ["entity_type", "uid"])
    return every.groupBy("entity_type", "key").agg(F.min_by("name", F.struct("alias", "uid")).alias("name"))


def official_index(entities: DataFrame, sizes: DataFrame) -> DataFrame:
    """entity_type, base key and official name: of names that end officially, the one with most members, then the longest ending, then its key."""
    rows = spellings(entities).where(F.col("entity_type") == PLACE).join(sizes.select("entity_type", "uid", "size"), ["entity_type", "uid"], "left")
    rows = rows.withColumn("end", official_end(F.col("key"))).where("end is not null")
    base = F.col("key").substr(F.lit(1), F.char_length("key") - F.char_length("end"))
    order = F.struct((-F.greatest(F.coalesce("size", F.lit(0)), F.lit(0))).alias("a"), (-F.char_length("end")).alias("b"), F.col("key").alias("c"), F.col("spelling").alias("d"))
    return rows.groupBy("entity_type", base.alias("key")).agg(F.min_by("spelling", order).alias("name"))


def official_end(key: Column) -> Column:
    """The longest ending that leaves a base of two characters or more; else null."""
    hits = [F.when(F.endswith(key, F.lit(e)) & (F.char_length(key) >= len(e) + BASE_MIN), F.lit(e)) for e in OFFICIAL_ENDS]
    return F.coalesce(*hits)


def resolved(found: DataFrame, index: DataFrame, owner: Sequence[str]) -> DataFrame:
    """Judged names (owner, position, entity_type, name, keyword) under their registered names, each once per owner: the first stays."""
    known = index.select("entity_type", "key", F.col("name").alias("registered"))
    rows = found.withColumn("key", text_key(F.col("name"))).join(known, ["entity_type", "key"], "left")
    rows = rows.withColumn("name", F.coalesce("registered", "name")).drop("registered", "key").withColumn("key", text_key(F.col("name")))
    first = F.min_by(F.struct("position", "name", "keyword"), "position")
    return rows.groupBy(*owner, "entity_type", "key").agg(first.alias("first")).select(*owner, "entity_type", "key", "first.*")


def contained(found: DataFrame, index: DataFrame, owner: Sequence[str], types: Sequence[str], generic: Callable[[Column], Column] | None = None) -> DataFrame:
    """Registered names inside judged ones that aren't registered themselves: (owner, from_type, from_name, entity_type, name), as resolved() gives them.

    Runs of words are tried by falling length, then from the front, and don't overlap; a run counts
    if exactly one of the types has it registered, it is no generic name and long enough. What an
    owner has already, or an earlier name added, is left out. A name of n words gives n * n / 2 runs.
    """
    known = index.where(F.col("entity_type").isin(*types)).groupBy("key").agg(F.count("*").alias("n"), F.first("entity_type").alias("to_type"), F.first("name").alias("to_name")).where("n = 1").drop("n")
    open_ = found.join(index.select("entity_type", "key"), ["entity_type", "key"], "left_anti")
    words = F.filter(F.split(F.regexp_replace("name", r"(?U)\s+", " "), " "), lambda w: w != "")
    rows = open_.select(*owner, "position", F.col("entity_type").alias("from_type"), F.col("name").alias("from_name"), words.alias("words")).where(F.size("words") > 1)
    size = F.explode(F.sequence(F.lit(1), F.size("words") - 1))
    rows = rows.withColumn("n", size).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))))
    runs = rows.withColumn("key", text_key(F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " "))).drop("words")
    runs = runs if generic is None else runs.where(~generic(F.col("key")))
    n = F.char_length("key")
    hits = runs.join(known, "key").where((n >= CONTAINED_MIN) | ((F.col("to_type") == PERSON) & (F.col("at") == 0) & (n >= 2)))
    one = F.struct((-F.col("n")).alias("less"), "at", "n", "key", "to_type", "to_name")
    groups = hits.groupBy(*owner, "position", "from_type", "from_name").agg(F.array_sort(F.collect_list(one)).alias("hits"))
    clash = lambda x, y: (x["at"] < y["at"] + y["n"]) & (y["at"] < x["at"] + x["n"])
    none = F.array().cast("array<struct<less:int,at:int,n:int,key:string,to_type:string,to_name:string>>")
    taken = F.aggregate("hits", none, lambda kept, x: F.when(F.exists(kept, lambda y: clash(x, y)), kept).otherwise(F.concat(kept, F.array(x))))
    added = groups.select(*owner, "position", "from_type", "from_name", F.posexplode(taken).alias("nth", "hit"))
    added = added.select(*owner, "position", "nth", "from_type", "from_name", F.col("hit.to_type").alias("entity_type"), F.col("hit.to_name").alias("name")).withColumn("key", text_key(F.col("name")))
    fresh = added.join(found.select(*owner, "entity_type", "key"), [*owner, "entity_type", "key"], "left_anti")
    first = F.min_by(F.struct("from_type", "from_name", "name"), F.struct("position", "nth"))
    return fresh.groupBy(*owner, "entity_type", "key").agg(first.alias("first")).select(*owner, "first.from_type", "first.from_name", "entity_type", "first.name")


def aliased(rows: DataFrame, aliases: DataFrame, raw: str, parent: Column) -> DataFrame:
    """rows with the column `hit`: what aliases (raw, parent, canonical) say of the raw label under its parent; a null parent is one of its own."""
    known = aliases.select(F.col("raw").alias("_raw"), F.col("parent").alias("_parent"), F.col("canonical").alias("hit"))
    keyed = rows.withColumn("_under", parent)
    return keyed.join(known, (F.col(raw) == F.col("_raw")) & F.col("_under").eqNullSafe(F.col("_parent")), "left").drop("_raw", "_parent", "_under")


def answered(rows: DataFrame, answer: Answer, column: str = "answer") -> DataFrame:
    """rows with what the function says of each batch of them; executors call it, so it must be picklable."""

    def each(batches):
        for batch in batches:
            yield batch.assign(**{column: pd.Series(list(answer(batch)), index=batch.index, dtype=object)})

    return rows.mapInPandas(each, rows.select("*", F.lit(None).cast("string").alias(column)).schema)


def topics(raws: DataFrame, registry: DataFrame, aliases: DataFrame, answer: Answer) -> DataFrame:
    """Distinct raws (raw, raw_en) with canonical, canonical_en and decided_by.

    passthrough: blank labels, or no registry (rows topic_ko, topic_en without parent); exact: a
    registered label or a known alias; classify: the answer, if it is a registered label, else
    the unclassified one. Only labels that nothing decides reach the answer.
    """
    closed = registry.where("parent is null").select(F.col("topic_ko").alias("_ko"), F.col("topic_en").alias("_en"))
    rows = aliased(raws, aliases, "raw", F.lit(None).cast("string"))
    as_is = raws.select("raw", "raw_en", F.col("raw").alias("canonical"), F.coalesce(F.when(F.col("raw_en") != "", F.col("raw_en")), F.lit(GENERAL)).alias("canonical_en"), F.lit("passthrough").alias("decided_by"))
    if closed.isEmpty():
        return as_is
    same = rows.where(filled(F.col("raw")).isNotNull()).join(closed.select(F.col("_ko").alias("_exact")), F.col("raw") == F.col("_exact"), "left")
    known = same.select("raw", "raw_en", F.coalesce("_exact", "hit").alias("canonical"))
    asked = answered(known.where("canonical is null").select("raw", "raw_en"), answer, "said").join(closed.select("_ko"), F.col("said") == F.col("_ko"), "left")
    found = known.where("canonical is not null").withColumn("decided_by", F.lit("exact"))
    found = found.unionByName(asked.select("raw", "raw_en", F.coalesce("_ko", F.lit(UNCLASSIFIED)).alias("canonical"), F.lit("classify").alias("decided_by")))
    named = found.join(closed, F.col("canonical") == F.col("_ko"), "left").select("raw", "raw_en", "canonical", F.col("_en").alias("canonical_en"), "decided_by")
    return named.unionByName(as_is.where(filled(F.col("raw")).isNull()))


def frozen_topics(decided: DataFrame) -> DataFrame:
    """The aliases to be stored for what was classified."""
    return decided.where("decided_by = 'classify'").select("raw", F.lit(None).cast("string").alias("parent"), "canonical")


def subtopics(rows: DataFrame, aliases: DataFrame, candidates: Callable[[DataFrame], DataFrame], answer: Answer) -> DataFrame:
    """Distinct rows (topic, raw) with their canonical subtopic and how it came: none, alias, same (judged a synonym) or new.

    candidates gives (parent, raw, topic_ko, rank) for labels (parent, raw); the answer sees parent, raw
    and the candidates joined by newlines, and counts only if it is one of them.
    """
    label = names.subtopic(F.col("raw"))
    odd = (label == "") | F.lower(label).isin(*MEDIA_WORDS) | (label == F.col("topic"))
    rows = rows.withColumn("label", F.when(~F.coalesce(odd, F.lit(True)), label))
    hits = aliased(rows, aliases, "label", F.col("topic"))
    misses = hits.where("label is not null and hit is null").select(F.col("topic").alias("parent"), F.col("label").alias("raw")).distinct()
    near = candidates(misses).groupBy("parent", "raw").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic_ko"))), lambda x: x["topic_ko"]).alias("near"))
    asked = answered(near.select("parent", "raw", F.array_join("near", "\n").alias("candidates")), answer, "said").join(near, ["parent", "raw"])
    said = asked.where(F.array_contains("near", F.col("said"))).select(F.col("parent").alias("topic"), F.col("raw").alias("label"), "said")
    how = F.when(F.col("label").isNull(), "none").when(F.col("hit").isNotNull(), "alias").when(F.col("said").isNotNull(), "same").otherwise("new")
    return hits.join(said, ["topic", "label"], "left").select("topic", "raw", F.coalesce("hit", "said", "label").alias("canonical"), "label", how.alias("decided_by"))


def learned_subtopics(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The labels to be registered (parent, topic_ko) and the aliases to be stored."""
    new = decided.where("decided_by = 'new'").select(F.col("topic").alias("parent"), F.col("label").alias("topic_ko")).distinct()
    return new, decided.where("decided_by in ('new', 'same')").select(F.col("label").alias("raw"), F.col("topic").alias("parent"), "canonical").distinct()
