"""Texts and keys for index documents, entity materials and prompts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: How the parts of a material are announced.
KEYWORDS, MEMBERS, EXCERPTS = "근거 키워드: ", "구성 키워드: ", "구성 자료: "
MODALITIES = ("text", "image", "video", "audio")
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


@pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def for_embedding(text: Column) -> Column:
    """Composed characters without control and zero-width ones; single spaces, at most two line ends in a row, none at the ends."""
    plain = F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(_composed(text))
    bare = F.regexp_replace(plain, "[​-‏⁠﻿\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    lines = F.regexp_replace(F.regexp_replace(bare, r"\r\n?", "\n"), r"[\t  ]+", " ")
    return F.regexp_replace(F.regexp_replace(lines, r"(?: ?\n ?){3,}", "\n\n"), r"^\s+|\s+$", "")


def _clean(values: Column) -> Column:
    """Distinct trimmed values in order of their text."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")))


def _filled(text: Column) -> Column:
    return F.when(F.trim(text) != "", F.trim(text))


def search_material(name: Column, kind: Column, description: Column, keywords: Column, member_keywords: Column, most: int = 12) -> Column:
    """What an entity is found by: name and type, description, keywords and those of its members, a line each; null without name or type."""
    listed = lambda label, values: F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, ", ")))
    head = F.concat(_filled(name), F.lit(" / "), _filled(kind))
    return F.when(head.isNotNull(), F.concat_ws("\n", head, _filled(description), listed(KEYWORDS, F.slice(_clean(keywords), 1, most)), listed(MEMBERS, _clean(member_keywords))))


def entity_material(name: Column, kind: Column, description: Column, summaries: Column, most: int = 0) -> Column:
    """What an entity is judged by; null without name or type."""
    head = F.concat(_filled(name), F.lit("("), _filled(kind), F.lit(")."))
    some = F.slice(F.filter(F.transform(F.coalesce(summaries, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), 1, most) if most > 0 else F.array().cast("array<string>")
    return F.when(head.isNotNull(), F.concat_ws(" ", head, _filled(description), F.when(F.size(some) > 0, F.concat(F.lit(EXCERPTS), F.array_join(some, " / ")))))


def material_hash(material: Column) -> Column:
    return F.sha2(material.cast("binary"), 256)


def topic_pairs(topics: Column) -> Column:
    """topic>subtopic of (topic, subtopic), each once in order; a topic alone without a subtopic."""
    pair = lambda t: F.concat_ws(">", _filled(t["topic"]), _filled(t["subtopic"]))
    return F.array_distinct(F.transform(F.filter(topics, lambda t: F.trim(t["topic"]) != ""), pair))


def label_keys(labels: Column, without: str = "unassigned") -> Column:
    """skill/label of (skill, label), each once in order, without blank ones and the one for unassigned."""
    real = lambda x: (F.trim(x["skill"]) != "") & (F.trim(x["label"]) != "") & (F.trim(x["label"]) != without)
    return F.array_distinct(F.transform(F.filter(labels, real), lambda x: F.concat_ws("/", F.trim(x["skill"]), F.trim(x["label"]))))


def reason_keyword(reason: Column) -> Column:
    """The keyword of a membership's stamp; null without one."""
    return F.when(reason.rlike("kw="), F.regexp_extract(reason, r"kw=([^|]*)", 1))


def key_parts(doc_id: Column) -> Column:
    """Type and uid of an entity's document id, cut at the first slash."""
    return F.struct(F.substring_index(doc_id, "/", 1).alias("entity_type"), F.regexp_extract(doc_id, r"(?s)^[^/]*/(.*)$", 1).alias("entity_uid"))


def after_prefix(name: Column) -> Column:
    """What follows the first double underscore of a base name; all of it without one."""
    return F.regexp_replace(name, r"(?s)^.*?__", "")


def type_label(code: Column, most: int = 120) -> Column:
    """A kind's code as words."""
    return F.substring(F.trim(F.regexp_replace(code, "_+", " ")), 1, most)


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID), F.lit(False))


def contentful(text: Column, least: int = 15) -> Column:
    return F.coalesce(F.char_length(F.trim(text)) >= least, F.lit(False))


def title_match(value: Column) -> Column:
    """yes, no or unsure; what is none of them is unsure."""
    folded = F.lower(F.trim(value))
    return F.when(folded.isin("yes", "no"), folded).otherwise("unsure")


def by_score(labels: Column) -> Column:
    """(score, label) by falling score, ties by label."""
    return F.array_sort(labels, lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0))


def like_escaped(value: str) -> str:
    """A text as a LIKE pattern that matches only itself."""
    return re.sub(r"([\\%_])", r"\\\1", value)


def kind_set(raw: str | None, default: Sequence[str] = ()) -> frozenset[str]:
    """Lower-case codes of a comma-separated text; an empty text is no code, none at all the default."""
    return frozenset(default if raw is None else (x for x in (y.strip().lower() for y in raw.split(",")) if x))


def modalities(raw: str | None) -> list[str] | None:
    """Modalities of a comma-separated text; None for a blank one, ValueError for an unknown one."""
    found = [x for x in (y.strip().lower() for y in (raw or "").split(",")) if x]
    if set(found) - set(MODALITIES):
        raise ValueError(f"unknown modalities: {sorted(set(found) - set(MODALITIES))}")
    return found or None
