"""What models answered, read strictly: labels of a skill, entities of keywords, one-line descriptions; and the texts they are asked.

Answers are JSON texts. Each reader gives a struct (ok, failure, ...): the first rule that an
answer breaks names the failure, and nothing of a failed answer is used.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from .scalars import let

#: Keys of the answers, lengths of texts, the default number of labels, codes and modes of skills.
JUDGED, DESCRIBED, LABELS = "판정", "설명", "labels"
SUMMARY_MAX, MEMBER_MAX, DESCRIPTION_MAX, LABELS_MAX = 250, 150, 120, 30
CODE = re.compile(r"[a-z][a-z0-9_]{0,99}")
MODES = ("multi", "single")
RESERVED = "unassigned"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _at(value: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(value, f'$["{key}"]', kind)


def _first(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds; null if none does."""
    return F.coalesce(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(name)) for hit, name in rules])


def _shapeless(response: Column) -> Column:
    keys = F.json_object_keys(response)
    return F.try_parse_json(response).isNull() | keys.isNull() | (F.size(keys) == 0)


def _lacks(response: Column, key: str) -> Column:
    return ~F.array_contains(F.json_object_keys(response), key)


@dataclass(frozen=True)
class Skill:
    """A closed set of labels (code, name, definition, not), and how many of them one thing may have."""

    code: str
    name: str
    labels: tuple[tuple[str, str, str, str], ...]
    unassigned: str
    selection: str = MODES[0]
    max_labels: int = LABELS_MAX

    def declared(self) -> dict:
        """The configuration that read_skill() takes."""
        fields = ("code", "name", "definition", "not")
        policy = {"selection": self.selection, "unassigned": self.unassigned, "max_labels": self.max_labels}
        return {"code": self.code, "name": self.name, "policy": policy, "labels": [dict(zip(fields, x, strict=True)) for x in self.labels]}

    def confirmation(self) -> str:
        """A short digest of the whole configuration, which a registration has to repeat."""
        return hashlib.sha256(json.dumps(self.declared(), sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]


def _fields(raw: object, where: str, needed: Sequence[str], optional: Sequence[str] = ()) -> Mapping:
    if not isinstance(raw, Mapping):
        raise ValueError(f"{where}: a mapping is expected")
    if odd := set(raw) - {*needed, *optional}:
        raise ValueError(f"{where}: unknown keys {sorted(map(str, odd))}")
    if lost := [k for k in needed if k not in raw]:
        raise ValueError(f"{where}: missing keys {lost}")
    return raw


def _text(raw: object, where: str) -> str:
    if not isinstance(raw, str) or not raw.strip():
        raise ValueError(f"{where}: a text is expected")
    return raw.strip()


def read_skill(raw: object) -> Skill:
    """A skill from its configuration; ValueError names what is wrong."""
    top = _fields(raw, "skill", ("code", "name", "policy", "labels"))
    policy = _fields(top["policy"], "policy", ("unassigned",), ("selection", "max_labels"))
    mode, most = policy.get("selection", MODES[0]), policy.get("max_labels", LABELS_MAX)
    if _text(mode, "policy.selection") not in MODES:
        raise ValueError(f"policy.selection: one of {MODES} is expected")
    if isinstance(most, bool) or not isinstance(most, int) or most < 1:
        raise ValueError("policy.max_labels: a positive whole number is expected")
    if not isinstance(top["labels"], (list, tuple)) or not 1 <= len(top["labels"]) <= most:
        raise ValueError(f"labels: a list of 1 to {most} labels is expected")
    order = ("code", "name", "definition", "not")
    labels = tuple(tuple(_text(_fields(x, f"labels[{i}]", order)[k], f"labels[{i}].{k}") for k in order) for i, x in enumerate(top["labels"]))
    skill = Skill(_text(top["code"], "code"), _text(top["name"], "name"), labels, _text(policy["unassigned"], "policy.unassigned"), mode.strip(), most)
    codes, shown = [x[0] for x in labels], [x[1] for x in labels]
    if bad := [c for c in (skill.code, *codes) if not CODE.fullmatch(c)]:
        raise ValueError(f"no codes: {bad}")
    if len(set(codes)) < len(codes) or len(set(shown)) < len(shown) or RESERVED in codes or skill.unassigned in shown:
        raise ValueError("labels: codes and names must differ from each other and from the unassigned label")
    return skill


def label_answer(response: Column, skill: Skill) -> Column:
    """struct(ok, failure, names, codes) of {"labels": [name, ...]}; labels come in the skill's order, the code of the unassigned one is reserved."""
    value = F.try_parse_json(response)
    raw = _at(value, LABELS, "array<variant>")
    texts = F.array_distinct(F.transform(raw, lambda x: _trimmed(F.try_variant_get(x, "$", "string"))))
    shown = F.array(*[F.lit(x[1]) for x in skill.labels])
    n, unassigned = F.size(texts), F.lit(skill.unassigned)
    failure = _first(
        (_shapeless(response), "response_shape"),
        (_lacks(response, LABELS), "labels_missing"),
        (~F.startswith(_kind(_at(value, LABELS, "variant")), F.lit("ARRAY")), "labels_not_list"),
        (F.size(raw) == 0, "labels_empty"),
        (F.exists(raw, lambda x: (_kind(x) != "STRING") | (_trimmed(F.try_variant_get(x, "$", "string")) == "")), "element_not_text"),
        (F.exists(texts, lambda x: ~F.array_contains(shown, x) & (x != unassigned)), "out_of_vocab"),
        (F.array_contains(texts, unassigned) & (n > 1), "unassigned_mixed"),
        (F.lit(skill.selection == "single") & (n > 1), "single_policy"),
    )
    code = F.create_map(*[F.lit(y) for x in (*skill.labels, (RESERVED, skill.unassigned)) for y in (x[1], x[0])])
    ordered = let(texts, lambda t: F.when(F.array_contains(t, unassigned), F.array(unassigned)).otherwise(F.filter(shown, lambda x: F.array_contains(t, x))))
    names = F.when(failure.isNull(), ordered)
    return F.struct(failure.isNull().alias("ok"), failure.alias("failure"), names.alias("names"), F.transform(names, lambda x: F.element_at(code, x)).alias("codes"))


@pandas_udf(ArrayType(StringType()))
def _spelled(asked: pd.Series, written: pd.Series) -> pd.Series:
    """How an answer spells each keyword: as it is, or the first with the same key; null where it doesn't."""
    fold = lambda x: "".join(unicodedata.normalize("NFKC", x).split()).casefold()

    def one(words, keys) -> list[str | None]:
        keys = [] if keys is None else list(keys)
        by_key = {fold(k): k for k in reversed(keys)}
        return [w if w in keys else by_key.get(fold(w)) for w in words]

    return pd.Series([one(a, w) for a, w in zip(asked, written, strict=True)], dtype=object)


def clean_keywords(keywords: Column) -> Column:
    """Distinct trimmed keywords in order, without blank ones."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), _trimmed), lambda x: x != ""))


def entity_answer(keywords: Column, response: Column, types: Sequence[str]) -> Column:
    """struct(ok, failure, entities(keyword, name, entity_type)) of {"판정": {keyword: {"entity", "type"}}}.

    A keyword is looked up as it is, else by its key; of several spellings of a key the first by
    text counts. Keywords without an entity, or with a type that isn't one of the types, give none.
    """
    value, asked = F.try_parse_json(response), clean_keywords(keywords)
    entries = _at(value, JUDGED, "map<string,variant>")
    written = F.array_sort(F.map_keys(entries))
    found = F.arrays_zip(asked.alias("keyword"), _spelled(asked, written).alias("key"))
    hits = F.filter(found, lambda x: x["key"].isNotNull())
    part = lambda e, k: F.when(_kind(F.try_variant_get(e, f"$.{k}", "variant")) == "STRING", F.try_variant_get(e, f"$.{k}", "string"))
    one = lambda x, e: F.struct(x["keyword"].alias("keyword"), _trimmed(part(e, "entity")).alias("name"), part(e, "type").alias("entity_type"))
    read = let(F.struct(hits.alias("hits"), entries.alias("entries")), lambda z: F.transform(z["hits"], lambda x: one(x, F.element_at(z["entries"], x["key"]))))
    real = F.filter(read, lambda x: F.coalesce((x["name"] != "") & x["entity_type"].isin(*types), F.lit(False)))
    failure = _first(
        (F.size(asked) == 0, "no_keywords"),
        (_shapeless(response), "response_shape"),
        (_lacks(response, JUDGED), "judgement_missing"),
        (~F.startswith(_kind(_at(value, JUDGED, "variant")), F.lit("OBJECT")), "judgement_not_mapping"),
        (F.size(written) == 0, "judgement_empty"),
        (F.size(hits) == 0, "keywords_unmatched"),
    )
    return F.struct(failure.isNull().alias("ok"), failure.alias("failure"), F.when(failure.isNull(), real).alias("entities"))


def description_answer(members: Column, response: Column) -> Column:
    """struct(ok, failure, description) of {"설명": text}: white space collapsed, never cut; members (modality, summary) must hold a summary."""
    value = F.try_parse_json(response)
    text = _trimmed(F.regexp_replace(_at(value, DESCRIBED, "string"), r"(?U)\s+", " "))
    failure = _first(
        (F.size(clean_members(members)) <= 0, "no_members"),
        (_shapeless(response), "response_shape"),
        (_lacks(response, DESCRIBED), "description_missing"),
        (_kind(_at(value, DESCRIBED, "variant")) != "STRING", "description_not_str"),
        (text == "", "description_empty"),
        (F.char_length(text) > DESCRIPTION_MAX, "description_too_long"),
    )
    return F.struct(failure.isNull().alias("ok"), failure.alias("failure"), F.when(failure.isNull(), text).alias("description"))


def clean_members(members: Column, most: int = MEMBER_MAX) -> Column:
    """(modality, summary) with a summary, cut to its length; a blank modality is unknown."""
    none = F.array().cast("array<struct<modality:string,summary:string>>")
    one = lambda m: F.struct(F.coalesce(F.nullif(_trimmed(m["modality"]), F.lit("")), F.lit("unknown")).alias("modality"), F.substring(_trimmed(F.coalesce(m["summary"], F.lit(""))), 1, most).alias("summary"))
    return F.filter(F.transform(F.coalesce(members, none), one), lambda m: m["summary"] != "")


def label_prompt(skill: Skill, summary: Column, keywords: Column) -> Column:
    """What a model is asked about a text with the skill's labels."""
    lines = [f"- {name}: {definition} (not: {other})" for _, name, definition, other in skill.labels]
    rule = "one label" if skill.selection == "single" else "every label that fits"
    head = "\n".join([f"Classify by {skill.name}. Choose {rule}; if none fits, {skill.unassigned} alone.", *lines, 'Answer as JSON: {"labels": ["..."]}'])
    return F.concat_ws("\n", F.lit(head), F.concat(F.lit("Summary: "), F.substring(F.coalesce(summary, F.lit("")), 1, SUMMARY_MAX)), F.concat(F.lit("Keywords: "), F.to_json(clean_keywords(keywords))))


def entity_prompt(summary: Column, keywords: Column, types: Mapping[str, str]) -> Column:
    """What a model is asked about keywords; types are names with their definitions."""
    head = "\n".join(["For each keyword name the entity that it stands for and its type, or null.", *[f"- {n}: {d}" for n, d in types.items()], f'Answer as JSON: {{"{JUDGED}": {{keyword: {{"entity": "...", "type": "..."}}}}}}'])
    return F.concat_ws("\n", F.lit(head), F.concat(F.lit("Summary: "), F.substring(F.coalesce(summary, F.lit("")), 1, SUMMARY_MAX)), F.concat(F.lit("Keywords: "), F.to_json(clean_keywords(keywords))))


def prompt_version(base: str, types: Mapping[str, str]) -> str:
    """The prompt's version with a digest of the types, so that other types are judged again."""
    return f"{base}-{hashlib.sha256(json.dumps(list(types.items()), ensure_ascii=False).encode()).hexdigest()[:8]}"


def description_prompt(name: Column, kind: Column, members: Column) -> Column:
    """What a model is asked about an entity and its members."""
    lines = F.transform(clean_members(members), lambda m: F.concat(F.lit("- ("), m["modality"], F.lit(") "), m["summary"]))
    head = F.concat(F.lit("Describe in one sentence: "), name, F.lit(" ("), kind, F.lit("), "), F.size(lines).cast("string"), F.lit(" items"))
    return F.concat_ws("\n", head, F.array_join(lines, "\n"), F.lit(f'Answer as JSON: {{"{DESCRIBED}": "..."}}'))
