"""Labels of topics, keywords, and file names without what looks like an identifier."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from .scalars import let

#: The longest label, the punctuation cut from its ends, and words too general for a keyword.
LABEL_MAX = 200
EDGE = r"\s.,;:!?·、，。"
GENERIC = frozenset("영상 동영상 비디오 장면 이미지 사진 그림 화면 영상입니다 장면입니다 사진입니다 이미지입니다 동영상입니다 화면입니다".split())
#: Tokens of at least this length with fewer vowels than this share are identifiers.
ID_LENGTH, ID_VOWELS = 8, 0.25


def _words(text: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.split(bare, r"(?U)\s+", -1)


def _cut(label: Column) -> Column:
    return F.regexp_replace(F.substring(label, 1, LABEL_MAX), r"(?U)\s+$", "")


def topic(raw: Column) -> Column:
    """The first word; empty for a blank one. A label without spaces stays whole."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)^\s+|\s+$", "")
    return _cut(F.when(bare.contains(" "), F.get(_words(raw), F.lit(0))).otherwise(bare))


def topic_en(raw: Column) -> Column:
    """Lower case, up to two words; of more only the first."""
    parts = _words(F.lower(raw))
    return _cut(F.when(F.size(parts) > 2, F.get(parts, F.lit(0))).otherwise(F.array_join(parts, " ")))


def subtopic(raw: Column) -> Column:
    """The first word without punctuation at the ends of the label."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), rf"(?U)^[{EDGE}]+|[{EDGE}]+$", "")
    return _cut(F.get(_words(bare), F.lit(0)))


def subtopic_en(raw: Column) -> Column:
    return subtopic(F.lower(raw))


def keywords(*lists: Column, limit: int | None = None) -> Column:
    """The lists' values in order, trimmed, without blanks, general words and repeats (case folded), at most limit."""

    @pandas_udf(ArrayType(StringType()))
    def clean(values: pd.Series) -> pd.Series:
        def one(v) -> list[str]:
            out: dict[str, str] = {}
            for text in (str(x).strip() for x in v if x is not None):
                out.setdefault(text.casefold(), text)
            return [t for key, t in out.items() if key and key not in GENERIC][:limit]

        return values.map(one)

    empty = F.array().cast("array<string>")
    return clean(F.concat(empty, *[F.coalesce(c, empty) for c in lists]))


def id_like(token: Column) -> Column:
    """ASCII letters and digits that no word would have: few vowels, or mixed kinds of characters."""
    n = F.char_length(token)
    vowels = n - F.char_length(F.regexp_replace(token, "[aeiouAEIOU]", ""))
    natural = token.rlike("^(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)$")
    mixed = sum((token.rlike(p).cast("int") for p in ("[A-Z]", "[a-z]", "[0-9]")), F.lit(0)) >= 2
    strange = F.when(vowels / n < ID_VOWELS, ~(natural & token.rlike("[aeiouyAEIOUY]"))).otherwise(mixed & ~natural)
    return token.rlike(f"^[A-Za-z0-9-]{{{ID_LENGTH},}}$") & strange


def cleaned_name(name: Column, noise: Iterable[str] = ()) -> Column:
    """The name without extension, identifiers and tokens that match a noise pattern; words joined by spaces."""
    patterns: Sequence[str] = list(noise)
    stem = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?s)\.[^.]*$", "")

    def keep(token: Column) -> Column:
        out = (token != "") & ~id_like(token)
        for p in patterns:
            out = out & ~token.rlike(p)
        return out

    return F.array_join(F.filter(F.split(stem, r"(?U)[_\s]+", -1), keep), " ")


#: Prefixes of cameras and tools, sources that file names begin with, marks around names, what separates them.
DEVICE = r"(?i)^(?:img|dsc|dscn|dcim|pic|photo|image|vid|video|mov|movie|screen ?shot|capture|kakaotalk|download|untitled|new ?file|캡처|사진|스크린샷|제목\s*없음|무제|새\s*파일)[ _\-]*"
SOURCES = ("youtube", "wikipedia")
OPEN, CLOSE = "\\[\\(（｛{《〈⟪「｢'\"“”‘’", "\\]\\)）｝}》〉⟫」｣'\"“”‘’"
HASHTAG = r"#([^\s#\[\]()（）｜|]{1,30})"
SEPARATOR = r"(?U)(?:[｜|/,·・•∙‧ㅣ:：;~〜]+|\s[-–—]\s)"
TELLING = "[가-힣]{2,}|[A-Za-z]{3,}"
CANDIDATES, CANDIDATE_LENGTH = 6, 40


def meaningful(stem: Column) -> Column:
    """The stem if it tells something besides a device's prefix; else null."""
    bare = F.regexp_replace(stem, r"(?U)^\s+|\s+$", "")
    return F.when(F.regexp_replace(bare, DEVICE, "").rlike(TELLING), bare)


def candidates(stem: Column, limit: int = CANDIDATES) -> Column:
    """What may be names in a stem: bracketed parts, then hashtags, then parts between separators; each once but for case and spaces."""
    marked = f"[{OPEN}]([^{OPEN}{CLOSE}]{{1,40}})[{CLOSE}]"
    text = F.coalesce(stem, F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(text, marked, " "), HASHTAG, " ")
    parts = F.concat(F.regexp_extract_all(text, F.lit(marked)), F.regexp_extract_all(text, F.lit(HASHTAG)), F.split(rest, SEPARATOR))
    clean = F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), "^ | $", ""), "^[#.·,]+|[#.·,]+$", ""))
    good = F.filter(clean, lambda x: (F.char_length(x) <= CANDIDATE_LENGTH) & x.rlike(TELLING))
    key = lambda x: F.lower(F.regexp_replace(x, r"(?U)\s+", ""))
    first = lambda every: F.filter(every, lambda x, i: ~F.exists(F.slice(every, F.lit(1), i), lambda y: key(y) == key(x)))
    return F.slice(let(good, first), 1, limit)


def topic_of_file(name: Column) -> Column:
    """The topic that a file name tells: its last brackets, the part behind a source's name, else the first part behind an id."""
    stem = F.regexp_replace(F.regexp_replace(name, r"(?s)\.[^.]*$", ""), r"(?U)^\s+|\s+$", "")
    parts = F.split(F.when(stem.contains("__"), F.regexp_extract(stem, r"(?s)^.*?__(.*)$", 1)).otherwise(stem), "_")
    at = F.when((F.size(parts) >= 2) & F.get(parts, F.lit(0)).isin(*SOURCES), F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    ending = F.regexp_extract(stem, r"\(([^()]+)\)\s*$", 1)
    return F.when(ending != "", F.regexp_replace(ending, r"(?U)^\s+|\s+$", "")).otherwise(at)


def topic_fields(edge: dict[str, Column], default: str = "일반", default_en: str = "general") -> Column:
    """struct(topic, subtopic, topic_en, subtopic_en, fallback) from an edge's columns under any of their names.

    Without a topic the first word of the reason's first line stands in, else the default.
    """
    none = F.lit(None).cast("string")
    first = lambda *keys: F.coalesce(*[F.when(F.trim(edge[k]) != "", edge[k]) for k in keys if k in edge], none)
    told, line = topic(first("topic_ko", "topic")), topic(F.substring_index(F.trim(edge.get("reason", none)), "\n", 1))
    missing = told == ""
    en = topic_en(first("topic_en"))
    return F.struct(
        F.when(~missing, told).when(line != "", line).otherwise(default).alias("topic"), subtopic(first("subtopic_ko", "sub_topic_ko", "subtopic")).alias("subtopic"),
        F.when(missing & (en == ""), default_en).otherwise(en).alias("topic_en"), subtopic_en(first("subtopic_en", "sub_topic_en")).alias("subtopic_en"), missing.alias("fallback"),
    )


def inserted(prompt: Column, marker: str, block: Column) -> Column:
    """The block before the marker's first place, or at the end of a prompt without it."""
    at = F.instr(prompt, F.lit(marker))
    return F.when(at > 0, F.concat(F.substr(prompt, F.lit(1), at - 1), block, F.substr(prompt, at))).otherwise(F.concat(prompt, block))


def timed_id(millis: Column) -> Column:
    """A version 7 identifier as text: 48 bits of time, then random ones; a retried task draws others, so store it before use."""
    noise = F.replace(F.uuid(), F.lit("-"), F.lit(""))  # version 4: the digit of its variant is already right
    time = F.lpad(F.lower(F.hex(millis)), 12, "0")
    return F.concat_ws("-", F.substring(time, 1, 8), F.substring(time, 9, 4), F.concat(F.lit("7"), F.substring(noise, 1, 3)), F.substring(noise, 17, 4), F.substring(noise, 21, 12))
