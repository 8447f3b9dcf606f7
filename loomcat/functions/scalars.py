"""Column functions for keys, names, numbers and vectors."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once: a column named within a lambda is worked out again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else "".join(unicodedata.normalize("NFKC", x).split()).casefold())


def text_key(text: Column) -> Column:
    """NFKC, without white space, case folded; ASCII texts stay in the JVM."""
    plain = F.lower(F.regexp_replace(text, r"\s+", ""))
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), plain).otherwise(_folded(text))


@pandas_udf(ArrayType(StringType()))
def _folded_each(values: pd.Series) -> pd.Series:
    fold = lambda x: None if x is None else "".join(unicodedata.normalize("NFKC", x).split()).casefold()
    return values.map(lambda v: None if v is None else [fold(x) for x in v])


def text_keys(values: Column) -> Column:
    """text_key of each value; arrays of ASCII texts stay in the JVM."""
    plain = F.transform(values, lambda x: F.lower(F.regexp_replace(x, r"\s+", "")))
    foreign = F.exists(values, lambda x: ~x.rlike(r"^[\x00-\x7F]*$"))
    return F.when(~F.coalesce(foreign, F.lit(False)), plain).otherwise(_folded_each(values))


def has_letter_or_digit(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def safe_float(value: Column, default: float = 0.0) -> Column:
    """value as a double; default for what is no finite number."""
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), default).otherwise(x)


def basename(path: Column) -> Column:
    """What follows the last slash; query and fragment are cut from URIs only."""
    bare = F.when(path.contains("://"), F.regexp_replace(path, r"[?#].*$", "")).otherwise(path)
    return F.regexp_extract(bare, r"([^/]*)$", 1)


def display_name(path: Column) -> Column:
    """The base name without an asset id in front."""
    return F.regexp_replace(basename(path), r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}__", "")


def file_ext(path: Column) -> Column:
    """Lower-case extension; null without a dot or behind a last one."""
    ext = F.regexp_extract(basename(path), r"\.([^.]+)$", 1)
    return F.when(ext != "", F.lower(ext))


def distinct_in_order(values: Column) -> Column:
    """Trimmed values without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of length zero, which take no part."""
    size = l2_norm(a) * l2_norm(b)
    return F.when(size > 0, dot(a, b) / size)


def padded(vector: Column, size: int) -> Column:
    """vector with zeros up to size; a longer one stays as it is."""
    return F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(size) - F.size(vector), F.lit(0))))


def member_reason(keyword: Column, prompt_version: Column, rule_version: Column) -> Column:
    return F.concat(F.lit("kw="), keyword, F.lit("|pv="), prompt_version, F.lit("|rv="), rule_version.cast("string"))


def parsed_reason(reason: Column) -> Column:
    """keyword, prompt_version and rule_version of a stamp, null if it is none."""
    form = r"(?s)^kw=(.+)\|pv=(.+)\|rv=(\d+)$"
    part = lambda i: F.regexp_extract(reason, form, i)
    return F.when(reason.rlike(form), F.struct(part(1).alias("keyword"), part(2).alias("prompt_version"), part(3).cast("int").alias("rule_version")))
