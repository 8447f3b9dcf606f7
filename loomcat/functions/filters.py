"""Search filters, narrowing, exposure and access as column conditions."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Sequence
from datetime import date, datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import text_key, text_keys

LONG_MAX = 2**63 - 1
#: Access tiers from low to high, and the least tier of a domain.
TIERS = ("public", "authenticated", "authorized", "regulated")
FLOORS = {"medical": "regulated", "review": "authorized"}
SIMILARITY = ("duplicate_near", "same_domain")


def plain_key(text: str) -> str:
    """text_key of a parameter."""
    return "".join(unicodedata.normalize("NFKC", text).split()).casefold()


Row = dict[str, Column]


def _listed(given: object) -> list[str]:
    """The texts of a parameter that may be one text or several; what is blank or no text is nothing."""
    several = [given] if isinstance(given, str) else [x for x in given or [] if isinstance(x, str)]
    bare = pd.Series(several, dtype=object).str.strip()
    return bare[bare != ""].drop_duplicates().tolist() if several else []


def _extensions(given: object) -> list[str]:
    return sorted({plain_case(x).lstrip(".") for x in _listed(given)})


def plain_case(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def _instant(given: str | None) -> date | None:
    """The day that a date or a time names, as it is written: times are cut, not moved to another zone."""
    for text in _listed(given):
        return date.fromisoformat(text) if re.fullmatch(r".{10}", text) else datetime.fromisoformat(re.sub("Z$", "+00:00", text)).date()
    return None


def _ranges(given: Sequence[Sequence[int | None]] | None) -> list[tuple[float, float]]:
    """Half-open ranges with an infinite end for a missing one, in order."""
    out = set()
    for entry in given or ():
        pair = tuple(entry) if isinstance(entry, (list, tuple)) else ()
        known = [x for x in pair if x is not None]
        whole = all(isinstance(x, int) and not isinstance(x, bool) and 0 <= x <= LONG_MAX for x in known)
        low, high = (-math.inf if pair[0] is None else pair[0], math.inf if pair[1] is None else pair[1]) if len(pair) == 2 else (0, 0)
        if not known or not whole or low >= high:
            raise ValueError(f"a size range is two whole numbers from 0, the low one first, or one of them and None: {entry!r}")
        out.add((low, high))
    return sorted(out)


def _any(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests)


def _sized(size: Column, ranges: list[tuple[float, float]]) -> Column:
    end = lambda x, test: F.lit(True) if math.isinf(x) else test(x)
    return _any([end(lo, lambda v: size >= v) & end(hi, lambda v: size < v) for lo, hi in ranges])


#: Each parameter: the column it looks at, how its value is read, and the test of a row; nothing read is no condition.
FIELDS: dict[str, tuple[str, Callable, Callable[[Column, list], Column]]] = {
    "file_ext": ("file_ext", _extensions, lambda c, v: c.isin(v)),
    "created_from": ("created", _instant, lambda c, v: F.to_date(c) >= F.lit(v)),
    "created_to": ("created", _instant, lambda c, v: F.to_date(c) <= F.lit(v)),
    "topic": ("topics", _listed, lambda c, v: F.arrays_overlap(c, F.array(*map(F.lit, v)))),
    "subtopic": ("subtopics", _listed, lambda c, v: F.arrays_overlap(c, F.array(*map(F.lit, v)))),
    "modality": ("modality", _listed, lambda c, v: c.isin(v)),
    "tag": ("tags", _listed, lambda c, v: F.arrays_overlap(text_keys(c), F.array(*[F.lit(plain_key(x)) for x in v]))),
    "file_size_ranges": ("file_size", _ranges, _sized),
}


class SearchFilters:
    """Conditions by parameter: all of them hold, each by any of its values."""

    def __init__(self, values: dict[str, list]) -> None:
        self.values = values

    def bounds(self) -> tuple[str | None, str | None]:
        """The days that apply."""
        first, last = (self.values.get(k) for k in ("created_from", "created_to"))
        return first and first.isoformat(), last and last.isoformat()

    def condition(self, columns: Row) -> Column:
        """The rows that pass; columns: file_ext, created, topics, subtopics, tags (arrays), modality, file_size."""
        return reduce(Column.__and__, [FIELDS[k][2](columns[FIELDS[k][0]], v) for k, v in self.values.items()], F.lit(True))


def parse_filters(**given) -> SearchFilters | None:
    """Filters from request parameters, those of FIELDS; None where none is given, ValueError for a bad one."""
    unknown = set(given) - set(FIELDS)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    read = {k: FIELDS[k][1](v) for k, v in given.items()}
    found = {k: v for k, v in read.items() if v}
    return SearchFilters(found) if found else None


def narrowed(query: str | None, fields: Sequence[Column]) -> Column:
    """Rows where every word of the query is inside some field, by text keys; all rows for a blank query."""
    wanted = [k for k in map(plain_key, (query or "").split()) if k]
    keep = F.lit(True)
    keys = [F.coalesce(text_key(f.cast("string")), F.lit("")) for f in fields]
    for word in wanted:
        some = F.lit(False)
        for k in keys:
            some = some | k.contains(word)
        keep = keep & some
    return keep


def persistable(kind: Column, confidence: Column, least: float) -> Column:
    """Kinds by similarity need the confidence; others always pass."""
    return ~kind.isin(*SIMILARITY) | F.lit(least <= 0) | (F.coalesce(confidence, F.lit(0.0)) >= least)


def exposure(status: Column, kind: Column, confidence: Column, least: float) -> Column:
    """strong, weak, or null for edges that aren't shown."""
    state = F.lower(F.trim(status))
    return F.when(state == "active", "strong").when((state == "proposed") & persistable(F.lower(F.trim(kind)), confidence, least), "weak")


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "strong", 0).when(tier == "weak", 1).otherwise(2)


def decided(kind: Column, confidence: Column, similarity: Column, *, least: float, least_similarity: float = 0.0, never: Sequence[str] = ()) -> Column:
    """active where kind, confidence and similarity allow it without review, else proposed."""
    ok = (F.coalesce(confidence, F.lit(0.0)) >= least) & ~F.coalesce(kind.isin(*never), F.lit(False))
    if least_similarity > 0:
        ok = ok & (F.coalesce(similarity, F.lit(0.0)) >= least_similarity)
    return F.when(ok, "active").otherwise("proposed")


def kind_code(raw: Column, reserved: Sequence[str] = ()) -> Column:
    """A proposed kind's code, null if it is malformed or reserved."""
    code = F.lower(F.trim(raw))
    return F.when(code.rlike(r"^[a-z][a-z0-9_]{0,99}$") & ~code.isin(*reserved), code)


def clamped(confidence: Column) -> Column:
    """Confidence within 0 and 1; 0 for what is no finite number."""
    x = confidence.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def visible(meta: Column, tiers: dict[str, str], domain: Column, clearance: str) -> Column:
    """The entries of a map that a clearance may see; unregistered keys pass, a null map is empty."""
    rank = {t: i for i, t in enumerate(TIERS)}
    floor = F.lit(0)
    for name, tier in FLOORS.items():
        floor = F.when(domain == name, rank[tier]).otherwise(floor)

    def allowed(key: Column, _value: Column) -> Column:
        need = F.lit(None).cast("int")
        for name, tier in tiers.items():
            need = F.when(key == name, rank[tier]).otherwise(need)
        return need.isNull() | (F.greatest(need, floor) <= rank[clearance])

    return F.map_filter(F.coalesce(meta, F.create_map().cast("map<string,string>")), allowed)
