"""From scored rows to result buckets: word clauses, evidence, gate, cut, rescue, reranking, and pages."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.filters import plain_key
from ..functions.scalars import text_key
from . import search
from .evaluation import gate_signal

#: What a match in a clause is worth, and the strong ones.
WEIGHTS = {"hit_keywords": 3.0, "hit_labels": 2.0, "hit_file_name": 1.5, "hit_summary": 0.7, "hit_cross_meta": 0.3}
STRONG = ("hit_keywords", "hit_labels", "hit_file_name")
#: Evidence that saves a row below the gate, by mode.
RESCUE = {"auto": 1.5, "keyword": 0.7}
#: The sorts of a file page; every one ends with the id.
SORTS = {"relevance": ("score", False), "name_asc": ("name", True), "name_desc": ("name", False), "created_asc": ("created_at", True), "created_desc": ("created_at", False), "updated_asc": ("updated_at", True), "updated_desc": ("updated_at", False), "size_asc": ("file_size", True), "size_desc": ("file_size", False)}
RANK_DEPTH, SORT_DEPTH, TOTAL_CAP = 1000, 10_000, 10_000


@dataclass(frozen=True)
class Tuning:
    """The knobs of a search."""

    cutoff: bool = True
    eps: float = 0.18
    floor: float = 0.35
    result_floor: float = 0.20
    operator: str = "and"
    rescue: bool = True
    about: bool = False
    rerank: int = 0
    tau: float = 0.0
    mode: str = "auto"

    def __post_init__(self) -> None:
        if self.mode not in RESCUE or self.operator not in ("and", "or"):
            raise ValueError(f"unknown mode or operator: {self.mode!r}, {self.operator!r}")


def query_words(query: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return re.findall(r"[^\W_]+", (query or "").lower())


def has_semantics(query: str | None) -> bool:
    """Whether the semantic branch applies: the query has a letter or a digit."""
    return any(c.isalnum() for c in query or "")


def _words_in(words: Sequence[str], have: Column, operator: str) -> Column:
    want = F.array(*map(F.lit, words)).cast("array<string>")
    return F.size(F.array_except(want, have)) == 0 if operator == "and" else F.arrays_overlap(want, have)


def word_clauses(query: str, *, keywords: Column, labels: Column, file_name: Column, summary: Column, operator: str = "or") -> Column:
    """Names of the clauses that match: each field by its words, labels as a whole, and summary and keywords together."""
    words = query_words(query)
    if not words:
        return F.array().cast("array<string>")
    of = search.tokens
    key, text = F.coalesce(F.flatten(F.transform(keywords, of)), F.array().cast("array<string>")), of(summary)
    whole = F.coalesce(F.exists(labels, lambda x: F.lower(x) == F.lit(query.strip().casefold())), F.lit(False))
    tests = {
        "hit_keywords": _words_in(words, key, operator), "hit_labels": whole, "hit_file_name": _words_in(words, of(file_name), operator),
        "hit_summary": _words_in(words, text, operator), "hit_cross_meta": _words_in(words, F.concat(key, text), operator),
    }
    return F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))


def about_words(query: str, about: Column) -> Column:
    """Whether a word of the query is one of the values, exactly."""
    return F.coalesce(F.arrays_overlap(about, F.array(*map(F.lit, (query or "").split() or [""]))), F.lit(False))


def in_scope(query: str, clauses: Column, semantic: Column, about: Column, filters: Column) -> Column:
    """A blank query is all rows; otherwise words, meaning or subject, and the filters."""
    return filters if not (query or "").strip() else (F.size(clauses) > 0) | semantic | about_words(query, about)


def evidence(matched: Column, weights: dict[str, float] | None = None, only: Sequence[str] | None = None) -> Column:
    """Summed worth of the clauses; the joint one counts only without a strong one."""
    weights = WEIGHTS if weights is None else weights
    strong = F.exists(matched, lambda m: m.isin(*[n for n in STRONG if n in weights]))
    worth = lambda m: reduce(lambda rest, n: F.when(m == n, F.when(strong, 0.0).otherwise(weights[n]) if n == "hit_cross_meta" else weights[n]).otherwise(rest), only or weights, F.lit(0.0))
    return F.coalesce(F.aggregate(matched, F.lit(0.0), lambda s, m: s + worth(m)), F.lit(0.0))


def rescued(matched: Column, mode: str = "auto") -> Column:
    """Rows that words alone save; rows whose clauses were never observed stay."""
    return matched.isNull() | ((F.size(matched) > 0) & (evidence(matched) >= RESCUE[mode]))


def with_evidence(rows: DataFrame, query: str, *, bucket: Sequence[str], about: str, words: str, most: float = 0.5) -> DataFrame:
    """Rows that tell of the query: a word and a subject contain each other, or a word that at most this share of the bucket holds.

    A bucket that would lose all its rows keeps them.
    """
    nouns = (query or "").split()
    if not nouns:
        return rows
    long = [n for n in nouns if len(n) >= 2]
    text = F.coalesce(F.col(words), F.lit(""))
    touches = lambda a: reduce(Column.__or__, [(a == n) | (a.contains(n) if len(n) >= 2 else F.lit(False)) | ((F.char_length(a) >= 2) & F.lit(n).contains(a)) for n in nouns])
    counts = rows.groupBy(*bucket).agg(F.count("*").alias("_n"), *[F.count_if(text.contains(n)).alias(f"_n{i}") for i, n in enumerate(long)])
    usable = [text.contains(n) & (F.col(f"_n{i}") / F.col("_n") <= most) for i, n in enumerate(long)]
    kept = F.coalesce(F.exists(F.col(about), touches), F.lit(False))
    marked = rows.join(counts, list(bucket)).withColumn("_keep", reduce(Column.__or__, usable, kept))
    any_left = marked.groupBy(*bucket).agg(F.bool_or("_keep").alias("_any"))
    return marked.join(any_left, list(bucket)).where(F.col("_keep") | ~F.col("_any")).select(*rows.columns)


def reranked(rows: DataFrame, *, bucket: Sequence[str], key: str, similarity: str, score: str, most: int, tau: float = 0.0) -> DataFrame:
    """The first rows of each bucket in the order of a second score, holding their similarities in falling order; those below tau go. The rest follows."""
    rows = rows.withColumn("_place", F.row_number().over(W.partitionBy(*bucket).orderBy(F.desc(similarity), key)))
    head = rows.where(F.col("_place") <= most)
    head = head if tau <= 0 else head.where(F.col(score) >= tau)
    part = W.partitionBy(*bucket)
    own = head.withColumns({"_to": F.row_number().over(part.orderBy(F.desc(score), key)), "_from": F.row_number().over(part.orderBy(F.desc(similarity), key))})
    values = own.select(*bucket, F.col("_from").alias("_to"), F.col(similarity).alias("_similarity"))
    moved = own.join(values, [*bucket, "_to"]).withColumns({similarity: F.col("_similarity"), "_place": F.col("_to")})
    names = [*[c for c in rows.columns if c != "_place"], "_place"]
    both = moved.select(*names).unionByName(rows.where(F.col("_place") > most).select(*names))
    return both.withColumn("place", F.row_number().over(part.orderBy("_place"))).drop("_place")


def bucket_policy(fused: DataFrame, sample: DataFrame, *, bucket: Sequence[str], key: str, k: int, query: str = "", tuning: Tuning = Tuning()) -> DataFrame:
    """The rows of each bucket that are shown, with their place and why they stay.

    fused (bucket, key, fused, cosine, bm25, matched and, for reranking and subjects, score,
    about, words); sample (bucket, cosine) is what the gate looks at. A bucket that passes
    the gate loses rows without words below the result floor; one that doesn't keeps what its
    words save, if all words were asked for.
    """
    rows = fused
    if not tuning.cutoff:
        rows = rows.withColumn("reason", F.lit("gate_passed"))
    else:
        signal = gate_signal(sample, bucket, "cosine").select(*bucket, search.passes(F.col("top"), F.col("baseline"), eps=tuning.eps, floor=tuning.floor).alias("_passed"))
        rows = rows.join(signal, list(bucket), "left").withColumn("_passed", F.coalesce("_passed", F.lit(False)))
        cut = F.col("bm25") | (F.col("cosine") >= tuning.result_floor - search.EPS)
        saved = (F.col("bm25") & (rescued(F.col("matched"), tuning.mode) if tuning.rescue else F.lit(True))) if tuning.operator == "and" else F.lit(False)
        rows = rows.where(F.when(F.col("_passed"), cut).otherwise(saved)).withColumn("reason", F.when(F.col("_passed"), "gate_passed").otherwise("evidence")).drop("_passed")
    if tuning.rerank:
        rows = reranked(rows, bucket=bucket, key=key, similarity="fused", score="score", most=tuning.rerank, tau=tuning.tau)
    else:
        rows = rows.withColumn("place", F.row_number().over(W.partitionBy(*bucket).orderBy(F.desc("fused"), key)))
    if tuning.about:
        rows = with_evidence(rows, query, bucket=bucket, about="about", words="words")
    rank = F.row_number().over(W.partitionBy(*bucket).orderBy("place"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).drop("place")


def file_page(rows: DataFrame, sort: str, *, key: str, start: int = 0, size: int = 50) -> DataFrame:
    """A page by one of SORTS (missing values last), with the total; a page that starts beyond the depth is an error."""
    column, ascending = SORTS[sort]
    depth = RANK_DEPTH if sort == "relevance" else SORT_DEPTH
    if start < 0 or start + size > depth:
        raise ValueError(f"a page of {sort} ends by row {depth}")
    total = rows.agg(F.count("*").alias("total"))
    order = F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)
    page = rows.orderBy(order, key).offset(start).limit(size)
    return page.join(F.broadcast(total)).withColumn("total_capped", F.col("total") >= TOTAL_CAP)


def narrowed_entities(items: DataFrame, query: str) -> DataFrame:
    """Entities (name, keywords, description, members) that hold words of the query, most words first, with the reason and its word."""
    words = [w for w in (plain_key(x) for x in (query or "").split()) if w]
    name, text = (F.coalesce(text_key(F.col(c)), F.lit("")) for c in ("name", "description"))
    keys = F.array_join(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.lower(F.regexp_replace(k, r"\s+", ""))), "\n")
    found = [F.struct(F.lit(w).alias("word"), name.contains(w).alias("name"), keys.contains(w).alias("keyword"), text.contains(w).alias("text")) for w in words]
    if not found:
        return items.withColumns({"hits": F.lit(0), "reason": F.lit(None).cast("string"), "word": F.lit(None).cast("string")})
    rows = items.withColumn("_hit", F.filter(F.array(*found), lambda h: h["name"] | h["keyword"] | h["text"])).where(F.size("_hit") > 0)
    by_key = F.filter("_hit", lambda h: ~h["name"] & h["keyword"])
    named = F.exists("_hit", lambda h: h["name"])
    reason = F.when(named, "name").when(F.size(by_key) > 0, "keyword").otherwise("description")
    word = F.when(~named, F.coalesce(F.get(by_key, F.lit(0))["word"], F.get("_hit", F.lit(0))["word"]))
    return rows.withColumns({"hits": F.size("_hit"), "reason": reason, "word": word}).drop("_hit")


def fused_entities(items: DataFrame, by_text: DataFrame, by_meaning: DataFrame, key: Sequence[str], *, most: int | None = None) -> DataFrame:
    """Hits by text in their order (rank), then listed entities found by meaning only, by similarity: key, place, similarity (null for text)."""
    text = by_text.select(*key, F.lit(0).alias("_tier"), F.col("rank").cast("double").alias("_order"), F.lit(None).cast("double").alias("similarity"))
    more = by_meaning.join(by_text.select(*key), list(key), "left_anti").join(items.select(*key), list(key), "left_semi")
    more = more.select(*key, F.lit(1).alias("_tier"), (-F.col("similarity")).alias("_order"), F.col("similarity"))
    if most is not None:
        more = more.orderBy("_order", *key).limit(most)
    both = text.unionByName(more)
    return both.withColumn("place", F.row_number().over(W.orderBy("_tier", "_order", *key))).drop("_tier", "_order")


def gated_meaning(hits: DataFrame, *, eps: float = 0.15, n: int = 5) -> DataFrame:
    """The n most similar hits, if the best stands out of the lower half's mean by eps; else none."""
    signal = gate_signal(hits.withColumn("_b", F.lit(1)), ["_b"], "similarity").where(F.col("top") - F.col("baseline") >= eps - search.EPS).select("top")
    return hits.join(F.broadcast(signal)).drop("top").orderBy(F.desc("similarity"), *[c for c in hits.columns if c != "similarity"]).limit(n)


def labelled_facets(rows: DataFrame, unit: str, label: Column, key: Column, *, n: int, least: int = 1) -> DataFrame:
    """key, label (the most frequent trimmed original, ties by text), units, and whether more keys follow; by units, then label."""
    if n < 1 or least < 1:
        raise ValueError("a facet shows at least one key with at least one unit")
    own = rows.select(F.col(unit).alias("_u"), F.trim(label).alias("_l"), key.alias("key")).where(F.coalesce(F.col("key") != "", F.lit(False)))
    names = own.groupBy("key", "_l").agg(F.count("*").alias("_c")).groupBy("key").agg(F.min_by("_l", F.struct(-F.col("_c"), F.col("_l"))).alias("label"))
    counts = own.groupBy("key").agg(F.count_distinct("_u").alias("units")).where(F.col("units") >= least).join(names, "key")
    first = counts.orderBy(F.desc("units"), "label", "key").limit(n + 1)  # n + 1 rows
    place = F.row_number().over(W.orderBy(F.desc("units"), "label", "key"))
    return first.withColumns({"place": place, "has_more": F.count("*").over(W.partitionBy()) > n}).where(F.col("place") <= n).drop("place")


def spread_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Every total/n-th id of the sorted ids, n in all."""
    total = rows.count()
    if total <= n:
        return rows.select(key)
    number = rows.select(key).withColumn("_i", F.row_number().over(W.orderBy(key)) - 1)
    step = total / n
    at = F.floor(F.col("_i") / F.lit(step))
    hit = (F.floor(at * step) == F.col("_i")) | (F.floor((at + 1) * step) == F.col("_i"))
    return number.where(hit).orderBy("_i").limit(n).select(key)
