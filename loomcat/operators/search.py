"""Lexical and vector retrieval: scoring, fusion, gates, scopes, facets and pages."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import cosine
from ..sources.shared import written

EPS = 1e-9


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _count(column: str, term: str) -> Column:
    return F.size(column) - F.size(F.array_remove(column, F.lit(term)))


def bm25(docs: DataFrame, key: str, text: Column, query: Sequence[str], *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and score of the documents that hold a query term, totals over all documents.

    One pass over the texts: the counts are written to the shared folder, a few numbers a document.
    """
    terms = list(dict.fromkeys(query))
    have = docs.select(F.col(key), tokens(text).alias("t")).withColumn("n", F.size("t"))
    counts = written(have.select(key, "n", *[_count("t", q).alias(f"f{i}") for i, q in enumerate(terms)]), "word-counts")
    totals = counts.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, d = F.col(f"f{i}"), F.col(f"d{i}")
        idf = F.log(1 + (F.col("docs") - d + 0.5) / (d + 0.5))
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    hit = F.lit(False)
    for i in range(len(terms)):
        hit = hit | (F.col(f"f{i}") > 0)
    return counts.where(hit).join(F.broadcast(totals)).select(key, score.alias("score"))  # totals: one row


def nearest(vectors: DataFrame, key: str, vector: str, query: Sequence[float], *, k: int) -> DataFrame:
    """key and cosine of the k nearest; vectors of length zero take no part; ties to smaller keys."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine(F.col(vector), q).alias("cosine")).where(F.col("cosine").isNotNull()).orderBy(F.desc("cosine"), key).limit(k)


def radial(rows: DataFrame, key: str, cosine: str, least: float, most: int) -> DataFrame:
    """key and score ((cosine + 1) / 2) of the rows with a cosine of at least `least`, the best `most` of them."""
    return rows.where(F.col(cosine) >= least).orderBy(F.desc(cosine), key).limit(most).select(key, ((F.col(cosine) + 1) / 2).alias("score"))


def min_max(df: DataFrame, score: str) -> DataFrame:
    """score scaled to 0..1 over all rows; 1 where all are equal."""
    span = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))  # one row
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return df.join(F.broadcast(span)).withColumn(score, scaled).drop("lo", "hi")


def fuse(lexical: DataFrame, semantic: DataFrame, key: str, *, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Weighted sum of scaled scores (key, score) and (key, cosine); what a branch lacks counts 0."""
    a = min_max(lexical, "score").withColumn("_bm25", F.lit(True))
    b = semantic.withColumn("similarity", F.col("cosine"))
    both = a.join(min_max(b, "similarity"), key, "full_outer")
    fused = weights[0] * F.coalesce("score", F.lit(0.0)) + weights[1] * F.coalesce("similarity", F.lit(0.0))
    return both.select(key, fused.alias("fused"), "cosine", F.coalesce("_bm25", F.lit(False)).alias("bm25"))


def passes(top: Column, baseline: Column, *, eps: float, floor: float) -> Column:
    """The gate of a bucket: its top stands out of the baseline and reaches the floor."""
    return (top - baseline >= eps - EPS) & (top >= floor - EPS)


def cut(rows: DataFrame, floor: float) -> DataFrame:
    """Rows with a lexical match, or a cosine of at least floor."""
    return rows.where(F.col("bm25") | (F.col("cosine") >= floor - EPS))


def facets(scope: DataFrame, axes: dict[str, Column], filters: dict[str, Column], unit: str, *, size: int = 24) -> DataFrame:
    """axis, key, n: distinct units per value, each axis without its own filter; (n desc, key) up to size.

    One pass: each row is counted on the axes whose other filters it meets.
    """
    others = lambda axis: reduce(lambda a, b: a & b, [F.coalesce(keep, F.lit(False)) for name, keep in filters.items() if name != axis], F.lit(True))
    each = F.array(*[F.when(others(axis), F.struct(F.lit(axis).alias("axis"), value.cast("string").alias("key"))) for axis, value in axes.items()])
    rows = scope.select(unit, F.explode(F.filter(each, lambda x: x["key"].isNotNull())).alias("x"))
    counts = rows.groupBy("x.axis", "x.key").agg(F.count_distinct(unit).alias("n"))
    rank = F.row_number().over(W.partitionBy("axis").orderBy(F.desc("n"), "key"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= size).drop("rank")


def after(order: Sequence[tuple[str, bool]], bookmark: Sequence) -> Column:
    """Rows behind the bookmark in the order of (column, ascending); columns without nulls."""
    if len(bookmark) != len(order):
        raise ValueError("the bookmark does not fit the order")
    out, equal = F.lit(False), F.lit(True)
    for (name, ascending), value in zip(order, bookmark, strict=True):
        c, v = F.col(name), F.lit(value)
        out, equal = out | (equal & ((c > v) if ascending else (c < v))), equal & (c == v)
    return out


def page(df: DataFrame, order: Sequence[tuple[str, bool]], limit: int, bookmark: Sequence | None = None) -> DataFrame:
    rows = df if bookmark is None else df.where(after(order, bookmark))
    return rows.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in order]).limit(limit)


def _scope(scope: object) -> str:
    return hashlib.sha256(json.dumps(scope, sort_keys=True, default=str).encode()).hexdigest()[:16]


def encode_cursor(order: Sequence, sort: str, scope: object) -> str:
    return base64.urlsafe_b64encode(json.dumps({"o": list(order), "s": sort, "f": _scope(scope)}).encode()).decode()


def decode_cursor(cursor: str, sort: str, scope: object, arity: int) -> list:
    """The bookmark of a cursor; an unfit one raises ValueError."""
    try:
        data = json.loads(base64.b64decode(cursor.encode(), altchars=b"-_", validate=True))
        values = data["o"]
    except Exception as e:
        raise ValueError("unreadable cursor") from e
    if data.get("s") != sort or data.get("f") != _scope(scope):
        raise ValueError("the cursor belongs to another query")
    if not isinstance(values, list) or len(values) != arity or any(isinstance(v, (list, dict)) for v in values):
        raise ValueError("the cursor has a wrong bookmark")
    return values
