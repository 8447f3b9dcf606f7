"""Ranking and agreement measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranking(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """recall, precision, reciprocal rank and nDCG at k per query; ranked (query, rank, id), relevant (query, id)."""
    gold = relevant.select("query", "id").distinct()
    sizes = gold.groupBy("query").agg(F.count("*").alias("wanted"))
    hits = ranked.where(F.col("rank") <= k).join(gold, ["query", "id"], "left_semi")
    gain = 1 / F.log2(F.col("rank") + 1)
    found = hits.groupBy("query").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(gain).alias("dcg"))
    out = sizes.join(found, "query", "left").na.fill({"hits": 0, "dcg": 0.0})
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    return out.select("query", (F.col("hits") / F.col("wanted")).alias("recall"), (F.col("hits") / k).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.col("dcg") / ideal).alias("ndcg"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Low and high end of the score interval; (0, 1) without trials."""
    p, m = hits / n, 1 + z * z / n
    middle, half = (p + z * z / (2 * n)) / m, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / m
    return F.when(n <= 0, F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))).otherwise(F.struct(F.greatest(middle - half, F.lit(0.0)).alias("low"), F.least(middle + half, F.lit(1.0)).alias("high")))


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa of columns a and b; 0 without rows, 1 or 0 where chance explains all."""
    n = pairs.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"))
    side = lambda c: pairs.groupBy(F.col(c).alias("v")).agg(F.count("*").alias(f"n{c}"))
    chance = side("a").join(side("b"), "v").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("s"))
    pe = F.col("s") / (F.col("n") * F.col("n"))
    value = F.when(F.col("n") == 0, 0.0).when(pe >= 1, F.when(F.col("po") >= 1, 1.0).otherwise(0.0)).otherwise((F.col("po") - pe) / (1 - pe))
    return n.join(F.broadcast(chance)).select("n", value.alias("kappa"))


def pair_recall(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Undirected recall of pairs (a, b): hits, wanted, recall; 0.0 without gold."""
    flat = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    want = flat(gold)
    hits = want.join(flat(found), ["a", "b"], "left_semi").agg(F.count("*").alias("hits"))
    return want.agg(F.count("*").alias("wanted")).join(F.broadcast(hits)).select("hits", "wanted", F.when(F.col("wanted") > 0, F.col("hits") / F.col("wanted")).otherwise(0.0).alias("recall"))


def stratified(rows: DataFrame, cell: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each cell, by the smallest seeded hashes."""
    rank = F.row_number().over(W.partitionBy(cell).orderBy(F.xxhash64(F.lit(seed), key), key))
    return rows.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def list_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """query, first differing rank (null if equal) of two ranked lists (query, rank, id)."""
    both = left.select("query", "rank", F.col("id").alias("l")).join(right.select("query", "rank", F.col("id").alias("r")), ["query", "rank"], "full_outer")
    return both.groupBy("query").agg(F.min(F.when(~F.col("l").eqNullSafe(F.col("r")), F.col("rank"))).alias("first_difference"))


def gate_signal(rows: DataFrame, bucket: Sequence[str], cosine: str) -> DataFrame:
    """top and baseline (mean of the lower half; 0 for a single row) of each bucket."""
    x = F.when(F.col(cosine).isNull() | F.isnan(cosine), 0.0).otherwise(F.col(cosine))
    sorted_ = rows.select(*bucket, x.alias("_x")).withColumns({"_r": F.row_number().over(W.partitionBy(*bucket).orderBy("_x")), "_n": F.count("*").over(W.partitionBy(*bucket))})
    low = F.when(F.col("_r") <= F.floor(F.col("_n") / 2), F.col("_x"))
    return sorted_.groupBy(*bucket).agg(F.max("_x").alias("top"), F.coalesce(F.avg(low), F.lit(0.0)).alias("baseline"))


def relation_sweep(proposed: DataFrame, gold: DataFrame, isolated: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Per threshold: precision of edges, recall of pairs, kind accuracy and isolation accuracy.

    proposed (source, target, kind, confidence), gold (a, b, kind) as unordered pairs, isolated (asset_id).
    One pass over the edges counts for all thresholds; shares of nothing are 0.
    """
    pair = lambda x, y: [F.least(x, y).alias("_a"), F.greatest(x, y).alias("_b")]
    want = gold.groupBy(*pair("a", "b")).agg(F.max("kind").alias("_kind"))
    edges = proposed.select(*pair("source", "target"), "source", "kind", "confidence").join(want, ["_a", "_b"], "left")
    pairs = edges.where(F.col("_kind").isNotNull()).groupBy("_a", "_b").agg(F.max("confidence").alias("best"))
    alone = isolated.select(F.col("asset_id").alias("source")).distinct().join(proposed.groupBy("source").agg(F.max("confidence").alias("best")), "source", "left")
    at = lambda name, test: [F.count_if(test(t)).alias(f"{name}{i}") for i, t in enumerate(thresholds)]
    passed = lambda t: F.col("confidence") >= t
    one = edges.agg(*at("accepted", passed), *at("hits", lambda t: passed(t) & F.col("_kind").isNotNull()), *at("kinds", lambda t: passed(t) & (F.col("_kind") == F.col("kind"))))
    two = pairs.agg(*at("covered", lambda t: F.col("best") >= t)).join(F.broadcast(want.agg(F.count("*").alias("pairs"))))
    three = alone.agg(*at("clean", lambda t: F.col("best").isNull() | (F.col("best") < t)), F.count("*").alias("isolated"))
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    each = [
        F.struct(
            F.lit(float(t)).alias("threshold"), share(f"hits{i}", f"accepted{i}").alias("precision"), share(f"covered{i}", "pairs").alias("recall"),
            share(f"kinds{i}", f"hits{i}").alias("kind_accuracy"), share(f"clean{i}", "isolated").alias("isolation_accuracy"), F.col(f"accepted{i}").alias("accepted"),
        )
        for i, t in enumerate(thresholds)
    ]
    return one.join(F.broadcast(two)).join(F.broadcast(three)).select(F.explode(F.array(*each)).alias("x")).select("x.*")
