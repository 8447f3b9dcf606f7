"""Connected components by alternating large and small stars.

Each round is two joins and grouped minima; the edge table is written to the shared
folder, so a round is never computed twice. Rounds grow with the logarithm of the graph.
The minima are stored too: with both sides of a join shuffled as they are, adaptive
execution can split the partition of a node with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of edges (a, b); loops count for nothing."""
    a, b = F.col("a"), F.col("b")
    now = S.stored(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select(a.alias("u"), b.alias("v")).union(now.select(b.alias("u"), a.alias("v")))
        least = S.stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = S.stored(large, "edges")
        least = S.stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        now = S.stored(small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    stars = now.select(a.alias("node"), b.alias("label"))
    return stars.union(stars.select(F.col("label").alias("node"), "label").distinct())
