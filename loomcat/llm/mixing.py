"""Mixing sources to target weights by capped water-filling.

Targets share the wanted size by weight; a source whose target passes its maximum
epochs is clamped and the excess goes to the others by weight, until none passes. The
water level, target per weight, only rises, so a round is one sum over the sources in
whole numbers; two numbers of it reach the driver. A document is then taken in whole
repeats, and once more if its seeded hash lies below its source's threshold, which is found
digit by digit so that the words taken come to within about one document of the target.

Sources may be as many as hosts: they stay in tables, with at most 256 sums a source for
each digit, and the rows that a digit leaves open are 256 times fewer each time.

Cases: a null source is a source of its own, last in order; a null text has size 0;
an empty table gives no rows; rows with one id are dealt by their texts, and equal rows by
their number among them; other columns, whatever their names, are kept by `repeated` and
ignored by `mix`.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _shared as S

SEED = 20_240_601
WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
EPOCHS = 2


def water_fill(sizes: list[int], weights: list[int], total: Fraction, epochs: int = EPOCHS) -> list[Fraction]:
    """Targets that sum to total (to all caps, if that is less), none above epochs times its size."""
    caps = [Fraction(epochs * s) for s in sizes]
    target = [Fraction(0)] * len(sizes)
    free, left = set(range(len(sizes))), total
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > caps[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = caps[i]
            left -= caps[i]
            free.discard(i)
    return target


def _sources(sized: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Stored skey, size and weight of each source; weights go round in code point order, null last."""
    order = [F.col("source").isNull(), F.col("source")]
    sums = sized.groupBy("skey", "source").agg(F.sum("size").alias("size")).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = S.stored(sums.withColumns({"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "sources")
    before, at = [], 0
    for r in sorted(dealt.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row for each task of the sort
        before.append((r.part, at))
        at += r.n
    first = sized.sparkSession.createDataFrame(before, "part int, before long")
    rank = F.pmod(F.col("before") + F.col("nth"), F.lit(len(weights))).cast("int")
    weight = F.get(F.array(*map(F.lit, weights)), rank).cast("long")
    return S.stored(dealt.join(S.small(first, len(before)), "part").select("skey", "size", weight.alias("weight")), "weighted")


def _level(sources: DataFrame, total: Fraction, epochs: int) -> Fraction | None:
    """Target per weight at which all targets sum to the total; None if all sources are clamped."""
    level, clamped = Fraction(0), -1
    while True:
        over = _over(level, epochs)
        r = sources.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("size") * epochs)).alias("caps"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        if not r.free:
            return None
        if r.n == clamped:
            return level
        level, clamped = (total - (r.caps or 0)) / r.free, r.n


def _share(level: Fraction) -> tuple[Column, Column]:
    """A source's target as a quotient of whole numbers: level times weight, and what it is to be divided by."""
    whole = lambda x, digits: F.lit(str(x)).cast(f"decimal({digits},0)")
    return F.col("weight").cast("decimal(10,0)") * whole(level.numerator, 27), whole(level.denominator, 17)


def _over(level: Fraction, epochs: int) -> Column:
    up, down = _share(level)
    return up > (F.col("size") * epochs).cast("decimal(20,0)") * down


def _thresholds(rows: DataFrame, need: DataFrame) -> DataFrame:
    """skey and the hash below which documents sum to about its need of words; rows (skey, size, hash), need (skey, need).

    A hash has 8 digits of 8 bits. Each pass sums the words by the next digit, among
    documents that share the threshold's digits so far: 256 rows a source at most.
    """
    state, found = need.select("skey", F.lit(0).cast("long").alias("low"), F.col("need").alias("left")), []
    for shift in range(56, -1, -8):
        state = S.stored(state, "thresholds")
        n = state.count()
        if not n:
            break
        prefix = lambda c: F.shiftright(c, shift + 8) if shift < 56 else F.lit(0).cast("long")  # noqa: B023, E731
        rows = S.stored(S.keyed(rows.withColumn("prefix", prefix("hash")), state.select("skey", prefix("low").alias("prefix")), ["skey", "prefix"], n).select("skey", "size", "hash"), "open-hashes")
        sums = rows.groupBy("skey", F.shiftright("hash", shift).alias("digits")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("words").over(W.partitionBy("skey").orderBy("digits").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        at = sums.withColumn("before", before).join(S.small(state, n), "skey")
        hit = (F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words"))
        low, left = F.shiftleft("digits", shift), F.col("left") - F.col("before")
        hits = S.stored(at.where(hit).select("skey", low.alias("low"), left.alias("left"), "words", "n"), "boundaries")
        last = (F.col("n") == 1) | F.lit(shift == 0)
        found.append(hits.where(last).select("skey", (F.col("low") + F.when(2 * F.col("left") >= F.col("words"), 1 << shift).otherwise(0)).alias("below")))
        # without a boundary all that is left is wanted
        found.append(state.join(hits, "skey", "left_anti").select("skey", (F.col("low") + F.lit((1 << shift + 8) if shift < 56 else 1 << 62)).alias("below")))
        state = hits.where(~last).select("skey", "low", "left")
    return reduce(DataFrame.unionByName, found) if found else need.select("skey", F.lit(0).cast("long").alias("below")).limit(0)


def _hashed(docs: DataFrame, seed: int) -> DataFrame:
    """row (all columns), skey, text and the seeded hash of id and text; of rows that share it, all but the first in each source get one with their number.

    The rows of such a group are numbered task by task, so that none holds them all.
    Rows that differ in neither id, source nor text are alike to the mix.
    """
    # 62 bits, so that a threshold above all hashes is a long too
    spread = lambda *c: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *c), 2)
    everything = F.struct(*S.columns(docs))
    rows = docs.select(everything.alias("row"), _source_key().alias("skey"), S.text_of().alias("text"), spread(F.col("doc_id").cast("long"), S.text_of()).alias("hash"))
    twice = S.stored(rows.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("hash"), "equal-hashes")
    n = twice.count()
    if not n:
        return rows
    once = rows.join(S.small(twice, n), "hash", "left_anti").select(*rows.columns)
    again = S.stored(rows.join(S.small(twice, n), "hash", "left_semi").select(*rows.columns, F.spark_partition_id().alias("part")), "equal-rows")
    own = ["hash", "skey", "part"]
    counts = again.groupBy(*own).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("hash", "skey").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = S.stored(counts.select(*own, before.alias("before")), "equal-counts")
    ordered = [F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    again = again.withColumn("nth", F.row_number().over(W.partitionBy(*own).orderBy(*ordered))).join(counts, own)
    number = F.col("before") + F.col("nth")
    return once.unionByName(again.select("row", "skey", "text", F.when(number > 1, spread("hash", number)).otherwise(F.col("hash")).alias("hash")))


def _source_key() -> Column:
    return F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))


def _sized(rows: DataFrame) -> DataFrame:
    size = F.size(S.words(F.col("text"))).cast("long")
    return S.stored(rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"), size.alias("size"), "hash", "skey"), "sizes")


def _plan(sized: DataFrame, weights: tuple[int, ...], share: Fraction, epochs: int) -> tuple[DataFrame, int]:
    """skey, source_size, target, whole repeats and the hash below which a document gets one more; and their number."""
    sources = _sources(sized, weights)
    words, n = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    level = _level(sources, share * words, epochs)
    if level is None:
        planned = sources.select("skey", "size", (F.col("size") * epochs).cast("double").alias("target"), F.lit(epochs).cast("long").alias("whole"), F.lit(0.0).alias("need"))
    else:
        (up, down), size = _share(level), F.col("size").cast("decimal(20,0)")
        over = _over(level, epochs)
        target = F.when(over, (F.col("size") * epochs).cast("double")).otherwise(up.cast("double") / down.cast("double"))
        whole = F.when(over, epochs).otherwise(sum((F.when(up >= size * e * down, 1).otherwise(0) for e in range(1, epochs + 1)), F.lit(0))).cast("long")
        need = F.when(over, 0.0).otherwise((up - size * F.col("whole").cast("decimal(4,0)") * down).cast("double") / down.cast("double"))
        planned = sources.select("skey", "size", "weight", target.alias("target"), whole.alias("whole")).withColumn("need", need)
    planned = S.stored(planned.select("skey", F.col("size").alias("source_size"), "target", "whole", "need"), "targets")
    below = _thresholds(sized.select("skey", "size", "hash"), planned.where((F.col("need") > 0) & (F.col("source_size") > 0) & (F.col("whole") < epochs)).select("skey", "need"))
    return S.stored(planned.drop("need").join(below, "skey", "left").na.fill(0, ["below"]), "mix-plan"), n


def _repeats(epochs: int) -> Column:
    return F.col("whole") + F.when((F.col("hash") < F.col("below")) & (F.col("whole") < epochs), 1).otherwise(0)


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats and taken of every row of docs (doc_id, text, source)."""
    sized = _sized(_hashed(docs.select("doc_id", "source", "text"), seed))
    out = S.keyed(sized, *_keyed(_plan(sized, weights, share, epochs))).withColumn("repeats", _repeats(epochs))
    return out.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """docs, each row as often as the mix takes it; texts are not shuffled, but for rows that share id and text."""
    rows = _hashed(docs, seed)
    out = S.keyed(rows.drop("text"), *_keyed(_plan(_sized(rows), weights, share, epochs))).withColumn("repeats", _repeats(epochs))
    copies = F.when(F.col("repeats") > 0, F.sequence(F.lit(1).cast("long"), F.col("repeats").cast("long")))
    return out.select("row", F.explode(copies)).select("row.*")


def _keyed(plan: tuple[DataFrame, int]) -> tuple[DataFrame, list[str], int]:
    return plan[0], ["skey"], plan[1]


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their size."""
    return mix(S.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
