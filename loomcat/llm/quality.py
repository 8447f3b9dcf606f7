"""Quality rules: word and line counts, then robust outliers per language and source.

Each document gives a vector of four transformed statistics. Per (lang, source) a
minimum-covariance-determinant estimate is reached by concentration steps: mean and
covariance of the half of the documents nearest to the last estimate. Steps run from
three starts side by side (medians with least scales, medians with quartile ranges, mean
and covariance of all) until each group's determinant has settled, and of each group's
estimates the one with the least determinant stays. A group's covariance is
drawn to its language's by PRIOR documents and has a least scale in each direction, so
small or constant groups need no rule of their own. A document is rejected when its squared
Mahalanobis distance passes the chi-square bound.

Only DataFrame functions run. The half is found on counts of distances by buckets, at most
some thousand a group; estimates are joined to the rows, sent to all tasks if they
are few (counted) or else copied so that no group is one task's. One number a step
reaches the driver.

Cases: a null text has no words; a null language or source is a group of its own; equal
documents get equal verdicts, and so do rows with one id or none; an empty table gives no
rows; other columns are ignored. Words in repeated windows are found by 64-bit
fingerprints of the windows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _shared as S

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Concentration steps at most.
STEPS = 8
#: A group has settled when the logarithm of its root's determinant moves by less: the half found by buckets may swing by a few rows.
SETTLED = 0.01
STARTS = range(3)
#: Buckets of distances for each doubling.
FINE = 256
#: Share of a group that an estimate rests on.
SUPPORT = 0.5
#: Covariance of the nearest half against that of all rows, for a normal vector of four: 1 / P(chi2_6 <= median of chi2_4).
CONSISTENCY = 3.03
PRIOR = 50.0
#: Least standard deviation of word length, symbols, repeated lines, repeated words, each as transformed.
FLOOR = (0.08, 0.06, 0.2, 0.2)
#: Chi-square bound with four degrees of freedom: 1 in 1000 normal vectors lies beyond.
BOUND = 18.47
P = range(4)
PAIRS = [(i, j) for i in P for j in range(i + 1)]


def statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, the columns to keep, the counts and base_failed of every row of docs (doc_id, text, lang, source)."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: S.trimmed(x) != "")
    n = F.col("n_words")
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(3)) - 2), lambda i: F.xxhash64(F.get("_words", i - 1), F.get("_words", i), F.get("_words", i + 1))))
    ranked = F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    again = F.filter(
        F.transform("_ranked", lambda r, k: F.when((F.get("_ranked", k - 1)["x"] == r["x"]) | (F.get("_ranked", k + 1)["x"] == r["x"]), r["i"])),
        lambda i: i.isNotNull(),
    )
    cover = F.aggregate(F.transform("_again", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_again", k + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    repeated = F.size("_windows") > F.size(F.array_distinct("_windows"))
    out = (
        docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), *keep, S.text_of().alias("_text"))
        .select("doc_id", "lang", "source", *keep, "_text", S.words(text).alias("_words"), lines.alias("_lines"))
        .withColumn("n_words", F.size("_words"))
        .withColumn("_windows", windows)
        .withColumn("_ranked", F.when(repeated, ranked))
        .withColumn("_again", F.array_sort(again))
        .select(
            "doc_id", "lang", "source", *keep, F.col("n_words").cast("long"),
            F.char_length(F.translate(text, S.BLANKS, "")).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"),
        )
    )
    return out.withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * n))


def vector() -> list[Column]:
    """Word length drawn to 5 by 100 words; shares of symbols, repeated lines and repeated words as square roots."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return [F.log((F.col("word_chars") + 500.0) / (F.col("n_words") + 100.0)), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]


KEYS = ["lkey", "skey"]
MEANS, COVARIANCES, ROOTS = [f"m{i}" for i in P], [f"c{i}{j}" for i, j in PAIRS], [f"l{i}{j}" for i, j in PAIRS]


def _moments(rows: DataFrame, within: list[Column]) -> DataFrame:
    """lkey, skey, k, n, means and covariances of the rows within each start's half (partial sums before the shuffle)."""
    names = ["n", *[f"s{i}" for i in P], *[f"q{i}{j}" for i, j in PAIRS]]
    values = [F.lit(1.0), *[F.col(f"x{i}") for i in P], *[F.col(f"x{i}") * F.col(f"x{j}") for i, j in PAIRS]]
    sums = rows.groupBy(*KEYS).agg(*[F.sum(F.when(own, v).otherwise(0.0)).alias(f"{c}_{k}") for k, own in enumerate(within) for c, v in zip(names, values, strict=True)])
    each = F.array(*[F.struct(F.lit(k).alias("k"), *[F.col(f"{c}_{k}").alias(c) for c in names]) for k in range(len(within))])
    flat = sums.select(*KEYS, F.explode(each).alias("e")).select(*KEYS, "e.*")
    mean = [F.col(f"s{i}") / F.col("n") for i in P]
    return flat.select(*KEYS, "k", "n", *[mean[i].alias(f"m{i}") for i in P], *[(F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j]).alias(f"c{i}{j}") for i, j in PAIRS])


def _root(groups: DataFrame) -> DataFrame:
    """Estimates with l_i_j, the Cholesky root of the group's covariance drawn to its language's, with least scales, and the determinant's logarithm."""
    # a language's moments from its groups' moments
    total = lambda c: F.sum(F.col("n") * c)
    second = [total(F.col(f"c{i}{j}") + F.col(f"m{i}") * F.col(f"m{j}")).alias(f"w_c{i}{j}") for i, j in PAIRS]
    wide = groups.groupBy("lkey", "k").agg(F.sum("n").alias("w_n"), *[total(F.col(c)).alias(f"w_{c}") for c in MEANS], *second)
    wide = wide.withColumns({f"w_{c}": F.col(f"w_{c}") / F.col("w_n") for c in MEANS + COVARIANCES})
    wide = wide.withColumns({f"w_c{i}{j}": F.col(f"w_c{i}{j}") - F.col(f"w_m{i}") * F.col(f"w_m{j}") for i, j in PAIRS})
    own = F.col("n") / (F.col("n") + PRIOR)
    both = groups.join(wide, ["lkey", "k"]).withColumns({c: own * F.col(c) + (1 - own) * F.col(f"w_{c}") for c in MEANS + COVARIANCES})
    cov = {(i, j): CONSISTENCY * F.col(f"c{i}{j}") + (FLOOR[i] ** 2 if i == j else 0.0) for i, j in PAIRS}
    for j in P:
        diagonal = cov[j, j]
        for k in range(j):
            diagonal = diagonal - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        both = both.withColumn(f"l{j}{j}", F.sqrt(F.greatest(diagonal, F.lit(FLOOR[j] ** 2))))
        for i in range(j + 1, len(FLOOR)):
            rest = cov[i, j]
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            both = both.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    return both.select(*KEYS, "k", *MEANS, *ROOTS, sum((F.log(f"l{i}{i}") for i in P), F.lit(0.0)).alias("size"))


def _squared(of: Callable[[str], Column]) -> Column:
    """Squared Mahalanobis distance of x0 to x3; of: the estimate's values by name."""
    z: list[Column] = []
    for i in P:
        rest = F.col(f"x{i}") - of(f"m{i}")
        for k in range(i):
            rest = rest - of(f"l{i}{k}") * z[k]
        z.append(rest / of(f"l{i}{i}"))
    return sum((x * x for x in z), F.lit(0.0))


def _starts(rows: DataFrame, scales: Sequence[float] = FLOOR) -> DataFrame:
    """The three first estimates of each group."""
    quarters = rows.groupBy(*KEYS).agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 10_000).alias(f"p{i}") for i in P])
    flat = lambda k, scale: quarters.select(*KEYS, F.lit(k).alias("k"), *[F.get(f"p{i}", F.lit(1)).alias(f"m{i}") for i in P], *[(scale(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS], F.lit(0.0).alias("size"))
    spread = lambda i: F.greatest((F.get(f"p{i}", F.lit(2)) - F.get(f"p{i}", F.lit(0))) / 1.349, F.lit(scales[i]))
    return flat(0, lambda i: F.lit(scales[i])).unionByName(flat(1, spread)).unionByName(_root(_moments(rows, [F.lit(True)])).withColumn("k", F.lit(2)))


def estimates(rows: DataFrame) -> tuple[DataFrame, int]:
    """Robust mean and covariance root for each (lkey, skey) of rows with x0 to x3, and their number."""
    now = S.stored(_starts(rows), "quality-starts")
    groups = now.where("k = 0").count()
    for _ in range(STEPS if groups else 0):
        known = now.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("k", *MEANS, *ROOTS))).alias("e"))
        bucket = lambda k: F.floor(F.log2(1 + _squared(lambda c: F.get("e", F.lit(k))[c])) * FINE).cast("int")
        near = S.keyed(rows, known, KEYS, groups).select(*KEYS, *[f"x{i}" for i in P], *[bucket(k).alias(f"b{k}") for k in STARTS])
        counts = near.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"b{k}").alias("b")) for k in STARTS])).alias("e")).groupBy(*KEYS, "e.k", "e.b").agg(F.count("*").alias("n"))
        part = W.partitionBy(*KEYS, "k")
        counts = counts.withColumns({"upto": F.sum("n").over(part.orderBy("b").rowsBetween(W.unboundedPreceding, 0)), "all": F.sum("n").over(part)})
        half = F.col("upto") >= SUPPORT * F.col("all")
        cuts = counts.groupBy(*KEYS).agg(*[F.min(F.when(half & (F.col("k") == k), F.col("b"))).alias(f"cut{k}") for k in STARTS])
        inside = S.keyed(near, S.stored(cuts, "quality-cuts"), KEYS, groups)
        before, now = now, S.stored(_root(_moments(inside, [F.col(f"b{k}") <= F.col(f"cut{k}") for k in STARTS])), "quality-roots")
        moved = now.join(before.select(*KEYS, "k", F.col("size").alias("was")), [*KEYS, "k"]).agg(F.max(F.abs(F.col("size") - F.col("was")))).first()[0]
        if moved < SETTLED:
            break
    best = now.groupBy(*KEYS).agg(F.min_by(F.struct(*MEANS, *ROOTS), F.struct(F.round("size", 6), "k")).alias("e"))
    return S.stored(best.select(*KEYS, "e"), "quality-best"), groups


def judge(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The statistics of every row of docs with distance (squared) and kept, and the columns to keep (other than the names used here)."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    rows = statistics(docs, keep).withColumns({f"x{i}": x for i, x in enumerate(vector())}).withColumns({"lkey": key("lang"), "skey": key("source")})
    rows = S.stored(rows, "quality")
    return _judged(rows)


def _judged(rows: DataFrame) -> DataFrame:
    # groups of documents that all fail the base rules have no estimate and need none
    base = rows.where(~F.col("base_failed"))
    best, groups = estimates(base.select(*KEYS, *[f"x{i}" for i in P]))
    distance = _squared(lambda c: F.col("e")[c])
    passed = S.keyed(base, best, KEYS, groups).withColumn("distance", distance).withColumn("kept", F.col("distance") <= BOUND).drop("e")
    failed = rows.where("base_failed").withColumns({"distance": F.lit(None).cast("double"), "kept": F.lit(False)})
    return passed.unionByName(failed).drop(*KEYS, *[f"x{i}" for i in P])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged."""
    return judge(S.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
