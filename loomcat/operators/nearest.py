"""The nearest vectors under the same parent, by blocks of labels against blocks of registered ones."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a block at most, and numbers in its vectors that it is made for.
BLOCK, NUMBERS = 4096, 1 << 20


def _best(k: int):
    """The k best pairs of every label in a pair of blocks (asked and have, this one by topic_ko).

    Cosines are first told from unit vectors; those that may be among the best are then summed
    in order, as functions.scalars.cosine does, so that ties are the same. All is local to
    run(), which executors get by value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def vectors(block):
            """Rows and matrix of the vectors of each length."""
            column = block.field("vector")
            sizes, flat = pc.list_value_length(column).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            return {int(d): (np.flatnonzero(sizes == d), flat[starts[sizes == d][:, None] + np.arange(d)]) for d in np.unique(sizes)}

        def norms(x):
            total = np.zeros(len(x))
            for i in range(x.shape[1]):
                total = total + x[:, i] * x[:, i]
            return np.sqrt(total)

        def of_size(one, two):
            """Positions and cosines of the best pairs of two matrices; two's rows are in order of their ties."""
            d, n, m = one.shape[1], norms(one), norms(two)
            odd_one, odd_two = ~((n > 1e-100) & (n < 1e100)), ~((m > 1e-100) & (m < 1e100))
            unit_one, unit_two = (np.where(odd[:, None], 0.0, x) / np.where(odd, 1.0, size)[:, None] for x, size, odd in ((one, n, odd_one), (two, m, odd_two)))
            slack = (4 * d + 32) * 2.0**-52
            step = max(1, (1 << 19) // len(two))
            for at in range(0, len(one), step):
                some = unit_one[at : at + step]
                if d > 8:
                    told = some @ unit_two.T
                else:
                    told = some[:, :1] * unit_two[:, 0]
                    for i in range(1, d):
                        told += some[:, i : i + 1] * unit_two[:, i]
                told[:, odd_two] = -np.inf
                least = np.partition(told, len(two) - k, axis=1)[:, len(two) - k] if len(two) > k else np.full(len(some), -np.inf)
                may = told >= (least - slack)[:, None]
                may[:, odd_two] = True
                may[odd_one[at : at + step]] = True
                i, j = np.nonzero(may)
                i = i + at
                total = np.zeros(len(i))
                for c in range(d):
                    total = total + one[i, c] * two[j, c]
                size = n[i] * m[j]
                valid = (size > 0) | np.isnan(size)
                i, j, value = i[valid], j[valid], total[valid] / size[valid]
                order = np.lexsort((j, -value, ~np.isnan(value), i))
                i, j, value = i[order], j[order], value[order]
                first = np.searchsorted(i, i)
                top = np.arange(len(i)) - first < k
                yield i[top], j[top], value[top]

        for batch in batches:
            for row in range(batch.num_rows):
                asked, have = batch.column("asked")[row].values, batch.column("have")[row].values
                left, right = vectors(asked), vectors(have)
                for d in left.keys() & right.keys():
                    with np.errstate(all="ignore"):
                        for i, j, value in of_size(left[d][1], right[d][1]):
                            own = [batch.column("parent").take(pa.array(np.full(len(i), row))), asked.field("raw").take(pa.array(left[d][0][i])), have.field("topic_ko").take(pa.array(right[d][0][j]))]
                            yield pa.RecordBatch.from_arrays([*own, pa.array(value)], ["parent", "raw", "topic_ko", "cosine"])

    return run


def _blocks(rows: DataFrame, name: str, column: str) -> DataFrame:
    """parent and blocks of its rows with a vector: arrays of (name, vector), sorted."""
    full = rows.where("vector is not null and size(vector) > 0").where(~F.exists("vector", lambda x: x.isNull()))
    full = full.select("parent", name, F.col("vector").cast("array<double>").alias("vector"))
    most, size = full.groupBy("parent").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).agg(F.max("n"), F.max("d")).first()
    if not most:
        dealt = F.lit(0).cast("long")
    else:
        dealt = F.monotonically_increasing_id() % math.ceil(most / max(1, min(BLOCK, NUMBERS // size)))
    return full.withColumn("_block", dealt).groupBy("parent", "_block").agg(F.array_sort(F.collect_list(F.struct(name, "vector"))).alias(column)).drop("_block")


def nearest_topics(labels: DataFrame, registry: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest registered labels under the same parent: labels (parent, raw, vector) against registry (parent, topic_ko, vector); ties by label.

    Every pair under a parent is compared, but is no row: a row is a pair of blocks, dealt
    over all tasks however many labels a parent has, and gives the k best of each label.
    """
    kind = {f.name: f.dataType.simpleString() for f in [*registry.schema.fields, *labels.schema.fields]}
    asked, have = _blocks(labels, "raw", "asked"), _blocks(registry, "topic_ko", "have").withColumnRenamed("parent", "_parent")
    pairs = asked.join(have, F.col("parent").eqNullSafe(F.col("_parent"))).select("parent", "asked", "have")
    pairs = pairs.repartition(int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = pairs.mapInArrow(_best(k), f"parent {kind['parent']}, raw {kind['raw']}, topic_ko {kind['topic_ko']}, cosine double")
    rank = F.row_number().over(W.partitionBy("parent", "raw").orderBy(F.desc("cosine"), "topic_ko"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)
