"""Incremental upkeep: a stream of changed rows merged into a keyed table, batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import VersionedTable


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def maintain(changes: DataFrame, table: VersionedTable, key: Sequence[str], newest: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Starts a query that upserts each batch's last change of every key.

    A batch that runs again after a failure writes the same rows, as the merge is by key.
    """

    def apply(batch: DataFrame, _number: int) -> None:
        if not batch.isEmpty():
            table.upsert(latest(batch, key, [F.desc(newest)]), key)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
