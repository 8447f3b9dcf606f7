"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters on document ids.

Cases: a null text is empty and holds the end id alone; documents with equal ids
stand next to each other, in the order of their texts' hashes, and may go on in the
next file, so that a frequent id is not one task's; a null id comes first;
an empty table gives files without rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S
from .tokens import BYTE_BPE, batches_of, encoder

END_ID = 2
#: Characters whose different chunks are looked up at once.
CHARS = 2_000_000
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
}
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def _encoded(name: str, path: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for a, b in batches_of(pc.utf8_length(texts).to_numpy(), CHARS):
                sizes, values = encoder(name, path).columns(texts.slice(a, b - a), end_id)
                ends = np.cumsum(sizes)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                columns = [ids.slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(start + ends - sizes), pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(values))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "part_start", "n_tokens", "ids"])
                start += int(ends[-1])

    return run


def write_token_files(docs: DataFrame, path: str, *, vocabulary: str = BYTE_BPE, vocabulary_path: str | None = None, end_id: int = END_ID) -> str:
    """Writes the ids of docs (doc_id, text) to ORC files at path, in ascending doc_id order over the files by name."""
    S.importable(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long"), S.text_of().alias("text"))
    order = ["doc_id", "hash", "nth"]  # rows alike in id and text are dealt by their place in the input
    rows = text.withColumns({"hash": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(_encoded(vocabulary, vocabulary_path, end_id), SCHEMA).write.options(**ORC_OPTIONS).orc(path)
    return path


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files with each document's start; doc_ids: only these, found by stripe statistics and Bloom filters."""
    files = spark.read.schema(SCHEMA).orc(path)
    # one number for each written file; their table is sent to all tasks only if it is small
    totals = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    begins, at = [], 0
    for part, n in totals:
        begins.append((part, at))
        at += n
    begin = spark.createDataFrame(begins, "part int, begin long")
    if doc_ids is not None:
        files = files.where(F.col("doc_id").isin(list(doc_ids)))
    return files.join(S.small(begin, len(begins)), "part").select("doc_id", (F.col("begin") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4").view(np.uint8), lists.offsets.to_numpy()
        data = memoryview(values)
        crc = pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("doc_id", "start", "n_tokens")] + [crc], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as ORC and read back."""
    path = write_token_files(S.table(spark, sf_dir, "documents"), S.work_folder(spark, "token-files"))
    return read_token_files(spark, path).mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
