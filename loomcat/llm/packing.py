"""Best-fit packing by exact complements.

The plan needs only how many pieces there are of each length (at most the
capacity's number of lengths, whatever the corpus): singles, pairs and triples
whose sums exactly fill a gap are consumed under these counts, and best fit
places what is left. Pieces then look up their place by length and rank.

Cases: a null or empty text is one piece with the separator alone; documents with
equal ids are packed each; an empty table gives no sequences; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _shared as S
from .tokens import WORD_BPE, batches_of, encoder

CAPACITY = 2048
SEPARATOR = 0
#: Characters whose different chunks are looked up at once, and pieces handed to Spark at once.
CHARS, ROWS = 4_000_000, 500
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long, ids array<int>"


class ComplementIndex:
    """How many available singles, pairs and triples of distinct lengths have each sum.

    The sums are a filter: whether counts suffice (a length taken twice needs two
    pieces) is decided on the counts.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.counts, self.cap = counts, len(counts) - 1
        self.present = (counts > 0).astype(np.int64)
        self._sums()

    def _sums(self) -> None:
        self.pairs = np.convolve(self.present, self.present)[: self.cap + 1]
        self.triples = np.convolve(self.pairs, self.present)[: self.cap + 1]

    def take(self, lengths: dict[int, int], times: int) -> None:
        gone = False
        for x, k in lengths.items():
            self.counts[x] -= k * times
            if not self.counts[x]:
                self.present[x], gone = 0, True
        if gone:
            self._sums()

    def complement(self, gap: int, base: int) -> tuple[int, ...] | None:
        """The lengths, longest first, that fill the gap beside a piece of length base."""
        left = self.counts.copy()
        left[base] -= 1
        if gap == 0:
            return ()
        if left[gap] > 0:
            return (gap,)
        return self._pair(gap, left) or self._triple(gap, left)

    def _pair(self, gap: int, left: np.ndarray, most: int | None = None) -> tuple[int, ...] | None:
        if gap < 2 or not self.pairs[gap]:
            return None
        long = np.arange(min(gap - 1, most or gap), (gap - 1) // 2, -1)
        fits = (left[long] > 0) & (left[gap - long] > np.where(long * 2 == gap, 1, 0))
        return (int(long[i]), int(gap - long[i])) if fits.any() and (i := int(fits.argmax())) >= 0 else None

    def _triple(self, gap: int, left: np.ndarray) -> tuple[int, ...] | None:
        if gap < 3 or not self.triples[gap]:
            return None
        for a in range(gap - 2, (gap + 2) // 3 - 1, -1):
            if left[a] > 0 and self.pairs[gap - a]:
                left[a] -= 1
                rest = self._pair(gap - a, left, a)
                left[a] += 1
                if rest:
                    return (a, *rest)
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Segments (length, first rank, pieces, first sequence, offset): the i-th piece goes to the i-th sequence from there."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    used: dict[int, int] = defaultdict(int)
    out, sequences = [], 0

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        out.append((length, used[length], n, sequence, offset))
        used[length] += n

    index = ComplementIndex(have)
    for length in range(capacity, 0, -1):
        while have[length] and (rest := index.complement(capacity - length, length)) is not None:
            need: dict[int, int] = defaultdict(int)
            for x in (length, *rest):
                need[x] += 1
            times, offset = int(min(have[x] // k for x, k in need.items())), 0
            for x in (length, *rest):
                place(x, times, sequences, offset)
                offset += x
            sequences += times
            index.take(need, times)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, sequences)
    for length in range(capacity, 0, -1):
        n = int(have[length])
        while n:
            gap = next((g for g in range(length, capacity) if gaps.get(g)), None)
            if gap is not None:
                first, m = gaps[gap].pop()
                k = min(m, n)
                place(length, k, first, capacity - gap)
                if gap > length:
                    gaps[gap - length].append((first, k))
                if k < m:
                    gaps[gap].append((first + k, m - k))
                n -= k
                continue
            each = capacity // length
            for m, depth in ((n // each, each), (1, n % each)):
                if m and depth:
                    for i in range(depth):
                        place(length, m, sequences, i * length)
                    if capacity > depth * length:
                        gaps[capacity - depth * length].append((sequences, m))
                    sequences += m
            n = 0
    return out


def _pieces(name: str, path: str | None, capacity: int, separator: int):
    def of_batch(batch: pa.RecordBatch, part: int, seen: dict[int, int]) -> Iterator[pa.RecordBatch]:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for a, b in batches_of(pc.utf8_length(texts).to_numpy(), CHARS):
            sizes, values = encoder(name, path).columns(texts.slice(a, b - a), separator)
            count = -(-sizes // capacity)  # the separator makes it one at least
            doc, before = np.repeat(np.arange(a, b), count), np.cumsum(count) - count
            k = np.arange(len(doc)) - np.repeat(before, count)
            start = k * capacity
            n = np.minimum(np.repeat(sizes, count) - start, capacity)
            ends = np.cumsum(n)
            data = memoryview(values.astype("<i4", copy=False).view(np.uint8))
            crc = [zlib.crc32(data[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
            nth = []
            for m in n.tolist():
                nth.append(seen[m])
                seen[m] += 1
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
            parts = np.full(len(doc), part, np.int32)
            columns = [ids.take(pa.array(doc)), *map(pa.array, (k.astype(np.int32), start, n)), pa.array(crc, pa.int64()), pa.array(parts), pa.array(nth, pa.int64()), lists]
            out = pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PIECES.split(", ")])
            for i in range(0, len(doc), ROWS):
                yield out.slice(i, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            yield from of_batch(batch, part, seen)
            S.trim_worker()

    return run


def cut(docs: DataFrame, *, capacity: int = CAPACITY, vocabulary: str = WORD_BPE, vocabulary_path: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """docs (doc_id, text) as stored pieces of at most capacity ids, each document ended by the separator."""
    S.importable(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long"), S.text_of().alias("text"))
    return S.stored(text.mapInArrow(_pieces(vocabulary, vocabulary_path, capacity, separator), PIECES), "pieces")


def _placed(segments: list[tuple[int, int, int, int, int]]):
    by = defaultdict(list)
    for length, first, _, sequence, offset in segments:
        by[length].append((first, sequence, offset))
    look = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                own = length == n
                first, base, at = look[int(n)]
                i = np.searchsorted(first, rank[own], "right") - 1
                sequence[own], offset[own] = base[i] + rank[own] - first[i], at[i]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Each stored piece's sequence_id and offset, without its ids."""
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = S.stored(counts.select("length", "part", "n", F.coalesce(before, F.lit(0)).alias("before")), "piece-counts")
    totals = {r.length: r.n for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    ranked = pieces.drop("ids").join(offsets.drop("n"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.mapInArrow(_placed(plan(totals, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """The packed ids themselves: sequence_id, ids; a sequence gathers at most its capacity."""
    both = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "ids").join(packed, ["doc_id", "piece", "start", "length", "ids_crc32"])
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return both.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return pack(cut(S.table(spark, sf_dir, "documents")))
