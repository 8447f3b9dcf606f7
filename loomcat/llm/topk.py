"""Exact top-k inner products by a bit-sliced index.

Rows are dealt into blocks by a hash of their id. A block keeps its integer vectors and,
for each attribute, bitmaps of the bits of its values above the block's least value: the
slices. For a query the slices, complemented where the query's component is negative, are
added with bitmap arithmetic (carry-save adders over all bitmaps of one weight at a time),
each as often as the bits of that component say. The top rows are then selected from the
most significant slice of the sums downward. The lowest bits of the attributes are left out
of the sums; the rows that this could hide lie within a known distance of the boundary and
are resolved by their exact scores.

Rows with a component beyond LIMIT after scaling are kept apart in their block, and such
queries go past the slices; both are scored by Python's integers, whatever their size.

Blocks stay where they are, once for each of LANES tasks; the queries go to them in chunks
and pass through one after the other. A chunk and a block give at most k rows a query.

Cases: vectors that are null, or hold a null or a non-finite component, take no part; scores
that a long can't hold are ranked exactly and written as the nearest long; shorter vectors
count as ending in zeros, an empty one as all zeros; ties go to smaller ids; rows that share the
query's id are not its candidates, and equal rows (id and vector) of an index count each;
repeated query ids are asked once, with one of their vectors; rows without an id take no part;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _shared as S

SCALE, K, EVERY = 1024, 10, 100
#: Components up to this size after scaling go into slices; sums over any number of them below 2^19 fit a long.
LIMIT = float(1 << 22)
#: Rows of an index block (about; ids are dealt by hash), queries of a chunk, and tasks that share a block's queries.
BLOCK, CHUNK, LANES = 32_768, 64, 4
#: Lowest bits of the attributes that the sums leave out.
DROPPED = 2
BLOCKS = "block int, part binary, n int, dims int, wide binary, n_wide int, dims_wide int"
HITS = "query_id long, vec_id long, score long, sorted binary"
LONG = (1 << 63) - 1


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and q: floor(scale * x) of the vectors that take part; where a component is beyond LIMIT, q is null and x holds them all."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    finite = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    narrow = F.forall("_x", lambda v: F.abs(v) * scale < LIMIT)
    q = F.when(narrow, F.transform("_x", lambda v: F.floor(F.lit(scale) * v).cast("int")))
    own = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), x.alias("_x")).where(finite)
    return own.select("vec_id", q.alias("q"), F.when(~narrow, F.col("_x")).alias("x"))


def exact(x: np.ndarray, scale: int = SCALE) -> list[int]:
    """floor(scale * x) as Python integers."""
    return [math.floor(scale * v) if math.isfinite(scale * v) else scale * int(v) for v in x.tolist()]


def sortable(n: int) -> bytes:
    """Bytes in the order of the integers: sign and length, then the magnitude (its complement below zero)."""
    size = (abs(n).bit_length() + 7) // 8
    if n >= 0:
        return (0x8000 + size).to_bytes(2, "big") + n.to_bytes(size, "big")
    return (0x8000 - size).to_bytes(2, "big") + (256**size - 1 + n).to_bytes(size, "big")


def _matrix(lists: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), int(max(sizes, default=0))), kind)
    mask = np.arange(out.shape[1]) < sizes[:, None]
    out[mask] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _block(table: pa.Table) -> pa.Table:
    """One row with the block's ids and vectors."""
    narrow = pc.is_valid(table.column("q"))
    out = {"block": table.column("block").slice(0, 1).cast(pa.int32())}
    for own, column, kind, names in ((table.filter(narrow), "q", "<i4", ("part", "n", "dims")), (table.filter(pc.invert(narrow)), "x", "<f8", ("wide", "n_wide", "dims_wide"))):
        ids, data = own.column("vec_id").to_numpy().astype("<i8"), _matrix(own.column(column), kind)
        order = np.argsort(ids, kind="stable")
        values = (ids[order].tobytes() + data[order].tobytes(), len(ids), data.shape[1])
        out |= {k: pa.array([v], t) for k, v, t in zip(names, values, (pa.binary(), pa.int32(), pa.int32()), strict=True)}
    return pa.table(out)


class BitSlices:
    """Bitmaps of one block's attribute bits, rows along 64-bit words."""

    def __init__(self, data: np.ndarray, dropped: int = DROPPED) -> None:
        self.data, self.n, self.dropped = data, len(data), dropped
        self.low = data.min(axis=0) if self.n else np.zeros(data.shape[1], np.int64)
        above = (data - self.low) >> dropped
        self.bits = [int(x).bit_length() for x in above.max(axis=0)] if self.n else [0] * data.shape[1]
        self.words = -(-self.n // 64)
        self.slices = [[self._pack((above[:, d] >> b) & 1) for b in range(self.bits[d])] for d in range(data.shape[1])]
        self.all = self._pack(np.ones(self.n, np.uint8))

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        out[: len(packed)] = packed
        return out.view("<u8")

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Bitmaps, lowest first, of the rows' sums of |q| * attribute (or its complement, for q < 0)."""
        columns: dict[int, list[np.ndarray]] = {}
        for d, q in enumerate(query.tolist()):
            weight, size = abs(q), 0
            while weight >> size:
                if weight >> size & 1:
                    for b, x in enumerate(self.slices[d]):
                        columns.setdefault(size + b, []).append(~x if q < 0 else x)
                size += 1
        out, w = [], 0
        while w <= max(columns, default=-1):
            level = np.array(columns.pop(w, []), dtype="<u8").reshape(-1, self.words)
            while len(level) > 1:
                k = len(level) // 3
                if k == 0:  # two left
                    a, b = level
                    columns.setdefault(w + 1, []).append(a & b)
                    level = (a ^ b)[None]
                    continue
                a, b, c = level[:k], level[k : 2 * k], level[2 * k : 3 * k]
                half = a ^ b
                columns.setdefault(w + 1, []).extend((a & b) | (half & c))
                level = np.concatenate([half ^ c, level[3 * k :]])
            out.append(level[0] if len(level) else np.zeros(self.words, "<u8"))
            w += 1
        return out

    def at_least(self, slices: list[np.ndarray], live: np.ndarray, least: int) -> np.ndarray:
        """Rows of live whose sum is at least least."""
        if least <= 0:
            return live
        if least >> len(slices):
            return np.zeros_like(live)
        more, equal = np.zeros_like(live), live
        for w in range(len(slices) - 1, -1, -1):
            if least >> w & 1:
                equal = equal & slices[w]
            else:
                more, equal = more | (equal & slices[w]), equal & ~slices[w]
        return more | equal

    def kth(self, slices: list[np.ndarray], live: np.ndarray, k: int) -> int:
        """The k-th highest sum among live, from the most significant slice downward."""
        value, rest, equal = 0, k, live
        for w in range(len(slices) - 1, -1, -1):
            ones = equal & slices[w]
            n = int(np.bitwise_count(ones).sum())
            if n >= rest:
                equal, value = ones, value | 1 << w
            else:
                rest, equal = rest - n, equal & ~slices[w]
        return value

    def top(self, query: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of the k best, ties to smaller rows; skip: rows that are no candidates."""
        live = self.all
        if len(skip):
            bits = np.ones(self.n, np.uint8)
            bits[skip] = 0
            live = self._pack(bits)
        if int(np.bitwise_count(live).sum()) > k:
            slices = self.sums(query)
            # the dropped bits move a score by up to this, in units of the sums
            slack = int(np.abs(query).sum())
            live = self.at_least(slices, live, self.kth(slices, live, k) - slack)
        rows = self.rows(live)
        scores = self.data[rows] @ query
        order = np.lexsort((rows, -scores))[:k]
        return rows[order], scores[order]


class Block:
    """A block's slices, and its rows that are too wide for them."""

    def __init__(self, row: dict) -> None:
        ids = lambda part, n: np.frombuffer(part, "<i8", n)
        self.ids = ids(row["part"], row["n"])
        self.index = BitSlices(np.frombuffer(row["part"], "<i4", offset=8 * row["n"]).reshape(row["n"], row["dims"]).astype(np.int64))
        self.wide_ids = ids(row["wide"], row["n_wide"]).tolist()
        self.wide = [exact(x) for x in np.frombuffer(row["wide"], "<f8", offset=8 * row["n_wide"]).reshape(row["n_wide"], row["dims_wide"])]

    def top(self, query: dict, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows for a query (vec_id, q or x)."""
        own, vector = query["vec_id"], query["q"] if query["q"] is not None else exact(np.array(query["x"]))
        dims = self.index.data.shape[1]
        if query["q"] is not None:
            padded = np.zeros(dims, np.int64)
            padded[: len(vector[:dims])] = vector[:dims]
            skip = np.arange(np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right"))
            rows, scores = self.index.top(padded, k, skip)
            found = list(zip(scores.tolist(), self.ids[rows].tolist(), strict=True))
        else:
            padded = np.array([*vector[:dims], *[0] * (dims - len(vector))], object)
            scores = self.index.data.astype(object) @ padded if self.index.n else []
            found = [(s, i) for s, i in zip(scores, self.ids.tolist(), strict=True) if i != own]
        found += [(sum(a * b for a, b in zip(vector, row, strict=False)), i) for row, i in zip(self.wide, self.wide_ids, strict=True) if i != own]
        return heapq.nsmallest(k, found, key=lambda x: (-x[0], x[1]))


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, Block] | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["queries"] is None:
                    held = (row["block"], Block(row))
                elif held and held[0] == row["block"]:  # a number without rows has no block
                    out = [(q["vec_id"], own, max(-LONG - 1, min(LONG, score)), sortable(score)) for q in row["queries"] for score, own in held[1].top(q, k)]
                    if out:
                        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["query_id", "vec_id", "score", "sorted"])

    return run


def build_index(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Stored blocks of about so many rows of rows (vec_id, q, x)."""
    S.importable(rows.sparkSession)
    blocks = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return S.stored(dealt.groupBy("block").applyInArrow(_block, BLOCKS), "bit-slices")


def search(index: DataFrame, queries: DataFrame, *, k: int = K, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each of queries (vec_id, q, x)."""
    last = index.agg(F.max("block")).first()[0]
    once = queries.groupBy("vec_id").agg(F.min(F.struct("q", "x")).alias("v")).select("vec_id", "v.q", "v.x")
    chunks = max(1, -(-queries.count() // chunk))
    number = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)).cast("int")
    packed = S.stored(once.groupBy(number.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "q", "x"))).alias("queries")), "query-chunks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    asked = packed.withColumn("lane", F.pmod("chunk", F.lit(LANES))).withColumn("block", every(last or 0))
    lanes = index.withColumns({"lane": every(LANES - 1), "chunk": F.lit(-1)})
    both = lanes.unionByName(asked, allowMissingColumns=True).repartition("block", "lane").sortWithinPartitions("block", "lane", "chunk")
    hits = both.mapInArrow(_search(k), HITS)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sorted"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op6_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every hundredth of all embeddings."""
    rows = S.stored(quantised(S.table(spark, sf_dir, "embeddings")), "vectors")
    return search(build_index(rows), rows.where(F.col("vec_id") % EVERY == 0))


OP6_SQL = """
WITH part AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM part a JOIN part b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
