"""SimHash near duplicates by a generalised pigeonhole.

The bits of a fingerprint are dealt into partitions, correlated bits together, and each
partition gets a threshold t of its own: none, 0 or 2. If the t + 1 sum to more than the
wanted distance, two fingerprints within that distance agree to within t bits in some
partition. Dynamic programming chooses partitions and thresholds for the least cost of
keys and expected candidates, estimated on a bounded sample. A fingerprint stands in
the bucket of its partition's value (t = 0) and of all values one bit away (t = 2: two
values within two bits of each other meet halfway). Pairs in a bucket are verified.

A bucket gives links that connect what its links connect, not all of them: small buckets
are compared pair by pair, and in larger ones rows near a pivot are linked to it, other
pairs being compared only between pivots' rows that are not yet connected.

Copies with one fingerprint are one row from the start. Components join what is linked.

Cases: a null or empty text has fingerprint zero; fewer words than a shingle form one;
equal rows share a fingerprint; a null id keeps its row, and its component's smallest id
is that of the others (null if there is none); an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S
from .components import components

SEED = 42
SHINGLE, BITS, DISTANCE = 4, 64, 4
#: Fingerprints that partitions and thresholds are estimated on.
SAMPLE = 4096
#: Seconds of a key (made, shuffled, sorted) and of a compared pair.
KEY_COST, PAIR_COST = 2e-6, 2e-8
#: Rows of a bucket up to which all pairs are compared.
SMALL = 32
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MASK = (1 << 64) - 1


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of the text's shingles, repeats included; `bytes.split` has the white space of the word rule."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another 64 bits of each hash; the first word is the hash itself."""
    if not salt:
        return h
    x = h + np.uint64(salt * 0x9E3779B97F4A7C15 & MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """The bits that are set in over half of the hashes, as words of 64 bits."""
    out = np.zeros(words, "<u8")
    for k in range(words if len(hashes) else 0):
        total = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 255):
            own = _mixed(hashes[i : i + 255], k).astype("<u8").view(np.uint8).reshape(-1, 8)
            total += np.unpackbits(own, axis=1, bitorder="little").sum(0, dtype=np.uint8)
        out[k] = np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t, shingle))[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, "<u8").view("<i8"))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, 64 bits in a long, of every row of docs (doc_id, text)."""
    S.importable(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long"), S.text_of().alias("text"))
    return S.stored(text.mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "fingerprints")


def bits_of(fps: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 for rows of 64-bit words."""
    return np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")


def grouped_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into parts of like size, each grown from a seed bit by the bit most correlated with it."""
    n = sample.shape[1]
    centred = sample - sample.mean(0)
    spread = np.sqrt(np.concatenate([(centred[:, k : k + 64] ** 2).sum(0) for k in range(0, n, 64)])) + 1e-9  # by blocks, for the driver's memory
    tie = np.abs(centred.T @ centred) / np.outer(spread, spread)
    free, out = list(range(n)), []
    for p in range(parts):
        size = n // parts + (p < n % parts)
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: (tie[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def _chance(sample: np.ndarray, group: list[int]) -> tuple[float, float]:
    """Share of pairs that agree in the group, and to within two bits; at least that of even bits."""
    w = len(group)
    even = np.array([1.0, 1.0 + w + w * (w - 1) / 2]) / 2.0**w
    if len(sample) < 2:
        return float(even[0]), float(even[1])
    own = sample[:, group]
    same, near = 0, 0
    half = len(own) // 2
    for shift in range(1, min(65, half + 1)):
        d = (own != np.roll(own, shift, axis=0)).sum(1)
        same, near = same + int((d == 0).sum()), near + int((d <= 2).sum())
    tried = len(own) * min(64, half) or 1
    return max(float(even[0]), same / tried), max(float(even[1]), near / tried)


def allocate(costs: list[tuple[float, float, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds -1 (none), 0 or 2 with sum of (t + 1) of at least total and least cost; costs: of each partition, by choice."""
    best: list[tuple[float, tuple[int, ...]]] = [(0.0, ())] + [(math.inf, ())] * total
    for cost in costs:
        new = [(math.inf, ())] * (total + 1)
        for have, (c, chosen) in enumerate(best):
            for t, x in zip((-1, 0, 2), cost, strict=True):
                at = min(total, have + t + 1)
                if c + x < new[at][0]:
                    new[at] = (c + x, (*chosen, t))
        best = new
    return best[total][0], list(best[total][1])


def plan(sample: np.ndarray, n: int, distance: int, sizes: range | list[int] | None = None) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions in use, for n fingerprints like the sample's."""
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for parts in sizes or range(2, distance + 2):
        groups = grouped_bits(sample, parts)
        costs = []
        for g in groups:
            same, near = _chance(sample, g)
            costs.append((0.0, n * KEY_COST + n * n / 2 * same * PAIR_COST, n * (len(g) + 1) * KEY_COST + n * n / 2 * (len(g) + 1) * near * PAIR_COST))
        cost, chosen = allocate(costs, distance + 1)
        if cost < best[0]:
            best = cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]
    return best[1]


def _keys(partitions: list[tuple[list[int], int]]):
    """Rows bucket, node, mark for rows node, mark and fp (words of 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.forget_tokens()
        for batch in batches:
            if not batch.num_rows:
                continue
            node, mark = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "mark"))
            data = batch.column("fp")
            words = data.to_numpy(zero_copy_only=False).reshape(-1, 1) if pa.types.is_integer(data.type) else np.frombuffer(b"".join(data.to_pylist()), "<u8").reshape(batch.num_rows, -1)
            bits = bits_of(words.view("<u8"))
            for i, (group, t) in enumerate(partitions):
                value = bits[:, group].astype(np.int64) @ (np.int64(1) << np.arange(len(group), dtype=np.int64))
                masks = [0] + ([1 << b for b in range(len(group))] if t == 2 else [])
                for m in masks:
                    bucket = (value ^ m) | (i << 40)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(node), pa.array(mark)], ["bucket", "node", "mark"])

    return run


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def spanning(marks: np.ndarray, distance: int, middle: bool = True) -> list[tuple[int, int]]:
    """Pairs of positions that connect whatever pairs within the distance connect."""
    n = len(marks)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    out: list[tuple[int, int]] = []
    left, stars = np.arange(n), []
    # the first pivot is the row nearest to the middle of all, or else the first row
    pivot = int(_differ(marks, np.packbits(bits_of(marks.reshape(-1, 1)).mean(0) > 0.5, bitorder="little").view("<u8")[0]).argmin()) if middle else 0
    while len(left):
        near = _differ(marks[left], marks[pivot]) <= distance
        own = left[near]
        out.extend((pivot, int(i)) for i in own if i != pivot)
        root[own] = pivot
        stars.append((pivot, own))
        left = left[~near]
        pivot = int(left[0]) if len(left) else -1
    pivots = np.array([p for p, _ in stars])
    size = np.array([len(o) for _, o in stars])
    for k in range(len(stars)):
        # rows of two stars can be near only if their pivots are within three distances; of lone rows, within one or two
        reach = distance * (1 + (size[k] > 1) + (size[k + 1 :] > 1))
        for j in np.flatnonzero(_differ(marks[pivots[k + 1 :]], marks[pivots[k]]) <= reach) + k + 1:
            if find(int(pivots[k])) == find(int(pivots[j])):
                continue
            a, b = stars[k][1], stars[j][1]
            if len(a) > len(b):
                a, b = b, a
            for i in a:
                hit = np.flatnonzero(_differ(marks[b], marks[i]) <= distance)
                if len(hit):
                    out.append((int(i), int(b[hit[0]])))
                    root[find(int(pivots[k]))] = find(int(pivots[j]))
                    break
    return out


def _pruned(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links i < j without those whose ends both link to j's first partner: the rest connect the same."""
    code = np.sort(i * n + j)
    least = np.full(n, n)
    np.minimum.at(least, j, i)
    want = least[j] * n + i
    at = np.minimum(np.searchsorted(code, want), len(code) - 1)
    keep = (least[j] == i) | (code[at] != want)
    return i[keep], j[keep]


def _bucket_links(bucket: np.ndarray, node: np.ndarray, mark: np.ndarray, distance: int, middle: bool) -> np.ndarray:
    """Rows (a, b) of linked nodes, rows being sorted by bucket and node."""
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.concatenate([first, [len(bucket)]]))
    found = []
    few = np.repeat((size > 1) & (size <= SMALL), size)
    rows = np.flatnonzero(few)
    for step in range(1, SMALL):
        rows = rows[rows + step < len(bucket)]
        rows = rows[bucket[rows + step] == bucket[rows]]
        if not len(rows):
            break
        hit = rows[_differ(mark[rows], mark[rows + step]) <= distance]
        found.append(np.stack([hit, hit + step], 1))
    if found:
        i, j = _pruned(*np.concatenate(found).T, len(bucket)) if sum(map(len, found)) else (rows[:0], rows[:0])
        found = [np.stack([node[i], node[j]], 1)]
    for a, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        own = node[a : a + n]
        pairs = np.array(spanning(mark[a : a + n], distance, middle), np.int64).reshape(-1, 2)
        found.append(own[pairs])
    out = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    out = out[out[:, 0] != out[:, 1]]
    return np.unique(np.sort(out, axis=1), axis=0)


def _links(distance: int, middle: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows since the start of the last bucket

        def emit(bucket: np.ndarray, node: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
            pairs = _bucket_links(bucket, node, mark.view("<u8"), distance, middle)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "node", "mark")]
            last = int(np.searchsorted(own[0], own[0][-1]))
            if held and (last or own[0][0] != held[-1][0][0]):
                joined = [np.concatenate(x) for x in zip(*held, [c[:last] for c in own], strict=True)]
                held = []
                yield emit(*joined)
            elif last:
                yield emit(*[c[:last] for c in own])
            held.append([c[last:] for c in own])
        if held:
            yield emit(*[np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def links(nodes: DataFrame, partitions: list[tuple[list[int], int]], distance: int, middle: bool = True) -> DataFrame:
    """a, b: pairs of nodes (node, mark, fp) within the distance by mark that connect what all such pairs connect in each bucket."""
    keys = nodes.mapInArrow(_keys(partitions), "bucket long, node long, mark long")
    return keys.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_links(distance, middle), "a long, b long")


def sampled(fps: DataFrame, order: str) -> np.ndarray:
    """Bits of at most SAMPLE fingerprints, those with the smallest hashes."""
    rows = fps.orderBy(F.xxhash64(order), order).limit(SAMPLE).collect()
    data = [int(r.fp) & MASK if isinstance(r.fp, int) else r.fp for r in rows]
    words = np.frombuffer(b"".join(data), "<u8").reshape(len(data), -1) if data and isinstance(data[0], (bytes, bytearray)) else np.array(data, np.uint64).reshape(-1, 1)
    return bits_of(words)


def groups(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id of rows doc_id, fp."""
    distinct = S.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    n = distinct.count()
    sample = sampled(distinct.select("fp"), "fp") if n else np.zeros((0, BITS))
    parts = plan(sample, n, distance)
    edges = S.stored(links(distinct.select(F.col("fp").alias("node"), F.col("fp").alias("mark"), "fp"), parts, distance).distinct(), "links")
    labels = S.stored(components(edges), "labels")
    own = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", F.coalesce("label", "fp").alias("label"), "least")
    least = own.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = own.join(least, "label").select("fp", "component_id")
    return prints.join(ids, "fp")


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints and components."""
    found = groups(fingerprints(S.table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Near duplicates by similarity: words of a shingle, similarity of shingle sets, words of a fingerprint, bits of a partition.
NEAR_SHINGLE, SIMILARITY, WORDS, WIDTH = 5, 0.8, 16, 16
#: Estimates this far from the wanted similarity (over four standard deviations) are trusted.
MARGIN = 0.12


def _wide_fingerprints(shingle: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.forget_tokens()
        for batch in batches:
            keys, sizes, fps = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = np.unique(shingle_hashes(text, shingle))
                line = b" ".join(text.encode("utf-8", "surrogatepass").translate(LOWER).split())
                keys.append(xxhash.xxh3_128_digest(line))
                sizes.append(len(hashes))
                fps.append(fingerprint(hashes, words).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(fps, pa.binary())], ["doc_id", "key", "size", "fp"])

    return run


def _estimates(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarities of shingle sets by their sizes n, m and the angle of their whole fingerprints x, y (rows of words)."""
    cosine = np.cos(np.pi * np.bitwise_count(x ^ y).sum(-1, dtype=np.int64) / (64.0 * x.shape[-1]))
    common = np.minimum(cosine * np.sqrt(n * m), np.minimum(n, m))
    return common / np.maximum(n + m - common, 1)


def _whole_buckets(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by their first, bucket, cut only between buckets."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        last = int(np.searchsorted(own[0], own[0][-1]))
        if held and (last or own[0][0] != held[-1][0][0]):
            yield [np.concatenate(x) for x in zip(*held, [c[:last] for c in own], strict=True)]
            held = []
        elif last:
            yield [c[:last] for c in own]
        held.append([c[last:] for c in own])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _runs(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows and sizes of the buckets."""
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return first, np.diff(np.concatenate([first, [len(bucket)]]))


def _steps(bucket: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the small buckets."""
    rows = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
    for step in range(1, SMALL):
        rows = rows[rows + step < len(bucket)]
        rows = rows[bucket[rows + step] == bucket[rows]]
        if not len(rows):
            return
        yield rows, rows + step


def _meeting(distance: int):
    """Rows bucket, node that have another of their bucket within the distance by mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.forget_tokens()
        for bucket, node, mark in _whole_buckets(batches, ("bucket", "node", "mark")):
            mark = mark.view("<u8")
            first, size = _runs(bucket)
            met = np.zeros(len(bucket), bool)
            for i, j in _steps(bucket, size):
                near = _differ(mark[i], mark[j]) <= distance
                met[i[near]] = met[j[near]] = True
            for a, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
                own, found = mark[a : a + n], met[a : a + n]
                for i in range(n):
                    if not found[i]:
                        near = _differ(own, own[i]) <= distance
                        if near.sum() > 1:
                            found |= near
            yield pa.RecordBatch.from_arrays([pa.array(bucket[met]), pa.array(node[met])], ["bucket", "node"])

    return run


#: Unsure similarities are taken by levels of this width, the highest first.
LEVEL = 0.08


class Family:
    """The rows of a bucket: node, whole fingerprint, number of shingles, component so far and partners already compared."""

    def __init__(self, node: np.ndarray, fps: np.ndarray, shingles: np.ndarray, label: np.ndarray, tried: list, least: float, sure: float) -> None:
        self.node, self.fps, self.shingles, self.label, self.tried, self.least, self.sure = node, fps, shingles, label, tried, least, sure

    def values(self, i: int, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of a row with others, and their levels: below 0 for no pair to compare, KNOWN for rows connected already."""
        value = _estimates(self.fps[i], self.shingles[i], self.fps[other], self.shingles[other])
        level = np.floor((value - self.least) / LEVEL).astype(np.int64)
        level[value >= self.sure] = KNOWN - 1
        if self.tried[i] is not None and len(self.tried[i]):
            level[np.isin(self.node[other], self.tried[i])] = -1
        level[self.label[other] == self.label[i]] = KNOWN
        return value, level

    def tree(self) -> list[tuple[int, int, float]]:
        """Pairs that connect whatever all pairs may connect, by the highest levels and smallest rows: a spanning forest, grown a row at a time."""
        out, at = [], 0
        left = np.arange(1, len(self.node))
        best, source, worth = np.full(len(left), -1, np.int64), np.zeros(len(left), np.int64), np.zeros(len(left))
        while len(left):
            value, level = self.values(at, left)
            better = level > best
            best[better], source[better], worth[better] = level[better], at, value[better]
            k = int(best.argmax())
            if 0 <= best[k] < KNOWN:
                out.append((int(source[k]), int(left[k]), float(worth[k])))
            at = int(left[k])
            left, best, source, worth = (np.delete(x, k) for x in (left, best, source, worth))
        return out

    def open(self, i: int) -> np.ndarray:
        """The rows after this one that it is to be compared with."""
        other = np.arange(i + 1, len(self.node))
        level = self.values(i, other)[1]
        return other[(level >= 0) & (level < KNOWN)]


#: Above all levels: two rows that are connected.
KNOWN = 1 << 20


WHOLE = ("bucket", "node", "size", "fp", "label", "tried")


def _families(bucket, node, shingles, fp, label, tried, *more, least: float, sure: float) -> Iterator[tuple[int, Family, slice]]:
    fps, shingles = np.frombuffer(b"".join(fp), "<u8").reshape(len(bucket), -1), shingles.astype(float)
    for a, n in zip(*(x.tolist() for x in _runs(bucket)), strict=True):
        own = slice(a, a + n)
        yield int(bucket[a]), Family(node[own], fps[own], shingles[own], label[own].copy(), tried[own], least, sure), own


def _proposed(least: float, sure: float):
    """Pairs a < b of each bucket's tree, by estimates from the whole fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_buckets(batches, WHOLE):
            out: list[tuple[int, int, int, float]] = []
            for bucket, family, _ in _families(*columns, least=least, sure=sure):
                for i, j, value in family.tree():
                    x, y = int(family.node[i]), int(family.node[j])
                    out.append((bucket, min(x, y), max(x, y), value))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["bucket", "a", "b", "value"])

    return run


def common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many values of a sorted set each of the other sets holds."""
    if not len(one):
        return np.zeros(len(others), np.int64)
    ends = np.cumsum([len(x) for x in others])
    every = np.concatenate(others)
    hits = np.concatenate([[0], np.cumsum(one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every)])
    return np.diff(hits[np.concatenate([[0], ends])])


#: Sets compared with one at a time.
TOGETHER = 256


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle).view(np.int64)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return run


def _exactly(similarity: float, shingle: int):
    """Pairs whose shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                one, two = (np.unique(shingle_hashes(t, shingle)) for t in (x, y))
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(common >= similarity * (len(one) + len(two) - common))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return run


def _texts(text: DataFrame, ids: DataFrame) -> DataFrame:
    """One text of each id."""
    ids = S.stored(ids.distinct(), "near-ids")
    return S.stored(text.join(S.small(ids, ids.count()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "near-texts")


def _compared(text: DataFrame, pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Those of the stored pairs (a, b) whose texts are similar enough."""
    texts = _texts(text, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return S.stored(both.select("a", "b", "ta", "tb").mapInArrow(_exactly(similarity, shingle), "a long, b long"), "near-true")


def _connected(text: DataFrame, whole: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """node and label of the components that the similar pairs of buckets make; whole: rows bucket, node, size, fp.

    A spanning tree of every bucket is proposed. Its sure pairs are links; of the others
    first each row's best is counted on the texts, then those that are still between two
    components. Where a tree's pair was no link, a bucket may hold links that no tree has:
    these are left to _completed, which finds all links between components.
    """
    least, sure = similarity - MARGIN, similarity + MARGIN
    dealt = lambda rows: rows.repartition("bucket").sortWithinPartitions("bucket", "node")
    trees = whole.select("*", F.col("node").alias("label"), F.lit(None).cast("array<bigint>").alias("tried"))
    found = S.stored(dealt(trees).mapInArrow(_proposed(least, sure), "bucket long, a long, b long, value double"), "near-proposed")
    links = S.stored(found.where(F.col("value") >= sure).select("a", "b").distinct(), "near-links")
    labels = S.stored(components(links), "near-labels")
    unsure = found.where(F.col("value") < sure)
    pairs = S.stored(unsure.groupBy("a", "b").agg(F.max("value").alias("value")), "near-unsure")
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    apart = lambda: pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b", "value")
    level = F.floor((F.col("value") - F.lit(least)) / LEVEL)
    ends = apart().select("a", "b", level.alias("level"), F.explode(F.array("a", "b")).alias("node"))
    best = ends.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("level", -F.col("a") - F.col("b"))).alias("p"))
    tried = S.stored(best.select("p.a", "p.b").distinct(), "near-open")
    for last in (False, True):
        fresh = S.stored(apart().select("a", "b").join(tried, ["a", "b"], "left_anti"), "near-open") if last else tried
        if fresh.isEmpty():
            continue
        links = S.stored(links.union(_compared(text, fresh, similarity, shingle)), "near-links")
        tried = S.stored(tried.union(fresh), "near-tried") if last else tried
        labels = S.stored(components(links), "near-labels")
    return labels


#: A shingle of more than so many texts of those that a task counts at once comes after others, the most frequent last; no more than LATE are held.
OFTEN, LATE = 4, 50_000
#: Shingles that a task counts at once.
COUNTED = 1 << 22
#: Bits that tell whether an even or odd number of shingles has that remainder: a power of two of at least twice the shingles, up to this.
PARITY = 1 << 15


def _frequent(shingle: int):
    """token and n of shingles that are frequent among the texts a task counts at once; only the order of shingles, hence time, rests on them."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(token[n > OFTEN].view(np.int64)), pa.array(n[n > OFTEN].astype(np.int64))], ["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.forget_tokens()
        held, total = [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.append(np.unique(shingle_hashes(text, shingle)))
                total += len(held[-1])
                if total >= COUNTED:
                    yield counted(held)
                    held, total = [], 0
        yield counted(held)

    return run


def parity(every: np.ndarray, width: int) -> np.ndarray:
    """Words of width bits that differ between two sets in no more bits than the sets in shingles."""
    return np.packbits((np.bincount((every & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(bool)).view("<u8")


def _width(size: int) -> int:
    return min(PARITY, 1 << max(6, (2 * size - 1).bit_length()))


def _first_shingles(similarity: float, shingle: int, late: np.ndarray, rank: np.ndarray):
    """node, size and the first shingles in one order of all (by hash, the sorted late ones last by rank): texts as similar as that share one of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.forget_tokens()
        for batch in batches:
            sizes, first, bits = [], [], []
            for text in batch.column("text").to_pylist():
                every = np.unique(shingle_hashes(text, shingle))
                n = len(every)
                at = np.minimum(np.searchsorted(late, every), max(len(late) - 1, 0))
                behind = late[at] == every if len(late) else np.zeros(n, bool)
                least = math.ceil(similarity * n - 1e-9)
                sizes.append(n)
                bits.append(parity(every, _width(n)).tobytes())
                first.append(np.concatenate([every[~behind], every[behind][np.argsort(rank[at[behind]])]])[: n - least + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["node", "size", "tokens", "parity"])

    return run


def _sharing(similarity: float):
    """met and node: rows that share a first shingle with a row of another component, unless places or sizes rule the similarity out.

    met is a hash of the nodes so found for one shingle: shingles that the same nodes share give these nodes once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.forget_tokens()
        seen: set[int] = set()
        for token, node, label, place in _whole_buckets(batches, ("token", "node", "label", "place")):
            size = place >> 32
            left = size - (place & 0xFFFFFFFF)  # shingles from this one on

            def may(i, j):
                need = similarity / (1 + similarity) * (size[i] + size[j]) - 1e-6
                return (label[i] != label[j]) & (np.minimum(left[i], left[j]) >= need)

            first, count = _runs(token)
            met = np.zeros(len(token), bool)
            for i, j in _steps(token, count):
                ok = may(i, j)
                met[i[ok]] = met[j[ok]] = True
            for a, n in zip(first[count > SMALL].tolist(), count[count > SMALL].tolist(), strict=True):
                every = np.arange(a, a + n)
                if (label[every] == label[a]).all():
                    continue
                for i in range(a, a + n):
                    if not met[i]:
                        j = every[may(i, every)]
                        met[j] = True
                        met[i] = len(j) > 0
            rows = np.flatnonzero(met)
            if not len(rows):
                continue
            begin, n = _runs(token[rows])
            name = np.add.reduceat(_mixed(node[rows].view(np.uint64), 1), begin).view(np.int64)
            fresh = np.zeros(len(begin), bool)
            for k, x in enumerate(name.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh[k] = True
            keep = np.repeat(fresh, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, n)[keep]), pa.array(node[rows][keep])], ["met", "node"])

    return run


def _may(similarity: float, n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles with parities x and y can be similar enough: they differ in at least as many shingles as in bits."""
    return n + m - np.bitwise_count(x ^ y).sum(-1, dtype=np.int64) >= 2 * (similarity / (1 + similarity) * (n + m) - 1e-6)


def _spanned(similarity: float):
    """Pairs a, b that connect all pairs of rows of a meeting, of different components, that sizes and parities leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met, node, label, size, bits in _whole_buckets(batches, ("met", "node", "label", "size", "parity")):
            out: list[tuple[int, int]] = []
            for a, count in zip(*(x.tolist() for x in _runs(met)), strict=True):
                if (label[a : a + count] == label[a]).all():
                    continue
                order = a + np.argsort(size[a : a + count], kind="stable")
                own, kin, n = node[order], label[order], size[order].astype(np.int64)
                root = np.arange(count)
                ends = np.searchsorted(n, n / similarity + 1e-6, "right")
                width = np.array([len(bits[k]) for k in order])
                for w in np.unique(width).tolist():
                    # wider parities of rows of similar sizes fold to this width
                    i0, i1 = np.searchsorted(width, [w, w + 1]).tolist()
                    wider = [bits[k] for k in order[i0 : int(ends[i1 - 1])]]
                    table = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, "<u8").reshape(-1, w // 8), axis=0) for x in wider])
                    for i in range(i0, i1):
                        j = np.arange(i + 1, int(ends[i]))
                        j = j[kin[j] != kin[i]]
                        j = j[_may(similarity, n[i], n[j], table[i - i0], table[j - i0])]
                        j = j[root[j] != root[i]]
                        for r in np.unique(root[j]).tolist():
                            out.append((int(own[i]), int(own[j[root[j] == r][0]])))
                        root[np.isin(root, root[j])] = root[i]
            rows = list(zip(*out, strict=True)) if out else [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["a", "b"])

    return run


def _linked(similarity: float):
    """Links a, b among the rows of each family that connect all its similar pairs, counted on the sets of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for family, node, label, sets in _whole_buckets(batches, ("family", "node", "label", "shingles")):
            out: list[tuple[int, int]] = []
            for a, count in zip(*(x.tolist() for x in _runs(family)), strict=True):
                order = a + np.argsort([len(x) for x in sets[a : a + count]], kind="stable")
                own, kin, every = node[order], label[order], sets[order]
                n = np.array([len(x) for x in every], np.int64)
                ends = np.searchsorted(n, n / similarity + 1e-6, "right")
                bits = np.stack([parity(x.view(np.uint64), _width(int(n[-1]))) for x in every])
                for i in range(count):
                    others = np.arange(i + 1, int(ends[i]))
                    others = others[kin[others] != kin[i]]
                    others = others[_may(similarity, n[i], n[others], bits[i], bits[others])]
                    for k in range(0, len(others), TOGETHER):
                        some = others[k : k + TOGETHER]
                        some = some[kin[some] != kin[i]]
                        if not len(some):
                            continue
                        both = common(every[i], [every[j] for j in some])
                        for j in some[both >= similarity * (n[i] + n[some] - both)].tolist():
                            if kin[i] != kin[j]:
                                out.append((int(own[i]), int(own[j])))
                                kin[kin == kin[j]] = kin[i]
            rows = list(zip(*out, strict=True)) if out else [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["a", "b"])

    return run


def _completed(text: DataFrame, nodes: DataFrame, labels: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """labels (node, label) after all links between their components: an exact way for pairs that fingerprints miss.

    Shingles have one order for all texts. Two sets as similar as that share one of their first
    n - ceil(similarity * n) + 1. Rows that share one with a row of another component meet, unless a bound on
    their common shingles (places, sizes) is too low. Each set of rows that meet is compared once, by
    parities; pairs that stay possible make families, and within a family all pairs of different components are
    counted on the sets of shingles. So no pair is a row: a meeting of n rows gives n rows and at most n - 1 links.
    Any order is exact; frequent shingles come last for speed. All texts of an id of several rows take part.
    """
    known = S.stored(nodes.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "near-components")
    often = text.mapInArrow(_frequent(shingle), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    late = np.array([r.token for r in often.orderBy(F.desc("n"), "token").limit(LATE).select("token").collect()], np.int64).view(np.uint64)
    order = np.argsort(late)
    made = text.mapInArrow(_first_shingles(similarity, shingle, late[order], -order), "node long, size int, tokens array<bigint>, parity binary")
    # most rows are nodes with their own label: these rows, wide as they are, aren't dealt out for it if the others are few
    copies = text.select(F.col("doc_id").alias("node")).join(known, "node", "left_anti").distinct().select("node", F.lit(None).cast("long").alias("label"))
    other = S.stored(known.where(F.col("label") != F.col("node")).union(copies).withColumn("other", F.lit(True)), "near-other")
    own = made.join(S.small(other, other.count()), "node", "left").where(F.col("other").isNull() | F.col("label").isNotNull())
    first = S.stored(own.select("node", "size", "tokens", "parity", F.coalesce("label", "node").alias("label")), "near-first")
    place = (F.shiftleft(F.col("size").cast("long"), 32) + F.col("place")).alias("place")
    tokens = first.select("node", "label", "size", F.posexplode("tokens").alias("place", "token")).select("token", "node", "label", place)
    met = tokens.repartition("token").sortWithinPartitions("token", "node").mapInArrow(_sharing(similarity), "met long, node long")
    met = S.stored(met.distinct(), "near-met")
    if met.isEmpty():
        return labels
    judged = met.join(first.select("node", "label", "size", "parity").distinct(), "node").select("met", "node", "label", "size", "parity")
    pairs = S.stored(judged.repartition("met").sortWithinPartitions("met").mapInArrow(_spanned(similarity), "a long, b long").distinct(), "near-possible")
    if pairs.isEmpty():
        return labels
    families = S.stored(components(pairs).select("node", F.col("label").alias("family")), "near-families")
    few = S.small(families, families.count())
    texts = text.join(few, text["doc_id"] == few["node"], "left_semi").select("doc_id", "text").distinct()
    sets = S.stored(texts.mapInArrow(_sets(shingle), "node long, shingles array<bigint>"), "near-sets")
    whole = sets.join(families, "node").join(known, "node").select("family", "node", "label", "shingles")
    more = S.stored(whole.repartition("family").sortWithinPartitions("family").mapInArrow(_linked(similarity), "a long, b long"), "near-more")
    if more.isEmpty():
        return labels
    return S.stored(components(S.stored(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more), "near-links")), "near-labels")


def near_duplicates(docs: DataFrame, *, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY, words: int = WORDS, width: int = WIDTH) -> DataFrame:
    """doc_id and keeper (the smallest id of its group) of docs (doc_id, text) with an id.

    Texts equal but for case and white space are one from the start. Fingerprints have
    64 * words bits in partitions of width bits with thresholds 0, so pairs that differ
    in fewer bits than there are partitions always meet; at similarity 0.8 pairs meet with
    probability 0.99. What doesn't meet, or is estimated too low, is found by shared shingles
    and counted (_completed). Similarity is estimated from the whole fingerprints and the
    numbers of shingles (standard deviation 0.026 for 1024 bits at 0.8); where that leaves
    doubt, it is counted on the texts.
    """
    S.importable(docs.sparkSession)
    text = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), S.text_of().alias("text"))
    prints = S.stored(text.mapInArrow(_wide_fingerprints(shingle, words), "doc_id long, key binary, size int, fp binary"), "wide-fingerprints")
    nodes = S.stored(prints.groupBy("key").agg(F.min("doc_id").alias("node"), F.min("size").alias("size"), F.min("fp").alias("fp")), "near-nodes")
    n = nodes.count()
    bits = 64 * words
    sample = sampled(nodes.select("fp"), "fp") if n else np.zeros((0, bits))
    parts = [(g, 0) for g in grouped_bits(sample, bits // width)] if n else []
    # rows whose first word differs too much from all others of a bucket leave it (at the similarity 15 % of bits differ, by chance half);
    # the others' pairs are estimated on whole fingerprints before any is found redundant
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    limit = round(64 * angle + 3.6 * math.sqrt(64 * angle * (1 - angle)))
    mark = F.conv(F.hex(F.substring("fp", 1, 8)), 16, -10).cast("long")
    ready = nodes.select("node", mark.alias("mark"), "fp")
    keys = ready.mapInArrow(_keys(parts), "bucket long, node long, mark long").repartition("bucket").sortWithinPartitions("bucket", "node")
    met = keys.mapInArrow(_meeting(limit), "bucket long, node long")
    begin, path = S.mark(), S.work_folder(docs.sparkSession, "near-connected")
    whole = S.stored(met.join(nodes.select("node", "size", "fp"), "node").select("bucket", "node", "size", "fp"), "near-whole")
    connected = S.saved(_connected(text, whole, similarity, shingle), path)
    S.release(docs.sparkSession, begin, keep=[path])
    labels = _completed(text, nodes, connected, similarity, shingle)
    keepers = nodes.select("key", "node").join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("keeper"))
    return prints.select("doc_id", "key").join(keepers, "key").select("doc_id", "keeper")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of near duplicates, that with the smallest id; rows without an id stay.

    Rows that share an id are one document if their texts are equal.
    """
    begin, path = S.mark(), S.work_folder(docs.sparkSession, "near-groups")
    found = S.saved(near_duplicates(docs, **options), path)
    S.release(docs.sparkSession, begin, keep=[path])
    gone = S.stored(found.where(F.col("doc_id") != F.col("keeper")).select("doc_id").distinct(), "near-gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(*S.columns(docs))
    twice = S.stored(found.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("doc_id"), "near-twice")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, "doc_id", "left_anti").select(*S.columns(docs))
    return once.unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*S.columns(docs)))
