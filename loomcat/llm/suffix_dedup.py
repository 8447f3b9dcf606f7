"""Removal of byte strings that occur more than once, by suffix order.

Every window of LENGTH bytes has an anchor: its K-gram of least hash. Neighbouring
windows with one anchor form a run, and equal windows have equal anchors at equal
places, so only runs whose anchors' K-grams occur twice can hold repeats (about one run
for each 69 bytes is counted; texts are not shuffled for that). Runs that are equal as
a whole (by the 64 bits of the anchor's hash and 64 of the run's) are repeats. What is left, distinct runs
around one anchor, is gathered by anchor and put in suffix order column by column: all
strings insert one symbol a round, from their ends, which updates the Burrows-Wheeler
transform of the collection; each round reads and writes it once, in order. A window whose
common prefix with a neighbour is LENGTH bytes is a repeat; these prefixes are taken once, at
the end, as keeping them in every round costs more than the rest of a round.

An anchor with more than HOT distinct runs (a common passage in many contexts) is split by
the place of the anchor in the window: windows of a cell of places share the bytes that all
of them cover, which go into the key. A key that still has over MOST strings is not gathered:
its windows are counted by their digests.

The collection of a round is a batch of about BATCH strings (MOST at most, but for the rows
of one key), held in memory in place of external files: a Python worker reaches no folder
that executors share, and its own disk is lost with it.

Cases: a null text is empty; texts below LENGTH bytes have no window; equal rows (ids too)
are documents of their own and repeat each other; a null id is kept; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S

LENGTH, K = 200, 64
#: Windows of one anchor at most, and places a cell of a split anchor.
PLACES, CELL = LENGTH - K + 1, 13
HOT = 2000
#: Strings of one collection (whole groups), and bytes of text looked at together.
BATCH, CHUNK = 500, 1 << 20
#: Strings of one key up to which they are gathered.
MOST = 4000
SPAN = "row long, s long, n int"


def _table() -> np.ndarray:
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return _mix(x)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x5851F42D4C957F2D
TABLE = _table()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS = _powers(BASE, CHUNK + LENGTH + 1)
INVERSE = _powers(pow(BASE, -1, 1 << 64), CHUNK + LENGTH + 1)


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, windows, place of the anchor in the first, anchor hash and run hash of each run; ends: where each byte's text ends."""
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(data) < LENGTH:
        return empty
    byte = TABLE[data]
    h, size, base = byte, 1, BASE
    while size < K:
        h = h[:-size] * np.uint64(base) + h[size:]
        base = base * base & 0xFFFFFFFFFFFFFFFF
        size *= 2
    h = _mix(h)
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= PLACES:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = PLACES - size
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    start = np.arange(len(anchor))
    whole = ends[: len(anchor)] - start >= LENGTH
    first = whole & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~whole[:-1] | (ends[1 : len(anchor)] != ends[: len(anchor) - 1])])
    stop = np.concatenate([whole[:-1] & (first[1:] | ~whole[1:]), [whole[-1]]])
    s, n = np.flatnonzero(first), np.flatnonzero(stop) - np.flatnonzero(first) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte * POWERS[: len(byte)], dtype=np.uint64)])
    seg = _mix((sums[s + n + LENGTH - 1] - sums[s]) * INVERSE[s] + n.astype(np.uint64))
    return s, n, anchor[s] - s, h[anchor[s]], seg


def _stored_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data = [pack.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(data, pa.binary())], ["row", "doc_id", "data"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()

    def emit(pieces: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        size = np.array([len(p) for _, _, p in pieces])
        ends = np.cumsum(size)
        s, n, place, core, seg = runs(np.frombuffer(b"".join(p for *_, p in pieces), np.uint8), np.repeat(ends, size))
        own = np.searchsorted(ends, s, "right")
        rows, at = np.array([r for r, *_ in pieces]), np.array([o for _, o, _ in pieces])
        columns = [rows[own], at[own] + s - (ends - size)[own], n.astype(np.int32), place.astype(np.int32), core.view(np.int64), seg.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "s", "n", "place", "core", "seg"])

    for batch in batches:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for row, packed in zip(batch.column("row").to_pylist(), batch.column("data").to_pylist(), strict=True):
            data = unpack.decompress(packed)
            for at in range(0, max(len(data) - LENGTH + 1, 0), CHUNK - LENGTH + 1):
                piece = data[at : at + CHUNK]
                if size + len(piece) > CHUNK:
                    yield emit(held)
                    held, size = [], 0
                held.append((row, at, piece))
                size += len(piece)
        if held:
            yield emit(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted runs, by key; runs of hot anchors by cells."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple] = []
        for row, packed, wanted in zip(batch.column("row").to_pylist(), batch.column("data").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            data = unpack.decompress(packed)
            for w in wanted:
                s, n, place, core = w["s"], w["n"], w["place"], w["core"]
                if not w["hot"]:
                    out.append((core, row, s, n, w["lone"], data[s : s + n + LENGTH - 1]))
                    continue
                anchor, i = s + place, 0
                while i < n:
                    cell = (place - i) // CELL  # the anchor's place falls as windows move on
                    k = min(n - i, place - i - cell * CELL + 1)
                    common = data[max(anchor - cell * CELL, 0) : anchor - min(cell * CELL + CELL - 1, PLACES - 1) + LENGTH]
                    key = int.from_bytes(hashlib.blake2b(common, digest_size=8, key=b"%d.%d" % (cell, core)).digest(), "little", signed=True)
                    out.append((key, row, s + i, k, w["lone"], data[s + i : s + i + k + LENGTH - 1]))
                    i += k
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "row", "s", "n", "lone", "data"])


def _places(bwt: np.ndarray) -> np.ndarray:
    """For each symbol its place among all in stable order."""
    out = np.empty(len(bwt), np.int32)
    out[np.argsort(bwt, kind="stable")] = np.arange(len(bwt), dtype=np.int32)
    return out


def suffix_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """String and length of each suffix of the collection, end marks included, in suffix order.

    Column by column: in round j the suffixes of length j enter. Symbols are numbered in
    byte order from 1; 0 stands where a string is at its start.
    """
    m = len(strings)
    size = np.array([len(x) for x in strings], np.int64)
    rounds = int(size.max(initial=0))
    used = np.unique(np.frombuffer(b"".join(strings), np.uint8))
    code = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)
    code[used] = np.arange(1, len(used) + 1)
    column = np.zeros((rounds + 1, m), code.dtype)  # row j: the symbols before the suffixes of length j
    for i, x in enumerate(strings):
        column[: size[i], i] = code[np.frombuffer(x, np.uint8)[::-1]]
    bwt, live = column[0].copy(), np.flatnonzero(size > 0)
    at = live
    for j in range(1, rounds + 1):
        # where the longer suffix goes: behind the end marks and all symbols before this one in stable order
        at = _places(bwt)[at] + (m - int(np.count_nonzero(bwt == 0)))
        new = np.empty(len(bwt) + len(at), code.dtype)
        old = np.ones(len(new), bool)
        old[at] = False
        new[old], new[at] = bwt, column[j, live]
        bwt = new
        on = size[live] > j
        if not on.all():
            at, live = at[on], live[on]
    order = _places(bwt) + (m - int(np.count_nonzero(bwt == 0)))
    string, length = np.empty(len(bwt), np.int32), np.zeros(len(bwt), np.int32)
    at = live = np.arange(m)
    string[at] = live
    for j in range(1, rounds + 1):
        on = size[live] >= j
        live, at = live[on], order[at[on]]
        string[at], length[at] = live, j
    return string, length


def repeated(strings: list[bytes]) -> list[np.ndarray]:
    """For each string, which of its windows of LENGTH bytes start at another place of the strings too."""
    string, length = suffix_order(strings)
    own = length >= LENGTH
    string, length = string[own], length[own]
    size = np.array([len(x) for x in strings])
    ends = np.cumsum(size)
    start = ends[string] - length
    data = np.frombuffer(b"".join(strings), np.uint8)
    same = np.zeros(max(len(start) - 1, 0), bool)
    if len(same):
        windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
        for i in range(0, len(same), 8192):
            same[i : i + 8192] = (windows[start[i : i + 8192][: len(same) - i]] == windows[start[i + 1 : i + 8193]]).all(1)
    twice = np.zeros(len(start), bool)
    twice[1:] |= same
    twice[:-1] |= same
    flat = np.zeros(len(data), bool)
    flat[start[twice]] = True
    return [flat[e - n : e - n + max(n - LENGTH + 1, 0)] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]


def spans_of(marks: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of the runs of marks."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    first = np.flatnonzero(edge == 1)
    return list(zip(first.tolist(), (np.flatnonzero(edge == -1) - first).tolist(), strict=True))


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of runs sorted by key; whole groups of a key share a collection. Of keys with too many strings each window with its digest."""
    names, kinds = ["row", "s", "n", "lone", "digest"], (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
    held: list[tuple] = []
    crowded = None  # a key whose strings are not gathered

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        # equal strings of a split anchor repeat each other; one of them stands for all
        place: dict[tuple[int, bytes], list[int]] = {}
        for i, (key, *_, data) in enumerate(rows):
            place.setdefault((key, data), []).append(i)
        out = []
        for (_, data), marks in zip(place, repeated([d for _, d in place]), strict=True):
            own = place[_, data]
            for i in own:
                _key, row, s, _n, lone, _d = rows[i]
                if lone:
                    found = [(0, len(marks))] if len(own) > 1 else spans_of(marks)
                    out.extend((row, s + a, n, True, None) for a, n in found)
        return batch_of(out)

    def digests(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for key, row, s, n, lone, data in rows:
            salt = b"%d" % key
            out.extend((row, s + i, 1, lone, hashlib.blake2b(data[i : i + LENGTH], digest_size=16, key=salt).digest()) for i in range(n))
        return batch_of(out)

    first = 0  # where the last key's rows begin
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("key", "row", "s", "n", "lone", "data")), strict=True):
            if crowded is not None and crowded != r[0]:
                if held:
                    yield digests(held)
                held, crowded = [], None
            if not held or held[-1][0] != r[0]:
                if len(held) >= BATCH:
                    yield emit(held)
                    held = []
                first = len(held)
            held.append(r)
            if len(held) - first > MOST:
                if first:
                    yield emit(held[:first])
                yield digests(held[first:])
                held, first, crowded = [], 0, r[0]
    if held:
        yield digests(held) if crowded is not None else emit(held)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for doc, packed, found in zip(batch.column("doc_id").to_pylist(), batch.column("data").to_pylist(), batch.column("found").to_pylist(), strict=True):
            data = unpack.decompress(packed)
            cover, spans = [], 0
            for f in sorted((x["s"], x["s"] + x["n"] + LENGTH - 1) for x in found or ()):
                if cover and f[0] <= cover[-1][1]:
                    cover[-1][1] = max(cover[-1][1], f[1])
                else:
                    cover.append(list(f))
                    spans += 1
            at, rest = 0, []
            for a, b in cover:
                rest.append(data[at:a])
                at = b
            rest.append(data[at:])
            kept = b"".join(rest)
            out.append((doc, len(data), len(data) - len(kept), spans, kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def find(texts: DataFrame) -> DataFrame:
    """Runs (row, s, n) of repeated windows of stored texts (row, data)."""
    same = ["core", "seg"]
    all_runs = S.stored(texts.select("row", "data").mapInArrow(_anchors, "row long, s long, n int, place int, core long, seg long"), "runs")
    twice = all_runs.groupBy("core").agg(F.count("*").alias("c"), F.min("seg").alias("lo"), F.max("seg").alias("hi")).where(F.col("c") > 1)
    twice = S.stored(twice.select("core", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    # both sides are shuffled as they are, so adaptive execution splits an anchor that very many runs share
    shared = S.stored(all_runs.join(twice, "core"), "shared-runs")
    mixed = shared.where("mixed")
    distinct = S.stored(mixed.groupBy(*same).agg(F.count("*").alias("c"), F.min(F.struct("row", "s", "n", "place")).alias("one")), "distinct-runs")
    hot = distinct.groupBy("core").agg(F.count("*").alias("d")).where(F.col("d") > HOT).select("core", F.lit(True).alias("hot"))
    wanted = distinct.join(hot, "core", "left").select("one.*", "core", (F.col("c") == 1).alias("lone"), F.coalesce("hot", F.lit(False)).alias("hot"))
    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct("s", "n", "place", "core", "lone", "hot")).alias("wanted"))
    cut = texts.select("row", "data").join(by_row, "row").mapInArrow(_cut, "key long, row long, s long, n int, lone boolean, data binary")
    matched = S.stored(cut.repartition("key").sortWithinPartitions("key").mapInArrow(_matched, f"{SPAN}, lone boolean, digest binary"), "matched")
    crowded = matched.where(F.col("digest").isNotNull())
    often = S.stored(crowded.groupBy("digest").agg(F.count("*").alias("c")).where(F.col("c") > 1), "digests")
    windows = S.skewed(crowded, often, ["digest"], "c").where("lone")
    many = mixed.join(distinct.where(F.col("c") > 1).select(*same), same, "left_semi")
    return shared.where("not mixed").select("row", "s", "n").union(many.select("row", "s", "n")).union(matched.where("digest is null").select("row", "s", "n")).union(windows.select("row", "s", "n"))


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row of docs (doc_id, text)."""
    S.importable(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), S.text_of().alias("text"))
    texts = S.stored(rows.mapInArrow(_stored_text, "row long, doc_id long, data binary"), "texts")
    found = S.stored(find(texts), "repeats").groupBy("row").agg(F.collect_list(F.struct("s", "n")).alias("found"))
    return texts.join(found, "row", "left").select("doc_id", "data", "found").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages."""
    out = remove(S.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
