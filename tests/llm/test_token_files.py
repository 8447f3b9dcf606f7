"""Token files: what prunes them, and ids that many rows share; ids of words."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomcat.llm import _shared as S
from loomcat.llm import packing, token_files, tokens
from loomcat.llm.tokens import BYTE_BPE, WORD_BPE, Encoder


def scanned(df):
    """Rows that the scan of a plan without shuffles gave."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value()


def test_bloom_filters_and_row_indexes_prune(spark):
    docs = spark.range(4000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("a b "), "id").alias("text"))
    path = token_files.write_token_files(docs, S.work_folder(spark, "t"))
    files = spark.read.schema(token_files.SCHEMA).orc(path)
    assert scanned(files.select("doc_id")) == 4000
    # ids between the least and the most of all files: only a Bloom filter knows that they are absent
    odd = [scanned(files.where(F.col("doc_id") == i).select("doc_id")) for i in (1001, 3003, 5005)]
    assert sorted(odd)[1] == 0
    assert 0 < scanned(files.where(F.col("doc_id") == 4000).select("doc_id")) <= 1000


def test_frequent_ids_are_split(spark):
    docs = spark.range(900).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("t "), "id")).alias("text"), F.lit(1).alias("hash"), F.lit(2).alias("nth"))
    merges = "spark.sql.adaptive.coalescePartitions.enabled"  # small partitions would become one
    spark.conf.set(merges, "false")
    try:
        path = token_files.write_token_files(docs, S.work_folder(spark, "t"))
    finally:
        spark.conf.unset(merges)
    files = spark.read.schema(token_files.SCHEMA).orc(path)
    assert files.where("doc_id = 7").select("part").distinct().count() > 1
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in docs.collect())
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == r.n_tokens
        at += r.n_tokens


def test_a_repeated_chunk_is_looked_up_once():
    class Counted(dict):
        asked = 0

        def get(self, key):
            Counted.asked += 1
            return super().get(key)

    odd = ["", " ", "one two", "one\ntwo it's", " one", "two ", "a  b", "a\xa0\xa0b", "a\x85b", "é 中 😀.\nOne", "x᠎y", "　x"]
    texts = [*odd, *(["one two three's"] * 500)]
    own = Encoder(public_tokenizers.path(BYTE_BPE), BYTE_BPE)
    own.chunks = Counted()
    sizes, ids = own.columns(pa.array(["cut off", *texts]).slice(1), 2)
    every = [[*own.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert sizes.tolist() == [len(x) for x in every] and ids.tolist() == [i for x in every for i in x]
    assert Counted.asked < 50


def words():
    latin = [f"a{chr(c)}B{chr(c)} {chr(c)}" for c in range(256)]
    odd = ["", " ", "\n", "  a\n\nb ", "it's 'S 'ſ", "<|endoftext|> </w>", "a\x1fb", "x᠎y", "\x00", "x" * 3000, "É é e\u0301 İ i\u0327\u0307 \u0301", "ΑΣ ας ΑΣ.", "中文 ٠ⅷ 😀.\nÅ ﬀ", "a\u200bb\u3000c"]
    return [*odd, *latin]


@pytest.mark.parametrize("memo", [800_000, 3])
def test_words_hold_the_ids_of_the_library(monkeypatch, memo):
    monkeypatch.setattr(tokens, "MEMO_WORDS", memo)
    own = Encoder(public_tokenizers.path(WORD_BPE), WORD_BPE)
    every = [[*own.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in words()]
    for _ in range(2):
        sizes, ids = own.columns(pa.array(["cut off", *words()]).slice(1), 0)
        assert sizes.tolist() == [len(x) for x in every] and ids.tolist() == [i for x in every for i in x]
    # a chunk that held white space would keep its pieces together
    assert own._normalised(["Ω b", "Σ"]) == ["ω", "b", " ", "σ", " "]


def test_a_word_goes_to_the_model_once():
    own = Encoder(public_tokenizers.path(WORD_BPE), WORD_BPE)
    asked, model = [], own.model
    own.model = lambda piece: asked.append(piece) or model(piece)
    for text in ("Été été, ÉTÉ.", "one One (ONE)", "Ωmega ωmega, one"):
        own.columns(pa.array([text] * 50), 0)
    assert len(asked) == len(set(asked)) == 7  # été one ωmega , . ( )


def test_pieces_of_a_batch_come_in_parts(spark):
    docs = spark.range(1200).select(F.when(F.col("id") != 7, F.col("id")).alias("doc_id"), F.concat(F.lit("word "), F.when(F.col("id") % 400 == 0, F.repeat(F.lit("b c "), 1500)).otherwise(F.col("id").cast("string"))).alias("text")).coalesce(1)
    own = Encoder(public_tokenizers.path(WORD_BPE), WORD_BPE).tokenizer
    expected = []
    for r in docs.collect():
        ids = [*own.encode(r.text, add_special_tokens=False).ids, 0]
        expected += [(r.doc_id, i // 2048, i, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), x) for i in range(0, len(ids), 2048) for x in [ids[i : i + 2048]]]
    found = packing.cut(docs).collect()
    assert sorted(map(repr, [(*r[:5], r.ids) for r in found])) == sorted(map(repr, expected))
    assert len(found) == 1203 > 2 * packing.ROWS
    for n in {r.length for r in found}:
        assert sorted(r.nth for r in found if r.length == n) == list(range(sum(r.length == n for r in found)))


def test_a_worker_gives_back_what_it_freed():
    def resident():
        with open("/proc/self/status") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("VmRSS")) >> 10

    kept = [bytes(1000) for _ in range(200_000)]
    last = kept[-1]  # above the others, so that the C library can't shorten its heap by itself
    full = resident()
    del kept
    S.trim_worker()
    assert full - resident() > 100 and len(last) == 1000
