"""From raw documents to packed sequences, in five stages.

Each stage works on all rows that its predecessor kept; run() writes what a stage returns
to the shared folder and reads it again for the next.

Cases: rows with a null, empty or very long text, repeated ids or none, and columns of any name
go through every stage as its operator says; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcat.llm import _shared as S
from loomcat.llm import mixing, packing, pii, quality, simhash

#: The stages' estimates and hashes are not SQL; tests hold them against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows are judged by themselves, repeated ids included."""
    row = F.struct(*S.columns(docs))
    judged = quality.judge(docs.select("doc_id", "text", "lang", "source", row.alias("row")), ("row",))
    return judged.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: shingles of five words, similarity 0.8 or more."""
    return simhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length(S.text_of()).cast("long")) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 2048 ids."""
    return packing.pack(packing.cut(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage and its predecessor stored goes once its successor is written."""
    begin, docs = S.mark(), S.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = S.work_folder(spark, name.replace(" ", "-"))
        docs = S.saved(stage(spark, docs, sf_dir), path)
        S.release(spark, begin, keep=[path])
    return docs
