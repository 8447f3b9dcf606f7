"""Keyed tables on Parquet: versions that replace each other, appended records, stored reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "version"
PROPOSAL = "target string, kind string, confidence double, topic_ko string, emb_score double"
SNAPSHOT = f"config map<string,string>, sources map<string,struct<candidates:array<struct<id:string,score:double>>,proposed:array<struct<{PROPOSAL.replace(' string', ':string').replace(' double', ':double').replace(', ', ',')}>>>>"


def merged(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(*key), list(key), "left_anti").select(*new.columns).unionByName(new)


def patched(old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """old with only the given columns taken from new where new has the key; new keys add no rows."""
    fresh = new.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    take = lambda c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    return old.join(fresh, list(key), "left").select(*[take(c) if c in columns else F.col(c) for c in old.columns])


def without_orphans(rows: DataFrame, owners: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose owner is still there."""
    return rows.join(owners.select(*key), list(key), "left_semi")


class VersionedTable:
    """A table as a folder of full versions; the newest finished one counts, so that a failed write changes nothing. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{VERSION}=") and done(n))

    def read(self) -> DataFrame | None:
        found = self._versions()
        return self.spark.read.parquet(f"{self.path}/{VERSION}={found[-1]}") if found else None

    def write(self, rows: DataFrame) -> int:
        number = ([0, *self._versions()])[-1] + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/{VERSION}={number}")
        return number

    def upsert(self, rows: DataFrame, key: Sequence[str]) -> int:
        old = self.read()
        return self.write(rows if old is None else merged(old, rows, key))


def record(spark: SparkSession, path: str, rows: DataFrame, *, activity: str, agent: str, used: dict | None = None, generated: dict | None = None) -> None:
    """Appends a lineage row for each asset."""
    text = lambda d: F.lit(json.dumps(d or {}, sort_keys=True, ensure_ascii=False))
    out = rows.select("asset_id", F.lit(activity).alias("activity"), F.lit(agent).alias("agent"), text(used).alias("used"), text(generated).alias("generated"), F.current_timestamp().alias("at"), F.lit(uuid.uuid4().hex).alias("run"))
    out.write.mode("append").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Candidates (source, id, score) and proposals (source, target, kind, confidence, topic_ko, emb_score) of a snapshot file; a candidate without a score has 0."""
    sources = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path).select(F.explode("sources").alias("source", "s"))
    found = sources.select("source", F.explode("s.candidates").alias("c")).select("source", "c.id", F.coalesce("c.score", F.lit(0.0)).alias("score"))
    return found, sources.select("source", F.explode("s.proposed").alias("p")).select("source", "p.*")


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, kind, note) and isolated (key) of a golden file of version 1; ValueError for a bad one."""
    rows = spark.read.schema("version int, key_type string, pairs array<struct<a:string,b:string,kind:string,note:string>>, isolated array<string>").option("multiLine", True).json(path)
    pairs = rows.select(F.explode("pairs").alias("p")).select("p.*")
    alone = rows.select(F.explode("isolated").alias("key"))
    if not rows.where(~F.col("version").eqNullSafe(1)).isEmpty() or not pairs.where(F.col("a").eqNullSafe(F.col("b")) | F.col("a").isNull() | F.col("b").isNull()).isEmpty():
        raise ValueError("a golden file has version 1 and pairs of two keys")
    return pairs, alone
