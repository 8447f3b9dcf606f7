"""What the corpus operators share: the work folder, stored tables, word rules."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import suppress
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`.
BLANKS = " \t\n\x0b\x0c\r"
CODEC = "zstd"


#: Work folders made so far, in order.
_MADE: list[str] = []


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Only where that setting is absent and Spark runs on this machine alone, as in tests, a
    local folder takes its place until the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="loomcat-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def mark() -> int:
    """How many work folders there are, for release()."""
    return len(_MADE)


def release(spark: SparkSession, since: int, keep: Iterable[str] = ()) -> None:
    """Deletes the work folders made since a mark, but those to keep; nothing may read them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kept = set(keep)
    for path in [p for p in _MADE[since:] if p not in kept]:
        root = jvm.org.apache.hadoop.fs.Path(path)
        root.getFileSystem(conf).delete(root, True)
    _MADE[since:] = [p for p in _MADE[since:] if p in kept]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, so that later steps neither repeat nor lose it."""
    return saved(df, work_folder(df.sparkSession, name))


def saved(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", CODEC).parquet(path)
    trim_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim_driver(spark: SparkSession) -> None:
    """Gives the system what the driver's JVM has freed outside its heap (compilers' work memory above all), which the C library would keep.

    Py4J reaches the server of beans by its public interface only. A JVM without the command keeps what it has.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    named = jvm.java.lang.Class.forName
    kinds, args = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = named(kind)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    with suppress(Py4JError):
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed on the executors."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])


def forget_tokens() -> None:
    """Frees what an earlier step's token ids left in this Python worker: Spark keeps workers, with all they hold, for later steps."""
    tokens = sys.modules.get(f"{__package__}.tokens")
    if tokens:
        tokens._ENCODERS.clear()
        trim_worker()


def trim_worker() -> None:
    """Gives the system what this Python worker has freed: idle workers keep it beside the executor's JVM. Other C libraries than GNU's keep what they have."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def text_of(column: str = "text") -> Column:
    """The text; a null is an empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """The words `[^\x20\x09-\x0D]+` as an array, empty if there are none."""
    bare = trimmed(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+", -1))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows of a driver-made table up to which a join sends it to every task (some 10 MB); a larger one is shuffled.
BROADCAST_ROWS = 50_000


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Copies of a keyed row that a join with hot keys deals its partners over.
SALTS = 32
#: A key is hot that holds more than this share of all rows; so there are at most 1 / share of them.
HOT_SHARE = 1e-4


def keyed(rows: DataFrame, few: DataFrame, key: list[str], n: int) -> DataFrame:
    """rows joined with few (n rows, one a key): sent to all tasks if it is small, else copied SALTS times so that no key is one task's."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), key)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(copies, [*key, "_salt"]).drop("_salt")


def skewed(rows: DataFrame, few: DataFrame, key: list[str], count: str) -> DataFrame:
    """rows joined with few, a stored table of one row a key whose column `count` says how many rows have it; hot keys are dealt over SALTS tasks."""
    total = few.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(few.where(F.col(count) > total * HOT_SHARE).select(*key, F.lit(True).alias("_hot")))  # at most 1 / HOT_SHARE rows
    salt = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    left = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    right = few.join(hot, key, "left").withColumn("_salt", copies).drop("_hot", count)
    return left.join(right, [*key, "_salt"]).drop("_salt")
