"""Shared helpers: table access, lineage cuts in the shared folder, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and \x09-\x0D.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders by application, for local sessions that name no shared one.
LOCAL: dict[str, str] = {}
#: Bytes of an Arrow batch on its way to Python: with few long texts a batch has few rows.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def batches_of(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bounds the session's Arrow batches by bytes, unless its own bound is lower."""
    known = spark.conf.get(BATCH_SETTING, None)
    if known is None or not known.isdigit() or int(known) > size:
        spark.conf.set(BATCH_SETTING, str(size))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Unset, a local session takes a temporary one; others are refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in LOCAL:
        LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return LOCAL[app]


#: Has Spark drop an execution's shuffle files as soon as it ends, instead of when the driver's JVM finds that nothing refers to them.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is executed while this is open leaves no shuffle files, which otherwise lie beside those of the next steps."""
    before = spark.conf.get(CLEANUP_SETTING, None)
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_SETTING) if before is None else spark.conf.set(CLEANUP_SETTING, before)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table written in the shared folder: lineage ends there, and a lost executor costs no rework."""
    return written_by_turns([df], tag)


def written_by_turns(turns: Iterable[DataFrame], tag: str, codec: str = "snappy") -> DataFrame:
    """Frames of the same columns as one table, written one after another, so that the shuffle files of one turn lie on disk at a time."""
    path = None
    for df in turns:
        spark, schema = df.sparkSession, df.schema
        path = path or f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        with shuffles_dropped(spark):
            df.write.mode("append").option("compression", codec).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_at = path
    if (held := RECORD.get()) is not None:
        held.append(out)
    return out


#: What takes note of the tables that this thread writes.
RECORD: ContextVar[list[DataFrame] | None] = ContextVar("RECORD", default=None)


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The tables that the calling thread writes while this is open."""
    held: list[DataFrame] = []
    token = RECORD.set(held)
    try:
        yield held
    finally:
        RECORD.reset(token)


def erase(*tables: DataFrame) -> None:
    """Deletes the files of tables from written(), once nothing will read them again."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v): rows (node, root), root the smallest node, for every node with an edge.

    Alternating large-star and small-star rounds; each is a combinable min by node and a join that adaptive execution
    can split, so a hub with a third of all nodes stays spread. Rounds grow with the logarithm of the longest path.
    """
    now = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(now, "edges")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        mark = (mark["n"], mark["h"])
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = mark
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, now = now, written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
        erase(before)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
