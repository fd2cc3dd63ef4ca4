"""Table readers and writers."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that all executors share (spark.checkpoint.dir); a local session without one takes a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{shared}/tables-{uuid.uuid4().hex}"


#: Bytes of a generated method beyond which the JVM interprets it for good instead of compiling it.
COMPILED_BYTES = 8000
METHOD_SETTING = "spark.sql.codegen.hugeMethodLimit"


def compiled_methods(spark: SparkSession) -> None:
    """Has the session split expressions over many columns into methods that the JVM compiles, unless its own bound is lower."""
    if int(spark.conf.get(METHOD_SETTING)) > COMPILED_BYTES:
        spark.conf.set(METHOD_SETTING, str(COMPILED_BYTES))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """zstd Parquet; `by` gives a folder per value, such as one per size range."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


#: Snapshots of a partition at most, on average, so that a task's sorts and groups need no more memory for a larger table.
PART_ROWS = 250_000


def parts(n_rows: int) -> int:
    """Partitions to deal so many rows out in, at least one."""
    return max(1, math.ceil(n_rows / PART_ROWS))


def held(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder, for what is read more than once; its lineage ends there."""
    path = f"{scratch(df.sparkSession)}/held"
    write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, key: str, order: list[str], buckets: int | None = None, path: str | None = None) -> DataFrame:
    """df as a table in buckets of a key, each in one file and sorted by key and order; read again without a shuffle.

    Joins, groups and windows on the key need no exchange of this table. The one shuffle is done here, unless df is
    dealt out by the key in as many partitions already. The table has a name of its own in the session's catalogue. It is
    below the shared folder, or at a path that holds nothing yet.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"by_{key}_{uuid.uuid4().hex}"
    writer = df.repartition(n, key).write.bucketBy(n, key).sortBy(key, *order).option("compression", "zstd")
    writer.option("path", path or f"{scratch(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def read_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """The table of write_bucketed at a path, in any session, with its buckets known."""
    name, columns = f"by_{key}_{uuid.uuid4().hex}", spark.read.parquet(path).schema
    spark.sql(f"CREATE TABLE {name} ({columns.toDDL()}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.json(path, schema=schema)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Summaries, a JSON object per row."""
    df.write.mode(mode).json(path)


def write_grid(cells: DataFrame, path: str, n_objects: int | None = None, mode: str = "overwrite") -> None:
    """Grid cells, the three axes with their centres beside them, and a table of steps, counts and the objects in the grid."""
    from orbitspark.operators.riskmap import AXES

    spark = cells.sparkSession
    cells.write.mode(mode).parquet(f"{path}/cells")
    for axis, (first, step, n) in AXES.items():
        spark.range(n).select(F.col("id").cast("int").alias(f"{axis}_i"), (first + step * F.col("id")).alias("center")).write.mode(mode).parquet(f"{path}/axis_{axis}")
    about = [(axis, first, step, n, n_objects) for axis, (first, step, n) in AXES.items()]
    spark.createDataFrame(about, "axis string, first double, step double, n int, n_objects long").coalesce(1).write.mode(mode).parquet(f"{path}/about")
