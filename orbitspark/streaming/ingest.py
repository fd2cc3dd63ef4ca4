"""Messages as a stream: new files are parsed by the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitspark.sources.messages import RECORD_END, epoch_time, parse_messages, split_blocks


def stream_messages(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming table of the messages in a folder's files, with epoch_dt."""
    records = spark.readStream.option("lineSep", RECORD_END).text(folder)
    return parse_messages(split_blocks(records)).withColumn("epoch_dt", epoch_time(F.col("epoch_time_utc")))


def stream_daily_counts(messages: DataFrame, late: str = "7 days") -> DataFrame:
    """Messages and mean coefficient by object class of day, with a watermark for late files."""
    timed = messages.withColumn("ts", F.col("epoch_dt").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day").alias("day"), "satellite_number").agg(F.count("*").alias("n"), F.avg("ballistic_coef_m2kg").alias("mean_bc"))
