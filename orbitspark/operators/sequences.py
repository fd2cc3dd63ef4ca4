"""Ordered sequences per object, rank splits and time gaps. One shuffle on the object serves all windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitspark.constants import MIN_EPOCHS, SEQ_LEN, TRAIN_RATIO, VAL_RATIO
from orbitspark.functions.features import by_object, seconds_since, size_range

def with_sequences(df: DataFrame, length: int = SEQ_LEN) -> DataFrame:
    """epoch_idx (from 0), sequence_id, seq_pos and seq_len. One shuffle and one order of rows: a sequence's length follows from its object's."""
    n = F.count("*").over(Window.partitionBy("satellite_number"))
    df = df.withColumns({"epoch_idx": F.row_number().over(by_object()).cast("long") - 1, "__n": n})
    df = df.withColumns({"sequence_id": F.floor(F.col("epoch_idx") / length), "seq_pos": (F.col("epoch_idx") % length).cast("int")})
    return df.withColumn("seq_len", F.least(F.lit(length).cast("long"), F.col("__n") - F.col("sequence_id") * length)).drop("__n")


def with_history(df: DataFrame, least: int = MIN_EPOCHS) -> DataFrame:
    """Objects of at least so many snapshots: a semi join on their counts."""
    enough = df.groupBy("satellite_number").count().where(F.col("count") >= least).select("satellite_number")
    return df.join(enough, "satellite_number", "left_semi")


def complete(df: DataFrame, length: int = SEQ_LEN) -> DataFrame:
    return df.where(F.col("seq_len") == length)


def with_time_gap(df: DataFrame) -> DataFrame:
    """Days since the object's snapshot before, by whole seconds; 0 for the first."""
    return df.withColumn("time_gap_days", F.coalesce(seconds_since(F.lag("epoch_dt").over(by_object())) / 86400.0, F.lit(0.0)))


def sequence_table(df: DataFrame) -> DataFrame:
    """A row per complete sequence: its first epoch and coefficient, and its size range."""
    first = lambda c: F.min_by(c, "epoch_idx").alias
    seqs = df.groupBy("satellite_number", "sequence_id").agg(first("epoch_dt")("seq_first_epoch"), first("ballistic_coef_m2kg")("seq_bc"))
    return seqs.withColumn("size_range", size_range(F.col("seq_bc")))


def rank_split(seqs: DataFrame) -> DataFrame:
    """(satellite_number, sat_median_epoch_us, sat_rank, split): objects ranked by the median of their first epochs.

    The window without a partition runs over one row per object, the smallest table of the data.
    """
    us = F.unix_micros(F.col("seq_first_epoch").cast("timestamp"))
    objects = seqs.groupBy("satellite_number").agg(F.median(us).alias("sat_median_epoch_us"))
    ranked = objects.withColumn("sat_rank", F.row_number().over(Window.orderBy("sat_median_epoch_us", "satellite_number")).cast("long") - 1)
    progress = F.col("sat_rank") / F.count("*").over(Window.partitionBy(F.lit(1)))
    return ranked.withColumn("split", F.when(progress < TRAIN_RATIO, "train").when(progress < TRAIN_RATIO + VAL_RATIO, "val").otherwise("test"))


def with_sizes(df: DataFrame) -> DataFrame:
    """Complete sequences with seq_bc, the coefficient of the sequence's first snapshot, and size_range; in the object's own order."""
    head = F.when(F.col("seq_pos") == 0, F.struct("ballistic_coef_m2kg"))  # there even if the coefficient is null
    own = F.last(head, ignorenulls=True).over(by_object())["ballistic_coef_m2kg"]
    return df.withColumn("seq_bc", own).withColumn("size_range", size_range(F.col("seq_bc")))


def split_table(df: DataFrame) -> DataFrame:
    """(satellite_number, split) from complete sequences: a row per object."""
    heads = df.where("seq_pos = 0").select("satellite_number", F.col("epoch_dt").alias("seq_first_epoch"))
    return rank_split(heads).select("satellite_number", "split")


def with_split(df: DataFrame) -> DataFrame:
    """Complete sequences with seq_bc and size_range by sequence, and split by object, without leaks between splits."""
    return with_sizes(df).join(split_table(df), "satellite_number")


def with_span(df: DataFrame, least_hours: float = 6.0) -> DataFrame:
    """Objects whose snapshots span more than so many hours."""
    span = F.timestamp_diff("SECOND", F.min("epoch_dt"), F.max("epoch_dt"))
    enough = df.groupBy("satellite_number").agg(span.alias("span")).where(F.col("span") > least_hours * 3600).select("satellite_number")
    return df.join(enough, "satellite_number", "left_semi")


def sampled_objects(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """All rows of n objects, those of the smallest seeded hash: the same sample on any partitioning."""
    chosen = df.select("satellite_number").distinct().orderBy(F.xxhash64("satellite_number", F.lit(seed)), "satellite_number").limit(n)
    return df.join(chosen, "satellite_number", "left_semi")


def split_profile(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("satellite_number").alias("n_objects"), F.countDistinct("sequence_id").alias("n_sequence_ids"), F.countDistinct("satellite_number", "sequence_id").alias("n_sequences"))


def leaked_objects(df: DataFrame) -> DataFrame:
    """One row: objects in more than one split; must be 0."""
    per_object = df.groupBy("satellite_number").agg(F.countDistinct("split").alias("n"))
    return per_object.agg(F.count_if(F.col("n") > 1).alias("n_leaked"), F.count("*").alias("n_objects"))


def ordered_chunks(df: DataFrame, columns: list[str], length: int = 1000) -> DataFrame:
    """(satellite_number, chunk, n, rows): an object's snapshots in order, as arrays of structs (epoch_dt, columns).

    A chunk holds so many snapshots at most, so that no object is one row, whatever its history; chunks follow each other.
    """
    at = F.row_number().over(by_object()).cast("long") - 1
    cut = df.withColumn("__at", at).withColumn("chunk", F.floor(F.col("__at") / length))
    rows = F.sort_array(F.collect_list(F.struct("__at", "epoch_dt", *columns)))
    each = cut.groupBy("satellite_number", "chunk").agg(rows.alias("rows"))
    plain = F.transform("rows", lambda x: F.struct(x["epoch_dt"].alias("epoch_dt"), *(x[c].alias(c) for c in columns)))
    return each.select("satellite_number", "chunk", F.size("rows").cast("long").alias("n"), plain.alias("rows"))
