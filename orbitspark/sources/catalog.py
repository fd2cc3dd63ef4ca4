"""Catalogue of known objects: union of event files, dedup, altitudes, and labels joined to snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitspark.functions.features import altitude_band, object_class
from orbitspark.functions.orbital import altitudes_from_mean_motion

SCHEMA = "OBJECT_NAME string, OBJECT_ID string, NORAD_CAT_ID long, MEAN_MOTION double, ECCENTRICITY double"


def read_catalog(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Event files (CSV with a header) by event name, as one table with event_source."""
    parts = [spark.read.csv(path, header=True, enforceSchema=False, schema=SCHEMA).withColumn("event_source", F.lit(name)) for name, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def enriched(catalog: DataFrame) -> DataFrame:
    """One row per NORAD id, the first by event and object id, with class, altitudes and band."""
    first = Window.partitionBy("NORAD_CAT_ID").orderBy("event_source", "OBJECT_ID", "OBJECT_NAME")
    one = catalog.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    df = one.withColumns(altitudes_from_mean_motion(F.col("MEAN_MOTION"), F.col("ECCENTRICITY"))).withColumn("object_class_catalog", object_class(F.col("OBJECT_NAME")))
    return df.withColumn("altitude_band", altitude_band(F.col("mean_alt_km")))


def with_catalog(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Left join on the object number: class (the catalogue's, else by name), event_source and catalogue altitude.

    The catalogue holds a row per object; the session's broadcast threshold decides whether it is broadcast.
    """
    known = catalog.select(F.col("NORAD_CAT_ID").alias("satellite_number"), "object_class_catalog", "event_source", F.col("mean_alt_km").alias("catalog_mean_alt_km"))
    joined = df.join(known, "satellite_number", "left")
    known_class = F.when(F.col("object_class_catalog") != "unknown", F.col("object_class_catalog"))
    return joined.withColumns({"object_class": F.coalesce(known_class, object_class(F.col("common_name"))), "debris_cloud_membership": F.coalesce("event_source", F.lit("none"))})


def supplier_catalog(supplier: DataFrame) -> DataFrame:
    """Catalogue rows from the supplier table, some ids twice."""
    k = F.col("s_nationkey")
    base = supplier.where(k % 3 < 2).select(
        F.concat(F.col("s_name"), F.when(k % 2 == 0, F.lit(" DEB")).otherwise(F.lit(" R/B"))).alias("OBJECT_NAME"),
        F.concat(F.lit("1993-036"), F.col("s_suppkey").cast("string")).alias("OBJECT_ID"),
        F.col("s_suppkey").alias("NORAD_CAT_ID"),
        (12 + 0.15 * k).alias("MEAN_MOTION"),
        (0.001 * (1 + k % 7)).alias("ECCENTRICITY"),
        F.concat(F.lit("event"), (k % 3).cast("string")).alias("event_source"),
    )
    again = base.where(F.col("NORAD_CAT_ID") % 4 == 0).withColumns({"event_source": F.lit("event9"), "MEAN_MOTION": F.col("MEAN_MOTION") + 1})
    return base.unionByName(again)
