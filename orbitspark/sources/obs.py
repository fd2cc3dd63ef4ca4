"""Snapshots from the line-item table: a projection with the columns of parsed messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitspark.constants import GM, R_EARTH

NAMES = ("COSMOS 2251 DEB", "SL-16 R/B", "IRIDIUM 33", "TEST PL", "OBJECT A")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, dealt: bool = False, by_object: int | None = None) -> DataFrame:
    """Snapshots of the line items; dealt out in shuffle partitions before anything is computed, for work that takes long per row.

    by_object deals them out by object in so many partitions, again before anything is computed: the line items' few columns
    are shuffled instead of the snapshots' many, and windows by object need no other shuffle.
    """
    li = table(spark, sf_dir, "lineitem")
    li = li.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if dealt else li
    li = li.repartition(by_object, "l_suppkey") if by_object else li
    ms = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("long") * 8640000 + (F.col("l_orderkey") % 8640) * 1000 + F.col("l_linenumber") + 500
    df = li.withColumns({"__ms": ms, "__r": R_EARTH + 250 + 32 * F.col("l_quantity"), "__u": F.radians((37 * F.col("l_orderkey") + 11 * F.col("l_linenumber")) % 360 + F.lit(0.25)), "__i": F.radians(F.col("l_suppkey") % 89 + F.lit(0.5)), "__vr": 2 * (F.col("l_discount") - 0.053)})
    r, u, i, vr = (F.col(c) for c in ("__r", "__u", "__i", "__vr"))
    df = df.withColumn("__vt", F.sqrt(F.lit(GM) / r) * (1 + 0.5 * (F.col("l_tax") - 0.021)))
    vt, up = F.col("__vt"), vr * F.sin(u) + F.col("__vt") * F.cos(u)
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("l_suppkey") % 5 + 1).cast("int"))
    pos = (r * F.cos(u), r * F.sin(u) * F.cos(i), r * F.sin(u) * F.sin(i))
    sigmas = dict(zip("uvw", (5 + 250 * F.col("l_discount"), 20 + 1000 * F.col("l_tax"), 10 + F.col("l_extendedprice") / 3000), strict=True))
    return df.select(
        F.col("l_suppkey").alias("satellite_number"),
        F.expr("timestampadd(MILLISECOND, __ms, TIMESTAMP_NTZ '2022-09-01 00:00:00')").alias("epoch_dt"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        *(c.alias(f"{frame}_pos_{n}") for frame in ("j2k", "efg") for n, c in zip("xyz", pos, strict=True)),
        (vr * F.cos(u) - vt * F.sin(u)).alias("j2k_vel_x"), (up * F.cos(i)).alias("j2k_vel_y"), (up * F.sin(i)).alias("j2k_vel_z"),
        *(c.alias(f"vector_{a}_sigma_km") for a, c in sigmas.items()),
        *((c / 1000).alias(f"vector_{a}d_sigma_kms") for a, c in sigmas.items()),
        (F.col("l_extendedprice") / 1e7).alias("ballistic_coef_m2kg"), (F.col("l_tax") / 10).alias("solar_rad_press_coeff_m2kg"),
        (70 + 3 * F.col("l_quantity")).alias("solar_flux_f10"), (70 + 10.0 * F.col("l_linenumber")).alias("average_f10"), (3.0 * F.col("l_linenumber")).alias("average_ap"),
        F.expr("(1661990400000 + __ms) div 5700000").alias("epoch_rev"), name.alias("common_name"),
    )
