"""Errors of states carried on as two-body orbits, and their statistics, as column expressions.

An object's first state is carried to each later snapshot in closed form: with Kepler's equation in the difference of
eccentric anomalies, solved by a fixed number of Newton steps, and the f and g coefficients. No angles are needed, so
that circular and equatorial orbits are like others.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitspark.constants import GM
from orbitspark.functions.features import TIES, by_object, error_altitude_bin, error_regime
from orbitspark.functions.vec import dot, norm, vec
from orbitspark.operators.profile import exact_quantiles
from orbitspark.sources.tables import held

#: Horizons in days with their half widths.
HORIZONS = {"1d": (1.0, 0.5), "3d": (3.0, 1.0), "7d": (7.0, 2.0)}
STATE = [f"j2k_{kind}_{n}" for kind in ("pos", "vel") for n in "xyz"]
NEWTON_STEPS = 10


def carried(df: DataFrame) -> DataFrame:
    """df (first state __j2k_..., seconds since then dt) with the carried position at_x, at_y, at_z; null if unbound or not converged."""
    p, v = vec("__j2k_pos_"), vec("__j2k_vel_")
    df = df.withColumns({"__r": norm(p), "__rv": dot(p, v), "__vv": dot(v, v)})
    df = df.withColumn("__a", F.expr(f"try_divide(1.0D, 2 / __r - __vv / {GM}D)")).withColumn("__a", F.when(F.col("__a") > 0, F.col("__a")))
    a, r = F.col("__a"), F.col("__r")
    df = df.withColumns({"__n": F.sqrt(F.lit(GM) / (a * a * a)), "__ec": 1 - r / a, "__es": F.col("__rv") / F.sqrt(F.lit(GM) * a)})
    turns = F.col("__n") * F.col("dt")
    df = df.withColumn("__m", turns - 2 * math.pi * F.floor(turns / (2 * math.pi)))
    ec, es, m = F.col("__ec"), F.col("__es"), F.col("__m")
    miss = lambda e: e - ec * F.sin(e) + es * (1 - F.cos(e)) - m
    # one expression for all steps: a column for each would be written out again wherever it is used
    step = lambda e, _: e - miss(e) / (1 - ec * F.cos(e) + es * F.sin(e))
    df = df.withColumn("__E", F.aggregate(F.array_repeat(F.lit(0), NEWTON_STEPS), m, step))
    e = F.col("__E")
    f, g = 1 - a / r * (1 - F.cos(e)), (m - (e - F.sin(e))) / F.col("__n")
    good = F.abs(miss(e)) < 1e-9
    made = ["__E", "__r", "__rv", "__vv", "__a", "__n", "__ec", "__es", "__m"]
    return df.withColumns({f"at_{n}": F.when(good, f * x + g * y) for n, x, y in zip("xyz", p, v, strict=True)}).drop(*made)


def residuals(df: DataFrame, most_days: float = 30.0) -> DataFrame:
    """(satellite_number, epoch_dt, alt_km, days, err_km): each snapshot's distance from its object's first state, carried on.

    Snapshots at the first one's second, and those later than most_days, give no rows; alt_km is the first one's perigee.
    """
    w = by_object()
    df = df.withColumns({f"__{c}": F.first(c).over(w) for c in STATE} | {"alt_km": F.first("perigee_alt_km").over(w), "dt": F.timestamp_diff("SECOND", F.first("epoch_dt").over(w), F.col("epoch_dt"))})
    late = carried(df.where((F.col("dt") > 0) & (F.col("dt") <= most_days * 86400)))
    apart = norm(tuple(F.col(f"at_{n}") - F.col(f"j2k_pos_{n}") for n in "xyz"))
    keys = [c for c in df.columns if c in ("satellite_number", "epoch_dt", *TIES)]
    # behind a generator, so that filters on the error aren't pushed into all of the above, written out anew for each use
    return late.select(*keys, "alt_km", (F.col("dt") / 86400.0).alias("days"), F.explode(F.array(apart)).alias("err_km"))


def divergence(errors: DataFrame, far: float = 1e4) -> DataFrame:
    """Per object: days of the first snapshot whose error passes `far` km, null if none does, and the last error."""
    return errors.groupBy("satellite_number").agg(F.min(F.when(F.col("err_km") > far, F.col("days"))).alias("diverged_days"), F.max_by("err_km", F.struct("days", "err_km")).alias("last_err_km"))


def horizon_rows(errors: DataFrame) -> DataFrame:
    """errors with a horizon, for those within one; horizons don't overlap."""
    h = F.lit(None).cast("string")
    for name, (days, half) in HORIZONS.items():
        h = F.when(F.col("days").between(days - half, days + half), name).otherwise(h)
    return errors.withColumn("horizon", h).where("horizon is not null")


def horizon_stats(errors: DataFrame) -> DataFrame:
    e, rows = "err_km", held(horizon_rows(errors).select("horizon", "err_km"))
    out = rows.groupBy("horizon").agg(F.count(e).alias("n"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.min(e).alias("min"), F.max(e).alias("max"))
    qs = exact_quantiles(rows, e, {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}, "horizon")
    return out.join(qs, "horizon", "left").select("horizon", "n", "mean", "median", "std", "p90", "p95", "p99", "min", "max")


def regime_errors(errors: DataFrame) -> DataFrame:
    """1-day errors by orbit regime."""
    day = horizon_rows(errors).where("horizon = '1d'").select(error_regime(F.col("alt_km")).alias("regime"), "err_km").where("regime is not null")
    day = held(day)
    stats = day.groupBy("regime").agg(F.count("*").alias("n"), F.avg("err_km").alias("mean"))
    return stats.join(exact_quantiles(day, "err_km", {"median": 0.5}, "regime"), "regime", "left")


def worst_objects(errors: DataFrame, k: int = 10) -> DataFrame:
    """The k objects of the largest error."""
    return errors.groupBy("satellite_number").agg(F.max("err_km").alias("max_err_km"), F.count("*").alias("n")).orderBy(F.desc("max_err_km"), "satellite_number").limit(k)


def error_pivot(errors: DataFrame) -> DataFrame:
    """A row per object: its altitude and the median error at each horizon, over an object's few snapshots there."""
    wide = horizon_rows(errors).groupBy("satellite_number").pivot("horizon", list(HORIZONS)).agg(F.percentile("err_km", F.lit(0.5)))
    alt = errors.groupBy("satellite_number").agg(F.min("alt_km").alias("alt_km"))
    return wide.join(alt, "satellite_number").select("satellite_number", "alt_km", *(F.col(h).alias(f"err_{h}_km") for h in HORIZONS))


def altitude_bin_errors(errors: DataFrame) -> DataFrame:
    day = held(error_pivot(errors).where("err_1d_km is not null").select(error_altitude_bin(F.col("alt_km")).alias("altitude_bin"), "err_1d_km"))
    stats = day.groupBy("altitude_bin").agg(F.count("*").alias("n"), F.max("err_1d_km").alias("max"))
    return stats.join(exact_quantiles(day, "err_1d_km", {"median": 0.5}, "altitude_bin"), "altitude_bin", "left")


def extreme_objects(errors: DataFrame, k: int = 5) -> DataFrame:
    """The k best and the k worst objects by 1-day error."""
    day = error_pivot(errors).where("err_1d_km is not null").select("satellite_number", "err_1d_km")
    best = day.orderBy("err_1d_km", "satellite_number").limit(k).withColumn("side", F.lit("best"))
    return best.union(day.orderBy(F.desc("err_1d_km"), "satellite_number").limit(k).withColumn("side", F.lit("worst")))


def error_overview(errors: DataFrame) -> DataFrame:
    """One row over all errors: count, mean, median, standard deviation, least and largest, and the mean at one day."""
    rows = held(errors.select("days", "err_km"))
    e, (day, half) = F.col("err_km"), HORIZONS["1d"]
    one = rows.agg(F.count(e).alias("n"), F.avg(e).alias("mean"), F.stddev_samp(e).alias("std"), F.min(e).alias("min"), F.max(e).alias("max"), F.avg(F.when(F.col("days").between(day - half, day + half), e)).alias("mean_1d"))
    return one.crossJoin(exact_quantiles(rows, "err_km", {"median": 0.5}))  # a row each
