"""Three-dimensional probability-of-presence grid, sparse, without Python on the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitspark.constants import BC_MAX, BC_MIN, GRID_ALT, GRID_LAT, GRID_LON, KM_PER_DEG_LAT, MAX_UNCERTAINTY_KM, MIN_SIGMA_KM, N_SIGMA
from orbitspark.functions.features import TIES
from orbitspark.functions.orbital import with_geodetic
from orbitspark.functions.vec import norm, vec
from orbitspark.sources.tables import held

AXES = {"alt": GRID_ALT, "lat": GRID_LAT, "lon": GRID_LON}


def latest(df: DataFrame) -> DataFrame:
    """Each object's last snapshot.

    Rows of an object's last time are found first, from a written table of objects and times: a maximum that is counted in
    hash tables, and a join that meets the table's raw columns. A max_by of whole rows sorts all of them; here it sees
    only those that share the last time.
    """
    times = held(df.groupBy("satellite_number").agg(F.max("epoch_dt").alias("epoch_dt"))).toDF("__object", "__last")
    last = df.join(times, df["satellite_number"].eqNullSafe(times["__object"]) & df["epoch_dt"].eqNullSafe(times["__last"]), "left_semi")
    rest = [c for c in df.columns if c != "satellite_number"]
    return last.groupBy("satellite_number").agg(F.max_by(F.struct(*rest), F.struct(*TIES)).alias("s")).select("satellite_number", *(F.col(f"s.{c}").alias(c) for c in rest))


def debris(df: DataFrame) -> DataFrame:
    """Rows with total sigma under 100 km, coefficient in [0.0006, 0.02], and altitude in [200, 2000] km; adds geodetic columns."""
    total = norm(vec("vector_", "uvw", "_sigma_km"))
    near = with_geodetic(df.where((total < MAX_UNCERTAINTY_KM) & F.col("ballistic_coef_m2kg").between(BC_MIN, BC_MAX)))
    return near.where(F.col("altitude_km").between(200, 2000))


def with_grid_sigmas(df: DataFrame) -> DataFrame:
    least = MIN_SIGMA_KM / KM_PER_DEG_LAT
    cos = F.greatest(F.cos(F.radians("latitude_deg")), F.lit(0.017))
    return df.withColumns({
        "sig_alt": F.greatest(F.col("vector_u_sigma_km"), F.lit(MIN_SIGMA_KM)),
        "sig_lat": F.greatest(F.col("vector_w_sigma_km") / KM_PER_DEG_LAT, F.lit(least)),
        "sig_lon": F.greatest(F.col("vector_v_sigma_km") / (KM_PER_DEG_LAT * cos), F.lit(least)),
    })


def voxel(value: Column, axis: str) -> Column:
    """Index of the first centre at or above a value, held in range."""
    first, step, n = AXES[axis]
    return F.least(F.greatest(F.ceil((value - first) / step), F.lit(0)), F.lit(n - 1)).cast("int")


def centre(index: Column, axis: str) -> Column:
    first, step, _ = AXES[axis]
    return first + step * index


def grid(df: DataFrame) -> DataFrame:
    """(alt_i, lat_i, lon_i, pop): the sum over objects of exp(-d^2/2) at the centres within 3 sigma on each axis."""
    position = {"alt": F.col("altitude_km"), "lat": F.col("latitude_deg"), "lon": F.col("longitude_deg")}
    cells = df
    for axis, at in position.items():
        reach = N_SIGMA * F.col(f"sig_{axis}")
        cells = cells.withColumn(f"{axis}_i", F.explode(F.sequence(voxel(at - reach, axis), voxel(at + reach, axis))))
    z = {axis: (centre(F.col(f"{axis}_i"), axis) - at) / F.col(f"sig_{axis}") for axis, at in position.items()}
    return cells.withColumn("p", F.exp(-(z["alt"] * z["alt"] + z["lat"] * z["lat"] + z["lon"] * z["lon"]) / 2)).groupBy("alt_i", "lat_i", "lon_i").agg(F.sum("p").alias("pop"))


def normalised(cells: DataFrame) -> DataFrame:
    """pop divided by the grid's largest, with centres. The grid has at most 583,200 cells, whatever the input."""
    top = cells.agg(F.max("pop").alias("top"))
    out = cells.crossJoin(F.broadcast(top)).withColumn("pop", F.when(F.col("top") > 0, F.col("pop") / F.col("top")).otherwise(F.col("pop"))).drop("top")
    return out.withColumns({f"{a}_center": centre(F.col(f"{a}_i"), a) for a in AXES})


def marginals(cells: DataFrame) -> DataFrame:
    """Global map (sum over altitude) and altitude profile in one pass of grouping sets; level names which."""
    sets = cells.groupingSets([["alt_i"], ["lat_i", "lon_i"]], "alt_i", "lat_i", "lon_i").agg(F.sum("pop").alias("pop"), F.grouping_id().alias("g"))
    return sets.select(F.when(F.col("alt_i").isNotNull(), "altitude").otherwise("map").alias("level"), "alt_i", "lat_i", "lon_i", "pop")


def hottest_shell(cells: DataFrame) -> DataFrame:
    shells = cells.groupBy("alt_i").agg(F.sum("pop").alias("pop"))
    return shells.agg(F.max_by("alt_i", F.struct("pop", "alt_i")).alias("alt_i"), F.max("pop").alias("pop"))
