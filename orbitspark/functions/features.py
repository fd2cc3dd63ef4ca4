"""Bins, classes and features of a snapshot, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitspark.constants import CD, DENSITY, DENSITY_LOW, DENSITY_TOP, SIZE_10CM_BC, SIZE_25CM_BC
from orbitspark.functions.vec import norm, vec


def altitude_band(alt: Column) -> Column:
    """Six bands; null and NaN fall in the last."""
    out = F.lit("1000+km")
    for high, low in ((1000, 800), (800, 600), (600, 400), (400, 200), (200, None)):
        out = F.when(alt < high, f"{low}-{high}km" if low else "<200km").otherwise(out)
    return out


def orbit_regime(alt: Column) -> Column:
    return F.when(alt < 2000, "LEO").when(alt < 35786, "MEO").otherwise("GEO")


def error_regime(alt: Column) -> Column:
    """Regimes of the error report: half-open ranges; null outside them."""
    return F.when((alt >= 0) & (alt < 2000), "LEO").when((alt >= 2000) & (alt < 20000), "MEO").when((alt >= 20000) & (alt < 50000), "GEO")


def error_altitude_bin(alt: Column) -> Column:
    return F.when(alt < 1000, "<1k").when(alt < 10000, "1-10k").when(alt < 30000, "10-30k").otherwise(">=30k")


def size_range(bc: Column) -> Column:
    return F.when(bc <= SIZE_25CM_BC, "25-50cm").when(bc <= SIZE_10CM_BC, "10-25cm").when(bc.isNotNull(), "5-10cm")


def object_class(name: Column) -> Column:
    """Class from a common name; null and unmatched names are unknown."""
    n = F.upper(F.trim(name))
    has = n.contains
    return (
        F.when(has(" DEB") | n.endswith("DEB") | has("DEB "), "fragmentation_debris")
        .when(has(" R/B") | n.endswith("RB") | n.startswith("R/B"), "rocket_body")
        .when(has(" PL") | n.endswith("PL") | has("PAYLOAD") | has("COSMOS") | has("IRIDIUM") | has("FENGYUN"), "payload")
        .otherwise("unknown")
    )


def density(alt: Column, flux: Column) -> Column:
    """Step density (kg/m^3) times a flux factor held in [0.5, 2]; NaN altitudes give NaN."""
    factor = 1 + 0.2 * (flux - 100) / 100
    factor = F.when(F.isnan(factor), factor).otherwise(F.least(F.greatest(factor, F.lit(0.5)), F.lit(2.0)))
    rho = F.lit(DENSITY_TOP)
    for high, value in reversed(DENSITY):
        rho = F.when(alt < high, value).otherwise(rho)
    return F.when(F.isnan(alt), alt).when(alt < 200, DENSITY_LOW).otherwise(rho * factor)


def size_features() -> dict[str, Column]:
    bc, srp = F.abs("ballistic_coef_m2kg"), F.abs("solar_rad_press_coeff_m2kg")
    return {"bc_abs": bc + 1e-10, "log_bc": F.log10(bc + 1e-10), "bc_to_srp_ratio": bc / (srp + 1e-10), "area_to_mass_ratio_m2kg": (bc + 1e-10) / CD, "log_amr": F.log10((bc + 1e-10) / CD + 1e-10)}


def environment_features() -> dict[str, Column]:
    return {
        "atmospheric_density_kgm3": density(F.col("mean_altitude_km"), F.col("solar_flux_f10")),
        "srp_acceleration_ms2": F.abs("solar_rad_press_coeff_m2kg") * F.col("solar_flux_f10") / 1361.0,
        "kp_index": (F.col("average_ap") + 1) / 10,
    }


def risk_features() -> dict[str, Column]:
    r, t, w = (F.col(f"vector_{x}_sigma_km") for x in "uvw")
    volume = r * t * w
    return {"uncertainty_volume_km3": volume, "log_uncertainty_volume": F.log10(volume + 1e-30), "collision_risk_proxy": volume / (F.col("mean_altitude_km") * F.col("mean_altitude_km") + 1)}


def rtn_products() -> dict[str, Column]:
    r, t, w = (F.col(f"vector_{x}_sigma_km") for x in "uvw")
    total = F.sqrt(r * r + t * t + w * w)
    return {"rtn_covariance_volume_km3": r * t * w, "rtn_along_track_ratio": t / (r + 1e-15), "rtn_cross_track_ratio": w / (r + 1e-15), "rtn_total_uncertainty_km": total, "log_rtn_uncertainty": F.log10(total + 1e-15)}


#: Order of an object's snapshots, with tie-breakers of the adapter's rows.
TIES = ("epoch_dt", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def by_object(*more: str) -> Window:
    return Window.partitionBy("satellite_number", *more).orderBy(*TIES)


def seconds_since(before: Column) -> Column:
    return F.timestamp_diff("SECOND", before, F.col("epoch_dt"))


def with_trends(df: DataFrame) -> DataFrame:
    """Changes since the object's previous snapshot, and since the previous one in its sequence; 0 for the first.

    Both orders are served by one shuffle on the object. Needs sequence_id, semi_major_axis_km.
    """
    obj, seq = by_object(), by_object("sequence_id")
    df = df.withColumn("time_gap_days", F.coalesce(seconds_since(F.lag("epoch_dt").over(obj)) / 86400.0, F.lit(0.0)))
    df = df.withColumn("velocity_magnitude_kms", norm(vec("j2k_vel_")))
    gap = F.col("time_gap_days") + 1e-10
    change = lambda c, w: F.coalesce(c - F.lag(c).over(w), F.lit(0.0))
    moved = [c - F.lag(c).over(seq) for c in vec("j2k_pos_")]
    return df.withColumns({
        "revolution_rate": F.coalesce((F.col("epoch_rev") - F.lag("epoch_rev").over(obj)) / gap, F.lit(0.0)),
        "position_drift_km": F.coalesce(norm(tuple(moved)), F.lit(0.0)),
        "acceleration_kms2": change(F.col("velocity_magnitude_kms"), seq) / (F.col("time_gap_days") * 86400 + 1e-10),
        "uncertainty_trend_r": change(F.col("vector_u_sigma_km"), seq),
        "orbital_decay_trend_kmpday": change(F.col("semi_major_axis_km"), seq) / gap,
        "drag_trend_per_day": change(F.abs("ballistic_coef_m2kg"), seq) / gap,
    })


def finite_or_null(df: DataFrame) -> DataFrame:
    """Infinities of floating columns become null."""
    return df.withColumns({c: F.when(F.abs(c) != float("inf"), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})
