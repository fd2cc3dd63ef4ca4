"""Local frames, orbital elements, geodetic coordinates and J2 acceleration, as native expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitspark.constants import GM, J2, R_EARTH, WGS84_A, WGS84_B, WGS84_E2, WGS84_EP2
from orbitspark.functions.vec import clipped, cross, dot, floored_norm, norm, scaled, vec

TWO_PI = 2 * math.pi


def with_rtn(df: DataFrame) -> DataFrame:
    """Radial, transverse and normal axes, position and velocity along them, and sigmas named by them."""
    r, v = vec("j2k_pos_"), vec("j2k_vel_")
    w = cross(r, v)
    step = df.withColumns({f"rtn_R{n}": c for n, c in zip("xyz", scaled(r, floored_norm(r)), strict=True)} | {f"rtn_W{n}": c for n, c in zip("xyz", scaled(w, floored_norm(w)), strict=True)})
    t = cross(vec("rtn_W"), vec("rtn_R"))
    step = step.withColumns({f"rtn_T{n}": c for n, c in zip("xyz", scaled(t, floored_norm(t)), strict=True)})
    along = {f"rtn_{kind}_{axis.lower()}_{unit}": dot(x, vec(f"rtn_{axis}")) for kind, x, unit in (("pos", r, "km"), ("vel", v, "kms")) for axis in "RTW"}
    sigmas = {f"rtn_sigma_{a}_km": F.col(f"vector_{u}_sigma_km") for a, u in zip("rtw", "uvw", strict=True)} | {f"rtn_sig_vel_{a}_kms": F.col(f"vector_{u}d_sigma_kms") for a, u in zip("rtw", "uvw", strict=True)}
    return step.withColumns(along | sigmas)


def frame_errors(df: DataFrame) -> DataFrame:
    """One row: the largest deviations of the axes from an orthonormal right-handed frame, over all rows."""
    r, t, w = vec("rtn_R"), vec("rtn_T"), vec("rtn_W")
    pos, rtn = vec("j2k_pos_"), vec("rtn_pos_", "rtw", "_km")
    checks = {
        "max_r_dot_t": dot(r, t), "max_r_dot_w": dot(r, w), "max_t_dot_w": dot(t, w), "max_r_norm": norm(r) - 1, "max_t_norm": norm(t) - 1, "max_w_norm": norm(w) - 1,
        "max_det": dot(r, cross(t, w)) - 1, "max_magnitude": norm(rtn) / norm(pos) - 1, "max_sigma": F.col("rtn_sigma_r_km") - F.col("vector_u_sigma_km"),
    }
    return df.agg(*(F.max(F.abs(c)).alias(n) for n, c in checks.items()), F.count("*").alias("n_rows"))


def wrapped(x: Column) -> Column:
    return F.pmod(x, F.lit(TWO_PI))


def with_elements(df: DataFrame) -> DataFrame:
    """Keplerian elements of each state; unbound states have a NaN semi-major axis."""
    r, v = vec("j2k_pos_"), vec("j2k_vel_")
    names = [f"__{x}" for x in ("r", "v", "rv", "hx", "hy", "hz", "h", "en", "ex", "ey", "ez", "e", "n")]
    h = cross(r, v)
    df = df.withColumns({"__r": norm(r), "__v": norm(v), "__rv": dot(r, v), "__hx": h[0], "__hy": h[1], "__hz": h[2]})
    rm, vm, rv = F.col("__r"), F.col("__v"), F.col("__rv")
    h = vec("__h")
    factor = vm * vm - F.lit(GM) / rm
    df = df.withColumns({"__h": norm(h), "__en": vm * vm / 2 - F.lit(GM) / rm, "__n": F.sqrt(h[0] * h[0] + h[1] * h[1])} | {f"__e{n}": (factor * a - rv * b) / GM for n, a, b in zip("xyz", r, v, strict=True)})
    e = vec("__e")
    df = df.withColumns({"__e": clipped(norm(e), 0.0, 0.999)})
    hm, nm, em = F.col("__h"), F.col("__n"), F.col("__e")
    a = F.when(F.col("__en") < 0, F.lit(-GM) / (2 * F.col("__en"))).otherwise(F.lit(float("nan")))
    # the node vector is (-h_y, h_x, 0)
    node = -h[1] * e[0] + h[0] * e[1]
    arg = F.acos(clipped(F.try_divide(node, nm * em), -1.0, 1.0))
    nu = F.acos(clipped(F.try_divide(dot(e, r), em * rm), -1.0, 1.0))
    df = df.withColumns({
        "semi_major_axis_km": a, "eccentricity": em, "inclination_deg": F.degrees(F.acos(clipped(h[2] / hm, -1.0, 1.0))),
        "raan_deg": F.degrees(wrapped(F.when(nm < 1e-10, 0.0).otherwise(F.atan2(h[0], -h[1])))),
        "arg_perigee_deg": F.degrees(wrapped(F.when(e[2] < 0, TWO_PI - arg).otherwise(arg))),
        "true_anomaly_deg": F.degrees(wrapped(F.when(rv > 0, nu).otherwise(TWO_PI - nu))),
    })
    a = F.col("semi_major_axis_km")
    return df.withColumns({"perigee_alt_km": a * (1 - em) - R_EARTH, "apogee_alt_km": a * (1 + em) - R_EARTH, "orbital_period_min": TWO_PI * F.sqrt(a * a * a / GM) / 60}).drop(*names)


def element_checks(df: DataFrame) -> DataFrame:
    """One row: the largest vis-viva error and the numbers of elements out of range."""
    r, v = vec("j2k_pos_"), vec("j2k_vel_")
    a, rm = F.col("semi_major_axis_km"), norm(r)
    expected = F.lit(GM) * (2 / rm - 1 / a)
    alt = rm - R_EARTH
    return df.agg(
        F.max(F.abs(dot(v, v) / expected - 1)).alias("max_vis_viva"),
        F.count_if((F.col("eccentricity") < 0) | (F.col("eccentricity") >= 1)).alias("bad_eccentricity"),
        F.count_if(~F.col("inclination_deg").between(0, 180)).alias("bad_inclination"),
        *(F.count_if((F.col(f"{c}_deg") < 0) | (F.col(f"{c}_deg") >= 360)).alias(f"bad_{c}") for c in ("raan", "arg_perigee", "true_anomaly")),
        F.count_if(F.col("perigee_alt_km") > alt + 100).alias("bad_perigee"),
        F.count_if(~((F.col("orbital_period_min") > 80) & (F.col("orbital_period_min") < 1500))).alias("bad_period"),
    )


def altitudes_from_mean_motion(rev_per_day: Column, eccentricity: Column) -> dict[str, Column]:
    n = rev_per_day * (TWO_PI / 86400.0)
    a = F.pow(F.lit(GM) / (n * n), F.lit(1.0 / 3.0))
    return {"perigee_alt_km": a * (1 - eccentricity) - R_EARTH, "apogee_alt_km": a * (1 + eccentricity) - R_EARTH, "mean_alt_km": a - R_EARTH}


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: a filter on the result, pushed below, then holds it once too."""
    return F.transform(F.array(value), use)[0]


def with_geodetic(df: DataFrame) -> DataFrame:
    """WGS-84 latitude_deg, longitude_deg and altitude_km of Earth-fixed positions: three rounds of Bowring's iteration."""
    x, y, z = vec("efg_pos_")
    p = F.sqrt(x * x + y * y)
    cube = lambda c: let(c, lambda v: v * v * v)

    def latitude(t: Column) -> Column:
        return F.atan2(z + WGS84_EP2 * WGS84_B * cube(F.sin(t)), p - WGS84_E2 * WGS84_A * cube(F.cos(t)))

    def round_of(t: Column) -> Column:
        return let(latitude(t), lambda v: F.atan2(F.sin(v) * WGS84_B, F.cos(v) * WGS84_A))

    lat = let(let(let(F.atan2(z * WGS84_A, p * WGS84_B), round_of), round_of), latitude)

    def altitude(v: Column) -> Column:
        n = F.lit(WGS84_A) / F.sqrt(1 - WGS84_E2 * F.sin(v) * F.sin(v))
        return F.when(F.abs(v) < math.radians(89.9), p / F.cos(v) - n).otherwise(F.abs(z) / F.abs(F.sin(v)) - n * (1 - WGS84_E2))

    return df.withColumns({"latitude_deg": F.degrees(lat), "longitude_deg": F.degrees(F.atan2(y, x)), "altitude_km": let(lat, altitude)})


def j2_acceleration(prefix: str = "j2k_pos_") -> dict[str, Column]:
    """Two-body and J2 acceleration (km/s^2) of a position."""
    x, y, z = r = vec(prefix)
    rm = norm(r)
    f = -1.5 * J2 * GM * R_EARTH**2 / F.pow(rm, F.lit(5.0))
    q = 5 * z * z / (rm * rm)
    return {f"acc_{n}": -GM * c / (rm * rm * rm) + f * c * (k - q) for n, c, k in (("x", x, 1), ("y", y, 1), ("z", z, 3))}
