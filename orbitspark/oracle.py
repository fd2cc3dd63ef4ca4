"""SQL for the queries, over the same tables, for DuckDB."""

from __future__ import annotations

from orbitspark.constants import CD, DENSITY, DENSITY_LOW, DENSITY_TOP, GM, J2, KM_PER_DEG_LAT, R_EARTH, WGS84_A, WGS84_B, WGS84_E2, WGS84_EP2

KEY = "satellite_number, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
TIES = "epoch_dt, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
PROFILED = ["ballistic_coef_m2kg", "solar_rad_press_coeff_m2kg", "vector_u_sigma_km", "vector_v_sigma_km", "vector_w_sigma_km", "solar_flux_f10"]
FEATURES = ["ballistic_coef_m2kg", "perigee_alt_km", "inclination_deg", "eccentricity", "vector_u_sigma_km", "vector_v_sigma_km", "vector_w_sigma_km", "solar_flux_f10", "average_ap", "log_bc"]

#: Newton steps for Kepler's equation.
NEWTON = " ".join(f"k{i + 1} AS (SELECT *, e{i} - (e{i} - ec * sin(e{i}) + es * (1 - cos(e{i})) - m) / (1 - ec * cos(e{i}) + es * sin(e{i})) AS e{i + 1} FROM k{i})," for i in range(10))

BASE = f"""
raw AS (
  SELECT *, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) * 8640000 + (l_orderkey % 8640) * 1000 + l_linenumber + 500 AS ms,
    {R_EARTH} + 250 + 32 * l_quantity AS r0, radians((37 * l_orderkey + 11 * l_linenumber) % 360 + 0.25::DOUBLE) AS u, radians(l_suppkey % 89 + 0.5::DOUBLE) AS i,
    2 * (l_discount - 0.053::DOUBLE) AS vr
  FROM lineitem),
raw2 AS (SELECT *, sqrt({GM}::DOUBLE / r0) * (1 + 0.5::DOUBLE * (l_tax - 0.021::DOUBLE)) AS vt FROM raw),
obs AS (
  SELECT l_suppkey AS satellite_number, TIMESTAMP '2022-09-01' + to_milliseconds(ms) AS epoch_dt, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
    r0 * cos(u) AS x, r0 * sin(u) * cos(i) AS y, r0 * sin(u) * sin(i) AS z,
    vr * cos(u) - vt * sin(u) AS vx, (vr * sin(u) + vt * cos(u)) * cos(i) AS vy, (vr * sin(u) + vt * cos(u)) * sin(i) AS vz,
    5 + 250 * l_discount AS vector_u_sigma_km, 20 + 1000 * l_tax AS vector_v_sigma_km, 10 + l_extendedprice / 3000 AS vector_w_sigma_km,
    l_extendedprice / 1e7 AS ballistic_coef_m2kg, l_tax / 10 AS solar_rad_press_coeff_m2kg, 70 + 3 * l_quantity AS solar_flux_f10,
    3.0::DOUBLE * l_linenumber AS average_ap, ((1661990400000 + ms) // 5700000)::BIGINT AS epoch_rev,
    ['COSMOS 2251 DEB', 'SL-16 R/B', 'IRIDIUM 33', 'TEST PL', 'OBJECT A'][(l_suppkey % 5 + 1)::INTEGER] AS common_name
  FROM raw2),
obs1 AS (
  SELECT *, sqrt(x * x + y * y + z * z) AS r, sqrt(vx * vx + vy * vy + vz * vz) AS v, x * vx + y * vy + z * vz AS rv,
    y * vz - z * vy AS hx, z * vx - x * vz AS hy, x * vy - y * vx AS hz FROM obs),
obs2 AS (
  SELECT *, sqrt(hx * hx + hy * hy + hz * hz) AS h, sqrt(hx * hx + hy * hy) AS nn, v * v / 2 - {GM} / r AS en,
    ((v * v - {GM} / r) * x - rv * vx) / {GM} AS ex, ((v * v - {GM} / r) * y - rv * vy) / {GM} AS ey, ((v * v - {GM} / r) * z - rv * vz) / {GM} AS ez FROM obs1),
obs3 AS (
  SELECT *, least(greatest(sqrt(ex * ex + ey * ey + ez * ez), 0), 0.999::DOUBLE) AS eccentricity, -{GM} / (2 * en) AS semi_major_axis_km FROM obs2),
obs4 AS (
  SELECT *, acos(least(greatest((hx * ey - hy * ex) / (nn * eccentricity), -1), 1)) AS arg0,
    acos(least(greatest((ex * x + ey * y + ez * z) / (eccentricity * r), -1), 1)) AS nu0 FROM obs3),
el AS (
  SELECT *, degrees(acos(least(greatest(hz / h, -1), 1))) AS inclination_deg,
    degrees(CASE WHEN atan2(hx, -hy) < 0 AND atan2(hx, -hy) + 2 * pi() < 2 * pi() THEN atan2(hx, -hy) + 2 * pi() ELSE greatest(atan2(hx, -hy), 0) END) AS raan_deg,
    degrees(CASE WHEN ez < 0 THEN 2 * pi() - arg0 ELSE arg0 END) AS arg_perigee_deg, degrees(CASE WHEN rv > 0 THEN nu0 ELSE 2 * pi() - nu0 END) AS true_anomaly_deg,
    semi_major_axis_km * (1 - eccentricity) - {R_EARTH} AS perigee_alt_km, semi_major_axis_km * (1 + eccentricity) - {R_EARTH} AS apogee_alt_km,
    2 * pi() * sqrt(semi_major_axis_km * semi_major_axis_km * semi_major_axis_km / {GM}) / 60 AS orbital_period_min FROM obs4),
band AS (
  SELECT *, (perigee_alt_km + apogee_alt_km) / 2 AS mean_altitude_km,
    CASE WHEN perigee_alt_km < 200 THEN '<200km' WHEN perigee_alt_km < 400 THEN '200-400km' WHEN perigee_alt_km < 600 THEN '400-600km' WHEN perigee_alt_km < 800 THEN '600-800km' WHEN perigee_alt_km < 1000 THEN '800-1000km' ELSE '1000+km' END AS altitude_band,
    vector_u_sigma_km * vector_v_sigma_km * vector_w_sigma_km AS volume, log10(vector_u_sigma_km * vector_v_sigma_km * vector_w_sigma_km + 1e-30) AS log_volume,
    log10(ballistic_coef_m2kg + 1e-10) AS log_bc,
    CASE WHEN ballistic_coef_m2kg <= 0.00244 THEN '25-50cm' WHEN ballistic_coef_m2kg <= 0.0061 THEN '10-25cm' ELSE '5-10cm' END AS row_size FROM el),
seq AS (SELECT *, row_number() OVER (PARTITION BY satellite_number ORDER BY {TIES}) - 1 AS epoch_idx FROM band),
seqs AS (SELECT *, epoch_idx // 20 AS sequence_id, (epoch_idx % 20)::INTEGER AS seq_pos, count(*) OVER (PARTITION BY satellite_number, epoch_idx // 20) AS seq_len FROM seq),
whole AS (SELECT * FROM seqs WHERE seq_len = 20),
first AS (SELECT satellite_number, sequence_id, min(epoch_dt) AS e0, arg_min(ballistic_coef_m2kg, epoch_idx) AS seq_bc FROM whole GROUP BY ALL),
firsts AS (SELECT *, CASE WHEN seq_bc <= 0.00244 THEN '25-50cm' WHEN seq_bc <= 0.0061 THEN '10-25cm' ELSE '5-10cm' END AS size_range FROM first),
medians AS (SELECT satellite_number, median(epoch_us(e0)::DOUBLE) AS m FROM firsts GROUP BY 1),
ranks AS (SELECT *, row_number() OVER (ORDER BY m, satellite_number) - 1 AS sat_rank, count(*) OVER () AS n_sats FROM medians),
splits AS (SELECT satellite_number, m, sat_rank, CASE WHEN sat_rank / n_sats < 0.7::DOUBLE THEN 'train' WHEN sat_rank / n_sats < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split FROM ranks),
parted AS (SELECT w.*, f.size_range, f.seq_bc, s.split FROM whole w JOIN firsts f USING (satellite_number, sequence_id) JOIN splits s USING (satellite_number)),
limits AS (SELECT altitude_band, quantile_cont(log_volume, 0.7) AS threshold, quantile_cont(log_volume, 0.9) AS secondary, count(*) AS n_rows FROM band GROUP BY 1),
marked AS (SELECT b.*, log_volume > threshold AS collision_risk FROM band b JOIN limits USING (altitude_band)),
parted_limits AS (SELECT size_range, altitude_band, quantile_cont(log_volume, 0.7) AS threshold FROM parted GROUP BY ALL),
parted_marked AS (
  SELECT p.*, log_volume > threshold AS collision_risk, lead(p.epoch_dt) OVER w IS NOT NULL AS has_future, row_number() OVER w AS i
  FROM parted p JOIN parted_limits USING (size_range, altitude_band) WINDOW w AS (PARTITION BY satellite_number, size_range ORDER BY {TIES})),
ev AS (SELECT user_id AS satellite_number, ts AS epoch_dt, event_id FROM events),
ev_counts AS (SELECT satellite_number, count(*) AS n FROM ev GROUP BY 1),
ev_gaps AS (SELECT * FROM (SELECT satellite_number, date_sub('second', lag(epoch_dt) OVER (PARTITION BY satellite_number ORDER BY epoch_dt, event_id), epoch_dt) / 86400.0::DOUBLE AS g FROM ev) WHERE g IS NOT NULL),
last_obs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY satellite_number ORDER BY epoch_dt DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rn FROM obs) WHERE rn = 1),
geo0 AS (SELECT *, sqrt(x * x + y * y) AS p, atan2(z * {WGS84_A}, sqrt(x * x + y * y) * {WGS84_B}) AS t0 FROM {{geo_from}}),
geo1 AS (SELECT *, atan2(z + {WGS84_EP2 * WGS84_B} * sin(t0) ** 3, p - {WGS84_E2 * WGS84_A} * cos(t0) ** 3) AS lat1 FROM geo0),
geo2 AS (SELECT *, atan2(sin(lat1) * {WGS84_B}, cos(lat1) * {WGS84_A}) AS t1 FROM geo1),
geo3 AS (SELECT *, atan2(z + {WGS84_EP2 * WGS84_B} * sin(t1) ** 3, p - {WGS84_E2 * WGS84_A} * cos(t1) ** 3) AS lat2 FROM geo2),
geo4 AS (SELECT *, atan2(sin(lat2) * {WGS84_B}, cos(lat2) * {WGS84_A}) AS t2 FROM geo3),
geo5 AS (SELECT *, atan2(z + {WGS84_EP2 * WGS84_B} * sin(t2) ** 3, p - {WGS84_E2 * WGS84_A} * cos(t2) ** 3) AS lat FROM geo4),
geo AS (
  SELECT *, degrees(lat) AS latitude_deg, degrees(atan2(y, x)) AS longitude_deg,
    CASE WHEN abs(lat) < radians(89.9::DOUBLE) THEN p / cos(lat) - {WGS84_A} / sqrt(1 - {WGS84_E2} * sin(lat) * sin(lat))
      ELSE abs(z) / abs(sin(lat)) - {WGS84_A} / sqrt(1 - {WGS84_E2} * sin(lat) * sin(lat)) * (1 - {WGS84_E2}) END AS altitude_km FROM geo5),
near AS (
  SELECT *, greatest(vector_u_sigma_km, 0.001) AS sa, greatest(vector_w_sigma_km / {KM_PER_DEG_LAT}, 0.001 / {KM_PER_DEG_LAT}) AS sl,
    greatest(vector_v_sigma_km / ({KM_PER_DEG_LAT} * greatest(cos(radians(latitude_deg)), 0.017)), 0.001 / {KM_PER_DEG_LAT}) AS so
  FROM geo WHERE sqrt(vector_u_sigma_km ** 2 + vector_v_sigma_km ** 2 + vector_w_sigma_km ** 2) < 100 AND ballistic_coef_m2kg BETWEEN 0.0006 AND 0.02 AND altitude_km BETWEEN 200 AND 2000),
axes AS (
  SELECT *, unnest(range(least(greatest(ceil((altitude_km - 3 * sa - 225) / 50), 0), 35)::INTEGER, least(greatest(ceil((altitude_km + 3 * sa - 225) / 50), 0), 35)::INTEGER + 1)) AS alt_i FROM near),
axes2 AS (SELECT *, unnest(range(least(greatest(ceil((latitude_deg - 3 * sl + 89) / 2), 0), 89)::INTEGER, least(greatest(ceil((latitude_deg + 3 * sl + 89) / 2), 0), 89)::INTEGER + 1)) AS lat_i FROM axes),
axes3 AS (SELECT *, unnest(range(least(greatest(ceil((longitude_deg - 3 * so + 179) / 2), 0), 179)::INTEGER, least(greatest(ceil((longitude_deg + 3 * so + 179) / 2), 0), 179)::INTEGER + 1)) AS lon_i FROM axes2),
cells AS (
  SELECT alt_i::INTEGER AS alt_i, lat_i::INTEGER AS lat_i, lon_i::INTEGER AS lon_i,
    sum(exp(-(((225 + 50.0 * alt_i - altitude_km) / sa) ** 2 + ((-89 + 2.0 * lat_i - latitude_deg) / sl) ** 2 + ((-179 + 2.0 * lon_i - longitude_deg) / so) ** 2) / 2)) AS pop FROM axes3 GROUP BY ALL),
sup AS (
  SELECT s_name || CASE WHEN s_nationkey % 2 = 0 THEN ' DEB' ELSE ' R/B' END AS name, '1993-036' || s_suppkey AS oid, s_suppkey AS id, 12 + 0.15::DOUBLE * s_nationkey AS mm, 0.001::DOUBLE * (1 + s_nationkey % 7) AS ecc, 'event' || (s_nationkey % 3) AS src
  FROM supplier WHERE s_nationkey % 3 < 2),
cat AS (SELECT name, id, src, power({GM} / power(mm * (2 * pi() / 86400.0), 2), 1.0::DOUBLE / 3) - {R_EARTH} AS mean_alt FROM sup),
fs AS (
  SELECT satellite_number, epoch_dt, l_orderkey, l_linenumber, l_partkey, l_extendedprice, x, y, z, date_sub('second', first_value(epoch_dt) OVER w, epoch_dt) AS dt, first_value(perigee_alt_km) OVER w AS alt_km,
    {", ".join(f"first_value({c}) OVER w AS {c}0" for c in ("x", "y", "z", "vx", "vy", "vz"))} FROM el WINDOW w AS (PARTITION BY satellite_number ORDER BY {TIES})),
fs1 AS (SELECT *, sqrt(x0 * x0 + y0 * y0 + z0 * z0) AS r0, x0 * vx0 + y0 * vy0 + z0 * vz0 AS rv0, vx0 * vx0 + vy0 * vy0 + vz0 * vz0 AS vv0 FROM fs WHERE dt > 0 AND dt <= 30 * 86400),
fs2 AS (SELECT *, 1.0::DOUBLE / (2 / r0 - vv0 / {GM}::DOUBLE) AS a0 FROM fs1),
fs3 AS (SELECT *, sqrt({GM}::DOUBLE / (a0 * a0 * a0)) AS n0, 1 - r0 / a0 AS ec, rv0 / sqrt({GM}::DOUBLE * a0) AS es FROM fs2 WHERE a0 > 0),
k0 AS (SELECT *, n0 * dt - 2 * pi() * floor(n0 * dt / (2 * pi())) AS m, n0 * dt - 2 * pi() * floor(n0 * dt / (2 * pi())) AS e0 FROM fs3),
{NEWTON}
fg AS (SELECT *, 1 - a0 / r0 * (1 - cos(e10)) AS f, (m - (e10 - sin(e10))) / n0 AS g FROM k10),
errs AS (
  SELECT satellite_number, epoch_dt, l_orderkey, l_linenumber, l_partkey, l_extendedprice, alt_km, dt / 86400.0::DOUBLE AS days,
    sqrt((f * x0 + g * vx0 - x) ** 2 + (f * y0 + g * vy0 - y) ** 2 + (f * z0 + g * vz0 - z) ** 2) AS err_km FROM fg),
hor AS (SELECT *, CASE WHEN days BETWEEN 6.5 - 1.5 AND 9 THEN '7d' WHEN days BETWEEN 2 AND 4 THEN '3d' WHEN days BETWEEN 0.5 AND 1.5 THEN '1d' END AS horizon FROM errs),
hors AS (SELECT * FROM hor WHERE horizon IS NOT NULL),
wide AS (
  SELECT satellite_number, min(alt_km) AS alt_km, median(err_km) FILTER (WHERE days BETWEEN 0.5 AND 1.5) AS e1, median(err_km) FILTER (WHERE days BETWEEN 2 AND 4) AS e3, median(err_km) FILTER (WHERE days BETWEEN 5 AND 9) AS e7 FROM errs GROUP BY 1),
wides AS (SELECT w.* FROM wide w WHERE e1 IS NOT NULL OR e3 IS NOT NULL OR e7 IS NOT NULL),
scored AS (SELECT collision_risk::INTEGER AS label, round(l_extendedprice / 1100, 0) / 100 AS score FROM marked)
"""


def sql(select: str, geo_from: str = "obs") -> str:
    return "WITH " + BASE.replace("{geo_from}", geo_from).strip() + "\n" + select.strip()  # a select that begins with a comma adds tables


def z(e: str) -> str:
    """e without a negative zero."""
    return f"CASE WHEN {e} = 0 THEN 0.0::DOUBLE ELSE {e} END"


def r(digits: int, *columns: str) -> str:
    return ", ".join(z(f"round({c}, {digits})") + f" AS {c}" for c in columns)


def slog(c: str) -> str:
    return z(f"round(sign({c}) * log10(1 + abs({c})), 4)") + f" AS {c}"


DENSITY_CASE = "CASE " + " ".join(f"WHEN mean_altitude_km < {h} THEN {v}::DOUBLE" for h, v in DENSITY) + f" ELSE {DENSITY_TOP}::DOUBLE END"
RHO = f"CASE WHEN mean_altitude_km < 200 THEN {DENSITY_LOW}::DOUBLE ELSE ({DENSITY_CASE}) * least(greatest(1 + 0.2::DOUBLE * (solar_flux_f10 - 100) / 100, 0.5), 2) END"
CLASS = """CASE WHEN {n} LIKE '% DEB%' OR {n} LIKE '%DEB' OR {n} LIKE '%DEB %' THEN 'fragmentation_debris' WHEN {n} LIKE '% R/B%' OR {n} LIKE '%RB' OR {n} LIKE 'R/B%' THEN 'rocket_body'
  WHEN {n} LIKE '% PL%' OR {n} LIKE '%PL' OR {n} LIKE '%PAYLOAD%' OR {n} LIKE '%COSMOS%' OR {n} LIKE '%IRIDIUM%' OR {n} LIKE '%FENGYUN%' THEN 'payload' ELSE 'unknown' END"""
EPOCH_BIN = "CASE WHEN n >= 50 THEN '50+' WHEN n >= 20 THEN '20-50' WHEN n >= 10 THEN '10-20' WHEN n >= 5 THEN '5-10' WHEN n >= 2 THEN '2-5' ELSE '1' END"
BC, SRP = "ballistic_coef_m2kg", "solar_rad_press_coeff_m2kg"
OBJ = f"PARTITION BY satellite_number ORDER BY {TIES}"
SEQ = f"PARTITION BY satellite_number, sequence_id ORDER BY {TIES}"
GRID = "last_obs"
#: Features in the model's order, and what they are in SQL over TRENDS.
MATRIX = {
    "bc_abs": f"{BC} + 1e-10", "log_bc": "log_bc", "bc_to_srp_ratio": f"{BC} / ({SRP} + 1e-10)", "area_to_mass_ratio_m2kg": f"({BC} + 1e-10) / {CD}", "log_amr": f"log10(({BC} + 1e-10) / {CD} + 1e-10)", "size_range": "dense_rank() OVER (ORDER BY size_range) - 1",
    "mean_altitude_km": "mean_altitude_km", "perigee_alt_km": "perigee_alt_km", "apogee_alt_km": "apogee_alt_km", "inclination_deg": "inclination_deg", "eccentricity": "eccentricity", "semi_major_axis_km": "semi_major_axis_km", "raan_deg": "least(raan_deg, 360 - raan_deg)",
    "arg_perigee_deg": "arg_perigee_deg", "true_anomaly_deg": "true_anomaly_deg", "orbital_period_min": "orbital_period_min", "altitude_band": "dense_rank() OVER (ORDER BY altitude_band) - 1", "orbit_regime": "dense_rank() OVER (ORDER BY CASE WHEN mean_altitude_km < 2000 THEN 'LEO' WHEN mean_altitude_km < 35786 THEN 'MEO' ELSE 'GEO' END) - 1",
    "vector_u_sigma_km": "vector_u_sigma_km", "vector_v_sigma_km": "vector_v_sigma_km", "vector_w_sigma_km": "vector_w_sigma_km", "rtn_covariance_volume_km3": "volume", "rtn_along_track_ratio": "vector_v_sigma_km / (vector_u_sigma_km + 1e-15)", "rtn_cross_track_ratio": "vector_w_sigma_km / (vector_u_sigma_km + 1e-15)",
    "rtn_total_uncertainty_km": "sqrt(vector_u_sigma_km ** 2 + vector_v_sigma_km ** 2 + vector_w_sigma_km ** 2)", "log_rtn_uncertainty": "log10(sqrt(vector_u_sigma_km ** 2 + vector_v_sigma_km ** 2 + vector_w_sigma_km ** 2) + 1e-15)",
    "time_gap_days": "g", "revolution_rate": "coalesce(drev / (g + 1e-10), 0)", "position_drift_km": "coalesce(drift, 0)", "velocity_magnitude_kms": "v", "acceleration_kms2": "coalesce(dv, 0) / (g * 86400 + 1e-10)", "uncertainty_trend_r": "coalesce(du, 0)",
    "orbital_decay_trend_kmpday": "coalesce(da, 0) / (g + 1e-10)", "drag_trend_per_day": "coalesce(dbc, 0) / (g + 1e-10)",
    "solar_flux_f10": "solar_flux_f10", "average_f10": "70 + 10.0::DOUBLE * l_linenumber", "kp_index": "(average_ap + 1) / 10", "atmospheric_density_kgm3": RHO, "srp_acceleration_ms2": f"{SRP} * solar_flux_f10 / 1361", "uncertainty_volume_km3": "volume", "log_uncertainty_volume": "log_volume",
}


def trends(table: str) -> str:
    return f"""SELECT *, coalesce(date_sub('second', lag(epoch_dt) OVER o, epoch_dt) / 86400.0::DOUBLE, 0) AS g, epoch_rev - lag(epoch_rev) OVER o AS drev, v - lag(v) OVER s AS dv,
      sqrt((x - lag(x) OVER s) ** 2 + (y - lag(y) OVER s) ** 2 + (z - lag(z) OVER s) ** 2) AS drift, vector_u_sigma_km - lag(vector_u_sigma_km) OVER s AS du,
      semi_major_axis_km - lag(semi_major_axis_km) OVER s AS da, {BC} - lag({BC}) OVER s AS dbc FROM {table} WINDOW o AS ({OBJ}), s AS ({SEQ})"""


#: Snapshots of complete sequences with the features as floats.
FEATURED = f""", trend AS ({trends("parted")}),
feat AS MATERIALIZED (SELECT {KEY}, epoch_dt, size_range AS size_name, split, {", ".join(f"({e})::FLOAT::DOUBLE AS f_{c}" for c, e in MATRIX.items())} FROM trend)"""
OWN = f"PARTITION BY satellite_number, size_name ORDER BY {TIES}"
SHOWN = ["size_range", "altitude_band", "orbit_regime", "perigee_alt_km", "log_bc", "kp_index", "time_gap_days"]

#: What messages say of a snapshot, by column.
MESSAGE = {
    "message_type": "'SP VECTOR/COVARIANCE MESSAGE - V2.0'", "message_time_utc": "'MESSAGE TIME UTC'", "center": "'CENTER'", "satellite_number": "satellite_number", "int_des": "'INT DES'", "common_name": "common_name", "epoch_rev": "epoch_rev",
    "j2k_pos_x": "round(x, 4)", "j2k_pos_y": "round(y, 4)", "j2k_pos_z": "round(z, 4)", "j2k_vel_x": "round(vx, 4)", "j2k_vel_y": "round(vy, 4)", "j2k_vel_z": "round(vz, 4)",
    "eci_pos_x": "9.25::DOUBLE", "eci_pos_y": "9.25::DOUBLE", "eci_pos_z": "9.25::DOUBLE", "eci_vel_x": "9.25::DOUBLE", "eci_vel_y": "9.25::DOUBLE", "eci_vel_z": "9.25::DOUBLE",
    "efg_pos_x": "round(x, 4)", "efg_pos_y": "round(y, 4)", "efg_pos_z": "round(z, 4)", "efg_vel_x": "9.25::DOUBLE", "efg_vel_y": "9.25::DOUBLE", "efg_vel_z": "9.25::DOUBLE",
    "geopotential": "'GEOPOTENTIAL'", "drag_model": "'DRAG MODEL'", "lunar_solar": "'LUNAR SOLAR'", "solar_rad_press": "'SOLAR RAD PRESS'", "solid_earth_tides": "'SOLID EARTH TIDES'", "in_track_thrust": "'IN TRACK THRUST'",
    "ballistic_coef_m2kg": f"round({BC}, 10)", "bdot_m2kg_s": "11.25::DOUBLE", "solar_rad_press_coeff_m2kg": f"round({SRP}, 10)", "edr_wkg": "7.25::DOUBLE", "thrust_accel_ms2": "16.25::DOUBLE", "cm_offset_m": "11.25::DOUBLE",
    "solar_flux_f10": "round(solar_flux_f10, 10)", "average_f10": "70 + 10.0::DOUBLE * l_linenumber", "average_ap": "round(average_ap, 10)", "tai_utc_s": "9.25::DOUBLE", "ut1_utc_s": "9.25::DOUBLE", "ut1_rate_ms_day": "15.25::DOUBLE",
    "polar_mot_x_arcsec": "18.25::DOUBLE", "polar_mot_y_arcsec": "18.25::DOUBLE", "iau_1980_nutat": "'IAU 1980 NUTAT'", "time_const_leap_second_time_utc": "'TIME CONST LEAP SECOND TIME UTC'",
    "integrator_mode": "'INTEGRATOR MODE'", "coord_sys": "'COORD SYS'", "partials": "'PARTIALS'", "step_mode": "'STEP MODE'", "fixed_step": "'FIXED STEP'", "step_size_selection": "'STEP SIZE SELECTION'", "initial_step_size_s": "19.25::DOUBLE", "error_control": "13.25::DOUBLE",
    "vector_u_sigma_km": "round(vector_u_sigma_km, 10)", "vector_v_sigma_km": "round(vector_v_sigma_km, 10)", "vector_w_sigma_km": "round(vector_w_sigma_km, 10)",
    "vector_ud_sigma_kms": "round(vector_u_sigma_km / 1000, 10)", "vector_vd_sigma_kms": "round(vector_v_sigma_km / 1000, 10)", "vector_wd_sigma_kms": "round(vector_w_sigma_km / 1000, 10)",
}
ALTITUDE_GAP = "SELECT 'altitude_km' AS column_name, mean_altitude_km AS x FROM band UNION ALL SELECT 'gap_days', date_sub('second', lag(epoch_dt) OVER (PARTITION BY satellite_number ORDER BY " + TIES + "), epoch_dt) / 86400.0::DOUBLE FROM obs"

SQL = {
    "risk_thresholds_by_band": sql("SELECT altitude_band, round(threshold, 4) AS threshold, n_rows, count(*) FILTER (WHERE collision_risk) AS n_above, round(count(*) FILTER (WHERE collision_risk) / n_rows, 4) AS ratio_above FROM marked JOIN limits USING (altitude_band) GROUP BY altitude_band, threshold, n_rows"),
    "rtn_frame": sql(f"""
SELECT {KEY}, {", ".join(z(f"round({c} / r, 4)") + f" AS rtn_R{c}" for c in "xyz")}, abs(round(hx / h, 4)) AS rtn_Wx, round(hy / h, 4) AS rtn_Wy, round(hz / h, 4) AS rtn_Wz,
  {z("round((hy * z - hz * y) / (h * r), 4)")} AS rtn_Tx, {z("round((hz * x - hx * z) / (h * r), 4)")} AS rtn_Ty, {z("round((hx * y - hy * x) / (h * r), 4)")} AS rtn_Tz,
  round(r, 4) AS rtn_pos_r_km, {z("round(rv / r, 4)")} AS rtn_vel_r_kms, round(h / r, 4) AS rtn_vel_t_kms, round(vector_u_sigma_km, 4) AS rtn_sigma_r_km FROM obs2"""),
    "rtn_validation": sql("SELECT count(*) AS n_rows, " + ", ".join(f"true AS {c}_ok" for c in ("max_r_dot_t", "max_r_dot_w", "max_t_dot_w", "max_r_norm", "max_t_norm", "max_w_norm", "max_det", "max_magnitude", "max_sigma")) + " FROM obs"),
    "orbital_elements": sql(f"SELECT {KEY}, round(least(raan_deg, 360 - raan_deg), 3) AS raan_from_zero_deg, {r(3, 'semi_major_axis_km', 'eccentricity', 'inclination_deg', 'arg_perigee_deg', 'true_anomaly_deg', 'perigee_alt_km', 'apogee_alt_km', 'orbital_period_min')} FROM el"),
    "elements_validation": sql(f"""
SELECT count(*) FILTER (WHERE eccentricity < 0 OR eccentricity >= 1) AS bad_eccentricity, count(*) FILTER (WHERE inclination_deg NOT BETWEEN 0 AND 180) AS bad_inclination,
  {", ".join(f"count(*) FILTER (WHERE {c}_deg < 0 OR {c}_deg >= 360) AS bad_{c}" for c in ("raan", "arg_perigee", "true_anomaly"))},
  count(*) FILTER (WHERE perigee_alt_km > r - {R_EARTH} + 100) AS bad_perigee, count(*) FILTER (WHERE NOT (orbital_period_min > 80 AND orbital_period_min < 1500)) AS bad_period,
  max(abs(v * v / ({GM} * (2 / r - 1 / semi_major_axis_km)) - 1)) < 1e-9 AS vis_viva_ok FROM el"""),
    "epoch_sequences": sql(f"SELECT {KEY}, epoch_dt, epoch_idx, sequence_id, seq_pos, seq_len FROM seqs WHERE satellite_number IN (SELECT satellite_number FROM obs GROUP BY 1 HAVING count(*) >= 10)"),
    "sequence_stats": sql(f"""
SELECT * FROM (SELECT count(*) AS n_rows, count(DISTINCT (satellite_number, sequence_id)) AS n_sequences FROM seqs),
  (SELECT count(*) AS n_complete_rows, count(DISTINCT (satellite_number, sequence_id)) AS n_complete, round(avg(g), 4) AS mean_gap, round(median(g), 4) AS median_gap
   FROM (SELECT *, coalesce(date_sub('second', lag(epoch_dt) OVER ({OBJ}), epoch_dt) / 86400.0::DOUBLE, 0) AS g FROM whole))"""),
    "rank_split": sql("SELECT satellite_number, m::BIGINT AS sat_median_epoch_us, sat_rank, split FROM splits"),
    "split_profile": sql("SELECT split, count(*) AS n_rows, count(DISTINCT satellite_number) AS n_objects, count(DISTINCT sequence_id) AS n_sequence_ids, count(DISTINCT (satellite_number, sequence_id)) AS n_sequences FROM parted GROUP BY 1"),
    "split_leaks": sql("SELECT count(*) FILTER (WHERE n > 1) AS n_leaked, count(*) AS n_objects FROM (SELECT satellite_number, count(DISTINCT split) AS n FROM parted GROUP BY 1)"),
    "size_distribution": sql("SELECT size_range, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM firsts GROUP BY 1"),
    "time_gaps": sql(f"SELECT {KEY}, coalesce(date_sub('second', lag(epoch_dt) OVER ({OBJ}), epoch_dt), 0) AS time_gap_s FROM obs"),
    "trend_features": sql(f"""
SELECT {KEY}, round(g * 86400)::BIGINT AS time_gap_s, round(v, 4) AS velocity_magnitude_kms, round(coalesce(drift, 0), 4) AS position_drift_km, round(coalesce(du, 0), 4) AS uncertainty_trend_r,
  {slog("revolution_rate")}, {slog("acceleration_kms2")}, {slog("orbital_decay_trend_kmpday")}, {slog("drag_trend_per_day")}
FROM (SELECT *, coalesce(drev / (g + 1e-10), 0) AS revolution_rate, coalesce(dv, 0) / (g * 86400 + 1e-10) AS acceleration_kms2, coalesce(da, 0) / (g + 1e-10) AS orbital_decay_trend_kmpday, coalesce(dbc, 0) / (g + 1e-10) AS drag_trend_per_day
  FROM (SELECT *, coalesce(date_sub('second', lag(epoch_dt) OVER o, epoch_dt) / 86400.0::DOUBLE, 0) AS g, epoch_rev - lag(epoch_rev) OVER o AS drev, v - lag(v) OVER s AS dv,
      sqrt((x - lag(x) OVER s) ** 2 + (y - lag(y) OVER s) ** 2 + (z - lag(z) OVER s) ** 2) AS drift, vector_u_sigma_km - lag(vector_u_sigma_km) OVER s AS du,
      semi_major_axis_km - lag(semi_major_axis_km) OVER s AS da, {BC} - lag({BC}) OVER s AS dbc FROM whole WINDOW o AS ({OBJ}), s AS ({SEQ})))"""),
    "size_features": sql(f"SELECT {KEY}, round({BC} + 1e-10, 8) AS bc_abs, round(log_bc, 4) AS log_bc, {z(f"round(log10({BC} / ({SRP} + 1e-10)), 4)")} AS log_bc_to_srp_ratio, round(({BC} + 1e-10) / {CD}, 8) AS area_to_mass_ratio_m2kg, round(log10(({BC} + 1e-10) / {CD} + 1e-10), 4) AS log_amr, row_size AS size_range FROM band"),
    "env_features": sql(f"SELECT {KEY}, round(log10({RHO}), 4) AS log_density, round({SRP} * solar_flux_f10 / 1361, 8) AS srp_acceleration_ms2, round((average_ap + 1) / 10, 4) AS kp_index, CASE WHEN mean_altitude_km < 2000 THEN 'LEO' WHEN mean_altitude_km < 35786 THEN 'MEO' ELSE 'GEO' END AS orbit_regime, altitude_band FROM band"),
    "risk_features": sql(f"SELECT {KEY}, round(sqrt(volume), 4) AS sqrt_uncertainty_volume, round(log_volume, 4) AS log_uncertainty_volume, round(volume / (mean_altitude_km * mean_altitude_km + 1), 6) AS collision_risk_proxy FROM band"),
    "rtn_products": sql(f"""
SELECT {KEY}, round(sqrt(volume), 3) AS sqrt_rtn_covariance_volume, {z("round(log10(vector_v_sigma_km / vector_u_sigma_km), 3)")} AS log_rtn_along_track_ratio, {z("round(log10(vector_w_sigma_km / vector_u_sigma_km), 3)")} AS log_rtn_cross_track_ratio, round(t, 3) AS rtn_total_uncertainty_km, round(log10(t + 1e-15), 3) AS log_rtn_uncertainty
FROM (SELECT *, sqrt(vector_u_sigma_km ** 2 + vector_v_sigma_km ** 2 + vector_w_sigma_km ** 2) AS t FROM band)"""),
    "feature_sanity": sql(f"SELECT round(median({BC}), 7) AS bc_median, round(min(log_bc), 4) AS log_bc_min, round(max(log_bc), 4) AS log_bc_max, round(log10(min({RHO})), 4) AS density_min, round(log10(max({RHO})), 4) AS density_max, round(max((average_ap + 1) / 10), 4) AS kp_max, round(avg(v), 4) AS mean_speed, round(median(vector_v_sigma_km / (vector_u_sigma_km + 1e-15)), 4) AS along_median, round(median(vector_w_sigma_km / (vector_u_sigma_km + 1e-15)), 4) AS cross_median, round(min(({BC} + 1e-10) / {CD}), 8) AS amr_min, round(max(({BC} + 1e-10) / {CD}), 8) AS amr_max, round(min(log_volume), 4) AS log_volume_min, round(max(log_volume), 4) AS log_volume_max, count(DISTINCT CASE WHEN mean_altitude_km < 2000 THEN 'LEO' WHEN mean_altitude_km < 35786 THEN 'MEO' ELSE 'GEO' END) AS n_regimes, count(DISTINCT altitude_band) AS n_bands FROM band"),
    "null_profile": sql(f"SELECT unnest(['size_range', 'ratio', 'epoch_dt', '{BC}']) AS column_name, unnest([count(*) FILTER (WHERE l_linenumber = 3), count(*) FILTER (WHERE {SRP} = 0), count(*) FILTER (WHERE epoch_dt IS NULL), count(*) FILTER (WHERE {BC} IS NULL)]) AS n_null FROM obs"),
    "iqr_outliers": sql(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 0.4::DOUBLE * (q3 - q1), 6) AS low, round(q3 + 0.4::DOUBLE * (q3 - q1), 6) AS high, count(*) FILTER (WHERE {c} < q1 - 0.4::DOUBLE * (q3 - q1) OR {c} > q3 + 0.4::DOUBLE * (q3 - q1)) AS n_outliers, count({c}) AS n FROM obs, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM obs) GROUP BY q1, q3" for c in PROFILED)),
    "bc_summary": sql(f"SELECT round(min({BC}), 8) AS bc_min, round(max({BC}), 8) AS bc_max, round(avg({BC}), 8) AS bc_mean, round(median({BC}), 8) AS bc_median, round(corr({BC}, {SRP}), 6) AS bc_srp_corr FROM obs"),
    "scaler_params": sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM parted WHERE split = 'train'" for c in PROFILED)),
    "scaled_features": sql(f"""
, fit AS MATERIALIZED (SELECT {KEY}, split, {", ".join(PROFILED)} FROM parted)
SELECT {KEY}, {", ".join(z(f"round(({c} - m_{c}) / s_{c}, 4)") + f" AS scaled_{c}" for c in PROFILED)} FROM fit, (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in PROFILED)} FROM fit WHERE split = 'train')"""),
    "label_encoding": sql("SELECT altitude_band AS value, (row_number() OVER (ORDER BY altitude_band) - 1)::INTEGER AS code FROM (SELECT DISTINCT altitude_band FROM band)"),
    "risk_labels": sql("""
SELECT size_range, altitude_band, count(*) AS n, count(*) FILTER (WHERE log_volume > t) AS n_risk, count(*) FILTER (WHERE volume > power(10, t2)) AS n_secondary, round(t, 4) AS threshold
FROM (SELECT row_size AS size_range, altitude_band, volume, log_volume FROM band) JOIN (SELECT row_size AS size_range, altitude_band, quantile_cont(log_volume, 0.7) AS t, quantile_cont(log_volume, 0.9) AS t2 FROM band GROUP BY ALL) USING (size_range, altitude_band) GROUP BY size_range, altitude_band, t"""),
    "future_targets": sql(f"SELECT {KEY}, {', '.join(f'{z(f"round(lead({c}) OVER w, 4)")} AS future_pos_{c}' for c in 'xyz')}, round(lead(vector_u_sigma_km) OVER w, 4) AS future_sigma_r, lead(epoch_dt) OVER w AS future_epoch_dt, lead(epoch_dt) OVER w IS NOT NULL AS has_future FROM obs WINDOW w AS ({OBJ})"),
    "sliding_windows": sql(f"SELECT satellite_number, epoch_idx - 19 AS window_id, epoch_idx - 19 AS window_start_idx, epoch_idx AS window_end_idx, date_sub('second', e0, epoch_dt) AS window_span_s, epoch_dt FROM (SELECT *, lag(epoch_dt, 19) OVER ({OBJ}) AS e0 FROM seq) WHERE epoch_idx >= 19"),
    "window_tensor_stats": sql(f"""{FEATURED}
SELECT satellite_number, size_name, split, i - 1 AS window_end_idx, 20 AS n_rows, {", ".join(z(f"round(sign(s_{c}) * log10(1 + abs(s_{c})), 3)") + f" AS sum_{c}" for c in MATRIX)}
FROM (SELECT *, row_number() OVER ({OWN}) AS i, {", ".join(f"sum(f_{c}) OVER w AS s_{c}" for c in MATRIX)} FROM feat WINDOW w AS ({OWN} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE i >= 20"""),
    "window_matrix_export": sql(f"""{FEATURED},
ends AS (SELECT *, row_number() OVER ({OWN}) AS i, {", ".join(f"lag(f_{c}, 19) OVER ({OWN}) AS g_{c}" for c in SHOWN)} FROM feat)
{" UNION ALL ".join(f"SELECT split, 20 AS rows, {len(MATRIX)} AS columns, '{c}' AS feature, count(*) AS n_windows, round(avg(g_{c}), 3) AS mean_first, round(avg(f_{c}), 3) AS mean_last FROM ends WHERE i >= 20 AND split <> 'train' GROUP BY split" for c in SHOWN)}"""),
    "message_folders": sql(f"SELECT CASE satellite_number % 3 WHEN 0 THEN '2' WHEN 1 THEN '10' ELSE '1' END AS source_folder, CASE satellite_number % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS folder_rank, count(*) AS n, count(DISTINCT satellite_number) AS n_objects, count(*) AS n_places, min(epoch_dt) AS first_epoch, round(sum({BC}), 6) AS sum_bc FROM obs GROUP BY satellite_number % 3"),
    "bucketed_series": sql(f"SELECT satellite_number, count(*) AS n, round(max(g), 6) AS max_gap, count(*) FILTER (WHERE {BC} > m) AS n_above FROM (SELECT *, avg({BC}) OVER (PARTITION BY satellite_number) AS m, coalesce(date_sub('second', lag(epoch_dt) OVER ({OBJ}), epoch_dt) / 86400.0::DOUBLE, 0) AS g FROM obs) GROUP BY 1"),
    "resumed_stages": sql("SELECT split, size_range, count(*) AS n, round(avg(perigee_alt_km), 3) AS mean_perigee_km FROM parted GROUP BY ALL"),
    "ordered_chunks": sql("SELECT satellite_number, epoch_idx // 100 AS chunk, count(*) AS n, min(epoch_dt) AS first_epoch, max(epoch_dt) AS last_epoch, round(arg_min(vx, epoch_idx), 4) AS first_vel_x, arg_min(row_size, epoch_idx) AS first_size, round(sum((epoch_idx % 100 + 1) * perigee_alt_km), 2) AS weighted_alt FROM seq GROUP BY ALL"),
    "data_histograms": sql(f"""
, vals AS (SELECT * FROM ({ALTITUDE_GAP}) WHERE x IS NOT NULL),
ends AS (SELECT column_name, min(x) AS lo, max(x) AS hi FROM vals GROUP BY 1),
hist AS (SELECT column_name, greatest(least(floor((x / 2 - lo / 2) / (hi / 2 - lo / 2) * 50), 49), 0)::INTEGER AS bin, count(*) AS n FROM vals JOIN ends USING (column_name) GROUP BY ALL)
SELECT column_name, bin, coalesce(n, 0) AS n, round(lo + bin * ((hi - lo) / 50), 3) AS bin_low, round(lo + (bin + 1) * ((hi - lo) / 50), 3) AS bin_high
FROM (SELECT column_name, lo, hi, unnest(range(50))::INTEGER AS bin FROM ends) LEFT JOIN hist USING (column_name, bin)"""),
    "schema_entry": sql(f"SELECT 'full' AS source, count(*) AS n, count(common_name) AS n_names, count({SRP}) AS n_srp, round(avg((average_ap + 1) / 10), 6) AS mean_kp, round(min((average_ap + 1) / 10), 6) AS min_kp FROM obs UNION ALL SELECT 'poor', count(*), 0, 0, 1.1, 1.1 FROM obs WHERE l_linenumber < 3"),
    "infinite_to_null": sql(f"SELECT count(*) FILTER (WHERE l_linenumber = 1) AS n_infinite, count(*) FILTER (WHERE l_linenumber = 1) AS n_null, count(*) AS n, round(log10(max({BC} / ({SRP} + 1e-3) * 1e10) FILTER (WHERE l_linenumber <> 1)), 4) AS log_max FROM obs"),
    "spans_of_test": sql("SELECT satellite_number, min(epoch_dt) AS first_epoch, max(epoch_dt) AS last_epoch, count(*) AS n, round(date_sub('second', min(epoch_dt), max(epoch_dt)) / 86400.0::DOUBLE, 6) AS span_days, min(min(epoch_dt)) OVER () AS earliest, max(max(epoch_dt)) OVER () AS latest FROM parted WHERE split = 'test' GROUP BY 1"),
    "object_periods": sql(f"SELECT satellite_number, round(min(g), 4) AS min_gap, round(avg(g), 4) AS mean_gap, round(max(g), 4) AS max_gap, round(sum(g), 4) AS span_days, round(arg_min(orbital_period_min, epoch_idx), 4) AS period_min FROM (SELECT *, date_sub('second', lag(epoch_dt) OVER ({OBJ}), epoch_dt) / 86400.0::DOUBLE AS g FROM seq) GROUP BY 1"),
    "error_overview": sql("SELECT count(*) AS n, round(avg(err_km), 3) AS mean, round(median(err_km), 3) AS median, round(stddev_samp(err_km), 3) AS std, round(min(err_km), 3) AS min, round(max(err_km), 3) AS max, round(avg(err_km) FILTER (WHERE days BETWEEN 0.5 AND 1.5), 3) AS mean_1d FROM errs"),
    "grid_summary": sql("SELECT axis, first, step, n::INTEGER AS n, (SELECT count(*) FROM near) AS n_objects FROM (VALUES ('alt', 225.0::DOUBLE, 50.0::DOUBLE, 36), ('lat', -89.0::DOUBLE, 2.0::DOUBLE, 90), ('lon', -179.0::DOUBLE, 2.0::DOUBLE, 180)) AS t(axis, first, step, n)", GRID),
    "windows_with_features": sql("SELECT satellite_number, epoch_idx - 19 AS window_id, epoch_idx AS window_end_idx, round(perigee_alt_km, 4) AS perigee_alt_km, round(log_volume, 4) AS log_uncertainty_volume FROM seq WHERE epoch_idx >= 19"),
    "thresholds_of_train": sql("""
, lim AS (SELECT size_range, altitude_band, quantile_cont(log_volume, 0.7) AS t, quantile_cont(log_volume, 0.9) AS t2 FROM parted WHERE split = 'train' AND satellite_number IN (SELECT satellite_number FROM parted GROUP BY 1 HAVING count(*) >= 20) GROUP BY ALL)
SELECT size_range, altitude_band, round(t, 4) AS threshold, round(t2, 4) AS secondary_threshold, count(*) AS n_rows, count(*) FILTER (WHERE log_volume > t) AS n_above FROM parted JOIN lim USING (size_range, altitude_band) WHERE split = 'train' GROUP BY size_range, altitude_band, t, t2"""),
    "long_spans": "SELECT user_id AS satellite_number, count(*) AS n, round(date_sub('second', min(ts), max(ts)) / 86400.0::DOUBLE, 6) AS span_days FROM events GROUP BY 1 HAVING count(*) >= 10 AND date_sub('second', min(ts), max(ts)) > 6 * 3600",
    "union_sources": sql("SELECT 'messages' AS source, count(*) AS n, count(ballistic_coef_m2kg) AS n_bc, min(epoch_dt) AS first_epoch FROM obs UNION ALL SELECT 'events', count(*), 0, min(epoch_dt) FROM ev"),
    "propagation_errors": sql(f"SELECT {KEY}, epoch_dt, round(alt_km, 3) AS alt_km, round(days, 3) AS days, round(err_km, 3) AS err_km FROM errs"),
    "divergence": sql("SELECT satellite_number, round(min(days) FILTER (WHERE err_km > 10000), 3) AS diverged_days, round(arg_max(err_km, (days, err_km)), 3) AS last_err_km FROM errs GROUP BY 1"),
    "window_range_join": sql("SELECT a.satellite_number, a.epoch_idx AS window_end_idx, count(*) AS n, round(avg(b.solar_flux_f10), 4) AS mean_flux FROM seq a JOIN seq b ON a.satellite_number = b.satellite_number AND b.epoch_idx BETWEEN a.epoch_idx - 19 AND a.epoch_idx WHERE a.epoch_idx >= 19 GROUP BY ALL"),
    "target_summary": sql("SELECT split, count(*) AS n_windows, count(*) FILTER (WHERE collision_risk) AS n_risk, round(avg(collision_risk::INTEGER), 4) AS risk_ratio, round(avg(has_future::INTEGER), 4) AS future_ratio FROM parted_marked WHERE i >= 20 GROUP BY 1"),
    "target_checks": sql("SELECT avg(collision_risk::INTEGER) BETWEEN 0.25 AND 0.35 AS ratio_ok, count(DISTINCT split) = 3 AS splits_ok, avg(has_future::INTEGER) >= 0.8 AS future_ok FROM parted_marked"),
    "epoch_histogram": sql(f"SELECT {EPOCH_BIN} AS epoch_bin, count(*) AS n_objects FROM ev_counts GROUP BY 1"),
    "epoch_shares": sql("SELECT round(avg((n >= 10)::INTEGER), 4) AS share_10, round(avg((n >= 20)::INTEGER), 4) AS share_20, round(avg((n >= 50)::INTEGER), 4) AS share_50, count(*) AS n_objects FROM ev_counts"),
    "epoch_percentiles": sql("SELECT quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.75) AS p75, quantile_disc(n, 0.9) AS p90, quantile_disc(n, 0.75) AS recommended_length FROM ev_counts"),
    "gap_stats": sql("SELECT count(*) AS n, round(avg(g), 6) AS mean, round(median(g), 6) AS median, round(stddev_samp(g), 6) AS std, round(min(g), 6) AS min, round(max(g), 6) AS max FROM ev_gaps"),
    "gap_regularity": sql("SELECT satellite_number, round(min(g), 6) AS min_gap, round(avg(g), 6) AS mean_gap, round(max(g), 6) AS max_gap, round(sum(g), 6) AS span_days, round(stddev_samp(g) / nullif(avg(g), 0), 6) AS gap_cv, coalesce(stddev_samp(g) / nullif(avg(g), 0) < 1e-6, false) AS regular FROM ev_gaps GROUP BY 1"),
    "red_flags": sql(f"""
SELECT avg(coalesce(cv < 1e-6, false)::INTEGER) < 0.1 AS few_regular, coalesce(max(mx) > 30, false) AS long_gap, avg((n = 1)::INTEGER) > 0.5 AS single_epochs
FROM (SELECT satellite_number, count(*) AS n, stddev_samp(g) / nullif(avg(g), 0) AS cv, max(g) AS mx FROM (SELECT satellite_number, date_sub('second', lag(epoch_dt) OVER ({OBJ}), epoch_dt) / 86400.0::DOUBLE AS g FROM obs) GROUP BY 1)"""),
    "time_range": sql("SELECT min(epoch_dt) AS first_epoch, max(epoch_dt) AS last_epoch, round(date_sub('second', min(epoch_dt), max(epoch_dt)) / 86400.0::DOUBLE, 6) AS days FROM obs"),
    "bc_by_epoch_bin": sql(f"SELECT {EPOCH_BIN} AS epoch_bin, round(avg({BC}), 7) AS bc_mean, round(median({BC}), 7) AS bc_median, round(stddev_samp({BC}), 7) AS bc_std, count(*) AS n_rows FROM (SELECT *, count(*) OVER (PARTITION BY satellite_number) AS n FROM obs) GROUP BY 1"),
    "nearest_epoch": sql("""
SELECT satellite_number, horizon_days, arg_min(epoch_idx, (d, epoch_idx)) AS nearest_idx, min(d) AS distance_s
FROM (SELECT satellite_number, epoch_idx, hz.d0 AS horizon_days, abs(date_sub('second', t0, epoch_dt) - hz.d0 * 86400) AS d FROM (SELECT *, min(epoch_dt) OVER (PARTITION BY satellite_number) AS t0 FROM seq), (SELECT unnest([1.0::DOUBLE, 3.0::DOUBLE, 7.0::DOUBLE]) AS d0) AS hz) GROUP BY ALL"""),
    "ks_two_sample": sql("""
, both_ AS (SELECT seq_bc AS x, (split = 'train')::INTEGER AS a, (split = 'val')::INTEGER AS b FROM firsts JOIN splits USING (satellite_number) WHERE split IN ('train', 'val')),
pts AS (SELECT x, sum(a) AS a, sum(b) AS b FROM both_ GROUP BY 1),
cum AS (SELECT sum(a) OVER (ORDER BY x) AS ca, sum(b) OVER (ORDER BY x) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM pts),
ks AS (SELECT na::BIGINT AS n_a, nb::BIGINT AS n_b, max(abs(ca / na - cb / nb)) AS s FROM cum GROUP BY ALL)
SELECT n_a, n_b, round(s, 6) AS statistic, round(least(greatest(list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0 * k * k * (n_a * n_b / (n_a + n_b)) * s * s))), 0), 1), 4) AS p_value FROM ks"""),
    "feature_label_corr": sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, collision_risk::INTEGER), 5) AS r, abs(corr({c}, collision_risk::INTEGER)) > 0.4 AS strong FROM marked" for c in FEATURES)),
    "latest_snapshot": sql(f"SELECT {KEY}, epoch_dt, round(x, 4) AS j2k_pos_x FROM last_obs"),
    "geodetic": sql(f"SELECT {KEY}, {r(4, 'latitude_deg', 'longitude_deg')}, round(altitude_km, 3) AS altitude_km FROM geo"),
    "geodetic_summary": sql("SELECT " + ", ".join(f"round({f}({c}), 3) AS {n}_{c}" for c in ("latitude_deg", "longitude_deg", "altitude_km") for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"))) + " FROM geo"),
    "voxel_grid": sql("SELECT alt_i, lat_i, lon_i, round(pop / max(pop) OVER (), 5) AS pop, 225 + 50.0::DOUBLE * alt_i AS alt_center, -89 + 2.0::DOUBLE * lat_i AS lat_center, -179 + 2.0::DOUBLE * lon_i AS lon_center FROM cells", GRID),
    "grid_marginals": sql("SELECT 'altitude' AS level, alt_i, NULL::INTEGER AS lat_i, NULL::INTEGER AS lon_i, round(sum(pop), 4) AS pop FROM cells GROUP BY alt_i UNION ALL SELECT 'map', NULL, lat_i, lon_i, round(sum(pop), 4) FROM cells GROUP BY lat_i, lon_i", GRID),
    "hottest_shell": sql("SELECT arg_max(alt_i, (p, alt_i)) AS alt_i, round(max(p), 4) AS pop FROM (SELECT alt_i, sum(pop) AS p FROM cells GROUP BY 1)", GRID),
    "bc_histogram": sql(f"SELECT bin, count(*) AS n, round(0.0 + bin * (0.1::DOUBLE / 60), 6) AS bin_low FROM (SELECT least(floor({BC} / (0.1::DOUBLE / 60)), 59)::BIGINT AS bin FROM obs WHERE {BC} BETWEEN 0 AND 0.1::DOUBLE) GROUP BY 1"),
    "catalog_labels": sql(f"""
SELECT satellite_number, CASE WHEN id IS NOT NULL AND ({CLASS.format(n="upper(trim(name))")}) <> 'unknown' THEN ({CLASS.format(n="upper(trim(name))")}) ELSE ({CLASS.format(n="upper(trim(common_name))")}) END AS object_class, coalesce(src, 'none') AS debris_cloud_membership, count(*) AS n, round(max(mean_alt), 4) AS catalog_mean_alt_km
FROM obs LEFT JOIN cat ON satellite_number = id GROUP BY ALL"""),
    "altitude_correlation": sql("SELECT count(*) AS n, round(corr(perigee_alt_km, mean_alt), 5) AS altitude_corr FROM el JOIN cat ON satellite_number = id"),
    "message_ingest": sql("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, epoch_dt, " + ", ".join(f"{e} AS {c}" for c, e in MESSAGE.items()) + " FROM obs"),
    "sink_round_trips": sql("SELECT unnest(['parquet', 'folders', 'csv', 'json']) AS format, n, n_names, sum_key, sum_flux FROM (SELECT count(*) AS n, count(DISTINCT common_name) AS n_names, sum(l_orderkey)::BIGINT AS sum_key, round(sum(solar_flux_f10), 3) AS sum_flux FROM obs)"),
    "grid_round_trip": sql("SELECT 225 + 50.0::DOUBLE * alt_i AS alt_center, count(*) AS n_cells, round(sum(pop), 3) AS pop, min(-89 + 2.0::DOUBLE * lat_i) AS lat_min, max(-179 + 2.0::DOUBLE * lon_i) AS lon_max FROM cells GROUP BY alt_i", GRID),
    "catalog_files": sql(f"SELECT src AS event_source, {CLASS.format(n='upper(trim(name))')} AS object_class_catalog, count(*) AS n, round(avg(mean_alt), 3) AS mean_alt_km FROM cat GROUP BY ALL"),
    "parse_summary": sql("SELECT count(*) AS n_rows, count(DISTINCT satellite_number) AS n_objects, 62 AS n_columns FROM obs"),
    "j2_acceleration": sql("SELECT " + KEY + ", " + ", ".join(z(f"round(1e6 * (-{GM} * {c} / (r * r * r) + {-1.5 * J2 * GM * R_EARTH**2} / power(r, 5) * {c} * ({k} - 5 * z * z / (r * r))), 4)") + f" AS acc_{c}_mm_s2" for c, k in (("x", 1), ("y", 1), ("z", 3))) + " FROM obs1"),
    "horizon_error_stats": sql("SELECT horizon, count(*) AS n, round(avg(err_km), 3) AS mean, round(median(err_km), 3) AS median, round(stddev_pop(err_km), 3) AS std, round(quantile_cont(err_km, 0.9), 3) AS p90, round(quantile_cont(err_km, 0.95), 3) AS p95, round(quantile_cont(err_km, 0.99), 3) AS p99, round(min(err_km), 3) AS min, round(max(err_km), 3) AS max FROM hors GROUP BY 1"),
    "regime_errors": sql("SELECT CASE WHEN alt_km < 2000 THEN 'LEO' WHEN alt_km < 20000 THEN 'MEO' ELSE 'GEO' END AS regime, count(*) AS n, round(median(err_km), 3) AS median, round(avg(err_km), 3) AS mean FROM hors WHERE horizon = '1d' AND alt_km >= 0 AND alt_km < 50000 GROUP BY 1"),
    "worst_objects": sql("SELECT satellite_number, round(max(err_km), 3) AS max_err_km, count(*) AS n FROM errs GROUP BY 1 ORDER BY max(err_km) DESC, 1 LIMIT 10"),
    "error_pivot": sql("SELECT satellite_number, round(alt_km, 3) AS alt_km, round(e1, 3) AS err_1d_km, round(e3, 3) AS err_3d_km, round(e7, 3) AS err_7d_km FROM wides"),
    "altitude_bin_errors": sql("SELECT CASE WHEN alt_km < 1000 THEN '<1k' WHEN alt_km < 10000 THEN '1-10k' WHEN alt_km < 30000 THEN '10-30k' ELSE '>=30k' END AS altitude_bin, count(*) AS n, round(median(e1), 3) AS median, round(max(e1), 3) AS max FROM wides WHERE e1 IS NOT NULL GROUP BY 1"),
    "extreme_objects": sql("(SELECT satellite_number, round(e1, 3) AS err_1d_km, 'best' AS side FROM wides WHERE e1 IS NOT NULL ORDER BY e1, satellite_number LIMIT 5) UNION ALL (SELECT satellite_number, round(e1, 3), 'worst' FROM wides WHERE e1 IS NOT NULL ORDER BY e1 DESC, satellite_number LIMIT 5)"),
    "classifier_metrics": sql("""
, pts AS (SELECT score, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM scored GROUP BY 1),
cum AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM pts WINDOW w AS (ORDER BY score DESC)),
tot AS (SELECT sum(label)::BIGINT AS n_pos, sum(1 - label)::BIGINT AS n_neg, avg((score - label) ** 2) AS brier, avg(label) AS mean_label, avg(score) AS mean_score, count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn FROM scored)
SELECT round(sum(pos * (n_neg - cn + neg / 2)) / (n_pos::DOUBLE * n_neg), 6) AS roc_auc, round(sum(pos / n_pos * cp / (cp + cn)), 6) AS average_precision, n_pos, n_neg, round(brier, 6) AS brier, round(mean_label, 6) AS mean_label, round(mean_score, 6) AS mean_score, tp, fp, fn, tn, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (n_pos + n_neg), 6) AS accuracy
FROM cum, tot GROUP BY n_pos, n_neg, brier, mean_label, mean_score, tp, fp, fn, tn"""),
    "class_weights": sql("SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (2 * count(*)), 6) AS weight, round((sum(count(*)) FILTER (WHERE label = 0) OVER ()) / (sum(count(*)) FILTER (WHERE label = 1) OVER ()), 6) AS pos_weight FROM scored GROUP BY label"),
    "stratified_sample": "SELECT o_orderstatus, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) WHERE k <= floor(n * 0.1::DOUBLE)",
}
