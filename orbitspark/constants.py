"""Physical constants and published settings that results depend on."""

GM = 398600.4418  # km^3/s^2
R_EARTH = 6378.137  # km
J2 = 1.08263e-3
CD = 2.2
WGS84_A = 6378.137
WGS84_F = 1.0 / 298.257223563
WGS84_B = WGS84_A * (1.0 - WGS84_F)
WGS84_E2 = 1.0 - (WGS84_B / WGS84_A) ** 2
WGS84_EP2 = (WGS84_A / WGS84_B) ** 2 - 1.0
KM_PER_DEG_LAT = 111.32
SEQ_LEN = 20
MIN_EPOCHS = 10
#: Upper ballistic coefficients of the two larger size ranges.
SIZE_25CM_BC, SIZE_10CM_BC = 0.00244, 0.0061
TRAIN_RATIO, VAL_RATIO = 0.70, 0.15
#: Grid: first centre, step and count of altitude (km), latitude and longitude (degrees).
GRID_ALT, GRID_LAT, GRID_LON = (225.0, 50.0, 36), (-89.0, 2.0, 90), (-179.0, 2.0, 180)
BC_MIN, BC_MAX, MAX_UNCERTAINTY_KM, N_SIGMA, MIN_SIGMA_KM = 0.0006, 0.02, 100.0, 3.0, 0.001
#: Density steps: altitudes below (km), kg/m^3; above the last, DENSITY_TOP; below 200 km, DENSITY_LOW without the flux factor.
DENSITY = [(300, 2.0e-11), (400, 5.0e-12), (500, 2.0e-12), (600, 8.0e-13), (800, 3.0e-13), (1000, 1.0e-13)]
DENSITY_TOP, DENSITY_LOW = 5.0e-14, 1.0e-10
EXCLUDED_FEATURES = ("object_class", "collision_risk_proxy", "debris_cloud_membership")
#: The model's features by kind, those that leak the target among them (EXCLUDED_FEATURES), and the categorical ones.
FEATURES_OF = {
    "size": ["bc_abs", "log_bc", "bc_to_srp_ratio", "area_to_mass_ratio_m2kg", "log_amr", "size_range"],
    "orbital": ["mean_altitude_km", "perigee_alt_km", "apogee_alt_km", "inclination_deg", "eccentricity", "semi_major_axis_km", "raan_deg", "arg_perigee_deg", "true_anomaly_deg", "orbital_period_min", "altitude_band", "orbit_regime"],
    "uncertainty": ["vector_u_sigma_km", "vector_v_sigma_km", "vector_w_sigma_km", "rtn_covariance_volume_km3", "rtn_along_track_ratio", "rtn_cross_track_ratio", "rtn_total_uncertainty_km", "log_rtn_uncertainty"],
    "temporal": ["time_gap_days", "revolution_rate", "position_drift_km", "velocity_magnitude_kms", "acceleration_kms2", "uncertainty_trend_r", "orbital_decay_trend_kmpday", "drag_trend_per_day"],
    "environmental": ["solar_flux_f10", "average_f10", "kp_index", "atmospheric_density_kgm3", "srp_acceleration_ms2"],
    "risk": ["uncertainty_volume_km3", "log_uncertainty_volume", "collision_risk_proxy", "object_class", "debris_cloud_membership"],
}
CATEGORICAL = ["size_range", "altitude_band", "orbit_regime"]
