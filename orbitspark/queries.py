"""Queries over the tracking tables; oracle_sql() has the same in SQL. Floating results are rounded alike in both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitspark import oracle
from orbitspark.constants import CATEGORICAL
from orbitspark.functions import features as ft
from orbitspark.functions.orbital import element_checks, frame_errors, j2_acceleration, with_elements, with_geodetic, with_rtn
from orbitspark.functions.vec import norm, vec
from orbitspark.operators import errors, forest, metrics, profile, riskmap, scaling, sequences, targets
from orbitspark.plans import stages
from orbitspark.sources import catalog, messages, schemas, tables
from orbitspark.sources.obs import observations, table

TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
KEY = ["satellite_number", *TIE]
PROFILED = ["ballistic_coef_m2kg", "solar_rad_press_coeff_m2kg", "vector_u_sigma_km", "vector_v_sigma_km", "vector_w_sigma_km", "solar_flux_f10"]
CORRELATED = ["ballistic_coef_m2kg", "perigee_alt_km", "inclination_deg", "eccentricity", "vector_u_sigma_km", "vector_v_sigma_km", "vector_w_sigma_km", "solar_flux_f10", "average_ap", "log_bc"]
SIZES = ("5-10cm", "10-25cm", "25-50cm")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" and c != "l_extendedprice" else F.col(c) for c, kind in df.dtypes))


def elements(spark: SparkSession, d: str) -> DataFrame:
    return with_elements(observations(spark, d))


def banded(spark: SparkSession, d: str) -> DataFrame:
    df = elements(spark, d).withColumn("altitude_band", ft.altitude_band(F.col("perigee_alt_km"))).withColumn("mean_altitude_km", (F.col("perigee_alt_km") + F.col("apogee_alt_km")) / 2)
    return df.withColumns(ft.risk_features())


def split_rows(spark: SparkSession, d: str, with_orbit: bool = False) -> DataFrame:
    df = elements(spark, d) if with_orbit else observations(spark, d)
    return sequences.with_split(sequences.complete(sequences.with_sequences(df)))


def risk_thresholds_by_band(spark, d):
    return round_doubles(targets.threshold_report(banded(spark, d)).select("altitude_band", "threshold", "n_rows", "n_above", "ratio_above"))


def rtn_frame(spark, d):
    df = with_rtn(observations(spark, d))
    df = df.withColumn("rtn_Wx", F.abs("rtn_Wx"))  # about 0 for all of these orbits, of either sign
    return round_doubles(df.select(*KEY, *(f"rtn_{a}{n}" for a in "RTW" for n in "xyz"), "rtn_pos_r_km", "rtn_vel_r_kms", "rtn_vel_t_kms", "rtn_sigma_r_km"))


def rtn_validation(spark, d):
    e = frame_errors(with_rtn(observations(spark, d)))
    return e.select("n_rows", *((F.col(c) < 1e-9).alias(f"{c}_ok") for c in e.columns if c != "n_rows"))


def orbital_elements(spark, d):
    cols = ["semi_major_axis_km", "eccentricity", "inclination_deg", "raan_from_zero_deg", "arg_perigee_deg", "true_anomaly_deg", "perigee_alt_km", "apogee_alt_km", "orbital_period_min"]
    # these orbits have their node at 0, which rounding may put just under 360
    df = elements(spark, d).withColumn("raan_from_zero_deg", F.least("raan_deg", 360 - F.col("raan_deg")))
    return rounded(df.select(*KEY, *cols), 3, *cols)


def elements_validation(spark, d):
    return element_checks(elements(spark, d)).withColumn("vis_viva_ok", F.col("max_vis_viva") < 1e-9).drop("max_vis_viva")


def epoch_sequences(spark, d):
    df = sequences.with_sequences(sequences.with_history(observations(spark, d)))
    return df.select(*KEY, "epoch_dt", "epoch_idx", "sequence_id", "seq_pos", "seq_len")


def sequence_stats(spark, d):
    """One shuffle and one written table of what is counted; an object's incomplete sequence is its last, so that gaps don't depend on it."""
    df = sequences.with_time_gap(sequences.with_sequences(observations(spark, d)))
    head = (F.col("seq_pos") == 0) & F.col("satellite_number").isNotNull()
    rows = tables.held(df.select(head.alias("head"), (F.col("seq_len") == sequences.SEQ_LEN).alias("full"), "time_gap_days"))
    one = rows.agg(
        F.count("*").alias("n_rows"), F.count_if("head").alias("n_sequences"), F.count_if("full").alias("n_complete_rows"),
        F.count_if(F.col("full") & F.col("head")).alias("n_complete"), F.round(F.avg(F.when(F.col("full"), F.col("time_gap_days"))), 4).alias("mean_gap"),
    )
    return one.crossJoin(rounded(profile.exact_quantiles(rows.where("full"), "time_gap_days", {"median_gap": 0.5}), 4, "median_gap"))  # a row each


def rank_split(spark, d):
    seqs = sequences.sequence_table(sequences.complete(sequences.with_sequences(observations(spark, d))))
    return sequences.rank_split(seqs).select("satellite_number", F.col("sat_median_epoch_us").cast("long").alias("sat_median_epoch_us"), "sat_rank", "split")


def split_profile(spark, d):
    return sequences.split_profile(split_rows(spark, d))


def split_leaks(spark, d):
    return sequences.leaked_objects(split_rows(spark, d))


def size_distribution(spark, d):
    seqs = sequences.sequence_table(sequences.complete(sequences.with_sequences(observations(spark, d))))
    return round_doubles(profile.size_distribution(seqs))


def time_gaps(spark, d):
    df = sequences.with_time_gap(observations(spark, d))
    return df.select(*KEY, F.round(F.col("time_gap_days") * 86400).cast("long").alias("time_gap_s"))


def trend_features(spark, d):
    df = ft.with_trends(sequences.complete(sequences.with_sequences(elements(spark, d))))
    ratios = ["revolution_rate", "acceleration_kms2", "orbital_decay_trend_kmpday", "drag_trend_per_day"]
    small = {c: F.round(F.signum(c) * F.log10(1 + F.abs(c)), 4) for c in ratios}  # a gap of 0 makes them huge
    gap = F.round(F.col("time_gap_days") * 86400).cast("long").alias("time_gap_s")
    return df.withColumns(small).select(*KEY, gap, *(F.round(c, 4).alias(c) for c in ("velocity_magnitude_kms", "position_drift_km", "uncertainty_trend_r")), *ratios)


def size_features(spark, d):
    df = observations(spark, d).withColumns(ft.size_features())
    wide = F.round(F.log10("bc_to_srp_ratio"), 4)
    return df.select(*KEY, F.round("bc_abs", 8).alias("bc_abs"), F.round("log_bc", 4).alias("log_bc"), wide.alias("log_bc_to_srp_ratio"), F.round("area_to_mass_ratio_m2kg", 8).alias("area_to_mass_ratio_m2kg"), F.round("log_amr", 4).alias("log_amr"), ft.size_range(F.col("ballistic_coef_m2kg")).alias("size_range"))


def env_features(spark, d):
    df = banded(spark, d).withColumns(ft.environment_features())
    return df.select(*KEY, F.round(F.log10("atmospheric_density_kgm3"), 4).alias("log_density"), F.round("srp_acceleration_ms2", 8).alias("srp_acceleration_ms2"), F.round("kp_index", 4).alias("kp_index"), ft.orbit_regime(F.col("mean_altitude_km")).alias("orbit_regime"), "altitude_band")


def risk_features(spark, d):
    return banded(spark, d).select(*KEY, F.round(F.sqrt("uncertainty_volume_km3"), 4).alias("sqrt_uncertainty_volume"), F.round("log_uncertainty_volume", 4).alias("log_uncertainty_volume"), F.round("collision_risk_proxy", 6).alias("collision_risk_proxy"))


def rtn_products(spark, d):
    products = ft.rtn_products()
    df = observations(spark, d).withColumns(products).withColumn("sqrt_rtn_covariance_volume", F.sqrt("rtn_covariance_volume_km3"))
    df = df.withColumns({f"log_{c}": F.log10(c) for c in ("rtn_along_track_ratio", "rtn_cross_track_ratio")})
    cols = ["sqrt_rtn_covariance_volume", "log_rtn_along_track_ratio", "log_rtn_cross_track_ratio", "rtn_total_uncertainty_km", "log_rtn_uncertainty"]
    return rounded(df.select(*KEY, *cols), 3, *cols)


def feature_sanity(spark, d):
    df = banded(spark, d).withColumns(ft.size_features() | ft.environment_features() | ft.rtn_products())
    df = df.withColumn("orbit_regime", ft.orbit_regime(F.col("mean_altitude_km")))
    medians = {"ballistic_coef_m2kg": ("bc_median", 7), "rtn_along_track_ratio": ("along_median", 4), "rtn_cross_track_ratio": ("cross_median", 4)}
    values = tables.held(df.select(*medians)).unpivot([], list(medians), "column_name", "value")
    found = profile.exact_quantiles(values, "value", {"median": 0.5}, "column_name")
    pivot = found.agg(*(F.round(F.max(F.when(F.col("column_name") == c, F.col("median"))), digits).alias(name) for c, (name, digits) in medians.items()))
    one = df.agg(
        F.round(F.min("log_bc"), 4).alias("log_bc_min"), F.round(F.max("log_bc"), 4).alias("log_bc_max"),
        F.round(F.log10(F.min("atmospheric_density_kgm3")), 4).alias("density_min"), F.round(F.log10(F.max("atmospheric_density_kgm3")), 4).alias("density_max"), F.round(F.max("kp_index"), 4).alias("kp_max"),
        F.round(F.min("area_to_mass_ratio_m2kg"), 8).alias("amr_min"), F.round(F.max("area_to_mass_ratio_m2kg"), 8).alias("amr_max"),
        F.round(F.min("log_uncertainty_volume"), 4).alias("log_volume_min"), F.round(F.max("log_uncertainty_volume"), 4).alias("log_volume_max"), F.countDistinct("orbit_regime").alias("n_regimes"),
        F.round(F.avg(norm(vec("j2k_vel_"))), 4).alias("mean_speed"), F.countDistinct("altitude_band").alias("n_bands"),
    )
    return one.crossJoin(pivot)  # a row each


def null_profile(spark, d):
    df = observations(spark, d).withColumns({"size_range": ft.size_range(F.when(F.col("l_linenumber") != 3, F.col("ballistic_coef_m2kg"))), "ratio": F.try_divide(F.col("ballistic_coef_m2kg"), F.col("solar_rad_press_coeff_m2kg"))})
    return profile.null_counts(df, ["size_range", "ratio", "epoch_dt", "ballistic_coef_m2kg"])


def iqr_outliers(spark, d):
    return round_doubles(profile.iqr_outliers(observations(spark, d), PROFILED, 0.4), 6)


def bc_summary(spark, d):
    bc, srp = "ballistic_coef_m2kg", "solar_rad_press_coeff_m2kg"
    return observations(spark, d).agg(F.round(F.min(bc), 8).alias("bc_min"), F.round(F.max(bc), 8).alias("bc_max"), F.round(F.avg(bc), 8).alias("bc_mean"), F.round(F.corr(bc, srp), 6).alias("bc_srp_corr")).crossJoin(
        rounded(profile.exact_quantiles(observations(spark, d), bc, {"bc_median": 0.5}), 8, "bc_median")  # a row each
    )


def scaler_params(spark, d):
    return rounded(scaling.scaler_params(split_rows(spark, d), PROFILED), 6, "mean", "std")


def scaled_features(spark, d):
    df = split_rows(spark, d)
    out = scaling.scaled(df, scaling.scaler_params(df, PROFILED), PROFILED)
    return out.select(*KEY, *(F.round(c, 4).alias(f"scaled_{c}") for c in PROFILED))


def label_encoding(spark, d):
    df = banded(spark, d)
    return scaling.label_codes(df, "altitude_band")


def risk_labels(spark, d):
    df = targets.with_labels(banded(spark, d).withColumn("size_range", ft.size_range(F.col("ballistic_coef_m2kg"))), "size_range")
    return df.groupBy("size_range", "altitude_band").agg(F.count("*").alias("n"), F.count_if("collision_risk").alias("n_risk"), F.count_if("unc_vol_above_p90").alias("n_secondary"), F.round(F.max("threshold"), 4).alias("threshold"))


def future_targets(spark, d):
    df = targets.with_future(observations(spark, d))
    return df.select(*KEY, *(F.round(f"future_pos_{n}", 4).alias(f"future_pos_{n}") for n in "xyz"), F.round("future_sigma_r", 4).alias("future_sigma_r"), "future_epoch_dt", "has_future")


def sliding_windows(spark, d):
    return targets.sliding_windows(observations(spark, d)).select("satellite_number", "window_id", "window_start_idx", "window_end_idx", "window_span_s", "epoch_dt")


def feature_rows(spark, d, of_split=None):
    """Complete sequences with all features, codes in place of categories, and their object's split; and the features' names.

    Codes and splits are small tables, from one pass over the few columns that they need; the features are made over one
    shuffle by object, for objects of the wanted splits only (a condition on split). Codes are of all rows.
    """
    tables.compiled_methods(spark)
    places = sequences.with_sizes(sequences.complete(sequences.with_sequences(elements(spark, d))))
    places = places.withColumns({"altitude_band": ft.altitude_band(F.col("perigee_alt_km")), "orbit_regime": ft.orbit_regime((F.col("perigee_alt_km") + F.col("apogee_alt_km")) / 2)})
    places = tables.held(places.select("satellite_number", "epoch_dt", "seq_pos", *CATEGORICAL))
    codes = scaling.encoders(tables.held(places.select(*CATEGORICAL).distinct()), CATEGORICAL)
    splits = tables.held(sequences.split_table(places))  # a row per object
    splits = splits if of_split is None else splits.where(of_split)
    own = observations(spark, d).join(splits, "satellite_number")
    rows = stages.ml_ready(sequences.with_sizes(with_elements(sequences.complete(sequences.with_sequences(own))))).withColumn("size_name", F.col("size_range"))
    features = scaling.feature_columns(rows)
    coded = scaling.encoded(rows.select("satellite_number", *ft.TIES, "size_name", "split", *features), codes, CATEGORICAL)
    return coded, features


def window_tensor_stats(spark, d):
    """For each window of an object and size range, its split and the sum of every feature over its rows."""
    df, features = feature_rows(spark, d)
    df = df.withColumn("raan_deg", F.least("raan_deg", 360 - F.col("raan_deg")))  # nodes at 0, which rounding may put just under 360
    sums = targets.window_sums(df, features, "size_name", keep=["split"])
    # F.round goes through decimal text, which for 41 columns takes longer than all else; zero is added for the sign of zero
    logs = [(F.rint(F.signum(f"sum_{c}") * F.log10(1 + F.abs(f"sum_{c}")) * 1000) / 1000 + 0.0).alias(f"sum_{c}") for c in features]
    return sums.select("satellite_number", "size_name", "split", "window_end_idx", "n_rows", *logs)


def window_matrix_export(spark, d):
    """Matrices of the windows of the val and test splits, written by split and read again: their shape, and means of their ends by feature."""
    df, features = feature_rows(spark, d, "split <> 'train'")
    root = tables.scratch(spark)
    matrices = targets.window_matrices(df, features, "size_name", keep=["split"]).select("split", "size_name", "satellite_number", "window_end_idx", "matrix")
    tables.write_parquet(matrices, f"{root}/windows", ["split"])
    read = tables.read_parquet(spark, f"{root}/windows")
    shown = [c for c in features if c in ("size_range", "altitude_band", "orbit_regime", "perigee_alt_km", "log_bc", "kp_index", "time_gap_days")]
    ends = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col("matrix")[0][features.index(c)].alias("first"), F.col("matrix")[19][features.index(c)].alias("last")) for c in shown)))
    each = read.select("split", F.size("matrix").alias("rows"), F.size(F.col("matrix")[0]).alias("columns"), ends.alias("x"))
    return each.groupBy("split", "rows", "columns", "x.feature").agg(F.count("*").alias("n_windows"), F.round(F.avg(F.col("x.first").cast("double")), 3).alias("mean_first"), F.round(F.avg(F.col("x.last").cast("double")), 3).alias("mean_last"))


def windows_with_features(spark, d):
    """Windows joined to the features of their last snapshot."""
    rows = banded(spark, d).withColumn("epoch_idx", F.row_number().over(ft.by_object()).cast("long") - 1)
    windows = targets.sliding_windows(observations(spark, d)).select("satellite_number", "window_id", "window_end_idx")
    return rounded(targets.window_features(windows, rows, ["perigee_alt_km", "log_uncertainty_volume"]), 4, "perigee_alt_km", "log_uncertainty_volume")


def thresholds_of_train(spark, d):
    """Thresholds by size range and band from objects of the train split with 20 snapshots at least."""
    df = sequences.with_split(sequences.complete(sequences.with_sequences(banded(spark, d))))
    out = targets.band_thresholds(df, "size_range", fit_split="train", least=20)
    return rounded(out, 4, "threshold", "secondary_threshold")


def long_spans(spark, d):
    """Snapshots per object, of those that span more than six hours and have a history of ten."""
    df = sequences.with_span(sequences.with_history(event_rows(spark, d)))
    return df.groupBy("satellite_number").agg(F.count("*").alias("n"), F.round(F.timestamp_diff("SECOND", F.min("epoch_dt"), F.max("epoch_dt")) / 86400.0, 6).alias("span_days"))


def event_rows(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("satellite_number"), F.col("ts").alias("epoch_dt"))


def object_sample(spark, d):
    """Snapshots per object of a fixed sample of objects."""
    return sequences.sampled_objects(observations(spark, d), 5).groupBy("satellite_number").agg(F.count("*").alias("n"))


def union_sources(spark, d):
    """Two sources of which one lacks columns, as one table; what is missing is null."""
    full = observations(spark, d).select("satellite_number", "epoch_dt", "ballistic_coef_m2kg").withColumn("source", F.lit("messages"))
    part = event_rows(spark, d).withColumn("source", F.lit("events"))
    both = full.unionByName(part, allowMissingColumns=True)
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("ballistic_coef_m2kg").alias("n_bc"), F.min("epoch_dt").alias("first_epoch"))


def window_range_join(spark, d):
    """The snapshots of every window and their mean flux.

    Partitions follow the number of rows, so that a task's rows stay as many; adaptive execution, which joins partitions by
    the bytes shuffled, sees nothing of what a window's rows take in a task. Without more partitions than cores it may.
    """
    parts = tables.parts(table(spark, d, "lineitem").count())
    parts = parts if parts > spark.sparkContext.defaultParallelism else None
    rows = observations(spark, d, by_object=parts).withColumn("epoch_idx", F.row_number().over(ft.by_object()).cast("long") - 1)
    windows = rows.where("epoch_idx >= 19").select("satellite_number", (F.col("epoch_idx") - 19).alias("window_start_idx"), F.col("epoch_idx").alias("window_end_idx"))
    found = targets.window_means(rows.select("satellite_number", "epoch_idx", "solar_flux_f10"), windows, "solar_flux_f10", parts)
    return found.select("satellite_number", "window_end_idx", "n", F.round("mean", 4).alias("mean_flux"))


def target_rows(spark, d):
    """Labelled snapshots of complete sequences, with their number in the windows of their object and size range.

    One shuffle deals the snapshots out by object; all windows are over that, and the result is written in buckets, so
    that splits and labels are joined to it where it is.
    """
    df = elements(spark, d)
    df = df.withColumns({"altitude_band": ft.altitude_band(F.col("perigee_alt_km")), "mean_altitude_km": (F.col("perigee_alt_km") + F.col("apogee_alt_km")) / 2})
    df = df.withColumns({c: ft.risk_features()[c] for c in ("uncertainty_volume_km3", "log_uncertainty_volume")})
    rows = sequences.with_sizes(sequences.complete(sequences.with_sequences(df)))
    own = ft.by_object("size_range")
    rows = rows.withColumns({"i": F.row_number().over(own), "has_future": F.lead("epoch_dt").over(own).isNotNull()})
    kept = rows.select("satellite_number", "epoch_dt", "seq_pos", "size_range", "altitude_band", "uncertainty_volume_km3", "log_uncertainty_volume", "i", "has_future")
    held = tables.write_bucketed(kept, "satellite_number", ["epoch_dt"])
    return targets.with_labels(held, "size_range", written=True).join(sequences.split_table(held), "satellite_number")


def target_summary(spark, d):
    return round_doubles(targets.target_summary(target_rows(spark, d).where("i >= 20")))


def target_checks(spark, d):
    return targets.target_checks(target_rows(spark, d))


def epoch_histogram(spark, d):
    return profile.epoch_histogram(table(spark, d, "events").withColumnRenamed("user_id", "satellite_number"))


def event_series(spark, d):
    """The event stream as a second irregular series, with the columns that gap profiles need."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("satellite_number"), F.col("ts").alias("epoch_dt"), F.col("event_id").alias("l_orderkey"), *(F.lit(0).alias(c) for c in TIE[1:]))


def epoch_shares(spark, d):
    return round_doubles(profile.epoch_shares(event_series(spark, d)))


def epoch_percentiles(spark, d):
    return profile.epoch_percentiles(event_series(spark, d))


def gap_stats(spark, d):
    return round_doubles(profile.gap_stats(event_series(spark, d)), 6)


def gap_regularity(spark, d):
    return round_doubles(profile.object_gaps(event_series(spark, d)), 6)


def red_flags(spark, d):
    return profile.red_flags(observations(spark, d))


def time_range(spark, d):
    return round_doubles(profile.time_range(observations(spark, d)), 6)


def bc_by_epoch_bin(spark, d):
    return round_doubles(profile.bc_by_epoch_bin(observations(spark, d)), 7)


def nearest_epoch(spark, d):
    rows = observations(spark, d).withColumn("epoch_idx", F.row_number().over(ft.by_object()).cast("long") - 1)
    return targets.nearest_epochs(rows)


def ks_two_sample(spark, d):
    seqs = sequences.sequence_table(sequences.complete(sequences.with_sequences(observations(spark, d))))
    both = seqs.join(sequences.rank_split(seqs).select("satellite_number", "split"), "satellite_number")
    out = profile.ks_two_sample(both.where("split = 'train'"), both.where("split = 'val'"), "seq_bc")
    return out.select("n_a", "n_b", F.round("statistic", 6).alias("statistic"), F.round("p_value", 4).alias("p_value"))


def feature_label_corr(spark, d):
    df = targets.with_labels(banded(spark, d).withColumns(ft.size_features()))
    return rounded(profile.label_correlations(df, scaling.feature_columns(df, CORRELATED), "collision_risk"), 5, "r")


def latest_snapshot(spark, d):
    return riskmap.latest(observations(spark, d)).select(*KEY, "epoch_dt", F.round("j2k_pos_x", 4).alias("j2k_pos_x"))


def geodetic(spark, d):
    df = with_geodetic(observations(spark, d))
    return df.select(*KEY, F.round("latitude_deg", 4).alias("latitude_deg"), F.round("longitude_deg", 4).alias("longitude_deg"), F.round("altitude_km", 3).alias("altitude_km"))


def geodetic_summary(spark, d):
    df = with_geodetic(observations(spark, d))
    return df.agg(*(F.round(f(c), 3).alias(f"{n}_{c}") for c in ("latitude_deg", "longitude_deg", "altitude_km") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))


def cells(spark, d):
    """The presence grid, written: at most 583,200 cells, which are read more than once."""
    return tables.held(riskmap.grid(riskmap.with_grid_sigmas(riskmap.debris(riskmap.latest(observations(spark, d))))))


def voxel_grid(spark, d):
    out = riskmap.normalised(cells(spark, d))
    return out.select("alt_i", "lat_i", "lon_i", F.round("pop", 5).alias("pop"), "alt_center", "lat_center", "lon_center")


def grid_marginals(spark, d):
    return rounded(riskmap.marginals(cells(spark, d)), 4, "pop")


def hottest_shell(spark, d):
    return rounded(riskmap.hottest_shell(cells(spark, d)), 4, "pop")


def bc_histogram(spark, d):
    return round_doubles(profile.histogram(observations(spark, d), "ballistic_coef_m2kg", 0.0, 0.1, 60), 6)


def catalog_labels(spark, d):
    known = catalog.enriched(catalog.supplier_catalog(table(spark, d, "supplier")))
    df = catalog.with_catalog(observations(spark, d), known)
    return df.groupBy("satellite_number", "object_class", "debris_cloud_membership").agg(F.count("*").alias("n"), F.round(F.max("catalog_mean_alt_km"), 4).alias("catalog_mean_alt_km"))


def altitude_correlation(spark, d):
    known = catalog.enriched(catalog.supplier_catalog(table(spark, d, "supplier")))
    df = catalog.with_catalog(elements(spark, d), known).where("catalog_mean_alt_km is not null")
    return df.agg(F.count("*").alias("n"), F.round(F.corr("perigee_alt_km", "catalog_mean_alt_km"), 5).alias("altitude_corr"))


def message_ingest(spark, d):
    """All 62 columns of the messages that the snapshots are written as, and the parsed epoch."""
    obs = observations(spark, d, dealt=True)
    parsed = messages.parse_messages(obs.select(F.struct(*TIE).alias("row"), messages.as_text(obs).alias("block")))
    numbers = {c: F.round(c, 4 if "_pos_" in c or "_vel_" in c else 10) for c, kind in messages.COLUMNS.items() if kind == "double"}
    return parsed.withColumns(numbers | {"epoch_dt": messages.epoch_time(F.col("epoch_time_utc"))}).select("row.*", "epoch_dt", *(c for c in messages.COLUMNS if c != "epoch_time_utc"))


def sink_round_trips(spark, d):
    """Snapshots written and read again as Parquet (by name, and with a folder a value), CSV and JSON: rows and sums."""
    df = observations(spark, d).select("satellite_number", "common_name", "l_orderkey", "l_linenumber", "solar_flux_f10")
    schema, root = df.schema.simpleString()[7:-1].replace(":", " "), tables.scratch(spark)
    tables.write_parquet(df, f"{root}/plain")
    tables.write_parquet(df, f"{root}/by_name", ["common_name"])
    tables.write_csv(df, f"{root}/csv")
    tables.write_json(df, f"{root}/json")
    found = {
        "parquet": tables.read_parquet(spark, f"{root}/plain", df.columns), "folders": tables.read_parquet(spark, f"{root}/by_name", df.columns),
        "csv": tables.read_csv(spark, f"{root}/csv", schema), "json": tables.read_json(spark, f"{root}/json", schema),
    }
    sums = [F.count("*").alias("n"), F.countDistinct("common_name").alias("n_names"), F.sum("l_orderkey").alias("sum_key"), F.round(F.sum("solar_flux_f10"), 3).alias("sum_flux")]
    return reduce(DataFrame.unionByName, [x.agg(*sums).withColumn("format", F.lit(name)) for name, x in found.items()])


def grid_round_trip(spark, d):
    """The presence grid written with its axes and read again, with centres joined from the axes' tables."""
    root = tables.scratch(spark)
    tables.write_grid(cells(spark, d), f"{root}/grid")
    read = tables.read_parquet(spark, f"{root}/grid/cells")
    for axis in ("alt", "lat", "lon"):
        read = read.join(tables.read_parquet(spark, f"{root}/grid/axis_{axis}").withColumnRenamed("center", f"{axis}_center"), f"{axis}_i")
    return read.groupBy("alt_center").agg(F.count("*").alias("n_cells"), F.round(F.sum("pop"), 3).alias("pop"), F.min("lat_center").alias("lat_min"), F.max("lon_center").alias("lon_max"))


def catalog_files(spark, d):
    """The catalogue written as a CSV file set for each event, read as one table and made unique."""
    known, root = catalog.supplier_catalog(table(spark, d, "supplier")), tables.scratch(spark)
    events = ["event0", "event1", "event9"]
    for e in events:
        tables.write_csv(known.where(F.col("event_source") == e).drop("event_source"), f"{root}/{e}")
    one = catalog.enriched(catalog.read_catalog(spark, {e: f"{root}/{e}" for e in events}))
    return one.groupBy("event_source", "object_class_catalog").agg(F.count("*").alias("n"), F.round(F.avg("mean_alt_km"), 3).alias("mean_alt_km"))


def parse_summary(spark, d):
    obs = observations(spark, d, dealt=True)
    parsed = messages.parse_messages(obs.select(messages.as_text(obs).alias("block")))
    return messages.parse_summary(parsed)


def j2_acc(spark, d):
    acc = j2_acceleration()
    return observations(spark, d).select(*KEY, *(F.round(c * 1e6, 4).alias(f"{n}_mm_s2") for n, c in acc.items()))


def error_rows(spark, d):
    """Distances of snapshots from their object's first state, carried on as a two-body orbit."""
    return errors.residuals(elements(spark, d))


def propagation_errors(spark, d):
    return rounded(error_rows(spark, d), 3, "alt_km", "days", "err_km")


def divergence(spark, d):
    return rounded(errors.divergence(error_rows(spark, d)), 3, "diverged_days", "last_err_km")


def horizon_error_stats(spark, d):
    return round_doubles(errors.horizon_stats(error_rows(spark, d)), 3)


def regime_errors(spark, d):
    return round_doubles(errors.regime_errors(error_rows(spark, d)), 3)


def worst_objects(spark, d):
    return round_doubles(errors.worst_objects(error_rows(spark, d)), 3)


def error_pivot(spark, d):
    return round_doubles(errors.error_pivot(error_rows(spark, d)), 3)


def altitude_bin_errors(spark, d):
    return round_doubles(errors.altitude_bin_errors(error_rows(spark, d)), 3)


def extreme_objects(spark, d):
    return round_doubles(errors.extreme_objects(error_rows(spark, d)), 3)


def scored_rows(spark, d):
    """The risk label with a score that is a fixed function of the row."""
    df = targets.with_labels(banded(spark, d))
    return df.select(F.col("collision_risk").cast("int").alias("label"), (F.round(F.col("l_extendedprice") / 1100, 0) / 100).alias("score"), *KEY)


def classifier_metrics(spark, d):
    return round_doubles(metrics.classifier_metrics(scored_rows(spark, d)), 6)


def class_weights(spark, d):
    return round_doubles(metrics.class_weights(scored_rows(spark, d)), 6)


def stratified_sample(spark, d):
    df = table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return metrics.stratified_sample(df, "o_orderstatus", 0.1, "o_orderkey")


def forest_windows(spark, d):
    """The last snapshots of windows with all features, labelled, written once by size range; and the features' names."""
    df, features = feature_rows(spark, d)
    df = targets.with_labels(df, "size_name")
    windows = df.withColumn("i", F.row_number().over(ft.by_object("size_name"))).where("i >= 20").select("size_name", "split", "collision_risk", *features)
    root = tables.scratch(spark)
    tables.write_parquet(windows, f"{root}/windows", ["size_name"])
    return tables.read_parquet(spark, f"{root}/windows"), features, root


def forests(spark, d):
    """(size range, its windows, where its forest is saved) for each size range that has rows to fit and to test."""
    windows, features, root = forest_windows(spark, d)
    for size in SIZES:
        own = windows.where(F.col("size_name") == size)
        if own.where("split = 'train'").head() is None or own.where("split = 'test'").head() is None:
            continue
        forest.save_forest(forest.fit_forest(own, features), f"{root}/forests", size)
        yield size, own, f"{root}/forests"


def rf_baseline(spark, d):
    """Metrics of a saved and loaded forest for each size range (three), on its windows' last snapshots, fitted on the train split."""
    found = [metrics.classifier_metrics(forest.scored(forest.load_forest(folder, size), own.where("split = 'test'"))).withColumn("size_range", F.lit(size)) for size, own, folder in forests(spark, d)]
    return reduce(DataFrame.unionByName, found) if found else metrics.classifier_metrics(spark.createDataFrame([], "label int, score double")).withColumn("size_range", F.lit(None).cast("string"))


def rf_importances(spark, d):
    """The features of each size range's forest by importance."""
    found = [forest.importances(spark, forest.load_forest(folder, size)).withColumn("size_range", F.lit(size)) for size, _, folder in forests(spark, d)]
    empty = spark.createDataFrame([], "feature string, importance double, rank int, size_range string")
    return reduce(DataFrame.unionByName, found, empty)


def distinct_bit(number: str, of: str | None = None):
    """(of, word, bit) of a whole number, whose distinct values are so counted exactly, 63 in a row that aggregates combine."""
    word, place = F.expr(f"({number} - pmod({number}, 63L)) div 63"), F.expr(f"shiftleft(1L, cast(pmod({number}, 63L) as int))")
    return F.struct((F.col(of) if of else F.lit(None).cast("string")).alias("of"), word.alias("word"), place.alias("bit"))


def message_folders(spark, d):
    """Snapshots written as message files in numbered folders and read again, by folder in numeric order."""
    obs, root = observations(spark, d, dealt=True), tables.scratch(spark)
    texts = obs.select("satellite_number", messages.as_text(obs).alias("block"))
    for i, folder in enumerate((2, 10, 1)):
        messages.write_messages(texts.where(F.col("satellite_number") % 3 == i), root, folder, compression="gzip")
    read = messages.read_messages(spark, root, "*.txt.gz").withColumn("epoch_dt", messages.epoch_time(F.col("epoch_time_utc")))
    by = read.withColumn("x", F.explode(F.array(distinct_bit("block_no", "source_file"), distinct_bit("satellite_number"))))
    place = F.col("x.of").isNotNull()
    by = by.groupBy("source_folder", "folder_no", "x.of", "x.word").agg(
        F.count_if(place).alias("n"), F.bit_count(F.bit_or("x.bit")).alias("bits"), F.min("epoch_dt").alias("first_epoch"), F.sum(F.when(place, F.col("ballistic_coef_m2kg"))).alias("sum_bc"),
    ).groupBy("source_folder", "folder_no").agg(
        F.sum("n").alias("n"), *(F.coalesce(F.sum(F.when(c, F.col("bits"))), F.lit(0)).cast("long").alias(name) for c, name in ((F.col("of").isNull(), "n_objects"), (F.col("of").isNotNull(), "n_places"))),
        F.min("first_epoch").alias("first_epoch"), F.round(F.sum("sum_bc"), 6).alias("sum_bc"),
    )
    order = F.sum(F.lit(1)).over(Window.orderBy("folder_no")).cast("int")  # a row per folder
    return by.withColumn("folder_rank", order).drop("folder_no")


def bucketed_series(spark, d):
    """Per object, over a table in buckets by object: windows, a join and a group that need no exchange of it."""
    held = tables.write_bucketed(observations(spark, d).select("satellite_number", *ft.TIES, "ballistic_coef_m2kg"), "satellite_number", list(ft.TIES))
    gaps = sequences.with_time_gap(held)
    means = held.groupBy("satellite_number").agg(F.avg("ballistic_coef_m2kg").alias("mean_bc"))
    out = gaps.join(means, "satellite_number").groupBy("satellite_number").agg(F.count("*").alias("n"), F.max("time_gap_days").alias("max_gap"), F.count_if(F.col("ballistic_coef_m2kg") > F.col("mean_bc")).alias("n_above"))
    return rounded(out, 6, "max_gap")


def resumed_stages(spark, d):
    """Stages run to the split, then resumed from the sequences' table for the same input: rows by split and size range.

    The line items are dealt out by object once, before anything is computed, and the tables are in buckets by object. The
    elements, a function of the row alone, are made where the last table is written instead of having tables of their own.
    """
    obs, folder = observations(spark, d), tables.scratch(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tables.parts(table(spark, d, "lineitem").count()))
    known = dict(stages.phases())
    steps = [("sequences", known["sequences"]), stages.fused(("elements", known["elements"]), ("split", known["split"]))]
    stages.run_stages(observations(spark, d, by_object=n), folder, steps[:1], source=stages.fingerprint(obs), by_object=n)
    resumed = stages.run_stages(obs, folder, steps, resume_after=stages.last_written(spark, folder, steps), by_object=n)
    return resumed.groupBy("split", "size_range").agg(F.count("*").alias("n"), F.round(F.avg("perigee_alt_km"), 3).alias("mean_perigee_km"))


def ordered_chunks(spark, d):
    """Objects' snapshots in order, in chunks of 100 as arrays: their ends, and a sum that depends on their order."""
    out = sequences.ordered_chunks(elements(spark, d), ["j2k_pos_x", "j2k_vel_x", "perigee_alt_km", "ballistic_coef_m2kg"], 100)
    weighted = F.aggregate(F.transform("rows", lambda x, i: (i + 1) * x["perigee_alt_km"]), F.lit(0.0), lambda a, x: a + x)
    first, last = F.element_at("rows", 1), F.element_at("rows", -1)
    return out.select("satellite_number", "chunk", "n", first["epoch_dt"].alias("first_epoch"), last["epoch_dt"].alias("last_epoch"), F.round(first["j2k_vel_x"], 4).alias("first_vel_x"), ft.size_range(first["ballistic_coef_m2kg"]).alias("first_size"), F.round(weighted, 2).alias("weighted_alt"))


def data_histograms(spark, d):
    """50 bins each of altitude and of gaps, between their own least and greatest values."""
    df = elements(spark, d)
    gap = ft.seconds_since(F.lag("epoch_dt").over(ft.by_object())) / 86400.0
    held = tables.held(df.select(((F.col("perigee_alt_km") + F.col("apogee_alt_km")) / 2).alias("altitude_km"), gap.alias("gap_days")))
    return rounded(profile.histograms(held, ["altitude_km", "gap_days"], 50), 3, "bin_low", "bin_high")


def schema_entry(spark, d):
    """Two sources through the snapshots' schema, one without the magnetic index and the pressure coefficient, as one table."""
    obs = observations(spark, d)
    poor = obs.where("l_linenumber < 3").drop("average_ap", "solar_rad_press_coeff_m2kg", "common_name")
    both = [schemas.conform(df, schemas.SNAPSHOTS).withColumn("source", F.lit(name)) for name, df in (("full", obs), ("poor", poor))]
    df = reduce(DataFrame.unionByName, both).withColumn("mean_altitude_km", F.lit(700.0))
    df = ft.finite_or_null(df.withColumns(ft.environment_features()))
    return df.groupBy("source").agg(F.count("*").alias("n"), F.count("common_name").alias("n_names"), F.count("srp_acceleration_ms2").alias("n_srp"), F.round(F.avg("kp_index"), 6).alias("mean_kp"), F.round(F.min("kp_index"), 6).alias("min_kp"))


def infinite_to_null(spark, d):
    """How many ratios with a zero or tiny divisor are infinite, and null once infinities are taken out."""
    tiny = F.when(F.col("l_linenumber") == 1, 1e-310).otherwise(F.col("solar_rad_press_coeff_m2kg") + 1e-3)
    df = observations(spark, d).select((F.col("ballistic_coef_m2kg") / tiny * 1e10).alias("ratio"), "solar_flux_f10")
    clean = ft.finite_or_null(df)
    return df.agg(F.count_if(F.abs("ratio") == float("inf")).alias("n_infinite")).crossJoin(clean.agg(F.count_if(F.col("ratio").isNull()).alias("n_null"), F.count("*").alias("n"), F.round(F.log10(F.max("ratio")), 4).alias("log_max")))  # a row each


def spans_of_test(spark, d):
    """Spans of the objects of the test split, with the earliest and latest snapshot of all of them."""
    return rounded(profile.object_spans(split_rows(spark, d).where("split = 'test'").select("satellite_number", "epoch_dt")), 6, "span_days")


def object_periods(spark, d):
    """Per object: gaps, span, and the period of its first snapshot's orbit."""
    gaps = profile.object_gaps(observations(spark, d)).select("satellite_number", "min_gap", "mean_gap", "max_gap", "span_days")
    first = elements(spark, d).groupBy("satellite_number").agg(F.min_by("orbital_period_min", F.struct(*ft.TIES)).alias("period_min"))
    return rounded(gaps.join(first, "satellite_number"), 4, "min_gap", "mean_gap", "max_gap", "span_days", "period_min")


def error_overview(spark, d):
    return round_doubles(errors.error_overview(error_rows(spark, d)), 3)


def grid_summary(spark, d):
    """The written grid's axes, steps and number of objects, read again."""
    near = tables.held(riskmap.with_grid_sigmas(riskmap.debris(riskmap.latest(observations(spark, d)))))  # a row per object
    root = tables.scratch(spark)
    tables.write_grid(riskmap.grid(near), f"{root}/grid", near.count())
    return tables.read_parquet(spark, f"{root}/grid/about")


QUERIES = (
    risk_thresholds_by_band, rtn_frame, rtn_validation, orbital_elements, elements_validation, epoch_sequences, sequence_stats, rank_split, split_profile, split_leaks, size_distribution, time_gaps, trend_features,
    size_features, env_features, risk_features, rtn_products, feature_sanity, null_profile, iqr_outliers, bc_summary, scaler_params, scaled_features, label_encoding, risk_labels, future_targets, sliding_windows,
    window_tensor_stats, windows_with_features, thresholds_of_train, long_spans, object_sample, union_sources, window_range_join, target_summary, target_checks, epoch_histogram, epoch_shares, epoch_percentiles, gap_stats, gap_regularity, red_flags, time_range, bc_by_epoch_bin, nearest_epoch,
    ks_two_sample, feature_label_corr, latest_snapshot, geodetic, geodetic_summary, voxel_grid, grid_marginals, hottest_shell, bc_histogram, catalog_labels, altitude_correlation, message_ingest, parse_summary, sink_round_trips, grid_round_trip, catalog_files,
    propagation_errors, divergence, horizon_error_stats, regime_errors, worst_objects, error_pivot, altitude_bin_errors, extreme_objects, classifier_metrics, class_weights, stratified_sample, rf_baseline,
    window_matrix_export, rf_importances, message_folders, bucketed_series, resumed_stages, ordered_chunks, data_histograms, schema_entry, infinite_to_null, spans_of_test, object_periods, error_overview, grid_summary,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES} | {"j2_acceleration": j2_acc}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL
