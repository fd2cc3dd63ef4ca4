"""Hand-computed rows and invariants."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from orbitspark.constants import GM, R_EARTH
from orbitspark.functions import features as ft
from orbitspark.functions.orbital import with_geodetic
from orbitspark.operators import errors, metrics, profile, riskmap, sequences, targets
from orbitspark.plans import stages
from orbitspark.sources import catalog, messages
from orbitspark.sources.obs import observations


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).withColumn("out", column).orderBy("i").select("out").collect()]


def test_bands_sizes_classes_density(spark):
    band = values(spark, ft.altitude_band(F.col("a")), [(199.9,), (200.0,), (400.0,), (600.0,), (800.0,), (1000.0,), (None,), (float("nan"),)], "a double")
    assert band == ["<200km", "200-400km", "400-600km", "600-800km", "800-1000km", "1000+km", "1000+km", "1000+km"]
    assert values(spark, ft.size_range(F.col("a")), [(0.00244,), (0.0061,), (0.0062,), (-1.0,), (None,)], "a double") == ["25-50cm", "10-25cm", "5-10cm", "25-50cm", None]
    names = [("FENGYUN 1C DEB",), ("SL-16 R/B",), ("TEST PL",), ("IRIDIUM 33",), ("XYZ",), (None,)]
    assert values(spark, ft.object_class(F.col("a")), names, "a string") == ["fragmentation_debris", "rocket_body", "payload", "payload", "unknown", "unknown"]
    rho = values(spark, ft.density(F.col("a"), F.col("f")), [(150.0, 70.0), (350.0, 100.0), (450.0, 1000.0), (float("nan"), 100.0)], "a double, f double")
    assert rho[:3] == pytest.approx([1e-10, 5e-12, 4e-12]) and math.isnan(rho[3])


def test_voxel_and_geodetic(spark):
    assert values(spark, riskmap.voxel(F.col("a"), "alt"), [(100.0,), (225.0,), (226.0,), (3000.0,)], "a double") == [0, 0, 1, 35]
    r = with_geodetic(spark.createDataFrame([(R_EARTH + 500, 0.0, 0.0), (0.0, 0.0, -7000.0)], "efg_pos_x double, efg_pos_y double, efg_pos_z double")).collect()
    assert r[0]["latitude_deg"] == pytest.approx(0) and r[0]["altitude_km"] == pytest.approx(500)
    assert r[1]["latitude_deg"] == pytest.approx(-90) and r[1]["altitude_km"] == pytest.approx(7000 - 6356.752, abs=0.01)


def test_window_range_join(spark):
    rows = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0), (2, 0, 4.0), (2, 1, 5.0)], "satellite_number long, epoch_idx long, x double")
    windows = spark.createDataFrame([(1, 0, 2), (2, 0, 1)], "satellite_number long, window_start_idx long, window_end_idx long")
    assert targets.window_members(rows, windows).count() == 5


def test_threshold_is_linear_and_strict(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 10)], "altitude_band string, log_uncertainty_volume double")
    r = targets.threshold_report(df).first()
    assert r["threshold"] == pytest.approx(3.7) and r["ratio_above"] == 0.25


def test_latest_is_by_time(spark):
    rows = [(1, datetime(2022, 4, 10, 23), 1), (1, datetime(2022, 4, 11, 0), 2)]
    df = spark.createDataFrame(rows, "satellite_number long, epoch_dt timestamp_ntz, v int").withColumns({c: F.lit(0) for c in ft.TIES[1:]})
    assert riskmap.latest(df).first()["v"] == 2


def test_messages(spark, tmp_path):
    one = "SP VECTOR/COVARIANCE MESSAGE - V2.0\n<> SATELLITE NUMBER: 42   INT. DES.: 1993-036A\nCOMMON NAME: OLD\nCOMMON NAME: COSMOS 2251 DEB\nEPOCH TIME (UTC): 2022 244 (01 SEP) 01:38:58.810  EPOCH REV: 77\nJ2K POS (KM): 1.5 -2 3E2\nVECTOR U,V,W SIGMAS (KM): 0.1 0.2 0.3\n"
    two = "SATELLITE NUMBER: 43   INT. DES.: X\nBALLISTIC COEF (M2/KG): 1-2 BDOT (M2/KG-S): 0.5\n"
    for folder in ("7", "x1"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.vcm").write_text(one + "ZZZZZZZZZZZZ\n" + two + "ZZZZZZZZZZ\n \n")
    rows = messages.read_messages(spark, str(tmp_path)).orderBy("block_no").withColumn("t", messages.epoch_time(F.col("epoch_time_utc"))).collect()
    assert len(rows) == 2 and rows[0]["source_folder"] == "7" and rows[0]["source_file"] == "a.vcm"
    assert (rows[0]["satellite_number"], rows[0]["common_name"], rows[0]["epoch_rev"]) == (42, "COSMOS 2251 DEB", 77)
    assert rows[0]["t"] == datetime(2022, 9, 1, 1, 38, 58, 810000) and rows[0]["j2k_pos_z"] == 300.0 and rows[0]["vector_w_sigma_km"] == 0.3
    assert rows[1]["ballistic_coef_m2kg"] is None and rows[1]["bdot_m2kg_s"] == 0.5 and rows[1]["vector_u_sigma_km"] is None
    assert len(messages.parse_messages(spark.createDataFrame([("x",)], "block string")).columns) == 62


def test_circular_orbit_returns(spark):
    """After whole and third periods a circular orbit is where it should be; an unbound state has no place."""
    r = R_EARTH + 500
    v, period = math.sqrt(GM / r), 2 * math.pi * math.sqrt(r**3 / GM)
    rows = [(r, 0.0, 0.0, 0.0, v, 0.0, period / 3), (r, 0.0, 0.0, 0.0, v, 0.0, 7 * period), (r, 0.0, 0.0, 0.0, 2 * v, 0.0, 100.0)]
    names = [f"__{c}" for c in errors.STATE] + ["dt"]
    got = errors.carried(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))).collect()
    assert (got[0]["at_x"], got[0]["at_y"]) == pytest.approx((r * math.cos(2 * math.pi / 3), r * math.sin(2 * math.pi / 3)), abs=1e-6)
    assert (got[1]["at_x"], got[1]["at_y"]) == pytest.approx((r, 0), abs=1e-4) and got[2]["at_x"] is None


def test_eccentric_orbit_equals_small_steps(spark):
    """Against a plain integration in steps of a tenth of a second."""
    s = np.array([7000.0, 100.0, -300.0, 0.5, 8.6, 1.2])
    names = [f"__{c}" for c in errors.STATE] + ["dt"]
    got = errors.carried(spark.createDataFrame([(*map(float, s), 2000.0)], ", ".join(f"{c} double" for c in names))).first()
    p, v, h = s[:3].copy(), s[3:].copy(), 0.1
    pull = lambda x: -GM * x / np.linalg.norm(x) ** 3
    for _ in range(20_000):
        half = v + h / 2 * pull(p)
        p = p + h * half
        v = half + h / 2 * pull(p)
    assert np.abs(np.array([got["at_x"], got["at_y"], got["at_z"]]) - p).max() < 1e-2


def test_residuals_cover_all_objects(spark):
    df = observations(spark, SMALL).withColumn("perigee_alt_km", F.lit(500.0)).where("epoch_dt < timestamp'2022-09-06'")
    got = {r["satellite_number"] for r in errors.residuals(df).collect()}
    many = {r["satellite_number"] for r in df.groupBy("satellite_number").count().where("count > 1").collect()}
    assert got == many


def test_exact_quantiles(spark):
    """Against numpy, with a value that a third of all rows have, few rows, and none."""
    rng = np.random.default_rng(4)
    rows = [("a", float(x)) for x in rng.normal(size=700)] + [("a", 0.25)] * 350 + [("b", 7.0), ("b", 9.0), ("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"low": 0.0, "q": 0.37, "mid": 0.5, "high": 1.0}
    got = {r["k"]: r for r in profile.exact_quantiles(df, "v", wanted, "k").collect()}
    assert set(got) == {"a", "b", "c"}
    for k in got:
        values = [v for kk, v in rows if kk == k]
        assert [got[k][q] for q in wanted] == pytest.approx([np.quantile(values, p) for p in wanted.values()])
    assert profile.quantiles_of_counts(profile.value_counts(df.where("k = 'd'"), "v"), wanted).first()["mid"] is None


def test_history_span_and_sample(spark):
    rows = [(1, datetime(2022, 1, 1, i)) for i in range(12)] + [(2, datetime(2022, 1, 1, 0, i)) for i in range(12)] + [(3, datetime(2022, 1, 1)), (3, datetime(2022, 1, 2))]
    df = spark.createDataFrame(rows, "satellite_number long, epoch_dt timestamp_ntz")
    objects = lambda x: {r["satellite_number"] for r in x.collect()}
    assert objects(sequences.with_history(df)) == {1, 2} and objects(sequences.with_span(df)) == {1, 3}
    assert objects(sequences.sampled_objects(df, 2)) == objects(sequences.sampled_objects(df.repartition(5), 2)) and len(objects(sequences.sampled_objects(df, 2))) == 2


def test_zero_sigmas(spark):
    got = spark.createDataFrame([(0.0, 0.0, 0.0)], "vector_u_sigma_km double, vector_v_sigma_km double, vector_w_sigma_km double").select(ft.rtn_products()["log_rtn_uncertainty"].alias("x")).first()
    assert got["x"] == pytest.approx(-15)


def test_message_lines_are_strict(spark):
    block = "  COMMON NAME: LED BY SPACES\n<>   COMMON NAME:  TWO  WORDS \t\nJ2K POS (KM): 1 2 3 4\nJ2K VEL (KM/S): 1 2\nECI POS (KM): 1 x 3\nEFG POS (KM): 7 8 9\nEFG POS (KM): 7 8\nSOLAR FLUX:  F10:1.5 AVERAGE F10: 2 AVERAGE AP: 3\nEPOCH TIME (UTC): 2022 244 EPOCH REV: x1\nPOLAR MOT X,Y (ARCSEC): .1 -.2 IAU 1980 NUTAT: 4 terms\nMESSAGE TIME (UTC): now CENTER:\n"
    r = messages.parse_messages(spark.createDataFrame([(block,), (None,)], "block string")).collect()
    assert r[0]["common_name"] == "TWO  WORDS" and r[0]["j2k_pos_x"] is None and r[0]["j2k_vel_x"] is None and r[0]["eci_pos_z"] is None
    assert (r[0]["efg_pos_x"], r[0]["efg_pos_z"]) == (7.0, 9.0) and (r[0]["solar_flux_f10"], r[0]["average_f10"], r[0]["average_ap"]) == (1.5, 2.0, 3.0)
    assert r[0]["epoch_rev"] is None and (r[0]["polar_mot_x_arcsec"], r[0]["polar_mot_y_arcsec"], r[0]["iau_1980_nutat"]) == (0.1, -0.2, "4 terms")
    assert (r[0]["message_time_utc"], r[0]["center"]) == ("now", "") and all(r[1][c] is None for c in messages.COLUMNS)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1)], "label int, score double")
    r = metrics.classifier_metrics(df).first()
    assert r["roc_auc"] == pytest.approx((0.5 + 1 + 0 + 1) / 4) and (r["tp"], r["fp"], r["fn"], r["tn"]) == (2, 1, 0, 1)


def test_window_invariants(spark):
    obs = observations(spark, SMALL)
    n = obs.count()
    objects = obs.select("satellite_number").distinct().count()
    assert targets.sliding_windows(obs).count() == n - 19 * objects


def test_stages_resume(spark, tmp_path):
    known = catalog.enriched(catalog.supplier_catalog(spark.read.parquet(f"{SMALL}/supplier.parquet")))
    steps = stages.phases(known)
    out = stages.run_stages(observations(spark, SMALL), str(tmp_path), steps)
    assert {"collision_risk", "split", "size_range", "object_class", "future_epoch_dt"} <= set(out.columns)
    rows = out.count()
    again = stages.run_stages(None, str(tmp_path), steps, resume_after="split", spark=spark)
    assert again.count() == rows > 0


def test_ks_of_equal_samples_is_zero(spark):
    df = spark.createDataFrame([(float(i),) for i in range(50)], "x double")
    r = profile.ks_two_sample(df, df, "x").first()
    assert r["statistic"] == 0


def test_stream_parses_messages(spark, tmp_path):
    from orbitspark.streaming.ingest import stream_messages

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("SATELLITE NUMBER: 5   INT. DES.: X\nEPOCH TIME (UTC): 2022 244 (01 SEP) 01:38:58  EPOCH REV: 1\n")
    q = stream_messages(spark, str(tmp_path / "in")).select("satellite_number", "epoch_dt").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").first()["satellite_number"] == 5
