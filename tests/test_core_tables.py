"""Message files in splits, buckets, exact quantiles, codes, models, resumed stages, chunks, histograms and schemas."""

import math
import re
import shutil
from datetime import datetime, timedelta

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SMALL
from orbitspark import queries as core
from orbitspark.functions import features as ft
from orbitspark.operators import forest, profile, scaling, sequences, targets
from orbitspark.plans import stages
from orbitspark.sources import messages, schemas, tables
from orbitspark.sources.obs import observations

# --- message files


@pytest.fixture
def split_bytes(spark):
    key, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")

    def put(n):
        spark.conf.set(key, str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield put
    spark.conf.set(key, old)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def message_file(seed, n=60):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        out.append(f"<> SATELLITE NUMBER: {1000 + i}   INT. DES.: {'Z' * int(rng.integers(9))}X\nCOMMON NAME: {'N' * int(rng.integers(1, 60))}\n")
        out.append(["\n", "", "x", " "][rng.integers(4)] + "Z" * int(rng.integers(10, 34)) + ["\n", "", "\n \n"][rng.integers(3)])
    return "".join(out)


@pytest.mark.parametrize("size", [37, 64, 101, 256, 1000, 10**6])
def test_a_file_in_any_splits_gives_the_same_messages(spark, tmp_path, split_bytes, size):
    split_bytes(size)
    for seed, folder in enumerate(("2", "10", "x3")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.vcm").write_text(message_file(seed))
    read = messages.read_messages(spark, str(tmp_path)).select("folder_no", "source_folder", "block_no", "satellite_number", "common_name", F.spark_partition_id().alias("task"))
    rows = read.orderBy("folder_no", "source_file", "block_no").collect() if "source_file" in read.columns else sorted(read.collect(), key=lambda r: (r["folder_no"], r["block_no"]))
    for seed, folder in enumerate(("2", "10")):
        blocks = [b for b in re.split("Z{10,}", message_file(seed)) if b.strip()]
        plain = messages.parse_messages(spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, block string")).orderBy("i").collect()
        own = [r for r in rows if r["source_folder"] == folder]
        assert [(r["satellite_number"], r["common_name"]) for r in own] == [(r["satellite_number"], r["common_name"]) for r in plain]
        assert len({r["block_no"] for r in own}) == len(own)
        if size <= 256:
            assert len({r["task"] for r in own}) > 1
    assert [r["source_folder"] for r in rows] == ["2"] * sum(r["source_folder"] == "2" for r in rows) + ["10"] * sum(r["source_folder"] == "10" for r in rows)


def test_bad_bytes_are_dropped(spark, tmp_path):
    (tmp_path / "1").mkdir()
    (tmp_path / "1" / "a.vcm").write_bytes(b"COMMON NAME: A\xff\xfeB\xc3\n" + b"Z" * 12 + b"\nCOMMON NAME: \xc3\xa9\xef\xbf\xbd\n")
    rows = messages.read_messages(spark, str(tmp_path)).orderBy("block_no").collect()
    assert [r["common_name"] for r in rows] == ["AB", "é�"]


def test_no_message_files_of_digits(spark, tmp_path):
    (tmp_path / "1a").mkdir()
    (tmp_path / "1a" / "a.vcm").write_text("COMMON NAME: A\n")
    assert not messages.read_messages(spark, str(tmp_path)).count()


# --- buckets


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_buckets_need_no_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("k"), "id", F.rand(1).alias("x"))
    held = tables.write_bucketed(df, "k", ["id"], 4)
    from pyspark.sql import Window

    out = held.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id"))).join(held.groupBy("k").agg(F.avg("x").alias("mean")).hint("merge"), "k").groupBy("k").agg(F.max("n").alias("n"))
    assert exchanges(out) == 0
    assert {(r["k"], r["n"]) for r in out.collect()} == {(k, len(range(k, 1000, 37))) for k in range(37)}


def test_bucketed_query_has_no_exchange_of_its_table(spark):
    assert exchanges(core.bucketed_series(spark, SMALL)) == 0


def test_targets_take_one_shuffle_by_object(spark):
    """What is written in buckets is read without another; the splits' side alone moves."""
    plan = core.target_rows(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(satellite_number") <= 1 and "lineitem" not in plan


# --- quantiles


QS = {"low": 0.0, "a": 0.01, "q": 0.37, "mid": 0.5, "b": 0.999, "high": 1.0}


def quantile_rows():
    rng = np.random.default_rng(4)
    out = [("a", float(x)) for x in rng.normal(size=900)] + [("a", 0.25)] * 500
    out += [("wide", float(x)) for x in rng.lognormal(0, 60, 700)] + [("near", 1e9 + float(x) * 1e-6) for x in rng.normal(size=600)]
    out += [(None, float(i)) for i in range(11)] + [("one", 7.0), ("two", 7.0), ("two", 9.0), ("none", None), ("nan", float("nan")), ("nan", 3.0)]
    return out + [("big", x) for x in (-1.7e308, 1.7e308, 5e-324, 0.0, -0.0, 12.0)] + [("inf", x) for x in (-math.inf, -math.inf, 1.0, 2.0, 3.0, math.inf)]


@pytest.mark.parametrize("options", [{}, {"bins": 64, "few": 1}, {"bins": 8, "few": 40}, {"most_groups": 2}])
def test_quantiles_equal_numpy(spark, options):
    rows = quantile_rows()
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r for r in profile.exact_quantiles(df, "v", QS, "k", **options).collect()}
    groups = {k for k, v in rows if v is not None and v == v}
    assert set(got) == groups
    for k in groups:
        values = [v for kk, v in rows if kk == k and v is not None and v == v]
        if k == "inf":
            ranked = sorted(values)
            assert got[k]["low"] == -math.inf and got[k]["high"] == math.inf and got[k]["mid"] == (ranked[2] + ranked[3]) / 2
            continue
        assert [got[k][q] for q in QS] == pytest.approx([np.quantile(values, p) for p in QS.values()], rel=1e-12), k


def test_quantiles_move_no_rows(spark):
    """What an exchange carries is counts by range, no more than groups, ranges and tasks make."""
    df = spark.range(200_000, numPartitions=4).select((F.col("id") % 3).alias("k"), F.rand(3).alias("v"))
    tracker, group = spark.sparkContext, "quantiles"
    tracker.setJobGroup(group, group)
    got = {r["k"]: r["q"] for r in profile.exact_quantiles(df, "v", {"q": 0.7}, "k", bins=64, few=10_000).collect()}
    tracker.setJobGroup("rest", "rest")
    store, written = spark._jsparkSession.sparkContext().statusStore(), []
    for job in tracker.statusTracker().getJobIdsForGroup(group):
        for stage in tracker.statusTracker().getJobInfo(job).stageIds:
            try:
                written.append(store.lastStageAttempt(stage).shuffleWriteRecords())
            except Py4JJavaError:  # a stage that was skipped
                continue
    assert len(got) == 3 and all(abs(q - 0.7) < 0.01 for q in got.values())
    assert max(written) < 15_000 and sum(written) < 30_000  # of 200,000 rows


def test_quantiles_without_rows(spark):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    assert profile.exact_quantiles(df, "v", {"mid": 0.5}).first()["mid"] is None
    assert not profile.exact_quantiles(df, "v", {"mid": 0.5}, "k").count()


def test_thresholds_keep_a_null_group(spark):
    rows = [(s, "x", float(v)) for s in (None, "s") for v in (1, 2, 3, 10)]
    df = spark.createDataFrame(rows, "size_range string, altitude_band string, log_uncertainty_volume double")
    got = {r["size_range"]: (r["threshold"], r["n_rows"], r["n_above"]) for r in targets.band_thresholds(df, "size_range").collect()}
    assert got == {None: (pytest.approx(3.7), 4, 1), "s": (pytest.approx(3.7), 4, 1)}
    labels = targets.with_labels(df.withColumn("uncertainty_volume_km3", F.lit(1.0)), "size_range")
    assert labels.where("collision_risk").count() == 2


def test_labels_of_objects_with_a_history(spark):
    rows = [(1, "x", float(v)) for v in range(10)] + [(2, "x", 1e6)]
    df = spark.createDataFrame(rows, "satellite_number long, altitude_band string, log_uncertainty_volume double").withColumn("uncertainty_volume_km3", F.lit(1.0))
    assert targets.with_labels(df, least=5).agg(F.min("threshold"), F.max("threshold")).first() == pytest.approx((6.3, 6.3))


def test_regime_edges(spark):
    alts = [-1.0, 0.0, math.nextafter(2000.0, 0.0), 2000.0, 19999.9, 20000.0, 50000.0, None]
    got = [r[0] for r in spark.createDataFrame([(i, a) for i, a in enumerate(alts)], "i int, a double").orderBy("i").select(ft.error_regime(F.col("a"))).collect()]
    assert got == [None, "LEO", "LEO", "MEO", "MEO", "GEO", None, None]


# --- sequences, codes, chunks, histograms


def test_sizes_follow_each_sequence_s_first_row(spark):
    rows = [(1, datetime(2022, 1, 1) + timedelta(hours=i), None if i == 20 else 0.001 * (i + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "satellite_number long, epoch_dt timestamp_ntz, ballistic_coef_m2kg double").withColumns({c: F.lit(0) for c in ft.TIES[1:]})
    got = sequences.with_sizes(sequences.with_sequences(df)).groupBy("sequence_id").agg(F.collect_set("seq_bc").alias("s"), F.max("seq_len").alias("n")).orderBy("sequence_id").collect()
    assert [(r["s"], r["n"]) for r in got] == [([0.001], 20), ([], 20), ([0.041], 20)]


def test_codes_of_sorted_values(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), (None, "y"), ("b", "y")], "c string, d string")
    codes = scaling.encoders(df, ["c", "d"])
    assert sorted(map(tuple, codes.collect())) == [("c", "a", 0), ("c", "b", 1), ("d", "x", 0), ("d", "y", 1)]
    new = spark.createDataFrame([("b", "z"), (None, "y")], "c string, d string")
    assert sorted(map(tuple, scaling.encoded(new, codes, ["c", "d"]).collect()), key=str) == sorted([(1, None), (None, 1)], key=str)


def test_all_features_and_no_leak(spark):
    _, features = core.feature_rows(spark, SMALL)
    assert len(features) == 41 and "collision_risk_proxy" not in features and "altitude_band" in features


def test_chunks_hold_an_object_in_order(spark):
    rows = [(1, datetime(2022, 1, 1) + timedelta(hours=i), i) for i in range(25)] + [(2, datetime(2022, 1, 1), 99)]
    df = spark.createDataFrame(rows, "satellite_number long, epoch_dt timestamp_ntz, v int").withColumns({c: F.lit(0) for c in ft.TIES[1:]}).repartition(7)
    got = sequences.ordered_chunks(df, ["v"], 10).orderBy("satellite_number", "chunk").collect()
    assert [(r["chunk"], r["n"]) for r in got] == [(0, 10), (1, 10), (2, 5), (0, 1)]
    assert [x["v"] for r in got[:3] for x in r["rows"]] == list(range(25))


def test_histograms_of_odd_columns(spark):
    rows = [(float(i), 5.0, None) for i in range(101)] + [(None, None, None), (float("nan"), 5.0, None), (math.inf, 5.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {}
    for r in profile.histograms(df, ["a", "b", "c"], 10).orderBy("bin").collect():
        got.setdefault(r["column_name"], []).append(r["n"])
    assert got == {"a": [10] * 9 + [11], "b": [103] + [0] * 9}
    assert not profile.histograms(df.where("false"), ["a"], 10).count()


# --- models


def test_forest_is_saved_and_loaded(spark, tmp_path):
    df = spark.range(600).select(F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"), (F.col("id") % 7 > 3).alias("collision_risk"), (F.col("id") % 7).alias("a"), F.rand(1).alias("b"), F.lit(float("nan")).alias("c"))
    forest.save_forest(forest.fit_forest(df, ["a", "b", "c"], trees=5, depth=4), str(tmp_path), "m")
    model = forest.load_forest(str(tmp_path), "m")
    out = forest.scored(model, df.where("split = 'test'"))
    assert out.where((F.col("score") > 0.5) == (F.col("label") == 1)).count() == out.count() == 150
    first = forest.importances(spark, model).orderBy("rank").collect()
    assert first[0]["feature"] == "a" and sum(r["importance"] for r in first) == pytest.approx(1) and [r["rank"] for r in first] == [1, 2, 3]


# --- resumed stages


STEPS = [("one", lambda df: df.withColumn("b", F.col("a") + 1)), ("two", lambda df: df.where("b > 2")), ("three", lambda df: df.groupBy().agg(F.sum("b").alias("s")))]


def test_stages_resume_from_the_last_written(spark, tmp_path):
    df, folder = spark.range(10).withColumnRenamed("id", "a"), str(tmp_path)
    assert stages.last_written(spark, folder, STEPS) is None
    stages.run_stages(df, folder, STEPS[:2])
    assert stages.last_written(spark, folder, STEPS) == "two"
    assert stages.run_stages(df, folder, STEPS, resume_after="two").first()["s"] == sum(range(3, 11))
    assert stages.run_stages(None, folder, STEPS, resume_after="one", spark=spark).first()["s"] == sum(range(3, 11))


def test_resume_is_refused(spark, tmp_path):
    df, folder = spark.range(10).withColumnRenamed("id", "a"), str(tmp_path)
    stages.run_stages(df, folder, STEPS[:2])
    with pytest.raises(ValueError, match="another input"):
        stages.run_stages(df.where("a <> 4").unionByName(spark.createDataFrame([(44,)], "a long")), folder, STEPS, resume_after="two")
    with pytest.raises(ValueError, match="other steps"):
        stages.run_stages(df, folder, [("zero", lambda x: x), *STEPS], resume_after="two")
    with pytest.raises(ValueError, match="not written to its end"):
        stages.run_stages(df, folder, STEPS, resume_after="three")
    shutil.rmtree(tmp_path / "two.manifest")
    (tmp_path / "two" / "_SUCCESS").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="not written to its end"):
        stages.run_stages(df, folder, STEPS, resume_after="two")
    spark.range(3).select(F.col("id").alias("a"), F.col("id").alias("b")).write.mode("overwrite").parquet(f"{folder}/one")
    with pytest.raises(ValueError, match="3 rows, of 10"):
        stages.run_stages(df, folder, STEPS, resume_after="one")


def test_a_failed_stage_leaves_no_manifest(spark, tmp_path):
    df, folder = spark.range(10).withColumnRenamed("id", "a"), str(tmp_path)
    stages.run_stages(df, folder, STEPS)
    broken = [STEPS[0], ("two", lambda x: x.withColumn("c", F.raise_error(F.lit("broken")).cast("int"))), STEPS[2]]
    with pytest.raises(Exception, match="broken"):
        stages.run_stages(df, folder, broken)
    assert stages.last_written(spark, folder, STEPS) == "one"


def test_fingerprint_is_of_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    assert stages.fingerprint(df) == stages.fingerprint(df.repartition(3).select("b", "a")) != stages.fingerprint(df.distinct())


# --- schemas


def test_missing_columns_get_defaults_and_wrong_types_are_named(spark):
    obs = observations(spark, SMALL)
    got = schemas.conform(obs.drop("average_ap", "epoch_rev"), schemas.SNAPSHOTS, keep=("l_orderkey",))
    assert got.columns == [f.name for f in schemas.SNAPSHOTS] + ["l_orderkey"]
    row = got.withColumn("mean_altitude_km", F.lit(500.0)).withColumns(ft.environment_features()).first()
    assert row["kp_index"] == pytest.approx(1.1) and row["epoch_rev"] is None
    with pytest.raises(ValueError, match="average_ap is string, not double"):
        schemas.conform(obs.withColumn("average_ap", F.lit("7")), schemas.SNAPSHOTS)
    with pytest.raises(ValueError, match="j2k_pos_x is missing"):
        schemas.conform(obs.drop("j2k_pos_x"), schemas.SNAPSHOTS)
    assert schemas.conform(obs.withColumn("satellite_number", F.col("satellite_number").cast("int")), schemas.SNAPSHOTS).schema["satellite_number"].dataType == T.LongType()
    assert schemas.struct_of(schemas.CATALOG)["NORAD_CAT_ID"].nullable is False
