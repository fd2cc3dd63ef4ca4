"""Steps whose work must not grow faster than their input: what their plans do, and that they give the same rows."""

import re
from datetime import datetime

from conftest import SMALL
from orbitspark import queries as core
from orbitspark.operators import profile, riskmap, sequences, targets
from orbitspark.plans import stages
from orbitspark.sources import tables
from orbitspark.sources.obs import observations


def plan_of(df, executed=False):
    plans = df._jdf.queryExecution()
    return (plans.executedPlan() if executed else plans.sparkPlan()).toString()


def test_latest_sees_whole_rows_of_last_times_only(spark):
    a, b = datetime(2022, 1, 1), datetime(2022, 1, 2)
    rows = [(1, a, 9, 1, 1, 1.0, "old"), (1, b, 1, 1, 1, 1.0, "tie lost"), (1, b, 2, 1, 1, 1.0, "kept"), (None, b, 1, 1, 1, 1.0, "no number"), (2, None, 3, 1, 1, 1.0, "no time"), (3, None, 1, 1, 1, 1.0, "null first"), (3, a, 1, 1, 1, 1.0, "timed")]
    df = spark.createDataFrame(rows, "satellite_number long, epoch_dt timestamp_ntz, l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, what string")
    got = {(r["satellite_number"], r["what"]) for r in riskmap.latest(df).collect()}
    assert got == {(1, "kept"), (None, "no number"), (2, "no time"), (3, "timed")}
    assert "LeftSemi" in plan_of(riskmap.latest(observations(spark, SMALL)))


def test_few_quantiles_are_joined_without_sorting_the_values(spark):
    values = observations(spark, SMALL).selectExpr("common_name", "solar_flux_f10 as x")
    found = profile.exact_quantiles(values, "x", {"q": 0.5}, "common_name")
    assert "SortMergeJoin" not in plan_of(values.join(found, "common_name"))
    assert "SortMergeJoin" not in plan_of(profile.iqr_outliers(observations(spark, SMALL), core.PROFILED))
    assert "SortMergeJoin" not in plan_of(targets.with_labels(core.banded(spark, SMALL)))


def test_quantile_passes_shuffle_counts_only(spark):
    """Each job of the passes over the values, as its plan is before it runs."""
    plans, join = [], profile.at_ranks

    def seen(rows, wanted, first, end):
        plans.append(plan_of(rows))
        return join(rows, wanted, first, end)

    profile.at_ranks = seen
    try:
        values = observations(spark, SMALL).selectExpr("common_name", "ballistic_coef_m2kg as x")
        profile.exact_quantiles(values, "x", {"q": 0.5}, "common_name", bins=8, few=4)
    finally:
        profile.at_ranks = join
    assert plans and not any("SortMergeJoin" in p for p in plans)


def test_sequences_are_made_once_for_all_their_statistics(spark):
    assert "Window" not in plan_of(core.sequence_stats(spark, SMALL))
    assert "Window" not in plan_of(profile.bc_by_epoch_bin(observations(spark, SMALL)))


def test_features_are_made_by_compiled_methods_and_joined_to_codes_where_they_are(spark):
    rows, _ = core.feature_rows(spark, SMALL)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    assert "SortMergeJoin" not in plan_of(rows)


def test_range_join_takes_more_partitions_for_more_rows(spark, monkeypatch):
    """With a partition's rows bounded, every exchange of the join and its sums is as wide as the table needs; results stay."""
    few = core.window_range_join(spark, SMALL)
    want = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(tables, "PART_ROWS", 500)
    n = tables.parts(observations(spark, SMALL).count())
    many = core.window_range_join(spark, SMALL)
    assert n > spark.sparkContext.defaultParallelism
    widths = {int(w) for w in re.findall(r"hashpartitioning\([^()]*, (\d+)\)", plan_of(many, executed=True))}
    assert widths == {n}
    assert sorted(map(tuple, many.collect())) == want


def test_stages_shuffle_rows_once_and_write_each_column_of_a_row_alone_once(spark, monkeypatch):
    """Tables in buckets by object, which a resumed run knows; the elements are in the last table only, which is whole."""
    folders, scratch = [], tables.scratch
    monkeypatch.setattr(core.tables, "scratch", lambda s: folders.append(scratch(s)) or folders[-1])
    core.resumed_stages(spark, SMALL)
    first = spark.read.parquet(f"{folders[0]}/sequences")
    last = spark.read.parquet(f"{folders[0]}/elements-split")
    made = set(core.elements(spark, SMALL).columns) - set(observations(spark, SMALL).columns)
    assert made and not made & set(first.columns) and made | set(first.columns) | {"seq_bc", "size_range", "split"} == set(last.columns)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    again = stages.checked(spark, folders[0], "sequences", ["sequences"], None)
    assert "Exchange" not in plan_of(sequences.with_sizes(again), executed=True)
    assert "Exchange" not in plan_of(tables.write_bucketed(again, "satellite_number", ["epoch_dt"], n), executed=True)
    dealt = sequences.with_sequences(observations(spark, SMALL, by_object=n))
    exchanges = re.findall(r"Exchange [^\n]*", plan_of(dealt, executed=True))
    assert len(exchanges) == 1 and "l_suppkey" in exchanges[0]
    want = core.split_rows(spark, SMALL, with_orbit=True)
    assert last.exceptAll(want.select(*last.columns)).isEmpty() and last.count() == want.count()
