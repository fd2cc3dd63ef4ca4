"""Every window of the range join."""

import math
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from conftest import SMALL
from oracle_check import TABLES
from orbitspark import queries as core
from orbitspark.functions import features as ft
from orbitspark.operators import targets
from orbitspark.sources.obs import observations


def test_range_join_has_every_window(spark):
    got = {(r["satellite_number"], r["window_end_idx"]): (r["n"], r["mean_flux"]) for r in core.window_range_join(spark, SMALL).collect()}
    rows = observations(spark, SMALL).select("satellite_number").collect()
    lengths = defaultdict(int)
    for r in rows:
        lengths[r["satellite_number"]] += 1
    assert set(got) == {(s, i) for s, n in lengths.items() for i in range(19, n)}
    assert {n for n, _ in got.values()} == {20}
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.sql(core.oracle_sql()["window_range_join"]).df().itertuples(index=False)
    want = {(r.satellite_number, r.window_end_idx): (r.n, r.mean_flux) for r in want}
    assert want == got


def test_windows_pass_in_batches(spark):
    """Windows over Arrow batches that cut objects anywhere, with null and NaN among the values, and no window operator over wide rows."""
    rows = [(s, size, i, *(None if (i + j) % 11 == 0 else math.nan if (i + j) % 13 == 0 else float(i * (j + 1) + (s or 0)) for j in range(3))) for s, size, n in ((1, "a", 30), (1, None, 9), (2, "a", 3), (None, "a", 17), (3, "b", 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "satellite_number long, size_name string, l_orderkey long, x double, y double, z double").withColumns({c: F.lit(0) for c in ft.TIES if c != "l_orderkey"}).repartition(5)
    df, want = df.withColumn("split", F.concat(F.lit("s"), "l_orderkey")), {}
    groups = defaultdict(list)
    for s, size, _, *x in rows:
        groups[s, size].append(x)
    for (s, size), own in groups.items():
        for end in range(3, len(own)):
            want[s, size, end] = own[end - 3 : end + 1]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        matrices, sums = (f(df, ["x", "y", "z"], "size_name", length=4, keep=["split"]) for f in (targets.window_matrices, targets.window_sums))
        plan = sums._jdf.queryExecution().sparkPlan().toString()
        assert "Window" not in plan and plan.count("Exchange") <= 2
        got = {(r["satellite_number"], r["size_name"], r["window_end_idx"]): r["matrix"] for r in matrices.collect()}
        assert str(got) == str({k: want[k] for k in got}) and set(got) == set(want)
        rows = sums.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plain = lambda x: 0.0 if x is None or math.isnan(x) else x
    assert {(r["satellite_number"], r["size_name"], r["window_end_idx"]): [r["sum_x"], r["sum_y"], r["sum_z"]] for r in rows} == {k: [sum(map(plain, c)) for c in zip(*m, strict=True)] for k, m in want.items()}
    assert len(rows) == len(want) and all(r["n_rows"] == 4 and r["split"] == f"s{r['window_end_idx']}" for r in rows)
