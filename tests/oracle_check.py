"""Compares a query with its SQL in DuckDB, row by row."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df, columns):
    def value(x):
        if x is None or x is pd.NA or x != x:
            return None
        return float(x) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else x

    return sorted(str(tuple(map(value, row))) for row in df[columns].astype(object).itertuples(index=False, name=None))


def assert_same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want, got = con.sql(sql).df(), df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a, b = normal(got, columns), normal(want, columns)
    assert len(a) == len(b)
    assert a == b, [x for x in zip(a, b, strict=True) if x[0] != x[1]][:3]
