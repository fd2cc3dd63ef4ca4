"""Risk thresholds by band, labels, next-snapshot targets and sliding windows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitspark.constants import SEQ_LEN
from orbitspark.functions.features import TIES, by_object
from orbitspark.operators.profile import exact_quantiles, same
from orbitspark.operators.sequences import with_history
from orbitspark.sources.tables import held

#: Windows that are made at a time.
SOME = 1024


def band_limits(df: DataFrame, *keys: str, q: float = 0.70, q_secondary: float = 0.90, fit_split: str | None = None, least: int = 0, written: bool = False) -> tuple[DataFrame, DataFrame]:
    """Exact linear quantiles (threshold, secondary_threshold) of log_uncertainty_volume by keys and band, and the rows they are of.

    fit_split takes only the rows of one split; least only objects of at least so many rows. What is read more than once,
    the value and its keys, is written first, unless df is such a table.
    """
    if least:
        df = with_history(df, least)
    if fit_split is not None:
        df = df.where(F.col("split") == fit_split)
    by = [*keys, "altitude_band"]
    values = df.select(*by, "log_uncertainty_volume")
    values = values if written else held(values)
    return exact_quantiles(values, "log_uncertainty_volume", {"threshold": q, "secondary_threshold": q_secondary}, *by), values


def with_limits(df: DataFrame, limits: DataFrame, *keys: str, how: str = "left") -> DataFrame:
    """df with its group's limits, null keys like others. They are few rows, which Spark sees, so that df stays where it is."""
    by = [*keys, "altitude_band"]
    limits = limits.withColumnsRenamed({k: f"__{k}" for k in by})
    return df.join(limits, same(df, limits, {k: f"__{k}" for k in by}), how).drop(*(f"__{k}" for k in by))


def band_thresholds(df: DataFrame, *keys: str, **options) -> DataFrame:
    """Thresholds by keys and band (see band_limits), with n_rows and n_above (strictly above the first)."""
    limits, values = band_limits(df, *keys, **options)
    x = F.col("log_uncertainty_volume")
    counted = with_limits(values.where(x.isNotNull() & ~F.isnan(x)), limits, *keys, how="inner").groupBy(*keys, "altitude_band", "threshold", "secondary_threshold")
    return counted.agg(F.count("*").alias("n_rows"), F.count_if(x > F.col("threshold")).alias("n_above"))


def threshold_report(df: DataFrame, *keys: str) -> DataFrame:
    """Thresholds with the rows strictly above and their share."""
    return band_thresholds(df, *keys).withColumn("ratio_above", F.col("n_above") / F.col("n_rows"))


def with_labels(df: DataFrame, *keys: str, **options) -> DataFrame:
    """collision_risk (above the band's 0.70 quantile) and unc_vol_above_p90 (volume above that of the 0.90 quantile)."""
    joined = with_limits(df, band_limits(df, *keys, **options)[0], *keys)
    return joined.withColumns({
        "collision_risk": F.coalesce(F.col("log_uncertainty_volume") > F.col("threshold"), F.lit(False)),
        "unc_vol_above_p90": F.coalesce(F.col("uncertainty_volume_km3") > F.pow(F.lit(10.0), "secondary_threshold"), F.lit(False)),
    })


def with_future(df: DataFrame, *keys: str) -> DataFrame:
    """The object's next snapshot: position, sigmas, epoch, and whether there is one."""
    w = by_object(*keys)
    ahead = {f"future_pos_{n}": F.lead(f"j2k_pos_{n}").over(w) for n in "xyz"} | {f"future_sigma_{a}": F.lead(f"vector_{u}_sigma_km").over(w) for a, u in zip("rtw", "uvw", strict=True)}
    return df.withColumns(ahead | {"future_epoch_dt": F.lead("epoch_dt").over(w)}).withColumn("has_future", F.col("future_epoch_dt").isNotNull())


def sliding_windows(df: DataFrame, *keys: str, length: int = SEQ_LEN) -> DataFrame:
    """A row per window of so many snapshots, stride 1: its last snapshot with window_id, start and end index, and span."""
    w = by_object(*keys)
    ranked = df.withColumns({"window_end_idx": F.row_number().over(w).cast("long") - 1, "window_first_epoch": F.lag("epoch_dt", length - 1).over(w)})
    full = ranked.where(F.col("window_end_idx") >= length - 1)
    return full.withColumns({"window_start_idx": F.col("window_end_idx") - length + 1, "window_id": F.col("window_end_idx") - length + 1, "window_span_s": F.timestamp_diff("SECOND", F.col("window_first_epoch"), F.col("epoch_dt"))})


def windows_of(df: DataFrame, features: list[str], keys: tuple[str, ...], length: int, keep: list[str], kind: type, made: str, make: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """A row per window of `length` rows: the object, `keep` of its last row, window_end_idx, and the columns (made) of make(values, none).

    values are the features of some windows' rows (window, row, feature) as numbers of a kind, none says which of them are null.
    One shuffle on the object, left out if df is dealt out so, and one sort. Arrow batches then pass one after another: a task
    holds a batch and the `length - 1` rows before it, whatever an object's history.
    """
    by = ["satellite_number", *keys]
    kept = list(dict.fromkeys([*by, *keep]))
    rows = df.repartition("satellite_number").sortWithinPartitions(*by, *TIES).select(*kept, F.array(*(F.col(c).cast("float") for c in features)).alias("__x"))
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, index, before, lost = None, -1, np.empty((0, width), kind), np.empty((0, width), bool)
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column("__x").flatten()
            values, none = (x.to_numpy(zero_copy_only=False).reshape(-1, width) for x in (flat, flat.is_null()))
            # where another group begins: a row that differs from the one ahead, nulls being equal
            new = np.zeros(b.num_rows, bool)
            for c in by:
                codes = b.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            first = tuple(b.column(c)[0].as_py() for c in by)
            new[0] = first != group
            place = np.arange(b.num_rows)
            start = np.maximum.accumulate(np.where(new, place, -1))
            at = np.where(start < 0, index + 1 + place, place - start)
            values, none, ahead = np.concatenate([before, values.astype(kind)]), np.concatenate([lost, none]), len(before)
            full = np.flatnonzero(at >= length - 1)
            for ends in (full[i : i + SOME] for i in range(0, len(full), SOME)):
                taken = b.take(pa.array(ends))
                members = ends[:, None] + np.arange(1 - length, 1) + ahead
                yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in kept), pa.array(at[ends]), *make(values[members], none[members])], names=names)
            group, index = tuple(b.column(c)[-1].as_py() for c in by), int(at[-1])
            before, lost = (x[max(len(x) - length + 1, 0) :].copy() for x in (values, none))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    names = [*kept, "window_end_idx", *re.findall(r"`(\w+)`", made)]
    return rows.mapInArrow(run, f"{types}, window_end_idx long, {made}")


def window_matrices(df: DataFrame, features: list[str], *keys: str, length: int = SEQ_LEN, keep: list[str] | None = None) -> DataFrame:
    """A row per window with matrix: array of `length` feature arrays, oldest first, float for export."""
    width = len(features)

    def make(values: np.ndarray, none: np.ndarray) -> list[pa.Array]:
        cells = pa.array(values.reshape(-1), mask=none.reshape(-1))
        lists = pa.ListArray.from_arrays(np.arange(0, len(cells) + 1, width, dtype=np.int32), cells)
        return [pa.ListArray.from_arrays(np.arange(0, len(lists) + 1, length, dtype=np.int32), lists)]

    return windows_of(df, features, keys, length, keep or [], np.float32, "`matrix` array<array<float>>", make)


def window_sums(df: DataFrame, features: list[str], *keys: str, length: int = SEQ_LEN, keep: list[str] | None = None) -> DataFrame:
    """A row per window: its end, n_rows, and the sum over its rows of every feature, as float for export; null and NaN count as 0.

    Each sum is of its own window's rows, so that a large value blurs no sums but those it is in.
    """

    def make(values: np.ndarray, none: np.ndarray) -> list[pa.Array]:
        sums = np.nan_to_num(values, nan=0.0, posinf=np.inf, neginf=-np.inf).sum(axis=1)
        return [pa.array(np.full(len(sums), length, np.int32)), *(pa.array(c) for c in sums.T.copy())]

    made = ", ".join(["`n_rows` int", *(f"`sum_{c}` double" for c in features)])
    return windows_of(df, features, keys, length, keep or [], np.float64, made, make)


def window_members(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Range join: the rows (satellite_number, epoch_idx) of each window, by object and index between start and end."""
    return members_by_bin(rows, windows).drop("bin")


def members_by_bin(rows: DataFrame, windows: DataFrame, parts: int | None = None) -> DataFrame:
    """The range join, with the bin in which a row met its window, in so many partitions by object and bin.

    Both sides are dealt into bins of the window length as well, so that one object's windows meet only near rows.
    """
    wide = windows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("window_start_idx") / SEQ_LEN), F.floor(F.col("window_end_idx") / SEQ_LEN))))
    binned = rows.withColumn("bin", F.floor(F.col("epoch_idx") / SEQ_LEN))
    if parts:
        binned, wide = (x.repartition(parts, "satellite_number", "bin") for x in (binned, wide))
    return binned.join(wide, ["satellite_number", "bin"]).where(F.col("epoch_idx").between(F.col("window_start_idx"), F.col("window_end_idx")))


def window_means(rows: DataFrame, windows: DataFrame, value: str, parts: int | None = None) -> DataFrame:
    """(satellite_number, window_end_idx, n, mean): the rows of each window and the mean of a value, by the range join.

    Windows are summed where they meet rows first, which needs no shuffle, then over their bins. With parts, every step has
    so many partitions, whatever the session's number.
    """
    window, x = ["satellite_number", "window_end_idx"], F.col(value)
    each = members_by_bin(rows, windows, parts).groupBy("satellite_number", "bin", "window_end_idx").agg(F.count("*").alias("n"), F.count(x).alias("known"), F.sum(x).alias("total"))
    each = each.repartition(parts, *window) if parts else each
    return each.groupBy(*window).agg(F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("known")).alias("mean"))


def nearest_epochs(df: DataFrame, horizons: tuple[float, ...] = (1.0, 3.0, 7.0)) -> DataFrame:
    """(satellite_number, horizon_days, nearest_idx, distance_s): the object's snapshot nearest to its first plus each horizon."""
    past = F.timestamp_diff("SECOND", F.min("epoch_dt").over(Window.partitionBy("satellite_number")), F.col("epoch_dt"))
    rows = df.select("satellite_number", "epoch_idx", past.alias("past"))
    near = [F.min(F.struct(F.abs(F.col("past") - h * 86400).alias("d"), F.col("epoch_idx"))).alias(f"m{i}") for i, h in enumerate(horizons)]
    found = rows.groupBy("satellite_number").agg(*near)
    each = found.select("satellite_number", F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"m{i}").alias("m")) for i, h in enumerate(horizons)))).alias("x"))
    return each.select("satellite_number", F.col("x.h").alias("horizon_days"), F.col("x.m.epoch_idx").alias("nearest_idx"), F.col("x.m.d").alias("distance_s"))


def window_features(windows: DataFrame, rows: DataFrame, features: list[str]) -> DataFrame:
    """Windows (satellite_number, window_end_idx) with the features of their last snapshot, joined on object and index."""
    return windows.join(rows.select("satellite_number", F.col("epoch_idx").alias("window_end_idx"), *features), ["satellite_number", "window_end_idx"])


def target_summary(df: DataFrame) -> DataFrame:
    """By split: windows, windows at risk, their share, and the share with a next snapshot."""
    return df.groupBy("split").agg(F.count("*").alias("n_windows"), F.count_if("collision_risk").alias("n_risk"), F.avg(F.col("collision_risk").cast("double")).alias("risk_ratio"), F.avg(F.col("has_future").cast("double")).alias("future_ratio"))


def target_checks(df: DataFrame) -> DataFrame:
    """One row of booleans: risk share in [0.25, 0.35], all three splits present, at least 0.8 with a next snapshot."""
    return df.agg(F.avg(F.col("collision_risk").cast("double")).between(0.25, 0.35).alias("ratio_ok"), (F.countDistinct("split") == 3).alias("splits_ok"), (F.avg(F.col("has_future").cast("double")) >= 0.8).alias("future_ok"))
