"""Profiles of time, size and feature distributions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitspark.functions.features import by_object, seconds_since
from orbitspark.sources.tables import held

#: Groups whose quantiles are found together with the driver's help; more go another way.
MOST_GROUPS = 1024
#: Ranges that a group's values are counted in, and values of such a range that are put in order at the end.
BINS, FEW = 4096, 100_000

#: Labels and lower bounds of the bins of snapshots per object.
EPOCH_BINS = [("1", 1), ("2-5", 2), ("5-10", 5), ("10-20", 10), ("20-50", 20), ("50+", 50)]


def epoch_bin(n: Column) -> Column:
    return reduce(lambda out, b: F.when(n >= b[1], b[0]).otherwise(out), EPOCH_BINS[1:], F.lit(EPOCH_BINS[0][0]))


def epoch_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("satellite_number").agg(F.count("*").alias("n_epochs"))


def epoch_histogram(df: DataFrame) -> DataFrame:
    return epoch_counts(df).groupBy(epoch_bin(F.col("n_epochs")).alias("epoch_bin")).agg(F.count("*").alias("n_objects"))


def epoch_shares(df: DataFrame) -> DataFrame:
    n = F.col("n_epochs")
    return epoch_counts(df).agg(*(F.avg((n >= k).cast("double")).alias(f"share_{k}") for k in (10, 20, 50)), F.count("*").alias("n_objects"))


def epoch_percentiles(df: DataFrame) -> DataFrame:
    """Discrete percentiles of snapshots per object; the recommended sequence length is the 75th."""
    return epoch_counts(df).agg(*(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY n_epochs)").cast("long").alias(f"p{p}") for p in (50, 75, 90))).withColumn("recommended_length", F.col("p75"))


def gaps(df: DataFrame) -> DataFrame:
    """Days between an object's successive snapshots, without its first."""
    gap = seconds_since(F.lag("epoch_dt").over(by_object())) / 86400.0
    return df.withColumn("gap_days", gap).where("gap_days is not null")


def gap_stats(df: DataFrame) -> DataFrame:
    g, rows = "gap_days", held(gaps(df).select("gap_days"))
    one = rows.agg(F.count(g).alias("n"), F.avg(g).alias("mean"), F.stddev_samp(g).alias("std"), F.min(g).alias("min"), F.max(g).alias("max"))
    return one.crossJoin(exact_quantiles(rows, g, {"median": 0.5}))  # a row each


def object_gaps(df: DataFrame) -> DataFrame:
    """Per object: smallest, mean and largest gap, span, and the variation of gaps with whether they are regular."""
    g = F.col("gap_days")
    out = gaps(df).groupBy("satellite_number").agg(F.min(g).alias("min_gap"), F.avg(g).alias("mean_gap"), F.max(g).alias("max_gap"), F.sum(g).alias("span_days"), F.try_divide(F.stddev_samp(g), F.avg(g)).alias("gap_cv"))
    return out.withColumn("regular", F.coalesce(F.col("gap_cv") < 1e-6, F.lit(False)))


def object_spans(df: DataFrame) -> DataFrame:
    """Per object: first and last snapshot, span in days, and beside it the earliest and latest of all objects."""
    own = df.groupBy("satellite_number").agg(F.min("epoch_dt").alias("first_epoch"), F.max("epoch_dt").alias("last_epoch"), F.count("*").alias("n"))
    bounds = df.agg(F.min("epoch_dt").alias("earliest"), F.max("epoch_dt").alias("latest"))
    return own.withColumn("span_days", F.timestamp_diff("SECOND", F.col("first_epoch"), F.col("last_epoch")) / 86400.0).crossJoin(bounds)  # one row


def red_flags(df: DataFrame) -> DataFrame:
    """One row of booleans: under 10 % regular objects, a gap over 30 days, over half of the objects with one snapshot."""
    per_object = epoch_counts(df).join(object_gaps(df), "satellite_number", "left")
    return per_object.agg((F.avg(F.coalesce(F.col("regular"), F.lit(False)).cast("double")) < 0.1).alias("few_regular"), F.coalesce(F.max("max_gap") > 30, F.lit(False)).alias("long_gap"), (F.avg((F.col("n_epochs") == 1).cast("double")) > 0.5).alias("single_epochs"))


def time_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("epoch_dt").alias("first_epoch"), F.max("epoch_dt").alias("last_epoch"), (F.timestamp_diff("SECOND", F.min("epoch_dt"), F.max("epoch_dt")) / 86400.0).alias("days"))


def bc_by_epoch_bin(df: DataFrame) -> DataFrame:
    """Coefficient statistics by the object's number of snapshots, counted over a window instead of a join back."""
    n = F.count("*").over(Window.partitionBy("satellite_number"))
    bc = "ballistic_coef_m2kg"
    binned = held(df.select(epoch_bin(n).alias("epoch_bin"), bc))
    stats = binned.groupBy("epoch_bin").agg(F.avg(bc).alias("bc_mean"), F.stddev_samp(bc).alias("bc_std"), F.count("*").alias("n_rows"))
    return stats.join(exact_quantiles(binned, bc, {"bc_median": 0.5}, "epoch_bin"), "epoch_bin", "left")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.unpivot([], columns, "column_name", "n_null")


def iqr_outliers(df: DataFrame, columns: list[str], width: float = 3.0) -> DataFrame:
    """Per column: quartiles, fences, and the rows outside them."""
    values = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "column_name", "value").where("value is not null")
    rows = exact_quantiles(values, "value", {"q1": 0.25, "q3": 0.75}, "column_name")
    rows = rows.withColumns({"low": F.col("q1") - width * (F.col("q3") - F.col("q1")), "high": F.col("q3") + width * (F.col("q3") - F.col("q1"))})
    outside = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    return values.join(rows, "column_name").groupBy("column_name", "q1", "q3", "low", "high").agg(F.count_if(outside).alias("n_outliers"), F.count("*").alias("n"))


def value_counts(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, x, n): how often each value occurs by keys, nulls left out; combinable, so that a common value is one row early."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("x")).agg(F.count("*").alias("n"))


def same(a: DataFrame, b: DataFrame, pairs: dict[str, str]) -> Column:
    """The condition that columns of a equal those of b, null with null."""
    return reduce(Column.__and__, (a[x].eqNullSafe(b[y]) for x, y in pairs.items()), F.lit(True))


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """The range of equal width between low and high that x is in, in the order of values; infinities have one of their own."""
    half = high / 2 - low / 2  # a half, as the whole may be too large for a number
    at = F.least(F.greatest(F.floor((x / 2 - low / 2) / half * bins), F.lit(0)), F.lit(bins - 1))
    inside = F.when(half > 0, at).when(x > low, bins - 1).otherwise(0)
    return F.when(x == -math.inf, -1).when(x == math.inf, bins).otherwise(inside).cast("int")


def at_ranks(rows: DataFrame, wanted: dict[int, list], first: Column, end: Column) -> dict:
    """The rows (g, ...) of which the places from first to before end hold a wanted rank of their range, by range and rank."""
    ranks = rows.sparkSession.createDataFrame(sorted({(g, r) for g, own in wanted.items() for r, _, _ in own}), "of int, rank long")
    hit = (F.col("g") == F.col("of")) & (F.col("rank") >= first) & (F.col("rank") < end)
    return {(r["g"], r["rank"]): r for r in rows.join(F.broadcast(ranks), hit).collect()}


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], *keys: str, bins: int = BINS, few: int = FEW, most_groups: int = MOST_GROUPS) -> DataFrame:
    """Linear quantiles of a column by keys, a column for each; without keys one row, null for no values.

    Nulls and NaN are left out; a null key is a group like others. No row is shuffled: values are counted by ranges, which
    combines before the exchange, and the range that holds a wanted rank is known then. If it holds more than a few
    values it is cut into ranges again, between its own least and greatest value, or at approximate quantiles, each
    a range of its own, if it has kept most of what was cut; the few that remain are put in order. The driver sees a row
    for each group and wanted rank. Beyond MOST_GROUPS groups, see quantiles_of_counts.
    """
    spark, x = df.sparkSession, F.col(value).cast("double")
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), x.alias("x"))
    finite = F.when(F.abs("x") < math.inf, F.col("x"))
    ends = rows.groupBy(*names).agg(F.count("*").alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high"))
    groups = ends.limit(most_groups + 1).collect()
    if len(groups) > most_groups:
        return quantiles_of_counts(value_counts(rows.withColumnsRenamed(dict(zip(names, keys, strict=True))), "x", *keys), quantiles, *keys)

    places = [{q: (g["n"] - 1) * at for q, at in quantiles.items()} if g["n"] else {} for g in groups]
    # (place in the range, group, place in the group) of what is wanted, by range
    wanted = {i: sorted({(r, i, r) for h in own.values() for r in (math.floor(h), math.ceil(h))}) for i, own in enumerate(places) if own}
    found: dict[tuple[int, int], float] = {}
    key_types = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    local = spark.createDataFrame([(i, *(groups[i][n] for n in names), groups[i]["low"], groups[i]["high"]) for i in wanted], "g int, " + (key_types + ", " if names else "") + "low double, high double")
    dealt = rows.join(F.broadcast(local), same(rows, local, {n: n for n in names})).select("g", "x", "low", "high")
    dealt = dealt.withColumn("edges", F.lit(None).cast("array<double>"))
    sizes = {i: groups[i]["n"] for i in wanted}
    while wanted:
        cut = F.when(F.col("edges").isNull(), bin_of(F.col("x"), F.col("low"), F.col("high"), bins)).otherwise(2 * F.size(F.filter("edges", lambda e: e < F.col("x"))) + F.array_contains("edges", F.col("x")).cast("int"))
        binned = dealt.select("g", "x", cut.alias("bin"))
        counted = binned.groupBy("g", "bin").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        ahead = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        counted = counted.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        bins_of = at_ranks(counted, wanted, F.col("before"), F.col("before") + F.col("n"))
        left: dict[tuple[int, int], tuple] = {}
        for g, own in wanted.items():
            for rank, group, place in own:
                r = bins_of[g, rank]
                at = rank - r["before"]
                if r["low"] == r["high"] or at in (0, r["n"] - 1):
                    found[group, place] = r["high"] if at else r["low"]
                else:
                    left.setdefault((g, r["bin"]), (r, []))[1].append((at, group, place))
        if not left:
            break
        wanted = {i: own for i, (_, own) in enumerate(left.values())}
        local = spark.createDataFrame([(*key, i, r["low"], r["high"]) for i, (key, (r, _)) in enumerate(left.items())], "of int, of_bin int, next int, low double, high double")
        dealt = binned.join(F.broadcast(local), (F.col("g") == F.col("of")) & (F.col("bin") == F.col("of_bin"))).select(F.col("next").alias("g"), "x", "low", "high")
        if max(r["n"] for r, _ in left.values()) <= few:
            upto = F.sum("n").over(Window.partitionBy("g").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
            summed = dealt.groupBy("g", "x").agg(F.count("*").alias("n")).withColumn("upto", upto)
            values = at_ranks(summed, wanted, F.col("upto") - F.col("n"), F.col("upto"))
            found |= {(group, place): values[g, rank]["x"] for g, own in wanted.items() for rank, group, place in own}
            break
        dealt = held(dealt)
        slow = [i for i, ((g, _), (r, _)) in enumerate(left.items()) if 2 * r["n"] > sizes[g]]
        sizes = {i: r["n"] for i, (r, _) in enumerate(left.values())}
        edges = dealt.where(F.col("g").isin(slow)).groupBy("g").agg(F.percentile_approx("x", [i / 64 for i in range(1, 64)], 10_000).alias("edges")) if slow else None
        known = spark.createDataFrame(edges.collect() if slow else [], "g int, edges array<double>")
        dealt = dealt.join(F.broadcast(known), "g", "left")

    def at(i: int, q: str) -> float | None:
        if not places[i]:
            return None
        h = places[i][q]
        low, high = found[i, math.floor(h)], found[i, math.ceil(h)]
        return low if low == high else low + (high - low) * (h - math.floor(h))

    out = [(*(g[n] for n in names), *(at(i, q) for q in quantiles)) for i, g in enumerate(groups)]
    schema = ", ".join([*(f"`{k}` {rows.schema[n].dataType.simpleString()}" for k, n in zip(keys, names, strict=True)), *(f"`{q}` double" for q in quantiles)])
    return F.broadcast(spark.createDataFrame(out, schema))


def quantiles_of_counts(points: DataFrame, quantiles: dict[str, float], *keys: str, ranges: int = 256) -> DataFrame:
    """Quantiles from counted values (keys, x, n), in two levels, for any number of groups; no task holds a group's values.

    Values are dealt into ranges at approximate quantiles; the ranges' totals say which of them hold the wanted ranks,
    and only those are ordered, each by itself. A finer cut takes more ranges.
    """
    points = points.select(F.struct(*(keys or [F.lit(0)])).alias("__by"), "x", "n")  # equal with nulls in it
    edges = points.groupBy("__by").agg(F.percentile_approx("x", [i / ranges for i in range(1, ranges)], 10_000).alias("__edges"), F.sum("n").alias("__total"))
    dealt = points.join(edges, "__by").withColumn("__range", F.size(F.filter("__edges", lambda e: e < F.col("x")))).drop("__edges")
    place = {q: (F.col("__total") - 1) * F.lit(float(at)) for q, at in quantiles.items()}
    ranks = F.array(*(f(h).cast("long") for h in place.values() for f in (F.floor, F.ceil)))
    totals = dealt.groupBy("__by", "__range", "__total").agg(F.sum("n").alias("__n"))
    ahead = Window.partitionBy("__by").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = totals.withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
    wanted = before.where(F.exists(ranks, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__n")))).select("__by", "__range", "__before")
    inside = Window.partitionBy("__by", "__range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.join(wanted, ["__by", "__range"]).withColumn("__cum", F.col("__before") + F.sum("n").over(inside))

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__cum") - F.col("n")) & (rank < F.col("__cum")), F.col("x")))

    found = {}
    for q, h in place.items():
        low, high = value_at(F.floor(h)), value_at(F.ceil(h))
        found[q] = F.when(low == high, low).otherwise(low + (high - low) * (F.max(h) - F.floor(F.max(h))))
    at_ranks = [c.alias(q) for q, c in found.items()]
    out = summed.groupBy("__by").agg(*at_ranks) if keys else summed.agg(*at_ranks)
    return out.select(*(F.col("__by")[k].alias(k) for k in keys), *quantiles)


def histograms(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """(column_name, bin, n, bin_low, bin_high): rows by bins of equal width between each column's least and greatest value.

    Two combinable passes, one for the bounds and one for the counts; a bin that is empty has a row too. Nulls, NaN and
    infinities are left out; a column of one value has it in the first bin of width 0, one of none has no row.
    """
    def finite(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < math.inf), x)

    bounds = df.agg(*(f(finite(c)).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max)))).first()
    known = {c: (bounds[f"low_{c}"], bounds[f"high_{c}"]) for c in columns if bounds[f"low_{c}"] is not None}
    if not known:
        return df.sparkSession.createDataFrame([], "column_name string, bin int, n long, bin_low double, bin_high double")
    cells = [F.struct(F.lit(c).alias("column_name"), F.when(finite(c).isNotNull(), bin_of(finite(c), F.lit(low), F.lit(high), bins)).alias("bin")) for c, (low, high) in known.items()]
    counted = df.select(F.explode(F.array(*cells)).alias("cell")).where("cell.bin is not null").groupBy("cell.column_name", "cell.bin").agg(F.count("*").alias("n"))
    edges = [(c, i, low + i * ((high - low) / bins), low + (i + 1) * ((high - low) / bins)) for c, (low, high) in known.items() for i in range(bins)]
    every = df.sparkSession.createDataFrame(edges, "column_name string, bin int, bin_low double, bin_high double")
    return every.join(counted, ["column_name", "bin"], "left").select("column_name", "bin", F.coalesce("n", F.lit(0)).alias("n"), "bin_low", "bin_high")


def size_distribution(seqs: DataFrame) -> DataFrame:
    counts = seqs.groupBy("size_range").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows by bin of equal width; the last bin holds its upper end."""
    at = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1))
    return df.where(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).withColumn("bin_low", low + F.col("bin") * ((high - low) / bins))


def ks_two_sample(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: the Kolmogorov-Smirnov statistic of two samples, their sizes and the asymptotic p-value.

    Cumulative counts come from two levels: values are dealt into ranges of the values, the ranges' totals are summed
    ahead, and each range is summed inside, so that no window holds all values.
    """
    both = a.select(F.col(column).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(F.col(column).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b"))).where("x is not null")
    points = both.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return ks_from_counts(points)


def ks_from_counts(points: DataFrame) -> DataFrame:
    summed = prefix_sums(points, "x", ["a", "b"])
    total = points.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    d = F.max(F.abs(F.col("cum_a") / F.col("n_a") - F.col("cum_b") / F.col("n_b"))).alias("statistic")
    out = summed.crossJoin(F.broadcast(total)).groupBy("n_a", "n_b").agg(d)  # one row of totals
    n = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    series = reduce(lambda s, k: s + (2 if k % 2 else -2) * F.exp(-2.0 * k * k * F.pow(n * F.col("statistic"), F.lit(2.0))), range(1, 101), F.lit(0.0))
    return out.withColumn("p_value", F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def prefix_sums(points: DataFrame, order: str, columns: list[str], ranges: int = 256) -> DataFrame:
    """points, whose order column is unique and a number, with cum_ sums up to each row, in two levels.

    Ranges are cut at approximate quantiles; their totals, `ranges` rows, are summed in one task.
    """
    edges = points.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000).alias("edges"))
    dealt = points.crossJoin(F.broadcast(edges)).withColumn("__range", F.size(F.filter("edges", lambda e: e < F.col(order)))).drop("edges")
    totals = dealt.groupBy("__range").agg(*(F.sum(c).alias(f"__t_{c}") for c in columns))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__range", *(F.coalesce(F.sum(f"__t_{c}").over(ahead), F.lit(0)).alias(f"__b_{c}") for c in columns))
    inside = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(F.broadcast(before), "__range")  # at most `ranges` rows
    return joined.withColumns({f"cum_{c}": F.sum(c).over(inside) + F.col(f"__b_{c}") for c in columns}).drop("__range", *(f"__b_{c}" for c in columns))


def label_correlations(df: DataFrame, features: list[str], label: str, k: int = 20) -> DataFrame:
    """The k features of the largest absolute correlation with a label, in one pass; constant features are left out."""
    y = F.col(label).cast("double")
    one = df.agg(*(F.struct(F.corr(F.col(c).cast("double"), y).alias("r"), F.stddev_pop(F.col(c).cast("double")).alias("s")).alias(c) for c in features))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}.r").alias("r"), F.col(f"{c}.s").alias("s")) for c in features))).alias("x")).select("x.*")
    return rows.where("s > 1e-10 and r is not null and not isnan(r)").withColumn("abs_r", F.abs("r")).orderBy(F.desc("abs_r"), "feature").limit(k).select("feature", "r", (F.col("abs_r") > 0.4).alias("strong"))
