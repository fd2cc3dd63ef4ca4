"""Sharding by minimax contiguous partition, in DataFrame operations only.

Equal texts form an atomic group; groups are ordered by a hash of the text. The smallest capacity that lets the ordered
groups be cut into the given number of shards is found by binary search with a greedy check, and the cuts are made
there. The groups stay in Spark: the search runs on a summary of hash ranges, in which ranges count as divisible, so
that its capacity is a lower bound. Ranges that a cut falls into are summarised anew, 1,024 times as fine, until each
cut falls between two ranges; then the bound is reached, and it is the optimum. A summary has 4,096 ranges and 1,024
more for each cut and round, whatever the data's size.

A group larger than an even share makes the capacity large, and shards filled up to it would be unequal. So the cuts
go where each shard is nearest to an even share of what remains, within the capacity; ranges that such a cut falls into
are summarised anew in the same way. All shards are contiguous in the order.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitspark.llm.common import partitions, written

#: Bits of the hash that orders the groups, of the first summary's ranges, and of each finer summary.
KEY_BITS, FIRST_BITS, FINER_BITS = 60, 12, 10


def text_key(text: Column) -> Column:
    """60 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def filled(ranges: list[tuple[int, int, int, int]], capacity: int, shards: int) -> list[int] | None:
    """Greedy check: the ends of the shards as amounts from the start, or None if the shards don't suffice.

    ranges: (key, bits, size, groups). One with several groups counts as divisible, a single group does not.
    """
    ends, start, at = [], 0, 0
    for _, _, size, groups in ranges:
        if groups == 1:
            if size > capacity:
                return None
            if at + size - start > capacity:
                ends.append(at)
                start = at
        else:
            while at + size - start > capacity:
                start += capacity
                ends.append(start)
                if len(ends) >= shards:
                    return None
        if len(ends) >= shards:
            return None
        at += size
    return ends


def smallest_capacity(ranges: list[tuple[int, int, int, int]], shards: int) -> tuple[int, list[int]]:
    low, high = 1, max(1, sum(r[2] for r in ranges))
    while low < high:
        middle = (low + high) // 2
        if filled(ranges, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low, filled(ranges, low, shards) or []


def summary(groups: DataFrame, key: int, bits: int, finer: int) -> list[tuple[int, int, int, int]]:
    """Ranges of the keys key .. key + 2^bits - 1, each of 2^(bits - finer) keys, in order."""
    left = max(0, bits - finer)
    rows = (
        groups.where(F.col("key").between(key, key + (1 << bits) - 1))
        .groupBy(F.shiftright("key", left).alias("at"))
        .agg(F.sum("size").alias("size"), F.count("*").alias("groups"), F.min("key").alias("least"))
        .collect()
    )
    return sorted((r["least"] if r["groups"] == 1 else r["at"] << left, left, r["size"], r["groups"]) for r in rows)


def refined(groups: DataFrame, ranges: list[tuple[int, int, int, int]], inside: set[int]) -> list[tuple[int, int, int, int]]:
    """The ranges with those at the places `inside` summarised anew, finer."""
    return sorted(x for i, r in enumerate(ranges) for x in (summary(groups, r[0], r[1], FINER_BITS) if i in inside else [r]))


def suffix_needs(ranges: list[tuple[int, int, int, int]], capacity: int) -> list[int]:
    """How many shards of a capacity the ranges from each place on need."""
    needs, end, held = [0] * (len(ranges) + 1), len(ranges), 0
    for i in range(len(ranges) - 1, -1, -1):
        held += ranges[i][2]
        while held > capacity and end > i + 1:
            end -= 1
            held -= ranges[end][2]
        needs[i] = 1 + needs[end]
    return needs


def even_cuts(ranges: list[tuple[int, int, int, int]], capacity: int, shards: int, large: set[int]) -> tuple[list[int], set[int]]:
    """The places of the first range of each shard after the first, and those of ranges in which a cut would be better.

    Groups of `large` are larger than an even share and get a shard each. Between them, a stretch of groups gets as many
    shards as it has even shares of the rest, at least one; each ends nearest to an even part of what remains of its
    stretch, holds no more than the capacity, and leaves no more than the shards after it can hold.
    """
    needs = suffix_needs(ranges, capacity)
    is_large = [r[3] == 1 and r[0] in large for r in ranges]
    stretch = [0] * (len(ranges) + 1)  # what lies before the next large group
    for i in range(len(ranges) - 1, -1, -1):
        stretch[i] = 0 if is_large[i] else stretch[i + 1] + ranges[i][2]
    small, many = sum(r[2] for r, x in zip(ranges, is_large, strict=True) if not x), sum(is_large)
    cuts, inside, i = [], set(), 0
    for left in range(shards, 1, -1):
        if i == len(ranges):
            break
        share = max(small, 1) / max(1, left - many)
        parts = max(1, round(stretch[i] / share)) if many else left
        part = stretch[i] / min(parts, max(1, left - many))
        held, start = 0, i
        while i < len(ranges):
            size, several = ranges[i][2], ranges[i][3] > 1
            if i > start and held + size > capacity:
                break
            if several and held < part < held + size:
                inside.add(i)
            if i > start and needs[i] < left and (is_large[i] or is_large[i - 1] or held + size - part > part - held):
                break
            held += size
            if is_large[i]:
                many -= 1
            else:
                small -= size
            i += 1
        if i < len(ranges):
            cuts.append(i)
    return cuts, inside


def cut_keys(groups: DataFrame, shards: int) -> list[int]:
    """The first key of each shard after the first; groups: (key, size), a row per key.

    No shard is larger than the smallest capacity that any cut of the ordered groups reaches.
    """
    ranges = summary(groups, 0, KEY_BITS, FIRST_BITS)
    while True:
        capacity, ends = smallest_capacity(ranges, shards)
        starts = [0]
        for r in ranges:
            starts.append(starts[-1] + r[2])
        known = set(starts)
        inside = {bisect_right(starts, e) - 1 for e in ends if e not in known}
        if not inside:
            break
        ranges = refined(groups, ranges, inside)
    fullest = [ranges[starts.index(e)][0] for e in ends if e < starts[-1]]
    # fewer than `shards` groups are larger than an even share
    large = {r["key"] for r in groups.where(F.col("size") * shards > starts[-1]).select("key").collect()}
    while True:
        cuts, inside = even_cuts(ranges, capacity, shards, large)
        inside |= {i for i, r in enumerate(ranges) if r[3] > 1 and any(r[0] <= k < r[0] + (1 << r[1]) for k in large)}
        if not inside:
            break
        ranges = refined(groups, ranges, inside)
    bounds = [0, *cuts, len(ranges)]
    if max((sum(r[2] for r in ranges[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)), default=0) > capacity:
        return fullest
    return [ranges[i][0] for i in cuts]


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): law `bytes`, the sizes of the shards nearly equal and equal texts together.

    Size is the text's UTF-8 bytes plus 1; a null text has none, and belongs with the empty ones. Slots count from 0
    without gaps in each shard. Rows that repeat an id, or have none, are placed each. With fewer groups than shards,
    some shards stay empty; an empty table gives no rows. Other columns are never read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_key(text).alias("key"),
        # rows are dealt out in turn, so that those of one id or none don't meet in one slice
        F.pmod(F.monotonically_increasing_id(), F.lit(partitions(spark))).cast("int").alias("slice"),
    )
    rows = written(rows, "sizes")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    shard = F.lit(0)
    for i, key in enumerate(cut_keys(groups, shards), 1):
        shard = F.when(F.col("key") >= key, i).otherwise(shard)
    placed = rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), "slice")
    counts = placed.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("n", F.row_number().over(inside) - 1)
        .join(first, ["shard", "slice"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("n")).cast("long").alias("slot"))
    )
