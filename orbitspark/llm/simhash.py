"""SimHash near-duplicate detection with Golay-code fuzzy hashing.

A fingerprint is cut into segments of 22, 21 and 21 bits. A segment, read as the 23 bits of a Golay word and completed
to even parity, has one codeword of the extended [24,12,8] code within distance 2, or six at distance 4. Two segments
that differ in at most 2 bits always share one of these codewords. With at most 2 differing bits in all, the
pigeonhole gives one of three cases: segment A is equal and B differs in 2 at most; or B is equal and A differs in 2
at most; or C is equal and A differs in 1. So three families of keys (an equal segment, a codeword index), 3 to 18
keys a fingerprint, meet every link. Candidates are joined on a key and verified by their Hamming distance.

A key that more than `cap` distinct fingerprints hold is not joined with itself. Its fingerprints are linked exactly
through the 65 points within distance 1 of each: two fingerprints lie within distance 2 just if they share such a
point, and a point has at most 65 of them, whatever the data.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitspark.llm.common import components, written

SEED = 42
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16
MAX_DISTANCE = 2


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of a whole text over its word shingles; null and wordless texts give 0."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    return print_of(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), np.uint64))


def print_of(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


@lru_cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity part by 12-bit message; error patterns and their number by syndrome, all of even weight, at most 4."""
    poly, parity = 0b101011100011, np.zeros(4096, np.int64)
    for m in range(4096):
        r = m << 11
        for b in range(22, 10, -1):
            if r >> b & 1:
                r ^= poly << (b - 11)
        word = m << 11 | r
        parity[m] = r << 1 | (bin(word).count("1") & 1)
    errors, n = np.full((4096, 6), -1, np.int64), np.zeros(4096, np.int64)
    for weight in (0, 2, 4):
        for bits in combinations(range(24), weight):
            e = sum(1 << b for b in bits)
            s = (e & 4095) ^ parity[e >> 12]
            if n[s] == 0 or bin(errors[s, 0]).count("1") == weight:
                errors[s, n[s]] = e
                n[s] += 1
    return parity, errors, n


def nearby(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the nearest codewords of 23-bit segments: (rows, 6) and how many of the 6 hold."""
    parity, errors, n = golay()
    odd = segment.copy()
    for shift in (16, 8, 4, 2, 1):
        odd ^= odd >> shift
    word = segment << 1 | odd & 1
    s = (word & 4095) ^ parity[word >> 12]
    return (word[:, None] ^ errors[s]) >> 12, n[s]


def fuzzy_keys(prints: np.ndarray) -> list[np.ndarray]:
    """The keys of each fingerprint (int64)."""
    x = prints.astype(np.int64).view(np.uint64)
    a, b, c = ((x >> np.uint64(at)).astype(np.int64) & (1 << bits) - 1 for at, bits in ((42, 22), (21, 21), (0, 21)))
    (of_a, n_a), (of_b, n_b) = nearby(a), nearby(b)
    families = [((k << 22 | same)[:, None] << 12 | index, n) for k, same, index, n in ((0, a, of_b, n_b), (1, b, of_a, n_a), (2, c, of_a, n_a))]
    return [np.concatenate([keys[i, : n[i]] for keys, n in families]) for i in range(len(x))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp, h1, h2): the 64-bit fingerprint of each row's whole text, and 96 bits of hash of the id and text."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col)).alias("fp"), *row_hash(id_col, text_col))


def row_hash(id_col: str, text_col: str) -> tuple[Column, Column]:
    return F.xxhash64(id_col, text_col).alias("h1"), F.hash(text_col, id_col).alias("h2")


def links(distinct: DataFrame, cap: int = 64) -> DataFrame:
    """Links (u, v) between the distinct fingerprints in column fp that keep every component of distance <= 2."""

    @F.pandas_udf("array<long>")
    def keys(fp: pd.Series) -> pd.Series:
        return pd.Series(fuzzy_keys(fp.to_numpy()))

    keyed = distinct.select("fp", F.explode(keys("fp")).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keyed.join(shared, "key"), "golay")
    few = met.where(F.col("n") <= cap)
    near = (
        few.select("key", F.col("fp").alias("u"))
        .join(few.select("key", F.col("fp").alias("v")), "key")
        .where("u > v")
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_DISTANCE)
        .select("u", "v")
    )
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
    points = met.where(F.col("n") > cap).select("fp").distinct().select("fp", F.explode(flips).alias("point"))
    around = points.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    close = around.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u != v")
    return near.union(close)


def grouped_rows(docs: DataFrame, id_col: str, text_col: str, width: int, cap: int) -> DataFrame:
    """(doc_id, fp, h1, h2, root, component_id): a row per input row; root is the smallest fingerprint of its group."""
    prints = written(fingerprints(docs, id_col, text_col, width), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(distinct.select("fp"), cap))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, cap: int = 64) -> DataFrame:
    """One row per input row: doc_id, fp (long), component_id (the smallest id reachable over links, itself included).

    Null and empty texts have fingerprint 0 and are linked like any other. Rows that repeat an id each get a row. A row
    with a null id keeps its place in its group; a group of null ids only has a null component_id. An empty table gives
    no rows. Other columns are never read. Exact copies are one fingerprint before any join.
    """
    return grouped_rows(docs, id_col, text_col, width, cap).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, grouped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each root of grouped (doc_id, h1, h2, root)."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    kept = grouped.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.h1").alias("__h1"), F.col("k.h2").alias("__h2"))
    h1, h2 = row_hash(id_col, text_col)
    return docs.withColumns({"__h1": h1, "__h2": h2}).join(kept, ["__h1", "__h2"], "left_semi").dropDuplicates(["__h1", "__h2"]).drop("__h1", "__h2")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, cap: int = 64) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest id, null ids last.

    Of rows that share this id, the one with the smaller hash stays; of rows equal in id and text, one. All columns stay as they were.
    """
    return one_of_each(docs, grouped_rows(docs, id_col, text_col, width, cap), id_col, text_col)
