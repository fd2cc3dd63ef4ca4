"""Near copies by word shingles: similarity of at least 0.8 between sets of five-word shingles.

Candidates come two ways. Every set has a 64-bit SimHash; sets whose SimHashes differ in at most 2 bits meet on the
Golay keys of `simhash`, all of them. At a similarity of 0.8 two SimHashes differ in about ten bits, though; Golay keys
that still meet there are segments of 12 bits each, too short to tell millions of texts apart. So bands of min-hashes
reach what lies farther apart: two sets of similarity s share a band of 5 with probability s^5 and one of 24 bands with
1 - (1 - s^5)^24, which is 0.9999 at 0.8 and more above. All candidates are verified by the similarity of their whole
sets, so that two SimHashes near each other by chance link nothing.

Texts of equal sets are one node before any join. Nodes of a key, of either kind, that at most `cap` hold are paired in a join. A
key that more hold is not: its nodes are dealt into blocks of bounded size, and a block is compared in itself and with
a few nodes of the key that all its blocks get, so comparisons grow with the nodes of a key, not with their square.
This joins most of a group of near copies. What it leaves open is settled exactly by prefixes: with shingles in one
order, rarest first, two sets of similarity 0.8 share one among the first fifth of each (and one more). Nodes of keys
that still hold several components meet on such shingles if they are of different components, near sizes and places
of the shared shingle that leave enough to share; each such pair is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitspark.llm.common import components, written
from orbitspark.llm.simhash import MAX_DISTANCE, SEED, fuzzy_keys, one_of_each, print_of, row_hash

BANDS, ROWS = 24, 5
#: Shingles whose min-hashes are taken at a time, and shingles of a block that are compared at a time.
CHUNK, WIDE = 1 << 13, 1 << 13
#: Nodes in a block of a hot key, and nodes that all blocks of a key get.
BLOCK, SHARED = 128, 16
#: Counters that order shingles by how many sets have them; shingles that share a counter keep one order too.
COUNTERS = 1 << 16
A, B = np.random.default_rng(SEED).integers(1, 2**63, (2, 1, BANDS * ROWS), np.uint64)
A |= np.uint64(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a whole text's word shingles; a shorter text is one shingle, a wordless one none."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    shingles = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), np.uint64))


def node_of(members: np.ndarray) -> int:
    """Signed 64-bit hash of a set; that of the empty one is 0."""
    return int(np.uint64(xxhash.xxh64_intdigest(members.tobytes(), SEED)).astype(np.int64)) if len(members) else 0


def band_keys(members: np.ndarray) -> np.ndarray:
    """The band keys of a set (int64); none of the empty one."""
    if not len(members):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(members), CHUNK):
        x = members[i : i + CHUNK, None] * A + B
        least = np.minimum(least, (x ^ x >> np.uint64(32)).min(0))
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), n) for n, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def similar(x: list[np.ndarray], y: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether each of the sets x and each of the sets y are at least so similar."""
    values, at = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    # what only one set has is in no intersection
    shared = np.bincount(at, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    sizes = np.array([len(s) for s in [*x, *y]])
    keep = np.flatnonzero(shared[at])
    keep = keep[np.argsort(column[at[keep]], kind="stable")]
    row, column = np.repeat(np.arange(len(sizes)), sizes)[keep], column[at[keep]]
    both = np.zeros((len(x), len(y)), np.int64)
    # some columns at a time, so that the table is small however many there are, and counts exact in single precision
    for first in range(0, int(shared.sum()), WIDE):
        part = slice(*np.searchsorted(column, (first, first + WIDE)))
        table = np.zeros((len(sizes), WIDE), np.float32)
        table[row[part], column[part] - first] = 1
        both += np.rint(table[: len(x)] @ table[len(x) :].T).astype(np.int64)
    return both >= similarity * (sizes[: len(x), None] + sizes[None, len(x) :] - both) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""

    @F.pandas_udf("boolean")
    def holds(us: pd.Series, vs: pd.Series) -> pd.Series:
        def one(u: bytes, v: bytes) -> bool:
            both = len(np.intersect1d(np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64), assume_unique=True))
            return both >= similarity * ((len(u) + len(v)) // 8 - both) - 1e-9

        return pd.Series([one(u, v) for u, v in zip(us, vs, strict=True)], dtype=bool)

    first, second = (sets.select(F.col("fp").alias(c), F.col("members").alias(f"of_{c}")) for c in "uv")
    sized = pairs.join(first, "u").join(second, "v")
    a, b = F.length("of_u"), F.length("of_v")
    return sized.where(F.least(a, b) >= similarity * F.greatest(a, b) - 1e-6).where(holds("of_u", "of_v")).select("u", "v")


def hot_links(hot: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links (u, v) among the nodes of each hot key (key, fp, n): in a block, and of a block with the key's shared nodes.

    A shared node goes to every block of its key, and blocks are as many as the nodes over `block`, so rows dealt are at
    most 1 + SHARED / block times the nodes, and so are comparisons over `block`.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = hot.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # the least by another hash than the one that deals: a combinable aggregate of bounded size
    order = F.struct(F.xxhash64("key", "fp").alias("at"), F.col("fp"))
    least = dealt.groupBy("key", "own", "blocks").agg(F.min(order).alias("first"))
    # every block offers one node, each at its place in the order; the key takes the first of them
    window = Window.partitionBy("key").orderBy("first")
    shared = least.withColumn("place", F.row_number().over(window)).where(F.col("place") <= SHARED)
    everywhere = shared.select("key", "first.fp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    rows = dealt.select("key", "fp", "own").union(everywhere).distinct()

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        members = [np.frombuffer(m, np.uint64) for m in rows["members"]]
        fp = rows["fp"].to_numpy()
        a, b = np.nonzero(np.triu(similar(members, members, similarity), 1))
        # a component of the links suffices: those that join two parts
        root = {}

        def find(k: int) -> int:
            while root.setdefault(k, k) != k:
                root[k] = k = root[root[k]]
            return k

        out = []
        for u, v in zip(fp[a].tolist(), fp[b].tolist(), strict=True):
            if (s := find(u)) != (t := find(v)):
                root[s] = t
                out.append((u, v))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return rows.join(sets, "fp").groupBy("key", "own").applyInPandas(compare, "u long, v long")


def counter_of(members: np.ndarray) -> np.ndarray:
    return (members % np.uint64(COUNTERS)).astype(np.int64)


def prefix_of(members: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of a set, rarest first by counts, of which a set at least so similar has one in its own prefix."""
    order = np.lexsort((members, counts[counter_of(members)]))
    return members[order[: len(members) - int(np.ceil(similarity * len(members) - 1e-9)) + 1]]


def prefix_links(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """All links (u, v) of nodes (fp, root) whose roots differ, by shared shingles of their prefixes."""
    spark = nodes.sparkSession
    held = written(nodes.join(sets, "fp"), "open")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for m in b["members"]:
                counts += np.bincount(counter_of(np.frombuffer(m, np.uint64)), minlength=COUNTERS)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"at": at, "n": counts[at]})

    # at most COUNTERS rows, whatever the input
    found = held.select("members").mapInPandas(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNTERS, np.int64)
    counts[found["at"]] = found["n"]
    known = spark.sparkContext.broadcast(counts)

    @F.pandas_udf("array<long>")
    def prefix(sets: pd.Series) -> pd.Series:
        return pd.Series([prefix_of(np.frombuffer(m, np.uint64), known.value, similarity).view(np.int64) for m in sets], dtype=object)

    size = (F.length("members") / 8).cast("long").alias("size")
    rows = held.select("fp", "root", size, F.posexplode(prefix("members")).alias("place", "shingle"))
    rows = written(rows.select("shingle", "fp", "root", (F.col("size") - F.col("place")).alias("rest"), "size"), "prefixes")
    by_root = rows.groupBy("shingle", "root").agg(F.count("*").alias("n"))
    # the largest component of a shingle needs no comparison with itself, and a shingle of one component none
    most = by_root.groupBy("shingle").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root"))["root"].alias("most")).where("roots > 1")
    rows = rows.join(most.drop("roots"), "shingle")
    u, v = rows.where("root != most").alias("u"), rows.alias("v")
    least = F.lit(similarity / (1 + similarity)) * (F.col("u.size") + F.col("v.size")) - 1e-6
    # what is left from the first shared shingle on bounds what the sets share; of other shared ones no pair depends
    near = (F.col("u.root") != F.col("v.root")) & (F.least("u.rest", "v.rest") >= least)
    pairs = u.join(v, (F.col("u.shingle") == F.col("v.shingle")) & near)
    pairs = pairs.select(F.greatest("u.fp", "v.fp").alias("u"), F.least("u.fp", "v.fp").alias("v")).distinct()
    return verified(pairs, sets, similarity)


def settled(hot: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """roots (node, root), with the links added that nodes of a hot key have beyond their components."""
    rooted = hot.select("key", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "rooted")
    still = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    links = prefix_links(rooted.join(still, "key").select("fp", "root").distinct(), sets, similarity)
    own = rooted.select("fp", "root").distinct()
    ends = links.join(own.toDF("u", "s"), "u").join(own.toDF("v", "t"), "v")
    joined = components(ends.select(F.col("s").alias("u"), F.col("t").alias("v"))).toDF("root", "top")
    # a node that had no link may have one now
    every = roots.union(rooted.select(F.col("fp").alias("node"), "root")).distinct()
    return every.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def near_prints(prints: DataFrame) -> DataFrame:
    """(key, fp, print, h1, h2, n): nodes by the Golay keys of their SimHash that n > 1 nodes have.

    Sets whose SimHashes differ in at most MAX_DISTANCE bits share a key. A wordless text has no key.
    """

    @F.pandas_udf("array<long>")
    def keys(prints: pd.Series) -> pd.Series:
        return pd.Series(fuzzy_keys(prints.to_numpy()))

    nodes = prints.where("fp != 0").groupBy("fp").agg(F.min(F.struct("h1", "h2")).alias("h"), F.first("print").alias("print"))
    keyed = nodes.select("fp", "h.*", "print", F.explode(keys("print")).alias("golay"))
    # hashed, as keys of bands are, so that both kinds go the same way
    keyed = keyed.select(F.xxhash64(F.lit("simhash"), "golay").alias("key"), "fp", "print", "h1", "h2")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return written(keyed.join(shared, "key"), "golay")


def grouped_rows(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, cap: int, block: int) -> DataFrame:
    """(doc_id, fp, h1, h2, root): a row per input row; fp stands for its set, root for its group."""

    @F.pandas_udf("fp long, print long, keys array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, width) for t in texts]
        return pd.DataFrame({"fp": [node_of(s) for s in sets], "print": [print_of(s) for s in sets], "keys": [band_keys(s) for s in sets]})

    @F.pandas_udf("binary")
    def members(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, width).tobytes() for t in texts], dtype=object)

    h1, h2 = row_hash(id_col, text_col)
    prints = written(docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col)).alias("s"), h1, h2).select("doc_id", "s.*", "h1", "h2"), "bands")
    near = near_prints(prints)
    distinct = prints.groupBy("fp").agg(F.min(F.struct("h1", "h2")).alias("h"), F.first("keys").alias("keys"))
    keyed = written(distinct.select("fp", "h.*", F.explode("keys").alias("key")), "band-keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keyed.join(shared, "key"), "met")
    # nodes that meet no other are never read again
    wanted = met.select("h1", "h2", "fp").union(near.select("h1", "h2", "fp")).distinct()
    texts = docs.select(F.col(text_col).alias("text"), h1, h2).join(wanted, ["h1", "h2"]).dropDuplicates(["fp"])
    sets = written(texts.select("fp", members("text").alias("members")), "sets")
    close = near.where(F.col("n") <= cap).select("key", "fp", "print")
    close = close.toDF("key", "u", "of_u").join(close.toDF("key", "v", "of_v"), "key").where("u > v")
    close = close.where(F.bit_count(F.col("of_u").bitwiseXOR(F.col("of_v"))) <= MAX_DISTANCE).select("u", "v")
    few = met.where(F.col("n") <= cap).select("key", "fp")
    pairs = few.withColumnRenamed("fp", "u").join(few.withColumnRenamed("fp", "v"), "key").where("u > v").select("u", "v")
    found = verified(pairs.union(close).distinct(), sets, similarity)
    hot = met.select("key", "fp", "n").union(near.select("key", "fp", "n")).where(F.col("n") > cap)
    if hot.head():
        found = found.union(hot_links(hot, sets, similarity, block))
        roots = settled(hot, sets, written(components(found), "roots"), similarity)
    else:
        roots = components(found)
    return prints.drop("keys", "print").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, cap: int = 64, block: int = BLOCK) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest id, null ids last.

    Groups are connected by links of the given similarity of whole texts' word shingles. Wordless and null texts are one
    group. Which of rows that share an id stays is as in simhash.near_dedup. All columns stay as they were. `cap` and
    `block` steer work, not results.
    """
    return one_of_each(docs, grouped_rows(docs, id_col, text_col, width, similarity, cap, block), id_col, text_col)
