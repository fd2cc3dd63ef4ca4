"""Merkle manifest of a dataset: a tree of 16 children over each source's leaves, and one over the sources' roots.

Nodes are held in blocks: an aligned subtree of up to 4,096 leaves is one row of a table, its digests in van Emde Boas
order (the upper half of the levels first, then each tree that hangs below, all by the same rule). Places of nodes are
computed, not stored: building a block and reading the siblings of its leaves use the same arithmetic. The blocks' roots
are the leaves of further blocks, until a tree has one block; then paths go down again, block by block. So no task holds
more than a block, whatever a source's share of all rows.
"""

from __future__ import annotations

from binascii import hexlify
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitspark.llm.common import batches_of, partitions, written

FAN = 16
#: Levels of a block above its leaves, and the leaves that it has at most.
ROUNDS = 3
WIDTH = FAN**ROUNDS
#: Columns that a leaf is made of, in this order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def tree_size(levels: int) -> int:
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of nodes (depth 0: the root; index within their level) of a full tree of so many levels."""
    at = np.zeros_like(index)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        depth, levels = depth - top, levels - top
        span = FAN**depth
        at, index = at + tree_size(top) + index // span * tree_size(levels), index % span
    return at


def build(leaves: str, rounds: int) -> bytes:
    """The nodes of a block over leaf digests (hex, one after another): 32 bytes each, in van Emde Boas order."""
    levels = rounds + 1
    nodes = np.zeros((tree_size(levels), 32), np.uint8)
    digests = bytes.fromhex(leaves)
    for depth in range(rounds, -1, -1):
        n = len(digests) // 32
        places = address(levels, depth, np.arange(n))
        nodes[places] = np.frombuffer(digests, np.uint8).reshape(n, 32)
        if depth:
            text, run = hexlify(nodes[places].tobytes()), 64 * FAN
            digests = b"".join(sha256(text[i : i + run]).digest() for i in range(0, len(text), run))
    return nodes.tobytes()


def level_texts(blob: bytes, rounds: int, n: int) -> list[bytes]:
    """The hex digests of each level of a block of n leaves, from the leaves up to below its root."""
    nodes, texts = np.frombuffer(blob, np.uint8).reshape(-1, 32), []
    for depth in range(rounds, 0, -1):
        texts.append(hexlify(nodes[address(rounds + 1, depth, np.arange(n))].tobytes()))
        n = -(-n // FAN)
    return texts


def siblings(texts: list[bytes], i: int) -> list[tuple[bytes, bytes]]:
    """What stands left and right of leaf i's node in its run, level by level."""
    found = []
    for text in texts:
        start = i // FAN * FAN
        found.append((text[64 * start : 64 * i], text[64 * (i + 1) : 64 * (start + FAN)]))
        i //= FAN
    return found


def written_path(pairs: list[tuple[bytes, bytes]]) -> str:
    return ",".join(f"{a.decode()}|{b.decode()}" for a, b in pairs)


def read_path(path: str) -> list[tuple[bytes, bytes]]:
    return [tuple(x.encode().split(b"|")) for x in path.split(",")] if path else []


def rounds_of(n: Column) -> Column:
    """Levels above the leaves of a block in a tree of n leaves."""
    return reduce(lambda out, k: F.when(n > FAN ** (k - 1), k).otherwise(out), range(1, ROUNDS + 1), F.lit(0))


def leaf_digest(text: Column) -> Column:
    values = [text if c == "text" else F.col(c).cast("string") for c in LEAF]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with i (place in its group, from 0) and n (rows of the group), in order, without a group in one task.

    Rows are dealt into ranges of (by, order), sorted and written; a row for each group and range says what comes before.
    """
    keys = [*by, *order]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()), "numbered").withColumn("range", F.shiftright("at", 33))
    parts = dealt.groupBy(*by, "range").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    group = Window.partitionBy(*(by or [F.lit(0)]))  # a row for each range
    ahead = F.coalesce(F.sum("here").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*by, "range", (ahead - F.col("first")).alias("shift"), F.sum("here").over(group).alias("n"))
    return dealt.join(parts, [*by, "range"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def layers(rows: DataFrame, held: tuple[str, ...] = ()) -> list[DataFrame]:
    """Blocks (key, block, n, m, nodes) over rows (key, i, n, digest), then over their roots, until each key has one block.

    Columns named in held are kept by the first layer, as arrays in the leaves' order.
    """
    build_all = F.pandas_udf(lambda texts, rounds: pd.Series([build(t, r) for t, r in zip(texts, rounds, strict=True)], dtype=object), "binary")
    found = []
    while True:
        cells = F.sort_array(F.collect_list(F.struct("i", "digest", *held))).alias("cells")
        blocks = rows.groupBy("key", "n", F.floor(F.col("i") / WIDTH).alias("block")).agg(cells)
        kept = [F.col(f"cells.{c}").alias(c) for c in held]
        blocks = blocks.select("key", "n", "block", F.size("cells").alias("m"), build_all(F.array_join("cells.digest", ""), rounds_of(F.col("n"))).alias("nodes"), *kept)
        found.append(written(blocks, "blocks"))
        root = F.lower(F.hex(F.substring("nodes", 1, 32)))
        rows, held = found[-1].where(F.col("n") > WIDTH).select("key", F.col("block").alias("i"), F.ceil(F.col("n") / WIDTH).alias("n"), root.alias("digest")), ()
        if rows.isEmpty():
            return found


PATHS = "key string, block long, path string, top string"


def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The path of each leaf of blocks, numbered on over the blocks."""
    for b in batches:
        rows = []
        for key, block, m, rounds, nodes, path, top in b.itertuples(index=False):
            texts, rest = level_texts(nodes, rounds, m), read_path(path)
            rows += [(key, block * WIDTH + i, written_path(siblings(texts, i) + rest), top) for i in range(m)]
        yield pd.DataFrame(rows, columns=["key", "block", "path", "top"])


def paths(found: list[DataFrame], above: DataFrame) -> DataFrame:
    """The blocks of the lowest layer with path (the siblings of their roots up to the last root) and top (their tree's root).

    above: (key, path) of each tree's own root.
    """

    below = None
    for k in range(len(found) - 1, -1, -1):
        last = found[k].where(F.col("n") <= WIDTH).join(above, "key").withColumn("top", F.lower(F.hex(F.substring("nodes", 1, 32))))
        blocks = last if below is None else last.unionByName(found[k].join(below, ["key", "block"]))
        if k:
            below = blocks.select("key", "block", "m", rounds_of(F.col("n")).alias("rounds"), "nodes", "path", "top").mapInPandas(children, PATHS)
    return blocks


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, checked against a tampered copy.

    Tampering lower-cases A-Z of the texts of rows where 5 divides crc32 of the decimal doc_id; the folded root is that
    of the tampered leaf (else the leaf) and the row's siblings. Nulls of any column are written as `-`, unlike empty
    texts; a null doc_id comes first in its source, and is never tampered with. Rows that repeat a doc_id in a source
    are leaves each, in order of their digests. An empty table gives no rows; columns that no leaf is made of aren't read.
    """
    spark = docs.sparkSession
    batches_of(spark)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own, changed = leaf_digest(F.col("text")), leaf_digest(lower)
    key = F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("key")  # in order of sources, null first
    leaves = written(docs.select(key, "doc_id", own.alias("digest"), F.when(tampered, changed).otherwise(own).alias("changed")), "leaves")
    trees = layers(numbered(leaves, ["key"], ["doc_id", "digest"]), ("doc_id", "changed"))
    roots = reduce(DataFrame.unionByName, [t.where(F.col("n") <= WIDTH).select("key", F.lower(F.hex(F.substring("nodes", 1, 32))).alias("digest")) for t in trees])
    # the sources are leaves of one more tree
    sources = written(numbered(roots, [], ["key"]), "sources")
    crown = layers(sources.select(F.lit("").alias("key"), "i", "n", "digest"))
    start = spark.range(1).select(F.lit("").alias("key"), F.lit("").alias("path"))
    top = crown[-1].select(F.lower(F.hex(F.substring("nodes", 1, 32)))).first()  # one row; none for an empty table
    ends = paths(crown, start).select("key", "block", "m", rounds_of(F.col("n")).alias("rounds"), "nodes", "path", "top").mapInPandas(children, PATHS)
    above = ends.select(F.col("block").alias("i"), "path").join(sources.select("i", "key"), "i").select("key", "path")
    blocks = paths(trees, above).select("doc_id", "changed", "m", rounds_of(F.col("n")).alias("rounds"), "nodes", "path", "top")

    def proofs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ids, changes, m, rounds, nodes, path, subroot in b.itertuples(index=False):
                texts, rest = level_texts(nodes, rounds, m), read_path(path)
                leaves_of = texts[0] if texts else subroot.encode()
                tail = b"".join(x + y for x, y in rest)
                for i, (doc, node) in enumerate(zip(ids, changes, strict=True)):
                    own, node = siblings(texts, i), node.encode()
                    proof = sha256(b"".join(x + y for x, y in own) + tail).hexdigest()
                    for x, y in (*own, *rest):
                        node = hexlify(sha256(x + node + y).digest())
                    rows.append((doc, leaves_of[64 * i : 64 * i + 64].decode(), subroot, proof, node.decode()))
            out = pd.DataFrame(rows, columns=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])
            yield out.astype({"doc_id": "Int64"})

    root = F.lit(top[0] if top else None).cast("string").alias("root")
    found = blocks.mapInPandas(proofs, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return found.select("doc_id", "leaf", "subroot", root, "proof_sha256", "folded_root").withColumn("verified", F.col("folded_root") == F.col("root"))
