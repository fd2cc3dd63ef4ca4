"""Exact top-k inner-product search by pivot-table elimination.

Every vector's distances to P pivots are a row of the pivot table. By the triangle inequality, |d(q,p) - d(x,p)| is a
lower bound of d(q,x) for each pivot p; the largest over the pivots gives the upper bound (|q|^2 + |x|^2 - bound^2) / 2
of the score q.x. Within a batch, candidates of a query are evaluated in the order of this bound, and the query stops at
the first bound under its k-th best score so far; ties in the bound are evaluated. The k-th best score starts from the
pivot sample, so that elimination works from the first batch on.

Queries go in blocks of bounded size, one after another: a block is broadcast to one pass over the stored vectors, its
result is written, and the block is released. Every task returns at most k rows a query, and a window by query merges
them. Scores are exact integers; where products could pass 64 bits they are summed as unbounded ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitspark.llm.common import batches_of, written

SCHEMA = "query_id long, vec_id long, score long"
#: Slack of a bound relative to the squared lengths, which only ever loosens it: for rounding while all sums of squares
#: are exact in 64-bit floats, and where they aren't (a difference of two near distances then loses half the digits).
SLACK, WIDE_SLACK, EXACT = 1e-9, 1e-6, 2.0**52
#: Bound of a component times the scale, and of a score.
MOST = 2.0**62


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as array<long>; null where the vector or a component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(wide, lambda x: F.when(F.abs(x * F.lit(float(scale))) < MOST, F.floor(x * F.lit(float(scale))).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for scores of 64 bits")).cast("long"))))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two integer matrices."""
    a, b = x.astype(float), y.astype(float)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


def scores_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with those of y, or with the one vector y, exact."""
    if x.shape[-1] * float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) < MOST:
        return x @ y.T
    found = x.astype(object) @ y.T.astype(object)
    if np.abs(found).max(initial=0) >= 1 << 63:
        raise OverflowError("a score does not fit 64 bits")
    return found.astype(np.int64)


def chosen_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of a sample, each the farthest from those before it."""
    if not len(sample):
        return sample
    at, near = [0], distances(sample, sample[:1])[:, 0]
    while len(at) < min(n, len(sample)) and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[at[-1:]])[:, 0])
    return sample[at]


def starting_floor(ids: np.ndarray, vectors: np.ndarray, seen_ids: np.ndarray, seen: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the sample's rows of other ids; -inf where there are fewer."""
    if len(seen) < k:
        return np.full(len(ids), -np.inf)
    known = np.where(ids[:, None] == seen_ids[None], -np.inf, scores_of(vectors, seen))
    return np.sort(known, axis=1)[:, len(seen) - k]


class Block:
    """A block of queries with their pivot distances and the k-th scores known so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.vectors, self.pivots, self.floor, self.k = ids, vectors, pivots, floor, k
        self.table = distances(vectors, pivots)
        self.norms = (vectors.astype(float) ** 2).sum(1)
        self.evaluated = 0  # pairs of which the score was taken

    def search(self, ids: np.ndarray, vectors: np.ndarray, table: np.ndarray, best: list[list[tuple[int, int]]]) -> None:
        """Puts the best (score, -id) of a batch of candidates into best, by query."""
        norms = (vectors.astype(float) ** 2).sum(1)
        most = max(norms.max(initial=0), self.norms.max(initial=0), (self.pivots.astype(float) ** 2).sum(1).max(initial=0))
        slack = SLACK if most < EXACT else WIDE_SLACK
        for i, q in enumerate(self.vectors):
            low = np.abs(table - self.table[i]).max(1)
            top = (self.norms[i] + norms - low * low) / 2
            top += slack * (self.norms[i] + norms + most * (slack > SLACK)) + 0.5
            mine = best[i]
            worst = max(self.floor[i], mine[-1][0] if len(mine) == self.k else -np.inf)
            order = np.flatnonzero(top >= worst)
            order = order[np.argsort(-top[order], kind="stable")]
            step = 32
            while len(order):
                part, order = order[:step], order[step:]
                scores = scores_of(vectors[part], q)
                self.evaluated += len(part)
                mine += [(int(s), -int(c)) for s, c in zip(scores, ids[part], strict=True) if s >= worst and c != self.ids[i]]
                mine.sort(reverse=True)
                del mine[self.k :]
                worst = max(self.floor[i], mine[-1][0] if len(mine) == self.k else -np.inf)
                order, step = order[: np.searchsorted(-top[order], -worst, side="right")], 2 * step


def top_k(
    rows: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
    pivots: int = 24, sample: int = 2048, block: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `queries` holds, its k best other rows, ties to the smaller id.

    The score is the inner product of the quantised vectors. Rows with a null id or vector, or with null or non-finite
    components, take no part. Vectors of different lengths have no inner product: candidates are the rows of the
    query's own length. Rows that repeat an id stay candidates each, and a query that repeats is asked once for each
    length, with its first vector in order. Fewer candidates than k give fewer rows; an empty table gives none. Other
    columns are never read. Pivots are taken from a sample of at most `sample` rows by hash of the id, a bound that only
    steers speed. A block holds at most about `block` queries in memory; more queries make more passes. A component of
    2^62 / scale or more, or a score beyond 64 bits, is an error and not a wrong rank.
    """
    spark = rows.sparkSession
    batches_of(spark)
    stored = rows.select(F.col(id_col).alias("vec_id"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked")).where(
        "vec_id is not null and v is not null"
    )
    stored = written(stored, "vectors")
    found = None
    for r in stored.groupBy(F.size("v").alias("width")).agg(F.count_if("asked").alias("asked")).where("asked > 0").orderBy("width").collect():
        for part in searched(stored.where(F.size("v") == r["width"]), r["width"], k, pivots, sample, block):
            found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def searched(stored: DataFrame, width: int, k: int, pivots: int, sample: int, block: int) -> Iterator[DataFrame]:
    """The best rows (query_id, vec_id, score) that each task has found for each query, written block by block."""
    spark = stored.sparkSession
    some = [(r["vec_id"], r["v"]) for r in stored.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("vec_id", "v").collect()]
    seen = np.array([x for _, x in some], np.int64).reshape(-1, width)
    seen_ids = np.array([i for i, _ in some], np.int64)
    points = chosen_pivots(seen, pivots)

    def with_table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"vec_id": b["vec_id"], "v": b["v"], "to_pivots": list(distances(np.stack(b["v"]).reshape(-1, width), points))})

    table = stored.select("vec_id", "v").mapInPandas(with_table, "vec_id long, v array<long>, to_pivots array<double>")
    asked = stored.where("asked").groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = -(-asked.count() // block)
    if blocks > 1:
        table = written(table, "pivots")
    for n in range(blocks):
        # ids by hash: a block holds about `block` queries, its size proven by the count above
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).collect()
        if not part:
            continue
        ids, vectors = np.array([r["vec_id"] for r in part], np.int64), np.array([r["v"] for r in part], np.int64).reshape(-1, width)
        shared = spark.sparkContext.broadcast(Block(ids, vectors, points, starting_floor(ids, vectors, seen_ids, seen, k), k))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            asked_block, best = shared.value, [[] for _ in shared.value.ids]
            for b in batches:
                if len(b):
                    asked_block.search(b["vec_id"].to_numpy(), np.stack(b["v"]).reshape(-1, width), np.stack(b["to_pivots"]), best)
            rows = [(q, -c, s) for q, own in zip(asked_block.ids.tolist(), best, strict=True) for s, c in own]
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"], dtype="int64")

        yield written(table.mapInPandas(search, SCHEMA), "best")
        shared.destroy()
