"""Packing by power-of-two decomposition: no sequence crosses documents, and no sequence needs padding.

A document of n tokens is cut into n // limit pieces of the limit and one piece for each set bit of the rest, longest
first. Pieces of one length form a bucket; in a bucket every piece is a sequence of its own, numbered without gaps.
"""

from __future__ import annotations

import json
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitspark.llm.common import batches_of, written

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, task int, nth long"


def byte_letters() -> dict[str, int]:
    """Byte by the letter that byte-level vocabularies write for it: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """Encoder for the byte-level vocabulary of a `tokenizers` file; ids are those that `tokenizers` gives, at a third of its time.

    As there, a special token's string in a text is that token.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    letters, special = byte_letters(), {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = {bytes(map(letters.__getitem__, t)): i for t, i in file["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def binary_lengths(n: int, limit: int = 2048) -> list[int]:
    """Lengths of the pieces of n tokens; limit is a power of two."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << b for b in range(limit.bit_length() - 1, -1, -1) if rest >> b & 1]


def split_documents(docs: DataFrame, path: str, pattern: str, end_id: int = 1, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (binary, little-endian unsigned 32-bit), task and nth.

    Pieces are numbered as they are made: nth (from 0) among those of their length that their task has made.
    A document's tokens are its ids and then end_id, so that a null or empty text makes one piece of one token. Rows
    that repeat an id, or have none, are packed each. Texts are encoded whole, whatever their length. An empty table
    gives no rows; other columns are never read.
    """
    batches_of(docs.sparkSession)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, task, made = encoder(path, pattern), TaskContext.get().partitionId(), Counter()
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"].astype("Int64"), b["text"], strict=True):
                ids = array("I", code.encode(text, allowed_special="all") if text else [])
                ids.append(end_id)
                blob, n, at = memoryview(ids).cast("B"), len(ids), 0
                for k in binary_lengths(n, limit):
                    rows.append((doc, at, k, n, bytes(blob[4 * at : 4 * (at + k)]), task, made[k]))
                    at += k
                    made[k] += 1
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids", "task", "nth"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(split, PIECES)


def number_sequences(pieces: DataFrame) -> DataFrame:
    """pieces with sequence_id (long, from 0 without gaps, buckets of one length together) and offset (0: a piece fills its sequence).

    Pieces are written as they were made; what is counted then, a row for each length (12 at most) and task, says with
    which number a task's pieces of a length begin. So pieces are never shuffled.
    """
    made = written(pieces, "pieces")
    counts = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.orderBy("length", "task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = made.join(F.broadcast(first), ["length", "task"]).withColumns({"sequence_id": F.col("first") + F.col("nth"), "offset": F.lit(0).cast("long")})
    return numbered.drop("task", "nth", "first")


def pack_documents(docs: DataFrame, path: str, pattern: str, end_id: int = 1, limit: int = 2048) -> DataFrame:
    """Packed pieces with their ids: doc_id, start, length, doc_tokens, ids, sequence_id, offset."""
    return number_sequences(split_documents(docs, path, pattern, end_id, limit))
