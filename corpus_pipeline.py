"""Corpus pipeline: from documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame, calls one operator of orbitspark.llm on all that the stage before
it kept, and is written as Parquet and read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitspark.llm import near_copies, packing, quality, suffix_dedup, toxicity
from orbitspark.llm.common import erase, recorded, release, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified rungs of their language keep. Null and empty texts go."""
    return quality.passing(docs, table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3, learned from the labelled ones among docs. Null texts are scored as empty."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingle similarity of 0.8 or more, the one of the smallest id.

    SimHashes within 2 bits, by Golay keys, and bands of min-hashes for what they don't reach; every candidate is verified.
    """
    return near_copies.near_dedup(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes that an earlier document has; n_chars is counted anew.

    Where a cut splits a character, its remaining bytes go too. A text of which nothing remains becomes empty; a null
    one stays null.
    """
    names = docs.columns
    # what isn't read goes along under one name, so that no column of docs meets a new one
    rest = F.struct(F.col("text").isNull().alias("__none"), *(c for c in names if c != "text"))
    cut = suffix_dedup.without_repeats(docs.select("doc_id", "text", rest.alias("__rest")))
    text = F.when(~F.col("__rest.__none"), suffix_dedup.as_text(F.col("kept")))
    done = cut.select(text.alias("text"), "__rest.*").withColumn("n_chars", F.char_length("text").cast("long"))
    return done.select(*names)


def binary_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a power of two of tokens, each from one document, with their ids. A null text is packed as empty."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_rules),
    ("toxicity", toxicity_filter),
    ("simhash", simhash_dedup),
    ("suffix", suffix_dedup_stage),
    ("packing", binary_packing),
]
#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents.

    Once a stage's result is written, what it has read and what it has written on its way goes; what the returned frame
    reads stays. A call knows its own tables only.
    """
    docs, past = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with recorded() as tables:
            out = stage(spark, docs, sf_dir)
        docs = written(out, name)
        erase(*tables, *past)
        past = [docs]
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
