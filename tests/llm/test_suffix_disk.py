"""What suffix dedup leaves on disk while it runs: no shuffle files of a written step, parts of what is moved, no texts where a hash is wanted."""

import hashlib
import os

from pyspark.sql import functions as F

from conftest import SMALL
from corpus_pipeline import suffix_dedup_stage
from orbitspark.llm import suffix_dedup
from orbitspark.llm.common import CLEANUP_SETTING, recorded, table, written
from test_operators import documents, plain_removal


def shuffle_files(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, files in os.walk(d.getPath()) for f in files if f.startswith("shuffle_")}


def test_a_written_step_leaves_no_shuffle_files(spark):
    setting, before = spark.conf.get(CLEANUP_SETTING, None), shuffle_files(spark)
    one = spark.range(1000).withColumn("k", F.col("id") % 7)
    out = written(one.join(one.groupBy("k").count().hint("merge"), "k"), "test")
    assert not shuffle_files(spark) - before
    assert out.count() == 1000 and spark.conf.get(CLEANUP_SETTING, None) == setting


def test_turns_and_hashes_give_the_same_rows(spark, monkeypatch):
    """In several turns, and with a hash made where texts are cut instead of the texts."""
    monkeypatch.setattr(suffix_dedup, "PER_TURN", 10_000)
    moved, by_turns = [], suffix_dedup.written_by_turns
    monkeypatch.setattr(suffix_dedup, "written_by_turns", lambda turns, tag, *codec: by_turns((moved.append((tag, x.columns)) or x for x in turns), tag, *codec))
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot, made in ((4096, None), (20, lambda kept: F.sha2(kept, 256))):
        moved.clear()
        got = suffix_dedup.without_repeats(df, hot=hot, block=3_000, made=made)
        assert [tag for tag, _ in moved] == ["windows"] * 4 + ["spans"] * 4 + ["cuts"] * 4
        digest = (lambda x: hashlib.sha256(bytes(x)).hexdigest()) if made is None else str
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], digest(r["kept"])) for r in got.collect()), key=str) == plain_removal(rows)


def test_the_pipelines_stage_leaves_only_what_its_result_reads(spark):
    """Before its result is read: no shuffle files, and of its tables the cut texts alone."""
    docs, before = table(spark, SMALL, "documents"), shuffle_files(spark)
    with recorded() as tables:
        out = suffix_dedup_stage(spark, docs, SMALL)
    left = [t.written_at for t in tables if os.path.exists(t.written_at.removeprefix("file://"))]
    assert len(left) == 1 and "/cuts-" in left[0]
    assert not shuffle_files(spark) - before
    assert out.columns == docs.columns and out.count() == docs.count()
