"""Message queries: rows dealt out before the parser, files that are small on disk, and lines as odd as they come."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SMALL
from orbitspark import queries as core
from orbitspark.sources import messages
from orbitspark.sources.obs import observations


def test_parser_gets_rows_in_more_tasks_than_the_table_has_parts(spark):
    for name in ("message_ingest", "message_folders", "parse_summary"):
        assert observations(spark, SMALL, dealt=True).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")), name
    assert "RoundRobinPartitioning" in core.message_ingest(spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_written_files_are_compressed_and_bounded(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    obs = observations(spark, SMALL)
    texts = obs.select(messages.as_text(obs).alias("block")).limit(100)
    messages.write_messages(texts, f"file://{root}", 3, compression="gzip", most=30)
    files = [f for f in os.listdir(f"{root}/3") if f.endswith(".txt.gz")]
    assert len(files) == 4
    assert sum(os.path.getsize(f"{root}/3/{f}") for f in files) < 100 * 500
    assert messages.read_messages(spark, f"file://{root}", "*.txt.gz").count() == 100


def test_lines_with_odd_ends_and_white_space(spark):
    lines = ["<> \t SATELLITE NUMBER: 7 \t INT. DES.:  A B  ", "COMMON NAME:\tX  Y\t \x85J2K POS (KM): 1 2\t 3", "J2K POS (KM): 4 5", "EPOCH TIME (UTC): t EPOCH REV: 1\u2028SATELLITE NUMBER: 8 x INT. DES.: C"]
    got = messages.parse_messages(spark.createDataFrame([("\r\n".join(lines),)], "block string")).first()
    assert (got["satellite_number"], got["int_des"], got["common_name"], got["epoch_rev"]) == (7, "A B", "X  Y", 1)
    assert (got["j2k_pos_x"], got["j2k_pos_y"], got["j2k_pos_z"]) == (1.0, 2.0, 3.0)


def test_plain_lines_are_cut_as_all_others_are(spark, monkeypatch):
    """The snapshots' messages are plain; what differs from them in any way has the values that regular expressions give."""
    text = observations(spark, SMALL).limit(3).select(messages.as_text(observations(spark, SMALL)).alias("block"))
    assert text.select(messages.plain_lines("block").alias("known")).select(F.min(messages.in_order("known"))).first()[0]
    one = text.first()["block"]
    lines = one.split("\n")
    odd = [one, f"\n\n{one}\n", one.replace("   ", "\t"), one.replace("   ", " "), one.replace(" CENTER", "  CENTER: x CENTER"), one.replace("CENTER: CENTER", "CENTER:"), one.replace("KM): ", "KM):  <> "), one.replace(": ", ":")]
    odd += [one.replace("F10: ", "F10: AVERAGE F10: "), one.replace("SOLAR FLUX:   F10", "SOLAR FLUX:F10"), one.replace("SOLAR FLUX: ", "SOLAR FLUX: 1 "), one.replace("TEST PL", "A: B").replace("COMMON NAME: ", "COMMON NAME: 1:2 x:"), one.replace("MESSAGE TIME UTC", "2022 290 (17 OCT) 14:45:42.507"), one.replace("J2K POS", "<>  J2K POS")]
    odd += [one.replace(" 9.25 ", "  9.25 "), one.replace("9.25", "x", 1), one.replace("9.25", "1.2.3", 1), one.replace("9.25", "NaN"), "\n".join(lines[::-1]), "\n".join(lines[:-1]), "\n".join([*lines, lines[5]]), one.replace("DRAG MODEL", "DR\u00c4G"), one.replace("PARTIALS: PARTIALS", "PARTIALS: a\x1cSTEP MODE: b"), "<> <> ".join(["", one])]
    odd += [one.replace("\n", " \n"), one.replace("\n", "\t\n"), one.replace("<> ", "<>\t"), one.replace("   ", "\x0c"), one.replace("INT DES", "INT  DES  "), one.replace("   INT. DES.", "INT. DES."), one.replace("DRAG: ", "LUNAR/SOLAR: "), "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, block string").union(text.select(F.lit(-1), "block"))
    got = sorted(map(str, messages.parse_messages(df).collect()))
    monkeypatch.setattr(messages, "in_order", lambda lines: F.lit(False))
    assert got == sorted(map(str, messages.parse_messages(df).collect()))
