"""Distinct places and objects of message files, counted exactly by bits that aggregates combine."""

from pyspark.sql import functions as F

from conftest import SMALL
from orbitspark import queries as core


def test_places_and_objects_are_counted_without_a_row_each(spark):
    assert "Expand" not in core.message_folders(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    numbers = [-64, -63, -1, 0, 0, 62, 63, 2**62, None, 5]
    x = spark.createDataFrame([(n,) for n in numbers], "n long").select(core.distinct_bit("n").alias("x"))
    bits = x.groupBy("x.word").agg(F.bit_count(F.bit_or("x.bit")).alias("bits")).agg(F.sum("bits")).first()[0]
    assert bits == len(set(numbers) - {None})
