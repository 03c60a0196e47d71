"""The replay table function against windows, for tables of any columns."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from duskwave.streaming.replay import replay


def test_equals_a_row_number_for_any_columns(spark):
    t = spark.range(400).select((F.col("id") % 7 * (F.col("id") % 3)).alias("who"), F.xxhash64("id").alias("order"), F.array("id").alias("list"), F.when(F.col("id") % 5 > 0, F.lit("é")).alias("note"))
    t = t.withColumn("who", F.when(F.col("who") != 4, F.col("who")))
    k = F.row_number().over(Window.partitionBy("who").orderBy("order"))
    want = t.withColumn("k", k.cast("long")).where("k between 3 and 40 or (k > 40 and k % 5 = 0)")
    got = replay(t, "who", "order")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 50


def test_empty_and_clashing_tables(spark):
    t = spark.range(3).select("id", F.col("id").alias("at"))
    assert replay(t.limit(0), "id", "at").count() == 0
    assert replay(t, "id", "at").count() == 0
    with pytest.raises(Exception, match="column k already"):
        replay(t.withColumn("K", F.lit(1)), "id", "at").collect()
