"""Bucketed storage, and the feature table on top of it."""

import re

from pyspark.sql import functions as F

from duskwave.operators import lightcurve as lc
from duskwave.sources import io


def curves(spark, objects=12, n=40):
    t = spark.range(objects * n).select((F.col("id") % objects).alias("obj_id"), (F.floor(F.col("id") / objects) * 0.4).alias("dt"), (F.col("id") % 3).cast("int").alias("band"))
    flux = 50 + 40 * F.exp(-(F.col("dt") - 6) / 8) / (1 + F.exp(-(F.col("dt") - 6) / 2)) + F.col("obj_id")
    t = t.withColumn("flux", flux).withColumn("flux_err", F.lit(1.0)).withColumn("mjd", F.col("dt") + 60310)
    return t.withColumns({"mag": 23.9 - 2.5 * F.log10("flux"), "magerr": F.lit(0.02), "logflux": F.log10("flux"), "logflux_err": F.lit(0.008), "fid": F.col("band") + 1})


def plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[: text.find("Initial Plan")] if "Initial Plan" in text else text


def test_no_part_of_the_feature_table_moves_rows_again(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = io.bucketed(curves(spark), "curves", "obj_id", "dt", 4)
        got = lc.assemble_features(stored)
        assert "FileScan" in plan(got) and not re.search(r"Exchange", plan(got))
        plain = lc.assemble_features(io.stored(curves(spark), "curves"))
        assert "Exchange" in plan(plain)
        rounded = lambda df: sorted(map(str, df.select(*((F.round(c, 6) + F.lit(0.0)) if t == "double" else c for c, t in df.dtypes)).collect()))
        assert rounded(got) == rounded(plain)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_buckets_keep_null_keys_repeated_and_no_rows(spark):
    rows = spark.createDataFrame([(None, 1.0), (1, None), (1, 2.0), (1, 2.0), (None, 1.0)], "k long, x double")
    assert sorted(map(str, io.bucketed(rows, "odd", "k", "x", 3).collect())) == sorted(map(str, rows.collect()))
    empty = io.bucketed(rows.limit(0), "none", "k", "x", 3)
    assert empty.count() == 0 and empty.columns == ["k", "x"]
