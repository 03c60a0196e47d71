"""What a stream reports of itself: arrived, kept and late rows, over several batches and a restart."""

import pytest
from pyspark.sql import functions as F

from duskwave.sources.io import scratch
from duskwave.streaming import jobs


def events(spark, days):
    t = spark.createDataFrame([(i, float(d)) for i, d in enumerate(days)], "event_id long, day double")
    return t.select("event_id", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("day") * 86_400).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(2.0).alias("value"), F.lit("{}").alias("props"))


def test_counts_of_batches_and_a_restart(spark):
    path, out = scratch(spark, "arrivals"), scratch(spark, "kept")
    run = lambda: jobs.counted(jobs.within_watermark(jobs.arriving(spark, f"{path}/*", 1), "5 days"), out)
    events(spark, [10, 11, 20]).union(events(spark, [10])).coalesce(1).write.parquet(f"{path}/a")
    assert run() == {"arrived": 4, "kept": 3, "late": 0}
    events(spark, [20, 12, 15, 15.5]).coalesce(1).withColumn("event_id", F.col("event_id") + 10).write.parquet(f"{path}/b")
    # the watermark is at day 15: of these, days 12 and 15 are late
    assert run() == {"arrived": 4, "kept": 2, "late": 2}
    assert run() == {"arrived": 0, "kept": 0, "late": 0}
    assert spark.read.parquet(out).count() == 5


def test_more_batches_than_reports_is_an_error(spark):
    path, out = scratch(spark, "arrivals"), scratch(spark, "kept")
    for k in range(4):
        events(spark, [k]).write.parquet(f"{path}/{k}")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        with pytest.raises(RuntimeError, match="numRecentProgressUpdates"):
            jobs.counted(jobs.within_watermark(jobs.arriving(spark, f"{path}/*", 1), "5 days"), out)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
