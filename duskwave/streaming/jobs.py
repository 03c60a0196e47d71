"""Structured Streaming on detections as they arrive: the same operators, with state instead of replays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship
from ..sources.io import scratch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
KINDS = {"view": 1, "click": 2, "purchase": 3}


def arriving(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENTS)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything there is now, through a checkpointed query into Parquet, and that read back. In append mode the file sink commits
    exactly once; in the others each batch replaces the table, which is what complete mode hands over."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def within_watermark(events: DataFrame, delay: str) -> DataFrame:
    """One row per event number and instant; rows older than the watermark are dropped. Two observed metrics tell of each batch: `arrived` (n) and
    `kept` (n); the progress of the query has a third number, the rows that its state refused."""
    seen = events.observe("arrived", F.count(F.lit(1)).alias("n")).withWatermark("at", delay)
    return seen.dropDuplicates(["event_id", "at"]).observe("kept", F.count(F.lit(1)).alias("n"))


def counted(stream: DataFrame, path: str) -> dict[str, int]:
    """Runs a stream of within_watermark() into Parquet at path until nothing is left, and adds up what its progress reports: arrived, kept and late.

    Batches that had ended before a restart are not counted again, as they are not run again. Spark keeps as many reports of a query as
    spark.sql.streaming.numRecentProgressUpdates says; with more batches than that the sums would lack some, which is an error.
    """
    spark = stream.sparkSession
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).format("parquet").option("path", path).start()
    query.awaitTermination()
    reports = query.recentProgress
    if len(reports) + 1 >= int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")):  # one fewer than that is kept
        raise RuntimeError("more batches than spark.sql.streaming.numRecentProgressUpdates keeps reports of")
    total = {"arrived": 0, "kept": 0, "late": 0}
    for r in reports:
        for name in ("arrived", "kept"):
            total[name] += r.observedMetrics[name]["n"] if name in r.observedMetrics else 0
        total["late"] += sum(op.numRowsDroppedByWatermark for op in r.stateOperators)
    return total


def typed(events: DataFrame) -> DataFrame:
    """Detections with a reason where one must wait in quarantine."""
    mag = F.when(F.col("value") > 0, F.lit(23.9) - F.lit(2.5) * F.log10("value"))
    fid = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in KINDS.items()))
    why = F.when(fid.isNull(), "unknown band").when(mag.isNull(), "no magnitude").when(F.col("user_id").isNull(), "no object")
    return events.select("event_id", F.col("user_id").alias("obj_id"), "at", fid.alias("fid"), mag.alias("mag"), why.alias("reason"))


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row per object and instant among repeats that arrive within the delay; state older than that is dropped."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["user_id", "at", "event_type"])


def nightly_counts(events: DataFrame) -> DataFrame:
    return events.withWatermark("at", "2 days").groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("night"), "event_type", "n")


def weekly_rate(events: DataFrame) -> DataFrame:
    return events.withWatermark("at", "2 days").groupBy(F.window("at", "7 days", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("week"), (F.col("n") / F.lit(7.0)).alias("per_day"))


def quiet_sessions(events: DataFrame, gap: str = "3 days") -> DataFrame:
    return events.withWatermark("at", "4 days").groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


SOURCE_STATE = "n long, first double, last double, peak double, recent array<double>"
SOURCE_OUT = "obj_id long, n long, span double, peak double, recent_mean double"


def on_schedule(k: int) -> bool:
    return 3 <= k <= 40 or (k > 40 and k % 5 == 0)


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Count, first and last time, peak and last five magnitudes of a source; a row for each scheduled analysis."""
    n, first, last, peak, recent = state.get if state.exists else (0, None, None, None, [])
    recent, rows = list(recent), []
    arrived = pd.concat(list(frames)).sort_values(["t", "mag"]) if frames is not None else pd.DataFrame()
    for t, mag in arrived[["t", "mag"]].itertuples(index=False):
        n, first, last = n + 1, t if first is None else min(first, t), t if last is None else max(last, t)
        peak, recent = mag if peak is None else min(peak, mag), [*recent, float(mag)][-5:]
        if on_schedule(n):
            rows.append((key[0], n, last - first, peak, sum(recent) / len(recent)))
    state.update((n, first, last, peak, recent))
    yield pd.DataFrame(rows, columns=["obj_id", "n", "span", "peak", "recent_mean"])


def source_features(events: DataFrame) -> DataFrame:
    """Features of each scheduled prefix from state of constant size for each source."""
    ship(events.sparkSession)
    rows = typed(events).where("reason is null").select("obj_id", (F.unix_micros("at") / F.lit(86400000000.0)).alias("t"), "mag")
    return rows.groupBy("obj_id").applyInPandasWithState(_advance, SOURCE_OUT, SOURCE_STATE, "append", GroupStateTimeout.NoTimeout)


def _minimum(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    k, low = state.get if state.exists else (0, 2.0)
    rows = []
    for _ in pd.concat(list(frames)).sort_values(["t", "event_id"]).itertuples(index=False):
        k += 1
        if on_schedule(k):
            low = min(low, ((key[0] * 7919 + k * 104729) % 1000 + 1) / 1001.0)
            rows.append((key[0], k, low))
    state.update((k, low))
    yield pd.DataFrame(rows, columns=["obj_id", "k", "m"])


def running_minimum(events: DataFrame) -> DataFrame:
    """The running minimum of p at each scheduled analysis, kept in state and never lost."""
    ship(events.sparkSession)
    rows = events.select(F.col("user_id").alias("obj_id"), "event_id", (F.unix_micros("at") / F.lit(86400000000.0)).alias("t"))
    return rows.groupBy("obj_id").applyInPandasWithState(_minimum, "obj_id long, k long, m double", "k long, low double", "append", GroupStateTimeout.NoTimeout)
