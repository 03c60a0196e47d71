"""Incremental features of sources: state that only grows with what may still change.

A source's detections wait in a list until the watermark has passed them, so late rows inside the delay are sorted in before anything is
derived from them. What has passed goes, in order of time, into sums of constant size; a row comes out for each scheduled analysis. So results
depend neither on how rows are cut into batches nor on the order in which they arrive, as long as none is later than the delay. A
source that has been quiet for the time to live starts anew, and its state is removed once the watermark shows that.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from ..sources.io import scratch
from .jobs import on_schedule, typed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DAY = 86_400_000_000  # microseconds
BANDS = (1, 2, 3)

_PER_BAND = [f"{x}{b}" for b in BANDS for x in ("n", "sum", "squares")]
SUMS = "first long, last long, peak double, " + ", ".join(f"{c} double" for c in _PER_BAND)
OUT = "obj_id long, since long, n long, span double, peak double, recent_mean double, " + ", ".join(f"n{b} long, mean{b} double, sd{b} double" for b in BANDS)
_NAMES = [c.split()[0] for c in OUT.split(", ")]


class SourceFeatures(StatefulProcessor):
    """Counts, span, peak, the mean of the last five and each band's count, mean and deviation at every scheduled analysis of a source."""

    def __init__(self, live_days: int = 100, keep: int = 5):
        self.live, self.keep = live_days * DAY, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", SUMS)
        self.recent = handle.getListState("recent", "mag double")
        self.waiting = handle.getListState("waiting", "t long, fid int, mag double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.waiting.appendList([(int(t), int(b), float(m)) for t, b, m in frame[["t", "fid", "mag"]].itertuples(index=False)])
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues)

    def close(self) -> None:
        pass

    def _advance(self, key, timerValues) -> Iterator[pd.DataFrame]:
        """Takes in what the watermark has passed; sets a timer for what waits, or for the end of the state."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(x) for x in self.waiting.get())
        ready = [x for x in waiting if x[0] < passed]
        first, last, peak, *bands = tuple(self.sums.get()) if self.sums.exists() else (None, None, None, *[0.0] * len(_PER_BAND))
        recent, out = [x[0] for x in self.recent.get()], []
        for t, fid, mag in ready:
            if last is None or t - last > self.live:
                first, peak, recent, bands = t, mag, [], [0.0] * len(_PER_BAND)
            last, peak, recent = t, min(peak, mag), [*recent, mag][-self.keep :]
            for i, x in enumerate((1.0, mag, mag * mag)):
                bands[3 * BANDS.index(fid) + i] += x
            n = int(sum(bands[::3]))
            if on_schedule(n):
                per_band = [v for i in range(0, len(bands), 3) for v in _moments(*bands[i : i + 3])]
                out.append((key[0], first, n, (last - first) / DAY, peak, sum(recent) / len(recent), *per_band))
        if ready:
            self.waiting.clear()
            if rest := waiting[len(ready) :]:
                self.waiting.put(rest)
            self.sums.update((first, last, peak, *bands))
            self.recent.put([(x,) for x in recent])
        if len(waiting) > len(ready):
            self.handle.registerTimer(waiting[len(ready)][0] // 1000 + 1)
        elif last is not None and last + self.live < passed:
            self.sums.clear()
            self.recent.clear()
        elif last is not None:
            self.handle.registerTimer((last + self.live) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=_NAMES)


def _moments(n: float, total: float, squares: float) -> tuple:
    if not n:
        return 0, None, None
    return int(n), total / n, max(squares / n - (total / n) ** 2, 0.0) ** 0.5


def source_features(events: DataFrame, delay: str = "10 days", live_days: int = 100) -> DataFrame:
    """A stream of events to a stream of features; needs the RocksDB state store (see drained_features)."""
    ship(events.sparkSession)
    rows = typed(events).where("reason is null").select("obj_id", "at", F.unix_micros("at").alias("t"), "fid", "mag").withWatermark("at", delay)
    return rows.groupBy("obj_id").transformWithStateInPandas(SourceFeatures(live_days), OUT, "append", "EventTime")


def in_time_slices(events: DataFrame, slices: int) -> str:
    """A folder with the events in `slices` parts of equal time, written one after the other, so that a stream reads a bounded part at a time, oldest first."""
    path = scratch(events.sparkSession, "slices")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    if low is None:
        events.write.parquet(f"{path}/slice=0")
        return path
    part = F.least(F.floor((at - F.lit(low)) * F.lit(slices) / F.lit(high - low + 1)), F.lit(slices - 1))
    for k in range(slices):
        events.where(part == k).write.parquet(f"{path}/slice={k}")
    return path


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, on local disk and not in memory; the setting is put back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def first_of_each(rows: DataFrame, key: str, path: str) -> DataFrame:
    """One row of each key, ever, of a stream, appended to the table at path, then that table.

    Which of a key's rows it is depends on the order of arrival. Keys seen are kept as state by hash of the key, so a batch costs
    its own rows and no look at what was appended before; state grows by one key for each row kept. Null is a key like any other. Called again with
    the same path it takes only what arrived since. A stream that never had a row gives an empty table.
    """
    with rocksdb(rows.sparkSession):
        new = rows.dropDuplicates([key]).writeStream.outputMode("append").option("checkpointLocation", f"{path}-checkpoint")
        new.trigger(availableNow=True).format("parquet").option("path", path).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def drained_features(events: DataFrame, **options) -> DataFrame:
    """All features of the events that there are now, through a checkpointed query into Parquet and read back."""
    spark = events.sparkSession
    path = scratch(spark, "source-features")
    with rocksdb(spark):
        query = source_features(events, **options).writeStream.outputMode("append").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).format("parquet").option("path", path).start()
        query.awaitTermination()
    return spark.read.schema(OUT).parquet(path)
