"""Streaming queries, each drained into a table; where the result does not depend on batches the batch form checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import adapters as src
from ..sources.io import scratch
from ..streaming import jobs, state
from .base import query, r6


def _in(spark, d):
    return jobs.arriving(spark, f"{d}/event[s].parquet")  # a pattern, since the table may be one file or a folder


@query("stream_ingest", "select coalesce(case when event_type not in ('view', 'click', 'purchase') then 'unknown band' when value <= 0 then 'no magnitude' end, 'good') as status, count(*) as n from events group by 1")
def stream_ingest(spark, d):
    return jobs.drained(jobs.typed(_in(spark, d)), "ingest").groupBy(F.coalesce("reason", F.lit("good")).alias("status")).agg(F.count("*").alias("n"))


@query("stream_dedupe", "select user_id as obj_id, count(distinct (ts, event_type)) as n from events group by 1")
def stream_dedupe(spark, d):
    """Every row arrives twice; one of each stays."""
    twice = _in(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return jobs.drained(jobs.deduplicated(twice), "dedupe").groupBy(F.col("user_id").alias("obj_id")).agg(F.count("*").alias("n"))


@query("stream_alarm_counts", "select date_trunc('day', ts)::varchar as night, event_type, count(*) as n from events group by 1, 2")
def stream_alarm_counts(spark, d):
    got = jobs.drained(jobs.nightly_counts(_in(spark, d)), "nightly", "complete")
    return got.select(F.date_format("night", "yyyy-MM-dd HH:mm:ss").alias("night"), "event_type", "n")


@query("stream_weekly_rate", "w as (select date_trunc('day', ts) - to_days(i::int) as week from events, (select unnest(generate_series(0, 6)) as i)) select week::varchar as week, round(count(*) / 7.0::double, 6) + 0.0 as per_day from w group by 1")
def stream_weekly_rate(spark, d):
    got = jobs.drained(jobs.weekly_rate(_in(spark, d)), "weekly", "complete")
    return got.select(F.date_format("week", "yyyy-MM-dd HH:mm:ss").alias("week"), r6("per_day").alias("per_day"))


@query("stream_quiet_sessions", "g as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 3 day then 1 else 0 end as new from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as s from g) select user_id, count(*) as n from s group by user_id, s")
def stream_quiet_sessions(spark, d):
    return jobs.drained(jobs.quiet_sessions(_in(spark, d)), "sessions", "complete").select("user_id", "n")


@query("stream_running_min", "rm as (select obj_id, k, min(p) over (partition by obj_id order by k) as m from traj) select obj_id, k, round(m, 6) + 0.0 as m from rm")
def stream_running_min(spark, d):
    return jobs.drained(jobs.running_minimum(_in(spark, d)), "minimum").select("obj_id", "k", r6("m").alias("m"))


@query("stream_source_state", "o as (select obj_id, mjd, mag, row_number() over (partition by obj_id order by mjd, mag) as n from det where mag is not null), c as (select obj_id, n, max(mjd) over w - min(mjd) over w as span, min(mag) over w as peak, avg(mag) over (partition by obj_id order by n rows between 4 preceding and current row) as recent from o window w as (partition by obj_id order by n)) select obj_id, n, round(span, 4) + 0.0 as span, round(peak, 6) + 0.0 as peak, round(recent, 5) + 0.0 as recent_mean from c where n between 3 and 40 or (n > 40 and n % 5 = 0)")
def stream_source_state(spark, d):
    got = jobs.drained(jobs.source_features(_in(spark, d)), "features")
    return got.select("obj_id", "n", (F.round("span", 4) + F.lit(0.0)).alias("span"), r6("peak").alias("peak"), (F.round("recent_mean", 5) + F.lit(0.0)).alias("recent_mean"))


_VAR = "(avg(mag * mag) filter (where fid = {b}) over w - pow(avg(mag) filter (where fid = {b}) over w, 2))"
_BY_BAND = ", ".join(f"count(*) filter (where fid = {b}) over w as n{b}, avg(mag) filter (where fid = {b}) over w as mean{b}, sqrt(greatest({_VAR.format(b=b)}, 0 * {_VAR.format(b=b)})) as sd{b}" for b in state.BANDS)
_ROUNDED = ", ".join(f"n{b}, round(mean{b}, 5) + 0.0 as mean{b}, round(sd{b}, 4) + 0.0 as sd{b}" for b in state.BANDS)


@query("stream_source_features", f"""x as (select user_id as obj_id, ts, case event_type when 'view' then 1 when 'click' then 2 else 3 end as fid, 23.9::double - 2.5::double * log10(value) as mag
  from events where event_type in ('view', 'click', 'purchase') and value > 0 and user_id is not null),
o as (select x.* from x, (select date_trunc('millisecond', max(ts)) - interval 10 day as mark from x) where ts < mark),
g as (select *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by obj_id order by ts, fid, mag) > 100 * 86400000000, false)::int as new from o),
s as (select *, sum(new) over (partition by obj_id order by ts, fid, mag rows unbounded preceding) as part from g),
c as (select obj_id, row_number() over w as n, (epoch_us(ts) - min(epoch_us(ts)) over w) / 86400000000.0::double as span, min(mag) over w as peak,
  avg(mag) over (partition by obj_id, part order by ts, fid, mag rows between 4 preceding and current row) as recent, {_BY_BAND} from s window w as (partition by obj_id, part order by ts, fid, mag rows unbounded preceding))
select obj_id, n, round(span, 4) + 0.0 as span, round(peak, 6) + 0.0 as peak, round(recent, 5) + 0.0 as recent_mean, {_ROUNDED} from c where n between 3 and 40 or (n > 40 and n % 5 = 0)""")
def stream_source_features(spark, d, slices=3):
    """Features of every scheduled prefix that the watermark has passed, from events that arrive in bounded batches, oldest first."""
    path = state.in_time_slices(src.table(spark, d, "events"), slices)
    got = state.drained_features(jobs.arriving(spark, f"{path}/*", per_batch=8))
    by_band = [c for b in state.BANDS for c in (F.col(f"n{b}"), (F.round(f"mean{b}", 5) + F.lit(0.0)).alias(f"mean{b}"), (F.round(f"sd{b}", 4) + F.lit(0.0)).alias(f"sd{b}"))]
    return got.select("obj_id", "n", (F.round("span", 4) + F.lit(0.0)).alias("span"), r6("peak").alias("peak"), (F.round("recent_mean", 5) + F.lit(0.0)).alias("recent_mean"), *by_band)


@query("stream_late_detections", """m as (select min(ts) + (max(ts) - min(ts)) / 2 as middle, max(ts) - interval 5 day as mark from events), x as (select ts >= middle or date_trunc('day', ts) + interval 1 day > mark as kept from events, m)
select count(*) filter (where kept) as kept, count(*) filter (where not kept) as dropped from x""")
def stream_late_detections(spark, d):
    """The later half of the time arrives first; then, in the same stream, the earlier half, of which nights older than the watermark are dropped."""
    e, path = src.table(spark, d, "events"), scratch(spark, "late")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = e.agg(F.min(micros), F.max(micros)).first()
    middle = first + (last - first) // 2 if first is not None else 0
    out = scratch(spark, "late-out")
    for part, rows in (("a", e.where(micros >= middle)), ("b", e.where(micros < middle))):
        rows.write.parquet(f"{path}/{part}")
        counts = jobs.arriving(spark, f"{path}/*").withWatermark("at", "5 days").groupBy(F.window("at", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("night"), "n")
        # a batch that is run again replaces its own folder
        batch = lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}")
        counts.writeStream.outputMode("update").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("night").agg(F.max_by("n", "batch").alias("n"))
    return last.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept")).crossJoin(e.agg(F.count("*").alias("all"))).select("kept", (F.col("all") - F.col("kept")).alias("dropped"))  # one row each


@query("stream_observed_counts", """m as (select min(ts) + (max(ts) - min(ts)) / 2 as middle, date_trunc('millisecond', max(ts)) - interval 5 day as mark from events),
x as (select ts >= middle as first, ts > mark as fresh from events, m)
select 'first half' as part, count(*) as arrived, count(*) as kept, 0::bigint as late from x where first union all
select 'second half', count(*), count(*) filter (where fresh), count(*) filter (where not fresh) from x where not first""")
def stream_observed_counts(spark, d):
    """The later half of the time arrives first, then the earlier half. All counts are those which the running query reports; no table is read again for them."""
    e, path, out = src.table(spark, d, "events"), scratch(spark, "observed"), scratch(spark, "observed-out")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = e.agg(F.min(micros), F.max(micros)).first()
    middle = first + (last - first) // 2 if first is not None else 0
    rows = []
    for part, half in (("first half", micros >= middle), ("second half", micros < middle)):
        e.where(half).write.parquet(f"{path}/{part[0]}")
        got = jobs.counted(jobs.within_watermark(jobs.arriving(spark, f"{path}/*"), "5 days"), out)
        rows.append((part, got["arrived"], got["kept"], got["late"]))
    return spark.createDataFrame(rows, "part string, arrived long, kept long, late long")


@query("stream_review_refit")
def stream_review_refit(spark, d):
    """New confirmations are appended to a store, and the combiner is refitted once three families are there."""
    from ..operators import models

    rows = _in(spark, d).select(F.col("event_id").alias("key"), F.col("event_type").alias("family"), F.coalesce("value", F.lit(0.0)).alias("score"), (F.col("user_id") % 3 == 0).cast("double").alias("y"))
    kept = state.first_of_each(rows, "key", scratch(spark, "reviews"))
    families = kept.select("family").distinct().count()
    weight = models.logistic(kept, ["score"], "y").stages[-1].coefficients[0] if families >= 3 else None
    return kept.groupBy("family").agg(F.count("*").alias("n")).withColumn("weight", F.round(F.lit(weight).cast("double"), 4))
