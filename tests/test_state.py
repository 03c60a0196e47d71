"""Incremental source state: batches and order of arrival don't matter, quiet sources start anew."""

import datetime
import math
import random
from collections import defaultdict

import pytest

from duskwave.streaming import jobs, state

START = datetime.datetime(2024, 1, 1)
DELAY = datetime.timedelta(days=10)
COLUMNS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def rows():
    """Sources with 30 to 60 events in 60 days; source 3 is quiet for 150 days and comes back; the last event of all is of source 9."""
    r, out = random.Random(4), []
    for source in (1, 2, 3):
        days = sorted(r.uniform(0, 60) for _ in range(r.randint(30, 60)))
        days += [d + 210 for d in days[:8]] if source == 3 else []
        out += [(source, d) for d in days]
    out += [(1, 5.0), (1, 5.0), (9, 300.0), (9, 239.5)]
    made = [(k, START + datetime.timedelta(days=d), s, r.choice(["view", "click", "purchase", "other"]), r.choice([0.0, -1.0, *[round(r.uniform(1, 90), 2)] * 8]), "{}") for k, (s, d) in enumerate(out)]
    return [(*x[:3], "view", 5.0, "{}") if x[2] == 9 else x for x in made]


def brute(events):
    """Scheduled rows of every source from detections before the watermark, sums from scratch for each."""
    kinds = {"view": 1, "click": 2, "purchase": 3}
    det = defaultdict(list)
    for _, ts, source, kind, value, _ in events:
        if kind in kinds and value > 0:
            det[source].append((ts, kinds[kind], 23.9 - 2.5 * math.log10(value)))
    mark = max(x[0] for d in det.values() for x in d) - DELAY
    out = set()
    for source, d in det.items():
        seen = []
        for x in sorted(x for x in d if x[0] < mark):
            if seen and x[0] - seen[-1][0] > datetime.timedelta(days=100):
                seen = []
            seen.append(x)
            if jobs.on_schedule(len(seen)):
                mags = [m for *_, m in seen]
                bands = [[m for _, b, m in seen if b == band] for band in (1, 2, 3)]
                mean = [round(sum(b) / len(b), 6) if b else None for b in bands]
                out.add((source, len(seen), round((x[0] - seen[0][0]).total_seconds() / 86400, 6), round(min(mags), 6), round(sum(mags[-5:]) / len(mags[-5:]), 6), *map(len, bands), *mean))
    return out


def folder(spark, tmp_path, name, parts):
    path = f"{tmp_path}/{name}"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.parquet(f"{path}/slice={k:03d}")
    return path


def drained(spark, path, per_batch):
    got = state.drained_features(jobs.arriving(spark, f"{path}/*", per_batch)).collect()
    six = lambda x: None if x is None else round(x, 6)
    return [(r["obj_id"], r["n"], six(r["span"]), six(r["peak"]), six(r["recent_mean"]), r["n1"], r["n2"], r["n3"], six(r["mean1"]), six(r["mean2"]), six(r["mean3"])) for r in got]


@pytest.mark.parametrize("arrival", ["one batch", "many batches", "shuffled"])
def test_batches_and_order_of_arrival_do_not_matter(spark, tmp_path, arrival):
    events = rows()
    if arrival == "one batch":
        parts = [random.Random(1).sample(events, len(events))]
    else:
        # out of order by up to nine days, which is less than the delay
        shift = random.Random(2).uniform if arrival == "shuffled" else lambda a, b: 0
        late = sorted(events, key=lambda x: x[1] + datetime.timedelta(days=shift(0, 9)))
        parts = [p for k in range(5) if (p := late[k * len(late) // 5 : (k + 1) * len(late) // 5])]
    got = drained(spark, folder(spark, tmp_path, arrival.replace(" ", "-"), parts), 1)
    assert len(got) == len(set(got))
    assert set(got) == brute(events)
    # source 3 came back after its state had ended
    assert [n for s, n, *_ in got if s == 3].count(3) == 2


def test_time_slices_hold_every_event_once(spark):
    from pyspark.sql import functions as F

    events = spark.createDataFrame(rows(), COLUMNS)
    path = state.in_time_slices(events, 4)
    back = spark.read.option("basePath", path).parquet(f"{path}/*")
    assert back.count() == events.count() == back.select("event_id").distinct().count()
    edges = back.groupBy("slice").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("slice").collect()
    assert all(x["b"] < y["a"] for x, y in zip(edges, edges[1:], strict=False))
    assert spark.read.parquet(state.in_time_slices(events.limit(0), 4)).count() == 0


def test_first_of_each_key_over_many_batches(spark, tmp_path):
    made = [(k, f"v{k}-{n}") for n in range(4) for k in [None, *range(10 * (n + 1))]]
    columns, store = "k long, v string", str(tmp_path / "store")
    before = spark.conf.get(state.PROVIDER, None)
    for n in range(4):
        part = [x for x in made if x[1].endswith(f"-{n}")]
        spark.createDataFrame(part + part, columns).write.mode("append").parquet(str(tmp_path / "in"))
        got = state.first_of_each(spark.readStream.schema(columns).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")), "k", store)
        # rows of earlier runs stay, of each new key one row is added
        first = {k: v for k, v in reversed(made) if int(v[-1]) <= n}
        assert sorted(map(tuple, got.collect()), key=str) == sorted(first.items(), key=str)
    assert spark.conf.get(state.PROVIDER, None) == before
    (tmp_path / "none").mkdir()
    none = state.first_of_each(spark.readStream.schema(columns).parquet(str(tmp_path / "none")), "k", str(tmp_path / "none-store"))
    assert none.columns == ["k", "v"] and none.count() == 0
