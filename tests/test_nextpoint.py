"""The value of the next observation: sums that grow by one point, draws that only see the prefix."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwave.operators import nextpoint

HORIZON = 10.0


@pytest.fixture(scope="module")
def curves(spark):
    r = np.random.default_rng(3)
    rows = [(i, float(d), int(b), float(18 + 0.05 * d + r.normal(0, 0.1))) for i in range(20) for d, b in zip(np.sort(r.uniform(0, 30, 12)), r.integers(0, 3, 12), strict=True)]
    rows += [(50, 1.0, 0, 19.0), (51, 2.0, 2, 19.0), (52, 3.0, 0, 18.0), (52, 3.0, 0, 17.0), (53, 40.0, 1, 20.0)]
    return spark.createDataFrame(rows, "obj_id long, dt double, band int, mag double").persist()


def table(df):
    return {r["obj_id"]: {k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in df.collect()}


def test_features_are_those_of_the_rows(curves):
    got, rows = table(nextpoint.with_features(nextpoint.prefix_sums(curves, HORIZON))), curves.where(F.col("dt") <= HORIZON).collect()
    assert set(got) == {r["obj_id"] for r in rows if r["band"] < 2} and 51 not in got and 53 not in got
    for i, f in got.items():
        for b, x in enumerate("gr"):
            own = [(r["dt"], r["mag"]) for r in rows if r["obj_id"] == i and r["band"] == b]
            assert f[f"{x}_n"] == len(own)
            if not own:
                assert f[f"{x}_mean"] is None and f[f"{x}_slope"] is None
                continue
            t, m = np.array(own).T
            assert f[f"{x}_mean"] == pytest.approx(m.mean()) and (f[f"{x}_min"], f[f"{x}_max"]) == pytest.approx((m.min(), m.max()))
            assert f[f"{x}_m_last"] == pytest.approx(min(v for d, v in own if d == t.max()))
            if len(own) > 1:
                assert f[f"{x}_sd"] == pytest.approx(m.std(), abs=1e-6)
            if np.ptp(t) > 0:
                assert f[f"{x}_slope"] == pytest.approx(np.polyfit(t, m, 1)[0], abs=1e-6)
            else:
                assert f[f"{x}_slope"] is None


@pytest.mark.parametrize("band", [0, 1])
def test_appending_to_the_sums_is_computing_anew(spark, curves, band):
    sums = nextpoint.prefix_sums(curves, HORIZON)
    grown = nextpoint.with_features(nextpoint.appended(sums, F.lit(band), F.lit(11.0), F.lit(18.5)))
    more = curves.where(F.col("dt") <= HORIZON).unionByName(sums.select("obj_id", F.lit(11.0).alias("dt"), F.lit(band).alias("band"), F.lit(18.5).alias("mag")))
    got, want = table(grown), table(nextpoint.with_features(nextpoint.prefix_sums(more, 11.0)))
    assert set(got) == set(want)
    for i in got:
        for c in nextpoint.FEATURES:
            assert (got[i][c] is None) == (want[i][c] is None) and (got[i][c] is None or got[i][c] == pytest.approx(want[i][c], abs=1e-6)), (i, c)


def test_draws_are_causal_reproducible_and_normal(spark, curves):
    scatter = spark.createDataFrame([(0, 0.1), (1, 0.4)], "band int, scatter double")
    plain = lambda r: tuple(round(v, 8) if isinstance(v, float) else v for v in r)
    points = lambda df, **o: {(r["obj_id"], r["next_band"], r["draw"]): plain(r) for r in nextpoint.drawn(nextpoint.prefix_sums(df, HORIZON), HORIZON, scatter, **o).collect()}
    changed = curves.withColumn("mag", F.when(F.col("dt") > HORIZON, F.lit(99.0)).otherwise(F.col("mag"))).repartition(3)
    assert points(curves) == points(changed) and points(curves) != points(curves, seed=1)
    many = nextpoint.drawn(nextpoint.prefix_sums(curves, HORIZON), HORIZON, scatter, draws=400)
    z = many.select(((F.when(F.col("next_band") == 0, F.col("g_m_last")).otherwise(F.col("r_m_last")) - F.col("mean")) / F.col("scatter")).alias("z"))
    n, mean, sd, inside = z.agg(F.count("*"), F.avg("z"), F.stddev("z"), F.avg((F.abs("z") < 1).cast("double"))).first()
    assert n > 5000 and abs(mean) < 4 / math.sqrt(n) and abs(sd - 1) < 0.03 and abs(inside - 0.6827) < 0.02
    assert many.where("obj_id = 50 and next_band = 1").count() == 0  # nothing to go on from


def test_the_forecast_goes_through_the_last_detection(spark):
    df = spark.createDataFrame([(1, 4.0, 0, 18.0), (1, 8.0, 0, 18.4), (2, 9.0, 1, 20.0), (3, 1.0, 0, 15.0), (3, 2.0, 0, 25.0)], "obj_id long, dt double, band int, mag double")
    got = {r["obj_id"]: (r[1], r[2]) for r in nextpoint.prefix_sums(df, HORIZON).select("obj_id", *nextpoint.forecast_next(HORIZON)).collect()}
    assert got[1] == (pytest.approx(18.4 + 0.1 * 3), None) and got[2] == (None, pytest.approx(20.0)) and got[3][0] == pytest.approx(25 + 0.2 * 9)


def test_value_of_sets(spark):
    before = spark.createDataFrame([(1, 4), (2, 3)], "obj_id long, size int")
    after = spark.createDataFrame([(1, 0, 4), (1, 0, 2), (1, 1, 1), (1, 1, 1), (2, 0, 4), (2, 1, 4)], "obj_id long, next_band int, size int")
    got = {(r["obj_id"], r["band"]): tuple(r)[2:] for r in nextpoint.set_value(before, after).collect()}
    assert got == {(1, 0): (4, 3.0, 1.0, 0.0, False), (1, 1): (4, 1.0, 3.0, 1.0, True), (2, 0): (3, 4.0, -1.0, 0.0, False), (2, 1): (3, 4.0, -1.0, 0.0, False)}
