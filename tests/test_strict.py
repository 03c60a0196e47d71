"""Strict validation stops a query, whatever it selects."""

import pytest
from pyspark.sql import functions as F

from duskwave.operators import lightcurve as lc

GOOD = [(1, 0.0, 0, 0.5, 0.1), (1, 3.0, 2, -1.0, 0.0), (2, 100.0, 1, 2.0, 0.2)]
LATE = [(2, 100.5, 7, None, -1.0), (1, -1.0, 9, 0.0, 0.1)]  # outside the horizon, so not looked at


def frame(spark, rows):
    return spark.createDataFrame(rows, "obj_id long, dt double, band int, logflux double, logflux_err double").repartition(2)


def test_sound_rows_pass(spark):
    got = lc.strictly_valid(frame(spark, GOOD + LATE))
    assert sorted(tuple(r) for r in got.collect()) == sorted(GOOD)
    assert lc.strictly_valid(frame(spark, []), 10).count() == 0
    assert [r[0] for r in lc.strictly_valid(frame(spark, GOOD), 10).select("dt").orderBy("dt").collect()] == [0.0, 3.0]


@pytest.mark.parametrize(
    ("bad", "why"),
    [
        ((3, 5.0, 0, None, 0.1), "finite"),
        ((3, 5.0, 0, float("nan"), 0.1), "finite"),
        ((3, 5.0, 0, 1.0, float("inf")), "finite"),
        ((3, None, 0, 1.0, 0.1), "finite"),
        ((3, float("nan"), 0, 1.0, 0.1), "finite"),
        ((3, 5.0, 0, 1.0, -0.1), "negative"),
        ((3, 5.0, 3, 1.0, 0.1), "band"),
        ((None, 5.0, None, 1.0, 0.1), "band"),
    ],
)
def test_a_faulty_row_stops_a_query_of_the_id_alone(spark, bad, why):
    checked = lc.strictly_valid(frame(spark, [*GOOD, bad]))
    for ask in (lambda: checked.select("obj_id").collect(), checked.count, lambda: checked.groupBy("obj_id").agg(F.count("*")).collect()):
        with pytest.raises(Exception, match=why):
            ask()


@pytest.mark.parametrize("days", [0, -1, 101, float("nan")])
def test_horizons_outside_their_range(spark, days):
    with pytest.raises(ValueError, match="horizon"):
        lc.strictly_valid(frame(spark, GOOD), days)
