"""Successive halving: rounds, reproducibility, and what wins."""

import pytest
from pyspark.sql import functions as F

from duskwave.operators import models, ranking, search


def rows(spark, n=400):
    t = spark.range(n).select(F.col("id").alias("obj_id"), (F.col("id") % 3).cast("double").alias("truth"))
    noise = lambda k: models.share_of(F.col("obj_id"), f"noise{k}")
    return t.withColumns({"x0": F.col("truth") + noise(0), "x1": noise(1), "x2": noise(2), "x3": noise(3)})


def test_points_are_different_and_repeat():
    a = search.sampled_points(8, 64)
    assert len(set(a)) == 8 and a == search.sampled_points(8, 64) and a != search.sampled_points(8, 64, seed=1)
    assert len(search.sampled_points(10_000, 64)) == 4 * 3 * 3 and {p.columns for p in search.sampled_points(99, 1)} == {1}


def test_macro_scores_by_hand(spark):
    p = spark.createDataFrame([(0, [0.9, 0.1, 0.0]), (0, [0.4, 0.6, 0.0]), (1, [0.2, 0.8, 0.0]), (1, [0.3, 0.7, 0.0])], "truth int, p array<double>")
    f1, ap = search.macro_scores(p, 3)
    assert abs(f1 - (2 / 3 + 4 / 5 + 0) / 3) < 1e-12 and abs(ap - 1.0) < 1e-12
    assert search.macro_scores(p.limit(0), 3) == (0.0, 0.0)
    assert ranking.average_precision(p.limit(0).select("truth", F.posexplode("p").alias("cls", "p"))).count() == 0


def test_rounds_and_winner(spark):
    points = [search.Point(3, 0.5, 4), search.Point(1, 0.5, 4), search.Point(2, 1.0, 1), search.Point(1, 0.0, 1)]
    run = lambda: search.halving(rows(spark), ["x0", "x1", "x2", "x3"], points, trees=2, keep=2, classes=3)
    tried = run()
    assert [(t.stage, t.trees) for t in tried] == [(0, 2)] * 4 + [(1, 4)] * 2
    for stage in (0, 1):
        scores = [t.score for t in tried if t.stage == stage]
        assert scores == sorted(scores, reverse=True) and sum(t.kept for t in tried if t.stage == stage) == len(scores) // 2
    winner = tried[4]
    default = [t for t in tried if t.stage == 0 and t.point == points[0]][0]
    assert winner.kept and winner.score > default.score - 0.02 and winner.score > 0.9
    again = run()
    assert [t.point for t in again] == [t.point for t in tried] and all(abs(a.score - b.score) < 1e-9 for a, b in zip(again, tried, strict=True))


def test_odd_settings_are_errors(spark):
    for bad in ({"points": []}, {"folds": 1}, {"keep": 1}):
        with pytest.raises(ValueError, match="a search takes"):
            search.halving(rows(spark, 10), ["x0"], **{"points": [search.Point(1, 0.5, 1)], **bad})
