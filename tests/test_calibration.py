"""Venn-Abers tables against isotonic fits with the test point added."""

import random

import pytest
from pyspark.sql import functions as F

from duskwave.operators import calibration


def isotonic(y, n):
    """Pool adjacent violators: the fitted value of each position."""
    blocks = []
    for v, w in zip(y, n):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, w2, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + w2, blocks[-1][2] + k]
    return [v / w for v, w, k in blocks for _ in range(k)]


@pytest.mark.parametrize("kind", ["rising", "flat", "falling", "ties", "one", "negative"])
def test_every_step_is_an_isotonic_fit(spark, monkeypatch, kind):
    monkeypatch.setattr(calibration, "CHUNK", 16)  # many stretches, and hulls that are merged in two rounds
    monkeypatch.setattr(calibration, "FAN", 3)
    r = random.Random(kind)
    rows = []
    for _ in range({"one": 1}.get(kind, 150)):
        s = r.choice([0.0, 0.1, 0.4, 0.7, 1.0]) if kind == "ties" else r.random()
        share = {"rising": s * s, "falling": 1 - s, "negative": 0}.get(kind, 0.5)
        rows.append(("a", s, int(r.random() < share)))
    rows += [("b", 0.3, 1), ("b", 0.6, 0)]
    got = {(x["c"], x["i"]): x for x in calibration.venn_abers_table(spark.createDataFrame(rows, "c string, s double, y long"), ["c"]).collect()}
    for c in "ab":
        scores = sorted({s for k, s, _ in rows if k == c})
        y = [sum(v for k, t, v in rows if k == c and t == s) for s in scores]
        n = [sum(1 for k, t, _ in rows if k == c and t == s) for s in scores]
        assert sum(k == c for k, _ in got) == len(scores) + 1
        for i in range(len(scores) + 1):
            x = got[c, i]
            assert x["s"] == (scores[i - 1] if i else None)
            for label, name in ((0, "p0"), (1, "p1")):
                assert x[name] == pytest.approx(isotonic([*y[:i], label, *y[i:]], [*n[:i], 1, *n[i:]])[i], abs=1e-12)


def test_lookup_takes_the_last_step_reached(spark):
    cal = spark.createDataFrame([("a", s / 10, int(s > 4)) for s in range(1, 10)], "c string, s double, y long")
    table = calibration.venn_abers_table(cal, ["c"])
    asked = spark.createDataFrame([("a", k, p) for k, p in enumerate((0.0, 0.1, 0.15, 0.5, 0.95))] + [("no table", 9, 0.5)], "c string, k int, p double")
    got = calibration.venn_abers_intervals(asked, table, ["c"], "p").orderBy("k").collect()
    step = {x["i"]: (x["p0"], x["p1"]) for x in table.collect()}
    assert [(x["lower"], x["upper"]) for x in got] == [step[0], step[1], step[1], step[5], step[9]]
    assert all(x["merged"] == x["upper"] / (1 - x["lower"] + x["upper"]) and x["lower"] <= x["upper"] for x in got)
    assert calibration.venn_abers_table(cal.limit(0), ["c"]).where(F.col("i") >= 0).count() == 0
