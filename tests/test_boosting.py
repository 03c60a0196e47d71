"""Boosting that stops early, bands from leaves, and what is counted in them."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwave.operators import boosting, heads, leaves, models

SOME = boosting.Settings(most_rounds=25, held_share=0.3)


@pytest.fixture(scope="module")
def objects(spark):
    """Three rows an object; classes 0 to 5 by two columns, one in eight labels at random."""
    r = np.random.default_rng(5)
    rows = []
    for i in range(400):
        x, y, truth = r.random(), r.random(), 0
        truth = int(6 * x) if r.random() > 0.125 else int(r.integers(6))
        rows += [(i, float(truth), x + float(r.normal(0, 0.02)), y, float(r.random())) for _ in range(3)]
    return spark.createDataFrame(rows, "obj_id long, truth double, a double, b double, c double").repartition(4).persist()


COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def fitted(objects):
    fit = objects.where("obj_id % 4 <> 0")
    return boosting.train_hierarchy(fit, COLUMNS, SOME)


def test_boosting_stops_before_its_last_round(fitted):
    rounds = [*fitted.top.rounds, *fitted.branch.rounds]
    assert len(rounds) == 6 and all(1 <= n <= 25 for n in rounds) and min(rounds) < 25
    assert all(m.getNumTrees == n for m, n in zip(fitted.top.models, fitted.top.rounds, strict=True))
    assert max(fitted.top.rounds) > 1


def test_objects_are_held_out_whole(objects):
    held = objects.select("obj_id", boosting.held_out(F.col("obj_id"), 0.3).alias("held")).groupBy("obj_id").agg(F.count_distinct("held").alias("n"), F.max("held").alias("held"))
    assert held.where("n > 1").count() == 0 and 80 < held.where("held").count() < 160


def test_boosting_is_no_worse_than_a_forest(objects, fitted):
    fit, asked = objects.where("obj_id % 4 <> 0"), objects.where("obj_id % 4 = 0")
    p = boosting.predict_hierarchy(fitted, asked)
    sums = p.select(F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("s"), F.size("p").alias("n")).agg(F.min("s"), F.max("s"), F.min("n"), F.max("n")).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1) and sums[2:] == (6, 6)
    loss = p.agg(boosting.log_loss(p)).first()[0]
    plain = models.probabilities(models.forest(fit, COLUMNS), asked)
    assert loss <= plain.agg(boosting.log_loss(plain)).first()[0]
    right = p.agg(F.avg((F.array_position("p", F.array_max("p")) - 1 == F.col("truth")).cast("double"))).first()[0]
    assert right > 0.7


def test_a_level_gives_the_branch_its_share(fitted, objects):
    asked = objects.where("obj_id % 4 = 0").limit(20)
    both = boosting.boosted_probabilities(fitted.branch, boosting.boosted_probabilities(fitted.top, asked, "t"), "b").withColumn("p", heads.hierarchical(F.col("t"), F.col("b")[1]))
    for r in both.collect():
        assert r["p"][1] + r["p"][2] == pytest.approx(r["t"][1]) and r["p"][2] == pytest.approx(r["t"][1] * r["b"][1])


def test_leaf_table_is_its_sql(spark):
    r = np.random.default_rng(8)
    rows = [([int(r.integers(3)), int(r.integers(2)) * 4], float(r.normal()), float(r.random() + 0.5)) for _ in range(500)] + [([9, 0], 2.0, 0.25), ([0, 4], None, 5.0)]
    df = spark.createDataFrame(rows, "leaves array<int>, v double, w double").repartition(3)
    got = {(x["tree"], x["leaf"]): (x["weight"], x["q"]) for x in leaves.leaf_table(df, "v", "w", [0.16, 0.5, 0.84], least=10.0, buckets=1 << 20).collect()}
    con = duckdb.connect()
    con.execute("create table t (leaves int[], v double, w double)")
    con.executemany("insert into t values (?, ?, ?)", rows)
    want = con.sql("""
with e as (select unnest([0, 1]) as tree, unnest(leaves) as own, v, w from t where v is not null),
x as (select tree, unnest([own, -1]) as leaf, v, w from e),
c as (select tree, leaf, v, sum(w) over (partition by tree, leaf order by v) as below, sum(w) over (partition by tree, leaf) as everything from x)
select tree, leaf, any_value(everything), min(v) filter (below >= 0.16 * everything), min(v) filter (below >= 0.5 * everything), min(v) filter (below >= 0.84 * everything) from c group by tree, leaf""").fetchall()
    assert len(want) == len(got) == 8
    whole = {t: q for t, leaf, _, *q in want if leaf == leaves.ROOT}
    for tree, leaf, weight, *q in want:
        assert got[tree, leaf][0] == pytest.approx(weight)
        assert got[tree, leaf][1] == pytest.approx(q if weight >= 10 else whole[tree], abs=1e-4)
    assert leaves.leaf_table(df.limit(0), "v", "w", [0.5], 1.0).count() == 0


def test_bands_are_as_wide_as_the_residuals(spark):
    r = np.random.default_rng(9)
    rows = [(i, x := float(r.random()), float(r.normal(0, 0.1 if x < 0.5 else 1.0)), 1.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "obj_id long, x double, residual double, w double").repartition(4)
    part = F.col("obj_id") % 3
    shares = [0.16, 0.84]
    bands = leaves.fit_leaf_quantiles(df.where(part == 0), df.where(part == 1), ["x"], "residual", "w", shares)
    out = leaves.with_quantiles(bands, df.where(part == 2), shares)
    inside = (F.col("residual") >= F.col("q")[0]) & (F.col("residual") <= F.col("q")[1])
    got = out.groupBy((F.col("x") < 0.5).alias("quiet")).agg(F.avg(inside.cast("double")).alias("share"), F.avg(F.col("q")[1] - F.col("q")[0]).alias("width"))
    got = {x["quiet"]: x for x in got.collect()}
    assert all(0.6 < x["share"] < 0.76 for x in got.values()) and got[False]["width"] > 5 * got[True]["width"]
