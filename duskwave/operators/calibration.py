"""Venn-Abers intervals: isotonic calibration with the test point added under either label, exact for any number of scores.

Calibration scores of a class are points of a cumulative diagram: (rows so far, positives so far). Its lower convex hull is the isotonic fit;
a block is what lies between two vertices. A point of label 0 added at rank i is pooled with whole blocks to its left and with a part of its
own block to its right, so its value is the smallest, over ranks b from i to the block's end, of the steepest line from a
vertex on the left to b. For label 1 it is the other way round. Each rank therefore looks at the vertices once, and running extremes
inside blocks give the rest: no pairs of ranks are formed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..sources import io
from . import ranking

#: Buckets of a score in [0, 1]; ranks that are ordered together; groups of hulls that are merged at once.
FINE, CHUNK, FAN = 1 << 20, 1 << 16, 16


def hull_vertices(points: DataFrame, by: list[str]) -> DataFrame:
    """by, cn, cy of the vertices of the lower convex hull of (cn, cy), both whole numbers and rising with the rank i.

    Stretches of CHUNK ranks give their own hulls, and FAN neighbouring hulls are merged until one is left. A hull of whole-number points has
    in the order of n^(2/3) vertices for n rows at most (a smooth calibration curve has n^(1/3)), so a merge stays far below n.
    """

    def lower(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        x, y, kept = rows["cn"].tolist(), rows["cy"].tolist(), []
        for k in range(len(x)):
            while len(kept) > 1 and (y[kept[-1]] - y[kept[-2]]) * (x[k] - x[kept[-1]]) >= (y[k] - y[kept[-1]]) * (x[kept[-1]] - x[kept[-2]]):
                kept.pop()
            kept.append(k)
        return rows.iloc[np.array(kept, dtype=int)]

    ship(points.sparkSession)
    types = dict(points.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in [*by, "i", "cn", "cy"])
    now = points.select(*by, "i", "cn", "cy").withColumn("part", F.floor(F.col("i") / CHUNK))
    stretches = (points.agg(F.max("i")).first()[0] or 0) // CHUNK + 1
    while True:
        now = now.groupBy(*by, "part").applyInPandas(lambda rows: lower(rows).assign(part=rows["part"].iloc[0] // FAN), f"{schema}, part long")
        if stretches == 1:
            return now.select(*by, "cn", "cy")
        stretches = -(-stretches // FAN)


def _running_extreme(df: DataFrame, by: list[str], order: Column, chunk: Column, fn, value: str, name: str) -> DataFrame:
    """df with the extreme of value over all rows up to each one inside by; chunk never falls along the order, and only its rows are ordered together."""
    df = df.withColumn("__c", chunk)
    before = Window.partitionBy(*by).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    per = df.groupBy(*by, "__c").agg(fn(value).alias("__e")).withColumn("__e", fn("__e").over(before))
    inside = Window.partitionBy(*by, "__c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    pick = F.least if fn is F.min else F.greatest  # these skip NULL
    return df.withColumn("__v", fn(value).over(inside)).join(per, [*by, "__c"]).withColumn(name, pick("__v", "__e")).drop("__c", "__v", "__e")


def venn_abers_table(cal: DataFrame, by: list[str]) -> DataFrame:
    """by, i, s, p0, p1 from rows of by, s (a score in [0, 1]) and y (0 or 1): the interval of a test score that reaches exactly i of the
    different calibration scores, s being the i-th (NULL for i = 0). Equal scores are one rank."""
    blk = cal.groupBy(*by, "s").agg(F.sum("y").cast("long").alias("sy"), F.count("*").alias("n"))
    pts = ranking.running(blk, by, ["s"], F.floor(F.col("s") * FINE), {"cy": F.col("sy"), "cn": F.col("n"), "i": F.lit(1).cast("long")}).select(*by, "i", "s", "cn", "cy")
    none = blk.select(*by).distinct().select(*by, F.lit(0).cast("long").alias("i"), F.lit(None).cast("double").alias("s"), F.lit(0).cast("long").alias("cn"), F.lit(0).cast("long").alias("cy"))
    pts = io.stored(pts.unionByName(none), "calibration-ranks")
    hull = hull_vertices(pts, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("cn", "cy"))).alias("v"))
    x = pts.join(F.broadcast(hull), by)  # one row a class
    steep = lambda left, right, y: (right["cy"] - left["cy"] + y) / (right["cn"] - left["cn"] + 1)
    me = {"cn": F.col("cn"), "cy": F.col("cy")}
    left, right = F.filter("v", lambda p: p["cn"] < F.col("cn")), F.filter("v", lambda p: p["cn"] > F.col("cn"))
    x = x.withColumns(
        {
            "f0": F.coalesce(F.array_max(F.transform(left, lambda p: steep(p, me, 0))), F.lit(0.0)),
            "f1": F.coalesce(F.array_min(F.transform(right, lambda p: steep(me, p, 1))), F.lit(1.0)),
            "j0": F.size(left), "j1": F.size(right),
        }
    ).drop("v")
    x = _running_extreme(x, [*by, "j0"], F.desc("i"), -F.floor(F.col("i") / CHUNK), F.min, "f0", "p0")
    x = _running_extreme(x, [*by, "j1"], F.asc("i"), F.floor(F.col("i") / CHUNK), F.max, "f1", "p1")
    return x.select(*by, "i", "s", "p0", "p1")


def venn_abers_intervals(asked: DataFrame, table: DataFrame, by: list[str], score: str) -> DataFrame:
    """asked with lower, upper and merged = p1 / (1 - p0 + p1), from the last step that the score reaches; every row has one where its class has a table."""
    step = F.struct("s", "p0", "p1")
    steps = table.withColumn("__at", F.coalesce("s", F.lit(-1.0))).withColumn("__step", step).select(*by, "__at", "__step")
    found = ranking.last_reached(asked, steps, by, F.col(score), "__at", "__step", lambda c: F.floor(c * FINE))
    got = found.where(F.col("__step").isNotNull())
    lo, hi = F.col("__step.p0"), F.col("__step.p1")
    return got.withColumns({"lower": F.least(lo, hi), "upper": F.greatest(lo, hi), "merged": hi / (1 - lo + hi)}).drop("__step")
