"""Quantiles in the leaves of fitted trees: bands that are wide where residuals are.

Trees are fitted to the size of residuals; what other objects' residuals look like in each leaf is counted in buckets, and quantiles come from
running sums over the buckets of a leaf. A row's quantile is the mean over the trees of its leaves' quantiles.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import prepared

#: A leaf's number in the table of all leaves.
ROOT = -1


class LeafQuantiles(NamedTuple):
    """Trees, and a table (tree, leaf, weight, q) with an array of quantiles for each leaf; its size is that of the trees."""

    trees: PipelineModel
    table: DataFrame


def leaf_numbers(trees: PipelineModel, df: DataFrame) -> DataFrame:
    """df with leaves, the number of the row's leaf in each tree."""
    return trees.transform(df).withColumn("leaves", F.transform(vector_to_array("__leaf"), lambda x: x.cast("int"))).select(*df.columns, "leaves")


def leaf_table(rows: DataFrame, value: str, weight: str, shares: list[float], least: float, buckets: int = 4096) -> DataFrame:
    """tree, leaf, weight, q of rows with leaves: the smallest bucket edge with a share of the leaf's weight below it.

    Rows without a value are not counted. Buckets divide the range of all values evenly. A leaf with less weight than `least` has the quantiles of its whole tree. Before the window
    there is at most one row for each leaf and bucket, however many rows were counted.
    """
    rows = rows.where(F.col(value).isNotNull())
    low, high = rows.agg(F.min(value), F.max(value)).first()
    width = ((high - low) / buckets or 1.0) if low is not None else 1.0
    spot = F.least(F.floor((F.col(value) - F.lit(low or 0.0)) / F.lit(width)), F.lit(buckets - 1))
    each = rows.select(F.posexplode("leaves").alias("tree", "own"), spot.alias("bucket"), F.col(weight).alias("weight"))
    each = each.select("tree", F.explode(F.array(F.col("own"), F.lit(ROOT))).alias("leaf"), "bucket", "weight").groupBy("tree", "leaf", "bucket").agg(F.sum("weight").alias("weight"))
    leaf = Window.partitionBy("tree", "leaf")
    each = each.withColumn("below", F.sum("weight").over(leaf.orderBy("bucket"))).withColumn("all", F.sum("weight").over(leaf))
    edge = lambda b: F.lit(low or 0.0) + (b + 1) * F.lit(width)
    found = each.groupBy("tree", "leaf").agg(F.first("all").alias("weight"), F.array(*(edge(F.min(F.when(F.col("below") >= F.lit(q) * F.col("all") - 1e-9, F.col("bucket")))) for q in shares)).alias("q"))
    whole = found.where(F.col("leaf") == ROOT).select("tree", F.col("q").alias("whole"))
    return found.join(F.broadcast(whole), "tree").select("tree", "leaf", "weight", F.when(F.col("weight") >= least, F.col("q")).otherwise(F.col("whole")).alias("q"))  # one row a tree


def fit_leaf_quantiles(
    fit: DataFrame, calibrate: DataFrame, columns: list[str], value: str, weight: str, shares: list[float], trees: int = 8, depth: int = 4, least: float = 40.0, seed: int = 7
) -> LeafQuantiles:
    """Trees on the size of fit's values; quantiles of calibrate's values, which should be of other objects."""
    learner = RandomForestRegressor(labelCol="__size", featuresCol="features", weightCol=weight, numTrees=trees, maxDepth=depth, minInstancesPerNode=20, subsamplingRate=0.7, leafCol="__leaf", predictionCol="__mean", seed=seed)
    model = Pipeline(stages=[*prepared(columns), learner]).fit(fit.withColumn("__size", F.abs(value)))
    return LeafQuantiles(model, leaf_table(leaf_numbers(model, calibrate), value, weight, shares, least))


def with_quantiles(model: LeafQuantiles, df: DataFrame, shares: list[float], name: str = "q") -> DataFrame:
    """df with an array of quantiles. The leaf table comes to the driver like the trees themselves, which have as many leaves."""
    rows = model.table.collect()
    spot = lambda tree, leaf: tree * F.lit(1 << 20) + leaf
    known = F.create_map(*(c for r in rows for c in (spot(F.lit(r["tree"]), F.lit(r["leaf"])), F.array(*map(F.lit, r["q"])))))
    trees = len({r["tree"] for r in rows})

    def of(i: int) -> Column:
        each = F.transform("leaves", lambda leaf, tree: F.coalesce(F.try_element_at(known, spot(tree, leaf)), F.try_element_at(known, spot(tree, F.lit(ROOT))))[i])
        return F.aggregate(each, F.lit(0.0), lambda a, b: a + b) / F.lit(float(trees))

    if not rows:
        return df.withColumn(name, F.lit(None).cast("array<double>"))
    return leaf_numbers(model.trees, df).withColumn(name, F.array(*(of(i) for i in range(len(shares))))).select(*df.columns, name)
