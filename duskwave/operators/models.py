"""MLlib models: hierarchical and flat classifiers, combiners, regressors, and the training tables they need.

Trees take no NULL, so features go through a median imputer with missing indicators; this differs from learners with native missing values.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_weights(df: DataFrame, label: str = "truth", beta: float = 0.5) -> DataFrame:
    """Adds weight = (N / (K n_c))^beta; classes are counted once and come back by a join on the class."""
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    every = Window.partitionBy(F.lit(0))
    n = n.withColumn("weight", F.pow(F.sum("__n").over(every) / (F.count("*").over(every) * F.col("__n")), F.lit(beta)))
    return df.join(F.broadcast(n.select(label, "weight")), label)


def object_weights(df: DataFrame, key: str = "obj_id") -> DataFrame:
    """Adds weight = 1 / rows of the object, rescaled to mean 1."""
    own = 1 / F.count("*").over(Window.partitionBy(key))
    objects = F.lit(df.select(key).distinct().count())
    return df.withColumn("weight", own * F.lit(df.count()) / objects)


def share_of(key: Column, salt: str) -> Column:
    """A number in [0, 1) from a hash, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"/{salt}"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def context_dropout(df: DataFrame, blocks: dict[str, list[str]], rate: float = 0.3, key: str = "obj_id", salt: str = "") -> DataFrame:
    """Each block of columns becomes NULL on about `rate` of the rows, independently, by hash."""
    out = df
    for name, columns in blocks.items():
        keep = share_of(F.col(key), f"{name}{salt}") >= rate
        out = out.withColumns({c: F.when(keep, F.col(c)) for c in columns})
    return out


def multiview(df: DataFrame, blocks: dict[str, list[str]], copies: int = 3, rate: float = 0.4, key: str = "obj_id") -> DataFrame:
    """The rows and `copies` dropped-out views of them, all at weight 1 / (copies + 1)."""
    views = [df.withColumn("view", F.lit(0))] + [context_dropout(df, blocks, rate, key, f"#{v}").withColumn("view", F.lit(v)) for v in range(1, copies + 1)]
    out = views[0]
    for v in views[1:]:
        out = out.unionByName(v)
    return out.withColumn("weight", F.lit(1 / (copies + 1)))


def prepared(columns: list[str] | None, impute: bool = False) -> list:
    """Stages from columns to `features`; none for rows that have `features` already (columns None)."""
    if columns is None:
        return []
    if not impute:
        return [VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")]
    filled = [f"{c}__filled" for c in columns]
    return [Imputer(inputCols=columns, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled + [f"{c}__missing" for c in columns], outputCol="features")]


def with_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}__missing": F.col(c).isNull().cast("double") for c in columns} | {c: F.coalesce(F.col(c), F.lit(float("nan"))) for c in columns})


def forest(df: DataFrame, columns: list[str] | None, label: str = "truth", weight: str | None = None, trees: int = 12, depth: int = 4, seed: int = 7, impute: bool = False) -> PipelineModel:
    learner = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="probability", rawPredictionCol="rawPrediction")
    if weight:
        learner = learner.setWeightCol(weight)
    return Pipeline(stages=[*prepared(columns, impute), learner]).fit(df)


def probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with p, the array of class probabilities."""
    return model.transform(df).withColumn("p", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")


def logistic(df: DataFrame, columns: list[str], label: str, balanced: bool = True) -> PipelineModel:
    rows = class_weights(df, label, 1.0) if balanced else df.withColumn("weight", F.lit(1.0))
    return Pipeline(stages=[*prepared(columns), LogisticRegression(labelCol=label, featuresCol="features", weightCol="weight", maxIter=50, standardization=True)]).fit(rows)


def boosted_regressor(df: DataFrame, columns: list[str], label: str, weight: str | None = None, rounds: int = 5) -> PipelineModel:
    learner = GBTRegressor(labelCol=label, featuresCol="features", lossType="absolute", maxIter=rounds, maxDepth=3, seed=7)
    if weight:
        learner = learner.setWeightCol(weight)
    return Pipeline(stages=[*prepared(columns), learner]).fit(df)


def out_of_fold(df: DataFrame, columns: list[str], folds: int = 5, **options) -> DataFrame:
    """Probabilities for each row from the model of the other folds."""
    parts = [probabilities(forest(df.where(F.col("fold") != k), columns, **options), df.where(F.col("fold") == k)) for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
