"""Boosted trees that stop where held-out objects stop gaining: one against the rest for each class, and the two-level hierarchy of them.

Objects are held out whole, by a hash of their key, so that no object is on both sides. A class' rounds are those after which the loss of the
held-out rows improves by less than the tolerance; only that many trees are kept, and their number is recorded. Margins of models that were fitted
one against the rest are no probabilities yet: a regularised multinomial logistic, fitted on the held-out rows, makes them such.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .heads import hierarchical
from .models import class_weights, prepared, share_of


class Settings(NamedTuple):
    most_rounds: int = 30
    depth: int = 3
    step: float = 0.1
    tolerance: float = 2e-4
    held_share: float = 0.3
    shrink: float = 1.0
    parallel: int = 4
    seed: int = 7


class Boosted(NamedTuple):
    """Models of classes against the rest, the trees that each kept, and what turns their margins into probabilities."""

    prepare: PipelineModel
    models: tuple[GBTClassificationModel, ...]
    rounds: tuple[int, ...]
    combine: LogisticRegressionModel


def held_out(key: Column, share: float, salt: str = "held") -> Column:
    """Whether the object of this key is held out."""
    return share_of(key, salt) < share


def fit_boosted(
    df: DataFrame, columns: list[str], label: str, classes: list[int], weight: str | None = None, settings: Settings | None = None, key: str = "obj_id", impute: bool = False
) -> Boosted:
    """A model of each of these classes against all other rows. The features are persisted once; classes are fitted `parallel` at a time."""
    s = settings or Settings()
    prepare = Pipeline(stages=prepared(columns, impute)).fit(df)
    rows = prepare.transform(df).select(F.col(label).alias("label"), "features", held_out(F.col(key), s.held_share).alias("held"), (F.col(weight) if weight else F.lit(1.0)).alias("weight"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)

    def one(k: int) -> GBTClassificationModel:
        learner = GBTClassifier(labelCol="is", featuresCol="features", weightCol="weight", validationIndicatorCol="held", maxIter=s.most_rounds, maxDepth=s.depth, stepSize=s.step, validationTol=s.tolerance, seed=s.seed)
        return learner.fit(rows.withColumn("is", (F.col("label") == k).cast("double")))

    try:
        with ThreadPoolExecutor(max(1, min(s.parallel, len(classes)))) as pool:
            fitted = tuple(pool.map(inheritable_thread_target(df.sparkSession)(one), classes))
        # the fewer held-out rows for each of its parameters, the nearer it stays to the classes' shares
        few = s.shrink * len(classes) ** 2 / max(rows.where("held").count(), 1)
        learner = LogisticRegression(labelCol="label", featuresCol="margins", weightCol="weight", family="multinomial", regParam=few, maxIter=100, predictionCol="__prediction")
        combine = learner.fit(_margins(fitted, rows.where("held")))
    finally:
        rows.unpersist()
    return Boosted(prepare, fitted, tuple(m.getNumTrees for m in fitted), combine)


def _margins(models: tuple[GBTClassificationModel, ...], df: DataFrame) -> DataFrame:
    """df with features as a vector of the models' margins."""
    out = df
    for k, m in enumerate(models):
        out = m.setRawPredictionCol(f"__raw{k}").setProbabilityCol(f"__p{k}").setPredictionCol(f"__c{k}").transform(out).withColumn(f"__m{k}", vector_to_array(f"__raw{k}")[1])
    return VectorAssembler(inputCols=[f"__m{k}" for k in range(len(models))], outputCol="margins").transform(out).select(*df.columns, "margins")


def boosted_probabilities(model: Boosted, df: DataFrame, name: str = "p") -> DataFrame:
    """df with an array of the probabilities of the labels 0, 1, ..."""
    out = model.combine.setProbabilityCol("__p").setRawPredictionCol("__raw").transform(_margins(model.models, model.prepare.transform(df)))
    return out.withColumn(name, vector_to_array("__p")).select(*df.columns, name)


def log_loss(df: DataFrame, label: str = "truth", p: str = "p") -> Column:
    """The mean of minus the logarithm of the true class' probability; an aggregate."""
    return F.avg(-F.ln(F.greatest(F.element_at(p, F.col(label).cast("int") + 1), F.lit(1e-15))))


class Hierarchy(NamedTuple):
    """The top level, with classes 1 and 2 merged, and the branch between these two."""

    top: Boosted
    branch: Boosted


def top_label(truth: Column) -> Column:
    return F.when(truth <= 1, truth).when(truth == 2, 1).otherwise(truth - 1).cast("double")


def train_hierarchy(df: DataFrame, columns: list[str], settings: Settings | None = None, impute: bool = False, classes: int = 5) -> Hierarchy:
    """Both levels, with rows weighted by class at the top. With impute, rows come from with_missing()."""
    top = class_weights(df.withColumn("top", top_label(F.col("truth"))), "top")
    branch = df.where("truth in (1, 2)").withColumn("second", (F.col("truth") == 2).cast("double"))
    return Hierarchy(fit_boosted(top, columns, "top", list(range(classes)), "weight", settings, impute=impute), fit_boosted(branch, columns, "second", [1], None, settings, impute=impute))


def predict_hierarchy(models: Hierarchy, df: DataFrame) -> DataFrame:
    both = boosted_probabilities(models.branch, boosted_probabilities(models.top, df, "__top"), "__branch")
    return both.withColumn("p", hierarchical(F.col("__top"), F.col("__branch")[1])).select(*df.columns, "p")
