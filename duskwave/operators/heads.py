"""Probabilities, sets, p-values and anomaly scores from raw scores and calibration rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import places

CLASSES = ("SN_Ia", "SN_CC", "SLSN", "AGN", "TDE", "CV")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(raw: Column) -> Column:
    e = F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))
    return F.transform(e, lambda x: x / total(e))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def energy(raw: Column) -> Column:
    """-logsumexp."""
    return -(F.array_max(raw) + F.ln(total(F.transform(raw, lambda x: F.exp(x - F.array_max(raw))))))


def hierarchical(top: Column, branch: Column) -> Column:
    """Five top-level probabilities (Ia, CC+, AGN, TDE, CV) and P(SLSN | CC+) to the six reported classes."""
    at = lambda i: F.element_at(top, i)
    return F.array(at(1), at(2) * (1 - branch), at(2) * branch, at(3), at(4), at(5))


def hierarchical_label(top: Column, branch: Column, threshold: float = 0.5) -> Column:
    """First largest top-level class; inside CC+ the branch decides, strictly above the threshold."""
    best = F.array_position(top, F.array_max(top)).cast("int")
    names = F.array(*(F.lit(x) for x in ("SN_Ia", "SN_CC", "AGN", "TDE", "CV")))
    return F.when((best == 2) & (branch > threshold), "SLSN").otherwise(F.element_at(names, best))


def long_probabilities(scores: DataFrame) -> DataFrame:
    """One row per object and class: p."""
    keep = [c for c in scores.columns if c not in ("raw", "emb")]
    return scores.select(*keep, F.posexplode(softmax(F.col("raw"))).alias("cls", "p"))


def rank_counts(asked: DataFrame, reference: DataFrame, by: list[str], value: str, bucket, largest_first: bool = True, name: str = "count") -> DataFrame:
    """asked, with how many reference rows of the same `by` have a value >= its own (<= if not largest_first), and their number n_ref.

    bucket maps a value monotonically to an integer: whole buckets beyond a value's own are counted once for all, and only the rows of
    one bucket are ordered together, so neither a large reference nor many questions about one key meet in one task.
    """
    a = asked.withColumn("__ref", F.lit(0))
    r = reference.select(*by, value).withColumn("__ref", F.lit(1))
    u = a.unionByName(r, allowMissingColumns=True).withColumn("__b", bucket(F.col(value)).cast("long"))
    keys = [*by, "__b"]
    per = u.groupBy(*keys).agg(F.sum("__ref").alias("__n"))
    way = F.col("__b").desc() if largest_first else F.col("__b")
    all_by = Window.partitionBy(*(by or [F.lit(0)]))
    per = per.withColumn("__beyond", F.coalesce(F.sum("__n").over(all_by.orderBy(way).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n_ref", F.sum("__n").over(all_by)).drop("__n")
    own = Window.partitionBy(*keys).orderBy(F.col(value).desc() if largest_first else F.col(value))
    return u.withColumn("__own", F.sum("__ref").over(own)).where("__ref = 0").join(per, keys).withColumn(name, F.col("__beyond") + F.col("__own")).drop("__ref", "__b", "__beyond", "__own")


def calibrate(cal: DataFrame, by: list[str], score: str = "s", tenths: int = 9) -> DataFrame:
    """Per key: n, k = ceil((n + 1) tenths / 10) and q, the k-th smallest score; 1.0 when k > n."""
    ranked = places(cal.select(*by, score), by, [score], F.floor(F.col(score) * 64)).withColumn("k", F.expr(f"((all_place + 1) * {tenths} + 9) div 10"))
    return ranked.groupBy(*by).agg(F.max("all_place").alias("n"), F.max("k").alias("k"), F.coalesce(F.max(F.when(F.col("place") == F.col("k"), F.col(score))), F.lit(1.0)).alias("q"))


def anomaly_probability(e: Column, slope: float, intercept: float, base_rate: float) -> Column:
    """Likelihood ratio exp(slope x energy + intercept), clipped, and prior to posterior."""
    if not 0 < base_rate < 1:
        raise ValueError("a base rate lies strictly between 0 and 1")
    lr = F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.lit(slope) * e + F.lit(intercept))))
    return lr * base_rate / (1 - base_rate + lr * base_rate)
