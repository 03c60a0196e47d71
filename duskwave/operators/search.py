"""Search for model settings by successive halving over a sampled space.

Points of the space are drawn with a seed, so a search can be repeated. Each round fits all points that are left on the same folds, several at a time,
and the better ones go on with more trees. Folds are of whole objects, by a hash of their key. A point's score is half macro average precision, half macro F1.
"""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models
from .ranking import average_precision


class Point(NamedTuple):
    """Settings of a forest. Weights go with the power `beta` of a class' rarity."""

    depth: int
    beta: float
    columns: int


class Tried(NamedTuple):
    """One fit: its round, the trees it had, the point and its mean scores over the folds."""

    stage: int
    trees: int
    point: Point
    f1: float
    auprc: float
    score: float
    kept: bool


def sampled_points(n: int, most_columns: int, depths: tuple[int, ...] = (2, 3, 4, 5), betas: tuple[float, ...] = (0.0, 0.5, 1.0), seed: int = 0) -> list[Point]:
    """n different points, or all of the space if it has no more, in an order that the seed decides."""
    widths = sorted({max(1, most_columns // k) for k in (1, 2, 4)})
    space = [Point(d, b, w) for d in depths for b in betas for w in widths]
    draw = random.Random(seed)
    draw.shuffle(space)
    return space[:n]


def macro_scores(p: DataFrame, classes: int) -> tuple[float, float]:
    """Macro F1 and macro average precision of rows (truth, p). A class without rows and predictions counts as 0 in F1 and not at all in the other."""
    own = (F.array_position("p", F.array_max("p")) - 1).cast("int")
    each = p.select(F.col("truth").cast("int").alias("truth"), own.alias("cls"), F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("c"))
    hit, true, told = (F.count_if(x) for x in ((F.col("truth") == F.col("c")) & (F.col("cls") == F.col("c")), F.col("truth") == F.col("c"), F.col("cls") == F.col("c")))
    f1 = each.groupBy("c").agg(hit.alias("hit"), (true + told).alias("both")).agg(F.sum(F.when(F.col("both") > 0, 2 * F.col("hit") / F.col("both")).otherwise(0.0)) / classes).first()[0]
    ap = average_precision(p.select(F.col("truth").cast("int").alias("truth"), F.posexplode("p").alias("cls", "p"))).agg(F.avg("ap")).first()[0]
    return float(f1 or 0.0), float(ap or 0.0)


def halving(df: DataFrame, columns: list[str], points: list[Point], folds: int = 2, trees: int = 4, keep: int = 3, classes: int = 6, parallel: int = 4, key: str = "obj_id") -> list[Tried]:
    """All fits of the search; the last one kept is the winner. df has truth and columns, without nulls.

    One point in `keep` goes on to a round with `keep` times the trees, until one is left. Ties go to the smaller point. Every round reads all rows: what is
    spared are trees, not rows. Only scores reach the driver.
    """
    if not points or folds < 2 or keep < 2:
        raise ValueError("a search takes points, two folds or more and keeps one point of two or fewer")
    rows = df.withColumn("__fold", F.floor(models.share_of(F.col(key), "search") * folds).cast("int")).persist(StorageLevel.MEMORY_AND_DISK)

    def one(x: tuple[Point, int, int]) -> tuple[float, float]:
        point, n, k = x
        fit = models.class_weights(rows.where(F.col("__fold") != k), beta=point.beta)
        m = models.forest(fit, columns[: point.columns], weight="weight", trees=n, depth=point.depth)
        return macro_scores(models.probabilities(m, rows.where(F.col("__fold") == k)).select("truth", "p"), classes)

    out, left, stage, n = [], list(points), 0, trees
    try:
        with ThreadPoolExecutor(max(1, parallel)) as pool:
            while True:
                asked = [(p, n, k) for p in left for k in range(folds)]
                got = list(pool.map(inheritable_thread_target(df.sparkSession)(one), asked))
                means = {p: [sum(s[i] for (q, _, _), s in zip(asked, got, strict=True) if q == p) / folds for i in (0, 1)] for p in left}
                best = sorted(left, key=lambda p: (-round(sum(means[p]) / 2, 9), p))
                going = best[: max(1, len(left) // keep)]
                out += [Tried(stage, n, p, *means[p], sum(means[p]) / 2, p in going) for p in best]
                if len(going) == 1:
                    return out
                left, stage, n = going, stage + 1, n * keep
    finally:
        rows.unpersist()
