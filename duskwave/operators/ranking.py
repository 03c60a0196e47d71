"""Running totals and places over a whole table, or over large groups, without sorting one in a single task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, by: list[str], order: list[Column | str], bucket: Column, sums: dict[str, Column]) -> DataFrame:
    """df with running totals of `sums` inside each `by`, in this order, and the totals of all of `by` as all_<name>.

    bucket maps rows to integers that never fall along the order (negate it for descending ones). Buckets are added up first, one row each;
    after that only the rows of one bucket are ordered together.
    """
    b = df.withColumn("__b", bucket.cast("long")).withColumns({f"__{n}": c for n, c in sums.items()})
    keys, one = [*by, "__b"], by or [F.lit(0)]
    # buckets in two levels: stretches of a thousand first, so that a fine bucket costs no long window
    per = b.groupBy(*keys).agg(*(F.sum(f"__{n}").alias(f"__s_{n}") for n in sums)).withColumn("__far", F.floor(F.col("__b") / 1000))
    before = lambda key, *cells: Window.partitionBy(*one, *cells).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    far = per.groupBy(*by, "__far").agg(*(F.sum(f"__s_{n}").alias(f"__f_{n}") for n in sums))
    far = far.select(*by, "__far", *(so_far(f"__f_{n}", before("__far")).alias(f"__far_{n}") for n in sums), *(F.sum(f"__f_{n}").over(Window.partitionBy(*one)).alias(f"all_{n}") for n in sums))
    per = per.withColumns({f"__before_{n}": so_far(f"__s_{n}", before("__b", "__far")) for n in sums}).join(far, [*by, "__far"])
    per = per.select(*keys, *((F.col(f"__before_{n}") + F.col(f"__far_{n}")).alias(f"__before_{n}") for n in sums), *(f"all_{n}" for n in sums))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = b.withColumns({n: F.sum(f"__{n}").over(inside) for n in sums}).join(per, keys)
    out = out.withColumns({n: F.col(n) + F.col(f"__before_{n}") for n in sums})
    return out.drop("__b", *(f"__{n}" for n in sums), *(f"__before_{n}" for n in sums))


def places(df: DataFrame, by: list[str], order: list[Column | str], bucket: Column) -> DataFrame:
    """df with `place`, from 1, and all_place, the number of rows in `by`."""
    return running(df, by, order, bucket, {"place": F.lit(1).cast("long")})


def average_ranks(df: DataFrame, value: str, bucket: Column, name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """df with the rank of value from 1, ties averaged, and all_<name>, the number of rows; rows without a value go.

    Equal values are counted first, so a value that many rows share is one row when ranks are made.
    """
    by = by or []
    n = df.where(F.col(value).isNotNull()).withColumn("__b", bucket).groupBy(*by, value, "__b").agg(F.count("*").alias("__n"))
    r = running(n.withColumnRenamed("__b", "__at"), by, [value], F.col("__at"), {"__upto": F.col("__n")})
    r = r.select(*by, value, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(name), F.col("all___upto").alias(f"all_{name}"))
    return df.join(r, [*by, value])


def quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float], bucket: Column) -> DataFrame:
    """One row per `by`: n and exact quantiles with linear interpolation, as columns named in qs. NULL values don't count.

    Unlike percentile(), which gathers all distinct values of a group in one task's memory, only counts by bucket and the rows on either
    side of each quantile meet.
    """
    p = places(df.where(F.col(value).isNotNull()).select(*by, value), by, [value], bucket)
    out = {}
    for name, q in qs.items():
        at = (F.col("all_place") - 1) * F.lit(float(q))
        below, above = F.floor(at) + 1, F.least(F.floor(at) + 2, F.col("all_place"))
        part = lambda place: F.max(F.when(F.col("place") == place, F.col(value)))
        out[name] = part(below) + F.max(at - F.floor(at)) * (part(above) - part(below))
    return p.groupBy(*by).agg(F.max("all_place").alias("n"), *(c.alias(n) for n, c in out.items()))


def last_reached(asked: DataFrame, steps: DataFrame, by: list[str], value: Column, at: str, step: str, bucket) -> DataFrame:
    """asked with the column `step` of the row of steps (by, at, step) with the largest at <= value in its `by`; NULL if there is none.

    bucket(Column) maps values to integers that never fall. Steps and rows of one bucket are ordered together; what a bucket starts
    with is the last step of the buckets before it, one row each.
    """
    rows = asked.withColumn("__row", F.struct(*asked.columns)).select(*by, value.alias("__v"), "__row", F.lit(None).cast(steps.schema[step].dataType).alias(step))
    marks = steps.select(*by, F.col(at).alias("__v"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), step)
    both = rows.unionByName(marks).withColumn("__b", bucket(F.col("__v")).cast("long"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = both.groupBy(*by, "__b").agg(F.max(F.when(F.col("__row").isNull(), F.struct("__v", step))).alias("__last"))
    first = first.withColumn("__first", F.last("__last", ignorenulls=True).over(before)).select(*by, "__b", "__first")
    inside = Window.partitionBy(*by, "__b").orderBy("__v", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(step, F.last(step, ignorenulls=True).over(inside)).where(F.col("__row").isNotNull()).join(first, [*by, "__b"])
    return found.select("__row.*", F.coalesce(step, F.col(f"__first.{step}")).alias(step))


#: Replicates of a bootstrap.
REPLICATES = 2000


def hashed(*parts: Column | str) -> Column:
    """The first 32 bits of the md5 of the parts, joined by slashes."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 8), 16, 10).cast("long")


def poisson_steps() -> list[int]:
    """Where the Poisson(1) weight of a 32-bit hash rises by one."""
    total, out = 0.0, []
    for k in range(13):
        total += math.exp(-1) / math.factorial(k)
        out.append(round(total * 2**32))
    return [x for x in out if x < 2**32]


def replicated(df: DataFrame, n: int = REPLICATES) -> DataFrame:
    """Every row of df once for each replicate rep from 0; rows are dealt out first, so that a small table's replicates are not one task's work."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def poisson_bootstrap(df: DataFrame, key: str, values: list[str], n: int = REPLICATES) -> DataFrame:
    """rep and the mean of each value in n resamples of the rows: each row counts as often as a Poisson(1) draw from the hash of replicate and key.

    A row's draws need no other row, so nothing is joined, and sums by replicate are folded before anything moves: n rows a task. Means of a
    replicate that draws no row are NULL.
    """
    drawn = replicated(df.select(*values, key), n).withColumn("__h", hashed("rep", key))
    drawn = drawn.withColumn("__w", sum(((F.col("__h") >= t).cast("int") for t in poisson_steps()), F.lit(0)))
    return drawn.groupBy("rep").agg(*((F.sum(F.col("__w") * F.col(v)) / F.nullif(F.sum("__w"), F.lit(0))).alias(v) for v in values))


def average_precision(long: DataFrame) -> DataFrame:
    """cls, ap of rows (cls, truth, p): one-vs-rest; tied scores are one step. A class without true rows is left out."""
    r = long.groupBy("cls", "p").agg(F.sum((F.col("cls") == F.col("truth")).cast("long")).alias("tp"), F.count("*").alias("n"))
    c = running(r, ["cls"], [F.desc("p")], -F.floor(F.col("p") * 256), {"ctp": F.col("tp"), "cn": F.col("n")}).withColumnRenamed("all_ctp", "pos")
    return c.where("pos > 0").groupBy("cls").agg(F.sum(F.col("tp") / F.col("pos") * (F.col("ctp") / F.col("cn"))).alias("ap"))
