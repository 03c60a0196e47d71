"""What one more observation is worth: draws of the next point are appended to each prefix, and the prediction sets they lead to are counted.

A prefix is kept as sums (one row an object), from which all features follow. A drawn point is added to the sums, so nothing is computed
from detections again, however many draws there are. Draws are normal, by a hash of object, band, number and seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: g and r; a next point is drawn in these.
LETTERS = "gr"
_SUMS = ("n", "m", "mm", "t", "tt", "tm", "min", "max", "first", "last", "m_last")
FEATURES = ("n_total", "span", *(f"{x}_{c}" for x in LETTERS for c in ("n", "mean", "sd", "min", "max", "slope", "age")), "colour")


def prefix_sums(phot: DataFrame, horizon: float) -> DataFrame:
    """One row an object: sums over its detections in g and r up to the horizon. What comes later is not looked at."""
    rows = phot.where((F.col("dt") <= horizon) & F.col("band").isin(0, 1))
    out = []
    for b, x in enumerate(LETTERS):
        only = lambda c, b=b: F.when(F.col("band") == b, c)
        t, m = F.col("dt"), F.col("mag")
        out += [F.count_if(F.col("band") == b).alias(f"{x}_n"), *(F.coalesce(F.sum(only(v)), F.lit(0.0)).alias(f"{x}_{c}") for c, v in (("m", m), ("mm", m * m), ("t", t), ("tt", t * t), ("tm", t * m)))]
        out += [F.min(only(m)).alias(f"{x}_min"), F.max(only(m)).alias(f"{x}_max"), F.min(only(t)).alias(f"{x}_first"), F.max(only(t)).alias(f"{x}_last"), F.max(only(F.struct(t, (-m).alias("m")))).alias(f"{x}_at")]
    sums = rows.groupBy("obj_id").agg(*out)
    return sums.select("obj_id", *(-F.col(f"{x}_at.m") if c == "m_last" else F.col(f"{x}_{c}") for x in LETTERS for c in _SUMS)).toDF("obj_id", *(f"{x}_{c}" for x in LETTERS for c in _SUMS))


def appended(sums: DataFrame, band: Column, t: Column, m: Column) -> DataFrame:
    """sums with one more detection in the band. It is later than all others."""
    new = {}
    for b, x in enumerate(LETTERS):
        of = lambda c, x=x: F.col(f"{x}_{c}")
        value = {"n": of("n") + 1, "m": of("m") + m, "mm": of("mm") + m * m, "t": of("t") + t, "tt": of("tt") + t * t, "tm": of("tm") + t * m}
        value |= {"min": F.least(of("min"), m), "max": F.greatest(of("max"), m), "first": F.coalesce(of("first"), t), "last": t, "m_last": m}
        new |= {f"{x}_{c}": F.when(band == b, v).otherwise(of(c)) for c, v in value.items()}
    return sums.withColumns(new)


def slope_of(x: str) -> Column:
    """Least squares; NULL if all times are one."""
    n, t, m, tt, tm = (F.col(f"{x}_{c}") for c in ("n", "t", "m", "tt", "tm"))
    spread = n * tt - t * t
    return F.when(spread > 1e-9 * F.greatest(n * tt, F.lit(1e-9)), (n * tm - t * m) / spread)


def with_features(sums: DataFrame) -> DataFrame:
    """sums with FEATURES, NULL where a band has too little."""
    new = {}
    for x in LETTERS:
        n, m, mm = (F.col(f"{x}_{c}") for c in ("n", "m", "mm"))
        mean = F.try_divide(m, n)
        new |= {f"{x}_mean": mean, f"{x}_sd": F.when(n > 1, F.sqrt(F.greatest(mm / n - mean * mean, F.lit(0.0)))), f"{x}_slope": slope_of(x), f"{x}_age": F.col(f"{x}_last") - F.col(f"{x}_first")}
    out = sums.withColumns(new)
    out = out.withColumns({"n_total": F.col("g_n") + F.col("r_n"), "span": F.greatest("g_last", "r_last") - F.least("g_first", "r_first"), "colour": F.col("g_mean") - F.col("r_mean")})
    return out.withColumns({c: F.col(c).cast("double") for c in FEATURES})


def forecast_next(horizon: float, step: float = 1.0, grid: float = 5.0, steepest: float = 0.2) -> list[Column]:
    """The magnitude `step` days after the horizon in each band: on the line from the last detection to the forecast at the first grid day,
    which goes on with the band's slope up to `steepest`. NULL without a detection in the band."""
    out = []
    for x in LETTERS:
        last, m0 = F.col(f"{x}_last"), F.col(f"{x}_m_last")
        slope = F.greatest(F.lit(-steepest), F.least(F.lit(steepest), F.coalesce(slope_of(x), F.lit(0.0))))
        m1 = m0 + slope * (F.lit(horizon + grid) - last)
        out.append(m0 + (m1 - m0) * (F.lit(horizon + step) - last) / (F.lit(horizon + grid) - last))
    return out


def normal_draw(*key: Column) -> Column:
    """A standard normal number from a hash of the key (Box and Muller)."""
    digest = F.md5(F.concat_ws("/", *(c.cast("string") for c in key)))
    u = [(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0) for at in (1, 9)]
    return F.sqrt(-2 * F.ln(u[0])) * F.cos(F.lit(6.283185307179586) * u[1])


def drawn(sums: DataFrame, horizon: float, scatter: DataFrame, draws: int = 16, seed: int = 0, step: float = 1.0) -> DataFrame:
    """For each object, each band that it has detections in and each draw: the sums with the drawn point, and next_band, draw, mean.

    scatter has one row for each band (band, scatter). Rows are multiplied by 2 * draws.
    """
    means = F.array(*(F.struct(F.lit(b).alias("b"), mean.alias("mean")) for b, mean in enumerate(forecast_next(horizon, step))))
    each = sums.withColumn("next", F.explode(F.filter(means, lambda s: s["mean"].isNotNull()))).withColumn("next_band", F.col("next.b")).withColumn("mean", F.col("next.mean")).drop("next")
    each = each.join(F.broadcast(scatter.select(F.col("band").alias("next_band"), "scatter")), "next_band")  # one row a band
    each = each.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    m = F.col("mean") + F.col("scatter") * normal_draw(F.col("obj_id"), F.col("next_band"), F.col("draw"), F.lit(seed))
    return appended(each.withColumn("__m", m), F.col("next_band"), F.lit(horizon + step), F.col("__m")).drop("__m")


def set_value(before: DataFrame, after: DataFrame, size: str = "size") -> DataFrame:
    """obj_id, band, set_before, mean_set, delta_s, p_singleton, best: from set sizes before (one row an object) and after each draw.

    delta_s is how much smaller the set gets on average. best marks the band with the largest delta_s, if that is above 0; of two equal ones g.
    """
    each = after.groupBy("obj_id", "next_band").agg(F.avg(size).alias("mean_set"), F.avg((F.col(size) == 1).cast("double")).alias("p_singleton"))
    out = each.join(before.select("obj_id", F.col(size).alias("set_before")), "obj_id").withColumn("delta_s", F.col("set_before") - F.col("mean_set"))
    sums = out.groupBy("obj_id").agg(F.max(F.struct("delta_s", (-F.col("next_band")).alias("b"))).alias("top"))
    best = (F.col("top.b") == -F.col("next_band")) & (F.col("top.delta_s") > 0)
    return out.join(sums, "obj_id").select("obj_id", F.col("next_band").alias("band"), "set_before", "mean_set", "delta_s", "p_singleton", best.alias("best"))
