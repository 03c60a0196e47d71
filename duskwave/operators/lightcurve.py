"""Operators on detection tables: (obj_id, mjd, fid, mag, magerr), one row per detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import photometry as ph


def per_object():
    return Window.partitionBy("obj_id")


def per_band():
    return Window.partitionBy("obj_id", "band")


def valid_detections(det: DataFrame, min_snr: float | None = 3.0) -> DataFrame:
    return det.where(ph.valid_detection(F.col("mag"), F.col("magerr"), min_snr))


def observation_fault(days: Column, band: Column, logflux: Column, error: Column) -> Column:
    """Why an observation can't be used, or NULL: numbers must be there and finite, errors not negative, bands 0 to 2."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return (
        F.when(odd(days.cast("double")) | odd(logflux) | odd(error), "times, logflux and errors must be finite").when(error < 0, "errors must not be negative")
        .when(band.isNull() | ~band.isin(0, 1, 2), "band must be 0, 1 or 2")
    )


def strictly_valid(phot: DataFrame, days: float = 100) -> DataFrame:
    """The rows of the first `days` days, or an error if one of them is faulty, whatever columns are asked for.

    The check is part of a filter, which no optimiser may leave out; later rows are not looked at. An empty prefix is no error.
    """
    if not 0 < days <= 100:
        raise ValueError("a horizon lies in (0, 100] days")
    early = F.col("dt").isNull() | F.isnan("dt") | F.col("dt").between(0, days)
    fault = observation_fault(F.col("dt"), F.col("band"), F.col("logflux"), F.col("logflux_err"))
    sound = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("object "), F.coalesce(F.col("obj_id").cast("string"), F.lit("NULL")), F.lit(": "), fault))).otherwise(F.lit(True))
    return phot.where(F.when(early, sound.cast("boolean")).otherwise(F.lit(False)))


def photometry(det: DataFrame) -> DataFrame:
    """Adds band (fid - 1), dt since the object's first row, flux, logflux and their errors."""
    return det.select(
        "obj_id", "mjd", "fid", (F.col("fid") - 1).alias("band"), "mag", "magerr", (F.col("mjd") - F.min("mjd").over(per_object())).alias("dt"),
        ph.flux(F.col("mag")).alias("flux"), ph.logflux(F.col("mag")).alias("logflux"),
        ph.logflux_error(F.col("magerr")).alias("logflux_err"), ph.flux_error(F.col("mag"), F.col("magerr")).alias("flux_err"),
    )


def horizon_truncate(phot: DataFrame, days: float) -> DataFrame:
    """Rows up to `days` after the object's first one, inclusive."""
    if not 0 < days <= 100:
        raise ValueError("a horizon lies in (0, 100] days")
    return phot.where(F.col("dt") <= days)


def prefix(det: DataFrame, days: float = 20, min_snr: float | None = 3.0) -> DataFrame:
    """Valid detections of the first days: whatever is derived from these can't look ahead."""
    return horizon_truncate(photometry(valid_detections(det, min_snr)), days)


def since_previous(phot: DataFrame) -> DataFrame:
    order = per_object().orderBy("mjd", "band", "mag", "magerr")
    return phot.withColumn("dt_prev", F.coalesce(F.col("mjd") - F.lag("mjd").over(order), F.lit(0.0)))


def dedupe_same_time(phot: DataFrame) -> DataFrame:
    """Of rows of one object, band and time the one with the smallest magnitude, then error."""
    first = Window.partitionBy("obj_id", "band", "mjd").orderBy("mag", "magerr")
    return phot.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def quality(phot: DataFrame, total: int = 8, g: int = 2, r: int = 2, i: int = 0, bands: int = 2) -> DataFrame:
    """One row per object: counts (before same-time duplicates go) and passes."""
    n = phot.groupBy("obj_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("band") == b).alias(f"n_{x}") for b, x in enumerate("gri")))
    seen = sum(((F.col(f"n_{x}") > 0).cast("int") for x in "gri"), F.lit(0))
    return n.withColumn("passes", (F.col("n") >= total) & (F.col("n_g") >= g) & (F.col("n_r") >= r) & (F.col("n_i") >= i) & (seen >= bands))


def quality_cut(phot: DataFrame, total: int = 8, g: int = 2, r: int = 2, i: int = 0, bands: int = 2) -> DataFrame:
    """Rows of the objects that pass quality(). Counts by windows: rows are dealt by object already, so nothing is read or moved again."""
    w = per_object()
    n = {f"__n_{x}": F.count_if(F.col("band") == b).over(w) for b, x in enumerate("gri")}
    rows = phot.withColumns(n | {"__n": F.count("*").over(w)})
    seen = sum(((F.col(x) > 0).cast("int") for x in n), F.lit(0))
    passes = (F.col("__n") >= total) & (F.col("__n_g") >= g) & (F.col("__n_r") >= r) & (F.col("__n_i") >= i) & (seen >= bands)
    return rows.where(passes).drop("__n", *n)


def nearest_time_pairs(phot: DataFrame, first: int = 0, second: int = 1, days: float = 1.5) -> DataFrame:
    """Colour first - second: every row of either band with the nearest row of the other one within `days`, inclusive.

    Ties go to the earlier partner, then the brighter one. Both directions emit rows. The nearest partner is the last one before or the
    first one after a row, so two running windows over the object find it: no join, and no move of rows that are dealt by object already.
    """
    rows = phot.where(F.col("band").isin(first, second)).select("obj_id", "mjd", "dt", "band", "logflux", "logflux_err", "mag", "magerr")
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("obj_id", "band", "mjd").orderBy("mag", "magerr")))
    ways = {"before": per_object().orderBy("mjd"), "after": per_object().orderBy(F.desc("mjd"))}
    me = F.struct("mjd", "dt", "logflux", "logflux_err")
    near = {f"__{way}_{b}": F.last(F.when((F.col("band") == b) & (F.col("__n") == 1), me), ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)) for way, w in ways.items() for b in (first, second)}
    rows = rows.withColumns(near)
    for way in ways:
        rows = rows.withColumn(way, F.when(F.col("band") == first, F.col(f"__{way}_{second}")).otherwise(F.col(f"__{way}_{first}")))
    gap = lambda way: F.abs(F.col("mjd") - F.col(f"{way}.mjd"))
    rows = rows.withColumn("o", F.when(F.col("after").isNull() | (gap("before") <= gap("after")), F.col("before")).otherwise(F.col("after")))
    rows = rows.where(F.abs(F.col("mjd") - F.col("o.mjd")) <= days)
    sign = F.when(F.col("band") == first, 1.0).otherwise(-1.0)
    return rows.select("obj_id", "mjd", "dt", "band", F.col("o.dt").alias("partner_dt"), (sign * -2.5 * (F.col("logflux") - F.col("o.logflux"))).alias("colour"), (2.5 * F.hypot(F.col("logflux_err"), F.col("o.logflux_err"))).alias("colour_err"))


def colour_stats(pairs: DataFrame) -> DataFrame:
    """Per object: n, mean, weighted mean, population std (NULL if n = 1), slope (n > 2), early, late, late - early."""
    w = 1 / F.pow(F.greatest("colour_err", F.lit(1e-6)), F.lit(2.0))
    halves = pairs.withColumn("half", F.min("dt").over(per_object()) + (F.max("dt").over(per_object()) - F.min("dt").over(per_object())) / 2)
    out = halves.groupBy("obj_id").agg(
        F.count("*").alias("n"), F.avg("colour").alias("mean"), (F.sum(w * F.col("colour")) / F.sum(w)).alias("wmean"),
        F.when(F.count("*") > 1, F.stddev_pop("colour")).alias("std"),
        F.when((F.count("*") > 2) & (F.max("dt") > F.min("dt")), F.regr_slope("colour", "dt")).alias("slope"),
        F.avg(F.when(F.col("dt") <= F.col("half"), F.col("colour"))).alias("early"), F.avg(F.when(F.col("dt") > F.col("half"), F.col("colour"))).alias("late"),
    )
    return out.withColumn("late_minus_early", F.col("late") - F.col("early"))


def cumulative_trapezoid(df: DataFrame, by: list[Column | str], order: list[Column | str], x: str, y: str, name: str) -> DataFrame:
    """df with the integral of y over x from the first row of its group up to each row, by the trapezoid rule."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = F.coalesce((F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w)), F.lit(0.0))
    return df.withColumn(name, step).withColumn(name, F.sum(name).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def leakage(phot: DataFrame, days: float) -> DataFrame:
    """Pairs of the full curve that a cut at `days` would not have had: per object, how many partners lie after it."""
    ahead = nearest_time_pairs(phot).where((F.col("dt") <= days) & (F.col("partner_dt") > days))
    return ahead.groupBy("obj_id").agg(F.count("*").alias("n_leaked"))


CADENCE = ("n_obs", "span", "gap_median", "gap_max", "snr_mean")
PEAK = ("t_peak", "logflux_peak", "logflux_last_minus_peak", "frac_obs_before_peak")


def band_cadence(bands: DataFrame) -> DataFrame:
    return band_features(bands).select("obj_id", "band", *CADENCE)


def band_peak(bands: DataFrame) -> DataFrame:
    """First maximum of the flux; the share of rows before it; the fall from it to the last row."""
    return band_features(bands).select("obj_id", "band", *PEAK)


def band_statistics(bands: DataFrame, min_n: int = 4) -> DataFrame:
    """The light-curve statistics of every (object, band) with at least min_n rows."""
    f = band_features(bands, min_n)
    return f.where(F.col("n_obs") >= min_n).drop(*CADENCE, *PEAK, "anderson_darling_normal")


def anderson_darling(bands: DataFrame, min_n: int = 4) -> DataFrame:
    f = band_features(bands, min_n)
    return f.where((F.col("n_obs") >= min_n) & F.col("anderson_darling_normal").isNotNull()).select("obj_id", "band", "anderson_darling_normal")


def global_cadence(phot: DataFrame) -> DataFrame:
    return phot.groupBy("obj_id").agg(F.count("*").alias("n_obs_total"), F.count_distinct("band").alias("n_bands"), F.max("dt").alias("span_total"))


def cross_band_peak(bands: DataFrame) -> DataFrame:
    """g minus r: peak times, peak brightness, counts; NULL unless both bands are there. One aggregation and one pivot."""
    both = band_features(bands).where(F.col("band") < 2).groupBy("obj_id").pivot("band", [0, 1]).agg(F.first("t_peak").alias("t"), F.first("logflux_peak").alias("f"), F.first("n_obs").alias("n"))
    return both.select("obj_id", (F.col("0_t") - F.col("1_t")).alias("gr_peak_dt"), (F.col("0_f") - F.col("1_f")).alias("gr_peak_logflux_ratio"), (F.col("0_n") / F.greatest("1_n", F.lit(1))).alias("gr_n_ratio"))


def over(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero: a curve without spread has no such statistic."""
    return F.try_divide(a, b)


QUANTILES = (0.05, 0.1, 0.2, 0.25, 0.4, 0.6, 0.75, 0.8, 0.9, 0.95)


def normal_cdf(z: Column) -> Column:
    """Phi by the rational approximation of Abramowitz and Stegun 26.2.17."""
    t = 1 / (1 + F.lit(0.2316419) * F.abs(z))
    tail = F.exp(-z * z / 2) / F.lit(2.5066282746310002) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def band_features(bands: DataFrame, min_n: int = 4) -> DataFrame:
    """Everything there is to say about one band of one object, in one aggregation: cadence, peak, and (NULL below min_n rows) statistics.

    Windows over (obj_id, band) attach moments, differences and ranks; the aggregation has the same grouping, so after the rows are dealt by object
    nothing moves again. Whoever selects a few columns pays for these only. m is logflux, d its error, s the sample deviation.
    """
    w, t = per_band(), per_band().orderBy("mjd")
    upto = t.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = F.col
    x = bands.select("obj_id", "band", c("dt").alias("t"), "mjd", "flux", c("logflux").alias("m"), c("logflux_err").alias("d"))
    x = x.withColumns(
        {
            "n": F.count("*").over(w), "mu": F.avg("m").over(w), "s": F.stddev_samp("m").over(w), "med": F.median("m").over(w), "mx": F.max("m").over(w), "mn": F.min("m").over(w),
            "wm": F.sum(c("m") / (c("d") * c("d"))).over(w) / F.sum(1 / (c("d") * c("d"))).over(w), "dm": c("m") - F.lag("m").over(t), "dtm": c("t") - F.lag("t").over(t), "gap": c("mjd") - F.lag("mjd").over(t),
            "peak": F.max(F.struct("flux", (-c("t")).alias("t"), "m")).over(w), "last": F.max(F.struct("t", "m")).over(w), "i": F.row_number().over(per_band().orderBy("m", "mjd")),
        }
    )
    # too little spread for anything that divides by it
    x = x.withColumn("s", F.when(c("s") > 1e-12, c("s")))
    x = x.withColumns({"z": (c("m") - c("mu")) / c("s"), "cum": F.sum((c("m") - c("mu")) / (c("n") * c("s"))).over(upto), "r": (c("m") - c("wm")) / c("d"), "e": c("m") - c("mu"), "wt": 1 / (c("d") * c("d"))})
    x = x.withColumn("f", ph.clip(normal_cdf(c("z")), 1e-12, 1 - 1e-12))
    n, s, mu, med = F.first("n"), F.first("s"), F.first("mu"), F.first("med")
    swt, swtt, sw, swm, swtm = F.sum(c("wt") * c("t")), F.sum(c("wt") * c("t") * c("t")), F.sum("wt"), F.sum(c("wt") * c("m")), F.sum(c("wt") * c("t") * c("m"))
    det = sw * swtt - swt * swt
    slope = over(sw * swtm - swt * swm, det)
    m2, m3, m4 = F.avg(F.pow(c("e"), F.lit(2.0))), F.avg(F.pow(c("e"), F.lit(3.0))), F.avg(F.pow(c("e"), F.lit(4.0)))
    all_q = F.percentile("m", F.array(*map(F.lit, QUANTILES)))
    q = lambda v: all_q[QUANTILES.index(v)]
    sxx, rest = F.regr_sxx("m", "t"), F.greatest(F.lit(0.0), F.regr_syy("m", "t") - over(F.pow(F.regr_sxy("m", "t"), F.lit(2.0)), F.regr_sxx("m", "t")))
    a2 = -n - F.sum((2 * c("i") - 1) * F.ln("f") + (2 * (c("n") - c("i")) + 1) * F.ln(1 - c("f"))) / n
    statistics = {
        "amplitude": (F.first("mx") - F.first("mn")) / 2,
        "beyond_1_std": F.avg((F.abs("z") > 1).cast("double")), "beyond_2_std": F.avg((F.abs("z") > 2).cast("double")),
        "cusum": F.max("cum") - F.min("cum"),
        "eta_e": F.pow(F.max("t") - F.min("t"), F.lit(2.0)) / F.pow(n - 1, F.lit(3.0)) * F.sum(F.pow(c("dm") / c("dtm"), F.lit(2.0))) / (s * s),
        "excess_variance": (s * s - F.avg(c("d") * c("d"))) / F.nullif(mu * mu, F.lit(0.0)),
        "inter_percentile_range_10": q(0.9) - q(0.1), "inter_percentile_range_25": q(0.75) - q(0.25),
        "kurtosis": F.when((n > 3) & (m2 > 1e-24), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * m4 / (m2 * m2) - 3 * (n - 1))),
        "skew": F.when((n > 2) & (m2 > 1e-24), F.sqrt(n * (n - 1.0)) / (n - 2) * m3 / F.pow(m2, F.lit(1.5))),
        "linear_fit_slope": slope, "linear_fit_slope_sigma": F.sqrt(over(sw, det)),
        "linear_fit_reduced_chi2": (F.sum(c("wt") * c("m") * c("m")) - slope * swtm - (swm - slope * swt) / sw * swm) / (n - 2),
        "linear_trend": F.regr_slope("m", "t"), "linear_trend_sigma": F.sqrt(rest / (n - 2) / F.nullif(sxx, F.lit(0.0))), "linear_trend_noise": F.sqrt(rest / (n - 2)),
        "magnitude_percentage_ratio_40_5": over(q(0.6) - q(0.4), q(0.95) - q(0.05)), "magnitude_percentage_ratio_20_10": over(q(0.8) - q(0.2), q(0.9) - q(0.1)),
        "maximum_slope": F.max(F.abs(c("dm") / c("dtm"))), "mean": mu, "weighted_mean": F.first("wm"), "mean_variance": over(s, mu),
        "median_absolute_deviation": F.median(F.abs(c("m") - c("med"))),
        "median_buffer_range_10": F.avg((F.abs(c("m") - c("med")) < 0.10 * (c("mx") - c("mn")) / 2).cast("double")),
        "percent_amplitude": F.greatest(F.first("mx") - med, med - F.first("mn")), "percent_difference_magnitude_percentile_5": over(q(0.95) - q(0.05), med),
        "chi2": F.sum(c("r") * c("r")) / (n - 1), "standard_deviation": s, "stetson_k": over(F.sum(F.abs("r")), F.sqrt(n * F.sum(c("r") * c("r")))),
        "anderson_darling_normal": a2 * (1 + 4.0 / n - 25.0 / (n * n)),
    }
    return x.groupBy("obj_id", "band").agg(
        F.count("*").alias("n_obs"), (F.max("mjd") - F.min("mjd")).alias("span"), F.median("gap").alias("gap_median"), F.max("gap").alias("gap_max"), F.avg(F.lit(ph.LOG_CONST) / F.greatest("d", F.lit(1e-6))).alias("snr_mean"),
        (-F.first("peak")["t"]).alias("t_peak"), F.first("peak")["m"].alias("logflux_peak"), (F.first("last")["m"] - F.first("peak")["m"]).alias("logflux_last_minus_peak"), F.avg((c("t") < -c("peak.t")).cast("double")).alias("frac_obs_before_peak"),
        *(F.when(n >= min_n, v).alias(k) for k, v in statistics.items()),
    )


#: Grids of the explosion-model fit, in days.
BAZIN_RISE, BAZIN_FALL, BAZIN_STEPS = (1.0, 2.0, 4.0, 8.0), (4.0, 8.0, 16.0, 32.0, 64.0), 9


def bazin_grid_fit(bands: DataFrame, min_n: int = 6) -> DataFrame:
    """flux = A exp(-(t - t0)/fall) / (1 + exp(-(t - t0)/rise)) + B, least squares over a grid of (t0, rise, fall).

    A and B have a closed form for each grid point, so the fit is one expansion of the rows by a fixed grid, one sum per grid
    point and one minimum: 180 rows for each detection before the map-side sums.
    """
    x = bands.select("obj_id", "band", "dt", "flux", "flux_err", F.count("*").over(per_band()).alias("n"), F.min("dt").over(per_band()).alias("t1"), F.max("dt").over(per_band()).alias("t2")).where(F.col("n") >= min_n)
    shapes = F.array(*(F.struct(F.lit(r).alias("rise"), F.lit(f).alias("fall")) for r in BAZIN_RISE for f in BAZIN_FALL if f > r))
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(BAZIN_STEPS - 1))).alias("i")).withColumn("t0", F.col("t1") + (F.col("t2") - F.col("t1")) * F.col("i") / (BAZIN_STEPS - 1))
    x = x.select("*", F.explode(shapes).alias("g"))
    u = F.col("dt") - F.col("t0")
    x = x.withColumn("h", F.exp(-u / F.col("g.fall")) / (1 + F.exp(-u / F.col("g.rise")))).withColumn("w", 1 / (F.col("flux_err") * F.col("flux_err")))
    s = lambda c: F.sum(F.col("w") * c)
    h, y = F.col("h"), F.col("flux")
    fit = x.groupBy("obj_id", "band", "t0", "g.rise", "g.fall").agg(F.first("n").alias("n"), F.sum("w").alias("s0"), s(h).alias("sh"), s(h * h).alias("shh"), s(y).alias("sy"), s(h * y).alias("shy"), s(y * y).alias("syy"))
    fit = fit.withColumn("det", F.col("s0") * F.col("shh") - F.col("sh") * F.col("sh")).where(F.col("det") > 1e-9 * F.col("s0") * F.col("shh"))
    fit = fit.withColumn("a", (F.col("s0") * F.col("shy") - F.col("sh") * F.col("sy")) / F.col("det")).withColumn("b", (F.col("sy") - F.col("a") * F.col("sh")) / F.col("s0"))
    fit = fit.withColumn("chi2", (F.col("syy") - F.col("a") * F.col("shy") - F.col("b") * F.col("sy")) / F.greatest(F.col("n") - 5, F.lit(1)))
    best = F.min(F.struct(F.round("chi2", 6).alias("k"), "t0", "rise", "fall", "a", "b", "chi2"))
    out = fit.where("a > 0").groupBy("obj_id", "band").agg(best.alias("f"))
    return out.select("obj_id", "band", F.col("f.a").alias("amplitude"), F.col("f.b").alias("baseline"), F.col("f.t0").alias("reference_time"), F.col("f.rise").alias("rise_time"), F.col("f.fall").alias("fall_time"), F.col("f.chi2").alias("reduced_chi2"), (F.col("f.fall") / F.col("f.rise")).alias("fall_over_rise"))


def by_band(part: DataFrame, prefix: str = "") -> DataFrame:
    """One row per object of a table with one row per (object, band): columns g_x, r_x, i_x."""
    names = [c for c in part.columns if c not in ("obj_id", "band")]
    rows = part.groupBy("obj_id").agg(*(F.max(F.when(F.col("band") == b, F.struct(*names))).alias(letter) for b, letter in enumerate("gri")))
    return rows.select("obj_id", *(F.col(f"{letter}.{c}").alias(f"{letter}_{prefix}{c}") for letter in "gri" for c in names))


def assemble_features(phot: DataFrame) -> DataFrame:
    """The wide feature table: global, per-band, colour and cross-band columns, NULL where there is too little data.

    Every part is dealt by object from the first window on and has one row per object when it is joined. phot is read once for each part, so
    it should be a stored table.
    """
    bands = dedupe_same_time(phot)
    out = global_cadence(phot).join(by_band(band_features(bands)), "obj_id", "left").join(by_band(bazin_grid_fit(bands), "bazin_"), "obj_id", "left")
    for name, (a, b) in {"g_r": (0, 1), "r_i": (1, 2)}.items():
        c = colour_stats(nearest_time_pairs(phot, a, b))
        out = out.join(c.withColumnsRenamed({x: f"{name}_{x}" for x in c.columns if x != "obj_id"}), "obj_id", "left")
    both = lambda c: F.col(f"g_{c}") - F.col(f"r_{c}")
    return out.withColumns({"gr_peak_dt": both("t_peak"), "gr_peak_logflux_ratio": both("logflux_peak"), "gr_n_ratio": F.col("g_n_obs") / F.greatest("r_n_obs", F.lit(1))})
