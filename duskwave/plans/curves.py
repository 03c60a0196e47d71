"""Queries on detections: units, quality, pairing and features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import photometry as ph
from ..operators import lightcurve as lc
from ..sources import adapters as src
from ..sources import io
from .base import query, r6


def _phot(spark, d):
    return lc.photometry(lc.valid_detections(src.detections(spark, d)))


def _pre(spark, d, days=20):
    return lc.horizon_truncate(_phot(spark, d), days)


def _bands(spark, d):
    return lc.dedupe_same_time(_pre(spark, d))


def _r(df, *keep):
    """df with its doubles at six digits."""
    return df.select(*(r6(c).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint", "long") else F.col(c) for c, t in df.dtypes))


@query("scan_detections", "select obj_id::bigint as obj_id, round(dt, 6) + 0.0 as dt, band::bigint as band, round(mag, 6) + 0.0 as mag, round(magerr, 6) + 0.0 as magerr from pre")
def scan_detections(spark, d):
    return _r(_pre(spark, d).select("obj_id", "dt", "band", "mag", "magerr"))


@query("mag_to_logflux", "select obj_id, round(mjd, 6) + 0.0 as mjd, round(flux, 6) + 0.0 as flux, round(logflux, 6) + 0.0 as logflux from phot")
def mag_to_logflux(spark, d):
    return _r(_phot(spark, d).select("obj_id", "mjd", "flux", "logflux"))


@query("magerr_to_logerr", "select obj_id, round(mjd, 6) + 0.0 as mjd, round(flux_err, 6) + 0.0 as flux_err, round(logflux_err, 6) + 0.0 as logflux_err from phot")
def magerr_to_logerr(spark, d):
    return _r(_phot(spark, d).select("obj_id", "mjd", "flux_err", "logflux_err"))


@query("logflux_to_flux", "select obj_id, round(mjd, 6) + 0.0 as mjd, round(pow(10::double, logflux), 6) + 0.0 as flux, round(logflux_err * pow(10::double, logflux) * ln(10::double), 6) + 0.0 as flux_err from phot")
def logflux_to_flux(spark, d):
    p = _phot(spark, d)
    return _r(p.select("obj_id", "mjd", ph.flux_from_log(F.col("logflux")).alias("flux"), ph.flux_error_from_log(F.col("logflux"), F.col("logflux_err")).alias("flux_err")))


@query("since_first", "select obj_id, round(mjd, 6) + 0.0 as mjd, round(dt, 6) + 0.0 as dt from phot")
def since_first(spark, d):
    return _r(_phot(spark, d).select("obj_id", "mjd", "dt"))


@query("since_previous", "select obj_id, round(mjd, 6) + 0.0 as mjd, round(coalesce(mjd - lag(mjd) over (partition by obj_id order by mjd, band, mag, magerr), 0), 6) + 0.0 as dt_prev from phot")
def since_previous(spark, d):
    return _r(lc.since_previous(_phot(spark, d)).select("obj_id", "mjd", "dt_prev"))


@query("band_one_hot", "select obj_id, round(mjd, 6) + 0.0 as mjd, (band = 0)::int::double as band_g, (band = 1)::int::double as band_r, (band = 2)::int::double as band_i from phot")
def band_one_hot(spark, d):
    b = ph.clip(F.col("band"), 0, 2)
    return _phot(spark, d).select("obj_id", r6("mjd").alias("mjd"), *((b == k).cast("double").alias(f"band_{x}") for k, x in enumerate("gri")))


@query(
    "fluxcal_rescale",
    """f as (select obj_id, mjd, fid, pow(10::double, -0.4::double * (mag - 27.5::double)) * pow(10::double, -0.4::double * 3.6::double) as flux, pow(10::double, -0.4::double * (mag - 27.5::double)) * pow(10::double, -0.4::double * 3.6::double) * magerr as err, magerr < 0.3 as detected from det where mag is not null)
select obj_id, fid, round(mjd - min(mjd) filter (where detected) over (partition by obj_id), 6) + 0.0 as dt, round(flux, 6) + 0.0 as flux from f where flux > 0 and err > 0 and flux / err >= 3""",
)
def fluxcal_rescale(spark, d):
    """Survey fluxes at zero point 27.5 to 23.9; the clock starts at the first detected epoch."""
    factor = 10 ** (-0.4 * 3.6)
    f = src.detections(spark, d).where("mag is not null").withColumn("flux", ph.flux(F.col("mag"), 27.5) * factor).withColumn("err", F.col("flux") * F.col("magerr"))
    f = f.where((F.col("flux") > 0) & (F.col("err") > 0) & (F.col("flux") / F.col("err") >= 3))
    start = F.min(F.when(F.col("magerr") < 0.3, F.col("mjd"))).over(lc.per_object())
    return f.select("obj_id", "fid", r6(F.col("mjd") - start).alias("dt"), r6("flux").alias("flux"))


@query("photometry_snr", "select obj_id, band, count(*) as n, round(avg(1.0857::double / magerr), 6) + 0.0 as snr, round(avg((1 / ln(10::double)) / greatest(logflux_err, 1e-6)), 6) + 0.0 as snr_mean from phot group by obj_id, band")
def photometry_snr(spark, d):
    return _r(_phot(spark, d).groupBy("obj_id", "band").agg(F.count("*").alias("n"), F.avg(ph.snr(F.col("magerr"))).alias("snr"), F.avg(F.lit(ph.LOG_CONST) / F.greatest("logflux_err", F.lit(1e-6))).alias("snr_mean"))).withColumn("band", F.col("band").cast("int"))


_SEX = "case when p_partkey % 2 = 0 then '-' else '' end || (p_partkey % 60) || ':' || (p_partkey % 59) || ':' || (p_partkey % 58) || '.5'"


@query("sexagesimal_to_degrees", f"select p_partkey, {_SEX} as text, round(15 * (case when p_partkey % 2 = 0 then -1 else 1 end) * (p_partkey % 60 + (p_partkey % 59) / 60.0::double + (p_partkey % 58 + 0.5::double) / 3600.0::double), 6) + 0.0 as ra, round(p_size::double, 6) + 0.0 as plain from part")
def sexagesimal_to_degrees(spark, d):
    p = src.table(spark, d, "part").withColumn("text", F.expr(_SEX))
    return p.select("p_partkey", "text", r6(ph.degrees(F.col("text"), True)).alias("ra"), r6(ph.degrees(F.col("p_size").cast("string"), True)).alias("plain"))


@query("angular_separation", "select src_id, obj_id, round(3600::double * sqrt(pow((c.ra - p.ra) * cos(radians(p.decl)), 2) + pow(c.decl - p.decl, 2)), 6) + 0.0 as sep from cat c join pos p on c.src_id % 97 = p.obj_id")
def angular_separation(spark, d):
    c, p = src.catalogue(spark, d), src.positions(spark, d).toDF("obj_id", "ra0", "dec0")
    both = c.join(p, F.col("src_id") % 97 == F.col("obj_id"))
    return both.select("src_id", "obj_id", r6(ph.separation(F.col("ra0"), F.col("dec0"), F.col("ra"), F.col("decl"))).alias("sep"))


_GRID = 512
_LUM = f"""grid as (select i, 5.0::double * i / {_GRID} as z, 1 / sqrt(0.3::double * pow(1 + 5.0::double * i / {_GRID}, 3) + 0.7::double) as e from (select unnest(generate_series(0, {_GRID})) as i)),
cum as (select i, z, 299792.458::double / 70 * sum(coalesce((e + pe) / 2 * (z - pz), 0)) over (order by i) as c from (select *, lag(e) over (order by i) as pe, lag(z) over (order by i) as pz from grid)),
seg as (select z as z0, c as c0, lead(z) over (order by i) as z1, lead(c) over (order by i) as c1 from cum),
q as (select p_partkey, p_size * 0.11::double - 0.2::double as z, 14 + p_size * 0.15::double as peak from part),
lum as (select p_partkey, q.z, peak, case when q.z > 0 and q.z < 5 then (1 + q.z) * (c0 + (c1 - c0) * (q.z - z0) / (z1 - z0)) end as d_mpc from q left join seg on q.z >= z0 and q.z < z1 and q.z > 0)"""


def luminosity_knots(spark):
    """z and comoving distance on a fixed grid to z = 5 (a few hundred rows whatever the input), by the trapezoid rule."""
    z = spark.range(_GRID + 1).select(F.col("id").alias("i"), (F.lit(5.0) * F.col("id") / _GRID).alias("z"))
    z = z.withColumn("e", 1 / F.sqrt(F.lit(ph.OMEGA_M) * F.pow(1 + F.col("z"), F.lit(3.0)) + F.lit(1 - ph.OMEGA_M)))
    z = lc.cumulative_trapezoid(z, [F.lit(0)], ["i"], "z", "e", "c").withColumn("c", F.lit(ph.CLIGHT / ph.H0) * F.col("c"))
    order = Window.partitionBy(F.lit(0)).orderBy("i")
    return z.select("i", F.col("z").alias("z0"), F.col("c").alias("c0"), F.lead("z").over(order).alias("z1"), F.lead("c").over(order).alias("c1"))


def with_distance(df, spark):
    """Adds d_mpc for a redshift column z: the knot below is an equality on the grid index, so the lookup is a plain broadcast join."""
    knots = F.broadcast(luminosity_knots(spark))
    at = F.when((F.col("z") > 0) & (F.col("z") < 5), F.floor(F.col("z") * _GRID / 5.0))
    d = (1 + F.col("z")) * (F.col("c0") + (F.col("c1") - F.col("c0")) * (F.col("z") - F.col("z0")) / (F.col("z1") - F.col("z0")))
    return df.withColumn("at", at).join(knots, F.col("at") == F.col("i"), "left").withColumn("d_mpc", d).drop("at", "i", "z0", "c0", "z1", "c1")


def _redshifts(spark, d):
    return src.table(spark, d, "part").select("p_partkey", (F.col("p_size") * F.lit(0.11) - F.lit(0.2)).alias("z"), (14 + F.col("p_size") * F.lit(0.15)).alias("peak"))


@query("luminosity_distance", f"{_LUM} select p_partkey, round(z, 6) + 0.0 as z, round(d_mpc, 5) + 0.0 as d_mpc from lum")
def luminosity_distance(spark, d):
    return with_distance(_redshifts(spark, d), spark).select("p_partkey", r6("z").alias("z"), (F.round("d_mpc", 5) + F.lit(0.0)).alias("d_mpc"))


@query("pseudo_absolute_magnitude", f"{_LUM} select p_partkey, round(peak - 5 * log10(d_mpc * 1e5), 6) + 0.0 as m_pseudo from lum")
def pseudo_absolute_magnitude(spark, d):
    return with_distance(_redshifts(spark, d), spark).select("p_partkey", r6(ph.absolute_magnitude(F.col("peak"), F.col("d_mpc"))).alias("m_pseudo"))


@query("cumulative_trapezoid", "t as (select obj_id, band, mjd, mag, magerr, coalesce((flux + lag(flux) over w) / 2 * (mjd - lag(mjd) over w), 0) as step from phot window w as (partition by obj_id, band order by mjd, mag, magerr)) select obj_id, band, round(mjd, 6) + 0.0 as mjd, round(sum(step) over (partition by obj_id, band order by mjd, mag, magerr rows unbounded preceding), 5) + 0.0 as fluence from t")
def cumulative_trapezoid(spark, d):
    """The light collected so far at each detection of a band."""
    f = lc.cumulative_trapezoid(_phot(spark, d), ["obj_id", "band"], ["mjd", "mag", "magerr"], "mjd", "flux", "fluence")
    return f.select("obj_id", "band", r6("mjd").alias("mjd"), (F.round("fluence", 5) + F.lit(0.0)).alias("fluence"))


@query("astrometry_features", "select p_partkey, round(case when p_size % 5 > 0 then p_retailprice / 1000 / (p_size % 5) end, 6) + 0.0 as parallax_over_error, round(sqrt(pow((p_partkey % 13 - 6)::double, 2) + pow((p_partkey % 7 - 3)::double, 2)), 6) + 0.0 as pm, round(case when p_size % 5 > 0 then sqrt(pow((p_partkey % 13 - 6)::double, 2) + pow((p_partkey % 7 - 3)::double, 2)) / (p_size % 5) end, 6) + 0.0 as pm_over_error from part")
def astrometry_features(spark, d):
    p = src.table(spark, d, "part")
    pm = F.hypot((F.col("p_partkey") % 13 - 6).cast("double"), (F.col("p_partkey") % 7 - 3).cast("double"))
    err = F.col("p_size") % 5
    return p.select("p_partkey", r6(ph.over(F.col("p_retailprice") / 1000, err)).alias("parallax_over_error"), r6(pm).alias("pm"), r6(ph.over(pm, err)).alias("pm_over_error"))


_MAGS = "case when p_partkey % {k} <> 0 then 15 + (p_partkey * {k}) % 50 / 10.0::double end"
_M = [_MAGS.format(k=k) for k in (7, 11, 13)]


@query("infrared_colours", f"select p_partkey, round({_M[0]} - {_M[1]}, 6) + 0.0 as w1w2, round({_M[1]} - {_M[2]}, 6) + 0.0 as w2w3 from part")
def infrared_colours(spark, d):
    w = [F.when(F.col("p_partkey") % k != 0, 15 + F.col("p_partkey") * k % 50 / F.lit(10.0)) for k in (7, 11, 13)]
    return src.table(spark, d, "part").select("p_partkey", r6(w[0] - w[1]).alias("w1w2"), r6(w[1] - w[2]).alias("w2w3"))


@query("counterpart_features", "select src_id, case when r_kron <> -999 then (ext < 0.05)::int end as star, round(case when r_kron <> -999 then r_kron end - 18, 6) + 0.0 as r_i, n_det from cat")
def counterpart_features(spark, d):
    kron = ph.null_if(F.col("r_kron"), -999.0, -99.0)
    return src.catalogue(spark, d).select("src_id", F.when(kron.isNotNull(), (F.col("ext") < 0.05).cast("int")).alias("star"), r6(kron - 18).alias("r_i"), "n_det")


@query("sentinel_to_null", "select src_id, round(case when r_kron not in (-999, -99) then r_kron end, 6) + 0.0 as r_kron from cat")
def sentinel_to_null(spark, d):
    return src.catalogue(spark, d).select("src_id", r6(ph.null_if(F.col("r_kron"), -999.0, -99.0)).alias("r_kron"))


#: Fine labels of the stand-in taxonomy: class, broad group, role.
TAXONOMY = {"ECONOMY": ("SN_Ia", "SN", "train"), "STANDARD": ("SN_CC", "SN", "train"), "PROMO": ("SLSN", "SN", "train"), "SMALL": ("AGN", "nuclear", "train"), "MEDIUM": ("TDE", "nuclear", "train"), "LARGE": (None, "SN", "ambiguous")}
_TAX = ", ".join(f"('{k}', {'null' if c is None else repr(c)}, '{b}', '{r}')" for k, (c, b, r) in TAXONOMY.items())


@query("taxonomy_map", f"tax as (select * from (values {_TAX}) t(fine, cls, broad, role)) select p_partkey, split_part(p_type, ' ', 1) as fine, cls, broad, coalesce(role, 'novel') as role from part left join tax on tax.fine = split_part(p_type, ' ', 1)")
def taxonomy_map(spark, d):
    tax = spark.createDataFrame([(k, *v) for k, v in TAXONOMY.items()], "fine string, cls string, broad string, role string")
    p = src.table(spark, d, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("fine"))
    return p.join(F.broadcast(tax), "fine", "left").select("p_partkey", "fine", "cls", "broad", F.coalesce("role", F.lit("novel")).alias("role"))


@query("label_consensus", "select user_id as obj_id, min(event_type) as label, count(*) as n from events group by user_id, cast(floor(value / 200) as int) having count(distinct event_type) = 1")
def label_consensus(spark, d):
    e = src.table(spark, d, "events").groupBy("user_id", F.floor(F.col("value") / 200).alias("batch")).agg(F.min("event_type").alias("label"), F.max("event_type").alias("other"), F.count("*").alias("n"))
    return e.where(F.col("label") == F.col("other")).select(F.col("user_id").alias("obj_id"), "label", "n")


@query("calendar_to_jd", "select o_orderkey, date_part('year', o_orderdate) as year, round(date_diff('day', date '1970-01-01', make_date(date_part('year', o_orderdate), 1, 1)) + 2440587.5::double - 2458000, 6) + 0.0 as jd from orders")
def calendar_to_jd(spark, d):
    year = F.year("o_orderdate")
    return src.table(spark, d, "orders").select("o_orderkey", year.cast("long").alias("year"), r6(ph.jd_from_date(F.make_date(year, F.lit(1), F.lit(1)))).alias("jd"))


@query("append_synthetic_detection", """x as (select obj_id, mjd, band, mag, magerr from pre union all select obj_id, min(mjd) + 25, 1, 18.5::double, 0.1::double from pre group by obj_id)
select obj_id, count(*) as n, round(sum(dp), 6) + 0.0 as sum_prev, round(max(dp), 6) + 0.0 as max_prev from (select *, coalesce(mjd - lag(mjd) over (partition by obj_id order by mjd, band, mag, magerr), 0) as dp from x) group by obj_id""")
def append_synthetic_detection(spark, d):
    pre = _pre(spark, d).select("obj_id", "mjd", "band", "mag", "magerr")
    extra = pre.groupBy("obj_id").agg((F.min("mjd") + 25).alias("mjd")).select("obj_id", "mjd", F.lit(1).alias("band"), F.lit(18.5).alias("mag"), F.lit(0.1).alias("magerr"))
    x = lc.since_previous(pre.unionByName(extra))
    return _r(x.groupBy("obj_id").agg(F.count("*").alias("n"), F.sum("dt_prev").alias("sum_prev"), F.max("dt_prev").alias("max_prev")))


@query("parse_trajectory", "select obj_id, k, round(p, 6) + 0.0 as p from traj")
def parse_trajectory(spark, d):
    """Trajectories as "k,day,model,p;..." strings and back to rows on the schedule."""
    t = src.trajectory(spark, d)
    packed = t.groupBy("obj_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", "k", F.lit(0), F.lit("m"), "p"))), ";").alias("s"))
    row = F.explode(F.split("s", ";")).alias("row")
    return packed.select("obj_id", row).select("obj_id", F.split("row", ",").alias("f")).select("obj_id", F.col("f")[0].cast("long").alias("k"), r6(F.col("f")[3].cast("double")).alias("p")).where("k between 3 and 40 or k % 5 = 0")


@query("valid_detections", "select obj_id, count(*) as n, round(sum(mag), 4) + 0.0 as s from valid group by obj_id")
def valid_detections(spark, d):
    return lc.valid_detections(src.detections(spark, d)).groupBy("obj_id").agg(F.count("*").alias("n"), (F.round(F.sum("mag"), 4) + F.lit(0.0)).alias("s"))


@query("horizon_truncate", "select obj_id, count(*) as n, round(max(dt), 6) + 0.0 as last from phot where dt <= 10 group by obj_id")
def horizon_truncate(spark, d):
    return _pre(spark, d, 10).groupBy("obj_id").agg(F.count("*").alias("n"), r6(F.max("dt")).alias("last"))


@query("validate_observations", "select coalesce(reason, 'good') as reason, count(*) as n from (select case when mag is null then 'not finite' when magerr < 0.03 then 'error too small' when fid not in (1, 2, 3) then 'unknown band' end as reason from det) group by 1")
def validate_observations(spark, d):
    """Good rows and a quarantine with the first reason."""
    det = src.detections(spark, d)
    why = F.when(F.col("mag").isNull() | F.isnan("mag"), "not finite").when(F.col("magerr") < 0.03, "error too small").when(~F.col("fid").isin(1, 2, 3), "unknown band")
    return det.groupBy(F.coalesce(why, F.lit("good")).alias("reason")).agg(F.count("*").alias("n"))


@query("strict_observations", "select obj_id, count(*) as n from phot where dt <= 100 group by obj_id")
def strict_observations(spark, d):
    """Rows of each object up to day 100; a faulty row among them stops the query."""
    return lc.strictly_valid(_phot(spark, d)).groupBy("obj_id").agg(F.count("*").alias("n"))


_QUAL = "qual as (select obj_id, count(*) as n, count(*) filter (where band = 0) as n_g, count(*) filter (where band = 1) as n_r, count(*) filter (where band = 2) as n_i, count(*) >= {n} and count(*) filter (where band = 0) >= {g} and count(*) filter (where band = 1) >= {r} and count(*) filter (where band = 2) >= {i} and count(distinct band) >= 2 as passes from {t} group by obj_id)"


@query("quality_cut", _QUAL.format(n=8, g=2, r=2, i=0, t="(select * from phot where dt <= 10)") + " select * from qual")
def quality_cut(spark, d):
    return lc.quality(_pre(spark, d, 10))


@query("quality_report", _QUAL.format(n=8, g=2, r=2, i=0, t="(select * from phot where dt <= 10)") + " select count(*) as rows_before, count(*) filter (where passes) as rows_after, count(*) filter (where not passes) as rows_dropped from qual")
def quality_report(spark, d):
    return lc.quality(_pre(spark, d, 10)).agg(F.count("*").alias("rows_before"), F.count_if("passes").alias("rows_after"), F.count_if(~F.col("passes")).alias("rows_dropped"))


@query("quality_relaxed", _QUAL.format(n=6, g=1, r=1, i=2, t="(select * from phot where dt <= 10)") + " select obj_id % 5 as kind, count(*) as n, round(avg(passes::int), 6) + 0.0 as survive from qual group by 1")
def quality_relaxed(spark, d):
    q = lc.quality(_pre(spark, d, 10), total=6, g=1, r=1, i=2)
    return q.groupBy((F.col("obj_id") % 5).alias("kind")).agg(F.count("*").alias("n"), r6(F.avg(F.col("passes").cast("double"))).alias("survive"))


@query("eligibility_ladder", """o as (select obj_id, count(*) filter (where mag is not null and magerr > 0 and magerr <= 1.0857::double / 3) as nv, min(mjd) as first, max(mjd) as last from det group by obj_id),
e as (select case when nv = 0 then 'none valid' when first < 60310.2 then 'too early' when last > 60339.5 then 'too recent' when nv < 20 then 'fails quality' else 'eligible' end as status from o) select status, count(*) as n from e group by 1""")
def eligibility_ladder(spark, d):
    det = src.detections(spark, d)
    o = det.groupBy("obj_id").agg(F.count_if(ph.valid_detection(F.col("mag"), F.col("magerr"))).alias("nv"), F.min("mjd").alias("first"), F.max("mjd").alias("last"))
    status = F.when(F.col("nv") == 0, "none valid").when(F.col("first") < 60310.2, "too early").when(F.col("last") > 60339.5, "too recent").when(F.col("nv") < 20, "fails quality").otherwise("eligible")
    return o.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


_SPAN = "o as (select obj_id, max(dt) as span, count(*) as n, count(*) filter (where band = 0) as n_g, count(*) filter (where band = 1) as n_r from phot group by obj_id)"


def _spans(spark, d):
    return _phot(spark, d).groupBy("obj_id").agg(F.max("dt").alias("span"), F.count("*").alias("n"), F.count_if(F.col("band") == 0).alias("n_g"), F.count_if(F.col("band") == 1).alias("n_r"))


@query("forecast_gate", f"{_SPAN} select obj_id, case when span > 28 then 'too long' when n < 20 then 'too few' when n_g < 8 then 'too few g' when n_r < 8 then 'too few r' else 'forecast' end as gate from o")
def forecast_gate(spark, d):
    gate = F.when(F.col("span") > 28, "too long").when(F.col("n") < 20, "too few").when(F.col("n_g") < 8, "too few g").when(F.col("n_r") < 8, "too few r").otherwise("forecast")
    return _spans(spark, d).select("obj_id", gate.alias("gate"))


@query("phase_routing", "o as (select obj_id, max(dt) as span from phot where dt <= obj_id % 30 + 1 group by obj_id) select obj_id, case when span < 7.5 then 5 when span < 15 then 10 when span < 35 then 20 end as phase from o")
def phase_routing(spark, d):
    o = _phot(spark, d).where(F.col("dt") <= F.col("obj_id") % 30 + 1).groupBy("obj_id").agg(F.max("dt").alias("span"))
    return o.select("obj_id", ph.phase(F.col("span")).alias("phase"))


@query("smallest_covering_horizon", "o as (select obj_id, max(dt) as span from phot where dt <= obj_id % 30 + 1 group by obj_id) select obj_id, case when span <= 5 then 5 when span <= 10 then 10 when span <= 15 then 15 when span <= 20 then 20 else 30 end as horizon from o")
def smallest_covering_horizon(spark, d):
    o = _phot(spark, d).where(F.col("dt") <= F.col("obj_id") % 30 + 1).groupBy("obj_id").agg(F.max("dt").alias("span"))
    return o.select("obj_id", ph.covering_horizon(F.col("span")).alias("horizon"))


@query("extended_source_filter", "select src_id, round(ext, 6) + 0.0 as ext from cat where ext > 0.06 and r_kron <> -999")
def extended_source_filter(spark, d):
    return src.catalogue(spark, d).where((F.col("ext") > 0.06) & ph.null_if(F.col("r_kron"), -999.0).isNotNull()).select("src_id", r6("ext").alias("ext"))


_PAIR = """pairs as (select * from (select a.obj_id, a.mjd, a.dt, a.band, b.dt as partner_dt, case when a.band = 0 then 1 else -1 end * -2.5::double * (a.logflux - b.logflux) as colour, 2.5::double * sqrt(a.logflux_err * a.logflux_err + b.logflux_err * b.logflux_err) as err,
  row_number() over (partition by a.obj_id, a.band, a.mjd, a.mag, a.magerr order by abs(a.mjd - b.mjd), b.mjd, b.mag, b.magerr) as n
  from {t} a join {t} b on a.obj_id = b.obj_id and abs(a.mjd - b.mjd) <= 1.5 and ((a.band = 0 and b.band = 1) or (a.band = 1 and b.band = 0))) where n = 1)"""


@query("nearest_time_pair", _PAIR.format(t="phot") + " select obj_id, round(mjd, 6) + 0.0 as mjd, band, round(colour, 6) + 0.0 as colour, round(err, 6) + 0.0 as colour_err from pairs")
def nearest_time_pair(spark, d):
    p = lc.nearest_time_pairs(_phot(spark, d))
    return p.select("obj_id", r6("mjd").alias("mjd"), "band", r6("colour").alias("colour"), r6("colour_err").alias("colour_err"))


@query("prefix_causal_colours", _PAIR.format(t="pre") + " select obj_id, round(dt, 6) + 0.0 as dt, band, round(colour, 6) + 0.0 as colour from pairs where obj_id in (select obj_id from pre group by obj_id having count(*) >= 8 and count(*) filter (where band = 0) >= 2 and count(*) filter (where band = 1) >= 2)")
def prefix_causal_colours(spark, d):
    p = lc.nearest_time_pairs(lc.quality_cut(_pre(spark, d)))
    return p.select("obj_id", r6("dt").alias("dt"), "band", r6("colour").alias("colour"))


@query("colour_leakage_audit", _PAIR.format(t="phot") + " select obj_id, count(*) as n_leaked from pairs where dt <= 10 and partner_dt > 10 group by obj_id")
def colour_leakage_audit(spark, d):
    return lc.leakage(_phot(spark, d), 10)


@query("colour_stats", _PAIR.format(t="pre") + """, h as (select *, min(dt) over (partition by obj_id) + (max(dt) over (partition by obj_id) - min(dt) over (partition by obj_id)) / 2 as half, 1 / pow(greatest(err, 1e-6), 2) as w from pairs)
select obj_id, count(*) as n, round(avg(colour), 6) + 0.0 as mean, round(sum(w * colour) / sum(w), 6) + 0.0 as wmean, round(case when count(*) > 1 then stddev_pop(colour) end, 6) + 0.0 as std, round(case when count(*) > 2 and max(dt) > min(dt) then regr_slope(colour, dt) end, 6) + 0.0 as slope,
round(avg(colour) filter (where dt <= half), 6) + 0.0 as early, round(avg(colour) filter (where dt > half), 6) + 0.0 as late, round(avg(colour) filter (where dt > half) - avg(colour) filter (where dt <= half), 6) + 0.0 as late_minus_early from h group by obj_id""")
def colour_stats(spark, d):
    return _r(lc.colour_stats(lc.nearest_time_pairs(_pre(spark, d))))


_BANDS = "bands as (select * from (select *, row_number() over (partition by obj_id, band, mjd order by mag, magerr) as rn from pre) where rn = 1)"


@query("dedupe_same_time", f"{_BANDS} select obj_id, band, count(*) as n, round(sum(mag), 6) + 0.0 as s from bands group by obj_id, band")
def dedupe_same_time(spark, d):
    return _bands(spark, d).groupBy("obj_id", "band").agg(F.count("*").alias("n"), r6(F.sum("mag")).alias("s"))


@query("band_cadence", f"{_BANDS}, g as (select *, mjd - lag(mjd) over (partition by obj_id, band order by mjd) as gap from bands) select obj_id, band, count(*) as n_obs, round(max(mjd) - min(mjd), 6) + 0.0 as span, round(median(gap), 6) + 0.0 as gap_median, round(max(gap), 6) + 0.0 as gap_max from g group by obj_id, band")
def band_cadence(spark, d):
    c = lc.band_cadence(_bands(spark, d))
    return c.select("obj_id", "band", "n_obs", *(r6(x).alias(x) for x in ("span", "gap_median", "gap_max")))


@query("band_peak", f"""{_BANDS}, k as (select *, first_value(dt) over w as tp, first_value(logflux) over w as lp, last_value(logflux) over (partition by obj_id, band order by dt rows between unbounded preceding and unbounded following) as ll from bands window w as (partition by obj_id, band order by flux desc, dt))
select obj_id, band, round(min(tp), 6) + 0.0 as t_peak, round(min(lp), 6) + 0.0 as logflux_peak, round(min(ll) - min(lp), 6) + 0.0 as logflux_last_minus_peak, round(avg((dt < tp)::int), 6) + 0.0 as frac_obs_before_peak from k group by obj_id, band""")
def band_peak(spark, d):
    return lc.band_peak(_bands(spark, d)).select("obj_id", "band", *(r6(x).alias(x) for x in ("t_peak", "logflux_peak", "logflux_last_minus_peak", "frac_obs_before_peak")))


@query("band_snr_mean", f"{_BANDS} select obj_id, band, round(avg((1 / ln(10::double)) / greatest(logflux_err, 1e-6)), 6) + 0.0 as snr_mean from bands group by obj_id, band")
def band_snr_mean(spark, d):
    return lc.band_cadence(_bands(spark, d)).select("obj_id", "band", r6("snr_mean").alias("snr_mean"))


@query("global_cadence", "select obj_id, count(*) as n_obs_total, count(distinct band) as n_bands, round(max(dt), 6) + 0.0 as span_total from pre group by obj_id")
def global_cadence(spark, d):
    return lc.global_cadence(_pre(spark, d)).withColumn("span_total", r6("span_total"))


@query("cross_band_peak", f"""{_BANDS}, k as (select obj_id, band, arg_max(dt, flux) as t, max(logflux) as f, count(*) as n from bands where band < 2 group by obj_id, band)
select o.obj_id, round(g.t - r.t, 6) + 0.0 as gr_peak_dt, round(g.f - r.f, 6) + 0.0 as gr_peak_logflux_ratio, round(g.n / greatest(r.n, 1)::double, 6) + 0.0 as gr_n_ratio from (select distinct obj_id from k) o left join k g on g.obj_id = o.obj_id and g.band = 0 left join k r on r.obj_id = o.obj_id and r.band = 1""")
def cross_band_peak(spark, d):
    return _r(lc.cross_band_peak(_bands(spark, d)))


_STAT = _BANDS + """, x0 as (select obj_id, band, dt as t, mjd, logflux as m, logflux_err as d, count(*) over w as n, avg(logflux) over w as mu, stddev_samp(logflux) over w as s, median(logflux) over w as med, max(logflux) over w as mx, min(logflux) over w as mn,
  sum(logflux / (logflux_err * logflux_err)) over w / sum(1 / (logflux_err * logflux_err)) over w as wm, logflux - lag(logflux) over (partition by obj_id, band order by mjd) as dm, dt - lag(dt) over (partition by obj_id, band order by mjd) as dtm from bands window w as (partition by obj_id, band)),
x as (select *, (m - mu) / s as z, sum((m - mu) / (n * s)) over (partition by obj_id, band order by mjd) as c, (m - wm) / d as r, row_number() over (partition by obj_id, band order by m, mjd) as i from x0 where n >= 4)"""
#: Column: SQL over x by (obj_id, band); the Spark form is in lightcurve.band_statistics.
_STATS = {
    "amplitude": "(max(m) - min(m)) / 2",
    "beyond_1_std": "avg((abs(z) > 1)::int)",
    "beyond_2_std": "avg((abs(z) > 2)::int)",
    "cusum": "max(c) - min(c)",
    "eta_e": "pow(max(t) - min(t), 2) / pow(any_value(n) - 1, 3) * sum(pow(dm / dtm, 2)) / pow(any_value(s), 2)",
    "excess_variance": "(pow(any_value(s), 2) - avg(d * d)) / pow(any_value(mu), 2)",
    "inter_percentile_range_10": "quantile_cont(m, 0.9) - quantile_cont(m, 0.1)",
    "inter_percentile_range_25": "quantile_cont(m, 0.75) - quantile_cont(m, 0.25)",
    "kurtosis": "(any_value(n) - 1.0::double) / ((any_value(n) - 2.0::double) * (any_value(n) - 3)) * ((any_value(n) + 1) * avg(pow(m - mu, 4)) / pow(avg(pow(m - mu, 2)), 2) - 3 * (any_value(n) - 1))",
    "skew": "case when any_value(n) > 2 then sqrt(any_value(n) * (any_value(n) - 1.0::double)) / (any_value(n) - 2) * avg(pow(m - mu, 3)) / pow(avg(pow(m - mu, 2)), 1.5) end",
    "linear_fit_slope": "(sum(1 / (d * d)) * sum(t * m / (d * d)) - sum(t / (d * d)) * sum(m / (d * d))) / (sum(1 / (d * d)) * sum(t * t / (d * d)) - pow(sum(t / (d * d)), 2))",
    "linear_trend": "regr_slope(m, t)",
    "linear_trend_noise": "sqrt(greatest(0, regr_syy(m, t) - pow(regr_sxy(m, t), 2) / regr_sxx(m, t)) / (any_value(n) - 2))",
    "magnitude_percentage_ratio_40_5": "(quantile_cont(m, 0.6) - quantile_cont(m, 0.4)) / (quantile_cont(m, 0.95) - quantile_cont(m, 0.05))",
    "magnitude_percentage_ratio_20_10": "(quantile_cont(m, 0.8) - quantile_cont(m, 0.2)) / (quantile_cont(m, 0.9) - quantile_cont(m, 0.1))",
    "maximum_slope": "max(abs(dm / dtm))",
    "mean": "any_value(mu)",
    "weighted_mean": "any_value(wm)",
    "mean_variance": "any_value(s) / any_value(mu)",
    "median_absolute_deviation": "median(abs(m - med))",
    "median_buffer_range_10": "avg((abs(m - med) < 0.10::double * (mx - mn) / 2)::int)",
    "percent_amplitude": "greatest(any_value(mx) - any_value(med), any_value(med) - any_value(mn))",
    "percent_difference_magnitude_percentile_5": "(quantile_cont(m, 0.95) - quantile_cont(m, 0.05)) / any_value(med)",
    "chi2": "sum(r * r) / (any_value(n) - 1)",
    "standard_deviation": "any_value(s)",
    "stetson_k": "sum(abs(r)) / sqrt(any_value(n) * sum(r * r))",
}
#: Queries of the statistics: columns that each returns.
_STAT_QUERIES = {
    "stat_amplitude": ["amplitude"], "stat_beyond_std": ["beyond_1_std", "beyond_2_std"], "stat_cusum": ["cusum"], "stat_eta_e": ["eta_e"], "stat_excess_variance": ["excess_variance"],
    "stat_inter_percentile_range": ["inter_percentile_range_10", "inter_percentile_range_25"], "stat_kurtosis": ["kurtosis"], "stat_skew": ["skew"], "stat_linear_fit": ["linear_fit_slope"],
    "stat_linear_trend": ["linear_trend", "linear_trend_noise"], "stat_magnitude_percentage_ratio": ["magnitude_percentage_ratio_40_5", "magnitude_percentage_ratio_20_10"], "stat_maximum_slope": ["maximum_slope"],
    "stat_mean": ["mean"], "stat_weighted_mean": ["weighted_mean"], "stat_mean_variance": ["mean_variance"], "stat_median_abs_deviation": ["median_absolute_deviation"],
    "stat_median_buffer_range": ["median_buffer_range_10"], "stat_percent_amplitude": ["percent_amplitude"], "stat_percent_difference_percentile": ["percent_difference_magnitude_percentile_5"],
    "stat_reduced_chi2": ["chi2"], "stat_standard_deviation": ["standard_deviation"], "stat_stetson_k": ["stetson_k"],
}


def _statistic(columns):
    def run(spark, d):
        return lc.band_statistics(_bands(spark, d)).select("obj_id", "band", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in columns))

    return run


for _name, _cols in _STAT_QUERIES.items():
    query(_name, _STAT + " select obj_id, band, " + ", ".join(f"round({_STATS[c]}, 5) + 0.0 as {c}" for c in _cols) + " from x group by obj_id, band")(_statistic(_cols))

_PHI = "case when z >= 0 then 1 - exp(-z * z / 2) / 2.5066282746310002::double * {p} else exp(-z * z / 2) / 2.5066282746310002::double * {p} end".format(p="(u * (0.319381530::double + u * (-0.356563782::double + u * (1.781477937::double + u * (-1.821255978::double + u * 1.330274429::double)))))")


@query("stat_anderson_darling", _STAT + f", y as (select *, 1 / (1 + 0.2316419::double * abs(z)) as u from x), f as (select *, greatest(1e-12, least(1 - 1e-12, {_PHI})) as f from y) select obj_id, band, round((-any_value(n) - sum((2 * i - 1) * ln(f) + (2 * (n - i) + 1) * ln(1 - f)) / any_value(n)) * (1 + 4.0::double / any_value(n) - 25.0::double / (any_value(n) * any_value(n))), 5) + 0.0 as anderson_darling_normal from f group by obj_id, band")
def stat_anderson_darling(spark, d):
    return lc.anderson_darling(_bands(spark, d)).select("obj_id", "band", (F.round("anderson_darling_normal", 5) + F.lit(0.0)).alias("anderson_darling_normal"))


_RF = ", ".join(f"({r}::double, {f}::double)" for r in lc.BAZIN_RISE for f in lc.BAZIN_FALL if f > r)
_BAZIN = f"""n6 as (select *, count(*) over w as n, min(dt) over w as t1, max(dt) over w as t2 from bands window w as (partition by obj_id, band)),
g as (select obj_id, band, n, flux, t1 + (t2 - t1) * i / {lc.BAZIN_STEPS - 1} as t0, rise, fall, 1 / (flux_err * flux_err) as w, dt from n6, (select unnest(generate_series(0, {lc.BAZIN_STEPS - 1})) as i), (values {_RF}) v(rise, fall) where n >= 6),
h as (select *, exp(-(dt - t0) / fall) / (1 + exp(-(dt - t0) / rise)) as h from g),
s as (select obj_id, band, t0, rise, fall, any_value(n) as n, sum(w) as s0, sum(w * h) as sh, sum(w * h * h) as shh, sum(w * flux) as sy, sum(w * h * flux) as shy, sum(w * flux * flux) as syy from h group by obj_id, band, t0, rise, fall),
f as (select *, (s0 * shy - sh * sy) / (s0 * shh - sh * sh) as a from s where s0 * shh - sh * sh > 1e-9 * s0 * shh), k as (select *, (sy - a * sh) / s0 as b from f where a > 0), c as (select *, (syy - a * shy - b * sy) / greatest(n - 5, 1) as chi2 from k),
bz as (select obj_id, band, a as amplitude, b as baseline, t0 as reference_time, rise as rise_time, fall as fall_time, chi2 as reduced_chi2, fall / rise as fall_over_rise from (select *, row_number() over (partition by obj_id, band order by round(chi2, 6), t0, rise, fall) as best from c) where best = 1)"""
_BAZIN_COLUMNS = ("amplitude", "baseline", "reference_time", "rise_time", "fall_time", "reduced_chi2", "fall_over_rise")
_r4 = lambda c: f"round({c}, 4) + 0.0"


@query("bazin_grid_fit", f"{_BANDS}, {_BAZIN} select obj_id, band, " + ", ".join(f"{_r4(c)} as {c}" for c in _BAZIN_COLUMNS) + " from bz")
def bazin_grid_fit(spark, d):
    return lc.bazin_grid_fit(_bands(spark, d)).select("obj_id", "band", *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in _BAZIN_COLUMNS))


_SLOPE = _STATS["linear_fit_slope"]
_DET = "(sum(1 / (d * d)) * sum(t * t / (d * d)) - pow(sum(t / (d * d)), 2))"
_REST = "greatest(0, regr_syy(m, t) - pow(regr_sxy(m, t), 2) / regr_sxx(m, t))"
#: All statistics of a band, in the order of lightcurve.band_features.
_ALL_STATS = {
    **{k: v for k, v in _STATS.items() if k not in ("chi2", "standard_deviation", "stetson_k")},
    "linear_fit_slope_sigma": f"sqrt(sum(1 / (d * d)) / {_DET})",
    "linear_fit_reduced_chi2": f"(sum(m * m / (d * d)) - {_SLOPE} * sum(t * m / (d * d)) - (sum(m / (d * d)) - {_SLOPE} * sum(t / (d * d))) / sum(1 / (d * d)) * sum(m / (d * d))) / (any_value(n) - 2)",
    "linear_trend_sigma": f"sqrt({_REST} / (any_value(n) - 2) / regr_sxx(m, t))",
    "chi2": _STATS["chi2"], "standard_deviation": _STATS["standard_deviation"], "stetson_k": _STATS["stetson_k"],
}
_COLOUR_STATS = ("n", "mean", "wmean", "std", "slope", "early", "late", "late_minus_early")


def _feature_sql():
    """The feature table in SQL: what the queries above return, side by side."""
    good = "good as (select * from pre where obj_id in (select obj_id from pre group by obj_id having count(*) >= 8 and count(*) filter (where band = 0) >= 2 and count(*) filter (where band = 1) >= 2))"
    bands = _STAT.replace("from pre)", "from good)")
    views = [good, bands]
    views.append("st as (select obj_id, band, " + ", ".join(f"{v} as {k}" for k, v in _ALL_STATS.items()) + " from x group by obj_id, band)")
    views.append(f"y as (select *, 1 / (1 + 0.2316419::double * abs(z)) as u from x), fz as (select *, greatest(1e-12, least(1 - 1e-12, {_PHI})) as f from y)")
    views.append("ad as (select obj_id, band, (-any_value(n) - sum((2 * i - 1) * ln(f) + (2 * (n - i) + 1) * ln(1 - f)) / any_value(n)) * (1 + 4.0::double / any_value(n) - 25.0::double / (any_value(n) * any_value(n))) as anderson_darling_normal from fz group by obj_id, band)")
    views.append("gap as (select *, mjd - lag(mjd) over (partition by obj_id, band order by mjd) as gap, first_value(dt) over w as tp, first_value(logflux) over w as lp, last_value(logflux) over (partition by obj_id, band order by dt rows between unbounded preceding and unbounded following) as ll from bands window w as (partition by obj_id, band order by flux desc, dt))")
    views.append("cad as (select obj_id, band, count(*) as n_obs, max(mjd) - min(mjd) as span, median(gap) as gap_median, max(gap) as gap_max, avg((1 / ln(10::double)) / greatest(logflux_err, 1e-6)) as snr_mean, min(tp) as t_peak, min(lp) as logflux_peak, min(ll) - min(lp) as logflux_last_minus_peak, avg((dt < tp)::int) as frac_obs_before_peak from gap group by obj_id, band)")
    views.append(_BAZIN)
    own = [*lc.CADENCE, *lc.PEAK]
    b = [f"b{i} as (select cad.*, " + ", ".join(f"st.{k}" for k in _ALL_STATS) + ", anderson_darling_normal, " + ", ".join(f"bz.{k} as bazin_{k}" for k in _BAZIN_COLUMNS) + f" from cad left join st using (obj_id, band) left join ad using (obj_id, band) left join bz using (obj_id, band) where cad.band = {i})" for i in range(3)]
    views += b
    for name, (x, y) in {"g_r": (0, 1), "r_i": (1, 2)}.items():
        pairs = _PAIR.format(t="good").replace("pairs as", f"{name}_p as").replace("a.band = 0", f"a.band = {x}").replace("b.band = 1", f"b.band = {y}").replace("(a.band = 1 and b.band = 0)", f"(a.band = {y} and b.band = {x})")
        views.append(pairs)
        views.append(f"{name}_h as (select *, min(dt) over (partition by obj_id) + (max(dt) over (partition by obj_id) - min(dt) over (partition by obj_id)) / 2 as half, 1 / pow(greatest(err, 1e-6), 2) as w from {name}_p)")
        views.append(f"{name}_c as (select obj_id, count(*) as n, avg(colour) as mean, sum(w * colour) / sum(w) as wmean, case when count(*) > 1 then stddev_pop(colour) end as std, case when count(*) > 2 and max(dt) > min(dt) then regr_slope(colour, dt) end as slope, avg(colour) filter (where dt <= half) as early, avg(colour) filter (where dt > half) as late, avg(colour) filter (where dt > half) - avg(colour) filter (where dt <= half) as late_minus_early from {name}_h group by obj_id)")
    views.append("totals as (select obj_id, count(*) as n_obs_total, count(distinct band) as n_bands, max(dt) as span_total from good group by obj_id)")
    columns = ["totals.obj_id", "n_obs_total", "n_bands", f"{_r4('span_total')} as span_total"]
    for i, letter in enumerate("gri"):
        columns += [f"b{i}.{k} as {letter}_{k}" if k == "n_obs" else f"{_r4(f'b{i}.{k}')} as {letter}_{k}" for k in [*own, *_ALL_STATS, "anderson_darling_normal", *(f"bazin_{k}" for k in _BAZIN_COLUMNS)]]
    for name in ("g_r", "r_i"):
        columns += [f"{name}_c.{k} as {name}_{k}" if k == "n" else f"{_r4(f'{name}_c.{k}')} as {name}_{k}" for k in _COLOUR_STATS]
    columns += [f"{_r4('b0.t_peak - b1.t_peak')} as gr_peak_dt", f"{_r4('b0.logflux_peak - b1.logflux_peak')} as gr_peak_logflux_ratio", f"{_r4('b0.n_obs / greatest(b1.n_obs, 1)::double')} as gr_n_ratio"]
    return ",\n".join(views) + "\nselect " + ", ".join(columns) + " from totals left join b0 using (obj_id) left join b1 using (obj_id) left join b2 using (obj_id) left join g_r_c using (obj_id) left join r_i_c using (obj_id)"


def features(spark, d):
    """The feature table of the first 20 days. Detections are read, cut and written once, in buckets by object; all parts start from there and
    none moves its rows again."""
    return lc.assemble_features(io.bucketed(lc.quality_cut(_pre(spark, d)), "detections", "obj_id", "dt"))


@query("assemble_features", _feature_sql())
def assemble_features(spark, d):
    f = features(spark, d)
    return f.select(*((F.round(c, 4) + F.lit(0.0)).alias(c) if t == "double" else c for c, t in f.dtypes))
