"""Queries on forecasts, baselines, reconstruction and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lightcurve as lc
from ..operators import metric
from ..operators import neighbours as nb
from ..operators import ranking
from ..sources import adapters as src
from .base import query, r6
from .curves import _phot
from .tables import _ANCHOR, _RECENT, _anchors, _future, _recent

_ERR = f"{_ANCHOR}, fu as (select p.obj_id, p.band, p.dt as day, p.mag - k.peak as target, anchor from phot p join anch a on p.obj_id = a.obj_id and p.band = a.band join peak k on k.obj_id = p.obj_id where p.dt > 10 and p.dt <= 90 and p.band < 2)"


@query("persistence_forecast", f"{_ERR} select obj_id, count(*) as n, round(avg(abs(target - anchor)), 6) + 0.0 as mae from fu group by obj_id")
def persistence_forecast(spark, d):
    return _future(spark, d).groupBy("obj_id").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("target") - F.col("anchor")))).alias("mae"))


@query("linear_extrapolation_forecast", f"{_ERR}, {_RECENT} select fu.obj_id, fu.band, round(fu.day, 6) + 0.0 as day, round(anchor + coalesce(greatest(-0.2, least(0.2, slope)), 0) * (fu.day - 10), 4) + 0.0 as pred from fu left join rec on fu.obj_id = rec.obj_id and fu.band = rec.band")
def linear_extrapolation_forecast(spark, d):
    f = _future(spark, d).join(_recent(spark, d), ["obj_id", "band"], "left")
    slope = F.coalesce(F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col("slope"))), F.lit(0.0))
    return f.select("obj_id", "band", r6("day").alias("day"), (F.round(F.col("anchor") + slope * (F.col("day") - 10), 4) + F.lit(0.0)).alias("pred"))


@query("object_error_summary", f"{_ERR}, o as (select obj_id, avg(abs(target - anchor)) as e from fu group by obj_id) select count(*) as n, round(median(e), 6) + 0.0 as median_object_mae, (select round(median(abs(target - anchor)), 6) + 0.0 from fu) as median_point from o")
def object_error_summary(spark, d):
    f = _future(spark, d).withColumn("e", F.abs(F.col("target") - F.col("anchor")))
    o = ranking.quantiles(f.groupBy("obj_id").agg(F.avg("e").alias("o")), [], "o", {"m": 0.5}, F.floor(F.col("o") * 64))
    point = ranking.quantiles(f, [], "e", {"m": 0.5}, F.floor(F.col("e") * 64)).first()
    return o.select("n", r6("m").alias("median_object_mae"), r6(F.lit(point["m"] if point else None).cast("double")).alias("median_point"))


@query("lead_time_bins", f"{_ERR} select case when day - 10 <= 5 then '0-5' when day - 10 <= 15 then '5-15' when day - 10 <= 30 then '15-30' else '30-60' end as lead, count(*) as n, round(median(abs(target - anchor)), 6) + 0.0 as median_error from fu group by 1")
def lead_time_bins(spark, d):
    lead = F.col("day") - 10
    bins = F.when(lead <= 5, "0-5").when(lead <= 15, "5-15").when(lead <= 30, "15-30").otherwise("30-60")
    f = _future(spark, d).select(bins.alias("lead"), F.abs(F.col("target") - F.col("anchor")).alias("e"))
    return ranking.quantiles(f, ["lead"], "e", {"m": 0.5}, F.floor(F.col("e") * 64)).select("lead", "n", r6("m").alias("median_error"))


@query("residual_anomaly", f"{_ERR} select obj_id, round(quantile_cont(abs(target - anchor) / 0.5, 0.9), 6) + 0.0 as score from fu where day <= 50 group by obj_id having count(*) >= 3")
def residual_anomaly(spark, d):
    f = _future(spark, d).where("day <= 50").groupBy("obj_id").agg(F.count("*").alias("n"), r6(F.percentile(F.abs(F.col("target") - F.col("anchor")) / 0.5, F.lit(0.9))).alias("score"))
    return f.where("n >= 3").select("obj_id", "score")


@query("grouped_interval_calibration", f"{_ERR}, r as (select band, floor((day - 10) / 5)::int as lead, abs(target - anchor) as e from fu), g as (select band, lead, count(*) as n, quantile_cont(e, 0.68) as q from r group by 1, 2) select band, lead, n, round(case when n >= 100 then q else (select quantile_cont(e, 0.68) from r) end, 6) + 0.0 as half_width from g")
def grouped_interval_calibration(spark, d):
    """Quantile of a group with at least 100 points, else the global one."""
    r = _future(spark, d).select("band", F.floor((F.col("day") - 10) / 5).cast("int").alias("lead"), F.abs(F.col("target") - F.col("anchor")).alias("e"))
    every = ranking.quantiles(r, [], "e", {"q": 0.68}, F.floor(F.col("e") * 64)).first()
    every = every["q"] if every else None
    g = ranking.quantiles(r, ["band", "lead"], "e", {"q": 0.68}, F.floor(F.col("e") * 64))
    return g.select("band", "lead", "n", r6(F.when(F.col("n") >= 100, F.col("q")).otherwise(F.lit(every).cast("double"))).alias("half_width"))


@query("paired_bootstrap", f"""{_ERR}, {_RECENT}, m as (select fu.obj_id, avg(abs(target - anchor)) as a, avg(abs(target - anchor - coalesce(greatest(-0.2, least(0.2, slope)), 0) * (fu.day - 10))) as b from fu left join rec on fu.obj_id = rec.obj_id and fu.band = rec.band group by fu.obj_id),
pick as (select a - b as gain, rep, ('0x' || substr(md5(rep || '/' || obj_id), 1, 8))::bigint as h from m, (select unnest(generate_series(0, {ranking.REPLICATES - 1})) as rep)),
w as (select rep, gain, {" + ".join(f"(h >= {t})::int" for t in ranking.poisson_steps())} as w from pick), s as (select rep, sum(w * gain) / nullif(sum(w), 0) as gain from w group by rep) select round(avg(gain), 5) + 0.0 as gain, round(quantile_cont(gain, 0.025), 5) + 0.0 as lo, round(quantile_cont(gain, 0.975), 5) + 0.0 as hi from s""")
def paired_bootstrap(spark, d, n=ranking.REPLICATES):
    """Objects resampled jointly for two methods: an object's weight in a replicate is a Poisson draw from the hash of both."""
    f = _future(spark, d).join(_recent(spark, d).select("obj_id", "band", "slope"), ["obj_id", "band"], "left")
    slope = F.coalesce(F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col("slope"))), F.lit(0.0))
    m = f.groupBy("obj_id").agg(F.avg(F.abs(F.col("target") - F.col("anchor"))).alias("a"), F.avg(F.abs(F.col("target") - F.col("anchor") - slope * (F.col("day") - 10))).alias("b"))
    s = ranking.poisson_bootstrap(m.withColumn("gain", F.col("a") - F.col("b")), "obj_id", ["gain"], n)
    r5 = lambda c: F.round(c, 5) + F.lit(0.0)
    return s.agg(r5(F.avg("gain")).alias("gain"), r5(F.percentile("gain", F.lit(0.025))).alias("lo"), r5(F.percentile("gain", F.lit(0.975))).alias("hi"))


@query("adoption_gates", f"{_ERR}, s as (select avg(abs(target - anchor)) as a, avg(abs(target)) as b, count(*) as n from fu) select round(b - a, 5) + 0.0 as gain, b - a > 0 as better, n >= 100 as enough, b - a > 0 and n >= 100 as adopt from s")
def adoption_gates(spark, d):
    s = _future(spark, d).agg(F.avg(F.abs(F.col("target") - F.col("anchor"))).alias("a"), F.avg(F.abs("target")).alias("b"), F.count("*").alias("n"))
    gain = F.col("b") - F.col("a")
    return s.select((F.round(gain, 5) + F.lit(0.0)).alias("gain"), (gain > 0).alias("better"), (F.col("n") >= 100).alias("enough"), ((gain > 0) & (F.col("n") >= 100)).alias("adopt"))


_GRID = "gr as (select a.obj_id, a.band, day::double as day, anchor + 0.03::double * (day - 10) as mag from anch a, (select unnest([10, 11, 15, 20, 25, 30, 40, 50, 60, 75, 90]) as day) where a.band < 2)"
_GRID_DAYS = (10, 11, 15, 20, 25, 30, 40, 50, 60, 75, 90)


@query("forecast_blend", f"{_ERR}, {_GRID}, seg as (select obj_id, band, day as d0, mag as m0, lead(day) over (partition by obj_id, band order by day) as d1, lead(mag) over (partition by obj_id, band order by day) as m1 from gr) select fu.obj_id, fu.band, round(fu.day, 6) + 0.0 as day, round(0.5 * (m0 + (fu.day - d0) / (d1 - d0) * (m1 - m0)) + 0.5 * anchor, 6) + 0.0 as blend from fu join seg on fu.obj_id = seg.obj_id and fu.band = seg.band and fu.day >= d0 and fu.day < d1")
def forecast_blend(spark, d):
    """Half the interpolated grid forecast, half the anchor. The knots of a curve travel as one array, so interpolation needs no range join."""
    g = _anchors(spark, d).where("band < 2").withColumn("grid", F.array(*(F.struct(F.lit(float(x)).alias("d"), (F.col("anchor") + 0.03 * (x - 10)).alias("m")) for x in _GRID_DAYS)))
    f = _future(spark, d).join(g.select("obj_id", "band", "grid"), ["obj_id", "band"])
    lo = F.element_at(F.filter("grid", lambda k: k["d"] <= F.col("day")), -1)
    hi = F.element_at(F.filter("grid", lambda k: k["d"] > F.col("day")), 1)
    at = lo["m"] + (F.col("day") - lo["d"]) / (hi["d"] - lo["d"]) * (hi["m"] - lo["m"])
    return f.select("obj_id", "band", r6("day").alias("day"), r6(0.5 * at + 0.5 * F.col("anchor")).alias("blend"))


@query("forecast_routing", "select obj_id, case when truth in (2, 3, 4, 5) then 'weighted' else 'pooled' end as role from sco")
def forecast_routing(spark, d):
    return src.scores(spark, d).select("obj_id", F.when(F.col("truth").isin(2, 3, 4, 5), "weighted").otherwise("pooled").alias("role"))


@query("mondrian_multipliers", f"{_ERR}, m as (select obj_id % 6 as cls, band, quantile_cont(abs(target - anchor), 0.68) as k, count(*) as n from fu group by 1, 2), al as (select quantile_cont(abs(target - anchor), 0.68) as k from fu) select c.obj_id % 6 as cls, c.band, round(coalesce(case when m.n >= 200 then m.k end, al.k), 6) + 0.0 as multiplier from (select distinct obj_id % 6 as obj_id, band from fu) c left join m on m.cls = c.obj_id and m.band = c.band, al")
def mondrian_multipliers(spark, d):
    f = _future(spark, d).withColumn("e", F.abs(F.col("target") - F.col("anchor")))
    every = ranking.quantiles(f, [], "e", {"k": 0.68}, F.floor(F.col("e") * 64)).first()
    every = every["k"] if every else None
    m = ranking.quantiles(f.withColumn("cls", F.col("obj_id") % 6), ["cls", "band"], "e", {"k": 0.68}, F.floor(F.col("e") * 64))
    return m.select("cls", "band", r6(F.when(F.col("n") >= 200, F.col("k")).otherwise(F.lit(every).cast("double"))).alias("multiplier"))


@query("parameter_estimates", "o as (select obj_id, min(mjd) as t0, arg_max(dt, (flux, -dt)) as tp, min(mag) as mb from phot where dt <= 20 group by obj_id) select obj_id, round(t0 + tp, 5) + 0.0 as peak_mjd, round(mb, 6) + 0.0 as m_peak, round(mb - 0.25, 6) + 0.0 as lo68, round(mb + 0.25, 6) + 0.0 as hi68 from o")
def parameter_estimates(spark, d):
    p = lc.horizon_truncate(_phot(spark, d), 20)
    o = p.groupBy("obj_id").agg(F.min("mjd").alias("t0"), (-F.max(F.struct("flux", (-F.col("dt")).alias("t")))["t"]).alias("tp"), F.min("mag").alias("mb"))
    return o.select("obj_id", (F.round(F.col("t0") + F.col("tp"), 5) + F.lit(0.0)).alias("peak_mjd"), r6("mb").alias("m_peak"), r6(F.col("mb") - 0.25).alias("lo68"), r6(F.col("mb") + 0.25).alias("hi68"))


_STEPS, _SCALE = 20, 5.0
_SMOOTH = f"""sp as (select obj_id, band, min(dt) as a, max(dt) as b from (select distinct obj_id, band, dt from phot where dt <= 20 and band < 2) group by 1, 2 having count(*) >= 3),
g as (select obj_id, band, i, a + (b - a) * i / {_STEPS}::double as t from sp, (select unnest(generate_series(0, {_STEPS})) as i)),
w as (select g.obj_id, g.band, g.i, g.t, p.mag, (1 + sqrt(3::double) * abs(p.dt - g.t) / {_SCALE}) * exp(-sqrt(3::double) * abs(p.dt - g.t) / {_SCALE}) / (p.magerr * p.magerr) as w from g join phot p on p.obj_id = g.obj_id and p.band = g.band and p.dt <= 20),
sm as (select obj_id, band, i, any_value(t) as t, sum(w * mag) / sum(w) as mag from w group by obj_id, band, i)"""


def reconstruct(phot, steps=_STEPS, scale=_SCALE, least=3):
    """A kernel smoother (Matern 3/2 weights over errors) on a grid inside each observed g or r span; nothing is extrapolated."""
    own = phot.where("band < 2")
    span = own.groupBy("obj_id", "band").agg(F.min("dt").alias("a"), F.max("dt").alias("b"), F.count_distinct("dt").alias("n")).where(F.col("n") >= least)
    grid = span.select("obj_id", "band", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i")).withColumn("t", F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / F.lit(float(steps)))
    u = F.lit(3**0.5) * F.abs(F.col("dt") - F.col("t")) / F.lit(scale)
    both = grid.join(own.select("obj_id", "band", "dt", "mag", "magerr"), ["obj_id", "band"]).withColumn("w", (1 + u) * F.exp(-u) / (F.col("magerr") * F.col("magerr")))
    out = both.groupBy("obj_id", "band", "i", "t").agg((F.sum(F.col("w") * F.col("mag")) / F.sum("w")).alias("mag"), F.sum("w").alias("w"))
    sd = 1 / F.sqrt("w")
    return out.select("obj_id", "band", "i", "t", "mag", (F.col("mag") - 1.211 * sd).alias("lo68"), (F.col("mag") + 1.211 * sd).alias("hi68"), (F.col("mag") - 3.222 * sd).alias("lo95"), (F.col("mag") + 3.222 * sd).alias("hi95"))


@query("curve_reconstruction", f"{_SMOOTH} select obj_id, band, i::int as i, round(t, 6) + 0.0 as t, round(mag, 5) + 0.0 as mag from sm")
def curve_reconstruction(spark, d):
    return reconstruct(lc.horizon_truncate(_phot(spark, d), 20)).select("obj_id", "band", "i", r6("t").alias("t"), (F.round("mag", 5) + F.lit(0.0)).alias("mag"))


@query("overlay_join", f"{_ANCHOR}, {_SMOOTH}, {_GRID}, hd as (select obj_id, band, max(t) as last from sm group by 1, 2) select obj_id, band, round(t, 6) + 0.0 as t, 'curve' as kind from sm union all select gr.obj_id, gr.band, gr.day, 'forecast' from gr left join hd on gr.obj_id = hd.obj_id and gr.band = hd.band where gr.day > coalesce(last, -1)")
def overlay_join(spark, d):
    """Reconstruction points, then forecast points after their end."""
    curve = reconstruct(lc.horizon_truncate(_phot(spark, d), 20))
    head = curve.groupBy("obj_id", "band").agg(F.max("t").alias("last"))
    grid = _anchors(spark, d).where("band < 2").select("obj_id", "band", F.explode(F.array(*(F.lit(float(x)) for x in _GRID_DAYS))).alias("t"))
    tail = grid.join(head, ["obj_id", "band"], "left").where(F.col("t") > F.coalesce("last", F.lit(-1.0)))
    return curve.select("obj_id", "band", r6("t").alias("t"), F.lit("curve").alias("kind")).union(tail.select("obj_id", "band", r6("t").alias("t"), F.lit("forecast").alias("kind")))


@query("next_observation_value", f"{_ANCHOR}, dr as (select obj_id, band, anchor, q, anchor + 0.3::double * z as m from anch, (values (1, -1.1503493803760079::double), (2, -0.3186393639643752), (3, 0.3186393639643752), (4, 1.1503493803760079)) v(q, z)) select obj_id, band, round(avg((abs(m) < 0.5)::int), 6) + 0.0 as p_close, round(avg(m), 6) + 0.0 as mean_mag from dr group by obj_id, band")
def next_observation_value(spark, d):
    """Four fixed normal quantiles stand for draws of one more observation in each band."""
    z = F.array(*(F.lit(x) for x in (-1.1503493803760079, -0.3186393639643752, 0.3186393639643752, 1.1503493803760079)))
    draws = _anchors(spark, d).select("obj_id", "band", F.explode(F.transform(z, lambda x: F.col("anchor") + 0.3 * x)).alias("m"))
    return draws.groupBy("obj_id", "band").agg(r6(F.avg((F.abs("m") < 0.5).cast("double"))).alias("p_close"), r6(F.avg("m")).alias("mean_mag"))


# similarity

_KNN = """qa as (select vec_id, embedding, vec_id % 20 < 14 as arch, label % 6 as truth from embeddings),
kd as (select q.vec_id as q_id, a.vec_id as a_id, a.truth, q.truth as q_truth, round({dist}, 9) as dist from qa q join qa a on a.arch and not q.arch and q.vec_id % 20 >= 17),
kn as (select *, row_number() over (partition by q_id order by dist, a_id) as place from kd)"""
_COS = _KNN.format(dist="1 - list_sum(list_transform(list_zip(q.embedding, a.embedding), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x::double))))")
_EUC = _KNN.format(dist="sqrt(list_sum(list_transform(list_zip(q.embedding, a.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))))")


def _sides(spark, d):
    s = src.scores(spark, d).select(F.col("obj_id").alias("id"), F.col("emb").alias("v"), "split", "truth")
    return s.where("split = 'test'"), s.where("split = 'train'")


@query("knn_cosine", f"{_COS} select q_id, a_id, place from kn where place <= 5")
def knn_cosine(spark, d):
    return nb.knn_all(*_sides(spark, d)).select("q_id", "a_id", F.col("place").cast("long").alias("place"))


@query("knn_euclidean", f"{_EUC} select q_id, a_id, place from kn where place <= 5")
def knn_euclidean(spark, d):
    return nb.knn_all(*_sides(spark, d), metric="euclidean").select("q_id", "a_id", F.col("place").cast("long").alias("place"))


def _hundredth(spark, d):
    """Every vector whose id is divisible by 100 against all vectors."""
    s = src.scores(spark, d).select(F.col("obj_id").alias("id"), F.col("emb").alias("v"))
    return s.where(F.col("id") % 100 == 0), s


@query("knn_metric_index", """kd as (select q.vec_id as q_id, a.vec_id as a_id, round(sqrt(list_sum(list_transform(list_zip(q.embedding, a.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))), 9) as dist
  from embeddings q join embeddings a on q.vec_id % 100 = 0 and a.vec_id <> q.vec_id), kn as (select *, row_number() over (partition by q_id order by dist, a_id) as place from kd) select q_id, a_id, place from kn where place <= 5""")
def knn_metric_index(spark, d):
    """Exact neighbours through the metric index, which leaves out what the triangle inequality rules out."""
    asked, archive = _hundredth(spark, d)
    return metric.metric_knn(asked, metric.metric_index(archive))[0].select("q_id", "a_id", F.col("place").cast("long").alias("place"))


@query("metric_index_work")
def metric_index_work(spark, d):
    """How many distances the search through the metric index computes, of how many there are."""
    asked, archive = _hundredth(spark, d)
    n, m = asked.count(), archive.count()
    computed = metric.metric_knn(asked, metric.metric_index(archive))[1]
    return spark.createDataFrame([(n, m, computed, computed / max(n * m, 1))], "queries long, rows long, computed long, share double")


@query("kth_distance_score", f"{_EUC} select q_id, round(max(dist) filter (where place = 5), 6) + 0.0 as kth, round(avg(dist) filter (where place <= 5), 6) + 0.0 as mean_dist from kn where place <= 5 group by q_id")
def kth_distance_score(spark, d):
    k = nb.knn_all(*_sides(spark, d), metric="euclidean")
    return k.groupBy("q_id").agg(r6(F.max(F.when(F.col("place") == 5, F.col("dist")))).alias("kth"), r6(F.avg("dist")).alias("mean_dist"))


@query("knn_vote", f"{_COS}, v as (select q_id, truth, count(*) as n from kn where place <= 5 group by 1, 2) select q_id, arg_max(truth, (n, -truth)) as vote from v group by q_id")
def knn_vote(spark, d):
    asked, archive = _sides(spark, d)
    v = nb.knn_all(asked, archive).join(archive.select(F.col("id").alias("a_id"), "truth"), "a_id").groupBy("q_id", "truth").agg(F.count("*").alias("n"))
    return v.groupBy("q_id").agg(F.max(F.struct("n", (-F.col("truth")).alias("t"))).alias("b")).select("q_id", (-F.col("b.t")).alias("vote"))


@query("neighbour_enrichment", f"{_COS} select q_truth as truth, count(*) as n, round(avg((truth = q_truth)::int), 6) + 0.0 as same from kn where place <= 5 group by 1")
def neighbour_enrichment(spark, d):
    asked, archive = _sides(spark, d)
    k = nb.knn_all(asked, archive).join(archive.select(F.col("id").alias("a_id"), F.col("truth").alias("a_truth")), "a_id").join(asked.select(F.col("id").alias("q_id"), "truth"), "q_id")
    return k.groupBy("truth").agg(F.count("*").alias("n"), r6(F.avg((F.col("truth") == F.col("a_truth")).cast("double"))).alias("same"))


def _indexed(spark, d):
    """The test rows, and every row."""
    asked, _ = _sides(spark, d)
    return asked, src.scores(spark, d).select(F.col("obj_id").alias("id"), F.col("emb").alias("v"))


@query("ivf_search")
def ivf_search(spark, d):
    asked, every = _indexed(spark, d)
    return nb.ivf_search(asked, nb.cell_index(every))


@query("recall_at_k")
def recall_at_k(spark, d):
    """Share of the exact five neighbours among all rows that the cell search finds, with its number of cells and those that a query looks at."""
    asked, every = _indexed(spark, d)
    index = nb.cell_index(every)
    exact = nb.knn_all(asked, every, metric="euclidean").groupBy("q_id").agg(F.collect_set("a_id").alias("e"))
    found = nb.ivf_search(asked, index).groupBy("q_id").agg(F.collect_set("a_id").alias("f"))
    hit = F.size(F.array_intersect("e", F.coalesce("f", F.array().cast("array<bigint>")))) / F.size("e")
    n = exact.join(found, "q_id", "left").agg(F.count("*").alias("n"), r6(F.avg(hit)).alias("recall"))
    return n.withColumns({"cells": F.lit(len(index.centres)), "probes": F.lit(index.probes)})


@query("pca_map")
def pca_map(spark, d):
    """Coordinates on the first two axes, and the share of the variance that each axis explains. An axis points where its largest loading is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = src.scores(spark, d).select("obj_id", array_to_vector(F.transform("emb", lambda x: x.cast("double"))).alias("f"))
    m = PCA(k=2, inputCol="f", outputCol="pc").fit(v)
    axes, shares = m.pc.toArray(), m.explainedVariance.toArray()
    signs = [1.0 if axis[abs(axis).argmax()] >= 0 else -1.0 for axis in axes.T]
    got = m.transform(v).withColumn("a", vector_to_array("pc"))
    return got.select("obj_id", *(r6(F.col("a")[i] * F.lit(x)).alias(f"pc{i + 1}") for i, x in enumerate(signs)), *(r6(F.lit(float(x))).alias(f"explained{i + 1}") for i, x in enumerate(shares)))


@query("nearest_centroid_baseline", "u as (select vec_id, label % 6 as truth, vec_id % 20 < 14 as fit, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as j from embeddings), c as (select truth, j, avg(x) as m from u where fit group by 1, 2), dd as (select u.vec_id, c.truth as cls, sum((x - m) * (x - m)) as d from u join c on u.j = c.j where not fit group by 1, 2) select vec_id as obj_id, arg_min(cls, (round(d, 9), cls)) as cls from dd group by 1")
def nearest_centroid_baseline(spark, d):
    """Class means and the nearest of them; means are classes x dimensions numbers."""
    u = src.scores(spark, d).select("obj_id", "truth", "split", F.posexplode("emb").alias("j", "x")).withColumn("x", F.col("x").cast("double"))
    c = u.where("split = 'train'").groupBy(F.col("truth").alias("cls"), "j").agg(F.avg("x").alias("m"))
    c = c.groupBy("j").agg(F.collect_list(F.struct("cls", "m")).alias("ms"))
    dd = u.where("split <> 'train'").join(F.broadcast(c), "j").select("obj_id", "x", F.inline("ms")).groupBy("obj_id", "cls").agg(F.round(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m"))), 9).alias("d"))
    return dd.groupBy("obj_id").agg(F.min(F.struct("d", "cls"))["cls"].alias("cls"))
