"""Queries on score vectors: probabilities, conformal sets, anomaly scores, lifetime rates, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calibration, heads, ranking
from ..sources import adapters as src
from ..streaming import replay
from .base import query, r6


def _sco(spark, d):
    return src.scores(spark, d)


def _long(spark, d):
    return heads.long_probabilities(_sco(spark, d))


def _probs(spark, d):
    return _sco(spark, d).withColumn("p", heads.softmax(F.col("raw")))


@query("softmax_scores", "select obj_id, cls::bigint as cls, round(p, 6) + 0.0 as p from plong")
def softmax_scores(spark, d):
    return _long(spark, d).select("obj_id", F.col("cls").cast("long").alias("cls"), r6("p").alias("p"))


_H = """h as (select obj_id, truth, fold, list_transform(raw[1:5], lambda x: exp(x - list_max(raw[1:5])) / list_sum(list_transform(raw[1:5], lambda y: exp(y - list_max(raw[1:5]))))) as t, 1 / (1 + exp(-raw[6])) as b from sco),
hp as (select *, [t[1], t[2] * (1 - b), t[2] * b, t[3], t[4], t[5]] as p from h)"""


def _hier(spark, d):
    return _sco(spark, d).withColumn("t", heads.softmax(F.slice("raw", 1, 5))).withColumn("b", heads.sigmoid(F.element_at("raw", 6))).withColumn("p", heads.hierarchical(F.col("t"), F.col("b")))


@query("hierarchical_probabilities", f"{_H} select obj_id, " + ", ".join(f"round(p[{i + 1}], 6) + 0.0 as p_{c.lower()}" for i, c in enumerate(heads.CLASSES)) + " from hp")
def hierarchical_probabilities(spark, d):
    return _hier(spark, d).select("obj_id", *(r6(F.element_at("p", i + 1)).alias(f"p_{c.lower()}") for i, c in enumerate(heads.CLASSES)))


@query("hierarchical_label", f"{_H} select obj_id, case when list_position(t, list_max(t)) = 2 and b > 0.5 then 'SLSN' else ['SN_Ia', 'SN_CC', 'AGN', 'TDE', 'CV'][list_position(t, list_max(t))] end as label from hp")
def hierarchical_label(spark, d):
    return _hier(spark, d).select("obj_id", heads.hierarchical_label(F.col("t"), F.col("b")).alias("label"))


_E = "en as (select obj_id, truth, novel, fold, split, raw, -(list_max(raw) + ln(list_sum(list_transform(raw, lambda x: exp(x - list_max(raw)))))) as e from sco)"


def _energy(spark, d):
    return _sco(spark, d).withColumn("e", heads.energy(F.col("raw")))


@query("energy_score", f"{_E} select obj_id, round(e, 6) + 0.0 as energy from en")
def energy_score(spark, d):
    return _energy(spark, d).select("obj_id", r6("e").alias("energy"))


@query("ensemble_mean", "select truth, cls::bigint as cls, round(avg(p), 6) + 0.0 as p from plong group by truth, cls")
def ensemble_mean(spark, d):
    return _long(spark, d).groupBy("truth", F.col("cls").cast("long").alias("cls")).agg(r6(F.avg("p")).alias("p"))


@query("logit_scorers", f"{_E} select en.obj_id, round(e, 6) + 0.0 as energy, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 6) + 0.0 as entropy, round(1 - list_max(p), 6) + 0.0 as msp from en join prob on en.obj_id = prob.obj_id")
def logit_scorers(spark, d):
    p = _probs(spark, d)
    return p.select("obj_id", r6(heads.energy(F.col("raw"))).alias("energy"), r6(-heads.total(F.transform("p", lambda x: x * F.ln(x)))).alias("entropy"), r6(1 - F.array_max("p")).alias("msp"))


#: A small numeric tree ensemble in table form: tree, node, feature (index into raw), threshold, left, right, leaf value.
TREES = [(0, 0, 0, 0.0, 1, 2, None), (0, 1, None, None, None, None, -1.0), (0, 2, 1, 0.5, 3, 4, None), (0, 3, None, None, None, None, 1.0), (0, 4, None, None, None, None, 2.0), (1, 0, 2, -0.5, 1, 2, None), (1, 1, None, None, None, None, 0.25), (1, 2, None, None, None, None, -0.75)]


def tree_column(nodes, tree, node=0):
    """One tree as nested conditions, x <= threshold to the left and NULL to the right."""
    _, _, feature, threshold, left, right, leaf = next(n for n in nodes if n[0] == tree and n[1] == node)
    if leaf is not None:
        return F.lit(leaf)
    return F.when(F.element_at("raw", feature + 1) <= threshold, tree_column(nodes, tree, left)).otherwise(tree_column(nodes, tree, right))


@query("score_tree_ensemble", "select obj_id, (case when raw[1] <= 0 then -1.0::double when raw[2] <= 0.5 then 1 else 2 end + case when raw[3] <= -0.5 then 0.25::double else -0.75 end) as raw_score from sco")
def score_tree_ensemble(spark, d):
    return _sco(spark, d).select("obj_id", sum((tree_column(TREES, t) for t in (0, 1)), F.lit(0.0)).alias("raw_score"))


_CAL = """cal as (select cls, 1 - p as s from plong where split = 'val' and cls = truth),
rk as (select cls, s, row_number() over (partition by cls order by s) as r, count(*) over (partition by cls) as n from cal),
q as (select cls, any_value(n) as n, (any_value(n) * 9 + 9 + 9) // 10 as k, coalesce(max(s) filter (where r = (n * 9 + 9 + 9) // 10), 1.0) as q from rk group by cls)"""


def _cal(spark, d):
    return _long(spark, d).where((F.col("split") == "val") & (F.col("cls") == F.col("truth"))).select("cls", (1 - F.col("p")).alias("s"))


@query("conformal_calibrate", f"{_CAL} select cls::bigint as cls, n, k::bigint as k, round(q, 6) + 0.0 as q from q")
def conformal_calibrate(spark, d):
    return heads.calibrate(_cal(spark, d), ["cls"]).select(F.col("cls").cast("long").alias("cls"), "n", "k", r6("q").alias("q"))


@query("finite_sample_quantile", f"{_E}, r as (select fold, e, row_number() over (partition by fold order by e) as r, count(*) over (partition by fold) as n from en) select fold, round(max(e) filter (where r = (n * 9 + 9 + 9) // 10), 6) + 0.0 as q from r group by fold")
def finite_sample_quantile(spark, d):
    return heads.calibrate(_energy(spark, d), ["fold"], "e").select("fold", r6("q").alias("q"))


@query("attainability", f"{_CAL} select cls::bigint as cls, n, n >= 9 as attainable, round(1.0::double / (n + 1), 6) + 0.0 as p_floor from q")
def attainability(spark, d):
    q = heads.calibrate(_cal(spark, d), ["cls"])
    return q.select(F.col("cls").cast("long").alias("cls"), "n", (F.col("n") >= 9).alias("attainable"), r6(1 / (F.col("n") + 1)).alias("p_floor"))


def _sets(spark, d):
    """Per test object: its set as sorted class numbers. The thresholds are one row per class."""
    q = F.broadcast(heads.calibrate(_cal(spark, d), ["cls"]).select("cls", "q"))
    t = _long(spark, d).where("split = 'test'").join(q, "cls").withColumn("inside", 1 - F.col("p") <= F.col("q"))
    return t.groupBy("obj_id", "truth").agg(F.array_sort(F.collect_list(F.when(F.col("inside"), F.col("cls")))).alias("set"))


_SETS = f"{_CAL}, sets as (select obj_id, truth, coalesce(list_sort(list(plong.cls) filter (where 1 - p <= q.q)), []) as set from plong join q on plong.cls = q.cls where split = 'test' group by obj_id, truth)"


@query("prediction_sets", f"{_SETS} select obj_id, array_to_string(set, '|') as set, len(set) as size from sets")
def prediction_sets(spark, d):
    return _sets(spark, d).select("obj_id", F.concat_ws("|", F.col("set").cast("array<string>")).alias("set"), F.size("set").cast("long").alias("size"))


@query("coverage_report", f"{_SETS} select coalesce(truth::varchar, 'all') as cls, count(*) as n, round(avg((list_contains(set, truth))::int), 6) + 0.0 as coverage, round(avg(len(set)), 6) + 0.0 as mean_size from sets group by rollup(truth)")
def coverage_report(spark, d):
    s = _sets(spark, d).withColumn("hit", F.array_contains("set", F.col("truth")).cast("double"))
    return s.rollup("truth").agg(F.count("*").alias("n"), r6(F.avg("hit")).alias("coverage"), r6(F.avg(F.size("set"))).alias("mean_size")).select(F.coalesce(F.col("truth").cast("string"), F.lit("all")).alias("cls"), "n", "coverage", "mean_size")


@query("coverage_binomial_error", f"{_SETS}, c as (select count(*) as n, avg((list_contains(set, truth))::int) as c from sets) select n, round(sqrt(c * (1 - c) / n), 6) + 0.0 as se from c")
def coverage_binomial_error(spark, d):
    c = _sets(spark, d).agg(F.count("*").alias("n"), F.avg(F.array_contains("set", F.col("truth")).cast("double")).alias("c"))
    return c.select("n", r6(F.sqrt(F.col("c") * (1 - F.col("c")) / F.col("n"))).alias("se"))


@query("set_size_profile", f"{_SETS} select len(set) as size, count(*) as n, round(avg((list_contains(set, truth))::int), 6) + 0.0 as correct from sets group by 1")
def set_size_profile(spark, d):
    return _sets(spark, d).groupBy(F.size("set").cast("long").alias("size")).agg(F.count("*").alias("n"), r6(F.avg(F.array_contains("set", F.col("truth")).cast("double"))).alias("correct"))


@query("gate_purity", f"{_SETS} select count(*) as n, round(avg((truth = 0)::int) filter (where set = [0]), 6) + 0.0 as purity, round(avg((set = [0])::int) filter (where truth = 0), 6) + 0.0 as completeness from sets")
def gate_purity(spark, d):
    only = F.col("set") == F.array(F.lit(0))
    s = _sets(spark, d)
    return s.agg(F.count("*").alias("n"), r6(F.avg(F.when(only, (F.col("truth") == 0).cast("double")))).alias("purity"), r6(F.avg(F.when(F.col("truth") == 0, only.cast("double")))).alias("completeness"))


@query("parameter_gate", f"{_SETS} select obj_id, set = [0] as estimate, case when set <> [0] then array_to_string(set, '|') end as abstained_on from sets")
def parameter_gate(spark, d):
    only = F.col("set") == F.array(F.lit(0))
    return _sets(spark, d).select("obj_id", only.alias("estimate"), F.when(~only, F.concat_ws("|", F.col("set").cast("array<string>"))).alias("abstained_on"))


@query("label_withholding", f"{_SETS} select obj_id, case when len(set) = 1 then 'class ' || set[1] when len(set) >= 2 and len(list_filter(set, lambda x: x > 2)) = 0 then 'SN' end as label from sets")
def label_withholding(spark, d):
    s = F.col("set")
    label = F.when(F.size(s) == 1, F.concat(F.lit("class "), F.element_at(s, 1).cast("string"))).when((F.size(s) >= 2) & F.forall(s, lambda x: x <= 2), "SN")
    return _sets(spark, d).select("obj_id", F.when(F.size(s) > 0, label).alias("label"))


def _p_values(spark, d, split="test"):
    """p-value per object and class: (1 + #{calibration score >= own}) / (n + 1)."""
    asked = _long(spark, d).where(F.col("split") == split).withColumn("s", 1 - F.col("p"))
    got = heads.rank_counts(asked, _cal(spark, d), ["cls"], "s", lambda v: F.floor(v * 256))
    return got.withColumn("pv", (1 + F.col("count")) / (F.col("n_ref") + 1))


_PV = f"{_CAL}, pv as (select t.obj_id, t.truth, t.cls, t.p, (1 + (select count(*) from cal c where c.cls = t.cls and c.s >= 1 - t.p)) / ((select count(*) from cal c where c.cls = t.cls) + 1.0::double) as pv from plong t where split = 'test')"


@query("conformal_p_values", f"{_PV} select obj_id, cls::bigint as cls, round(pv, 6) + 0.0 as pv from pv")
def conformal_p_values(spark, d):
    return _p_values(spark, d).select("obj_id", F.col("cls").cast("long").alias("cls"), r6("pv").alias("pv"))


@query("rank_count_lookup", f"{_CAL} select t.obj_id, t.cls::bigint as cls, (select count(*) from cal c where c.cls = t.cls and c.s >= 1 - t.p) as n from plong t where split = 'test'")
def rank_count_lookup(spark, d):
    return _p_values(spark, d).select("obj_id", F.col("cls").cast("long").alias("cls"), F.col("count").alias("n"))


@query("p_value_sets", f"{_PV} select obj_id, coalesce(string_agg(cls::varchar, '|' order by cls) filter (where pv > 0.15), '') as set from pv group by obj_id")
def p_value_sets(spark, d):
    s = _p_values(spark, d).groupBy("obj_id").agg(F.array_sort(F.collect_list(F.when(F.col("pv") > 0.15, F.col("cls")))).alias("set"))
    return s.select("obj_id", F.concat_ws("|", F.col("set").cast("array<string>")).alias("set"))


@query("credibility_confidence", f"{_PV}, r as (select obj_id, pv, row_number() over (partition by obj_id order by pv desc, cls) as r from pv) select obj_id, round(max(pv) filter (where r = 1), 6) + 0.0 as credibility, round(1 - max(pv) filter (where r = 2), 6) + 0.0 as confidence from r group by obj_id")
def credibility_confidence(spark, d):
    s = _p_values(spark, d).groupBy("obj_id").agg(F.sort_array(F.collect_list("pv"), asc=False).alias("v"))
    return s.select("obj_id", r6(F.element_at("v", 1)).alias("credibility"), r6(1 - F.element_at("v", 2)).alias("confidence"))


@query("cross_conformal_coverage", """s as (select fold, cls, 1 - p as s from plong where cls = truth and split <> 'test'), folds as (select unnest(generate_series(0, 4)) as k),
r as (select k, cls, s, row_number() over (partition by k, cls order by s) as r, count(*) over (partition by k, cls) as n from s join folds on fold <> k),
q as (select k, cls, coalesce(max(s) filter (where r = (n * 9 + 9 + 9) // 10), 1.0) as q from r group by k, cls)
select s.fold, count(*) as n, round(avg((s.s <= q.q)::int), 6) + 0.0 as coverage from s join q on s.fold = q.k and s.cls = q.cls group by s.fold""")
def cross_conformal_coverage(spark, d):
    """Leave one fold out: each row goes to the four calibrations of the other folds."""
    s = _long(spark, d).where((F.col("cls") == F.col("truth")) & (F.col("split") != "test")).select("fold", "cls", (1 - F.col("p")).alias("s"))
    other = s.withColumn("without", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("fold <> without")
    q = heads.calibrate(other.select("without", "cls", "s"), ["without", "cls"]).select(F.col("without").alias("fold"), "cls", "q")
    return s.join(F.broadcast(q), ["fold", "cls"]).groupBy("fold").agg(F.count("*").alias("n"), r6(F.avg((F.col("s") <= F.col("q")).cast("double"))).alias("coverage"))


@query("threshold_vs_sets", "select truth, count(*) as n, round(avg((list_max(p) >= 0.9)::int), 6) + 0.0 as kept, round(avg((list_position(p, list_max(p)) - 1 = truth)::int) filter (where list_max(p) >= 0.9), 6) + 0.0 as correct from prob where split = 'test' group by truth")
def threshold_vs_sets(spark, d):
    p = _probs(spark, d).where("split = 'test'").withColumn("sure", F.array_max("p") >= 0.9)
    right = (F.array_position("p", F.array_max("p")) - 1 == F.col("truth")).cast("double")
    return p.groupBy("truth").agg(F.count("*").alias("n"), r6(F.avg(F.col("sure").cast("double"))).alias("kept"), r6(F.avg(F.when(F.col("sure"), right))).alias("correct"))


_VAT = """va as (select cls, p as s, (cls = truth)::int as y from plong where split = 'val'),
blk as (select cls, s, sum(y) as sy, count(*) as n from va group by cls, s),
cum as (select cls, row_number() over w as i, s, sum(sy) over w as cy, sum(n) over w as cn from blk window w as (partition by cls order by s) union all select distinct cls, 0, null::double, 0, 0 from blk),
pr as (select x.cls, x.i, x.s, b.i as b, max((b.cy - a.cy) / (b.cn - a.cn + 1.0::double)) as m0, max((b.cy - a.cy + 1) / (b.cn - a.cn + 1.0::double)) as m1
  from cum x join cum a on a.cls = x.cls and a.i <= x.i join cum b on b.cls = x.cls and b.i >= x.i group by x.cls, x.i, x.s, b.i),
vat as (select cls, i, s, min(m0) as p0, min(m1) as p1 from pr group by cls, i, s)"""


def _steps(spark, d):
    cal = _long(spark, d).where("split = 'val'").select("cls", F.col("p").alias("s"), (F.col("cls") == F.col("truth")).cast("long").alias("y"))
    return calibration.venn_abers_table(cal, ["cls"])


@query("venn_abers_table", f"{_VAT} select cls::bigint as cls, i, round(s, 6) + 0.0 as s, round(p0, 6) + 0.0 as p0, round(p1, 6) + 0.0 as p1 from vat")
def venn_abers_table_query(spark, d):
    return _steps(spark, d).select(F.col("cls").cast("long").alias("cls"), F.col("i").cast("long").alias("i"), *(r6(c).alias(c) for c in ("s", "p0", "p1")))


@query("venn_abers_intervals", f"{_VAT}, iv as (select t.obj_id, t.cls, (select arg_max(p0, coalesce(v.s, -1)) from vat v where v.cls = t.cls and coalesce(v.s, -1) <= t.p) as lo, (select arg_max(p1, coalesce(v.s, -1)) from vat v where v.cls = t.cls and coalesce(v.s, -1) <= t.p) as hi from plong t where split = 'test'), m as (select *, hi / (1 - lo + hi) as u from iv where lo is not null) select obj_id, cls::bigint as cls, round(least(lo, hi), 6) + 0.0 as lower, round(greatest(lo, hi), 6) + 0.0 as upper, round(u / sum(u) over (partition by obj_id), 6) + 0.0 as merged from m")
def venn_abers_intervals(spark, d):
    """Exact intervals of all test rows and classes, and the merged probabilities, which add up to 1 for each object."""
    got = calibration.venn_abers_intervals(_long(spark, d).where("split = 'test'").select("obj_id", "cls", "p"), _steps(spark, d), ["cls"], "p")
    return got.select("obj_id", F.col("cls").cast("long").alias("cls"), r6("lower").alias("lower"), r6("upper").alias("upper"), r6(F.col("merged") / F.sum("merged").over(Window.partitionBy("obj_id"))).alias("merged"))


@query("anomaly_likelihood_ratio", f"{_E} select obj_id, round(exp(greatest(-50, least(50, 0.8::double * e + 2))) * 0.0326 / (1 - 0.0326::double + exp(greatest(-50, least(50, 0.8::double * e + 2))) * 0.0326), 6) + 0.0 as p_anomaly from en")
def anomaly_likelihood_ratio(spark, d):
    return _energy(spark, d).select("obj_id", r6(heads.anomaly_probability(F.col("e"), 0.8, 2.0, 0.0326)).alias("p_anomaly"))


_NP = f"{_E}, np as (select a.obj_id, a.novel, a.truth, (1 + (select count(*) from en k where k.split = 'val' and not k.novel and k.e >= a.e)) / ((select count(*) from en k where k.split = 'val' and not k.novel) + 1.0::double) as pv from en a where a.split = 'test')"


def _novelty(spark, d):
    e = _energy(spark, d)
    got = heads.rank_counts(e.where("split = 'test'").select("obj_id", "truth", "novel", "e"), e.where("split = 'val' and not novel"), [], "e", lambda v: F.floor(v * 8))
    return got.withColumn("pv", (1 + F.col("count")) / (F.col("n_ref") + 1))


@query("novelty_p_value", f"{_NP} select obj_id, round(pv, 6) + 0.0 as pv from np")
def novelty_p_value(spark, d):
    return _novelty(spark, d).select("obj_id", r6("pv").alias("pv"))


@query("novelty_family_table", f"{_NP} select truth, novel, count(*) as n, count(*) filter (where pv <= 0.1) as flagged from np group by truth, novel")
def novelty_family_table(spark, d):
    return _novelty(spark, d).groupBy("truth", "novel").agg(F.count("*").alias("n"), F.count_if(F.col("pv") <= 0.1).alias("flagged"))


@query("console_status", f"{_NP}, b as (select obj_id, list_position(p, list_max(p)) - 1 as cls, len(list_filter(p, lambda x: x > 0.2)) as size from prob) select np.obj_id, case when pv <= 0.05 then 'anomaly' when cls in (2, 4) and size = 1 then 'follow' when size > 1 then 'ambiguous' else 'routine' end as status from np join b on np.obj_id = b.obj_id")
def console_status(spark, d):
    b = _probs(spark, d).select("obj_id", (F.array_position("p", F.array_max("p")) - 1).alias("cls"), F.size(F.filter("p", lambda x: x > 0.2)).alias("size"))
    status = F.when(F.col("pv") <= 0.05, "anomaly").when(F.col("cls").isin(2, 4) & (F.col("size") == 1), "follow").when(F.col("size") > 1, "ambiguous").otherwise("routine")
    return _novelty(spark, d).join(b, "obj_id").select("obj_id", status.alias("status"))


@query("triage_verdict", f"{_NP}, b as (select obj_id, list_max(p) as pm, len(list_filter(p, lambda x: x > 0.2)) as size from prob) select np.obj_id, case when np.obj_id % 11 = 0 then 'insufficient_data' when np.obj_id % 13 = 0 then 'stellar' when pv <= 0.1 then 'anomaly_review' when pm < 0.4 then 'needs_spectrum' when size > 1 then 'ambiguous' else 'ordinary' end as verdict from np join b on np.obj_id = b.obj_id")
def triage_verdict(spark, d):
    b = _probs(spark, d).select("obj_id", F.array_max("p").alias("pm"), F.size(F.filter("p", lambda x: x > 0.2)).alias("size"))
    verdict = F.when(F.col("obj_id") % 11 == 0, "insufficient_data").when(F.col("obj_id") % 13 == 0, "stellar").when(F.col("pv") <= 0.1, "anomaly_review").when(F.col("pm") < 0.4, "needs_spectrum").when(F.col("size") > 1, "ambiguous").otherwise("ordinary")
    return _novelty(spark, d).join(b, "obj_id").select("obj_id", verdict.alias("verdict"))


@query("triage_queue", f"{_NP} select obj_id, round(pv, 6) + 0.0 as pv, row_number() over (order by pv, obj_id) as place from np order by pv, obj_id limit 50")
def triage_queue(spark, d):
    top = _novelty(spark, d).orderBy("pv", "obj_id").limit(50)
    return top.select("obj_id", r6("pv").alias("pv"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("pv", "obj_id")).alias("place"))


@query("top_k_weirdest", f"{_E} select obj_id, truth, round(e, 6) + 0.0 as energy from en order by e desc, obj_id limit 20")
def top_k_weirdest(spark, d):
    return _energy(spark, d).orderBy(F.desc("e"), "obj_id").limit(20).select("obj_id", "truth", r6("e").alias("energy"))


@query("far_threshold", f"{_E}, t as (select quantile_cont(e, 0.9) as t from en where split = 'val' and not novel) select novel, count(*) as n, count(*) filter (where e > t) as flagged from en, t where split = 'test' group by novel")
def far_threshold(spark, d):
    e = _energy(spark, d)
    t = ranking.quantiles(e.where("split = 'val' and not novel"), [], "e", {"t": 0.9}, F.floor(F.col("e") * 8)).first()["t"]
    return e.where("split = 'test'").groupBy("novel").agg(F.count("*").alias("n"), F.count_if(F.col("e") > F.lit(t)).alias("flagged"))


@query("minp_combination", f"{_NP}, m as (select obj_id, max(pv) as c from (select t.obj_id, 1 - t.p as pv from plong t where split = 'test') group by obj_id) select np.obj_id, round(least(1, 2 * least(np.pv, m.c)), 6) + 0.0 as p from np join m on np.obj_id = m.obj_id")
def minp_combination(spark, d):
    c = _long(spark, d).where("split = 'test'").groupBy("obj_id").agg(F.max(1 - F.col("p")).alias("c"))
    return _novelty(spark, d).join(c, "obj_id").select("obj_id", r6(F.least(F.lit(1.0), 2 * F.least("pv", "c"))).alias("p"))


@query("robust_embedding", """u as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as j, vec_id % 20 < 14 as fit from embeddings),
s as (select j, median(x) as med, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) as iqr from u where fit group by j)
select u.vec_id as obj_id, round(sum(greatest(-10, least(10, (x - med) / case when iqr = 0 then 1 else iqr end))), 4) + 0.0 as s, round(max(greatest(-10, least(10, (x - med) / case when iqr = 0 then 1 else iqr end))), 5) + 0.0 as m from u join s on u.j = s.j group by 1""")
def robust_embedding(spark, d):
    """(x - median) / interquartile range, clipped; one row of statistics per dimension."""
    u = _sco(spark, d).select("obj_id", "split", F.posexplode("emb").alias("j", "x")).withColumn("x", F.col("x").cast("double"))
    s = ranking.quantiles(u.where("split = 'train'"), ["j"], "x", {"med": 0.5, "q3": 0.75, "q1": 0.25}, F.floor(F.col("x") * 32)).withColumn("iqr", F.col("q3") - F.col("q1"))
    z = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (F.col("x") - F.col("med")) / F.when(F.col("iqr") == 0, 1.0).otherwise(F.col("iqr"))))
    return u.join(F.broadcast(s), "j").groupBy("obj_id").agg((F.round(F.sum(z), 4) + F.lit(0.0)).alias("s"), (F.round(F.max(z), 5) + F.lit(0.0)).alias("m"))


_TR = "rm as (select obj_id, k, p, min(p) over (partition by obj_id order by k) as m from traj)"


def _running(spark, d):
    w = Window.partitionBy("obj_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return src.trajectory(spark, d).withColumn("m", F.min("p").over(w))


@query("running_minimum", f"{_TR} select obj_id, k, round(m, 6) + 0.0 as m from rm")
def running_minimum(spark, d):
    return _running(spark, d).select("obj_id", F.col("k").cast("long").alias("k"), r6("m").alias("m"))


@query("replay_schedule", "n as (select user_id as obj_id, count(*) as n from events group by 1) select obj_id, k from (select obj_id, unnest(generate_series(1, n)) as k from n) where k between 3 and 40 or (k > 40 and k % 5 = 0)")
def replay_schedule(spark, d):
    n = src.table(spark, d, "events").groupBy(F.col("user_id").alias("obj_id")).agg(F.count("*").alias("n"))
    steps = F.filter(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda k: k.between(3, 40) | ((k > 40) & (k % 5 == 0)))
    return n.select("obj_id", F.explode(steps).alias("k"))


@query("replay_prefix_ends", """o as (select user_id as obj_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) as k from events)
select obj_id, event_id, round(value, 6) + 0.0 as value, k from o where k between 3 and 40 or (k > 40 and k % 5 = 0)""")
def replay_prefix_ends(spark, d):
    """The event that ends each scheduled prefix of an object, from a table function that sees one row at a time."""
    e = src.table(spark, d, "events").select(F.col("user_id").alias("obj_id"), "ts", "event_id", "value")
    return replay.replay(e, "obj_id", "ts", "event_id").select("obj_id", "event_id", r6("value").alias("value"), "k")


@query("first_crossing", f"{_TR} select obj_id, min(k) filter (where m <= 0.02) as k from rm group by obj_id")
def first_crossing(spark, d):
    return _running(spark, d).groupBy("obj_id").agg(F.min(F.when(F.col("m") <= 0.02, F.col("k"))).cast("long").alias("k"))


_LIFE = f"{_TR}, ref as (select k, m from rm where obj_id % 3 <> 0), kk as (select k, count(*) as n from ref group by k having count(*) >= 5), life as (select a.obj_id, a.k, (1 + (select count(*) from ref r where r.k = a.k and r.m <= a.m)) / (kk.n + 1.0::double) as lp from rm a join kk on a.k = kk.k where a.obj_id % 3 = 0)"


def _lifetime(spark, d):
    """Lifetime p at each analysis of the questioned objects, against the running minima of the others at the same k."""
    m = _running(spark, d)
    got = heads.rank_counts(m.where("obj_id % 3 = 0").select("obj_id", "k", "m"), m.where("obj_id % 3 <> 0"), ["k"], "m", lambda v: F.floor(v * 64), largest_first=False)
    return got.where("n_ref >= 5").withColumn("lp", (1 + F.col("count")) / (F.col("n_ref") + 1))


@query("lifetime_significance", f"{_LIFE} select obj_id, count(*) as n, round(min(lp), 6) + 0.0 as p_life from life group by obj_id")
def lifetime_significance(spark, d):
    return _lifetime(spark, d).groupBy("obj_id").agg(F.count("*").alias("n"), r6(F.min("lp")).alias("p_life"))


@query("lifetime_reading", f"{_LIFE}, o as (select obj_id, min(lp) as f from life group by obj_id) select obj_id, round(f * 6.8 * 7, 6) + 0.0 as per_week, case when f <= 0.005 then 'very rare' when f <= 0.02 then 'rare' when f <= 0.15 then 'uncommon' else 'common' end as words from o")
def lifetime_reading(spark, d):
    o = _lifetime(spark, d).groupBy("obj_id").agg(F.min("lp").alias("f"))
    words = F.when(F.col("f") <= 0.005, "very rare").when(F.col("f") <= 0.02, "rare").when(F.col("f") <= 0.15, "uncommon").otherwise("common")
    return o.select("obj_id", r6(F.col("f") * 6.8 * 7).alias("per_week"), words.alias("words"))


@query("lifetime_reference", f"{_TR}, c as (select k, count(*) as n, round(median(m), 6) + 0.0 as median_m, round(quantile_cont(m, 0.1), 6) + 0.0 as low_m from rm group by k having count(*) >= 5) select * from c")
def lifetime_reference(spark, d):
    q = ranking.quantiles(_running(spark, d).withColumn("k", F.col("k").cast("long")), ["k"], "m", {"median_m": 0.5, "low_m": 0.1}, F.floor(F.col("m") * 64))
    return q.where("n >= 5").select("k", "n", r6("median_m").alias("median_m"), r6("low_m").alias("low_m"))


@query("nearest_reference_index", f"{_TR}, kk as (select k from rm group by k having count(*) >= 40) select distinct rm.k, coalesce((select max(kk.k) from kk where kk.k <= rm.k), (select min(kk.k) from kk)) as ref from rm")
def nearest_reference_index(spark, d):
    """The largest populated index at or below k, else the smallest: one row per index, so one ordered window."""
    per = _running(spark, d).groupBy(F.col("k").cast("long").alias("k")).agg(F.count("*").alias("n"))
    one = Window.partitionBy(F.lit(0))
    full = F.when(F.col("n") >= 40, F.col("k"))
    return per.select("k", F.coalesce(F.max(full).over(one.orderBy("k")), F.min(full).over(one)).alias("ref"))


# evaluation

_PRED = "pred as (select obj_id, truth, fold, list_position(p, list_max(p)) - 1 as cls, list_max(p) as conf, p from prob), conf as (select t.c as truth, q.c as cls, count(pred.obj_id) as n from (select unnest(generate_series(0, 5)) as c) t cross join (select unnest(generate_series(0, 5)) as c) q left join pred on pred.truth = t.c and pred.cls = q.c group by t.c, q.c)"


def _pred(spark, d):
    return _probs(spark, d).select("obj_id", "truth", "fold", (F.array_position("p", F.array_max("p")) - 1).alias("cls"), F.array_max("p").alias("conf"), "p")


def _confusion(spark, d, by=()):
    """Counts of all 36 pairs, zeros included; the frame of pairs is fixed."""
    frame = spark.range(36).select((F.floor(F.col("id") / 6)).alias("truth"), (F.col("id") % 6).alias("cls"))
    n = _pred(spark, d).groupBy(F.col("truth").cast("long").alias("truth"), F.col("cls").cast("long").alias("cls"), *by).agg(F.count("*").alias("n"))
    return frame.join(n, ["truth", "cls"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("confusion_matrix", f"{_PRED} select truth, cls, n from conf")
def confusion_matrix(spark, d):
    return _confusion(spark, d).select("truth", "cls", "n")


@query("classification_metrics", f"{_PRED}, k as (select c, (select sum(n) from conf where truth = c) as nt, (select sum(n) from conf where cls = c) as np, (select n from conf where truth = c and cls = c) as tp from (select distinct truth as c from conf)) select round(sum(tp) / sum(nt), 6) + 0.0 as accuracy, round(avg(tp / nt) filter (where nt > 0), 6) + 0.0 as balanced, round(avg(case when nt + np > 0 then 2 * tp / (nt + np) else 0 end), 6) + 0.0 as macro_f1 from k")
def classification_metrics(spark, d):
    c = _confusion(spark, d)
    k = c.groupBy(F.col("truth").alias("c")).agg(F.sum("n").alias("nt"), F.sum(F.when(F.col("truth") == F.col("cls"), F.col("n")).otherwise(0)).alias("tp")).join(c.groupBy(F.col("cls").alias("c")).agg(F.sum("n").alias("np")), "c")
    return k.agg(r6(F.sum("tp") / F.sum("nt")).alias("accuracy"), r6(F.avg(F.when(F.col("nt") > 0, F.col("tp") / F.col("nt")))).alias("balanced"), r6(F.avg(F.when(F.col("nt") + F.col("np") > 0, 2 * F.col("tp") / (F.col("nt") + F.col("np"))).otherwise(0.0))).alias("macro_f1"))


_BIN = f"{_PRED}, b as (select ceil(conf * 15)::int as bin, count(*) as n, avg(conf) as c, avg((truth = cls)::int) as a from pred group by 1)"


def _bins(spark, d):
    return _pred(spark, d).groupBy(F.ceil(F.col("conf") * 15).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("c"), F.avg((F.col("truth") == F.col("cls")).cast("double")).alias("a"))


@query("expected_calibration_error", f"{_BIN} select round(sum(n * abs(c - a)) / sum(n), 6) + 0.0 as ece from b")
def expected_calibration_error(spark, d):
    return _bins(spark, d).agg(r6(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


@query("reliability_curve", f"{_BIN} select bin, n, round(c, 6) + 0.0 as confidence, round(a, 6) + 0.0 as accuracy from b where n >= 5")
def reliability_curve(spark, d):
    return _bins(spark, d).where("n >= 5").select("bin", "n", r6("c").alias("confidence"), r6("a").alias("accuracy"))


@query("macro_auprc", "r as (select cls, p, sum((cls = truth)::int) as tp, count(*) as n from plong group by cls, p), c as (select cls, p, tp, sum(tp) over (partition by cls order by p desc) as ctp, sum(n) over (partition by cls order by p desc) as cn, sum(tp) over (partition by cls) as pos from r), ap as (select cls, sum(tp / pos * (ctp / cn)) as ap from c where pos > 0 group by cls) select cls::bigint as cls, round(ap, 6) + 0.0 as ap from ap")
def macro_auprc(spark, d):
    return ranking.average_precision(_long(spark, d)).select(F.col("cls").cast("long").alias("cls"), r6("ap").alias("ap"))


_AR = "rk as (select *, rank() over (order by e) + (count(*) over (partition by e) - 1) / 2.0::double as r from en)"


@query("auroc", f"{_E}, {_AR} select round((sum(r) filter (where novel) - count(*) filter (where novel) * (count(*) filter (where novel) + 1) / 2.0::double) / (count(*) filter (where novel) * count(*) filter (where not novel)), 6) + 0.0 as auroc from rk")
def auroc(spark, d):
    """Rank statistic with ties averaged."""
    r = ranking.average_ranks(_energy(spark, d).select("e", "novel"), "e", F.floor(F.col("e") * 8))
    n1, n0 = F.count_if("novel"), F.count_if(~F.col("novel"))
    return r.agg(r6((F.sum(F.when(F.col("novel"), F.col("rank"))) - n1 * (n1 + 1) / F.lit(2.0)) / (n1 * n0)).alias("auroc"))


@query("tpr_at_far", f"{_E}, t as (select quantile_cont(e, 0.99) as t from en where not novel) select round(avg((e > t)::int), 6) + 0.0 as tpr from en, t where novel")
def tpr_at_far(spark, d):
    e = _energy(spark, d)
    t = ranking.quantiles(e.where("not novel"), [], "e", {"t": 0.99}, F.floor(F.col("e") * 8)).first()["t"]
    return e.where("novel").agg(r6(F.avg((F.col("e") > F.lit(t)).cast("double"))).alias("tpr"))


_BOOT = f"""{_PRED}, num as (select truth, row_number() over (partition by truth order by obj_id) - 1 as i, count(*) over (partition by truth) as n, sum((truth = cls)::int) over (partition by truth) as hits from pred),
b as (select rep, avg(((('0x' || substr(md5(rep || '/' || truth || '/' || i), 1, 8))::bigint % n) < hits)::int) as acc from num, (select unnest(generate_series(0, {ranking.REPLICATES - 1})) as rep) group by rep)"""


@query("bootstrap_ci", f"{_BOOT} select round(avg(acc), 6) + 0.0 as mean, round(quantile_cont(acc, 0.025), 6) + 0.0 as lo, round(quantile_cont(acc, 0.975), 6) + 0.0 as hi from b")
def bootstrap_ci(spark, d, n=ranking.REPLICATES):
    """Stratified resampling by hash: each replicate draws as many rows of a class as it has. Rows of a class only differ in being right or
    wrong, so they stand in that order and a drawn place says which: nothing is joined but the counts of the classes."""
    p = _pred(spark, d).select("obj_id", "truth", (F.col("truth") == F.col("cls")).cast("int").alias("ok"))
    num = ranking.places(p, ["truth"], ["obj_id"], F.floor(F.col("obj_id") / 1024)).select("truth", (F.col("place") - 1).alias("i"), F.col("all_place").alias("n"))
    hits = p.groupBy("truth").agg(F.sum("ok").alias("hits"))
    b = ranking.replicated(num.join(F.broadcast(hits), "truth"), n).groupBy("rep").agg(F.avg((ranking.hashed("rep", "truth", "i") % F.col("n") < F.col("hits")).cast("int")).alias("acc"))
    return b.agg(r6(F.avg("acc")).alias("mean"), r6(F.percentile("acc", F.lit(0.025))).alias("lo"), r6(F.percentile("acc", F.lit(0.975))).alias("hi"))


@query("branch_threshold_search", "th as (select 0.05::double + unnest(generate_series(0, 34)) * 0.025::double as t), s as (select obj_id, 1 / (1 + exp(-raw[6])) as b, truth = 2 as y from sco), f as (select t, sum((b > t and y)::int) as tp, sum((b > t)::int) as pp, sum(y::int) as pos from s, th group by t), x as (select t, case when pp + pos > 0 then round(2 * tp / (pp + pos)::double, 9) else 0 end as f1 from f) select round(min(t), 6) + 0.0 as threshold, round(any_value(f1), 6) + 0.0 as f1 from x where f1 = (select max(f1) from x)")
def branch_threshold_search(spark, d):
    """F1 over 35 thresholds; the first maximum wins."""
    s = _sco(spark, d).select(heads.sigmoid(F.element_at("raw", 6)).alias("b"), (F.col("truth") == 2).alias("y"))
    t = s.select("b", "y", F.explode(F.transform(F.sequence(F.lit(0), F.lit(34)), lambda i: F.lit(0.05) + i * F.lit(0.025))).alias("t"))
    f = t.groupBy("t").agg(F.count_if((F.col("b") > F.col("t")) & F.col("y")).alias("tp"), F.count_if(F.col("b") > F.col("t")).alias("pp"), F.count_if("y").alias("pos"))
    f = f.withColumn("f1", F.when(F.col("pp") + F.col("pos") > 0, F.round(2 * F.col("tp") / (F.col("pp") + F.col("pos")), 9)).otherwise(0.0))
    best = f.agg(F.max(F.struct("f1", (-F.col("t")).alias("t"))).alias("x"))
    return best.select(r6(-F.col("x.t")).alias("threshold"), r6("x.f1").alias("f1"))


@query("discovery_curve", f"{_E} select row_number() over (order by e desc, obj_id) as inspected, sum(novel::int) over (order by e desc, obj_id) as found from en where split = 'test'")
def discovery_curve(spark, d):
    e = _energy(spark, d).where("split = 'test'").select("obj_id", "e", "novel")
    got = ranking.running(e, [], [F.desc("e"), "obj_id"], -F.floor(F.col("e") * 8), {"inspected": F.lit(1).cast("long"), "found": F.col("novel").cast("long")})
    return got.select("inspected", "found")


@query("class_feature_summary", f"{_E} select truth, count(*) as n, round(median(e), 6) + 0.0 as median, round(quantile_cont(e, 0.01), 6) + 0.0 as lo, round(quantile_cont(e, 0.99), 6) + 0.0 as hi from en group by truth")
def class_feature_summary(spark, d):
    q = ranking.quantiles(_energy(spark, d), ["truth"], "e", {"median": 0.5, "lo": 0.01, "hi": 0.99}, F.floor(F.col("e") * 8))
    return q.select("truth", "n", *(r6(c).alias(c) for c in ("median", "lo", "hi")))


@query("mean_percentile_rank", f"{_E}, s as (select en.obj_id, e, -list_max(p) as m from en join prob on en.obj_id = prob.obj_id where en.split = 'test'), r as (select obj_id, rank() over (order by e) + (count(*) over (partition by e) - 1) / 2.0::double as a, rank() over (order by m) + (count(*) over (partition by m) - 1) / 2.0::double as b, count(*) over () as n from s) select obj_id, round((a + b) / 2 / n, 6) + 0.0 as consensus from r")
def mean_percentile_rank(spark, d):
    s = _probs(spark, d).where("split = 'test'").select("obj_id", heads.energy(F.col("raw")).alias("e"), (-F.array_max("p")).alias("m"))
    s = ranking.average_ranks(s, "e", F.floor(F.col("e") * 8), "a")
    s = ranking.average_ranks(s, "m", F.floor(F.col("m") * 256), "b")
    return s.select("obj_id", r6((F.col("a") + F.col("b")) / 2 / F.col("all_a")).alias("consensus"))


@query("frozen_percentile_rank", f"{_E} select a.obj_id, round((select count(*) from en k where k.split = 'val' and k.e <= a.e) / (select count(*) from en k where k.split = 'val')::double, 6) + 0.0 as pr from en a where split = 'test'")
def frozen_percentile_rank(spark, d):
    e = _energy(spark, d)
    got = heads.rank_counts(e.where("split = 'test'").select("obj_id", "e"), e.where("split = 'val'"), [], "e", lambda v: F.floor(v * 8), largest_first=False)
    return got.select("obj_id", r6(F.col("count") / F.col("n_ref")).alias("pr"))


@query("review_score", f"{_E}, st as (select avg(e) as me, stddev_pop(e) as se, avg(list_max(p)) as mp, stddev_pop(list_max(p)) as sp from en join prob on en.obj_id = prob.obj_id where en.split = 'train') select en.obj_id, round(0.7 * (e - me) / se - 0.3 * (list_max(p) - mp) / sp + 0.1, 6) + 0.0 as score from en join prob on en.obj_id = prob.obj_id, st where en.split = 'test'")
def review_score(spark, d):
    """A linear score of standardised scorers; four numbers of statistics."""
    s = _probs(spark, d).select("obj_id", "split", heads.energy(F.col("raw")).alias("e"), F.array_max("p").alias("m"))
    st = s.where("split = 'train'").agg(F.avg("e").alias("me"), F.stddev_pop("e").alias("se"), F.avg("m").alias("mp"), F.stddev_pop("m").alias("sp")).first()
    z = lambda c, m, sd: F.coalesce((F.col(c) - F.lit(st[m])) / F.lit(st[sd]), F.lit(0.0))
    return s.where("split = 'test'").select("obj_id", r6(0.7 * z("e", "me", "se") - 0.3 * z("m", "mp", "sp") + 0.1).alias("score"))
