"""Queries that train MLlib models. Model output is not SQL; the tables that go into training are."""

from __future__ import annotations

from statistics import median

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import boosting, heads, leaves, models, nextpoint, ranking, search
from ..operators import neighbours as nb
from ..sources import adapters as src
from ..sources import io
from .base import query, r6
from .curves import _phot, features
from .tables import _ANCHOR, _future, _recent

#: Values of an embedding; models take all of them.
N = 64
COLS = [f"x{i}" for i in range(N)]


def _rows(spark, d):
    s = src.scores(spark, d)
    return s.select("obj_id", F.col("truth").cast("double").alias("truth"), "novel", "fold", "split", "raw", *(F.element_at("emb", i + 1).cast("double").alias(f"x{i}") for i in range(N)))


def _named(df):
    return df.select("obj_id", *(r6(F.element_at("p", i + 1)).alias(f"p{i}") for i in range(6)))


@query("class_weights", "n as (select truth, count(*) as n from sco group by truth) select s.obj_id, round(pow((select sum(n) from n) / ((select count(*) from n) * n.n), 0.5), 6) + 0.0 as weight from sco s join n on s.truth = n.truth")
def class_weights(spark, d):
    return models.class_weights(src.scores(spark, d)).select("obj_id", r6("weight").alias("weight"))


@query("object_weights", f"{_ANCHOR}, fu as (select p.obj_id, p.dt as day from phot p join anch a on p.obj_id = a.obj_id and p.band = a.band where p.dt > 10 and p.dt <= 90 and p.band < 2) select obj_id, round(day, 6) + 0.0 as day, round(1.0::double / count(*) over (partition by obj_id) * (select count(*) from fu) / (select count(distinct obj_id) from fu), 6) + 0.0 as weight from fu")
def object_weights(spark, d):
    return models.object_weights(_future(spark, d)).select("obj_id", r6("day").alias("day"), r6("weight").alias("weight"))


_SHARE = "(('0x' || substr(md5(obj_id || '/{}'), 1, 8))::bigint / 4294967296.0::double)"


@query("context_dropout", f"select obj_id, case when {_SHARE.format('host')} >= 0.3 then truth end as a, case when {_SHARE.format('z')} >= 0.3 then fold end as b from sco")
def context_dropout(spark, d):
    s = src.scores(spark, d).select("obj_id", F.col("truth").alias("a"), F.col("fold").alias("b"))
    return models.context_dropout(s, {"host": ["a"], "z": ["b"]})


@query("multiview_augment", f"v as (select obj_id, truth, 0 as view from sco union all select obj_id, case when {_SHARE.format('host#1')} >= 0.4 then truth end, 1 from sco union all select obj_id, case when {_SHARE.format('host#2')} >= 0.4 then truth end, 2 from sco union all select obj_id, case when {_SHARE.format('host#3')} >= 0.4 then truth end, 3 from sco) select obj_id, truth as a, view, 0.25::double as weight from v")
def multiview_augment(spark, d):
    return models.multiview(src.scores(spark, d).select("obj_id", F.col("truth").alias("a")), {"host": ["a"]})


@query("train_hierarchy")
def train_hierarchy(spark, d):
    r = _rows(spark, d)
    return _named(boosting.predict_hierarchy(boosting.train_hierarchy(r.where("split = 'train'"), COLS), r.where("split <> 'train'")))


@query("boosting_rounds")
def boosting_rounds(spark, d):
    """The trees that each model of the hierarchy kept, of how many at most, and the loss of the validation split beside that of a forest."""
    r = _rows(spark, d)
    fit, held = r.where("split = 'train'"), r.where("split = 'val'")
    h = boosting.train_hierarchy(fit, COLS)
    boosted = boosting.predict_hierarchy(h, held).agg(boosting.log_loss(held).alias("loss")).first()["loss"]
    plain = models.probabilities(models.forest(models.class_weights(fit), COLS, weight="weight"), held).agg(boosting.log_loss(held).alias("loss")).first()["loss"]
    rows = [("top", k, n) for k, n in enumerate(h.top.rounds)] + [("branch", 0, n) for n in h.branch.rounds]
    kept = spark.createDataFrame([(level, k, n, boosting.Settings().most_rounds) for level, k, n in rows], "level string, class int, rounds int, most_rounds int")
    return kept.withColumns({"loss": r6(F.lit(boosted)), "forest_loss": r6(F.lit(plain))})


@query("classify_features")
def classify_features(spark, d):
    """From light curves to sets: the feature table, the two-level model on its training objects, thresholds by class on the validation
    objects, and for each test object the probabilities, the label and the set."""
    f = io.stored(features(spark, d).join(src.scores(spark, d).select("obj_id", F.col("truth").cast("double").alias("truth"), "split"), "obj_id"), "features")
    fit = f.where("split = 'train'")
    # a column without any value in training tells trees nothing
    seen = fit.agg(*(F.count(c).alias(c) for c in f.columns)).first()
    columns = [c for c in f.columns if c not in ("obj_id", "truth", "split") and seen[c]]
    rows = models.with_missing(f.withColumns({c: F.col(c).cast("double") for c in columns}), columns)
    p = boosting.predict_hierarchy(boosting.train_hierarchy(rows.where("split = 'train'"), columns, impute=True), rows.where("split <> 'train'"))
    p = io.stored(p.select("obj_id", F.col("truth").cast("int").alias("truth"), "split", "p"), "probabilities")
    long = p.where("split = 'val'").select("obj_id", "truth", F.posexplode("p").alias("cls", "p"))
    q = heads.calibrate(long.where("cls = truth").select("cls", (1 - F.col("p")).alias("s")), ["cls"])
    limits = q.agg(F.map_from_entries(F.collect_list(F.struct("cls", "q"))).alias("limits"))
    test = p.where("split = 'test'").join(F.broadcast(limits))  # one row
    # a class without a threshold stays in every set
    inside = F.filter(F.transform("p", lambda x, i: F.when(1 - x <= F.coalesce(F.try_element_at("limits", i), F.lit(1.0)), i)), lambda x: x.isNotNull())
    label = F.element_at(F.array(*map(F.lit, heads.CLASSES)), F.array_position("p", F.array_max("p")).cast("int"))
    return test.select("obj_id", *(r6(F.element_at("p", i + 1)).alias(f"p_{c.lower()}") for i, c in enumerate(heads.CLASSES)), label.alias("label"), inside.alias("set"))


@query("next_observation_sets")
def next_observation_sets(spark, d, horizon=10.0, draws=16, seed=0):
    """What one more g or r point on the night after the horizon is worth to each test object: how much smaller its prediction set gets.

    The model sees prefixes of the horizon's length, its thresholds by class are those of the validation objects, and so is the scatter of the
    next point around its forecast.
    """
    phot = io.stored(_phot(spark, d), "photometry")
    sums = io.stored(nextpoint.prefix_sums(phot, horizon).join(src.scores(spark, d).select("obj_id", F.col("truth").cast("double").alias("truth"), "split"), "obj_id"), "prefix-sums")
    fit = nextpoint.with_features(sums.where("split = 'train'"))
    seen = fit.agg(*(F.count(c).alias(c) for c in nextpoint.FEATURES)).first()
    columns = [c for c in nextpoint.FEATURES if seen[c]]
    m = models.forest(models.class_weights(models.with_missing(fit, columns)), columns, weight="weight", impute=True)
    asked = lambda rows: models.probabilities(m, models.with_missing(nextpoint.with_features(rows), columns))
    val = sums.where("split = 'val'")
    own = asked(val).select(F.col("truth").cast("int").alias("cls"), (1 - F.element_at("p", F.col("truth").cast("int") + 1)).alias("s"))
    limits = {r["cls"]: r["q"] for r in heads.calibrate(own, ["cls"]).collect()}  # one row a class
    limit = F.array(*(F.lit(float(limits[c]) if limits.get(c) is not None else 1.0) for c in range(len(heads.CLASSES))))
    sized = lambda rows: asked(rows).withColumn("size", F.size(F.filter(F.zip_with("p", limit, lambda p, q: 1 - p <= q), lambda x: x)))
    later = phot.where((F.col("dt") > horizon) & (F.col("dt") <= horizon + 2)).groupBy("obj_id", "band").agg(F.min_by("mag", "dt").alias("mag"))
    told = val.select("obj_id", F.inline(F.array(*(F.struct(F.lit(b).alias("band"), mean.alias("mean")) for b, mean in enumerate(nextpoint.forecast_next(horizon))))))
    off = told.join(later, ["obj_id", "band"]).select("band", F.abs(F.col("mag") - F.col("mean")).alias("e")).where("e is not null")
    measured = {r["band"]: r["scatter"] for r in ranking.quantiles(off, ["band"], "e", {"scatter": 0.68}, F.floor(F.col("e") * 64)).collect()}  # two rows
    scatter = spark.createDataFrame([(b, float(measured.get(b) or 0.3)) for b in (0, 1)], "band int, scatter double")
    test = sums.where("split = 'test'")
    value = nextpoint.set_value(sized(test), sized(nextpoint.drawn(test, horizon, scatter, draws, seed)))
    return value.select("obj_id", "band", "set_before", *(r6(c).alias(c) for c in ("mean_set", "delta_s", "p_singleton")), "best")


@query("train_five_class")
def train_five_class(spark, d):
    """The flat model over five broad groups, with its sets at a fixed mass."""
    r = _rows(spark, d).withColumn("truth", F.least("truth", F.lit(4.0)))
    p = models.probabilities(models.forest(models.class_weights(r.where("split = 'train'")), COLS, weight="weight"), r.where("split = 'test'"))
    return p.select("obj_id", (F.array_position("p", F.array_max("p")) - 1).alias("cls"), F.filter(F.transform("p", lambda x, i: F.when(x > 0.2, i)), lambda x: x.isNotNull()).alias("set"))


@query("oof_predictions")
def oof_predictions(spark, d):
    return _named(models.out_of_fold(_rows(spark, d), COLS, trees=6, depth=3))


@query("round_selection_cv")
def round_selection_cv(spark, d):
    """Boosting rounds: the median over the five folds of the round with the smallest held-out error of the branch model, and the loss of
    the model refitted on all rows with so many."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier

    r = _rows(spark, d).withColumn("y", (F.col("truth") == 2).cast("double"))
    boosted = lambda rounds: Pipeline(stages=[*models.prepared(COLS), GBTClassifier(labelCol="y", featuresCol="features", maxIter=rounds, maxDepth=2, seed=7)])
    best = []
    for k in range(5):
        fit, held = r.where(F.col("fold") != k), r.where(F.col("fold") == k)
        m = boosted(6).fit(fit)
        loss = m.stages[-1].evaluateEachIteration(m.stages[0].transform(held))
        best.append((k, min(range(len(loss)), key=loss.__getitem__) + 1))
    chosen = int(median(rounds for _, rounds in best))
    m = boosted(chosen).fit(r)
    loss = m.stages[-1].evaluateEachIteration(m.stages[0].transform(r))[-1]
    return spark.createDataFrame([(k, rounds, float(chosen), float(loss)) for k, rounds in best], "fold int, rounds int, chosen double, refit_loss double")


@query("hyperparameter_search")
def hyperparameter_search(spark, d, points=6):
    """Successive halving from the default and sampled points, on folds of the training and validation objects; one row for each fit, best first in its round."""
    r = _rows(spark, d).where("split <> 'test'").select("obj_id", "truth", *COLS)
    default = search.Point(4, 0.5, len(COLS))
    asked = [default, *(p for p in search.sampled_points(points, len(COLS)) if p != default)][:points]
    tried = search.halving(r, COLS, asked)
    rows = [(t.stage, t.trees, *t.point, t.f1, t.auprc, t.score, t.kept) for t in tried]
    out = spark.createDataFrame(rows, "stage int, trees int, depth int, beta double, columns int, f1 double, auprc double, score double, kept boolean")
    return out.withColumns({c: r6(c) for c in ("f1", "auprc", "score")})


@query("train_energy_space")
def train_energy_space(spark, d):
    """Energy of a model on fewer columns."""
    from pyspark.ml.functions import vector_to_array

    r = _rows(spark, d)
    m = models.logistic(r.where("split = 'train'"), COLS[:4], "truth", balanced=False)
    return m.transform(r.where("split = 'test'")).select("obj_id", r6(heads.energy(vector_to_array("rawPrediction"))).alias("energy"))


@query("balanced_logistic")
def balanced_logistic(spark, d):
    """One score to a probability, both classes weighing the same."""
    e = _rows(spark, d).withColumn("e", heads.energy(F.col("raw"))).withColumn("y", F.col("novel").cast("double"))
    m = models.logistic(e.where("split <> 'test'"), ["e"], "y")
    return models.probabilities(m, e.where("split = 'test'")).select("obj_id", r6(F.element_at("p", 2)).alias("p"))


@query("isotonic_calibration")
def isotonic_calibration(spark, d):
    from pyspark.ml.regression import IsotonicRegression

    p = heads.long_probabilities(src.scores(spark, d)).where("cls = 0").withColumn("y", (F.col("truth") == 0).cast("double"))
    m = IsotonicRegression(featuresCol="p", labelCol="y").fit(p.where("split = 'val'"))
    return m.transform(p.where("split = 'test'")).select("obj_id", r6("p").alias("score"), r6("prediction").alias("calibrated"))


@query("review_combiner_fit")
def review_combiner_fit(spark, d):
    """Logistic over two standardised scorers against the review labels, out of fold."""
    from pyspark.ml.functions import vector_to_array

    lab = src.table(spark, d, "labels").select(F.col("doc_id").alias("obj_id"), F.col("quality").cast("double").alias("y"))
    e = _rows(spark, d).withColumn("e", heads.energy(F.col("raw"))).withColumn("m", F.array_max(heads.softmax(F.col("raw")))).join(lab, "obj_id").where("y is not null")
    out = None
    for k in range(5):
        got = models.logistic(e.where(F.col("fold") != k), ["e", "m"], "y").transform(e.where(F.col("fold") == k)).select("obj_id", r6(vector_to_array("probability")[1]).alias("p"))
        out = got if out is None else out.unionByName(got)
    return out


@query("top_features_by_gain")
def top_features_by_gain(spark, d):
    gain = models.forest(_rows(spark, d).where("split = 'train'"), COLS).stages[-1].featureImportances
    return spark.createDataFrame([(c, float(gain[i])) for i, c in enumerate(COLS)], "feature string, gain double").orderBy(F.desc("gain"), "feature")


@query("feature_ablation")
def feature_ablation(spark, d):
    """Accuracy of the validation split with the first k columns."""
    r, out = _rows(spark, d), None
    for k in (2, 4, 8, N):
        p = models.probabilities(models.forest(r.where("split = 'train'"), COLS[:k], trees=6), r.where("split = 'val'"))
        one = p.agg(F.avg((F.array_position("p", F.array_max("p")) - 1 == F.col("truth")).cast("double")).alias("a")).select(F.lit(k).alias("columns"), r6("a").alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out


@query("leave_one_class_out")
def leave_one_class_out(spark, d):
    """Train without a class, for each class; AUROC of energy and of distance, all its objects against the test rows of the others.

    The distance is the mean to the ten nearest training rows, in columns standardised on these. Both tell only vectors apart, so they are
    made for each distinct vector once; how many rows it stands for counts among the neighbours and in the AUROC. Rows without a vector are left
    out: trees refuse them.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = src.scores(spark, d).select("obj_id", "truth", "split", "emb").where("emb is not null")
    # dealt out, so that models are trained by all tasks however the table was written
    rows = io.stored(rows.repartition("obj_id"), "left-out-rows")
    count = lambda *conditions: F.array(*(F.count_if((F.col("truth") == c) & cond) for c in range(6) for cond in conditions))
    vectors = rows.groupBy("emb").agg(F.min("obj_id").alias("id"), count(F.col("split") == "train").alias("train"), count(F.col("split") == "test").alias("test"), count(F.lit(True)).alias("every"))
    vectors = io.stored(vectors, "left-out-vectors")
    others = lambda name, c: F.aggregate(name, F.lit(0).cast("long"), lambda s, n: s + n) - F.element_at(name, c + 1)
    vector = array_to_vector(F.col("emb").cast("array<double>"))
    train = rows.where("split = 'train' and truth is not null").withColumn("features", vector)
    spread = lambda c: Summarizer.metrics("mean", "std", "count").summary(F.col("features"), (F.col("truth") != c).cast("double"))
    spreads, out = train.agg(*(spread(c).alias(f"of{c}") for c in range(6))).first(), None
    for c in range(6):
        fit = train.where(F.col("truth") != c).withColumn("truth", F.when(F.col("truth") > c, F.col("truth") - 1).otherwise(F.col("truth")).cast("double"))
        m = models.forest(fit, None, trees=6)
        asked = vectors.withColumns({"n_out": F.element_at("every", c + 1), "n_in": others("test", c)}).where("n_out + n_in > 0")
        e = m.transform(asked.withColumn("features", vector)).select("id", "n_out", "n_in", heads.energy(vector_to_array("rawPrediction")).alias("energy"))
        n = spreads[f"of{c}"]["count"]
        mean, std = spreads[f"of{c}"]["mean"].toArray(), spreads[f"of{c}"]["std"].toArray() * (max(n - 1, 0) / max(n, 1)) ** 0.5
        v = F.zip_with(F.zip_with(F.col("emb"), F.lit(mean.tolist()), lambda x, y: x.cast("double") - y), F.lit([x or 1.0 for x in std.tolist()]), lambda x, y: x / y)
        known = vectors.withColumn("n", others("train", c)).where("n > 0")
        # a vector of both sides has two ids: its training rows are neighbours of its asked ones
        near = nb.knn_all(asked.select((F.col("id") * 2).alias("id"), v.alias("v")), known.select((F.col("id") * 2 + 1).alias("id"), v.alias("v")), 10, "euclidean", 1 << 15)
        near = near.join(known.where("n > 1").select((F.col("id") * 2 + 1).alias("a_id"), "n"), "a_id", "left").withColumn("n", F.coalesce("n", F.lit(1)))
        before = F.sum("n").over(Window.partitionBy("q_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
        near = near.withColumn("n", F.least("n", 10 - F.coalesce(before, F.lit(0)))).where("n > 0")
        distance = near.groupBy(F.shiftright("q_id", 1).alias("id")).agg((F.sum(F.col("n") * F.col("dist")) / F.sum("n")).alias("distance"))
        one = e.join(distance, "id").drop("id").withColumn("cls", F.lit(c))
        out = one if out is None else out.unionByName(one)
    out = io.stored(out, "left-out")
    return _weighted_auroc(out, "energy").join(_weighted_auroc(out, "distance"), "cls")


def _weighted_auroc(scored, x):
    """Of rows (cls, x, n_out, n_in), each standing for so many rows of either side: how often x is larger among those left out, ties half."""
    per = scored.where(F.col(x).isNotNull()).groupBy("cls", x).agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))
    r = ranking.running(per, ["cls"], [x], F.floor(F.col(x) * 1024), {"upto": F.col("n_in")})
    above = F.sum(F.col("n_out") * (F.col("upto") - F.col("n_in") / 2))
    return r.groupBy("cls").agg(r6(above / F.nullif(F.sum("n_out") * F.sum("n_in"), F.lit(0))).alias(f"{x}_auroc"))


def _forecast_rows(spark, d):
    f = _future(spark, d).join(_recent(spark, d), ["obj_id", "band"], "left")
    x = ["anchor", "day", "band_", "age", "slope_", "scatter_"]
    f = f.withColumn("band_", F.col("band").cast("double")).withColumn("slope_", F.coalesce("slope", F.lit(0.0))).withColumn("scatter_", F.coalesce("scatter", F.lit(0.0))).withColumn("held", F.col("obj_id") % 4 == 0)
    return models.object_weights(f), x


def _forecaster(f, x, shares):
    """The median model, and quantiles of its residuals in the leaves of trees on their size, counted on objects that neither was fitted to."""
    calibration = boosting.held_out(F.col("obj_id"), 0.4, "leaves")
    fit = f.where(~F.col("held") & ~calibration)
    m = models.boosted_regressor(fit, x, "target", "weight")
    residuals = lambda rows: m.transform(rows).withColumn("residual", F.col("target") - F.col("prediction")).select(*rows.columns, "residual")
    return m, leaves.fit_leaf_quantiles(residuals(fit), residuals(f.where(~F.col("held") & calibration)), x, "residual", "weight", shares)


@query("train_forecaster")
def train_forecaster(spark, d):
    """Absolute-loss forecast; the band is the 16% and 84% quantile of the residuals in a row's leaves."""
    f, x = _forecast_rows(spark, d)
    m, bands = _forecaster(f, x, [0.16, 0.84])
    out = leaves.with_quantiles(bands, m.transform(f.where("held")).select("obj_id", "band", *x, "target", "prediction"), [0.16, 0.84])
    return out.select("obj_id", "band", r6("day").alias("day"), r6("target").alias("target"), r6("prediction").alias("median"), r6(F.col("prediction") + F.col("q")[0]).alias("lo"), r6(F.col("prediction") + F.col("q")[1]).alias("hi"))


@query("forecast_leaves")
def forecast_leaves(spark, d):
    """Each tree's leaves (-1: all of a tree): the weight of the calibration rows in it, and its quantiles."""
    f, x = _forecast_rows(spark, d)
    table = _forecaster(f, x, [0.16, 0.5, 0.84])[1].table
    return table.select("tree", "leaf", r6("weight").alias("weight"), *(r6(F.col("q")[i]).alias(n) for i, n in enumerate(("q16", "q50", "q84"))))


@query("train_real_delta")
def train_real_delta(spark, d):
    """The change from the anchor on real future rows, each object weighing the same."""
    f, x = _forecast_rows(spark, d)
    m = models.boosted_regressor(f.where("not held").withColumn("delta", F.col("target") - F.col("anchor")), x, "delta", "weight")
    return m.transform(f.where("held")).select("obj_id", "band", r6("day").alias("day"), r6(F.col("anchor") + F.col("prediction")).alias("forecast"))


@query("forecast_grid")
def forecast_grid(spark, d):
    """The forecaster on a day grid: the median, and the residuals' quantiles for 68% and 95%, 0.05 from it at least."""
    f, x = _forecast_rows(spark, d)
    shares = [0.025, 0.16, 0.84, 0.975]
    m, bands = _forecaster(f, x, shares)
    grid = f.where("held").dropDuplicates(["obj_id", "band"]).withColumn("day", F.explode(F.array(*(F.lit(float(t)) for t in (11, 15, 20, 25, 30, 40, 50, 60, 75, 90)))))
    out = leaves.with_quantiles(bands, m.transform(grid.select("obj_id", "band", *x)).select("obj_id", "band", *x, "prediction"), shares)
    wide = lambda i, s, least: F.col("prediction") + (F.least if s < 0 else F.greatest)(F.col("q")[i], F.lit(s * least))
    return out.select("obj_id", "band", "day", r6("prediction").alias("mag"), *(r6(wide(i, s, 0.05)).alias(n) for n, i, s in (("lo68", 1, -1), ("hi68", 2, 1), ("lo95", 0, -1), ("hi95", 3, 1))))


@query("train_parameter_models")
def train_parameter_models(spark, d):
    """Regressors for four parameters with conformal half-widths from the validation rows."""
    targets = ("t0", "mb", "x1", "c")
    r, out = _rows(spark, d).withColumns({t: F.element_at("raw", i + 1) for i, t in enumerate(targets)}), None
    for target in targets:
        m = models.boosted_regressor(r.where("split = 'train'"), COLS[len(targets) :], target)
        cal = m.transform(r.where("split = 'val'")).select(F.lit(0).alias("g"), F.abs(F.col(target) - F.col("prediction")).alias("s"))
        q = heads.calibrate(cal, ["g"], tenths=7).first()["q"]
        one = m.transform(r.where("split = 'test'")).select("obj_id", F.lit(target).alias("parameter"), r6("prediction").alias("value"), r6(F.lit(q)).alias("half_width"))
        out = one if out is None else out.unionByName(one)
    return out
