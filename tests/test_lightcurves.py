"""Hand-made light curves: leaks, ties, schedules, gates and edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from duskwave.functions import photometry as ph
from duskwave.operators import heads, models, neighbours, ranking, sky
from duskwave.operators import lightcurve as lc
from duskwave.sources import io
from duskwave.streaming import jobs

DET = "obj_id long, mjd double, fid int, mag double, magerr double"


def phot(spark, rows):
    return lc.photometry(spark.createDataFrame([(1, *r) for r in rows] if len(rows[0]) == 4 else rows, DET))


def test_colours_never_look_past_the_cut(spark):
    rows = [(0.0, 1, 18.0, 0.1), (0.5, 2, 18.2, 0.1), (9.5, 1, 17.6, 0.1), (10.5, 2, 17.9, 0.1), (12.0, 1, 17.7, 0.1)]
    p = lc.horizon_truncate(phot(spark, rows), 10)
    got = sorted((round(r["dt"], 1), round(r["colour"], 6)) for r in lc.nearest_time_pairs(p).collect())
    assert got == [(0.0, -0.2), (0.5, -0.2)]
    assert lc.leakage(phot(spark, rows), 10).collect()[0]["n_leaked"] == 1


def test_nearest_pair_ties_go_to_the_earlier_partner(spark):
    p = phot(spark, [(0.0, 2, 18.0, 0.1), (1.0, 1, 19.0, 0.1), (2.0, 2, 17.0, 0.1), (9.0, 1, 18.0, 0.1)])
    g = lc.nearest_time_pairs(p).where("band = 0").collect()
    assert len(g) == 1 and g[0]["colour"] == pytest.approx(1.0)


def test_tied_epoch_keeps_one_row(spark):
    p = phot(spark, [(5.0, 1, 18.5, 0.1), (5.0, 1, 18.0, 0.2), (6.0, 1, 18.0, 0.1)])
    assert sorted(r["mag"] for r in lc.dedupe_same_time(p).collect()) == [18.0, 18.0] and lc.band_cadence(lc.dedupe_same_time(p)).first()["n_obs"] == 2


def test_valid_detections(spark):
    rows = [(1, 1.0, 1, 18.0, 0.1), (1, 2.0, 1, 18.0, -0.1), (1, 3.0, 1, None, 0.1), (1, 4.0, 1, float("nan"), 0.1), (1, 5.0, 1, 18.0, 0.37), (1, 6.0, 1, 18.0, None)]
    d = spark.createDataFrame(rows, DET)
    assert [r["mjd"] for r in lc.valid_detections(d).collect()] == [1.0]
    assert lc.valid_detections(d, None).count() == 3


def test_quality_counts_bands(spark):
    rows = [(1, float(i), 1 + i % 2, 18.0, 0.1) for i in range(8)] + [(2, float(i), 1, 18.0, 0.1) for i in range(9)]
    assert {r["obj_id"]: r["passes"] for r in lc.quality(phot(spark, rows)).collect()} == {1: True, 2: False}


@pytest.mark.parametrize("days", [0, -1, 101])
def test_horizons_are_bounded(spark, days):
    with pytest.raises(ValueError):
        lc.horizon_truncate(phot(spark, [(0.0, 1, 18.0, 0.1)]), days)


def test_statistics_of_constant_and_short_curves(spark):
    flat = phot(spark, [(float(i), 1, 18.0, 0.1) for i in range(6)] + [(float(i), 2, 18.0 + i, 0.1) for i in range(3)])
    got = lc.band_statistics(lc.dedupe_same_time(flat)).collect()
    assert len(got) == 1 and got[0]["amplitude"] == pytest.approx(0) and got[0]["skew"] is None and got[0]["kurtosis"] is None


def test_bazin_grid_finds_its_own_curve(spark):
    import math

    def flux(t):
        return 50 * math.exp(-(t - 10) / 16) / (1 + math.exp(-(t - 10) / 2)) + 5

    rows = [(float(t), 1, 23.9 - 2.5 * math.log10(flux(t)), 0.01) for t in range(0, 41)]
    f = lc.bazin_grid_fit(lc.dedupe_same_time(phot(spark, rows))).first()
    assert (f["reference_time"], f["rise_time"], f["fall_time"]) == (10.0, 2.0, 16.0) and f["amplitude"] == pytest.approx(50, rel=1e-6) and f["reduced_chi2"] < 1e-6


def test_features_of_one_object(spark):
    rows = [(float(i), 1 + i % 3, 18.0 + (i % 4) * 0.3, 0.1) for i in range(24)]
    t = lc.assemble_features(phot(spark, rows))
    assert t.count() == 1 and len(t.columns) > 100 and t.first()["n_obs_total"] == 24


@pytest.mark.parametrize(("span", "want"), [(0, 5), (7.4, 5), (7.5, 10), (14.9, 10), (15, 20), (34.9, 20), (35, None)])
def test_phases(spark, span, want):
    assert spark.range(1).select(ph.phase(F.lit(float(span))).alias("p")).first()["p"] == want


def test_sexagesimal(spark):
    d = spark.createDataFrame([("-00:30:36",), ("12:00:00",), ("15.5",), ("x",), (None,)], "t string")
    got = [r[0] for r in d.select(ph.degrees(F.col("t"), False)).collect()]
    assert got[0] == pytest.approx(-0.51) and got[1:3] == [12.0, 15.5] and got[3:] == [None, None]


def test_alerts_are_filtered_and_beat_history(spark):
    doc = '{"detections":[{"mjd":1,"fid":1,"magpsf":18,"sigmapsf":0.1},{"mjd":2,"fid":4,"magpsf":18,"sigmapsf":0.1},{"mjd":3,"fid":1,"magpsf":null,"sigmapsf":0.1},{"mjd":4,"fid":1,"magpsf":18,"sigmapsf":-1}]}'
    assert [r["mjd"] for r in io.parse_alerts(spark.createDataFrame([(1, doc), (2, "broken")], "obj_id long, doc string")).collect()] == [1.0]
    a = spark.createDataFrame([(1, 5.000001, 18.0, 0.1)], "obj_id long, mjd double, mag double, magerr double")
    h = spark.createDataFrame([(1, 5.000002, 19.0, 0.1), (1, 6.0, 19.0, 0.1)], "obj_id long, mjd double, mag double, magerr double")
    assert sorted(r["mag"] for r in io.merge_history(a, h).collect()) == [18.0, 19.0]


def test_upsert_and_fingerprint(spark):
    old = spark.createDataFrame([(1, 1), (2, 1)], "k long, v long")
    new = spark.createDataFrame([(2, 2), (3, 2)], "k long, v long")
    assert sorted(tuple(r) for r in io.upsert(old, new, "k", "v").collect()) == [(1, 1), (2, 2), (3, 2)]
    assert io.append_new(old, new, "k").collect()[0]["k"] == 3
    assert io.table_digest(old).first() == io.table_digest(old.orderBy(F.desc("k"))).first() != io.table_digest(new).first()


def test_rank_counts_against_brute_force(spark):
    import random

    r = random.Random(1)
    ref = [(r.choice("ab"), round(r.random(), 2)) for _ in range(300)]
    ask = [(i, r.choice("abc"), round(r.random(), 2)) for i in range(100)]
    for largest in (True, False):
        got = heads.rank_counts(spark.createDataFrame(ask, "id int, g string, v double"), spark.createDataFrame(ref, "g string, v double"), ["g"], "v", lambda v: F.floor(v * 7), largest)
        for x in got.collect():
            assert x["count"] == sum(g == x["g"] and (v >= x["v"] if largest else v <= x["v"]) for g, v in ref)


def test_calibration_threshold_needs_enough_rows(spark):
    d = spark.createDataFrame([("a", i / 10) for i in range(9)] + [("b", 0.5)], "g string, s double")
    got = {r["g"]: (r["n"], r["k"], r["q"]) for r in heads.calibrate(d, ["g"]).collect()}
    assert got == {"a": (9, 9, 0.8), "b": (1, 2, 1.0)}


def test_hierarchical_head(spark):
    p = spark.range(1).select(heads.hierarchical(F.array(*map(F.lit, (0.1, 0.5, 0.2, 0.1, 0.1))), F.lit(0.4)).alias("p")).first()["p"]
    assert p == pytest.approx([0.1, 0.3, 0.2, 0.2, 0.1, 0.1])
    with pytest.raises(ValueError):
        heads.anomaly_probability(F.lit(1.0), 1, 0, 1.0)


def test_box_against_brute_force(spark):
    import math
    import random

    r = random.Random(4)
    o = [(i, r.uniform(0, 0.2), r.choice([0, 40, -75]) + r.uniform(0, 0.1)) for i in range(40)]
    s = [(i, x[1] + r.uniform(-0.02, 0.02), x[2] + r.uniform(-0.02, 0.02)) for i, x in enumerate(r.choices(o, k=300))]
    half = 30.0
    got = {(x["obj_id"], x["src_id"]) for x in sky.box_crossmatch(spark.createDataFrame(o, "obj_id long, ra double, decl double"), spark.createDataFrame(s, "src_id long, ra double, decl double"), half, ["src_id"]).collect()}
    want = {(i, j) for i, ra, de in o for j, ra2, de2 in s if abs(de - de2) <= half / 3600 and abs(ra - ra2) <= half / 3600 / max(math.cos(math.radians(de)), 0.05)}
    assert got == want


def test_neighbours_against_brute_force(spark):
    import random

    r = random.Random(6)
    v = [(i, [r.random() for _ in range(4)]) for i in range(60)]
    d = spark.createDataFrame(v, "id long, v array<double>")
    got = {}
    for x in neighbours.knn(d.where("id < 10"), d.repartition(3), 3, "euclidean", cells=50).collect():
        got.setdefault(x["q_id"], {})[x["place"]] = x["a_id"]
    for q in range(10):
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(v[q][1], w)) ** 0.5, 9), i) for i, w in v if i != q)[:3]
        assert [got[q][k] for k in (1, 2, 3)] == [i for _, i in near]
    with pytest.raises(ValueError):
        neighbours.knn(d, d, most_queries=10)


@pytest.mark.parametrize("name", ["knn_cosine", "kth_distance_score", "recall_at_k"])
def test_neighbours_of_more_queries_than_go_out_together(spark, monkeypatch, name):
    from duskwave.plans import registry

    rows = lambda: sorted(map(tuple, registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
    want = rows()
    monkeypatch.setattr(neighbours, "MOST_QUERIES", 20, raising=False)
    # before there were groups, the default of knn() was the limit
    monkeypatch.setattr(neighbours.knn, "__defaults__", (5, "cosine", 20, 1 << 21))
    assert rows() == want and want


def test_neighbours_in_groups_with_null_vectors(spark):
    d = spark.createDataFrame([(i, None if i % 4 == 1 else [float(i * i % 31), float(i)]) for i in range(40)], "id long, v array<double>")
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(neighbours.knn_all(d, d, 3, "euclidean", most_queries=6)) == rows(neighbours.knn(d, d, 3, "euclidean"))
    with pytest.raises(ValueError):
        neighbours.knn_all(d.where("id = 2").union(d.where("id = 2")), d, most_queries=1)
    assert neighbours.knn_all(d.where("id = 1"), d).count() == 0


def test_poisson_bootstrap(spark):
    import hashlib
    import random

    from duskwave.operators import ranking

    steps = ranking.poisson_steps()
    share = [b - a for a, b in zip([0, *steps], steps, strict=False)]
    assert all(abs(s / 2**32 - math.exp(-1) / math.factorial(k)) < 1e-9 for k, s in enumerate(share))
    r = random.Random(3)
    v = {i: r.gauss(5, 2) for i in range(200)}
    got = {x["rep"]: x["v"] for x in ranking.poisson_bootstrap(spark.createDataFrame(list(v.items()), "id long, v double"), "id", ["v"], 400).collect()}
    weight = lambda rep, i: sum(int(hashlib.md5(f"{rep}/{i}".encode()).hexdigest()[:8], 16) >= t for t in steps)
    for rep in (0, 7, 399):
        w = {i: weight(rep, i) for i in v}
        assert abs(got[rep] - sum(w[i] * v[i] for i in v) / sum(w.values())) < 1e-9
    mean = sum(v.values()) / 200
    error = (sum((x - mean) ** 2 for x in v.values()) / 200) ** 0.5 / 200**0.5
    spread = (sum((x - mean) ** 2 for x in got.values()) / 400) ** 0.5
    assert len(got) == 400 and 0.85 < spread / error < 1.15
    # a replicate may draw no row of a tiny table
    tiny = [x["v"] for x in ranking.poisson_bootstrap(spark.createDataFrame([(1, 2.0)], "id long, v double"), "id", ["v"], 50).collect()]
    assert set(tiny) == {2.0, None}


def test_cell_search(spark):
    import random

    r = random.Random(8)
    d = spark.createDataFrame([(i, None if i % 50 == 7 else [r.gauss(c, 0.2) for c in (i % 3, i % 5, i % 7)]) for i in range(400)], "id long, v array<double>").repartition(3)
    asked = d.where("id % 9 = 0")
    rows = lambda x: sorted(map(tuple, x.select("q_id", "a_id", "dist", "place").collect()))
    exact = rows(neighbours.knn(asked, d, 4, "euclidean"))
    index = neighbours.cell_index(d, k=4)
    assert index.rows.count() == 392 and 16 <= len(index.centres) <= 20 and index.probes < len(index.centres)
    found = rows(neighbours.ivf_search(asked, index, 4))
    assert len(set(found) & set(exact)) >= 0.9 * len(exact)
    # all cells: the exact neighbours, whatever the size of a group of queries or of a block
    assert rows(neighbours.ivf_search(asked, index._replace(probes=len(index.centres)), 4, most_queries=11, block=64)) == exact
    assert neighbours.ivf_search(asked.where("id < 0"), index).count() == 0
    assert neighbours.ivf_search(asked, neighbours.cell_index(d.where("id < 0"))).count() == 0
    assert rows(neighbours.ivf_search(d.where("id < 3"), neighbours.cell_index(d.where("id < 3")), 4)) == rows(neighbours.knn(d.where("id < 3"), d.where("id < 3"), 4, "euclidean"))


def test_survey_lists_are_read_whole_by_type_or_by_padded_ids(spark):
    from duskwave.plans import registry, tables
    from duskwave.sources import io

    path = tables._survey_lists(spark, "/root/testdata/sf0.01")
    ids = lambda **k: {r["obj_id"] for r in io.read_survey_lists(spark, path, **k).select("obj_id").distinct().collect()}
    every = ids()
    assert max(every) >= 100 and ids(kind="SN") == {i for i in every if i % 3 == 0}
    assert ids(snids=spark.createDataFrame([(f"{i:<12}",) for i in (5, 120)], "snid string")) == {5, 120} & every
    assert registry.QUERIES["explode_all_survey_lists"](spark, "/root/testdata/sf0.01").count() == len(every)


def test_models_take_whole_vectors_all_folds_and_all_classes(spark):
    from pyspark.sql import functions as F

    from duskwave.plans import registry, training
    from duskwave.sources import adapters as src

    d = "/root/testdata/sf0.001"
    assert src.scores(spark, d).select(F.size("emb").alias("n")).distinct().collect() == [(len(training.COLS),)]
    rounds = registry.QUERIES["round_selection_cv"](spark, d).collect()
    assert {r["fold"] for r in rounds} == set(range(5)) and all(r["refit_loss"] > 0 for r in rounds)
    got = registry.QUERIES["leave_one_class_out"](spark, d).collect()
    assert {r["cls"] for r in got} == set(range(6)) and all(0 <= r[k] <= 1 for r in got for k in ("energy_auroc", "distance_auroc"))
    for r in registry.QUERIES["hyperparameter_search"](spark, d).collect():
        assert r["score"] == pytest.approx(0.5 * r["auprc"] + 0.5 * r["f1"], abs=2e-6)


def test_object_weights(spark):
    d = spark.createDataFrame([(x,) for x in (10, 20, 20, 20, 30, 30)], "obj_id long")
    got = models.object_weights(d).groupBy("obj_id").agg(F.round(F.sum("weight"), 9).alias("w")).collect()
    assert {r["w"] for r in got} == {2.0}


def test_schedule():
    assert [k for k in range(1, 6) if jobs.on_schedule(k)] == [3, 4, 5]
    assert [k for k in range(1, 48) if jobs.on_schedule(k)] == [*range(3, 41), 45]


def test_state_survives_batches(spark, tmp_path):
    """Features from rows in two batches equal those from one."""
    rows = [(i, f"2024-01-{1 + i:02d}T00:00:00", 7, "view", 10.0 + i, "{}") for i in range(12)]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    e.where("event_id < 6").coalesce(1).write.parquet(f"{tmp_path}/two/a")
    e.where("event_id >= 6").coalesce(1).write.parquet(f"{tmp_path}/two/b")
    e.coalesce(1).write.parquet(f"{tmp_path}/one/a")
    two = jobs.drained(jobs.source_features(jobs.arriving(spark, f"{tmp_path}/two/*", 1)), "two")
    one = jobs.drained(jobs.source_features(jobs.arriving(spark, f"{tmp_path}/one/*")), "one")
    assert sorted(map(tuple, two.collect())) == sorted(map(tuple, one.collect())) and two.count() == 10


def test_the_future_changes_nothing(spark):
    """Features of a prefix stay as they are whatever happens after the cut."""
    rows = [(float(i), 1 + i % 3, 18.0 + (i % 4) * 0.3, 0.1) for i in range(30)]
    other = [r if r[0] <= 12 else (r[0], r[1], 14.0 + r[0] / 10, 0.02) for r in rows] + [(12.4, 2, 15.0, 0.1)]
    a, b = (lc.assemble_features(lc.horizon_truncate(phot(spark, x), 12)).first().asDict() for x in (rows, other))
    assert a == b
    assert lc.nearest_time_pairs(lc.horizon_truncate(phot(spark, rows), 12)).count() == lc.nearest_time_pairs(lc.horizon_truncate(phot(spark, other), 12)).count()


def test_box_matches_go_round_the_sky_and_over_the_poles(spark):
    half = 25.5 / 3600
    r = random.Random(12)
    objects = [(i, ra, dec) for i, (ra, dec) in enumerate([(0.001, 10.0), (359.999, -35.0), (180.0, 88.5), (5.0, 89.99), (200.0, -89.999), (0.0, 0.0), (77.0, 90.0)])]
    sources = []
    for _, ra, dec in objects:
        for _ in range(60):
            d = max(-90.0, min(90.0, dec + r.uniform(-1.5, 1.5) * half))
            sources.append((len(sources), (ra + r.uniform(-1.5, 1.5) * min(180, half / max(math.cos(math.radians(dec)), 1e-9))) % 360, d))
    got = sky.box_crossmatch(spark.createDataFrame(objects, "obj_id int, ra double, decl double"), spark.createDataFrame(sources, "src_id int, ra double, decl double"), 25.5, ["src_id"])
    want = set()
    for i, ra, dec in objects:
        dra = min(180, half / max(math.cos(math.radians(dec)), 1e-9))
        want |= {(i, k) for k, s_ra, s_dec in sources if abs((s_ra - ra + 540) % 360 - 180) <= dra and abs(s_dec - dec) <= half}
    rows = [(x["obj_id"], x["src_id"]) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and len({i for i, _ in want}) == len(objects)


def test_ranks_of_a_value_that_many_rows_share(spark):
    values = [0.5] * 200 + [r / 100 for r in range(50)] + [-3.0, 700.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(999, None)], "id int, v double")
    got = {x["id"]: (x["rank"], x["all_rank"]) for x in ranking.average_ranks(df, "v", F.floor(F.col("v") * 4096)).collect()}
    assert got == {i: (sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2, len(values)) for i, v in enumerate(values)}
