"""Every registered query of the light-curve engine on the smallest tables; those with SQL must give DuckDB's rows."""

import math
import os
import re
from pathlib import Path

import pytest

from duskwave.plans import curves, registry
from duskwave.plans.base import sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"hyperparameter_search", "feature_ablation", "leave_one_class_out", "oof_predictions", "train_forecaster", "train_real_delta", "train_parameter_models", "round_selection_cv", "forecast_grid", "classify_features"}

pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    return str(x)


#: Queries that return columns of one table; test_all_statistics() checks them together.
TOGETHER = set(curves._STAT_QUERIES)


def adds_up(t):
    return all(abs(sum(r[c] for c in r if re.fullmatch(r"p\d|p_[a-z_]+", c)) - 1) < 1e-4 for r in t.to_pylist())


def rising(t, x, y):
    pairs = sorted((r[x], r[y]) for r in t.to_pylist())
    return all(a[1] <= b[1] + 1e-6 for a, b in zip(pairs, pairs[1:], strict=False))


#: What must hold of the results of queries without SQL.
INVARIANTS = {
    "train_hierarchy": lambda t: adds_up(t) and t.num_rows > 0,
    "oof_predictions": lambda t: adds_up(t) and len(set(t["obj_id"].to_pylist())) == t.num_rows,
    "classify_features": adds_up,
    "next_observation_sets": lambda t: all(0 <= r["mean_set"] <= 6 and abs(r["set_before"] - r["mean_set"] - r["delta_s"]) < 1e-5 and 0 <= r["p_singleton"] <= 1 for r in t.to_pylist()),
    "boosting_rounds": lambda t: t.num_rows == 6 and all(1 <= r["rounds"] <= r["most_rounds"] for r in t.to_pylist()),
    "forecast_leaves": lambda t: all(r["q16"] <= r["q50"] <= r["q84"] for r in t.to_pylist()) and t.num_rows >= 8,
    "pca_map": lambda t: all(1 >= r["explained1"] >= r["explained2"] > 0 for r in t.to_pylist()) and all(min(t[c].to_pylist()) < 0 < max(t[c].to_pylist()) for c in ("pc1", "pc2")),
    "metric_index_work": lambda t: all(0 < r["computed"] <= 2.1 * r["queries"] * r["rows"] for r in t.to_pylist()),
    "train_five_class": lambda t: all(0 <= c <= 4 for c in t["cls"].to_pylist()),
    "balanced_logistic": lambda t: all(0 <= p <= 1 for p in t["p"].to_pylist()) and t.num_rows > 0,
    "review_combiner_fit": lambda t: all(0 <= p <= 1 for p in t["p"].to_pylist()),
    "isotonic_calibration": lambda t: rising(t, "score", "calibrated") and t.num_rows > 0,
    "top_features_by_gain": lambda t: t.num_rows == 64 and abs(sum(t["gain"].to_pylist()) - 1) < 1e-6,
    "feature_ablation": lambda t: sorted(t["columns"].to_pylist()) == [2, 4, 8, 64] and all(0 <= a <= 1 for a in t["accuracy"].to_pylist()),
    "leave_one_class_out": lambda t: t.num_rows == 6 and all(0 <= r[c] <= 1 for r in t.to_pylist() for c in ("energy_auroc", "distance_auroc")),
    "round_selection_cv": lambda t: sorted(t["fold"].to_pylist()) == list(range(5)) and all(1 <= r <= 6 for r in t["rounds"].to_pylist()),
    "hyperparameter_search": lambda t: t["stage"].to_pylist().count(0) == 6 and all(abs(r["score"] - (r["f1"] + r["auprc"]) / 2) < 1e-5 for r in t.to_pylist()) and sum(r["kept"] for r in t.to_pylist() if r["stage"] == max(t["stage"].to_pylist())) == 1,
    "stored_file_faults": lambda t: {(r["part"], r["fault"]) for r in t.to_pylist()} >= {("event_type=view", "unlisted"), ("event_type=view", "missing"), ("event_type=click", "unlisted")},
    "train_forecaster": lambda t: all(r["lo"] is None or r["lo"] <= r["hi"] for r in t.to_pylist()),
    "forecast_grid": lambda t: all(r["lo95"] <= r["lo68"] <= r["mag"] <= r["hi68"] <= r["hi95"] for r in t.to_pylist()),
    "train_parameter_models": lambda t: set(t["parameter"].to_pylist()) == {"t0", "mb", "x1", "c"} and all(h >= 0 for h in t["half_width"].to_pylist()),
    "stream_review_refit": lambda t: sum(t["n"].to_pylist()) > 0 and len(set(t["weight"].to_pylist())) == 1,
    "recall_at_k": lambda t: all(0.9 <= v <= 1 for c in t.schema.names if "recall" in c for v in t[c].to_pylist()),
}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - (set() if os.environ.get("ALL_QUERIES") else TOGETHER - {"stat_skew"})))
def test_query(spark, duck, name):
    if name in SLOW and not os.environ.get("ALL_QUERIES"):
        pytest.skip("trains several models; set ALL_QUERIES to run it")
    got = registry.QUERIES[name](spark, SF).toArrow()
    if name not in registry.ORACLE_SQL:
        assert got.schema.names and INVARIANTS.get(name, lambda t: t.num_rows > 0)(got)
        return
    want = duck.sql(registry.ORACLE_SQL[name]).to_arrow_table()
    names = sorted(got.schema.names)
    assert names == sorted(want.schema.names)
    rows = lambda t: sorted(tuple(plain(v) for v in r) for r in zip(*(t.column(c).to_pylist() for c in names), strict=True))
    assert rows(got) == rows(want)


def test_all_statistics(spark, duck):
    from pyspark.sql import functions as F

    columns = [c for cols in curves._STAT_QUERIES.values() for c in cols]
    got = curves._statistic(columns)(spark, SF).where(F.col("band") >= 0).toArrow()
    want = duck.sql(sql(curves._STAT + " select obj_id, band, " + ", ".join(f"round({curves._STATS[c]}, 5) + 0.0 as {c}" for c in columns) + " from x group by obj_id, band")).to_arrow_table()
    rows = lambda t: sorted(tuple(plain(v) for v in r) for r in zip(*(t.column(c).to_pylist() for c in ["obj_id", "band", *columns]), strict=True))
    assert rows(got) == rows(want) and got.num_rows > 10


def test_entry():
    import __spark_entry__ as entry

    assert registry.FLAGSHIP in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
