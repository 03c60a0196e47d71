"""Leaving out one class, and the exact Euclidean search that it needs, against brute force."""

import numpy as np
import pytest

from duskwave.operators import neighbours as nb
from duskwave.plans import registry, training


def plain(q_ids, q, a_ids, a, k):
    """By all distances: (number of q, distance, id)."""
    out = []
    for i, x in enumerate(q):
        d = np.round(np.sqrt(((a - x) ** 2).sum(axis=1)), 9)
        out += sorted((i, dist, int(n)) for dist, n in zip(d, a_ids, strict=True) if np.isfinite(dist) and n != q_ids[i])[:k]
    return out


@pytest.mark.parametrize("kind", ["spread", "grid", "far from zero", "copies", "odd values", "all sizes"])
def test_the_screen_loses_no_neighbour(kind, monkeypatch):
    r = np.random.default_rng(len(kind))
    q, a = r.normal(size=(90, 7)), r.normal(size=(2500, 7))
    if kind == "grid":
        q, a = np.round(q), np.round(a)
    elif kind == "far from zero":
        q, a = q + 1e4, a + 1e4
    elif kind == "copies":
        a[r.integers(0, 2500, 1200)] = a[0]
        q[:30] = a[0]
    elif kind == "odd values":
        a[r.random(a.shape) < 0.01] = np.nan
        a[7], a[8], q[3] = np.inf, 1e150, np.nan
    elif kind == "all sizes":
        q, a = q * 10.0 ** r.integers(-30, 30, (90, 1)), a * 10.0 ** r.integers(-30, 30, (2500, 1))
    monkeypatch.setattr(nb, "TILE", (32, 300))
    q_ids, a_ids = r.permutation(90), r.permutation(2500) + (0 if kind in ("grid", "copies") else 10**6)
    best = None
    for cut in (slice(0, 4), slice(4, 1300), slice(1300, 2500)):
        best = nb.nearest_rows(q_ids, q, a_ids[cut], a[cut], 6, "euclidean", best)
    assert list(zip(*(x.tolist() for x in best), strict=True)) == plain(q_ids, q, a_ids, a, 6)


def test_few_distances_are_computed_in_full(monkeypatch):
    r, cells = np.random.default_rng(5), []
    q, a = r.normal(size=(300, 64)), r.normal(size=(8000, 64))
    true_cells = nb._true_cells
    monkeypatch.setattr(nb, "_true_cells", lambda may: cells.append(len(true_cells(may))) or true_cells(may))
    got = nb.nearest_rows(np.arange(300), q, np.arange(8000) + 300, a, 10, "euclidean")
    assert list(zip(*(x.tolist() for x in got), strict=True)) == plain(np.arange(300), q, np.arange(8000) + 300, a, 10)
    # before, all 2.4 million were
    assert sum(cells) < 0.02 * 300 * 8000


def test_copies_are_compared_once_and_count_as_often_as_they_are_there(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    r = np.random.default_rng(9)
    few = r.normal(size=(90, 64)).astype(np.float32)
    # vectors 0 to 9 have 12 to 21 copies, so that one of them can fill all ten places
    which = np.concatenate([np.arange(90)] * 3 + [np.full(9 + i, i) for i in range(10)])
    r.shuffle(which)
    ids, label = np.arange(len(which)), (which + r.integers(0, 2, len(which))) % 10
    rows = [(int(i), few[w].tolist(), int(c)) for i, w, c in zip(ids, which, label, strict=True)]
    # neither a row without a vector nor one without a class has a part in distances
    rows += [(1000, None, 3), (1017, None, 3), (1001, few[0].tolist(), None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    seen, knn_all = [], nb.knn_all
    monkeypatch.setattr(training.nb, "knn_all", lambda q, a, *more: seen.append((q.count(), a.count())) or knn_all(q, a, *more))
    got = {x["cls"]: x for x in registry.QUERIES["leave_one_class_out"](spark, str(tmp_path)).withColumn("cls", F.col("cls").cast("int")).collect()}
    v, truth, part = few[which].astype(float), label % 6, ids % 20
    assert set(got) == set(range(6)) and all(0 <= x["energy_auroc"] <= 1 for x in got.values())
    for c in range(6):
        fit = (truth != c) & (part < 14)
        far = np.sqrt(((v[:, None, :] - v[fit][None, :, :]) ** 2 / v[fit].std(axis=0) ** 2).sum(axis=2))
        distance = np.round(np.sort(np.round(far, 9), axis=1)[:, :10].mean(axis=1), 12)
        out, known = distance[truth == c], distance[(truth != c) & (part >= 17)]
        auroc = ((out[:, None] > known[None, :]) + 0.5 * (out[:, None] == known[None, :])).mean()
        assert got[c]["distance_auroc"] == pytest.approx(auroc, abs=2e-6)
    # before, the number of rows: up to 130 asked and 240 known ones
    assert len(seen) == 6 and all(q <= 90 and a <= 90 for q, a in seen)
