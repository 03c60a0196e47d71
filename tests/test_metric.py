"""The metric index gives what a comparison with all rows gives, with fewer distances."""

import numpy as np
import pytest

from duskwave.operators import metric


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>").repartition(3)


def brute(ids, q, a_ids, a, k):
    out = set()
    for i, x in zip(ids, q, strict=True):
        d = np.round(np.sqrt(((a - x) ** 2).sum(axis=1)), 9)
        order = [j for j in np.lexsort((a_ids, d)) if a_ids[j] != i][:k]
        out |= {(i, int(a_ids[j]), float(d[j]), p) for p, j in enumerate(order, 1)}
    return out


@pytest.mark.parametrize(("dims", "clusters", "most"), [(6, 20, None), (6, 20, 40), (16, 1, None)])
def test_metric_knn_is_brute_force(spark, dims, clusters, most):
    r = np.random.default_rng(dims)
    a = r.normal(0, 5, (clusters, dims))[r.integers(0, clusters, 900)] + r.normal(0, 0.3, (900, dims))
    a[100:110] = a[100]  # copies: ties by id
    rows = frame(spark, a)
    asked = rows.where("id % 9 = 1")
    index = metric.metric_index(rows)
    got, computed = metric.metric_knn(asked, index, 4, most)
    ids = [i for i in range(900) if i % 9 == 1]
    assert {(x["q_id"], x["a_id"], x["dist"], x["place"]) for x in got.collect()} == brute(ids, a[ids], np.arange(900), a, 4)
    assert computed < (0.5 if clusters > 1 else 2.1) * len(ids) * 900


def test_few_and_no_rows(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None)], "id long, v array<double>")
    got, _ = metric.metric_knn(rows, metric.metric_index(rows), 5)
    assert sorted((x["q_id"], x["a_id"], x["dist"]) for x in got.collect()) == [(1, 2, 5.0), (2, 1, 5.0)]
    none = rows.limit(0)
    assert metric.metric_knn(rows, metric.metric_index(none), 5)[0].count() == 0
    assert metric.metric_knn(none, metric.metric_index(rows), 5)[0].count() == 0
