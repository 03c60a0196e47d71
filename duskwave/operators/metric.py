"""Exact nearest neighbours with fewer distances, by the triangle inequality.

Every row is dealt to the cell of its nearest centre and keeps its distance from that centre; a cell keeps its radius. For a query, a row of a cell
is at least |d(query, centre) - d(row, centre)| away, so rows and whole cells beyond the query's k-th distance are never compared with it. A first
pass over each query's own cell gives an upper bound of that distance, a second one over all cells compares what the bound leaves. The
result is that of a comparison with all rows. How many distances were computed is counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..sources import io
from .neighbours import _best, _centres, _in_groups, _to_numpy, _vectors, nearest_cells, nearest_rows

#: Distances are compared to nine digits; bounds give way by more than that.
SLACK = 1e-7


class MetricIndex(NamedTuple):
    """Rows (id, v, cell, far) sorted by cell and far in each file, the centres, and each cell's radius."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :], 0))


def metric_index(archive: DataFrame, n_cells: int | None = None, most_cells: int = 4096, fit_rows: int = 100_000, rounds: int = 10, seed: int = 7) -> MetricIndex:
    """Indexes every row with a vector. Centres (sqrt(rows) of them, most_cells at most) are fitted on at most fit_rows rows; rows are not shuffled."""
    spark = archive.sparkSession
    ship(spark)
    whole = archive.where("v is not null").select("id", "v")
    kind = {f.name: f.dataType.simpleString() for f in whole.schema}
    schema = f"id {kind['id']}, v {kind['v']}, cell int, far double"
    if (rows := whole.count()) == 0:
        return MetricIndex(spark.createDataFrame([], schema), np.empty((0, 0)), np.empty(0))
    centres = _centres(whole, min(rows, n_cells or min(most_cells, max(8, round(rows**0.5)))), fit_rows, rounds, seed)
    shared = spark.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _vectors(batch)
                cell = nearest_cells(v, shared.value, 1)[:, 0]
                far = np.linalg.norm(v - shared.value[cell], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(far)], ["id", "v", "cell", "far"])

    dealt = io.stored(whole.mapInArrow(run, schema).sortWithinPartitions("cell", "far"), "metric-cells")
    radius = np.zeros(len(centres))
    for r in dealt.groupBy("cell").agg(F.max("far").alias("far")).collect():  # one row a cell
        radius[r["cell"]] = r["far"]
    return MetricIndex(dealt, centres, radius)


def _compare(index: MetricIndex, part: DataFrame, k: int, bounds: np.ndarray | None, block: int):
    """The k best of each query for each task, and a row without ids whose dist is the number of distances; and the broadcast behind it.

    Without bounds a query meets its own cell; with bounds (k-th distances so far) every row that may be nearer.
    """
    spark = part.sparkSession
    ids, q = _to_numpy(part)
    d = distances(q, index.centres) if len(ids) and len(index.centres) else np.empty((len(ids), 0))
    shared = spark.sparkContext.broadcast((ids, q, d, bounds, index.radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, d, bounds, radius = shared.value
        best, done = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)), 0
        own = d.argmin(axis=1) if d.shape[1] else np.empty(0, np.int64)
        for batch in batches if len(ids) else ():
            a_ids, a = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64), _vectors(batch)
            cells, far = batch.column("cell").to_numpy(zero_copy_only=False), batch.column("far").to_numpy(zero_copy_only=False)
            found = [best]
            for c in np.unique(cells):
                rows = np.flatnonzero(cells == c)
                asked = np.flatnonzero(own == c) if bounds is None else np.flatnonzero(d[:, c] - radius[c] <= bounds + SLACK)
                # queries at like distances from the centre leave like rows
                asked = asked[np.argsort(d[asked, c], kind="stable")]
                for some in (asked[i : i + 64] for i in range(0, len(asked), 64)):
                    mine = rows
                    if bounds is not None:
                        low, high = (d[some, c] - bounds[some]).min() - SLACK, (d[some, c] + bounds[some]).max() + SLACK
                        mine = rows[(far[rows] >= low) & (far[rows] <= high)]
                    for few in (mine[i : i + block] for i in range(0, len(mine), block)):
                        done += len(some) * len(few)
                        r, dist, got = nearest_rows(ids[some], q[some], a_ids[few], a[few], k, "euclidean")
                        found.append((some[r], dist, got))
            best = _best(*map(np.concatenate, zip(*found, strict=True)), k)
        yield pa.RecordBatch.from_arrays([pa.array([*ids[best[0]].tolist(), None], pa.int64()), pa.array([*best[2].tolist(), None], pa.int64()), pa.array([*best[1].tolist(), float(done)])], ["q_id", "a_id", "dist"])

    return index.rows.mapInArrow(run, "q_id long, a_id long, dist double"), shared, ids


def metric_knn(queries: DataFrame, index: MetricIndex, k: int = 5, most_queries: int | None = None, block: int = 4096) -> tuple[DataFrame, int]:
    """q_id, a_id, dist, place of the k nearest rows of each query row (id, v) by Euclidean distance, ties by a_id, a row never its own neighbour; and
    the number of distances that were computed.

    Queries go out in groups, so that their distances from all centres stay below 64 MB. NULL vectors are nobody's neighbour.
    """
    ship(queries.sparkSession)
    computed = 0
    w = Window.partitionBy("q_id").orderBy("dist", "a_id")

    def one_pass(part: DataFrame):
        nonlocal computed
        near, shared, ids = _compare(index, part, k, None, block)
        near = io.stored(near, "metric-near")
        last = near.where("q_id is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") == k).select("q_id", "dist")
        known = {r["q_id"]: r["dist"] for r in last.collect()}  # one row a query
        bounds = np.array([known.get(i, np.inf) for i in ids.tolist()])
        met, shared, _ = _compare(index, part, k, bounds, block)
        met = io.stored(met, "metric-met")
        computed += int(sum(x.where("q_id is null").agg(F.coalesce(F.sum("dist"), F.lit(0.0))).first()[0] for x in (near, met)))
        return met.where("q_id is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k), shared

    most = most_queries or max(64, (1 << 23) // max(len(index.centres), 1))
    return _in_groups(queries.where("v is not null"), most, one_pass), computed
