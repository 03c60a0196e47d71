"""Nearest neighbours of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..sources import io

#: Queries that go out together: at 64 dimensions 10 MB.
MOST_QUERIES = 20000


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)


def nearest_rows(q_ids: np.ndarray, q: np.ndarray, a_ids: np.ndarray, a: np.ndarray, k: int, metric: str, best: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
    """Of rows a (and those in best) the k nearest of each q by (distance to nine digits, id), as (number of q, distance, id)."""
    if metric == "euclidean":
        return _nearest_euclidean(q_ids, q, a_ids, a, k, (np.empty(0, np.int64), np.empty(0), a_ids[:0]) if best is None else best)
    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(a, axis=1)[None, :]
    d = 1 - np.divide(q @ a.T, norms, out=np.zeros(norms.shape), where=norms > 0)
    d = np.round(d, 9)
    d[q_ids[:, None] == a_ids[None, :]] = np.inf
    far = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
    row, col = np.nonzero((d <= far[:, None]) & np.isfinite(d))
    row, dist, ids = row, d[row, col], a_ids[col]
    if best is not None:
        row, dist, ids = np.concatenate((best[0], row)), np.concatenate((best[1], dist)), np.concatenate((best[2], ids))
    return _best(row, dist, ids, k)


#: Queries and rows of a block of the screen: its products stay in a core's cache.
TILE = (512, 1024)


def _nearest_euclidean(q_ids: np.ndarray, q: np.ndarray, a_ids: np.ndarray, a: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """nearest_rows() for Euclidean distance, exactly.

    A matrix product in single precision, with a bound on its error, tells which rows can't be among the k nearest so far; the distances of the
    others are computed in full. As |q - a|^2 = |q|^2 - 2 (q a - |a|^2 / 2), a row may count if what is in brackets is `least` or more. For the
    products values are scaled by a power of two, so that none is beyond 1.
    """
    far_q, far_a = ~np.isfinite(q).all(axis=1), ~np.isfinite(a).all(axis=1)
    fine_q, fine_a = np.where(far_q[:, None], 0.0, q), np.where(far_a[:, None], 0.0, a)
    unit = np.ldexp(1.0, min(1000, -int(np.frexp(max(np.abs(fine_q).max(initial=0.0), np.abs(fine_a).max(initial=0.0)))[1])))
    fine_q, fine_a = fine_q * unit, fine_a * unit
    qq, aa = (fine_q * fine_q).sum(axis=1), (fine_a * fine_a).sum(axis=1)
    longest = aa.max(initial=0.0)
    # twice the error of products and norms, and what rounding to nine digits may add
    slack = 2.0**-23 * (q.shape[1] + 12) * (qq + longest) + 4e-9 * unit * (np.sqrt(qq) + np.sqrt(longest)) + 1e-17 * unit**2 + 1e-40
    q32 = np.column_stack((fine_q, np.ones(len(q)))).astype(np.float32)
    a32 = np.column_stack((fine_a, np.where(far_a, -np.inf, -aa / 2))).astype(np.float32)
    shared, out = np.isin(q_ids, a_ids), []
    for lo in range(0, len(q), TILE[0]):
        some = slice(lo, min(len(q), lo + TILE[0]))
        n, mine = some.stop - lo, slice(*np.searchsorted(best[0], (lo, some.stop)))
        found, waiting = [(best[0][mine] - lo, best[1][mine], best[2][mine])], 0
        kth = _kth(found[0], n, k)
        for at in range(0, len(a), TILE[1]):
            few = slice(at, at + TILE[1])
            g = q32[some] @ a32[few].T
            if shared[some].any():
                g[q_ids[some][:, None] == a_ids[few][None, :]] = -np.inf
            least = np.where(far_q[some], np.inf, (qq[some] - ((kth + 1e-9) * unit) ** 2 - slack[some]) / 2)
            if g.shape[1] > k and np.isinf(kth).any():
                least = np.maximum(least, -np.partition(-g, k - 1, axis=1)[:, k - 1] - slack[some])
            may = _true_cells(g >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None])
            for first in range(0, len(may), 1 << 16):
                row, col = np.divmod(may[first : first + (1 << 16)], g.shape[1])
                d = np.round(np.sqrt(((a[few][col] - q[some][row]) ** 2).sum(axis=1)), 9)
                near = np.isfinite(d) & (d <= kth[row]) & (q_ids[some][row] != a_ids[few][col])
                found.append((row[near], d[near], a_ids[few][col[near]]))
                waiting += np.count_nonzero(near)
                if waiting > 4 * k * n:
                    found, waiting = [_best(*map(np.concatenate, zip(*found, strict=True)), k)], 0
                    kth = _kth(found[0], n, k)
        row, dist, ids = _best(*map(np.concatenate, zip(*found, strict=True)), k)
        out.append((row + lo, dist, ids))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else best


def _true_cells(cells: np.ndarray) -> np.ndarray:
    """np.flatnonzero() of booleans of which few are true: looks at eight at once first."""
    flat = cells.reshape(-1)
    whole = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
    at = np.concatenate((at, np.arange(whole, len(flat))))
    return at[flat[at]]


def _kth(best: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, k: int) -> np.ndarray:
    """The k-th distance of each of n row numbers, infinite where there are fewer."""
    row, out = best[0], np.full(n, np.inf)
    last = np.arange(len(row)) - np.searchsorted(row, row) == k - 1
    out[row[last]] = best[1][last]
    return out


def _best(row: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each row number, by (distance, id)."""
    order = np.lexsort((ids, dist, row))
    row, dist, ids = row[order], dist[order], ids[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], dist[place < k], ids[place < k]


def knn(queries: DataFrame, archive: DataFrame, k: int = 5, metric: str = "cosine", most_queries: int = 20000, cells: int = 1 << 21) -> DataFrame:
    """q_id, a_id, dist, place: the k nearest archive rows (id, v) of each query row (id, v), exactly; ties by a_id. NULL vectors are nobody's neighbour.

    A stated set of queries is compared with all rows in blocks. The queries are counted first and go to all tasks; each task reads its part of the
    archive once, in blocks of at most `cells` distances (Euclidean ones: of TILE), and hands on its k best for each query, so nothing but these is shuffled.
    """
    if (n := queries.count()) > most_queries:
        raise ValueError(f"{n} queries; send at most {most_queries} at a time")
    return _one_pass(queries, archive, k, metric, cells)[0]


def knn_all(queries: DataFrame, archive: DataFrame, k: int = 5, metric: str = "cosine", most_queries: int | None = None, cells: int = 1 << 21) -> DataFrame:
    """As knn() for any number of queries. Ids are dealt by hash into groups of at most most_queries (MOST_QUERIES where it is None).

    Each group takes one pass over the archive; its result is stored and its broadcast destroyed before the next one, so that driver and tasks hold
    one group at a time. The work is still queries times rows.
    """
    most = most_queries or MOST_QUERIES
    if queries.count() <= most:
        return knn(queries, archive, k, metric, most, cells)
    return _in_groups(queries, most, lambda part: _one_pass(part, archive, k, metric, cells))


def _in_groups(queries: DataFrame, most: int, one_pass) -> DataFrame:
    """The union of one_pass (a result and its broadcast) over groups of at most `most` queries."""
    n = queries.count()
    groups = max(1, -(-n // most))
    group = lambda: F.pmod(F.xxhash64("id"), F.lit(groups))
    while n > most and queries.groupBy(group().alias("g")).count().agg(F.max("count")).first()[0] > most:
        if groups > 4 * n:
            raise ValueError(f"more than {most} queries of one id")
        groups = groups * 5 // 4 + 1
    if groups == 1:
        return one_pass(queries)[0]
    path = io.scratch(queries.sparkSession, "knn")
    for i in range(groups):
        got, shared = one_pass(queries.where(group() == i))
        got.write.mode("append").parquet(path)
        shared.destroy()
    return queries.sparkSession.read.schema(got.schema).parquet(path)


def _to_numpy(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a bounded set of rows (id, v)."""
    asked = rows.where("v is not null").select("id", "v").toArrow()
    flat = asked.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return asked.column("id").to_numpy().astype(np.int64), flat.reshape(asked.num_rows, -1) if asked.num_rows else np.empty((0, 0))


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _one_pass(queries: DataFrame, archive: DataFrame, k: int, metric: str, cells: int):
    """The result of knn(), and the broadcast that it needs until it is computed."""
    spark = archive.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(_to_numpy(queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        best = None
        for batch in batches:
            # Euclidean distances are cut into blocks where they are made
            step = max(1, batch.num_rows if metric == "euclidean" else cells // max(len(q_ids), 1))
            for at in range(0, batch.num_rows if len(q_ids) else 0, step):
                part = batch.slice(at, step)
                best = nearest_rows(q_ids, q, part.column("id").to_numpy(zero_copy_only=False).astype(np.int64), _vectors(part), k, metric, best)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[best[0]]), pa.array(best[2]), pa.array(best[1])], ["q_id", "a_id", "dist"])

    met = archive.where("v is not null").select("id", "v").mapInArrow(run, "q_id long, a_id long, dist double")
    w = Window.partitionBy("q_id").orderBy("dist", "a_id")
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k), shared


class CellIndex(NamedTuple):
    """All rows of an archive (id, v, cell), the cells' centres, and how many cells a query looks at."""

    rows: DataFrame
    centres: np.ndarray
    probes: int


def nearest_cells(v: np.ndarray, centres: np.ndarray, n: int, block: int = 1 << 21) -> np.ndarray:
    """Numbers of the n nearest centres of each row of v, nearest first; temporaries have about `block` entries."""
    out = np.empty((len(v), n), np.int64)
    step, own = max(1, block // len(centres)), (centres**2).sum(axis=1)
    for at in range(0, len(v), step):
        out[at : at + step] = np.argsort(own[None, :] - 2 * v[at : at + step] @ centres.T, axis=1, kind="stable")[:, :n]
    return out


def _centres(archive: DataFrame, n: int, fit_rows: int, rounds: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    fit = archive.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    model = KMeans(k=n, maxIter=rounds, seed=seed, featuresCol="f").fit(fit.select(array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("f")))
    return np.array(model.clusterCenters())


def cell_index(
    archive: DataFrame, k: int = 5, recall: float = 0.95, n_cells: int | None = None, most_cells: int = 4096, fit_rows: int = 100_000, asked_rows: int = 256, rounds: int = 10, seed: int = 7
) -> CellIndex:
    """Deals every row with a vector to the nearest of about sqrt(rows) k-means cells, and measures how many cells a search must look at.

    Two samples by the hash of the id, both bounded: centres are fitted on at most fit_rows rows; the exact neighbours of asked_rows rows tell the
    smallest number of cells in which the share `recall` of them lies. Rows are written once, each partition sorted by cell; nothing is shuffled.
    """
    spark = archive.sparkSession
    ship(spark)
    whole = archive.where("v is not null").select("id", "v")
    if (rows := whole.count()) == 0:
        return CellIndex(whole.withColumn("cell", F.lit(0)), np.empty((0, 0)), 0)
    centres = _centres(whole, min(rows, n_cells or min(most_cells, max(16, round(rows**0.5)))), fit_rows, rounds, seed)
    shared = spark.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = nearest_cells(_vectors(batch), shared.value, 1)[:, 0].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell)], ["id", "v", "cell"])

    kind = {f.name: f.dataType.simpleString() for f in whole.schema}
    dealt = io.stored(whole.mapInArrow(run, f"id {kind['id']}, v {kind['v']}, cell int").sortWithinPartitions("cell"), "cells")
    asked = dealt.select("id", "v").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(asked_rows)
    near = knn(asked, dealt, k, "euclidean", asked_rows).select("q_id", F.col("a_id").alias("id"))
    near = near.join(dealt.select("id", "cell"), "id").select("q_id", "cell").toArrow()
    ids, v = _to_numpy(asked)
    order = dict(zip(ids.tolist(), np.argsort(nearest_cells(v, centres, len(centres)), axis=1), strict=True))
    looked = np.sort([order[q][c] + 1 for q, c in zip(near.column("q_id").to_pylist(), near.column("cell").to_pylist(), strict=True)])
    return CellIndex(dealt, centres, int(looked[int(np.ceil(recall * len(looked))) - 1]) if len(looked) else 1)


def ivf_search(queries: DataFrame, index: CellIndex, k: int = 5, most_queries: int | None = None, block: int = 1 << 21) -> DataFrame:
    """As knn_all() with Euclidean distance, but a query only meets the rows of the index.probes cells nearest to it.

    Queries go to all tasks in groups, as in knn_all(), each under the cells that it looks at; a task compares the rows of a cell with the cell's
    queries in blocks. Rows are not shuffled, so a cell may hold any share of them.
    """
    spark = queries.sparkSession
    ship(spark)

    def one_pass(part: DataFrame):
        ids, v = _to_numpy(part)
        cells = nearest_cells(v, index.centres, index.probes) if len(ids) and index.probes else np.empty((len(ids), 0), np.int64)
        shared = spark.sparkContext.broadcast((ids, v, cells))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q, probed = shared.value
            row, cell = np.nonzero(np.ones_like(probed))[0], probed.ravel()
            row, cell = row[order := np.argsort(cell, kind="stable")], cell[order]
            best = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
            for batch in batches:
                if not batch.num_rows:
                    continue
                a_ids, a, at = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64), _vectors(batch), batch.column("cell").to_numpy(zero_copy_only=False)
                found = [best]
                for c in np.unique(at):
                    asked = row[np.searchsorted(cell, c) : np.searchsorted(cell, c, "right")]
                    mine = np.flatnonzero(at == c)
                    step = max(1, block // max(len(asked), 1))
                    for first in range(0, len(mine) if len(asked) else 0, step):
                        some = mine[first : first + step]
                        r, dist, got = nearest_rows(q_ids[asked], q[asked], a_ids[some], a[some], k, "euclidean")
                        found.append((asked[r], dist, got))
                best = _best(*map(np.concatenate, zip(*found, strict=True)), k)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[best[0]]), pa.array(best[2]), pa.array(best[1])], ["q_id", "a_id", "dist"])

        met = index.rows.mapInArrow(run, "q_id long, a_id long, dist double")
        w = Window.partitionBy("q_id").orderBy("dist", "a_id")
        return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k), shared

    return _in_groups(queries, most_queries or MOST_QUERIES, one_pass)
