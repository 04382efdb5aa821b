"""Centroid clustering with Ptolemaic pivots.

Lloyd's rounds on whole numbers. For a vector x, a centroid c and two pivots p and q,
Ptolemy's inequality gives d(x, c) >= |d(x, p) d(c, q) - d(x, q) d(c, p)| / d(p, q). The
pivots are fixed before the first round, so a vector's distances to them are worked out
once and stored beside it; per round only the centroids' are new. A vector's first exact
distance is that to the centroid of least bound; another centroid is measured only if its
bound, taken down by more than any rounding error, is not above the best distance so far.
Distances measured are exact squares of whole numbers, so ties are real ones.

A round is one pass over the stored vectors in Arrow batches. A task gives back one sum per
cluster, and the driver gets ``k`` centroids, nothing that grows with the table.

Vectors that are null, of another length than ``dims``, or with a component that is null or
not finite are left out. Repeated rows each count. If fewer vectors than ``k`` are kept
there are fewer centroids; an empty table gives an empty one. Other columns are not looked
at. A null id sorts last among the first centroids. Components must be below 2^27 in size
after scaling: larger ones are refused, as their squared distances would not fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.functions.reliability import checkpointed
from leadlake.llm.ship import ship_code

PIVOTS = 8
PAIRS = 12
LARGEST = 1 << 27
#: More than the relative rounding error of a bound's products, difference and quotient.
SLACK = 16 * float(np.finfo(np.float64).eps)


def whole_vectors(vectors: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(id, v) of the vectors that are kept; v holds floor(scale * x)."""
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(key).alias("id"), F.col(vector).alias("x")).where(F.size("x") == dims).where(fine)
    return kept.select("id", F.transform("x", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors of smallest sha256 of salt and id, in that order."""
    name = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    top = rows.orderBy(F.asc_nulls_last(name), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in top], np.int64)


class Pivots(NamedTuple):
    """Fixed vectors, and the pairs of them that bound distances, with the pairs' own distances."""

    points: np.ndarray
    pairs: list[tuple[int, int, float]]


def choose_pivots(points: np.ndarray) -> Pivots:
    """Points far from each other, one after the other the farthest from those chosen; the widest pairs of them."""
    chosen = [0]
    nearest = squares(points, points[0])
    while len(chosen) < min(PIVOTS, len(points)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squares(points, points[chosen[-1]]))
    picked = points[chosen]
    wide = sorted(((float(np.sqrt(squares(picked[a], picked[b]))), a, b) for a, b in combinations(range(len(picked)), 2)), reverse=True)
    return Pivots(picked, [(a, b, d) for d, a, b in wide[:PAIRS]])


def squares(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances."""
    apart = rows - point
    return (apart * apart).sum(axis=-1)


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squares(rows, p) for p in points], axis=1).astype(np.float64))


def lower_bounds(far: np.ndarray, centre: np.ndarray, pivots: Pivots) -> np.ndarray:
    """(vectors, centroids): squared distances are certainly not below this. ``far`` and ``centre`` hold distances to pivots."""
    bound = np.zeros((len(far), len(centre)))
    for p, q, apart in pivots.pairs:
        one, other = np.outer(far[:, p], centre[:, q]), np.outer(far[:, q], centre[:, p])
        low = (np.abs(one - other) - SLACK * (one + other)) / apart
        np.maximum(bound, low, out=bound)
    return bound * bound * (1 - SLACK)


def nearest(rows: np.ndarray, far: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: the number of the nearest centroid (the smaller one of equals), the squared distance, and how many were measured."""
    bounds = lower_bounds(far, distances(centroids, pivots.points), pivots)
    cluster = bounds.argmin(axis=1)
    best = squares(rows, centroids[cluster])
    first, measured = cluster.copy(), np.ones(len(rows), np.int64)
    for c in range(len(centroids)):
        left = np.nonzero((bounds[:, c] <= best) & (first != c))[0]
        if not left.size:
            continue
        measured[left] += 1
        found = squares(rows[left], centroids[c])
        closer = (found < best[left]) | ((found == best[left]) & (c < cluster[left]))
        cluster[left[closer]], best[left[closer]] = c, found[closer]
    return cluster, best, measured


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    rows = batch["v"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), -1)
    if rows.size and np.abs(rows).max() >= LARGEST:
        raise ArithmeticError("components too large for exact distances")
    return rows


def _far(batch: pa.RecordBatch) -> np.ndarray:
    return batch["far"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def with_pivot_distances(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """(id, v, far): the distances to the pivots, stored once."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                far = distances(_rows(b), pivots.points)
                lists = pa.ListArray.from_arrays(np.arange(0, far.size + 1, far.shape[1], dtype=np.int32), pa.array(far.ravel()))
                yield pa.RecordBatch.from_arrays([b["id"], b["v"], lists], ["id", "v", "far"])

    return checkpointed(rows.mapInArrow(told, "id long, v array<int>, far array<double>"))


def moved(stored: DataFrame, centroids: np.ndarray, pivots: Pivots) -> np.ndarray:
    """Assign all vectors; the floor of each cluster's mean, or the old centroid of an empty one."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for b in batches:
            if len(b):
                rows = _rows(b)
                cluster, _, _ = nearest(rows, _far(b), centroids, pivots)
                order = cluster.argsort(kind="stable")
                found, starts = np.unique(cluster[order], return_index=True)
                total[found] += np.add.reduceat(rows[order], starts, axis=0)
                count += np.bincount(cluster, minlength=len(count))
        used = np.nonzero(count)[0]
        for c in used.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([count[c]]), pa.array([total[c].tolist()], pa.list_(pa.int64()))], ["c", "n", "total"])

    parts = stored.mapInArrow(sums, "c long, n long, total array<long>").select("c", "n", F.posexplode("total"))
    added = parts.groupBy("c", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in added.collect():  # at most k * dims rows
        out[r["c"], r["pos"]] = int(r["s"]) // r["n"]
    return out


def clusters(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:",
) -> DataFrame:
    """One row per kept vector: key, cluster, distance, measured (centroids), cluster_inertia, inertia, centroid (its components)."""
    spark = vectors.sparkSession
    ship_code(spark)
    rows = whole_vectors(vectors, key, vector, dims, scale)
    centroids = first_centroids(rows, k, salt)
    names = "id long, cluster int, distance long, measured int"
    if not len(centroids):
        empty = spark.createDataFrame([], f"{names}, cluster_inertia long, inertia long, centroid array<long>")
        return empty.withColumnRenamed("id", key)
    pivots = choose_pivots(centroids)
    stored = with_pivot_distances(rows, pivots)
    for _ in range(rounds):
        centroids = moved(stored, centroids, pivots)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                cluster, best, measured = nearest(_rows(b), _far(b), centroids, pivots)
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(cluster, pa.int32()), pa.array(best), pa.array(measured, pa.int32())], ["id", "cluster", "distance", "measured"])

    told = checkpointed(stored.mapInArrow(assigned, names))
    listed = spark.createDataFrame([(c, [int(x) for x in v]) for c, v in enumerate(centroids)], "cluster int, centroid array<long>")
    per = told.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(F.broadcast(listed), "cluster")
    per = per.crossJoin(F.broadcast(told.agg(F.sum("distance").alias("inertia"))))  # a row per cluster, and one
    return told.join(F.broadcast(per), "cluster").select(
        F.col("id").alias(key), "cluster", "distance", "measured", "cluster_inertia", "inertia", "centroid"
    )
