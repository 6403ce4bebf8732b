"""Centroid clustering of integer vectors by Lloyd's rounds, with bounds that are loosened by geometric drift.

Each vector carries an upper bound on the distance to its centroid and a lower bound on the distance to every other one. While the first stays
below the second, or below half the distance to the nearest other centroid, the vector can't change its cluster and no distance is computed. When centroids move:

* The upper bound grows by what the vector's own centroid moved.
* All vectors of a cluster lie in a sphere around its old centroid, whose radius is their largest upper bound. How much closer another
  centroid can come to a point of the sphere by moving from p to p' is a question in the plane through the sphere's centre, p and p': seen from the
  midpoint of p and p', a point in a direction at angle t to the move gains at most ``|p' - p| * cos(t)``, as the two distances sum to twice
  the distance to the midpoint at least. The sphere is seen under the half-angle ``asin(radius / distance)`` around the direction of its
  centre, so the cosine of the smallest angle in it bounds the gain. The lower bound drops by the largest gain of any other centroid, which
  is less than the full drift unless the sphere lies in the direction of the move.
* Vectors that remain ambiguous are compared with all centroids in whole numbers. Bounds only save work; they never decide a tie.

A round is one pass over a table of vectors with their bounds, written to the shared folder. Tasks add one row for each cluster (number, sum and
radius); the driver sees one such row a cluster. Nothing is shuffled by cluster, so a cluster may hold most of the vectors.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whisperlake.llm.store import share_package, written

# Scaled components are held within this, so that squared distances of vectors of up to 64 components fit into a long.
LARGEST = 1 << 27
# Up to here products and sums of 64 components are exact in doubles as well.
_EXACT = 1 << 22
# Relative slack of the bounds, far above the rounding of doubles.
_SLACK = 1e-9
_ROWS = 4096


class Move(NamedTuple):
    """Centroids, and what their last move does to the bounds of each cluster."""

    centroids: np.ndarray
    drift: np.ndarray
    loosened: np.ndarray
    # Half the distance to the nearest other centroid.
    apart: np.ndarray


def scaled(vector: Column, scale: int) -> Column:
    """Whole numbers floor(scale * component) in doubles, held within ``LARGEST``."""
    def one(x: Column) -> Column:
        return F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.lit(float(scale)) * x.cast("double")))).cast("int")

    return F.transform(vector, one)


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has exactly ``size`` components, none null, NaN or infinite."""
    def fine(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))

    return F.coalesce((F.size(vector) == size) & F.forall(vector, fine), F.lit(False))


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector (rows of int64) to each centroid."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= _EXACT:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((v - x) ** 2).sum(1) for x in c], 1)


def squared_to(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to the centroid of its row."""
    return ((v - c) ** 2).sum(1)


def gain(centre: np.ndarray, radius: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """[a, j]: how much closer centroid j can have come to any point within ``radius[a]`` of ``centre[a]`` by its move, at most."""
    drift = np.linalg.norm(new - old, axis=1)
    middle = (new + old) / 2
    along = (new - old) / np.maximum(drift, 1e-300)[:, None]
    away = np.linalg.norm(centre[:, None] - middle[None], axis=2)
    # Angles as seen from the midpoint: of the centre against the move, and of the sphere around its centre.
    cosine = np.einsum("ajd,jd->aj", centre[:, None] - middle[None], along) / np.maximum(away, 1e-300)
    inside = radius[:, None] >= away * (1 - _SLACK)
    half = np.arcsin(np.clip(radius[:, None] / np.maximum(away, 1e-300), 0, 1))
    nearest = np.maximum(np.arccos(np.clip(cosine, -1, 1)) - half, 0)
    share = np.where(inside, 1.0, np.maximum(np.cos(nearest), 0) + _SLACK)
    return drift * np.minimum(share, 1.0)


def moved(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Move:
    """What a move of the centroids does to the bounds of vectors that lie within ``radius`` of their old centroids."""
    k = len(old)
    a, b = old.astype(np.float64), new.astype(np.float64)
    gains = gain(a, radius, a, b)
    np.fill_diagonal(gains, 0)
    between = np.sqrt(np.maximum(squared(new, new), 0).astype(np.float64))
    np.fill_diagonal(between, np.inf)
    apart = between.min(1) / 2 if k > 1 else np.full(k, np.inf)
    return Move(new, np.linalg.norm(b - a, axis=1), gains.max(1, initial=0), apart)


def reassigned(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, m: Move) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds after a move, and how many vectors were compared with all centroids."""
    upper, lower = upper + m.drift[cluster], lower - m.loosened[cluster]

    def settled(u: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return u * (1 + _SLACK) + _SLACK < np.maximum(lower[rows], m.apart[cluster[rows]]) * (1 - _SLACK)

    open_ = np.flatnonzero(~settled(upper, np.arange(len(v))))
    upper[open_] = np.sqrt(squared_to(v[open_], m.centroids[cluster[open_]]).astype(np.float64))
    open_ = open_[~settled(upper[open_], open_)]
    cluster = cluster.copy()
    cluster[open_], upper[open_], lower[open_] = assigned(v[open_], m.centroids)
    return cluster, upper, lower, len(open_)


def assigned(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (of equal ones the first), its distance and that of the next."""
    d = squared(v, centroids)
    cluster = d.argmin(1)
    rows = np.arange(len(v))
    near = d[rows, cluster].astype(np.float64)
    d = d.astype(np.float64)
    d[rows, cluster] = np.inf
    return cluster, np.sqrt(near), np.sqrt(d.min(1, initial=np.inf))


_STATE = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()),
                    ("n", pa.int64()), ("radius", pa.float64()), ("sums", pa.list_(pa.int64()))])
_STATE_DDL = "vec_id long, v array<int>, cluster int, upper double, lower double, n long, radius double, sums array<long>"


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _pass(m: Move, first: bool):
    """Rows (vec_id, v, and bounds but for the first pass) with new clusters and bounds; at the end a row of sums for each cluster."""
    k, size = m.centroids.shape

    def run(batches):
        number, sums, radius = np.zeros(k, np.int64), np.zeros((k, size), np.int64), np.zeros(k)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                b = batch.slice(at, _ROWS)
                v = _vectors(b.column(1), size)
                if first:
                    cluster, upper, lower = assigned(v, m.centroids)
                else:
                    state = [b.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4)]
                    cluster, upper, lower, _ = reassigned(v, state[0].astype(np.int64), state[1], state[2], m)
                number += np.bincount(cluster, minlength=k)
                np.add.at(sums, cluster, v)
                np.maximum.at(radius, cluster, upper)
                null = pa.nulls(len(v))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower),
                     *(null.cast(f.type) for f in list(_STATE)[5:])], schema=_STATE)
        some = np.flatnonzero(number)
        null = pa.nulls(len(some))
        yield pa.RecordBatch.from_arrays(
            [null.cast(pa.int64()), null.cast(_STATE.field("v").type), pa.array(some, pa.int32()), null.cast(pa.float64()), null.cast(pa.float64()),
             pa.array(number[some]), pa.array(radius[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], schema=_STATE)

    return run


def _next(state: DataFrame, centroids: np.ndarray) -> Move:
    """The move after a pass, from its rows of sums: at most one row a cluster reaches the driver."""
    size = centroids.shape[1]
    # Sums as decimals, as those of many tasks may be larger than a long.
    total = state.filter("n is not null").groupBy("cluster").agg(
        F.sum("n").alias("n"), F.max("radius").alias("radius"),
        F.array(*(F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(size))).alias("sums"))
    new, radius = centroids.copy(), np.zeros(len(centroids))
    for r in total.collect():
        new[r.cluster] = [int(s) // r.n for s in r.sums]
        radius[r.cluster] = r.radius * (1 + _SLACK) + _SLACK
    return moved(centroids, new, radius)


def _final(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                b = batch.slice(at, _ROWS)
                cluster = b.column(2).to_numpy(zero_copy_only=False)
                distance = squared_to(_vectors(b.column(1), centroids.shape[1]), centroids[cluster])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors (vec_id, v) whose ``salt`` with the id has the smallest SHA-256; ids that are null come last, ties by components."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in vectors.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()], np.int64)


def clusters(vectors: DataFrame, size: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, salt: str = "2:") -> DataFrame:
    """One row for each usable row of ``vectors`` (vec_id, embedding; nothing else is read): vec_id, ``cluster``, ``distance`` (squared, in scaled
    whole numbers), ``cluster_inertia`` and ``inertia`` (distances summed over the cluster and over all) and ``centroid_sha256`` (of the
    final centroid's components, joined by commas).

    Vectors of another length, with null or non-finite components, and null vectors give no row. Ids may be null or repeated: every row is a vector
    of its own. Components beyond ``LARGEST`` after scaling are held at it, as distances would not fit into a long. Of equally
    near centroids the first counts; clusters without vectors keep their centroid; of fewer than ``k`` vectors each starts a cluster. A table
    without usable vectors gives no rows.
    """
    spark = vectors.sparkSession
    share_package(spark)
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter(usable(F.col("v"), size))
    now = named.withColumn("v", scaled(F.col("v"), scale))
    start = seeds(now, k, salt)
    if not len(start):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    m = Move(start, *(np.zeros(len(start)),) * 3)
    for i in range(rounds + 1):
        now = now.select("vec_id", "v") if not i else now.filter("n is null").select("vec_id", "v", "cluster", "upper", "lower")
        now = written(now.mapInArrow(_pass(m, not i), _STATE_DDL), "vectors")
        if i < rounds:
            m = _next(now, m.centroids)
    rows = now.filter("n is null").select("vec_id", "v", "cluster")
    found = written(rows.mapInArrow(_final(m.centroids), "vec_id long, cluster int, distance long"), "distances")
    # One row for each of at most ``k`` clusters.
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia")).first()[0]
    digest = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in m.centroids.tolist()))
    return found.join(F.broadcast(sums), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), digest[F.col("cluster")].alias("centroid_sha256"))
