"""Centroid clustering in exact integers, pruned by a table of distances to fixed pivots (LAESA).

Components become integers, floor(1024 * x).  A vector's distances to the pivots are computed once and
kept beside it.  In each round the differences between a vector's and a centroid's distances to the
pivots bound their distance from below; a centroid whose bound exceeds the best exact distance found so
far is left out, every other one gets an exact squared distance in 64-bit integers.  Tasks add up their
vectors by cluster; only k sums of each round reach the driver.

Cases: a vector without exactly `dims` components, or with a null, infinite or NaN one, is left out;
components beyond +-LARGEST / 1024 count as that, so that squared distances fit 64 bits (at 64
dimensions); rows of one vec_id are rows of their own, and a null vec_id is one with no digits; fewer
vectors than centroids make fewer centroids; equal vectors give equal centroids of which the smaller
number wins; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, stage

SCALE = 1024
LARGEST = 1 << 27
#: Pivots: the vectors of smallest hash under a key of their own.
PIVOTS = 8
#: Square roots of exact integers are rounded; a bound is lowered by this share of the greatest distance in it.
SLACK = 1e-14
ROWS = 20_000


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, dims: int) -> DataFrame:
    """(vec_id, v): the kept vectors as arrays of integers."""
    x = F.col("__x")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("__x"))
    kept = rows.filter((F.size(x) == dims) & whole)
    most = float(LARGEST)
    return kept.select("vec_id", F.transform(x, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(most)), F.lit(-most))).cast("int")).alias("v"))


def smallest_hashes(rows: DataFrame, salt: str, n: int) -> np.ndarray:
    """The n vectors whose `salt:<vec_id>` has the smallest SHA-256; of equal ones the smaller components first."""
    key = F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.select(key.alias("key"), "v").orderBy("key", "v").limit(n).collect()
    return np.array([r["v"] for r in found], np.int64).reshape(len(found), len(found[0]["v"]) if found else 0)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to y (a row, or a row for each)."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, centroid_to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, exact squared distance) of each vector's nearest centroid, and how many exact distances it took."""
    n, k = len(x), len(centroids)
    least = np.zeros((n, k))
    for j in range(to_pivots.shape[1]):
        np.maximum(least, np.abs(to_pivots[:, j : j + 1] - centroid_to_pivots[None, :, j]), out=least)
    least -= SLACK * (to_pivots.max(initial=0) + centroid_to_pivots.max(initial=0))
    cluster = least.argmin(1)
    best = squared(x, centroids[cluster])
    asked = n
    first = cluster.copy()
    for c in range(k):
        open_ = np.flatnonzero((first != c) & (least[:, c] <= np.sqrt(best)))
        asked += len(open_)
        d = squared(x[open_], centroids[c])
        better = (d < best[open_]) | ((d == best[open_]) & (c < cluster[open_]))
        cluster[open_[better]], best[open_[better]] = c, d[better]
    return cluster, best, asked


def roots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(x, p) for p in pivots], 1).astype(np.float64)) if len(pivots) else np.zeros((len(x), 0))


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Rows of `width` numbers each from a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _pivot_table(pivots: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                b = batch.slice(lo, ROWS)
                x = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "v": _packed(x.astype("<i4")), "p": _packed(roots(x, pivots))})

    return run


def _assigned(batch: pa.RecordBatch, dims: int, pivots: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    to = roots(centroids, pivots)
    for lo in range(0, batch.num_rows, ROWS):
        b = batch.slice(lo, ROWS)
        x = _matrix(b.column("v"), "<i4", dims).astype(np.int64)
        yield b, x, *nearest(x, _matrix(b.column("p"), "<f8", len(pivots)), centroids, to)[:2]


def _sums(dims: int, pivots: np.ndarray, centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, x, cluster, _ in _assigned(batch, dims, pivots, centroids):
                order = np.argsort(cluster, kind="stable")
                at = np.flatnonzero(np.r_[True, np.diff(cluster[order]) > 0])
                total[cluster[order][at]] += np.add.reduceat(x[order], at, axis=0)
                count += np.bincount(cluster, minlength=len(centroids))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(used, pa.int32()), "n": pa.array(count[used]), "s": pa.array(list(total[used]), pa.list_(pa.int64()))})

    return run


def _labels(dims: int, pivots: np.ndarray, centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, _, cluster, best in _assigned(batch, dims, pivots, centroids):
                yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(best)})

    return run


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, salt: str = "3", vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) rows, and the final centroids.

    Starts from the k vectors of smallest hash; each of `rounds` rounds assigns every vector and replaces
    centroids that have vectors by floor(sum / count); then vectors are assigned once more."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, vec_id, embedding, dims)
    centroids = smallest_hashes(rows, salt, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    pivots = smallest_hashes(rows, f"pivot:{salt}", PIVOTS)
    table = stage(rows.mapInArrow(lean(_pivot_table(pivots)), "vec_id long, v binary, p binary"), "pivot-table")
    for _ in range(rounds):
        parts = table.mapInArrow(lean(_sums(dims, pivots, centroids)), "cluster int, n long, s array<long>")
        found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dims)]).collect()
        moved = centroids.copy()
        for r in found:
            moved[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
        if np.array_equal(moved, centroids):  # further rounds would give the same
            break
        centroids = moved
    return table.mapInArrow(lean(_labels(dims, pivots, centroids)), "vec_id long, cluster int, distance long"), centroids


def cluster_digest(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assignment with each cluster's and the whole inertia and a hash of the final centroid."""
    spark = assigned.sparkSession
    rows = stage(assigned, "clusters")
    sizes = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    named = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    whole = sizes.agg(F.sum("cluster_inertia").alias("inertia"))
    facts = F.broadcast(sizes.join(named, "cluster").crossJoin(F.broadcast(whole)))  # a row for each centroid
    return rows.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
