"""Centroid clustering with Elkan's bounds, exact to the integer.

Each vector keeps an upper bound of the distance to its centroid and a lower bound to each centroid.
When centroids move, bounds are loosened by how far; distances between centroids and the bounds then
rule out most centroids without a distance to the vector. Bounds are rounded outward at each step and
a centroid is ruled out only if it is strictly farther, so ties still go to the smaller number and
the result is that of comparing all exact integer distances.

Components are floor(scale * x), as integers; beyond LARGEST (either sign) they count as LARGEST, so
squared distances fit into a long. Vectors and bounds are kept in the shared folder and written anew
in each round by tasks that also give sums of their clusters; the driver gets one row of sums for
each centroid and holds the centroids alone. A lost executor's tasks read their part again.

Vectors of another length, null ones and those with null or non-finite components aren't kept. With
fewer kept vectors than centroids there are as many centroids as vectors. Null ids count as empty
text where the first centroids are chosen; rows that share an id go by their components. Repeated
vectors are all kept: a centroid that equals one of a smaller number stays empty and where it is.
Tables without kept vectors give an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import deleted, in_tasks, small_batches, stored

COMPONENTS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024.0, 8, 10, 3
LARGEST = 1 << 26
#: Vectors that are held against all centroids together.
TOGETHER = 4096


def kept(vectors: DataFrame, vector_col: str, components: int) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    return vectors.filter((F.size(v) == components) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def whole_numbers(vector: Column, scale: float) -> Column:
    limit = F.lit(float(LARGEST))
    return F.transform(vector.cast("array<double>"), lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * scale, limit), -limit)), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, along the last axis."""
    d = a.astype(np.int64) - b
    return np.einsum("...i,...i->...", d, d)


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x, -np.inf), 0.0)


@dataclass
class Geometry:
    """Centroids, half their distances to each other (rounded down), and how far each has moved (rounded up)."""

    centroids: np.ndarray
    moved: np.ndarray

    def __post_init__(self):
        k = len(self.centroids)
        between = np.sqrt(squared(self.centroids[:, None], self.centroids[None]).astype(np.float64))
        self.half = down(down(between) / 2)
        self.nearest = np.min(self.half + np.where(np.eye(k, dtype=bool), np.inf, 0), 1) if k > 1 else np.full(k, np.inf)


def assign_all(x: np.ndarray, g: Geometry) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster, upper and lower bounds of vectors that have none yet, and the number of distances worked out."""
    d = np.stack([squared(x, c) for c in g.centroids], 1)
    cluster = d.argmin(1)  # of equal ones the first
    root = np.sqrt(d.astype(np.float64))
    return cluster, up(root[np.arange(len(x)), cluster]), down(root), d.size


def assign_again(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, g: Geometry) -> int:
    """Brings clusters and bounds up to date after centroids have moved; the number of distances worked out."""
    k, computed = len(g.centroids), 0
    upper[:] = up(upper + g.moved[cluster])
    lower[:] = down(lower - g.moved)
    rows = np.flatnonzero(upper >= g.nearest[cluster])
    may = maybe(rows, cluster, upper, lower, g)
    rows, may = rows[may.any(1)], may[may.any(1)]
    if not len(rows):
        return computed
    own = squared(x[rows], g.centroids[cluster[rows]])
    computed += len(rows)
    upper[rows] = up(np.sqrt(own.astype(np.float64)))
    lower[rows, cluster[rows]] = down(np.sqrt(own.astype(np.float64)))
    may &= maybe(rows, cluster, upper, lower, g)
    best, best_d = cluster[rows].copy(), own
    for j in range(k):
        at = np.flatnonzero(may[:, j])
        if not len(at):
            continue
        d = squared(x[rows[at]], g.centroids[j])
        computed += len(at)
        lower[rows[at], j] = down(np.sqrt(d.astype(np.float64)))
        better = (d < best_d[at]) | ((d == best_d[at]) & (j < best[at]))
        best[at[better]], best_d[at[better]] = j, d[better]
    cluster[rows] = best
    upper[rows] = up(np.sqrt(best_d.astype(np.float64)))
    return computed


def maybe(rows: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, g: Geometry) -> np.ndarray:
    """Which centroids the bounds can't rule out for each row; never its own."""
    u, c = upper[rows][:, None], cluster[rows]
    may = (lower[rows] <= u) & (g.half[c] <= u)
    may[np.arange(len(rows)), c] = False
    return may


STATE = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("vector", T.BinaryType()), T.StructField("cluster", T.IntegerType()), T.StructField("upper", T.DoubleType()), T.StructField("lower", T.BinaryType()),
    T.StructField("sums", T.ArrayType(T.LongType(), False)), T.StructField("n", T.LongType()), T.StructField("computed", T.LongType()),
])


def one_round(rows: DataFrame, geometry: Geometry, components: int, name: str) -> DataFrame:
    """rows with clusters and bounds, and with a row of sums for each cluster of a task (vector is null there); stored."""
    shared, k = rows.sparkSession.sparkContext.broadcast(geometry), len(geometry.centroids)
    first = "cluster" not in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        sums, counts, computed = np.zeros((k, components), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(a, TOGETHER)
                n = part.num_rows
                if first:
                    x = np.ascontiguousarray(part.column(1).flatten().to_numpy(zero_copy_only=False), "<i4").reshape(n, components)
                    cluster, upper, lower, more = assign_all(x, g)
                else:
                    x = packed(part.column(1), "<i4").reshape(n, components)
                    cluster, upper = part.column(2).to_numpy().copy(), part.column(3).to_numpy().copy()
                    lower = packed(part.column(4), "<f8").reshape(n, k).copy()
                    more = assign_again(x, cluster, upper, lower, g)
                computed += more
                counts += np.bincount(cluster, minlength=k)
                for j in np.unique(cluster):
                    sums[j] += x[cluster == j].sum(0, dtype=np.int64)
                none = pa.nulls(n, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), binary(x, 4 * components), pa.array(cluster, pa.int32()), pa.array(upper), binary(lower, 8 * k), none, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=STATE.names)
        if counts.any():
            own = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * components, pa.int32()), pa.array(sums.ravel()))
            spent = pa.array([computed] + [0] * (k - 1), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(np.arange(k), pa.int32()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.binary()), own, pa.array(counts), spent], names=STATE.names)

    return stored(rows.mapInArrow(in_tasks(run), STATE), name)


def packed(column: pa.Array, kind: str) -> np.ndarray:
    """The values of a column of binary, one row after another."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(kind)


def binary(rows: np.ndarray, width: int) -> pa.Array:
    data = np.ascontiguousarray(rows, "<i4" if rows.dtype.kind == "i" else "<f8")
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(data)])


def first_centroids(ints: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the k smallest hashes."""
    hash_ = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = ints.select(hash_.alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    return np.array([r.vector for r in rows], np.int64)


@dataclass
class Clustering:
    """rows: vec_id, cluster and distance (squared); centroids; computed: distances worked out in each pass, of k for each vector."""

    rows: DataFrame
    centroids: np.ndarray
    computed: list[int]


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> Clustering:
    """Lloyd's rounds from the first centroids, and one assignment more."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = kept(vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("v")), "v", components)
    rows = rows.select("vec_id", whole_numbers(F.col("v"), scale).alias("vector"))
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids.reshape(0, components), [])
    moved, computed, before = np.zeros(len(centroids)), [], None
    for turn in range(rounds + 1):
        rows = one_round(rows, Geometry(centroids, moved), components, "vectors")
        if before:
            deleted(spark, before)
        before = rows.stored_at
        sums = rows.filter("sums IS NOT NULL").select("cluster", "n", "computed", F.posexplode("sums").alias("place", "x"))
        sums = sums.groupBy("cluster", "place").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("computed").alias("computed"))
        found = sums.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("xs"), F.max("n").alias("n"), F.max("computed").alias("computed")).collect()
        rows = rows.filter("vector IS NOT NULL").select("vec_id", "vector", "cluster", "upper", "lower")
        computed.append(sum(r.computed for r in found))
        if turn < rounds:
            new = centroids.copy()
            for r in found:
                if r.n:
                    new[r.cluster] = [x.x // r.n for x in r.xs]
            moved, centroids = up(np.sqrt(squared(new, centroids).astype(np.float64))), new
    last = centroids

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column(2).to_numpy()
            x = packed(batch.column(1), "<i4").reshape(batch.num_rows, components)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(squared(x, last[cluster]))], names=["vec_id", "cluster", "distance"])

    final = stored(rows.select("vec_id", "vector", "cluster").mapInArrow(in_tasks(distances), "vec_id long, cluster int, distance long"), "clusters")
    deleted(spark, before)
    return Clustering(final, centroids, computed)


def centroid_hashes(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
