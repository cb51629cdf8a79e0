"""Clustering by centroids: Lloyd's rounds in exact integers, in which only what a round has changed is compared again.

Each round's assignments are written to the shared folder with their vectors; the driver holds the sums and counts of the clusters, which are as
many as clusters times dimensions. A vector whose centroid has stayed keeps its distance and is compared with the changed centroids only; one whose
centroid has moved is compared with all. Vectors that change their cluster are added to one sum and taken from the other."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import dropped, written

#: Components are integers of at most this size, so that a squared distance in 64 dimensions fits into 64 bits.
LARGEST = 1 << 27
STATE = "vec_id long, x array<int>, before int, cluster int, distance long"
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def quantised(vectors: DataFrame, dimensions: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, x): the vectors of so many components, none null, infinite or not a number, as floor(scale * component).

    A component beyond LARGEST fails the job: its squared distance would not fit into the result's 64 bits."""
    whole = (F.size("embedding") == dimensions) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = lambda v: v.cast("double") * float(scale)
    integer = lambda v: F.when(F.abs(scaled(v)) < LARGEST, F.floor(scaled(v)).cast("int")).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST / scale:g}")).cast("int"))
    return vectors.where(whole).select(F.col("vec_id").cast("long"), F.transform("embedding", integer).alias("x"))


def distances(x: np.ndarray, centroids: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Squared distances of each row to the centroids of these numbers, in exact integers."""
    out = np.empty((len(x), len(which)), np.int64)
    for j, c in enumerate(which):
        gap = x - centroids[c]
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


def reassigned(x: np.ndarray, own: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) after the centroids marked in `changed` have moved; own is -1 where there is none yet. Ties go to the smaller number."""
    lost = (own < 0) | changed[own]
    moved, stayed = np.flatnonzero(changed), np.flatnonzero(~changed)
    best, least = own.astype(np.int64), distance.copy()
    best[lost], least[lost] = len(centroids), np.iinfo(np.int64).max

    def offered(rows: np.ndarray, which: np.ndarray) -> None:
        if len(which) and len(rows):
            each = distances(x[rows], centroids, which)
            at = each.argmin(axis=1)  # the first of equals, and `which` ascends
            d, c = each[np.arange(len(rows)), at], which[at]
            better = (d < least[rows]) | ((d == least[rows]) & (c < best[rows]))
            best[rows[better]], least[rows[better]] = c[better], d[better]

    offered(np.arange(len(x)), moved)
    offered(np.flatnonzero(lost), stayed)
    return best, least


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def assigned(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """A round's assignment of every vector; `before` is the cluster that it had."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vec_id, x, own, distance = (batch.column(i) for i in range(4))
                best, least = reassigned(matrix(x, centroids.shape[1]), own.to_numpy(zero_copy_only=False), distance.to_numpy(zero_copy_only=False), centroids, changed)
                yield pa.RecordBatch.from_arrays([vec_id, x, own, pa.array(best, pa.int32()), pa.array(least, pa.int64())], names=["vec_id", "x", "before", "cluster", "distance"])

    return state.select("vec_id", "x", "cluster", "distance").mapInArrow(each, STATE)


def transfers(state: DataFrame, clusters: int, dimensions: int) -> np.ndarray:
    """clusters x (dimensions + 1): what the vectors that have changed their cluster bring and take, their number last. Summed in each task, then by cluster and place."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((clusters, dimensions + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), dimensions)
                x = np.hstack([x, np.ones((len(x), 1), np.int64)])
                before, after = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                np.add.at(total, after, x)
                np.subtract.at(total, before[before >= 0], x[before >= 0])
        c, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[c, place])], names=["c", "place", "v"])

    rows = state.where("before <> cluster").select("x", "before", "cluster").mapInArrow(each, "c int, place int, v long")
    out = np.zeros((clusters, dimensions + 1), object)
    for r in rows.groupBy("c", "place").agg(F.sum("v").alias("v")).collect():  # at most clusters times dimensions rows
        out[r.c, r.place] = r.v
    return out


def clustered(vectors: DataFrame, clusters: int = 8, rounds: int = 10, seed: int = 3, dimensions: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, embedding) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, a row per kept vector.

    Centroids start as the vectors of the smallest sha256 of `<seed>:<vec_id>`, in that order; equal hashes go by their components, a null id counts as no text. Fewer vectors than
    clusters make fewer clusters. Each round assigns every vector and sets every centroid with vectors to the floor of their mean; then all are assigned
    once more. Where no centroid has changed, the rounds left would change nothing and are left out."""
    given = written(quantised(vectors.select("vec_id", "embedding"), dimensions, scale), "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = [r.x for r in given.orderBy(hashed, "x").limit(clusters).collect()]
    if not first:
        return given.sparkSession.createDataFrame([], OUT)
    centroids, clusters = np.array(first, np.int64), len(first)
    changed, totals = np.ones(clusters, bool), np.zeros((clusters, dimensions + 1), object)
    state = given.select("vec_id", "x", F.lit(-1).alias("before"), F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    for turn in range(rounds + 1):
        new = written(assigned(state, centroids, changed), "assigned")
        dropped(given if turn == 0 else state)
        state = new
        if turn == rounds:
            break
        totals += transfers(state, clusters, dimensions)
        means = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else list(c) for row, c in zip(totals, centroids, strict=True)], np.int64)
        changed, centroids = (means != centroids).any(axis=1), means
        if not changed.any():
            break
    sums = {r.cluster: int(r.d) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row per cluster
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of_cluster = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))
    return state.select(
        "vec_id", "cluster", "distance", of_cluster([sums.get(c, 0) for c in range(clusters)], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), of_cluster(digests, "string").alias("centroid_sha256"),
    )
