"""Centroid clustering with scalar lookup tables.

Vectors are stored once as integers. In each round every task tabulates, per dimension,
the squared difference between each integer value that occurs in its rows and each
centroid; a distance is then a sum of gathers from these tables, in exact integers. What
leaves a task is one row of sums per centroid it met; what reaches the driver is one row
per centroid.

NULL vectors, vectors of another length and those with a NULL or non-finite component
are dropped; an empty table gives no rows. A NULL id counts as an empty one when starts
are chosen. Rows repeating an id are vectors of their own, ordered by their components
where their hashes tie. Fewer vectors than `clusters` give as many centroids as there are
vectors. Integers beyond `vectors.COMPONENT_BOUND` are set to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.vectors import exact_sum, integer_vectors, joined, matrix
from tidemark.sources.shared import materialise

ROWS = 4096  # rows whose distances to all centroids are held at once


@dataclass(frozen=True)
class ClusterOptions:
    clusters: int = 40
    rounds: int = 5
    scale: int = 256
    width: int = 64
    seed: str = "2:"


def cluster(rows: DataFrame, options: ClusterOptions = ClusterOptions()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 per vector."""
    vectors = materialise(
        integer_vectors(rows, options.scale).where(F.size("v") == options.width), "clusters-vectors"
    )
    centroids = first_centroids(vectors, options)
    for _ in range(options.rounds):
        centroids = moved(vectors, centroids)
    return described(assigned(vectors, centroids), centroids)


def first_centroids(vectors: DataFrame, options: ClusterOptions) -> np.ndarray:
    seeded = F.sha2(F.concat(F.lit(options.seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    least = vectors.select(seeded.alias("hash"), "v").orderBy("hash", "v").limit(options.clusters)
    found = sorted((r["hash"], r["v"]) for r in least.collect())
    return np.array([v for _, v in found], np.int64).reshape(len(found), options.width)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest number among the nearest centroids of each row, and the squared distance."""
    total = np.zeros((len(vectors), len(centroids)), np.int64)
    for d in range(vectors.shape[1]):
        values, at = _occurring(vectors[:, d])
        total += ((values[:, None] - centroids[None, :, d]) ** 2)[at]
    near = total.argmin(axis=1)
    return near.astype(np.int32), total[np.arange(len(total)), near]


def _occurring(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and the place of each row's value among them."""
    low = values.min()
    if values.max() - low < 4 * len(values):  # close together: found without a sort
        seen = np.bincount(values - low) > 0
        return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[values - low]
    return np.unique(values, return_inverse=True)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round; one without vectors stays."""
    count, width = centroids.shape

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, members = np.zeros((count, width), np.int64), np.zeros(count, np.int64)
        for _, rows in _slices(batches, width):
            near, _ = nearest(rows, centroids)
            order = np.argsort(near, kind="stable")
            met, first = np.unique(near[order], return_index=True)
            sums[met] += np.add.reduceat(rows[order], first, axis=0)
            members += np.bincount(near, minlength=count)
        for c in np.flatnonzero(members):
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], pa.int32()), pa.array([members[c]], pa.int64()), pa.array([sums[c].tolist()], pa.list_(pa.int64()))],
                ["cluster", "members", "sums"],
            )

    if not count:
        return centroids
    tallied = vectors.select("v").mapInArrow(tally, "cluster int, members long, sums array<bigint>")
    totals = tallied.groupBy("cluster").agg(
        F.sum("members").alias("members"), *(F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(width))
    )
    after = centroids.copy()
    for r in totals.collect():  # one row per centroid
        after[r["cluster"]] = [r[f"s{d}"] // r["members"] for d in range(width)]
    return after


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    width = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _slices(batches, width):
            near, distance = nearest(rows, centroids)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(near), pa.array(distance)], ["vec_id", "cluster", "distance"]
            )

    return materialise(
        vectors.select("vec_id", "v").mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters-assigned"
    )


def described(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`found` with the sums over clusters and over all, and each centroid's digest."""
    per_cluster = found.groupBy("cluster").agg(
        exact_sum("distance").alias("cluster_inertia"),
        F.sum(F.col("distance").cast("decimal(20,0)")).alias("exact"),
    )
    rows = per_cluster.collect()  # one row per centroid
    inertia = min(sum(int(r["exact"]) for r in rows), 2**63 - 1)
    known = found.sparkSession.createDataFrame(
        [
            (r["cluster"], r["cluster_inertia"], inertia, hashlib.sha256(joined(centroids[r["cluster"]]).encode()).hexdigest())
            for r in rows
        ],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array | None, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            ids = part.column("vec_id") if "vec_id" in part.schema.names else None
            yield ids, matrix(part.column("v"), width)
