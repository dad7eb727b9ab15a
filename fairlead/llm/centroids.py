"""Centroid clustering of vectors; nearest centroids by Orchard's search.

Every centroid has the list of the others, nearest first. A vector starts at one centroid and goes along its list;
where it meets a centroid that is closer, that one becomes the current one, and the search goes on in its list from
the start. Centroids looked at are marked and not looked at again. The search stops at the first centroid of the
list that is more than twice as far from the current one as the vector is: by the triangle inequality it and all
after it are farther from the vector. One exactly twice as far may tie, so it is still looked at; of equally near
centroids the smaller number is the current one. All vectors of a chunk take their steps together.

Vectors become integers once (``floor(scale * x)``) and are written; a round reads them, and returns from every
task its counts and sums by centroid. Centroids and their lists are broadcast: their size is the number of
centroids', whatever the data. All sums are exact, so the result doesn't depend on how rows are dealt out.

Defined results: rows whose vector is null, has another number of components or a null or non-finite one are left
out. Components beyond ``vectors.largest(dims)`` (2**27 at 64) count as that. Rows with one vec_id are vectors of
their own; as starting centroids, equal hashes go by the vector, and null ids come last. With fewer vectors than
centroids each one starts a centroid. Inertias beyond 2**63 - 1 are given as that. Other columns are not needed,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm import vectors as vx
from fairlead.operators.scan import settle


class Orchard:
    """Centroids (k, dims) of integers with their neighbour lists."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        between = np.stack([vx.squared(centroids, c) for c in centroids]) if k else np.zeros((0, 0), np.int64)
        order = np.argsort(between, axis=1, kind="stable")
        #: For each centroid the numbers of the others, nearest first.
        self.lists = order[order != np.arange(k)[:, None]].reshape(k, max(0, k - 1))
        # A centroid is more than twice as far if its squared distance is over four times as large.
        self.quarter = (np.take_along_axis(between, self.lists, 1) + 3) // 4

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of its nearest centroid, and the squared distance."""
        n, k = len(rows), len(self.centroids)
        current, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        best = vx.squared(rows, self.centroids[0])
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        going = np.arange(n)
        while True:
            going = going[at[going] < k - 1]
            going = going[self.quarter[current[going], at[going]] <= best[going]]
            if not len(going):
                return current, best
            other = self.lists[current[going], at[going]]
            at[going] += 1
            fresh = ~seen[going, other]
            row, other = going[fresh], other[fresh]
            seen[row, other] = True
            distance = vx.squared(rows[row], self.centroids[other])
            closer = (distance < best[row]) | (distance == best[row]) & (other < current[row])
            row, other = row[closer], other[closer]
            current[row], best[row], at[row] = other, distance[closer], 0


def _assigned(shared, dims: int, sums: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(shared.value)
        total = np.zeros((len(search.centroids), 1 + dims), np.int64)
        for batch in batches:
            rows = vx.matrix(batch.column("v"), dims)
            for lo in range(0, len(rows), vx.CHUNK):
                part = rows[lo : lo + vx.CHUNK]
                nearest, distance = search.nearest(part)
                if sums:
                    total += vx.group_sums(nearest, part, len(total))
                else:
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id")[lo : lo + vx.CHUNK], pa.array(nearest, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])
        if sums:
            yield vx.cell_batch(total)

    return work


def fit(rows: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after ``rounds`` rounds over vectors (v)."""
    k, dims = centroids.shape
    for _ in range(rounds if k else 0):
        shared = rows.sparkSession.sparkContext.broadcast(centroids)
        cells = rows.select("v").mapInArrow(_assigned(shared, dims, True), "cell bigint, amount bigint")
        centroids = vx.moved(centroids, vx.sum_cells(cells, (k, 1 + dims)))
    return centroids


def cluster(table: DataFrame, k: int, rounds: int, scale: int, dims: int, seed: str = "", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    The first centroids are the vectors with the least SHA-256 of ``seed`` and their id.
    """
    spark = table.sparkSession
    kept = table.where(vx.usable(vector_col) & (F.size(vector_col) == dims))
    rows = settle(kept.select(F.col(id_col).cast("bigint").alias("vec_id"), vx.scaled(vector_col, scale, dims).alias("v")))
    mark = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = [r["v"] for r in rows.select("v", mark.alias("mark")).orderBy(F.col("mark").asc_nulls_last(), "v").limit(k).collect()]
    centroids = fit(rows, np.array(first, np.int64).reshape(-1, dims), rounds)
    if not len(centroids):
        found = rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
    else:
        shared = spark.sparkContext.broadcast(centroids)
        found = settle(rows.mapInArrow(_assigned(shared, dims, False), "vec_id bigint, cluster int, distance bigint"))
    # One row per centroid.
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    most = (1 << 63) - 1
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = spark.createDataFrame([(i, min(most, sums.get(i, 0)), digest[i]) for i in range(len(centroids))], "cluster int, cluster_inertia bigint, centroid_sha256 string")
    every = F.lit(min(most, sum(sums.values()))).cast("bigint")
    return found.join(told, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", every.alias("inertia"), "centroid_sha256")
