"""Integer vectors, and exact sums of them by group, for the operators on embeddings."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors worked on at once in a task.
CHUNK = 4096


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    number = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(math.inf), F.lit(False)) & ~F.isnan(x)
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, number), F.lit(False))


def largest(dims: int) -> int:
    """Components are kept up to this amount, so that a squared distance stays below 2**62."""
    return min((1 << 31) - 1, math.isqrt((1 << 62) // dims) // 2)


def scaled(vector: str, scale: int, dims: int) -> Column:
    """floor(scale * x) for every component x, as integers."""
    most = F.lit(largest(dims))
    return F.transform(vector, lambda x: F.greatest(-most, F.least(most, F.floor(x.cast("double") * scale))).cast("int"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column without nulls as rows of int64."""
    return np.asarray(column.flatten(), np.int64).reshape(-1, dims)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances along the last axis."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def group_sums(groups: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, 1 + dims): for every group its number of rows and their componentwise sums."""
    out = np.zeros((n, 1 + rows.shape[1]), np.int64)
    out[:, 0] = np.bincount(groups, minlength=n)
    np.add.at(out[:, 1:], groups, rows)
    return out


def sum_cells(cells: DataFrame, shape: tuple[int, ...]) -> list[int]:
    """Exact sums of (cell, amount) over all tasks, as Python integers; there are as many cells as ``shape`` has,
    however many vectors."""
    sums = cells.groupBy("cell").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount")).toArrow()
    out = [0] * math.prod(shape)
    for cell, amount in zip(sums.column("cell").to_pylist(), sums.column("amount").to_pylist()):
        out[cell] = int(amount)
    return out


def cell_batch(sums: np.ndarray) -> pa.RecordBatch:
    """What one task adds to the cells: those that aren't zero."""
    flat = sums.ravel()
    some = np.flatnonzero(flat)
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(flat[some], pa.int64())], names=["cell", "amount"])


def moved(centres: np.ndarray, sums: list[int]) -> np.ndarray:
    """Every centre (n, dims) at the floor of its rows' mean; a centre without rows stays."""
    n, dims = centres.shape
    out = centres.copy()
    for i in range(n):
        count, *totals = sums[i * (dims + 1) : (i + 1) * (dims + 1)]
        if count:
            out[i] = [total // count for total in totals]
    return out
