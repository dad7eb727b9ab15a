"""Compression of vectors to short codes: each is cut into parts, and each part becomes the number of the nearest
entry of its position's codebook. Nearest entries by slices of sorted coordinates and bitmasks.

For every component the codebook's entries are sorted by their coordinate, and every place in that order has the
mask of the entries before it. A part's first radius is its distance from one entry, so that the nearest one is
within it in every component. In each component the coordinates within the radius are one slice of the order, whose
entries are the two end masks' difference; the masks of all components, ANDed, are exactly the entries of the cube
round the part. Only these are compared, in ascending order, so that ties go to the smaller number. Masks are words
of 64 bits, as many as the codebook needs.

Vectors become integers once (``floor(scale * x)``) and are written; a round reads them and returns from every task
its counts and sums by (part, entry). Codebooks are broadcast: their size doesn't depend on the data. Sums are
exact, so the result doesn't depend on how rows are dealt out.

Defined results: rows whose vector is null or has a null or non-finite component are left out. All vectors must
have one length, a multiple of the parts: where ``dims`` isn't given, that of the least vec_id with such a length;
others are left out. Components beyond ``vectors.largest(dims)`` count as that. Rows with one vec_id are vectors of
their own; in the first codebooks, equal ids go by the vector and null ids come last. With fewer vectors than
entries each one is an entry. Errors of a label beyond 2**63 - 1 are given as that. Other columns are not needed,
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

#: Rows of one label meet the label's sum over so many keys.
SALTS = 16


class Slices:
    """A codebook (entries, width) of integers, its coordinates sorted, with the masks of their prefixes."""

    def __init__(self, book: np.ndarray):
        self.book = book
        n, width = book.shape
        order = np.argsort(book, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(book, order, 0).T)
        self.prefix = np.zeros((width, n + 1, (n + 63) // 64), np.uint64)
        bit = np.zeros((n, (n + 63) // 64), np.uint64)
        bit[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n, dtype=np.uint64) % np.uint64(64))
        for d in range(width):
            self.prefix[d, 1:] = np.bitwise_or.accumulate(bit[order[:, d]], axis=0)
        #: The component whose coordinates differ most: a part's first entry is its neighbour there.
        self.widest = int(np.argmax(book.max(axis=0) - book.min(axis=0))) if n else 0
        self.along = order[:, self.widest]

    def candidates(self, rows: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks (rows, words) of the entries that are within ``radius`` of each row in every component."""
        masks = np.full((len(rows), self.prefix.shape[2]), np.iinfo(np.uint64).max, np.uint64)
        for d, (coordinates, prefix) in enumerate(zip(self.sorted, self.prefix)):
            lo = np.searchsorted(coordinates, rows[:, d] - radius, "left")
            hi = np.searchsorted(coordinates, rows[:, d] + radius, "right")
            masks &= prefix[hi] ^ prefix[lo]
        return masks

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of its nearest entry, and the squared distance."""
        n = len(self.book)
        place = np.minimum(np.searchsorted(self.sorted[self.widest], rows[:, self.widest]), n - 1)
        best = vx.squared(rows, self.book[self.along[place]])
        # No smaller than the distance, whatever the square root's rounding; best + 1 is beaten by the entry itself.
        masks = self.candidates(rows, np.sqrt(best.astype(np.float64)).astype(np.int64) + 1)
        best, found = best + 1, np.zeros(len(rows), np.int64)
        for e in range(n):
            at = np.flatnonzero(masks[:, e // 64] >> np.uint64(e % 64) & np.uint64(1))
            distance = vx.squared(rows[at], self.book[e])
            closer = distance < best[at]
            found[at[closer]], best[at[closer]] = e, distance[closer]
        return found, best


def _encoded(shared, dims: int, sums: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Slices(b) for b in shared.value]
        parts, (entries, width) = len(books), shared.value[0].shape
        total = np.zeros((parts, entries, 1 + width), np.int64)
        digits = np.array([f"{i:02x}" for i in range(entries)])
        for batch in batches:
            rows = vx.matrix(batch.column("v"), dims).reshape(-1, parts, width)
            for lo in range(0, len(rows), vx.CHUNK):
                part = np.ascontiguousarray(rows[lo : lo + vx.CHUNK].transpose(1, 0, 2))
                found = [book.nearest(x) for book, x in zip(books, part)]
                if sums:
                    for p, (entry, _) in enumerate(found):
                        total[p] += vx.group_sums(entry, part[p], entries)
                else:
                    code = digits[found[0][0]]
                    for entry, _ in found[1:]:
                        code = np.char.add(code, digits[entry])
                    error = sum(distance for _, distance in found)
                    own = batch.slice(lo, vx.CHUNK)
                    yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])
        if sums:
            yield vx.cell_batch(total)

    return work


def fit(rows: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (parts, entries, width) after ``rounds`` rounds over vectors (v)."""
    parts, entries, width = books.shape
    for _ in range(rounds if books.size else 0):
        shared = rows.sparkSession.sparkContext.broadcast(books)
        cells = rows.select("v").mapInArrow(_encoded(shared, parts * width, True), "cell bigint, amount bigint")
        sums = vx.sum_cells(cells, (parts, entries, 1 + width))
        books = vx.moved(books.reshape(-1, width), sums).reshape(books.shape)
    return books


def compress(table: DataFrame, parts: int, entries: int, rounds: int, scale: int, dims: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("two hex digits number up to 256 entries")
    kept = table.where(vx.usable(vector_col)).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("x"))
    if dims is None:
        size = F.size("x")
        least = kept.where((size > 0) & (size % parts == 0)).orderBy(F.col("vec_id").asc_nulls_last(), size).select(size).first()
        dims = least[0] if least else parts
    rows = settle(kept.where(F.size("x") == dims).select("vec_id", "label", vx.scaled("x", scale, dims).alias("v")))
    first = [r["v"] for r in rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    books = np.array(first, np.int64).reshape(-1, parts, dims // parts).transpose(1, 0, 2)
    books = fit(rows, np.ascontiguousarray(books), rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    if books.size:
        shared = rows.sparkSession.sparkContext.broadcast(books)
        schema = rows.select("vec_id", "label").schema.simpleString()[len("struct<") : -1]
        found = settle(rows.mapInArrow(_encoded(shared, dims, False), f"{schema}, code string, error bigint"))
    else:
        found = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = found.groupBy("label").agg(F.least(most, F.sum(F.col("error").cast("decimal(38,0)"))).cast("bigint").alias("label_error"))
    salted = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    dealt = found.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    met = dealt.join(salted, F.col("label").eqNullSafe(F.col("_label")) & (F.col("salt") == F.col("_salt")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
