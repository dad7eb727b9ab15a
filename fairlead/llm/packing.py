"""Packing of token ids into rows of one length by best-fit-decreasing, and the binary output.

Every document's ids end with an end-of-text id, so that an empty document is a segment too. A document longer
than a row is split into whole rows and a rest; nothing is cut off. A task packs its documents in blocks: the
segments, longest first, each go to the open row with the least room that still holds them, found in a segment
tree over room. Rows come with their ids, the cumulative lengths of their segments, the positions (which start
anew with each segment, or go on where a split document goes on) and the segments' documents.

Defined results: a null text is empty. Documents with a null id are packed like others. Of equally long
segments the earlier one in the block is placed first. Rows are padded with the end-of-text id after the last
cumulative length. An empty table gives no rows; other columns are not needed, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_TOKENS = 4096
#: Tokens of a block; a longer document is a block of its own.
BLOCK_TOKENS = 1 << 22
MAX_VOCABULARY_BYTES = 64 << 20


class RoomTree:
    """Open rows by the room they have: a segment tree whose leaves are amounts of room."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]
        self.count = [0] * (2 * self.leaves)

    def _add(self, room: int, by: int) -> None:
        i = self.leaves + room
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``least``; rows with equal room, the last one put in."""
        i = self.leaves + least
        if not self.count[i]:
            # Up to the first right sibling that holds a row, then down its left side.
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of segment numbers; every size is from 1 to capacity."""
    rows: list[list[int]] = []
    tree = RoomTree(capacity)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = tree.take(sizes[k])
        if found is None:
            found = capacity, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(k)
        if room > sizes[k]:
            tree.put(room - sizes[k], row)
    return rows


def split(length: int, capacity: int) -> list[tuple[int, int]]:
    """Begin and end of a document's segments."""
    return [(a, min(a + capacity, length)) for a in range(0, length, capacity)]


SCHEMA = "input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<bigint>, doc_begins array<bigint>, n_tokens bigint"


def id_type(end_id: int) -> str:
    """Little-endian unsigned ids in 16 bits where the vocabulary (whose last id is the end) allows it, else 32."""
    return "<u2" if end_id < 1 << 16 else "<u4"


def pack_block(ids: list[np.ndarray], docs: list[int | None], capacity: int, pad: int) -> pa.RecordBatch:
    """The packed rows of a block as a batch of SCHEMA. Positions are little-endian unsigned 32-bit."""
    segments = [(d, a, b) for d, x in enumerate(ids) for a, b in split(len(x), capacity)]
    rows = best_fit([b - a for _, a, b in segments], capacity)
    columns: list[list] = [[] for _ in range(6)]
    for row in rows:
        matrix, positions, ends, at = np.full(capacity, pad, id_type(pad)), np.zeros(capacity, "<u4"), [0], 0
        for d, a, b in (segments[k] for k in row):
            matrix[at : at + b - a], positions[at : at + b - a] = ids[d][a:b], np.arange(a, b)
            at += b - a
            ends.append(at)
        for column, value in zip(columns, (matrix.tobytes(), ends, positions.tobytes(), [docs[segments[k][0]] for k in row], [segments[k][1] for k in row], at)):
            column.append(value)
    kinds = (pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], end_id: int, capacity: int = ROW_TOKENS, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Packed rows (SCHEMA) of all documents. ``encoder`` gives, inside a task, the function from a text to ids,
    none of which is above ``end_id``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        ids, names, total = [], [], 0
        for batch in batches:
            for name, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                own = np.append(encode(value.as_py() or ""), end_id).astype(id_type(end_id))
                if ids and total + len(own) > block_tokens:
                    yield from _sliced(pack_block(ids, names, capacity, end_id))
                    ids, names, total = [], [], 0
                ids.append(own)
                names.append(name)
                total += len(own)
        if ids:
            yield from _sliced(pack_block(ids, names, capacity, end_id))

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, SCHEMA)


def _sliced(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def tiktoken_encoder(path: str, pattern: str) -> Callable[[], Callable[[str], np.ndarray]]:
    """An encoder from a vocabulary file of ranks, which the driver reads; every task builds its own."""
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is no vocabulary: over {MAX_VOCABULARY_BYTES} bytes")

    def encoder() -> Callable[[str], np.ndarray]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: np.array(encoding.encode_ordinary(text), "<u4")

    return encoder


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet shards: id matrices row by row, cumulative lengths, positions, documents."""
    packed.write.mode("errorifexists").parquet(path)


def unpack(packed: DataFrame, id_bytes: int = 2) -> DataFrame:
    """The documents' ids from packed rows: doc_id, begin, ids (binary), one row per segment."""
    parts = packed.select("input_ids", F.explode(F.arrays_zip("doc_ids", "doc_begins", F.slice("cu_seqlens", F.lit(1), F.size("doc_ids")).alias("a"), F.slice("cu_seqlens", F.lit(2), F.size("doc_ids")).alias("b"))).alias("s"))
    return parts.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.doc_begins").alias("begin"), F.substring("input_ids", F.col("s.a") * id_bytes + 1, (F.col("s.b") - F.col("s.a")) * id_bytes).alias("ids"))
