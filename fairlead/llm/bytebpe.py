"""Byte-level BPE through a global shuffle of distinct words, and decoding by a join with the token-byte table.

A text is cut into pretokens. Blocks of documents are written as one row each: the distinct pretokens of the block,
and for every document the places of its pretokens among them. The distinct pretokens of all blocks are exploded
with their place, brought together by word and sorted, so that each distinct word of the corpus is encoded once;
its ids go back to (block, place). There they meet the block's documents again, whose ids are read off by position.
A word that is in every text has one row a block, not one an occurrence, so no word is a hot key.

Encoding follows the ranks alone: a pretoken that is a token is that token; else the adjacent pair whose joined
bytes have the least rank is merged, the leftmost of equals first, until no pair has a rank. Pairs wait in a
queue and are skipped where a neighbour has changed since, so a pretoken of a million letters takes seconds.

Decoding is a map-side join: the ids of a batch are exploded, each meets its row of the token-byte table (as many
rows as the tokenizer has tokens, whatever the data; checked when it is read), and the bytes are put together by
position.

Defined results: a null text is empty and has no ids; invalid UTF-8 is made valid first (U+FFFD). Rows come back
one each, repeated rows and null ids too. Ids that are no tokens fail to decode. A text is one row, however long:
a document longer than a block is a block of its own. Other columns are not needed, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.operators.scan import settle_buckets

#: Text of a block, in characters.
BLOCK_CHARS = 32 << 20
MAX_RANKS_BYTES = 64 << 20
#: Words encoded before they are sent back, grouped by block.
HELD_ROWS = 1 << 19
#: Elements gathered at once; each takes three numbers in memory.
GATHERED = 1 << 20
_BLOCK = "block bigint, words array<binary>, doc_ids array<bigint>, counts array<int>, places binary"
_ENCODED = "block bigint, places binary, sizes binary, ids binary"


def read_ranks(path: str) -> bytes:
    """A file of ranks (a token in base64 and its rank a line), read by the driver."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANKS_BYTES + 1)
    if len(data) > MAX_RANKS_BYTES:
        raise ValueError(f"{path} is no file of ranks: over {MAX_RANKS_BYTES} bytes")
    return data


class Ranks:
    """Tokens by their bytes, and their bytes by id."""

    def __init__(self, data: bytes):
        self.rank: dict[bytes, int] = {}
        for line in data.splitlines():
            if line:
                token, rank = line.split()
                self.rank[base64.b64decode(token)] = int(rank)
        self.sizes = np.full(1 + max(self.rank.values(), default=-1), -1, np.int64)
        for token, rank in self.rank.items():
            self.sizes[rank] = len(token)
        self.length = self.sizes.tolist()
        ends = np.cumsum(np.maximum(self.sizes, 0))
        self.begins = ends - np.maximum(self.sizes, 0)
        flat = bytearray(int(ends[-1]) if len(ends) else 0)
        for token, rank in self.rank.items():
            flat[self.begins[rank] : self.begins[rank] + len(token)] = token
        self.flat = np.frombuffer(bytes(flat), np.uint8)

    def ids(self, word: bytes) -> list[int]:
        """Ids of one pretoken."""
        rank, length = self.rank, self.length
        whole = rank.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        end = list(range(1, n + 1))  # where the symbol that begins here ends; 0: none begins here any more
        begin = list(range(-1, n))  # where the symbol that ends here begins
        queue = [r << 32 | i for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapify(queue)
        while queue:
            top = heappop(queue)
            i = top & 0xFFFFFFFF
            k = i + length[top >> 32]  # a rank stands for its bytes, so it tells how far the pair reaches
            j = end[i]
            if not 0 < j < k or end[j] != k:
                continue
            end[i], end[j], begin[k] = k, 0, i
            if k < n and (r := rank.get(word[i : end[k]])) is not None:
                heappush(queue, r << 32 | i)
            if i and (r := rank.get(word[begin[i] : k])) is not None:
                heappush(queue, r << 32 | begin[i])
        out, i = [], 0
        while i < n:
            out.append(rank[word[i : end[i]]])
            i = end[i]
        return out

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The token-byte rows of ``ids``, one after the other, and the size of each."""
        if len(ids) and (int(ids.max()) >= len(self.sizes) or int(self.sizes[ids].min()) < 0):
            raise ValueError("an id is no token of this vocabulary")
        return _gather(self.flat, self.begins[ids], self.sizes[ids]), self.sizes[ids]


_built: dict[str, Ranks] = {}


def built(data: bytes) -> Ranks:
    """One table per worker process, kept between tasks."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Ranks(data)
    return _built[key]


def _gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin and last so long, one after the other."""
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, flat.dtype)
    lo = done = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, done + GATHERED, side="right")))
        own, upto = sizes[lo:hi], int(ends[hi - 1])
        out[done:upto] = flat[np.repeat(begins[lo:hi] - ends[lo:hi] + own, own) + np.arange(done, upto)]
        lo, done = hi, upto
    return out


def _binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte strings that end at ``ends`` (in bytes) of ``flat``."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    if offsets[-1] >= 1 << 31:
        raise ValueError("a block's ids take over 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


class _Places(dict):
    """The place of each pretoken among the block's distinct ones, in order of first occurrence."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 as four planes of bytes, compressed: most high bytes are zero."""
    planes = numbers.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    planes = pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), "zstd")
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _cut(pattern: str, block_chars: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokens = regex.compile(pattern).findall
        block = TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            # Frequent words get the small numbers. What is packed is let go at once: a block is large.
            counts, used = [len(s) for s in seen], np.concatenate(seen)
            seen.clear()
            by_use = np.argsort(-np.bincount(used, minlength=len(places)), kind="stable")
            rank = np.empty(len(by_use), np.uint32)
            rank[by_use] = np.arange(len(by_use))
            words = pa.array(list(places), pa.string()).take(pa.array(by_use)).cast(pa.binary())
            places.clear()
            np.take(rank, used, out=used, mode="clip")  # all are in range; this mode needs no copy
            values = [[block], None, [ids], [counts], [_packed(used)]]
            types = [pa.int64(), None, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            columns = [pa.array(v, t) if t else pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words) for v, t in zip(values, types)]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _BLOCK.split(", ")])

        places, ids, seen, chars = _Places(), [], [], 0
        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = value.as_py() or ""
                if ids and chars + len(text) > block_chars:
                    yield row()
                    block += 1
                    places, ids, seen, chars = _Places(), [], [], 0
                words = pretokens(text)
                ids.append(doc_id)
                seen.append(np.fromiter(map(places.__getitem__, words), np.uint32, len(words)))
                chars += len(text)
        if ids:
            yield row()

    return work


def _encode_words(shared):
    def by_block(rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """The words of many blocks as one row a block, so that what goes back is few and packed rows."""
        block, place, sizes, flat = (np.concatenate(x) for x in zip(*rows))
        order = np.argsort(block, kind="stable")
        begins = np.cumsum(sizes) - sizes
        block = block[order]
        edges = [*np.flatnonzero(np.diff(block, prepend=block[0] - 1)), len(block)]
        for lo, hi in zip(edges, edges[1:]):
            own = order[lo:hi]
            values = [[int(block[lo])], *([_packed(x)] for x in (place[own], sizes[own], _gather(flat, begins[own], sizes[own])))]
            types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=[c.split()[0] for c in _ENCODED.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by word: a word's rows follow each other, also from one batch to the next."""
        ranks, last = built(shared.value), (None, None)
        rows, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word").dictionary_encode()
            which, distinct = np.asarray(words.indices), words.dictionary.to_pylist()
            found = [last[1] if w == last[0] else ranks.ids(w) for w in distinct]
            last = distinct[which[-1]], found[which[-1]]
            sizes = np.array([len(x) for x in found], np.int64)
            flat = np.array([i for x in found for i in x], "<u4")
            rows.append((np.asarray(batch.column("block")), np.asarray(batch.column("place")), sizes[which], _gather(flat, (np.cumsum(sizes) - sizes)[which], sizes[which])))
            held += len(which)
            if held >= HELD_ROWS:
                yield from by_block(rows)
                rows, held = [], 0
        if rows:
            yield from by_block(rows)

    return work


def _reassemble(words: pa.Table, blocks: pa.Table) -> pa.Table:
    """One block: the ids of its distinct words, and its documents' places of words, read off some at a time."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    column = lambda name: np.concatenate([np.zeros(0, "<u4"), *map(_unpacked, words.column(name).to_pylist())])
    place, length, flat = column("places"), column("sizes"), column("ids")
    begins, sizes = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    begins[place], sizes[place] = np.cumsum(length, dtype=np.int64) - length, length
    out = []
    for row in range(blocks.num_rows):
        block = {name: blocks.column(name)[row] for name in ("doc_ids", "counts", "places")}
        used = _unpacked(block["places"].as_py())
        parts = [used[at : at + GATHERED] for at in range(0, len(used), GATHERED)]
        ends = np.cumsum([0, *(int(sizes[part].sum()) for part in parts)])
        all_ids = np.empty(int(ends[-1]), "<u4")
        # Where a document ends among the words is where it ends among the ids.
        borders = np.cumsum(np.concatenate([[0], np.asarray(block["counts"].values)]), dtype=np.int64)
        upto = np.zeros(len(borders), np.int64)
        for k, part in enumerate(parts):
            own = sizes[part]
            all_ids[ends[k] : ends[k + 1]] = _gather(flat, begins[part], own)
            here = (borders > k * GATHERED) & (borders <= k * GATHERED + len(part))
            upto[here] = ends[k] + np.cumsum(own)[borders[here] - k * GATHERED - 1]
        columns = [block["doc_ids"].values, pa.array(np.diff(upto)), _binary(all_ids.view(np.uint8), 4 * upto[1:])]
        out.append(pa.Table.from_arrays(columns, schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit). ``ranks`` is the path
    of a file of ranks, ``pattern`` what cuts a text into pretokens."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks))
    text = F.make_valid_utf8(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    blocks = settle_buckets(rows.mapInArrow(_cut(pattern, block_chars), _BLOCK), "block")
    exploded = blocks.select("block", F.posexplode("words").alias("place", "word"))
    encoded = exploded.repartition("word").sortWithinPartitions("word").mapInArrow(_encode_words(shared), _ENCODED)
    documents = blocks.select("block", "doc_ids", "counts", "places")
    return encoded.groupBy("block").cogroup(documents.groupBy("block")).applyInArrow(_reassemble, "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, ranks: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column decoded: the bytes that its ids (binary, as encode gives them; null: none) stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    if "decoded" in encoded.columns:
        raise ValueError("there is a column named decoded already")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = built(shared.value)
        for whole in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(whole.column(ids_col)), 0)) // 4
            at = 0
            while at < len(sizes):  # some rows at a time, or one alone
                rows = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), GATHERED, side="right")))
                batch = whole.slice(at, rows)
                values = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(ids_col).fill_null(b"")]
                data, lengths = tokens.bytes_of(np.concatenate(values))
                upto = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(sizes[at : at + rows])]
                yield pa.RecordBatch.from_arrays([*batch.columns, _binary(data, upto)], names=[*batch.schema.names, "decoded"])
                at += rows

    return encoded.mapInArrow(work, schema)
