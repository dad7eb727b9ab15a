"""Byte-level BPE: encoding by a priority queue of merge ranks over a linked symbol list, and decoding.

A text is cut at added tokens, then into pretokens, whose bytes are the first symbols. All adjacent pairs that
a merge rule names go into a heap by (rank, position). The best one is taken out; if its symbols are no longer
what they were, it is stale and skipped; else the two are merged in a doubly linked list and the pairs with
both neighbours go into the heap. Decoding concatenates the vocabulary's byte strings.

The vocabulary is a file in the JSON format of public tokenizers, whose path is a parameter. It is read once by
the driver and broadcast; its size is the tokenizer's, not the data's, and is checked.

Defined results: a null text is empty and has no tokens; decoding ids that are not the tokenizer's fails;
bytes that are no UTF-8 are decoded with replacement characters. Texts of any length are encoded whole. Rows
come back as they were given, one each, ties and repeated rows too; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the pattern that cuts a text into pretokens.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_VOCABULARY_BYTES = 64 << 20
#: Encoded pretokens a task keeps; then it starts anew. About 200 bytes each.
CACHE = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Known(dict):
    """Ids of pretokens met before, as bytes; others are encoded when they are asked for."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, pretoken: str) -> bytes:
        symbols = self.bpe.merge(pretoken.encode())
        ids = struct.pack(f"<{len(symbols)}I", *symbols)
        if len(pretoken) <= 64:
            self[pretoken] = ids
        return ids


class Bpe:
    """A tokenizer read from the text of its file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocabulary, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.bytes_of = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.strings = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.of_byte = [0] * 256
        for c, b in alphabet.items():
            if c in vocabulary:
                self.of_byte[b] = vocabulary[c]
        #: Pair of ids -> an entry of the queue: rank, room for 32 bits of position, 24 bits of merged id.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocabulary[a] << 32 | vocabulary[b]] = rank << 56 | vocabulary[a + b]
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.pretokens = regex.compile(PRETOKEN).findall
        self.known = Known(self)

    def merge(self, pretoken: bytes) -> list[int]:
        """Ids of one pretoken."""
        ids = [self.of_byte[b] for b in pretoken]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges.get
        heap = []
        for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)):
            m = merges(a << 32 | b)
            if m is not None:
                heap.append(m | i << 24)
        if not heap:
            return ids
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i, merged = top >> 24 & 0xFFFFFFFF, top & 0xFFFFFF
            j = after[i]
            # Stale: the symbol is gone, has no follower any more, or either of the two has changed.
            if ids[i] < 0 or j >= n or merges(ids[i] << 32 | ids[j], 0) & 0xFFFFFF != merged:
                continue
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges(merged << 32 | ids[k])
                if m is not None:
                    heappush(heap, m | i << 24)
            h = before[i]
            if h >= 0:
                m = merges(ids[h] << 32 | merged)
                if m is not None:
                    heappush(heap, m | h << 24)
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> bytes:
        if len(self.known) > CACHE:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.pretokens(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not any(map(text.__contains__, self.added)):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.added[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for: the vocabulary's strings, one after the other."""
        tokens = np.frombuffer(ids, "<u4")
        sizes = self.sizes[tokens]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        # Byte k of the output is the byte of its token that lies as far from the token's first one.
        return self.strings[np.repeat(self.begins[tokens] - ends + sizes, sizes) + np.arange(total)].tobytes()


def read_vocabulary(path: str) -> str:
    """The file's text, read by the driver."""
    with open(path, encoding="utf-8") as f:
        text = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(text) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is no tokenizer file: over {MAX_VOCABULARY_BYTES} characters")
    return text


_built: dict[str, Bpe] = {}


def built(text: str) -> Bpe:
    """One tokenizer per worker process, kept between tasks."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Bpe(text)
    return _built[key]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids: also ids (binary, little-endian unsigned 32-bit);
    with_decoded: also decoded (the text that the ids stand for). ``vocabulary`` is the path of the file."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids + ", decoded string" * with_decoded

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = built(shared.value)
        for batch in batches:
            ids, counts, digests, texts, decoded = [], [], [], [], []
            for value in batch.column("text"):
                got = bpe.encode(value.as_py() or "")
                back = bpe.decode(got)
                try:
                    text = back.decode()
                except UnicodeDecodeError:
                    text = back.decode("utf-8", "replace")
                    back = text.encode()
                counts.append(len(got) // 4)
                digests.append(hashlib.sha256(got).hexdigest())
                texts.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    ids.append(got)
                if with_decoded:
                    decoded.append(text)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            columns += [pa.array(ids, pa.binary())] * with_ids + [pa.array(decoded, pa.string())] * with_decoded
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])
        bpe.known.clear()  # a worker lives on after its task

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, schema)
