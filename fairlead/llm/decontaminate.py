"""Benchmark decontamination: windows of benchmark words found in documents through FM-indexes.

Words are lower-cased (A-Z) runs of digits, a-z and everything from U+0080. A benchmark item's windows are its
runs of ``window`` words; a shorter item is one window, one without words none. Every task builds an FM-index
for each shard of its documents, searches all windows backwards, locates what occurs and merges it to spans.
A shard's index holds the words that occur in windows; others are borders, which no window can reach across.
Pieces between borders that are shorter than the shortest window can't hold one and are left out.

No row is shuffled. Windows are broadcast in blocks of a stated size: items are numbered into blocks by their
bytes, and for each further block the documents are gone through once more, adding to what was found.

Defined results: a null text has no words; an item with a null text has none either; a null item_id counts as a
hit but isn't listed. Rows come back as they were, one each; repeated rows too. Documents of any length are
searched whole. An empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.llm.fmindex import FmIndex

WINDOW = 10
#: Words of documents per FM-index.
SHARD_WORDS = 1 << 20
#: Words of benchmark text broadcast at once (an item of more stands alone): some 10 MB, and a dictionary of its
#: distinct words in every worker, of 100 bytes each at most.
BLOCK_WORDS = 1 << 19
#: Windows searched for at once.
SEARCHED = 1 << 16

_words = re.compile(rb"[0-9a-z\x80-\xff]+")


def tokens(text: str | None) -> list[bytes]:
    return _words.findall((text or "").encode().lower())


class Phrases:
    """The distinct windows of a block of items. A window is a place in one array of word numbers, so a block takes
    some 20 bytes a word, and its vocabulary."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        vocabulary: dict[bytes, int] = {}
        self.window, self.items = window, [i for i, _ in items]
        ids = [np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in tokens(text)), np.int32) for _, text in items]
        lengths = np.array([len(x) for x in ids], np.int64)
        # An item of fewer words, but not none, is one window.
        counts = np.where(lengths > 0, np.maximum(lengths - window + 1, 1), 0)
        owner = np.repeat(np.arange(len(items)), counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.numbers = np.concatenate([*ids, np.zeros(window, np.int32)])
        self.starts = ((np.cumsum(lengths) - lengths)[owner] + within).astype(np.int32)
        self.sizes = np.minimum(lengths, window)[owner]
        rows = np.ascontiguousarray(self.table(0, len(self.starts)).astype(np.int32))
        _, first, same = np.unique(rows.view([("", np.int32)] * window).ravel(), return_index=True, return_inverse=True)
        self.starts, self.sizes = self.starts[first], self.sizes[first]
        held = np.unique(same.astype(np.int64) * max(1, len(items)) + owner)
        self.owner_at = np.searchsorted(held // max(1, len(items)), np.arange(len(first) + 1))
        self.owners = (held % max(1, len(items))).astype(np.int32)
        self.vocabulary, self.bits = vocabulary, max(1, len(vocabulary).bit_length())
        self.shortest = int(self.sizes.min()) if len(self.sizes) else 0

    def table(self, lo: int, hi: int) -> np.ndarray:
        """Word numbers of the windows lo to hi, zero behind a short one's end."""
        place = np.arange(self.window)
        rows = self.numbers[self.starts[lo:hi, None] + place].astype(np.int64)
        return np.where(place < self.sizes[lo:hi, None], rows, 0)


def find(texts: list[str | None], phrases: Phrases) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
    """For each text of a shard: its words, merged spans of hit words (begin, end), items (by place in the block)."""
    get = phrases.vocabulary.get
    numbers = []
    for text in texts:
        found = tokens(text)
        numbers.append(np.fromiter(map(get, found, repeat(0)), np.int64, len(found)))
    sizes = np.array([len(x) for x in numbers], np.int64)
    begins = np.cumsum(sizes) - sizes
    # Words of windows stand in pieces; a text's end ends a piece.
    padded = np.concatenate([x for pair in zip(numbers, repeat(np.zeros(1, np.int64))) for x in pair]) if len(texts) else np.zeros(0, np.int64)
    known = padded != 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
    first, end = edges[::2], edges[1::2]
    long = end - first >= max(1, phrases.shortest)
    first, end = first[long], end[long]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    if len(first) and len(phrases.sizes):
        # The index's text: the pieces, each with a border behind it; place[i] is where its symbol i stood.
        total = end - first + 1
        place = np.repeat(first - np.cumsum(total) + total, total) + np.arange(total.sum())
        index = FmIndex(padded[place], phrases.bits)
        parts = [index.search(phrases.table(lo, lo + SEARCHED), phrases.sizes[lo : lo + SEARCHED]) for lo in range(0, len(phrases.sizes), SEARCHED)]
        low, high = (np.concatenate(x) for x in zip(*parts))
        hits = np.flatnonzero(high > low)
        counts = (high - low)[hits]
        rows = np.repeat(low[hits] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        which = np.repeat(hits, counts)
        where = place[index.locate(rows)]
        doc = np.searchsorted(begins + np.arange(len(texts)), where, side="right") - 1
        begin = where - begins[doc] - doc
        # Which items: each occurring window stands for all the items that hold it.
        pairs = np.unique(doc * len(phrases.sizes) + which)
        for d, w in zip((pairs // len(phrases.sizes)).tolist(), (pairs % len(phrases.sizes)).tolist()):
            items[d].update(phrases.owners[phrases.owner_at[w] : phrases.owner_at[w + 1]].tolist())
        by = np.lexsort((begin, doc))
        for d, a, b in zip(doc[by].tolist(), begin[by].tolist(), (begin + phrases.sizes[which])[by].tolist()):
            mine = spans[d]
            if mine and a <= mine[-1][1]:
                mine[-1] = (mine[-1][0], max(b, mine[-1][1]))
            else:
                mine.append((a, b))
    return zip(sizes.tolist(), spans, items)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _shards(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about SHARD_WORDS words, at five bytes or more a word; a longer text stands alone."""
    lo, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "") // 5
        if i > lo and size + n > SHARD_WORDS:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
FOUND = "n_words bigint, spans array<struct<begin:bigint,end:bigint>>, items array<string>"


def blocks(benchmark: DataFrame, block_words: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The items with the number of their block, and how many blocks there are."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")), F.lit(0)).cast("bigint")
    total = items.agg(F.sum(words)).first()[0] or 0
    if total <= block_words:
        return items.withColumn("block", F.lit(0)), 1
    # Larger: by a running sum of words over groups of items, so that no task sees all of them.
    groups = max(1, 4 * total // block_words)
    items = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(groups)))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = items.groupBy("part").agg(F.sum(words).alias("size"))
    sizes = sizes.select("part", F.floor(F.coalesce(F.sum("size").over(upto), F.lit(0)) / F.lit(block_words)).cast("int").alias("block"))
    return items.join(sizes, "part").select("item", "text", "block"), total // block_words + 1


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, spans (merged, of hit words: begin, end), items (ids as sorted strings); keep_text: also text."""
    spark = docs.sparkSession
    items, count = blocks(benchmark, block_words, item_col, item_text_col)
    none = F.lit(None)
    out = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), none.cast("bigint").alias("n_words"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for block in range(count):
        chosen = [(r["item"], r["text"]) for r in items.where(F.col("block") == block).toLocalIterator()]
        shared = spark.sparkContext.broadcast(Phrases(chosen, window))
        out = out.mapInArrow(_work(shared, keep_text or block < count - 1), "doc_id bigint, " + ("text string, " if keep_text or block < count - 1 else "") + FOUND)
    return out


def _work(shared, keep_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n_words, spans, items = [], [], []
            before = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for lo, hi in _shards(texts):
                for i, (n, s, k) in enumerate(find(texts[lo:hi], phrases), lo):
                    s = merged([*s, *((x["begin"], x["end"]) for x in before[0][i])]) if before[0][i] else s
                    names = {phrases.items[x] for x in k} | set(before[1][i])
                    n_words.append(n)
                    spans.append([{"begin": a, "end": b} for a, b in s])
                    items.append(sorted(x for x in names if x is not None))
            columns = {"doc_id": batch.column("doc_id")} | ({"text": batch.column("text")} if keep_text else {})
            columns |= {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, pa.list_(_SPAN)), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict(columns)

    return work


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if not spans or text is None:
        return text
    raw = text.encode()
    at = [(m.start(), m.end()) for m in _words.finditer(raw.lower())]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that no benchmark window hits, all columns and rows as they are."""
    schema = docs.schema
    spark = docs.sparkSession
    items, count = blocks(benchmark, options.pop("block_words", BLOCK_WORDS), options.pop("item_col", "item_id"), options.pop("item_text_col", "text"))
    place = docs.columns.index(text_col)
    for block in range(count):
        chosen = [(r["item"], r["text"]) for r in items.where(F.col("block") == block).toLocalIterator()]
        shared = spark.sparkContext.broadcast(Phrases(chosen, options.get("window", WINDOW)))
        docs = docs.mapInArrow(_keep(shared, place), T.StructType(schema.fields))
    return docs


def _keep(shared, place: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            fine = [not s for lo, hi in _shards(texts) for _, s, _ in find(texts[lo:hi], shared.value)]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return work
