"""Language-model scores that sum over all segmentations of a text into subword pieces.

Pieces come from an existing public vocabulary. Its scores give the first piece probabilities (their logarithms
as they are, or, where the scores are only merge ranks, falling with the rank); these are fitted to the training
words by expectation maximization, since every model but the tokenizer is trained here. A text is a row of
tokens (words between white space, A-Z lower-cased) and an end. A word's piece sequences begin with the word
mark, so the lattice of a text falls into the lattices of its words, and the text's log-probability is the sum
of its words' marginals and the end's. A word's marginal comes from the forward recursion in log space over its
bytes. A word of the training texts also has an edge of its own over the whole of it, weighted by its count less
a discount; the discounts of all words together are what the piece sequences share, so that all texts'
probabilities add up to one. Words of up to 64 bytes go through the recursion many at a time; a longer one (a
paragraph without blanks) by itself, stretch by stretch, in memory that doesn't grow with it. Every byte is a piece too, so every text has a probability above zero.

Texts are of one of a few kinds (by default their language), which the training documents tell: counts and
discounts are kept by kind, and a text's probability is the sum over kinds of the kind's share times the text's
probability in it. So a text of a rare language isn't measured by the words of the most frequent one, and no
kind has to be known for a text that is scored.

Words are counted over all documents with map-side sums; each distinct word's lattice is worked on once a round,
not once an occurrence. Tokens meet their word's marginal and training count in two ways: words that make up at
least 1 of ``HEAVY`` tokens are broadcast, at most ``HEAVY`` of them by that bound; the others are joined.

Defined results: a null text is empty and has one token, its end. A null doc_id counts as empty text in the
training rule. Rows come back one each; rows with the same id and text count as often as they stand there. Words
are joined by a 64-bit hash. Without training documents, counts are 0 and the first probabilities hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.llm import text as tx
from fairlead.operators.scan import settle

HEAVY = 1 << 20
#: Labels that may have counts of their own; more are refused, not put together.
MOST_KINDS = 256
ROUNDS = 2
#: What every training word's count gives to the piece sequences.
DISCOUNT = 0.75
#: Weight of the first probabilities in the fitted ones, in pieces.
PRIOR = 50.0
#: Bytes of words whose lattices are worked on together.
BLOCK_BYTES = 1 << 17
#: Longer words (in bytes) are walked one by one, this many bytes at a time.
LONG_BYTES = 64
WALK_BYTES = 1 << 16
MARK = "▁"
_LOG10 = np.log(10)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


class Pieces:
    """A vocabulary's pieces as bytes: those that begin a word (without the mark) and those inside one."""

    def __init__(self, pieces: list[tuple[bytes, bool, float]]):
        """``pieces``: bytes, whether they begin a word, weight."""
        self.first_weights = np.array([w for _, _, w in pieces])
        self.first_weights /= self.first_weights.sum()
        starts = np.array([s for _, s, _ in pieces])
        self.sets = []
        for begins in (True, False):
            chosen = np.flatnonzero(starts == begins)
            data = [pieces[i][0] for i in chosen]
            ends = np.cumsum([len(b) for b in data], dtype=np.int64)
            sizes = np.diff(np.concatenate([[0], ends]))
            flat = np.frombuffer(b"".join(data), np.uint8)
            words = tx.Words(flat, ends, ends - sizes, ends)
            self.sets.append((words.hashes(), chosen, sorted({int(n) for n in sizes if n})))
        self.mark_alone = next((i for i, (b, s, _) in enumerate(pieces) if s and not b), None)
        self.tables = None

    def ready(self) -> Pieces:
        if self.tables is None:
            self.tables = [tx.HashTable(h) for h, _, _ in self.sets]
        return self

    def __getstate__(self):
        return self.__dict__ | {"tables": None}


def read_weights(path: str) -> list[tuple[bytes, bool, float]]:
    """Pieces of a sentencepiece vocabulary file with their weights, read by the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        if model.is_byte(i):
            key = (bytes([int(piece[3:5], 16)]), False)
        elif MARK in piece[1:]:
            continue  # several words' marks: no word holds them
        else:
            key = (piece.removeprefix(MARK).encode(), piece.startswith(MARK))
        scores[key] = max(model.get_score(i), scores.get(key, -np.inf)) if not model.is_byte(i) else scores.get(key, -1e9)
    values = np.array([s for s in scores.values() if s > -1e8])
    ranks = bool(np.all(values == np.round(values)))
    # Merge ranks are 0, -1, -2, ...: a rank's weight falls as in Zipf's law. Bytes weigh as much as the last rank.
    floor = float(values.min())
    weigh = (lambda s: 1 / (10 - max(s, floor))) if ranks else (lambda s: float(np.exp(max(s, floor))))
    out = [(b, begins, weigh(s)) for (b, begins), s in scores.items()]
    have = {(b, begins) for b, begins, _ in out}
    out += [(bytes([x]), False, weigh(floor)) for x in range(256) if (bytes([x]), False) not in have]
    out += [] if (b"", True) in have else [(b"", True, weigh(0.0))]
    return out


def _sum_logs(parts: np.ndarray) -> np.ndarray:
    """log of the sum of exp along the first axis."""
    top = parts.max(axis=0)
    return top + np.log(np.exp(parts - top).sum(axis=0))


class Lattice:
    """Lattices of a block of words, the longest first."""

    def __init__(self, pieces: Pieces, logs: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        pieces.ready()
        self.logs, self.pieces = logs, pieces
        self.order = np.argsort(start - end, kind="stable")
        self.start, self.size = start[self.order], (end - start)[self.order]
        self.n, self.most = len(start), int(self.size.max(initial=0))
        # How many words have at least so many bytes: they are the first ones.
        self.long = np.searchsorted(-self.size, -np.arange(self.most + 2), side="right")
        sums = np.zeros(len(data) + 1, np.uint64)
        up, down = tx._power_table("up", tx._BASE, len(data) + 1), tx._power_table("down", pow(tx._BASE, -1, 1 << 64), len(data) + 1)
        np.cumsum(tx.BYTE_CODES[data] * up[: len(data)], out=sums[1:])
        self.sums, self.down = sums, down
        self.edges: dict[int, list] = {}

    def _ids(self, words: int, at: int, size: int, which: int) -> np.ndarray:
        """Piece number of the bytes at..at+size of the first ``words`` words, or -1."""
        begin = self.start[:words] + at
        raw = (self.sums[begin + size] - self.sums[begin]) * self.down[begin]
        hashes, numbers, _ = self.pieces.sets[which]
        found = self.pieces.tables[which].find(tx.mix(raw + np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64))))
        return np.where(found >= 0, numbers[found], -1)

    def forward(self, keep: bool = False) -> np.ndarray:
        """log P of every word, in the order of ``order``; keep: also what the backward pass needs."""
        self.alpha = np.full((self.most + 1, self.n), -np.inf)
        mark = self.pieces.mark_alone
        self.alpha[0] = self.logs[mark]
        out = self.alpha[0].copy()
        for j in range(1, self.most + 1):
            words = int(self.long[j])
            parts = []
            for which in (0, 1):
                for size in self.pieces.sets[which][2]:
                    if size > j or (which == 0 and size != j):
                        continue
                    ids = self._ids(words, j - size, size, which)
                    hit = np.flatnonzero(ids >= 0)
                    if len(hit):
                        if keep:
                            self.edges.setdefault(j, []).append((which, size, hit, ids[hit]))
                        value = np.full(words, -np.inf)
                        value[hit] = self.logs[ids[hit]] + (self.alpha[j - size, hit] if which else 0.0)
                        parts.append(value)
            self.alpha[j, :words] = _sum_logs(np.stack(parts))
            ends = slice(int(self.long[j + 1]), words)
            out[ends] = self.alpha[j, ends]
        return out

    def expected(self, weight: np.ndarray) -> np.ndarray:
        """Expected number of each piece, words weighted by ``weight`` (given in the words' own order)."""
        total = self.forward(keep=True)
        weight = weight[self.order]
        beta = np.full((self.most + 1, self.n), -np.inf)
        beta[self.size, np.arange(self.n)] = 0.0
        counts = np.zeros(len(self.logs))
        for j in range(self.most, 0, -1):
            for which, size, hit, ids in self.edges.get(j, []):
                through = self.logs[ids] + beta[j, hit]
                before = self.alpha[j - size, hit] if which else 0.0
                counts += np.bincount(ids, np.exp(before + through - total[hit]) * weight[hit], len(counts))
                if which:
                    beta[j - size, hit] = np.logaddexp(beta[j - size, hit], through)
        mark = self.pieces.mark_alone
        counts[mark] += float((np.exp(self.logs[mark] + beta[0] - total) * weight).sum())
        return counts


class Walk:
    """The lattice of one long word, walked stretch by stretch: edges are found for a whole stretch at once, and the
    recursion goes on byte by byte. Node 0 is before the word mark, node k + 1 before byte k."""

    def __init__(self, pieces: Pieces, logs: np.ndarray, word: np.ndarray):
        self.pieces, self.logs, self.word, self.n = pieces.ready(), logs, word, len(word)
        self.mark = pieces.mark_alone
        self.sizes = [s for s in pieces.sets[1][2] if s <= self.n]
        self.reach = max([1, *pieces.sets[1][2], *pieces.sets[0][2]])
        self.step = max(WALK_BYTES, self.reach)

    def _found(self, which: int, lo: int, hi: int, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges that begin at the bytes lo to hi: from node, to node, piece."""
        text = self.word[lo : min(self.n, hi + self.reach)]
        begins, ends, ids = [], [], []
        hashes, numbers, _ = self.pieces.sets[which]
        every = np.arange(len(text))
        for size in sizes:
            count = min(hi, self.n - size + 1) - lo
            if count <= 0:
                continue
            begin = every[:count]
            found = self.pieces.tables[which].find(tx.Words(text, begin, begin, begin + size).hashes())
            hit = np.flatnonzero(found >= 0)
            begins.append(lo + hit + 1)
            ends.append(lo + hit + 1 + size)
            ids.append(numbers[found[hit]])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(none + begins), np.concatenate(none + ends), np.concatenate(none + ids)

    def _first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges from node 0: the mark alone, and pieces that begin with it."""
        _, ends, ids = self._found(0, 0, 1, [s for s in self.pieces.sets[0][2] if 0 < s <= self.n])
        ends, ids = np.append(ends, 1), np.append(ids, self.mark)
        return np.zeros(len(ends), np.int64), ends, ids

    def forward(self, keep: bool = False) -> float:
        """log P of the word; keep: also of every node. Otherwise memory holds one stretch."""
        if keep:
            self.alpha = np.full(self.n + 2, -np.inf)
            self.alpha[0] = 0.0
        start = self._first()
        recent, base = [0.0], 0  # the last nodes' values, from node ``base`` on
        for lo in range(-1, self.n, self.step):
            hi = min(self.n, lo + self.step)  # nodes lo + 2 to hi + 1 come now
            begin, end, ids = self._found(1, max(0, lo - self.reach), hi, self.sizes)
            if lo <= self.reach:
                begin, end, ids = (np.concatenate(x) for x in zip((begin, end, ids), start))
            now = (end > lo + 1) & (end <= hi + 1)
            begin, end, ids = begin[now], end[now], ids[now]
            by = np.argsort(end, kind="stable")
            edges = np.searchsorted(end[by], np.arange(lo + 2, hi + 3)).tolist()
            source, weight = (begin[by] - base).tolist(), self.logs[ids[by]].tolist()
            for k in range(hi - lo):
                a, b = edges[k], edges[k + 1]
                if b - a == 1:
                    recent.append(recent[source[a]] + weight[a])
                    continue
                parts = [recent[i] + w for i, w in zip(source[a:b], weight[a:b])]
                top = max(parts)
                recent.append(top + math.log(math.fsum([math.exp(x - top) for x in parts])))
            if keep:
                self.alpha[lo + 2 : hi + 2] = recent[len(recent) - (hi - lo) :]
            cut = max(0, len(recent) - self.reach - 1)
            recent, base = recent[cut:], base + cut
        return recent[-1]

    def expected(self, counts: np.ndarray) -> None:
        """Adds the expected number of each piece to ``counts``."""
        total = self.forward(keep=True)
        beta = np.full(self.n + 2, -np.inf)
        beta[self.n + 1] = 0.0
        for hi in range(self.n, 0, -self.step):
            lo = max(0, hi - self.step)  # nodes lo + 1 to hi
            begin, end, ids = self._found(1, lo, hi, self.sizes)
            by = np.argsort(begin, kind="stable")
            edges = np.searchsorted(begin[by], np.arange(lo + 1, hi + 2)).tolist()
            target, weight = (end[by] - lo).tolist(), self.logs[ids[by]].tolist()
            near = beta[lo : hi + 1 + self.reach + 1].tolist()
            for k in range(hi - lo - 1, -1, -1):
                a, b = edges[k], edges[k + 1]
                parts = [near[i] + w for i, w in zip(target[a:b], weight[a:b])]
                top = max(parts)
                near[k + 1] = top + math.log(math.fsum([math.exp(x - top) for x in parts])) if b - a > 1 else top
            beta[lo + 1 : hi + 1] = near[1 : hi - lo + 1]
            counts += np.bincount(ids, np.exp(self.alpha[begin] + self.logs[ids] + beta[end] - total), len(counts))
        begin, end, ids = self._first()
        counts += np.bincount(ids, np.exp(self.logs[ids] + beta[end] - total), len(counts))


def _by_length(words: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Places of short words, these, and places of the long ones."""
    sizes = np.asarray(pc.binary_length(words))
    short, long = np.flatnonzero(sizes <= LONG_BYTES), np.flatnonzero(sizes > LONG_BYTES)
    return short, words.take(pa.array(short)) if len(long) else words, long


def _bytes_of(words: pa.Array, i: int) -> np.ndarray:
    return np.frombuffer(words[int(i)].as_buffer(), np.uint8)


def marginals(pieces: Pieces, logs: np.ndarray, words: pa.Array) -> np.ndarray:
    """log P of every word of a column under the piece probabilities."""
    out = np.zeros(len(words))
    short, column, long = _by_length(words)
    own = np.zeros(len(short))
    for part, lattice in lattices(pieces, logs, *_text_buffers(column)):
        values = np.empty(lattice.n)
        values[lattice.order] = lattice.forward()
        own[part] = values
    out[short] = own
    for i in long:
        out[i] = Walk(pieces, logs, _bytes_of(words, i)).forward()
    return out


def expected_pieces(pieces: Pieces, logs: np.ndarray, words: pa.Array) -> np.ndarray:
    """Expected number of each piece in the words of a column, each word once."""
    counts = np.zeros(len(logs))
    _, column, long = _by_length(words)
    for _, lattice in lattices(pieces, logs, *_text_buffers(column)):
        counts += lattice.expected(np.ones(lattice.n))
    for i in long:
        Walk(pieces, logs, _bytes_of(words, i)).expected(counts)
    return counts


def lattices(pieces: Pieces, logs: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[slice, Lattice]]:
    """Lattices of the words of a column, block by block. A block is short enough for its table of all word
    places; words of very different length aren't put into one table."""
    sizes = np.diff(offsets)
    lo, n = 0, len(sizes)
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, side="right")) - 1))
        while hi - lo > 1 and int(sizes[lo:hi].max()) * (hi - lo) > 16 * BLOCK_BYTES:
            hi = lo + (hi - lo) // 2
        at = offsets[lo : hi + 1] - offsets[lo]
        yield slice(lo, hi), Lattice(pieces, logs, data[offsets[lo] : offsets[hi]], at[:-1], at[1:])
        lo = hi


def _counted(kinds: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct words of each batch: word, hash, occurrences in all, in training documents of each kind."""
        for batch in batches:
            data, offsets = tx.buffers(batch.column("text"))
            kind = np.asarray(batch.column("kind"))
            found = []
            for lo, hi in tx.chunks(offsets):
                words = tx.words(data, offsets, lo, hi)
                hashes, first, where = np.unique(words.hashes(), return_index=True, return_inverse=True)
                # One column per kind, and one for documents held out (kind -1, the last).
                grid = np.bincount(where * (kinds + 1) + kind[lo:hi][words.doc] % (kinds + 1), minlength=len(hashes) * (kinds + 1))
                found.append((hashes, tx.take_bytes(words.text, words.start[first], words.end[first]), grid.reshape(-1, kinds + 1)))
            if not found:
                continue
            hashes, first, where = np.unique(np.concatenate([f[0] for f in found]), return_index=True, return_inverse=True)
            grid = np.concatenate([f[2] for f in found])
            sums = np.stack([np.bincount(where, grid[:, k], len(hashes)) for k in range(kinds + 1)]).astype(np.int64)
            words = pa.concat_arrays([f[1] for f in found]).take(pa.array(first))
            counts = [pa.array(sums.sum(axis=0)), *map(pa.array, sums[:kinds])]
            yield pa.RecordBatch.from_arrays([words, pa.array(hashes.view(np.int64)), *counts], names=["word", "hash", "total", *_counts(kinds)])

    return work


def _counts(kinds: int) -> list[str]:
    return [f"c{k}" for k in range(kinds)]


def _logs(kinds: int) -> list[str]:
    return [f"p{k}" for k in range(kinds)]


def _schema(longs: list[str], doubles: list[str] = ()) -> str:
    return ", ".join([f"{c} bigint" for c in longs] + [f"{c} double" for c in doubles])


def _text_buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return tx.buffers(words.cast(pa.large_binary()).view(pa.large_string()))


def count_words(rows: DataFrame, kinds: int) -> DataFrame:
    """word, hash, total and counts by kind over documents (text, kind), written to the shared folder."""
    names = ["total", *_counts(kinds)]
    words = rows.select("text", "kind").mapInArrow(_counted(kinds), "word binary, " + _schema(["hash", *names]))
    return settle(words.groupBy("word").agg(F.min("hash").alias("hash"), *[F.sum(c).alias(c) for c in names]))


def fit_pieces(words: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """log P of each piece, fitted to distinct words: each gives one discount to the pieces."""
    spark = words.sparkSession
    weights = pieces.first_weights
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, np.log(weights)))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, logs = shared.value
            counts = np.zeros(len(logs))
            for batch in batches:
                counts += expected_pieces(own, logs, batch.column("word"))
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["piece", "n"])

        # One row per piece of the vocabulary, however many words there are.
        sums = words.select("word").mapInArrow(work, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(len(weights))
        counts[np.asarray(sums.column("piece"))] = np.asarray(sums.column("n"))
        weights = (counts + PRIOR * pieces.first_weights) / (counts.sum() + PRIOR)
    return np.log(weights)


def score_words(words: DataFrame, pieces: Pieces, logs: np.ndarray, tokens: list[int], distinct: list[int]) -> DataFrame:
    """hash, total, train (count over kinds), p0, p1, ... (log10 of the marginal in each kind), plain (that of the
    lattice alone under the first probabilities), written to the shared folder. ``tokens``, ``distinct``: training tokens (ends too) and distinct training words by kind."""
    kinds = len(tokens)
    shared = words.sparkSession.sparkContext.broadcast((pieces, logs))
    # log of what the piece sequences share: all discounts, or, where nothing was learned, what no end takes.
    rest = [float(np.log(DISCOUNT * v / n)) if v else -float(np.log(2)) for n, v in zip(tokens, distinct)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, logs = shared.value
        first = np.log(own.first_weights)
        for batch in batches:
            spelled, plain = (marginals(own, x, batch.column("word")) for x in (logs, first))
            counts = [np.asarray(batch.column(c)) for c in _counts(kinds)]
            out = []
            for k, count in enumerate(counts):
                value, seen = spelled + rest[k], count > 0
                value[seen] = np.logaddexp(value[seen], np.log((count[seen] - DISCOUNT) / max(1, tokens[k])))
                out.append(pa.array(value / _LOG10))
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("total"), pa.array(np.sum(counts, axis=0)), *out, pa.array(plain / _LOG10)], names=["hash", "total", "train", *_logs(kinds), "plain"])

    return settle(words.mapInArrow(work, _schema(["hash", "total", "train"], [*_logs(kinds), "plain"])))


def _looked_up(shared, kinds: int, rare_only: bool):
    """Per document, sums over its heavy words (rare_only: instead its other words, each with its count)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, *logs = shared.value
        weights = [(counts > 0).astype(float), np.log10(counts + 1), *logs]
        for batch in batches:
            data, offsets = tx.buffers(batch.column("text"))
            for lo, hi in tx.chunks(offsets):
                n, words = hi - lo, tx.words(data, offsets, lo, hi)
                h, doc = words.hashes(), words.doc
                at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
                heavy = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
                part = batch.slice(lo, n)
                if rare_only:
                    by = np.lexsort((h[~heavy], doc[~heavy]))
                    doc, h = doc[~heavy][by], h[~heavy][by]
                    new = np.ones(len(h), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
                    times = np.diff(np.append(np.flatnonzero(new), len(h)))
                    keys = pa.array(doc[new])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(keys), part.column("digest").take(keys), pa.array(h[new].view(np.int64)), pa.array(times.astype(np.int64))], names=["doc_id", "digest", "hash", "times"])
                else:
                    at, own = at[heavy], doc[heavy]
                    sums = [np.bincount(own, w[at], n) if len(at) else np.zeros(n) for w in weights]
                    whole = [np.bincount(doc, minlength=n).astype(np.int64), np.bincount(doc[~heavy], minlength=n).astype(np.int64), sums[0].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "digest", "held_out")), *map(pa.array, [*whole, *sums[1:]])], names=["doc_id", "digest", "held_out", "tokens", "rare", "known", "log_counts", *_logs(kinds), "plain"])

    return work


def _kinds(rows: DataFrame, documents: int, least_share: float) -> list[str]:
    """The kinds of their own among the training documents, the largest first."""
    sizes = rows.where("train and label is not null").groupBy("label").count().where(F.col("count") >= least_share * documents)
    found = sizes.orderBy(F.desc("count"), "label").limit(MOST_KINDS + 1).collect()
    if len(found) > MOST_KINDS:
        raise ValueError(f"over {MOST_KINDS} kinds: give a least_share below which kinds are counted together, or another kind_col")
    return [r["label"] for r in found]


def score(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", kind_col: str | None = "lang", rounds: int = ROUNDS, heavy: int = HEAVY, least_share: float = 0.0) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, plain_score (log10).

    ``plain_score``: the sum of the words' lattice marginals under the vocabulary's own weights alone, without ends.
    ``least_share``: kinds with a smaller share of the training documents are counted as one (0: none are).

    ``vocabulary``: path of the sentencepiece file. ``kind_col``: the kind of each training document; the column
    may be missing, and no kind of a document held out is ever read.
    """
    pieces = Pieces(read_weights(vocabulary))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    label = F.col(kind_col).cast("string") if kind_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), held_out(F.col(id_col)).alias("held_out"), label.alias("label"))
    rows = rows.select("*", F.xxhash64("text").alias("digest"), (~F.col("held_out")).alias("train"))
    documents = rows.where("train").count()
    names = _kinds(rows, documents, least_share)
    place = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("label")) if names else F.lit(0)
    others = len(names)  # the number of the kind of all others
    rows = rows.withColumn("kind", F.when(F.col("held_out"), -1).otherwise(F.when(F.coalesce(place, F.lit(0)) > 0, place - 1).otherwise(others)).cast("bigint"))
    kinds = others + 1
    of_kind = {r["kind"]: r["count"] for r in rows.where("train").groupBy("kind").count().collect()}
    ends = [of_kind.get(k, 0) for k in range(kinds)]

    words = count_words(rows, kinds)
    train = sum(F.col(c) for c in _counts(kinds))
    sums = [F.sum(c) for c in ("total", *_counts(kinds))] + [F.count(F.when(F.col(c) > 0, 1)) for c in _counts(kinds)]
    every, *found = [x or 0 for x in words.agg(*sums, F.count(F.when(train > 0, 1))).first()]
    tokens, distinct = [n + e for n, e in zip(found[:kinds], ends)], found[kinds : 2 * kinds]
    n, v = sum(tokens), found[-1] + (documents > 0)
    logs = fit_pieces(words.where(train > 0), pieces, rounds if found[-1] else 0)
    scored = score_words(words, pieces, logs, tokens, distinct)

    # At most ``heavy`` words can make up one in ``heavy`` tokens each.
    columns = ["hash", "train", *_logs(kinds), "plain"]
    heavy = max(1, heavy * 10 // (len(columns) + 1))  # with more kinds fewer words, so that their table doesn't grow
    often = F.col("total") * F.lit(heavy) >= F.lit(every)
    top = scored.where(often).select(*columns).toArrow()
    hashes = np.asarray(top.column("hash")).view(np.uint64)
    by = np.argsort(hashes)
    shared = rows.sparkSession.sparkContext.broadcast((hashes[by], *(np.asarray(top.column(c))[by] for c in columns[1:])))
    schema = "doc_id bigint, digest bigint, held_out boolean, " + _schema(["tokens", "rare", "known"], ["log_counts", *_logs(kinds), "plain"])
    totals = rows.select("doc_id", "digest", "held_out", "text").mapInArrow(_looked_up(shared, kinds, False), schema)
    rare = rows.select("doc_id", "digest", "text").mapInArrow(_looked_up(shared, kinds, True), _schema(["doc_id", "digest", "hash", "times"]))
    met = rare.join(scored.where(~often).select(*columns), "hash")
    sums = met.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(
        F.sum("times").alias("rare_tokens"),
        F.sum(F.when(F.col("train") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.col("train") + 1)).alias("rare_log_counts"),
        *[F.sum(F.col("times") * F.col(p)).alias(f"rare_{p}") for p in (*_logs(kinds), "plain")],
    )
    out = totals.join(sums, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    # Rows with equal id and text have met as one document so many times over.
    times = F.coalesce(F.col("rare_tokens") / F.col("rare"), F.lit(1.0))
    both = lambda a: F.col(a) + F.coalesce(F.col(f"rare_{a}") / times, F.lit(0.0))
    whole = F.col("tokens") + 1
    base = both("log_counts") + F.lit(float(np.log10(documents + 1))) - whole * F.lit(float(np.log10(n + v + 1)))
    # The sum over kinds of share times probability; an end is as likely as it is frequent among the kind's tokens.
    parts = []
    for k, p in enumerate(_logs(kinds)):
        if ends[k]:
            parts.append(both(p) + F.lit(float(np.log10(ends[k] / documents) + np.log10(ends[k] / tokens[k]))))
        elif not documents:
            parts.append(both(p) + F.lit(float(np.log10(0.5))))
    best = F.greatest(*parts) if len(parts) > 1 else parts[0]
    score_ = best + F.log10(sum(F.pow(F.lit(10.0), part - best) for part in parts))
    known = both("known") + F.lit(int(documents > 0))
    return out.select("doc_id", "held_out", whole.alias("n_tokens"), F.round(known).cast("bigint").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), base.alias("base_score"), score_.alias("score"), both("plain").alias("plain_score"))
