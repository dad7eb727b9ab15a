"""Toxicity as ordered grades: a cumulative-link regression over sparse text features.

Grades are 0 (clean), 1 (toxic) and 2 (severely toxic). One weight per feature is shared by both thresholds:
P(grade >= k) = logistic(w.x - t_k) with t_1 < t_2. Labels say toxic or not; a toxic training text counts as
severe if it holds at least as many words tied to toxic texts as the median toxic training text.

Features are words and word beginnings of 4, 5 and 6 bytes (inflected forms share them), lower-cased (A-Z). Of
those in the training texts, the ones whose presence differs most between toxic and clean texts are kept, with
log(1 + count) as value. So a long clean text isn't a sum of many small weights.

The training sample is bounded: of the toxic and of the clean labelled texts, in order of their id's hash, as many
as ``SAMPLE`` texts and ``SAMPLE_BYTES`` bytes hold (a text that doesn't fit any more is passed over; of several
texts with one id, the least counts). Everything else covers all rows: every whole text is scored.

Defined results: a null or empty text has no features and gets the intercepts' grades. Labels with a null id or
flag and those without a document are ignored; of contradicting labels of one id, toxic counts. Without any
toxic or any clean labelled text, nothing is toxic. A text is toxic from a probability of ``REJECT_AT``. Rows come back one each, as they were given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.llm import text as tx

#: Labelled texts of either kind that the model is fitted on, at most.
SAMPLE = 2500
#: And their bytes, of either kind.
SAMPLE_BYTES = 32 << 20
FEATURES = 512
#: Least likelihood-ratio statistic of a kept feature.
LEAST_TIE = 12.0
PREFIXES = (4, 5, 6)
#: From this probability on a text counts as toxic: missing one costs more than losing one.
REJECT_AT = 0.3

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def features(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(document from lo, feature hash) of every word and word beginning."""
    words = tx.words(data, offsets, lo, hi, WORD)
    parts = [words.hashes(), *(words.prefix_hashes(n) for n in PREFIXES)]
    return np.tile(words.doc, len(parts)), np.concatenate(parts)


@dataclass
class Grades:
    """A fitted model: feature hashes, their weights, and the two thresholds."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def table(self) -> tx.HashTable:
        return tx.HashTable(self.hashes)

    def score(self, data: np.ndarray, offsets: np.ndarray, table: tx.HashTable) -> np.ndarray:
        """P(grade >= 1) and P(grade >= 2) of every row."""
        n, m = len(offsets) - 1, max(1, len(self.hashes))
        total = np.zeros(n)
        for lo, hi in tx.chunks(offsets):
            doc, value = features(data, offsets, lo, hi)
            at = table.find(value) if len(self.hashes) else np.full(len(value), -1)
            pair, count = np.unique((doc[at >= 0] + lo) * m + at[at >= 0], return_counts=True)
            total += np.bincount(pair // m, np.log1p(count) * self.weights[pair % m], n) if len(pair) else 0
        return logistic(total[:, None] - self.thresholds[None, :])


def logistic(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -x))


def fit(texts: list[str], toxic: np.ndarray, share: float, steps: int = 400) -> Grades:
    """A model from training texts; ``share`` of toxic texts among all labelled ones weights the two kinds."""
    nothing = Grades(np.zeros(0, np.uint64), np.zeros(0), np.array([50.0, 60.0]))
    n, n_toxic = len(texts), int(toxic.sum())
    if not n_toxic or n_toxic == n:
        return nothing
    data, offsets = tx.buffers(pa.array(texts, pa.large_string()))
    # Texts that hold each feature, by kind; texts are gone through twice, so that only chosen features are kept.
    known, held = np.zeros(0, np.uint64), np.zeros((2, 0))
    for lo, hi in tx.chunks(offsets):
        doc, value = features(data, offsets, lo, hi)
        by = np.lexsort((value, doc))
        doc, value = doc[by], value[by]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        doc, value = doc[new] + lo, value[new]
        merged, place = np.unique(np.concatenate([known, value]), return_inverse=True)
        rows = [np.bincount(place, np.concatenate([held[k], (toxic[doc] == bool(k)).astype(float)]), len(merged)) for k in (0, 1)]
        known, held = merged, np.stack(rows)
    # How much more likely presence is if toxic and clean texts have rates of their own.
    b, a = held
    na, nb = float(n_toxic), float(n - n_toxic)
    rate = (a + b) / n

    def entropy(x: np.ndarray, size: float, p: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(p, 1e-12)) + (size - x) * np.log(np.maximum(1 - p, 1e-12))

    tie = 2 * (entropy(a, na, a / na) + entropy(b, nb, b / nb) - entropy(a, na, rate) - entropy(b, nb, rate))
    best = np.argsort(-tie, kind="stable")[:FEATURES]
    best = best[tie[best] >= LEAST_TIE]
    if not len(best):
        return nothing
    x, table = np.zeros((n, len(best))), tx.HashTable(known[best])
    for lo, hi in tx.chunks(offsets):
        doc, value = features(data, offsets, lo, hi)
        at = table.find(value)
        pair, count = np.unique((doc[at >= 0] + lo) * len(best) + at[at >= 0], return_counts=True)
        x[pair // len(best), pair % len(best)] = np.log1p(count)
    # Severe: many words tied to toxic texts. A word is counted once, by its whole form or its longest beginning.
    bad = a[best] / na > b[best] / nb
    amount = np.expm1(x[:, bad]).max(axis=1) + (x[:, bad] > 0).sum(axis=1) if bad.any() else np.zeros(n)
    grade = np.where(toxic, 1 + (amount >= np.median(amount[toxic])), 0)
    weight = np.where(toxic, share / na, (1 - share) / nb)
    return Grades(known[best], *cumulative_link(x, grade, weight / weight.sum(), steps))


def cumulative_link(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, steps: int, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds by maximum likelihood with a penalty (Adam, all rows per step)."""
    m = x.shape[1]
    p = np.concatenate([np.zeros(m), [2.0, 0.0]])  # weights, first threshold, log of the distance to the second
    first, second = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        t = np.array([p[m], p[m] + np.exp(p[m + 1])])
        above = logistic((x @ p[:m])[:, None] - t)
        one, two = above[:, 0], above[:, 1]
        # Likelihood of each row's grade, and its slope by either logit.
        slope1, slope2 = one * (1 - one), two * (1 - two)
        middle = np.maximum(one - two, 1e-12)
        g1 = np.where(grade == 0, -one, np.where(grade == 1, slope1 / middle, 0.0)) * weight
        g2 = np.where(grade == 2, 1 - two, np.where(grade == 1, -slope2 / middle, 0.0)) * weight
        gradient = np.concatenate([x.T @ (g1 + g2) - penalty * p[:m], [-(g1 + g2).sum(), -g2.sum() * np.exp(p[m + 1])]])
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        p = p + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return p[:m], np.array([p[m], p[m] + np.exp(p[m + 1])])


def within(sizes: list[int], room: int) -> list[bool]:
    """Which of the texts, taken in order, fit into ``room`` bytes."""
    out = []
    for size in sizes:
        out.append(size <= room)
        room -= size if out[-1] else 0
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", flag_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Grades:
    """Fits the model on labelled documents."""
    spark = docs.sparkSession
    flags = labels.select(F.col(id_col).cast("bigint").alias("id"), (F.col(flag_col) > 0).alias("toxic")).dropna().groupBy("id").agg(F.max("toxic").alias("toxic"))
    shares = {r["toxic"]: r["count"] for r in flags.groupBy("toxic").count().collect()}
    known = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Ids and sizes first, so that only the sample's texts are moved.
    sizes = known.groupBy("id").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    ids: dict[int, bool] = {}
    for kind in (True, False):
        some = flags.where(F.col("toxic") == F.lit(kind)).join(sizes, "id").orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "size").collect()
        ids |= {r["id"]: kind for r, fits in zip(some, within([r["size"] for r in some], sample_bytes)) if fits}
    if not ids:
        return fit([], np.zeros(0, bool), 0.0)
    chosen = spark.createDataFrame([(i,) for i in ids], "id bigint")  # at most twice the sample
    rows = known.join(F.broadcast(chosen), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")).orderBy("id").collect()
    toxic = np.array([ids[r["id"]] for r in rows], bool)
    total = sum(shares.values())
    return fit([r["text"] or "" for r in rows], toxic, shares.get(True, 0) / total if total else 0.0)


def grade(docs: DataFrame, model: Grades, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, p_toxic, p_severe, expected_severity (0 to 2), grade (the likeliest), toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.table()
        for batch in batches:
            p = shared.value.score(*tx.buffers(batch.column("text")), table)
            chances = np.stack([1 - p[:, 0], p[:, 0] - p[:, 1], p[:, 1]], axis=1)
            columns = {"doc_id": batch.column("doc_id"), "p_toxic": p[:, 0], "p_severe": p[:, 1], "expected_severity": p.sum(axis=1), "grade": chances.argmax(axis=1).astype(np.int64), "toxic": p[:, 0] >= REJECT_AT}
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, p_toxic double, p_severe double, expected_severity double, grade bigint, toxic boolean")


def keep_clean(docs: DataFrame, model: Grades, text_col: str = "text") -> DataFrame:
    """The documents that aren't toxic, all columns and rows as they are."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.table()
        for batch in batches:
            p = shared.value.score(*tx.buffers(batch.column(place)), table)
            yield batch.filter(pa.array(p[:, 0] < REJECT_AT))

    return docs.mapInArrow(work, T.StructType(docs.schema.fields))
