"""From raw documents to token ids: toxic documents go, then exact copies, near copies and documents with
benchmark passages; what is left is encoded. Every stage works on all that the one before it kept, written as
Parquet to the shared folder and read again; all but the last return the columns of ``documents``.

Documents with null ids, empty texts, repeated rows or further columns pass like others (each operator's
docstring says how); an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fairlead.llm import bpe, decontaminate, exact, minhash, toxicity
from fairlead.llm.workload import BYTE_BPE, table, vocabulary
from fairlead.operators.scan import delete, passing_steps, steps_folder

#: Least similarity of near copies, in percent.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model doesn't grade as toxic. It is fitted on the labelled ones among ``docs``."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id: the one that a digest index of this run names."""
    index = exact.fresh_index(spark)
    kept = exact.drop_copies(docs, index)
    index.remove()
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id."""
    return minhash.drop_near_copies(docs, NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.encode(docs, vocabulary(BYTE_BPE))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The fitted model, the signatures and the merges have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage made on its way is deleted when its rows are written, and these when the
    next stage's are."""
    docs, before, home = table(spark, sf_dir, "documents"), None, steps_folder(spark)
    for _, stage in STAGES:
        path = f"{home}/{uuid.uuid4().hex}"
        with passing_steps(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
