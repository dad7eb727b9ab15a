"""Exact deduplication against a persistent digest index.

The index is a Parquet table with one row per distinct text, bucketed and sorted by the text's SHA-256.
A batch of new documents is reduced to one row per digest before it meets the index, and the two meet in a
sort-merge anti-join that moves no row of the index. Digests not seen yet are appended.

Defined results: a null text counts as the empty text. Of equal texts in one batch, the row with the largest
doc_id stays (null counts as smallest); a text that the index holds already keeps the doc_id it has there.
An index has one writer at a time: two that add at once may both append a digest (``compact`` mends that).
An empty batch adds nothing. Other columns are neither needed nor touched, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.operators.scan import delete, settle, shared_folder

INDEX_SCHEMA = "digest string, keep_id bigint, batch_count bigint"


def digest(text_col: str = "text") -> Column:
    """SHA-256 of the text in UTF-8, lower-case hex; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)


class DigestIndex:
    """The digests of all texts seen so far, in a folder that outlives the session."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({INDEX_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def read(self) -> DataFrame:
        """The index, with its bucketing: a join by digest shuffles nothing of it."""
        return self.spark.table(self.table)

    def files(self) -> DataFrame:
        """The same rows without the bucketing, for a join against skewed rows, which Spark can then split."""
        self.spark.catalog.refreshTable(self.table)
        return self.spark.read.schema(INDEX_SCHEMA).parquet(self.path)

    def new_digests(self, batch: DataFrame) -> DataFrame:
        """Of a batch (digest, doc_id): one row per digest that the index doesn't hold."""
        seen = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("batch_count"))
        return seen.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def add(self, batch: DataFrame) -> None:
        """Appends the digests of a batch (digest, doc_id) that the index doesn't hold yet. Run again after
        a failure it adds only what is missing: rows are committed with the job or not at all."""
        fresh = self.new_digests(batch)
        fresh.repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def compact(self, path: str) -> DigestIndex:
        """The same index in another folder, with one file a bucket (every batch adds one); of a digest that two
        writers have added at once, the first row by keep_id. This index stays as it is."""
        other = DigestIndex(self.spark, path, self.buckets)
        one = self.read().groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.min_by("batch_count", "keep_id").alias("batch_count"))
        one.repartition(self.buckets, "digest").write.insertInto(other.table)
        self.spark.catalog.refreshTable(other.table)
        return other

    def remove(self) -> None:
        """Deletes the index."""
        self.forget()
        delete(self.spark, self.path)

    def forget(self) -> None:
        """Takes the table's name out of the session; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def mark_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds the documents to the index and tells for each one which of its copies stays.

    Returns doc_id, keep_id, group_size (rows of this text in the batch that brought it), kept, text_sha256.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), digest(text_col).alias("digest"))
    index.add(rows)
    marked = rows.join(index.files(), "digest")
    return marked.select(
        "doc_id",
        "keep_id",
        F.col("batch_count").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def fresh_index(spark: SparkSession, buckets: int = 64) -> DigestIndex:
    """An index of its own in the shared folder."""
    return DigestIndex(spark, f"{shared_folder(spark)}/fairlead/digests-{uuid.uuid4().hex}", buckets)


def drop_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each text stays: the one that the index names once the batch
    is added. A text that an earlier batch brought stays only as the row that stayed then. Of rows that share id and
    text, the one that is least as JSON stays. The decision is settled here; the result doesn't read the index."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    keyed = docs.select(digest(text_col).alias("own_digest"), F.col(f"`{id_col}`").cast("bigint").alias("own_id"), row.alias("row"))
    index.add(keyed.select(F.col("own_id").alias("doc_id"), F.col("own_digest").alias("digest")))
    counted = keyed.groupBy("own_digest", "own_id").agg(F.count(F.lit(1)).alias("n"))
    stay = counted.join(index.files().select(F.col("digest").alias("own_digest"), "keep_id"), "own_digest").where(F.col("own_id").eqNullSafe(F.col("keep_id")))
    stay = settle(stay.select(F.col("own_digest").alias("digest"), F.col("own_id").alias("id"), "n"))
    # Digests decided; now every text is moved once, to meet its id.
    met = keyed.join(stay.hint("shuffle_hash"), (F.col("own_digest") == F.col("digest")) & F.col("own_id").eqNullSafe(F.col("id")))
    out = met.where("n = 1").select("row")
    if not stay.where("n > 1").isEmpty():
        several = met.where("n > 1").groupBy("digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = out.unionByName(several.select("row"))
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
