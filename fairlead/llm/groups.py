"""Connected groups of linked ids by union-find in every task and star contraction between tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.operators.scan import settle

#: Links of one hub that one task takes; a larger hub's are dealt over several, up to MOST_SALTS.
HUB_LINKS = 100_000
MOST_SALTS = 64


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one task as a forest: each id with the smallest id of its group in this task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in parent]
    pairs = [(x, top) for x, top in pairs if x != top]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([t for _, t in pairs], pa.int64())], names=["u", "v"])


def _with_least(links: DataFrame, least: DataFrame, salts: int) -> DataFrame:
    """``links`` (u, v) with m, the smallest neighbour of u in ``least`` (u, m)."""
    if salts == 1:
        return links.join(least, "u")
    dealt = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    return dealt.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["u", "salt"]).drop("salt")


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _mark(links: DataFrame) -> tuple[tuple, int]:
    """What tells one round's links from another's, and the links of the largest hub."""
    hubs = links.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    n, x, most = hubs.agg(F.sum("n"), F.bit_xor("x"), F.max("n")).first()
    return (n or 0, x), most or 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every id in ``links`` (u, v) but the smallest of its group, which is the component.

    Links are BIGINT pairs with u and v apart. Every round is written to the shared folder; rounds end when
    every group is one star round its smallest id, after a number of rounds that grows with the logarithm of
    the longest chain.
    """
    stars = settle(links.mapInArrow(_union_find, "u bigint, v bigint"))
    before, most = _mark(stars)
    while before[0]:
        salts = min(MOST_SALTS, 1 + most // HUB_LINKS)
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Larger neighbours are tied to the smallest id in the neighbourhood, ...
        large = _with_least(both.where("v > u"), _least(both), salts).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # ... then smaller ones, and the id itself.
        small = _with_least(large, _least(large), salts)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        stars = settle(small.where("u <> v").distinct())
        now, most = _mark(stars)
        if now == before:
            break
        before = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
