"""Ordered look-back and look-ahead that stays parallel inside one boat.

A plain ``Window.partitionBy("boat_id").orderBy("time")`` puts a boat's whole history into one task.
Here the history is cut into slices (``slice_col``: a time slice, or the log file), every slice is
sorted by its own task, and only one summary row per slice is ordered per boat. What crosses a slice
border is joined back from those summaries, so the result is the same as with the plain window.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(
    df: DataFrame,
    keys: list[str],
    slice_col: str,
    order: list[str],
    *,
    prev: dict[str, Column] | None = None,
    nxt: dict[str, Column] | None = None,
    fill: dict[str, Column] | None = None,
    bfill: dict[str, Column] | None = None,
    fill_before: dict[str, Column] | None = None,
    bfill_after: dict[str, Column] | None = None,
    running_sum: dict[str, Column] | None = None,
    max_before: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds columns that look along ``order`` inside ``keys``.

    prev / nxt      value of the expression in the previous / next row
    fill / bfill    last non-null value up to / first non-null value from the current row
    fill_before / bfill_after   the same without the current row
    running_sum     sum up to the current row
    max_before      maximum of the rows before the current one
    """
    prev, nxt, fill, bfill = prev or {}, nxt or {}, fill or {}, bfill or {}
    fill_before, bfill_after = fill_before or {}, bfill_after or {}
    running_sum, max_before = running_sum or {}, max_before or {}
    part = [*keys, slice_col]
    here = Window.partitionBy(*part).orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    # Looking ahead is looking back from the end: a frame with an open end is gone through anew for every row.
    from_end = Window.partitionBy(*part).orderBy(*[F.desc(c) for c in order])
    onward = from_end.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = from_end.rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*[F.col(c) for c in order])

    # One summary row per slice.
    summaries = [F.count(F.lit(1)).alias("_rows")]
    for name, e in prev.items():
        summaries.append(F.max_by(F.struct(e.alias("v")), at).alias(f"_p_{name}"))
    for name, e in nxt.items():
        summaries.append(F.min_by(F.struct(e.alias("v")), at).alias(f"_n_{name}"))
    for name, e in {**fill, **fill_before}.items():
        summaries.append(F.max_by(e, F.when(e.isNotNull(), at)).alias(f"_f_{name}"))
    for name, e in {**bfill, **bfill_after}.items():
        summaries.append(F.min_by(e, F.when(e.isNotNull(), at)).alias(f"_b_{name}"))
    for name, e in running_sum.items():
        summaries.append(F.sum(e).alias(f"_s_{name}"))
    for name, e in max_before.items():
        summaries.append(F.max(e).alias(f"_m_{name}"))
    per_slice = df.groupBy(*part).agg(*summaries)

    # Ordered per boat over slices only (a few thousand rows for years of data).
    slices = Window.partitionBy(*keys).orderBy(slice_col)
    s_before = slices.rowsBetween(Window.unboundedPreceding, -1)
    s_after = Window.partitionBy(*keys).orderBy(F.desc(slice_col)).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.col(c) for c in part]
    for name in prev:
        carried.append(F.lag(f"_p_{name}").over(slices).alias(f"_p_{name}"))
    for name in nxt:
        carried.append(F.lead(f"_n_{name}").over(slices).alias(f"_n_{name}"))
    for name in [*fill, *fill_before]:
        carried.append(F.last(f"_f_{name}", ignorenulls=True).over(s_before).alias(f"_f_{name}"))
    for name in [*bfill, *bfill_after]:
        carried.append(F.last(f"_b_{name}", ignorenulls=True).over(s_after).alias(f"_b_{name}"))
    for name in running_sum:
        carried.append(F.sum(f"_s_{name}").over(s_before).alias(f"_s_{name}"))
    for name in max_before:
        carried.append(F.max(f"_m_{name}").over(s_before).alias(f"_m_{name}"))
    carry = per_slice.select(*carried)

    local = df
    made: list[str] = []

    def add(name: str, e: Column) -> None:
        nonlocal local
        local = local.withColumn(f"_l_{name}", e)
        made.append(name)

    base = df.columns
    for name, e in prev.items():
        add(name, F.lag(F.struct(e.alias("v"))).over(here))
    for name, e in nxt.items():
        add(name, F.lead(F.struct(e.alias("v"))).over(here))
    for name, e in fill.items():
        add(name, F.last(e, ignorenulls=True).over(upto))
    for name, e in fill_before.items():
        add(name, F.last(e, ignorenulls=True).over(before))
    for name, e in bfill.items():
        add(name, F.last(e, ignorenulls=True).over(onward))
    for name, e in bfill_after.items():
        add(name, F.last(e, ignorenulls=True).over(after))
    for name, e in running_sum.items():
        add(name, F.sum(e).over(upto))
    for name, e in max_before.items():
        add(name, F.max(e).over(before))

    joined = local.join(carry, part)
    out = [F.col(c) for c in base]
    for name in prev:
        out.append(F.coalesce(f"_l_{name}", f"_p_{name}")["v"].alias(name))
    for name in nxt:
        out.append(F.coalesce(f"_l_{name}", f"_n_{name}")["v"].alias(name))
    for name in [*fill, *fill_before]:
        out.append(F.coalesce(f"_l_{name}", f"_f_{name}").alias(name))
    for name in [*bfill, *bfill_after]:
        out.append(F.coalesce(f"_l_{name}", f"_b_{name}").alias(name))
    for name, e in running_sum.items():
        out.append((F.coalesce(f"_l_{name}", F.lit(0)) + F.coalesce(f"_s_{name}", F.lit(0))).alias(name))
    for name in max_before:
        out.append(F.greatest(f"_l_{name}", f"_m_{name}").alias(name))
    return joined.select(*out)


def time_slice(time_col: str, width_us: int) -> Column:
    """Number of the time slice a BIGINT microsecond column falls in."""
    return F.floor(F.col(time_col) / F.lit(width_us)).cast("bigint")


def slices_between(start: str, end: str, width_us: int) -> Column:
    """Array of the slices an inclusive interval touches, to turn a range join into an equi-join."""
    return F.sequence(time_slice(start, width_us), time_slice(end, width_us))


#: Levels of a dyadic cover: enough for all slices of a BIGINT of microseconds.
LEVELS = 44


def cover(lo: Column, hi: Column) -> Column:
    """An inclusive range of numbers as nodes (level, node) of the binary tree over all numbers: at most two a
    level, however long the range. A number is in the range if one of its ``ancestors`` is among them."""
    none = F.array().cast("array<struct<level:int,node:bigint>>")
    start = F.struct(lo.cast("bigint").alias("l"), (hi + 1).cast("bigint").alias("r"), none.alias("out"))

    def step(acc: Column, level: Column) -> Column:
        left, right = acc["l"], acc["r"]
        odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
        node = lambda x: F.array(F.struct(level.cast("int").alias("level"), x.alias("node")))
        from_left, from_right = (left < right) & odd(left), (left < right) & odd(right)
        out = F.concat(acc["out"], F.when(from_left, node(left)).otherwise(none), F.when(from_right, node(right - 1)).otherwise(none))
        up = lambda x: F.shiftright(x, 1)
        return F.struct(up(F.when(from_left, left + 1).otherwise(left)).alias("l"), up(F.when(from_right, right - 1).otherwise(right)).alias("r"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step, lambda acc: acc["out"])


def ancestors(x: Column) -> Column:
    """The nodes (level, node) that a number is under."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(x.cast("bigint"), k).alias("node")) for k in range(LEVELS + 1)])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach for intermediate tables: what the session names in
    spark.fairlead.dir or spark.checkpoint.dir, else the context's checkpoint folder, else a folder in the
    warehouse; on a cluster a warehouse that is a local folder is refused."""
    named = spark.conf.get("spark.fairlead.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local") and spark.conf.get("spark.sql.warehouse.dir").startswith("file:"):
        raise ValueError("no folder that all executors share: set spark.checkpoint.dir")
    named = named or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/_steps"
    return named.rstrip("/")


_scope: ContextVar[str] = ContextVar("steps", default="")


def steps_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie."""
    return f"{shared_folder(spark)}/fairlead/{spark.sparkContext.applicationId}{_scope.get()}"


@contextmanager
def passing_steps(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are deleted at the end: for a job whose results are written by then."""
    token = _scope.set(f"{_scope.get()}/{uuid.uuid4().hex}")
    own = steps_folder(spark)
    try:
        yield
    finally:
        _scope.reset(token)
        delete(spark, own)


def delete(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it back.

    Cuts the lineage, survives lost executors, and gives later steps column pruning and pushed
    filters on a step that several of them read.
    """
    spark = df.sparkSession
    path = f"{steps_folder(spark)}/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytecode of a method beyond which the JVM never compiles it.
JIT_BYTES = 8000


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs and streams started inside compute rows of very many columns in methods that the JVM compiles: Spark makes
    one method of all of them otherwise, which stays interpreted and takes several times as long for every row."""
    name = "spark.sql.codegen.hugeMethodLimit"
    old = spark.conf.get(name)
    spark.conf.set(name, str(JIT_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def settle_buckets(df: DataFrame, key: str) -> DataFrame:
    """Like ``settle``, bucketed by ``key`` into as many buckets as shuffles have partitions: a later join or group
    by ``key`` moves none of these rows. Nothing is shuffled for writing, so keys should come in runs."""
    spark = df.sparkSession
    name = f"step_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, key).option("path", f"{steps_folder(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved now, so that the name needn't stay in the catalog
    spark.sql(f"DROP TABLE {name}")  # its files stay
    return table


def remove_steps(spark: SparkSession) -> bool:
    """Deletes the application's intermediate tables, once a build's results are written where they belong.
    DataFrames that still read them can't be used any more."""
    return delete(spark, steps_folder(spark))
