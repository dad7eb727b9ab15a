"""When the engine was running (from its fuel rate)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlead.operators.scan import time_slice
from fairlead.params import ENGINE_IDLE_FUEL_LPH, ENGINE_OFF_GAP_S, US, TripParams


def on_intervals(engine: DataFrame, params: TripParams, per_instance: bool = False) -> DataFrame:
    """Intervals with fuel use above idle; readings at most 60 s apart belong together.

    Readings are first joined up inside a time slice (one small row per slice and interval leaves the
    task), then across slice borders.
    """
    keys = ["boat_id", "clock_epoch", *(["instance"] if per_instance else [])]
    gap = ENGINE_OFF_GAP_S * US
    on = (
        engine.where(F.col("fuel_rate_lph") > ENGINE_IDLE_FUEL_LPH)
        .select(*keys, time_slice("time_us", params.chunk_us).alias("slice"), "time_us")
        .groupBy(*keys, "slice", "time_us")
        .count()
        .drop("count")
    )
    here = Window.partitionBy(*keys, "slice").orderBy("time_us")
    part = on.withColumn("_new", F.coalesce(F.col("time_us") - F.lag("time_us").over(here) > gap, F.lit(True)))
    part = part.withColumn("_no", F.sum(F.col("_new").cast("int")).over(here))
    part = part.groupBy(*keys, "slice", "_no").agg(F.min("time_us").alias("s"), F.max("time_us").alias("e"))
    whole = Window.partitionBy(*keys).orderBy("s")
    joined = part.withColumn("_new", F.coalesce(F.col("s") - F.lag("e").over(whole) > gap, F.lit(True)))
    joined = joined.withColumn("_no", F.sum(F.col("_new").cast("int")).over(whole))
    return joined.groupBy(*keys, "_no").agg(F.min("s").alias("on_start"), F.max("e").alias("on_end")).drop("_no")
