"""Local calendar keys, trip identifiers and totals over trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlead.functions.clocktime import day_of, local_us, rounded_minutes, utc_offset_hours
from fairlead.functions.ids import uuid5
from fairlead.functions.text import fixed
from fairlead.params import TripParams


def with_local_time(trips: DataFrame, params: TripParams) -> DataFrame:
    """Offset, local departure and arrival and calendar keys. The offset is estimated where the drawn
    track begins, which is the departure position."""
    if params.utc_offset_hours is not None:
        offset = F.lit(float(params.utc_offset_hours))
    else:
        offset = utc_offset_hours(F.col("depart_lat"), F.col("depart_lon"), F.col("depart_us"))
    df = trips.withColumn("offset_h", offset)
    df = df.withColumn("depart_local_us", local_us(F.col("depart_us"), F.col("offset_h")))
    df = df.withColumn("arrive_local_us", local_us(F.col("arrive_us"), F.col("offset_h")))
    df = df.withColumn("local_date", day_of(F.col("depart_local_us")))
    return df.withColumns(
        {
            "year": F.year("local_date"),
            "iso_year": F.extract(F.lit("YEAROFWEEK"), F.col("local_date")).cast("int"),
            "iso_week": F.weekofyear("local_date"),
        }
    )


def with_sequence(trips: DataFrame) -> DataFrame:
    w = Window.partitionBy("boat_id", "year").orderBy("depart_us", "trip_no")
    return trips.withColumn("seq_in_year", F.row_number().over(w))


def with_trip_uid(trips: DataFrame) -> DataFrame:
    """Identifier from local date and rounded end positions, with a counter for same-day repeats."""
    c = F.col
    place = F.concat(
        fixed(c("depart_lat"), 3), F.lit(","), fixed(c("depart_lon"), 3), F.lit("|"),
        fixed(c("arrive_lat"), 3), F.lit(","), fixed(c("arrive_lon"), 3),
    )
    df = trips.withColumn("_base", F.concat(F.date_format("local_date", "yyyy-MM-dd"), F.lit("|"), place))
    w = Window.partitionBy("boat_id", "_base").orderBy("depart_us", "trip_no")
    df = df.withColumn("trip_key", F.concat("_base", F.lit("|"), (F.row_number().over(w) - 1).cast("string")))
    return df.withColumn("trip_uid", uuid5(c("trip_key"))).drop("_base")


def totals(trips: DataFrame) -> DataFrame:
    """Totals per boat and per boat and year, in one pass. Hours add up the rounded minutes of the
    trips. ``year`` is NULL in the overall rows."""
    df = trips.withColumn("minutes", rounded_minutes(F.col("duration_us")))
    g = df.groupingSets([["boat_id"], ["boat_id", "year"]], "boat_id", "year").agg(
        F.count(F.lit(1)).alias("trip_count"),
        F.sum("distance_nm").alias("distance_nm"),
        F.sum("fuel_liters").alias("fuel_liters"),
        F.sum("fuel_liters_device").alias("fuel_liters_device"),
        (F.sum("minutes") / 60.0).alias("moving_hours"),
        F.max("max_speed_kn").alias("max_speed_kn"),
    )
    return derived_totals(g)


def derived_totals(g: DataFrame) -> DataFrame:
    c = F.col
    return g.withColumns(
        {
            "avg_l_per_nm": F.when(c("distance_nm") > 0, F.try_divide("fuel_liters", "distance_nm")),
            "avg_l_per_hour": F.when(c("moving_hours") > 0, F.try_divide("fuel_liters", "moving_hours")),
            "avg_speed_kn": F.when(c("moving_hours") > 0, F.try_divide("distance_nm", "moving_hours")),
        }
    )


def engine_totals(trip_engines: DataFrame) -> DataFrame:
    """Hours logged (sum) and the newest meter reading per instance, overall and per year. Input: one
    row per trip and instance with year, depart_us, engine_hours, engine_hours_total."""
    newest = F.max_by("engine_hours_total", F.when(F.col("engine_hours_total").isNotNull(), F.struct("depart_us", "trip_no")))
    return trip_engines.groupingSets(
        [["boat_id", "instance"], ["boat_id", "year", "instance"]], "boat_id", "year", "instance"
    ).agg(F.sum("engine_hours").alias("engine_hours"), newest.alias("engine_hours_current"))
