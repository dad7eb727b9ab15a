"""Keeping the logbook current without building everything again.

Every trip of a boat but its newest is settled. A later run starts where nothing can change any more:
at the start of the stay before the newest trip, so the first trip of the new part always has its
stay, and never needs a wider window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlead.params import TripParams


def split_settled(trips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled, newest) trips."""
    w = Window.partitionBy("boat_id")
    df = trips.withColumn("_last", F.max("trip_no").over(w))
    return df.where("trip_no < _last").drop("_last"), df.where("trip_no = _last").drop("_last")


def resume_points(trips: DataFrame, params: TripParams) -> DataFrame:
    """Per boat where the next run starts: the start of the stay the newest trip left from (else its
    own start), with how many trips are settled and the signature they were built with."""
    _, newest = split_settled(trips)
    at = F.coalesce("prev_stay.start_us", "depart_us")
    return newest.select(
        "boat_id", "clock_epoch", at.alias("resume_us"), (F.col("trip_no") - 1).alias("settled_trips"), F.lit(params.signature()).alias("signature")
    )


def _since(series: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows at or after their boat's mark (``_from``); boats without a mark keep everything."""
    df = series.join(marks.withColumnRenamed("clock_epoch", "_e"), "boat_id", "left")
    late = (F.col("clock_epoch") > F.col("_e")) | ((F.col("clock_epoch") == F.col("_e")) & (F.col("time_us") >= F.col("_from")))
    return df.where(F.col("_from").isNull() | late).drop("_e", "_from")


def _last_before(series: DataFrame, resume: DataFrame, strict: bool = False) -> DataFrame:
    """Per boat the time of the last row of a series up to the resume point."""
    both = series.select("boat_id", "clock_epoch", "time_us").join(resume.select("boat_id", "clock_epoch", "resume_us"), ["boat_id", "clock_epoch"])
    upto = F.col("time_us") < F.col("resume_us") if strict else F.col("time_us") <= F.col("resume_us")
    return both.where(upto).groupBy("boat_id", "clock_epoch").agg(F.max("time_us").alias("last_us"))


def resume_tables(tables: dict[str, DataFrame], resume: DataFrame, intervals: DataFrame, params: TripParams, rows: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The input of the next run: what it needs of ``rows`` (by default of the tables themselves; else of the same
    series before a source was chosen).

    Positions from the resume point on, plus the one before it if a data gap lies between (a short
    stay may only count as a stay because of that gap). Every other series also keeps its last value
    before the point, which is carried forward into it; the engine series goes back to the end of the
    last engine interval before the stay, which bounds the engine-off time around it.
    """
    keys = ["boat_id", "clock_epoch"]
    base = resume.select(*keys, "resume_us")
    out = {}
    for name, df in tables.items():
        if name == "fixes":
            before = _last_before(df, resume, strict=True)
            mark = F.when(F.col("resume_us") - F.col("last_us") >= params.max_gap_us, F.col("last_us")).otherwise(F.col("resume_us"))
        elif name == "engine":
            ends = intervals.join(base, keys).where("on_end <= resume_us").groupBy(*keys).agg(F.max("on_end").alias("last_us"))
            before, mark = ends, F.coalesce("last_us", "resume_us")
        else:
            before, mark = _last_before(df, resume), F.coalesce("last_us", "resume_us")
        marks = base.join(before, keys, "left").select(*keys, mark.alias("_from"))
        out[name] = _since((rows or tables)[name], marks)
    return out


def combine(settled: DataFrame, fresh: DataFrame, resume: DataFrame) -> DataFrame:
    """Settled trips followed by the freshly built ones, numbered on."""
    base = resume.select("boat_id", F.col("settled_trips").alias("_base"))
    moved = fresh.join(base, "boat_id", "left").withColumn("trip_no", (F.col("trip_no") + F.coalesce("_base", F.lit(0))).cast("int"))
    return settled.unionByName(moved.drop("_base"), allowMissingColumns=True)


def resume_files(files: DataFrame, resume: DataFrame) -> DataFrame:
    """The file each boat is decoded from again: the last one that starts at or before the resume
    point, else its first."""
    df = files.join(resume.select("boat_id", "resume_us"), "boat_id")
    return df.groupBy("boat_id").agg(
        F.coalesce(F.max(F.when(F.col("first_us") <= F.col("resume_us"), F.col("file_no"))), F.min("file_no")).alias("file_no")
    )
