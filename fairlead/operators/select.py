"""Which device a series is taken from: one source per message type and boat, over all files.

Every choice is a count per (boat, source) with partial aggregation, a rank over the handful of
sources of a boat, and a semi-join that Spark turns into a broadcast when the winners are few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlead.operators.scan import settle


def count_by(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy("boat_id", by).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def top_choice(counts: DataFrame, by: str) -> DataFrame:
    """The source (or instance) with most messages per boat; on a tie the one seen first."""
    w = Window.partitionBy("boat_id").orderBy(F.col("n").desc(), "first_seq")
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("boat_id", by, "n")


def keep_dominant(df: DataFrame, by: str = "source") -> DataFrame:
    return df.join(top_choice(count_by(df, by), by).select("boat_id", by), ["boat_id", by], "left_semi")


def primary_gps(fixes: DataFrame, sog: DataFrame) -> DataFrame:
    """Per boat the leading position source, and the source its speed is taken from: the same one
    if it sends speed at all, else the busiest speed source."""
    return gps_sources(count_by(fixes, "source"), count_by(sog, "source"))


def gps_sources(fix_counts: DataFrame, sog_counts: DataFrame) -> DataFrame:
    lead = top_choice(fix_counts, "source").select("boat_id", F.col("source").alias("fix_source"))
    own = sog_counts.select("boat_id", F.col("source").alias("fix_source"), F.col("source").alias("own_sog"))
    busiest = top_choice(sog_counts, "source").select("boat_id", F.col("source").alias("any_sog"))
    # Full join: a boat without any position still keeps its busiest speed source.
    return (
        lead.join(own, ["boat_id", "fix_source"], "left")
        .join(busiest, "boat_id", "full")
        .select("boat_id", "fix_source", F.coalesce("own_sog", "any_sog").alias("sog_source"))
    )


def keep_dominant_engine(engine: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """For a boat known to have one engine: only the instance with most engine samples, in the engine
    series and in the series that go with it."""
    chosen = top_choice(count_by(engine, "instance"), "instance").select("boat_id", "instance")
    return [df.join(chosen, ["boat_id", "instance"], "left_semi") for df in (engine, *others)]


BY_SOURCE = ("depth", "water_temp", "battery", "attitude", "wind", "stw", "outside_temp", "humidity")


def source_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(boat_id, series, source, n, first_seq) of every series that is taken from one source, and of the engine
    instances (series engine_instance). Counts of several runs can be added up: see add_counts."""
    parts = [count_by(tables[n], "source").withColumn("series", F.lit(n)) for n in ("fixes", "sog", *BY_SOURCE) if n in tables]
    if "engine" in tables:
        parts.append(count_by(tables["engine"], "instance").withColumnRenamed("instance", "source").withColumn("series", F.lit("engine_instance")))
    return reduce(DataFrame.unionByName, parts).select("boat_id", "series", F.col("source").cast("int"), "n", "first_seq")


def add_counts(*counts: DataFrame) -> DataFrame:
    every = reduce(DataFrame.unionByName, counts)
    return every.groupBy("boat_id", "series", "source").agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"))


def source_choice(counts: DataFrame) -> DataFrame:
    """(boat, series, source) for every series of ``counts``: the dominant source, and for position and speed the
    primary GPS. One row per boat and series."""
    of = lambda name: counts.where(F.col("series") == name)
    gps = gps_sources(of("fixes"), of("sog"))
    rows = gps.select("boat_id", F.lit("fixes").alias("series"), F.col("fix_source").alias("source")).unionByName(
        gps.select("boat_id", F.lit("sog").alias("series"), F.col("sog_source").alias("source"))
    )
    w = Window.partitionBy("boat_id", "series").orderBy(F.col("n").desc(), "first_seq")
    rest = counts.where(~F.col("series").isin("fixes", "sog"))
    top = rest.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("boat_id", "series", "source")
    return rows.unionByName(top)


def choose_inputs(tables: dict[str, DataFrame], engine_count: int | None = None, counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """The series a season is built from: primary GPS for position and speed (and the DOPs of that receiver), the
    dominant source of every other per-source series, and all engine series (or only the dominant engine).

    The choice is worked out once over all series and written out (it is tiny); every series is then
    read once more, filtered by a semi-join. ``counts``: what the choice is made by, where the tables are only
    a part of what is known.
    """
    out = dict(tables)
    choice = settle(source_choice(source_counts(tables) if counts is None else counts))
    for name in ("fixes", "sog", *BY_SOURCE, "dops"):
        if name in tables:
            mine = choice.where(F.col("series") == ("fixes" if name == "dops" else name)).select("boat_id", "source")
            out[name] = tables[name].join(mine, ["boat_id", "source"], "left_semi")
    if engine_count == 1 and "engine" in tables:
        one = choice.where("series = 'engine_instance'").select("boat_id", F.col("source").alias("instance"))
        for name in ("engine", "trip_fuel", "rpm"):
            if name in tables:
                out[name] = tables[name].join(one, ["boat_id", "instance"], "left_semi")
    return out
