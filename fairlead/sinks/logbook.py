"""Writing the logbook: CSV, GPX tracks and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions.clocktime import clock_text, to_ntz
from fairlead.functions.text import beaufort, comma, compass, fixed, wind_side
from fairlead.operators import periods, rows
from fairlead.operators.rows import CSV_COLUMNS
from fairlead.operators.stats import TRIP
from fairlead.params import KNOT_IN_MS, TripParams


def write_csv(facts: DataFrame, path: str, params: TripParams) -> None:
    """Semicolons, decimal commas, a header; one folder per boat, in time order."""
    df = rows.csv_rows(facts, params).select("boat_id", "clock_epoch", "trip_no", *CSV_COLUMNS)
    ordered = df.repartition("boat_id").sortWithinPartitions("boat_id", "trip_no")
    ordered.select("boat_id", *CSV_COLUMNS).write.mode("errorifexists").partitionBy("boat_id").option("sep", ";").option("header", "true").csv(path)


def _escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def gpx_lines(facts: DataFrame, marked: DataFrame, params: TripParams) -> DataFrame:
    """The GPX file of every trip as lines with their order (``part``, ``pos``): a head, one line per
    track point and a tail. A long track stays a set of rows and is never one value."""
    c = F.col
    local = periods.with_local_time(facts, params)
    clock = F.concat(F.date_format("local_date", "yyyy-MM-dd"), F.lit(" "), clock_text(c("depart_local_us")))
    name = F.concat(clock, F.lit(" "), c("depart_place"), F.lit(" -> "), c("arrive_place"))
    head = F.concat(
        F.lit("<?xml version='1.0' encoding='utf-8'?>\n<gpx version=\"1.1\" creator=\"fairlead\" xmlns=\"http://www.topografix.com/GPX/1/1\">\n  <trk>\n    <name>"),
        _escaped(name), F.lit("</name>\n    <desc>"), _escaped(rows.description(local, params)), F.lit("</desc>\n    <trkseg>"),
    )
    when = F.date_format(to_ntz(c("time_us")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    point = F.concat(
        F.lit('      <trkpt lat="'), fixed(c("lat"), 7), F.lit('" lon="'), fixed(c("lon"), 7), F.lit('"><time>'), when, F.lit("</time></trkpt>")
    )
    zero = F.lit(0).cast("bigint").alias("pos")
    heads = local.select(*TRIP, F.lit(0).alias("part"), zero, head.alias("line"))
    points = marked.select(*TRIP, F.lit(1).alias("part"), c("pos").cast("bigint").alias("pos"), point.alias("line"))
    tails = local.select(*TRIP, F.lit(2).alias("part"), zero, F.lit("    </trkseg>\n  </trk>\n</gpx>").alias("line"))
    return heads.unionByName(points).unionByName(tails)


def write_gpx(facts: DataFrame, marked: DataFrame, path: str, params: TripParams) -> None:
    """One GPX file per trip, in folders boat_id=/trip_no=. The lines of a trip go to one file in
    order; trips spread over the tasks."""
    lines = gpx_lines(facts, marked, params)
    placed = lines.repartition("boat_id", "trip_no").sortWithinPartitions("boat_id", "trip_no", "part", "pos")
    placed.select("boat_id", "trip_no", "line").write.mode("errorifexists").partitionBy("boat_id", "trip_no").text(path)


def log_table(entries: DataFrame, weather: DataFrame | None, marine: DataFrame | None) -> DataFrame:
    """The periodic log with texts. A boat with its own wind instrument shows that wind instead of
    the model's. ``weather`` and ``marine`` are hourly tables (operators/places.py) or None."""
    from pyspark.sql import Window

    from fairlead.operators.places import join_hourly

    c = F.col
    df = entries
    for table, names in ((weather, ("wind_kn", "wind_deg", "precip_mm", "cloud_pct")), (marine, ("wave_height_m", "wave_direction_deg", "wave_period_s", "current_kn", "current_direction_deg"))):
        if table is not None:
            df = join_hourly(df, table)
            df = df.drop("hour")
        else:
            df = df.withColumns({n: F.lit(None).cast("double") for n in names})
    trip = Window.partitionBy(*TRIP)
    own = c("wind_speed_ms").isNotNull() | c("wind_angle_deg").isNotNull()
    df = df.withColumn("_own", F.max(own.cast("int")).over(trip) == 1).withColumn("_several", F.count(F.lit(1)).over(trip) > 1)
    instrument = F.concat_ws(
        ", ", F.concat(comma(c("wind_speed_ms") / KNOT_IN_MS), F.lit(" kn")), wind_side(c("wind_angle_deg"), F.coalesce("wind_reference", F.lit(-1)))
    )
    model = F.concat(comma(c("wind_kn")), F.lit(" kn "), compass(c("wind_deg")), F.lit(" (Bft "), beaufort(c("wind_kn")).cast("string"), F.lit(")"))
    wave = F.concat(comma(c("wave_height_m")), F.lit(" m, "), comma(c("wave_period_s")), F.lit(" s, "), compass(c("wave_direction_deg")))
    current = F.concat(comma(c("current_kn")), F.lit(" kn "), compass(c("current_direction_deg")))

    def text(value: Column) -> Column:
        return F.coalesce(value, F.lit(""))

    return df.where("_several").select(
        *TRIP, "no", "entry", clock_text(c("local_us")).alias("clock"),
        F.concat(fixed(c("lat"), 4), F.lit(", "), fixed(c("lon"), 4)).alias("position"),
        text(F.concat(comma(c("depth_m")), F.lit(" m"))).alias("depth"),
        text(F.concat(comma(c("cog_deg"), 0), F.lit("°"))).alias("cog"),
        F.concat(comma(c("sog_ms") / KNOT_IN_MS), F.lit(" kn")).alias("sog"),
        text(F.concat(comma(c("stw_ms") / KNOT_IN_MS), F.lit(" kn"))).alias("stw"),
        F.when(c("_own"), instrument).otherwise("").alias("wind_instrument"),
        F.when(c("_own"), "").otherwise(text(model)).alias("wind_model"),
        text(F.concat(comma(c("precip_mm")), F.lit(" mm"))).alias("precip"),
        text(F.concat(comma(c("cloud_pct"), 0), F.lit("%"))).alias("cloud"),
        text(wave).alias("wave"), text(current).alias("current"),
    )


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each logbook table as Parquet by boat."""
    for name, df in tables.items():
        df.write.mode("errorifexists").partitionBy("boat_id").parquet(f"{path}/{name}")
