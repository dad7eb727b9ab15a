"""Trip rows of the logbook: every figure of a trip as one row, and its texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions.clocktime import clock_text, hours_text
from fairlead.functions.text import comma, fixed, joined
from fairlead.operators import periods, stats
from fairlead.operators.stats import TRIP
from fairlead.params import TripParams


def _list(df: DataFrame, name: str, *cols: str) -> DataFrame:
    """Per trip the rows of its few engines or batteries, in order of instance."""
    return df.groupBy(*TRIP).agg(F.array_sort(F.collect_list(F.struct("instance", *cols))).alias(name))


def trip_facts(season) -> DataFrame:
    """One row per trip with scalars and one short array per device table."""
    s, p, t = season, season.params, season.tables
    df = s.trips
    if "engine" in t:
        fuel = stats.fuel_litres(df, t["engine"], p).groupBy(*TRIP).agg(F.sum("fuel_l").alias("fuel_liters"))
        warn = stats.engine_warnings(df, t["engine"], p)
        flags = warn.groupBy(*TRIP, "instance").agg(F.array_sort(F.collect_set("warning")).alias("warnings"))
        health = stats.engine_health(df, t["engine"], p).join(flags, [*TRIP, "instance"], "left")
        hcols = [c for c in health.columns if c not in (*TRIP, "instance")]
        out = df.join(fuel, TRIP, "left")
        out = out.join(_list(health, "engine_health", *hcols), TRIP, "left")
        out = out.join(_list(stats.engine_hours(df, t["engine"], s.instance_intervals, p), "engine_hours", "engine_hours"), TRIP, "left")
        out = out.join(_list(stats.engine_hours_total(df, t["engine"], p), "engine_hours_total", "engine_hours_total"), TRIP, "left")
    else:
        out = df.withColumn("fuel_liters", F.lit(0.0))
    out = out.withColumn("fuel_liters", F.coalesce("fuel_liters", F.lit(0.0)))
    if "trip_fuel" in t:
        out = out.join(stats.device_fuel(df, t["trip_fuel"], p), TRIP, "left")
    if "rpm" in t:
        out = out.join(_list(stats.typical_rpm(df, t["rpm"], p), "typical_rpm", "typical_rpm"), TRIP, "left")
        out = out.join(_list(stats.rpm_at_top_speed(df, t["rpm"], p), "max_speed_rpm", "rpm"), TRIP, "left")
    if "battery" in t:
        out = out.join(_list(stats.battery_health(df, t["battery"], p), "battery_health", "avg_voltage_v", "min_voltage_v", "min_voltage_us"), TRIP, "left")
    if "attitude" in t:
        out = out.join(stats.motion(df, t["attitude"], p), TRIP, "left")
    if "outside_temp" in t:
        out = out.join(stats.series_range(df, t["outside_temp"], "temp_c", p), TRIP, "left")
    if "humidity" in t:
        out = out.join(stats.series_range(df, t["humidity"], "humidity_pct", p), TRIP, "left")
    return out


def _per_device(items: Column, word: str, text) -> Column:
    """Texts of the devices, labelled only if there is more than one; devices without text vanish."""
    several = F.size(items) > 1
    label = lambda x: F.when(several, F.concat(F.lit(f"{word} "), x["instance"].cast("string"), F.lit(": "))).otherwise("")
    return F.array_compact(F.transform(items, lambda x: F.concat(label(x), text(x))))


def health_text(health: Column) -> Column:
    def one(x: Column) -> Column:
        bits = joined(
            F.concat(F.lit("oil "), comma(x["oil_pressure_bar_avg"]), F.lit(" bar")),
            F.concat(F.lit("oil temp "), comma(x["oil_temperature_c_avg"], 0), F.lit("°C")),
            F.concat(F.lit("coolant "), comma(x["coolant_temperature_c_avg"], 0), F.lit("°C")),
            F.concat(F.lit("alternator "), comma(x["alternator_voltage_v_avg"]), F.lit(" V")),
            F.concat(F.lit("load max "), comma(x["engine_load_pct_max"], 0), F.lit("%")),
        )
        return F.when(bits != "", bits)

    return F.coalesce(F.array_join(_per_device(health, "engine", one), "; "), F.lit(""))


def warnings_text(health: Column, batteries: Column, threshold: float) -> Column:
    engine = _per_device(health, "engine", lambda x: F.when(F.size(x["warnings"]) > 0, F.array_join(x["warnings"], ", ")))
    low = _per_device(
        batteries, "battery",
        lambda x: F.when(x["min_voltage_v"] < threshold, F.concat(F.lit("low battery "), comma(x["min_voltage_v"]), F.lit(" V"))),
    )
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.coalesce(engine, none), F.coalesce(low, none)), "; ")


def hours_list_text(items: Column) -> Column:
    return F.coalesce(F.array_join(_per_device(items, "engine", lambda x: F.concat(comma(x["engine_hours"]), F.lit(" h"))), ", "), F.lit(""))


def rpm_list_text(items: Column) -> Column:
    return F.coalesce(F.array_join(_per_device(items, "engine", lambda x: x["typical_rpm"].cast("string")), ", "), F.lit(""))


# The columns of the CSV logbook, in order.
CSV_COLUMNS = [
    "date", "departure_time", "departure_port", "arrival_time", "arrival_port", "duration", "distance_nm", "avg_speed_kn", "max_speed_kn",
    "fuel_L_calculated", "fuel_L_engine_meter", "avg_consumption_L_per_hour", "avg_consumption_L_per_nm", "engine_hours", "typical_rpm",
    "engine_health", "warnings", "min_depth_m", "min_depth_position", "avg_water_temp_c", "min_water_temp_c", "max_water_temp_c",
    "roll_variation_deg", "pitch_variation_deg", "roll_range_deg", "pitch_range_deg",
]


def csv_rows(facts: DataFrame, params: TripParams) -> DataFrame:
    """The 26 text columns of the CSV logbook. ``facts`` needs depart_place and arrive_place."""
    c = F.col
    df = periods.with_local_time(facts, params)
    # Other names for the lists, so that the texts can take their column names.
    df = df.withColumnsRenamed({"engine_health": "_health", "engine_hours": "_hours", "typical_rpm": "_rpm"})

    def num(col: Column, decimals: int = 1) -> Column:
        return F.coalesce(comma(col, decimals), F.lit(""))

    hours = c("duration_us") / 3.6e9
    position = F.concat(fixed(c("shallow.lat"), 4), F.lit(", "), fixed(c("shallow.lon"), 4))
    made = {
        "date": F.date_format("local_date", "yyyy-MM-dd"),
        "departure_time": clock_text(c("depart_local_us")),
        "departure_port": c("depart_place"),
        "arrival_time": clock_text(c("arrive_local_us")),
        "arrival_port": c("arrive_place"),
        "duration": hours_text(c("duration_us")),
        "distance_nm": num(c("distance_nm")),
        "avg_speed_kn": num(c("avg_speed_kn")),
        "max_speed_kn": num(c("max_speed_kn")),
        "fuel_L_calculated": num(c("fuel_liters")),
        "fuel_L_engine_meter": num(c("fuel_liters_device")),
        "avg_consumption_L_per_hour": num(F.when(hours > 0, F.try_divide(c("fuel_liters"), hours))),
        "avg_consumption_L_per_nm": num(F.when(c("distance_nm") > 0, F.try_divide(c("fuel_liters"), c("distance_nm"))), 2),
        "engine_hours": hours_list_text(c("_hours")),
        "typical_rpm": rpm_list_text(c("_rpm")),
        "engine_health": health_text(c("_health")),
        "warnings": warnings_text(c("_health"), c("battery_health"), params.battery_warning_voltage),
        "min_depth_m": num(c("shallow.depth_m")),
        "min_depth_position": F.coalesce(position, F.lit("")),
        "avg_water_temp_c": num(c("avg_water_temp_c")),
        "min_water_temp_c": num(c("min_water_temp_c")),
        "max_water_temp_c": num(c("max_water_temp_c")),
        "roll_variation_deg": num(c("roll_variation_deg")),
        "pitch_variation_deg": num(c("pitch_variation_deg")),
        "roll_range_deg": num(c("roll_range_deg")),
        "pitch_range_deg": num(c("pitch_range_deg")),
    }
    texts = df.select(*TRIP, *[made[n].alias(f"t_{n}") for n in CSV_COLUMNS])
    return texts.select(*TRIP, *[F.col(f"t_{n}").alias(n) for n in CSV_COLUMNS])


def description(facts: DataFrame, params: TripParams) -> Column:
    """The one-line summary of a trip, for its GPX track."""
    c = F.col
    kn = F.when(
        c("avg_speed_kn").isNotNull() & c("max_speed_kn").isNotNull(),
        F.concat(F.lit("Speed: avg "), comma(c("avg_speed_kn")), F.lit(" kn, max "), comma(c("max_speed_kn")), F.lit(" kn")),
    )

    def named(label: str, text: Column) -> Column:
        return F.when(text != "", F.concat(F.lit(label), text))

    def swing(label: str, variation: str, spread: str) -> Column:
        peak = F.coalesce(F.concat(F.lit(", peak "), comma(c(spread)), F.lit("°")), F.lit(""))
        return F.concat(F.lit(label), comma(c(variation)), F.lit("°"), peak)

    wide = F.when(
        c("max_water_temp_c") - c("min_water_temp_c") > 0.5,
        F.concat(F.lit(" ("), comma(c("min_water_temp_c")), F.lit("-"), comma(c("max_water_temp_c")), F.lit(")")),
    ).otherwise("")
    return joined(
        F.concat(F.lit("Duration: "), hours_text(c("duration_us"))),
        F.concat(F.lit("Distance: "), comma(c("distance_nm")), F.lit(" nm")),
        kn,
        F.concat(F.lit("Fuel (calculated): "), comma(c("fuel_liters")), F.lit(" L")),
        F.concat(F.lit("Fuel (engine meter): "), comma(c("fuel_liters_device")), F.lit(" L")),
        named("Engine hours: ", hours_list_text(c("engine_hours"))),
        named("Typical RPM: ", rpm_list_text(c("typical_rpm"))),
        named("Warnings: ", warnings_text(c("engine_health"), c("battery_health"), params.battery_warning_voltage)),
        F.concat(F.lit("Min. depth: "), comma(c("shallow.depth_m")), F.lit(" m")),
        F.concat(F.lit("Water temp: "), comma(c("avg_water_temp_c")), F.lit("°C"), wide),
        swing("Roll variation: ±", "roll_variation_deg", "roll_range_deg"),
        swing("Pitch variation: ±", "pitch_variation_deg", "pitch_range_deg"),
    )
