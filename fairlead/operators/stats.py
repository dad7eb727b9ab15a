"""Per-trip figures.

Everything that comes from the track is combined from the pieces' sums and extremes. Everything that
comes from a sensor series joins the series with the trips on (boat, time slice): an equi-join whose
small side is the trip table, followed by an aggregation that Spark starts on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.operators.align import KEYS
from fairlead.operators.runs import add_hops
from fairlead.operators.scan import scan, slices_between, time_slice
from fairlead.params import (
    KELVIN_TO_CELSIUS,
    KNOT_IN_MS,
    MAX_INTEGRATION_GAP_S,
    PA_TO_BAR,
    RPM_BUCKET,
    RPM_STABLE_S,
    US,
    TripParams,
)

TRIP = ["boat_id", "clock_epoch", "trip_no"]

# The names of the status bits of the engine message (bit number = position).
STATUS_1 = [
    "Check Engine",
    "Over Temperature",
    "Low Oil Pressure",
    "Low Oil Level",
    "Low Fuel Pressure",
    "Low System Voltage",
    "Low Coolant Level",
    "Water Flow",
    "Water In Fuel",
    "Charge Indicator",
    "Preheat Indicator",
    "High Boost Pressure",
    "Rev Limit Exceeded",
    "EGR System",
    "Throttle Position Sensor",
    "Emergency Stop",
]
STATUS_2 = [
    "Warning Level 1",
    "Warning Level 2",
    "Power Reduction",
    "Maintenance Needed",
    "Engine Comm Error",
    "Sub or Secondary Throttle",
    "Neutral Start Protect",
    "Engine Shutting Down",
]


def warning_names(status1: Column, status2: Column) -> Column:
    """Sorted names of the bits that are set; a missing status adds none."""
    flags = [(status1, i, n) for i, n in enumerate(STATUS_1)] + [(status2, i, n) for i, n in enumerate(STATUS_2)]
    named = [F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for s, i, n in flags]
    return F.array_sort(F.array_compact(F.array(*named)))


def track_stats(pieces: DataFrame, params: TripParams) -> DataFrame:
    """Distance, time underway, speed, depth and water temperature of every trip."""
    c = F.col
    df = add_hops(pieces.where("final_label = 'moving'"), "final_no", params)
    g = df.groupBy(*KEYS, "final_no").agg(
        F.sum(c("path_nm") + c("hop_nm")).alias("distance_nm"),
        F.sum(c("moving_us") + c("hop_us")).alias("duration_us"),
        (F.sum("sog_sum") / F.sum("n_all") / KNOT_IN_MS).alias("avg_speed_kn"),
        F.max("top").alias("top"),
        F.min(F.when(c("shallow").isNotNull(), c("shallow"))).alias("shallow"),
        F.max_by("deep", F.when(c("deep").isNotNull(), F.struct(c("deep.depth_m"), -c("deep.time_us")))).alias("deep"),
        (F.try_divide(F.sum("wt_sum"), F.sum("wt_n"))).alias("avg_water_temp_c"),
        F.min("wt_min").alias("min_water_temp_c"),
        F.max("wt_max").alias("max_water_temp_c"),
    )
    return g.withColumns(
        {"max_speed_kn": c("top.sog_ms") / KNOT_IN_MS, "max_speed_us": -c("top.col2")}
    ).drop("top")


def in_trips(trips: DataFrame, samples: DataFrame, params: TripParams, start: str = "depart_us", end: str = "arrive_us", keep: list[str] | None = None) -> DataFrame:
    """Rows of a series inside each trip (both ends included), matched on time slices."""
    keep = keep or []
    spans = trips.select(*TRIP, *keep, F.col(start).alias("_lo"), F.col(end).alias("_hi"))
    spans = spans.withColumn("_slice", F.explode(slices_between("_lo", "_hi", params.chunk_us)))
    timed = samples.withColumn("_slice", time_slice("time_us", params.chunk_us))
    joined = timed.join(spans, [*KEYS, "_slice"])
    return joined.where("time_us BETWEEN _lo AND _hi").drop("_slice", "_lo", "_hi")


def fuel_litres(trips: DataFrame, engine: DataFrame, params: TripParams) -> DataFrame:
    """Trapezoid of the fuel rate per trip and instance; steps of more than an hour count nothing."""
    c = F.col
    known = engine.where("fuel_rate_lph IS NOT NULL").withColumn("slice", time_slice("time_us", params.chunk_us))
    known = known.select(*KEYS, "instance", "slice", "time_us", "seq", "fuel_rate_lph")
    pairs = scan(
        known, [*KEYS, "instance"], "slice", ["time_us", "seq"],
        prev={"p": F.struct("time_us", "fuel_rate_lph")},
    )
    inside = in_trips(trips, pairs, params, keep=["depart_us"])
    dt = c("time_us") - c("p.time_us")
    step = F.when((c("p.time_us") >= c("depart_us")) & (dt > 0) & (dt <= MAX_INTEGRATION_GAP_S * US), dt / (3600.0 * US) * (c("fuel_rate_lph") + c("p.fuel_rate_lph")) / 2)
    return inside.groupBy(*TRIP, "instance").agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("fuel_l"))


def meter_advance(inside: DataFrame, meter: str, scale: float, out: str) -> DataFrame:
    """Last minus first reading per trip and instance, never negative, from at least two readings."""
    at = F.struct("time_us", "seq")
    g = inside.where(F.col(meter).isNotNull()).groupBy(*TRIP, "instance").agg(
        F.count(F.lit(1)).alias("n"), F.max_by(meter, at).alias("_b"), F.min_by(meter, at).alias("_a")
    )
    return g.where("n >= 2").select(*TRIP, "instance", (F.greatest(F.col("_b") - F.col("_a"), F.lit(0)) / scale).alias(out))


def device_fuel(trips: DataFrame, trip_fuel: DataFrame, params: TripParams) -> DataFrame:
    per = meter_advance(in_trips(trips, trip_fuel, params), "trip_fuel_used_l", 1.0, "fuel_l")
    return per.groupBy(*TRIP).agg(F.sum("fuel_l").alias("fuel_liters_device"))


def engine_windows(trips: DataFrame, engine: DataFrame, instance_intervals: DataFrame) -> DataFrame:
    """Per trip and instance the window widened by the time the engine ran on continuously before
    departure and after arrival, at most to the middle of the neighbouring stay."""
    c = F.col
    half_prev = c("prev_stay.start_us") + F.expr("(prev_stay.end_us - prev_stay.start_us) div 2")
    half_next = c("next_stay.start_us") + F.expr("(next_stay.end_us - next_stay.start_us) div 2")
    instances = engine.select("boat_id", "clock_epoch", "instance").distinct()
    base = trips.select(*TRIP, "depart_us", "arrive_us", half_prev.alias("hp"), half_next.alias("hn")).join(instances, KEYS)

    def covering(moment: str) -> DataFrame:
        """The interval of that engine a moment lies in, found by looking back along the boat."""
        marks = base.select(*TRIP, "instance", c(moment).alias("t"), F.lit(1).alias("tag"), F.lit(None).cast("struct<on_start:bigint,on_end:bigint>").alias("iv"))
        starts = instance_intervals.select(
            *KEYS, F.lit(None).cast("int").alias("trip_no"), "instance", c("on_start").alias("t"), F.lit(0).alias("tag"), F.struct("on_start", "on_end").alias("iv")
        )
        w = Window.partitionBy(*KEYS, "instance").orderBy("t", "tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = marks.unionByName(starts).withColumn("iv", F.last("iv", ignorenulls=True).over(w)).where("tag = 1")
        return found.where(c("t") <= c("iv.on_end")).select(*TRIP, "instance", c("iv.on_start").alias(f"{moment}_on"), c("iv.on_end").alias(f"{moment}_off"))

    keys = [*TRIP, "instance"]
    df = base.join(covering("depart_us"), keys, "left").join(covering("arrive_us"), keys, "left")
    lo = F.least(F.coalesce(F.greatest("depart_us_on", "hp"), c("depart_us")), c("depart_us"))
    hi = F.greatest(F.coalesce(F.least("arrive_us_off", "hn"), c("arrive_us")), c("arrive_us"))
    lo = F.when(c("depart_us_on").isNull(), c("depart_us")).otherwise(lo)
    hi = F.when(c("arrive_us_off").isNull(), c("arrive_us")).otherwise(hi)
    return df.select(*keys, lo.alias("lo_us"), hi.alias("hi_us"))


def engine_hours(trips: DataFrame, engine: DataFrame, instance_intervals: DataFrame, params: TripParams) -> DataFrame:
    windows = engine_windows(trips, engine, instance_intervals).withColumnRenamed("instance", "_instance")
    inside = in_trips(windows, engine, params, "lo_us", "hi_us", keep=["_instance"]).where("instance = _instance")
    return meter_advance(inside, "total_hours_s", 3600.0, "engine_hours")


def engine_hours_total(trips: DataFrame, engine: DataFrame, params: TripParams) -> DataFrame:
    inside = in_trips(trips, engine, params).where("total_hours_s IS NOT NULL")
    last = F.max_by("total_hours_s", F.struct("time_us", "seq"))
    return inside.groupBy(*TRIP, "instance").agg((last / 3600.0).alias("engine_hours_total"))


def engine_health(trips: DataFrame, engine: DataFrame, params: TripParams) -> DataFrame:
    return in_trips(trips, engine, params).groupBy(*TRIP, "instance").agg(
        (F.avg("oil_pressure_pa") * PA_TO_BAR).alias("oil_pressure_bar_avg"),
        (F.avg("oil_temperature_k") - KELVIN_TO_CELSIUS).alias("oil_temperature_c_avg"),
        (F.avg("coolant_temperature_k") - KELVIN_TO_CELSIUS).alias("coolant_temperature_c_avg"),
        F.avg("alternator_voltage_v").alias("alternator_voltage_v_avg"),
        F.max("engine_load_pct").alias("engine_load_pct_max"),
    )


def engine_warnings(trips: DataFrame, engine: DataFrame, params: TripParams) -> DataFrame:
    """When each warning was first seen, per trip and instance. Readings without a warning drop out
    before the join."""
    flagged = engine.where("status1 <> 0 OR status2 <> 0").withColumn("warnings", warning_names(F.col("status1"), F.col("status2")))
    single = flagged.select(*KEYS, "time_us", "instance", F.explode("warnings").alias("warning"))
    return in_trips(trips, single, params).groupBy(*TRIP, "instance", "warning").agg(F.min("time_us").alias("first_seen_us"))


def battery_health(trips: DataFrame, battery: DataFrame, params: TripParams) -> DataFrame:
    inside = in_trips(trips, battery.where("voltage_v IS NOT NULL"), params)
    return inside.groupBy(*TRIP, "instance").agg(
        F.avg("voltage_v").alias("avg_voltage_v"),
        F.min("voltage_v").alias("min_voltage_v"),
        F.min_by("time_us", F.struct("voltage_v", "time_us", "seq")).alias("min_voltage_us"),
    )


def low_batteries(health: DataFrame, params: TripParams) -> DataFrame:
    return health.where(F.col("min_voltage_v") < params.battery_warning_voltage)


def series_range(trips: DataFrame, samples: DataFrame, column: str, params: TripParams) -> DataFrame:
    return in_trips(trips, samples, params).groupBy(*TRIP).agg(
        F.avg(column).alias(f"avg_{column}"), F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}")
    )


def motion(trips: DataFrame, attitude: DataFrame, params: TripParams) -> DataFrame:
    """Sample deviation and range of roll and pitch. The largest series: it meets the trips in a hash
    join on slices and leaves as one row per trip."""
    return in_trips(trips, attitude, params).groupBy(*TRIP).agg(
        F.stddev_samp("roll_deg").alias("roll_variation_deg"),
        F.stddev_samp("pitch_deg").alias("pitch_variation_deg"),
        (F.max("roll_deg") - F.min("roll_deg")).alias("roll_range_deg"),
        (F.max("pitch_deg") - F.min("pitch_deg")).alias("pitch_range_deg"),
    )


def rpm_at_top_speed(trips: DataFrame, rpm: DataFrame, params: TripParams) -> DataFrame:
    """The reading nearest in time to the top speed, per trip and instance; the earlier one on a tie."""
    inside = in_trips(trips, rpm.where("rpm IS NOT NULL"), params, keep=["max_speed_us"])
    near = F.struct(F.abs(F.col("time_us") - F.col("max_speed_us")), F.col("time_us"), F.col("seq"))
    return inside.groupBy(*TRIP, "instance").agg(F.min_by("rpm", near).alias("rpm"))


def rpm_bucket(rpm: Column) -> Column:
    return (F.bround(rpm / RPM_BUCKET) * RPM_BUCKET).cast("bigint")


def typical_rpm(trips: DataFrame, rpm: DataFrame, params: TripParams) -> DataFrame:
    """Most frequent engine speed rounded to 50; on a tie the one that occurred first."""
    inside = in_trips(trips, rpm.where("rpm IS NOT NULL"), params)
    counts = inside.groupBy(*TRIP, "instance", rpm_bucket(F.col("rpm")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("time_us", "seq")).alias("first_at")
    )
    w = Window.partitionBy(*TRIP, "instance").orderBy(F.col("n").desc(), "first_at")
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*TRIP, "instance", F.col("bucket").alias("typical_rpm"), "n")


def cruising_rows(trips: DataFrame, rpm: DataFrame, typical: DataFrame, params: TripParams) -> DataFrame:
    """RPM readings inside held stretches: within one bucket of the typical value, without another
    reading in between, for at least two minutes. Numbered by stretch."""
    c = F.col
    inside = in_trips(trips, rpm.where("rpm IS NOT NULL"), params)
    near = F.abs(rpm_bucket(c("rpm")) - c("typical_rpm")) <= RPM_BUCKET
    df = inside.join(typical.select(*TRIP, "instance", "typical_rpm"), [*TRIP, "instance"])
    df = df.withColumn("near", near).withColumn("slice", time_slice("time_us", params.chunk_us))
    df = df.select(*TRIP, "instance", "slice", "time_us", "seq", "near")
    keys = [*TRIP, "instance"]
    df = scan(df, keys, "slice", ["time_us", "seq"], fill={"off_at": F.when(~c("near"), F.struct("time_us", "seq"))})
    # A stretch is the near readings after one and the same off reading.
    held = df.where("near").withColumn("stretch", F.coalesce("off_at", F.struct(F.lit(-1).cast("bigint").alias("time_us"), F.lit(-1).cast("bigint").alias("seq"))))
    long_ones = held.groupBy(*keys, "stretch").agg(F.min("time_us").alias("w_start"), F.max("time_us").alias("w_end"))
    long_ones = long_ones.where(c("w_end") - c("w_start") >= RPM_STABLE_S * US)
    return held.join(long_ones, [*keys, "stretch"])


def nearest_track_speed(readings: DataFrame, track: DataFrame, params: TripParams) -> DataFrame:
    """Adds the speed at the nearest row of the same trip's track, the earlier one on a tie."""
    c = F.col
    point = "struct<time_us:bigint,sog_ms:double>"
    probes = readings.withColumn("tag", F.lit(1)).withColumn("pt", F.lit(None).cast(point))
    points = track.select(
        *TRIP, time_slice("time_us", params.chunk_us).alias("slice"), "time_us", F.lit(0).cast("bigint").alias("seq"),
        F.lit(0).alias("tag"), F.struct("time_us", "sog_ms").cast(point).alias("pt"),
    )
    both = points.unionByName(probes, allowMissingColumns=True)
    # Slices of different trips of a boat touch, so the trip is part of the key. At one instant the
    # track row comes first: it is then both the latest before and at distance zero.
    both = scan(both, TRIP, "slice", ["time_us", "tag", "seq", "instance"], fill={"back": c("pt")}, bfill={"ahead": c("pt")})
    gap_back = c("time_us") - c("back.time_us")
    gap_ahead = c("ahead.time_us") - c("time_us")
    use_back = F.coalesce(gap_back <= gap_ahead, c("ahead").isNull())
    return both.where("tag = 1").withColumn("sog_ms", F.when(use_back, c("back.sog_ms")).otherwise(c("ahead.sog_ms"))).drop("pt", "back", "ahead", "tag")


def speed_at_typical_rpm(trips: DataFrame, rpm: DataFrame, engine: DataFrame, track: DataFrame, params: TripParams) -> DataFrame:
    c = F.col
    keys = [*TRIP, "instance"]
    held = cruising_rows(trips, rpm, typical_rpm(trips, rpm, params), params)
    kn = c("sog_ms") / KNOT_IN_MS
    speeds = nearest_track_speed(held.select(*keys, "slice", "time_us", "seq"), track, params).groupBy(*keys).agg(
        F.min(kn).alias("min_kn"), F.max(kn).alias("max_kn"), F.avg(kn).alias("avg_kn")
    )
    windows = held.groupBy(*keys, "stretch").agg(F.min("w_start").alias("w_start"), F.max("w_end").alias("w_end"))
    windows = windows.withColumnRenamed("instance", "_instance")
    rates = in_trips(windows, engine.where("fuel_rate_lph IS NOT NULL"), params, "w_start", "w_end", keep=["_instance"])
    rates = rates.where("instance = _instance").groupBy(*keys).agg(F.avg("fuel_rate_lph").alias("rate"))
    out = speeds.join(rates, keys, "left")
    per_nm = F.when(c("avg_kn") > 0, F.try_divide(c("rate"), c("avg_kn")))
    return out.select(*keys, "min_kn", "max_kn", "avg_kn", per_nm.alias("fuel_l_per_nm"))
