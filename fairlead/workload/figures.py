"""Queries: per-trip figures, totals, tracks and logs."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from fairlead.operators import logbook, periods, runs, stats
from fairlead.operators.stats import TRIP
from fairlead.workload.oracle import KN, add_step, hav
from fairlead.workload.registry import PARAMS, query, season

T = "boat_id:i | trip_no:i"


def _trip_query(name: str, columns: str, rest: str):
    return query(name, f"{T} | {columns}", rest)


@_trip_query("ag1_distance", "distance_nm:f", "FROM trips")
def ag1(spark, sf):
    return season(spark, sf).trips


@_trip_query("ag2_moving_duration", "duration_us:i", "FROM trips")
def ag2(spark, sf):
    return season(spark, sf).trips


@_trip_query("ag3_speed", "avg_speed_kn:f | max_speed_kn:f | max_speed_us:i", "FROM trips")
def ag3(spark, sf):
    return season(spark, sf).trips


add_step(
    "fuel_pairs",
    """SELECT boat_id, trip_no, instance, time_us, fuel_rate_lph, lag(time_us) OVER w AS pt, lag(fuel_rate_lph) OVER w AS pf
    FROM t_engine WHERE fuel_rate_lph IS NOT NULL WINDOW w AS (PARTITION BY boat_id, trip_no, instance ORDER BY time_us, seq)""",
)
add_step(
    "fuel",
    """SELECT boat_id, trip_no, instance, coalesce(sum(CASE WHEN time_us > pt AND time_us - pt <= 3600000000 THEN (time_us - pt) / 36e8 * (fuel_rate_lph + pf) / 2 END), 0e0) AS fuel_l
    FROM fuel_pairs GROUP BY ALL""",
)


@_trip_query("ag4_fuel_litres", "instance:i | fuel_l:f", "FROM fuel WHERE true")
def ag4(spark, sf):
    s = season(spark, sf)
    return stats.fuel_litres(s.trips, s.tables["engine"], PARAMS)


add_step(
    "device_fuel",
    """SELECT boat_id, trip_no, sum(greatest(b - a, 0)) AS fuel_liters_device FROM (
    SELECT boat_id, trip_no, instance, first(trip_fuel_used_l ORDER BY time_us, seq) AS a, last(trip_fuel_used_l ORDER BY time_us, seq) AS b, count(*) AS n
    FROM t_trip_fuel WHERE trip_fuel_used_l IS NOT NULL GROUP BY ALL) WHERE n >= 2 GROUP BY ALL""",
)


@_trip_query("ag5_device_fuel", "fuel_liters_device:f", "FROM device_fuel")
def ag5(spark, sf):
    s = season(spark, sf)
    return stats.device_fuel(s.trips, s.tables["trip_fuel"], PARAMS)


add_step(
    "engine_windows",
    """SELECT t.boat_id, t.trip_no, i.instance,
      CASE WHEN a.on_start IS NULL THEN t.depart_us ELSE least(t.depart_us, greatest(a.on_start, coalesce(t.prev_start + (t.prev_end - t.prev_start) // 2, a.on_start))) END AS lo_us,
      CASE WHEN b.on_end IS NULL THEN t.arrive_us ELSE greatest(t.arrive_us, least(b.on_end, coalesce(t.next_start + (t.next_end - t.next_start) // 2, b.on_end))) END AS hi_us
    FROM trips t JOIN (SELECT DISTINCT boat_id, instance FROM c_engine) i USING (boat_id)
    LEFT JOIN ivi a ON a.boat_id = t.boat_id AND a.instance = i.instance AND t.depart_us BETWEEN a.on_start AND a.on_end
    LEFT JOIN ivi b ON b.boat_id = t.boat_id AND b.instance = i.instance AND t.arrive_us BETWEEN b.on_start AND b.on_end""",
)
add_step(
    "engine_hours",
    """SELECT boat_id, trip_no, instance, greatest(b - a, 0) / 36e2 AS engine_hours FROM (
    SELECT w.boat_id, w.trip_no, w.instance, first(total_hours_s ORDER BY time_us, seq) AS a, last(total_hours_s ORDER BY time_us, seq) AS b, count(*) AS n
    FROM engine_windows w JOIN c_engine e ON e.boat_id = w.boat_id AND e.instance = w.instance AND e.time_us BETWEEN w.lo_us AND w.hi_us WHERE total_hours_s IS NOT NULL GROUP BY ALL) WHERE n >= 2""",
)


@_trip_query("ag6_engine_hours", "instance:i | engine_hours:f", "FROM engine_hours WHERE true")
def ag6(spark, sf):
    s = season(spark, sf)
    return stats.engine_hours(s.trips, s.tables["engine"], s.instance_intervals, PARAMS)


add_step(
    "engine_totals",
    "SELECT boat_id, trip_no, instance, last(total_hours_s ORDER BY time_us, seq) / 36e2 AS engine_hours_total FROM t_engine WHERE total_hours_s IS NOT NULL GROUP BY ALL",
)


@_trip_query("ag7_engine_hours_total", "instance:i | engine_hours_total:f", "FROM engine_totals")
def ag7(spark, sf):
    s = season(spark, sf)
    return stats.engine_hours_total(s.trips, s.tables["engine"], PARAMS)


add_step(
    "health",
    """SELECT boat_id, trip_no, instance, avg(oil_pressure_pa) * 1e-5 AS oil_pressure_bar_avg, avg(oil_temperature_k) - 27315e-2 AS oil_temperature_c_avg,
    avg(coolant_temperature_k) - 27315e-2 AS coolant_temperature_c_avg, avg(alternator_voltage_v) AS alternator_voltage_v_avg, max(engine_load_pct) AS engine_load_pct_max FROM t_engine GROUP BY ALL""",
)
# The flags of either status word, lowest bit first, written down here once more for the check.
_FLAG_NAMES = {
    "status1": "Check Engine; Over Temperature; Low Oil Pressure; Low Oil Level; Low Fuel Pressure; Low System Voltage; Low Coolant Level; Water Flow; Water In Fuel; "
    "Charge Indicator; Preheat Indicator; High Boost Pressure; Rev Limit Exceeded; EGR System; Throttle Position Sensor; Emergency Stop",
    "status2": "Warning Level 1; Warning Level 2; Power Reduction; Maintenance Needed; Engine Comm Error; Sub or Secondary Throttle; Neutral Start Protect; Engine Shutting Down",
}
_flags = " UNION ALL ".join(
    f"SELECT boat_id, trip_no, instance, time_us, '{n}' AS warning FROM t_engine WHERE (({s} // {1 << i}) % 2) = 1"
    for s, names in _FLAG_NAMES.items()
    for i, n in enumerate(names.split("; "))
)
add_step("warn", f"SELECT boat_id, trip_no, instance, warning, min(time_us) AS first_seen_us FROM ({_flags}) GROUP BY ALL")


@_trip_query(
    "ag8_engine_health",
    "instance:i | oil_pressure_bar_avg:g | oil_temperature_c_avg:g | coolant_temperature_c_avg:g | alternator_voltage_v_avg:g | engine_load_pct_max:f",
    "FROM health",
)
def ag8(spark, sf):
    s = season(spark, sf)
    return stats.engine_health(s.trips, s.tables["engine"], PARAMS)


@_trip_query("ag8_engine_warnings", "instance:i | warning:s | first_seen_us:i", "FROM warn")
def ag8w(spark, sf):
    s = season(spark, sf)
    return stats.engine_warnings(s.trips, s.tables["engine"], PARAMS)


@_trip_query("set3_warnings_union", "instance:i | warnings:s", "FROM (SELECT boat_id, trip_no, instance, string_agg(warning, ', ' ORDER BY warning) AS warnings FROM warn GROUP BY ALL)")
def set3(spark, sf):
    s = season(spark, sf)
    warn = stats.engine_warnings(s.trips, s.tables["engine"], PARAMS)
    return warn.groupBy(*TRIP, "instance").agg(F.array_join(F.array_sort(F.collect_set("warning")), ", ").alias("warnings"))


add_step(
    "bat",
    """SELECT boat_id, trip_no, instance, avg(voltage_v) AS avg_voltage_v, min(voltage_v) AS min_voltage_v, first(time_us ORDER BY voltage_v, time_us, seq) AS min_voltage_us
    FROM t_battery WHERE voltage_v IS NOT NULL GROUP BY ALL""",
)


@_trip_query("ag10_battery_health", "instance:i | avg_voltage_v:g | min_voltage_v:f | min_voltage_us:i", "FROM bat")
def ag10(spark, sf):
    s = season(spark, sf)
    return stats.battery_health(s.trips, s.tables["battery"], PARAMS)


add_step("rpm_known", "SELECT *, CAST(round_even(rpm / 50, 0) AS BIGINT) * 50 AS bucket FROM t_rpm WHERE rpm IS NOT NULL")
add_step(
    "typical",
    """SELECT boat_id, trip_no, instance, bucket AS typical_rpm, n FROM (SELECT boat_id, trip_no, instance, bucket, count(*) AS n, min(struct_pack(t := time_us, s := seq)) AS fs FROM rpm_known GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY boat_id, trip_no, instance ORDER BY n DESC, fs) = 1""",
)


@_trip_query("ag11_typical_rpm", "instance:i | typical_rpm:i | n:i", "FROM typical")
def ag11(spark, sf):
    s = season(spark, sf)
    return stats.typical_rpm(s.trips, s.tables["rpm"], PARAMS)


add_step(
    "held0",
    """SELECT k.*, abs(k.bucket - t.typical_rpm) <= 50 AS near, sum(CASE WHEN abs(k.bucket - t.typical_rpm) <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY k.boat_id, k.trip_no, k.instance ORDER BY k.time_us, k.seq) AS g
    FROM rpm_known k JOIN typical t USING (boat_id, trip_no, instance)""",
)
add_step(
    "held",
    """SELECT * FROM (SELECT *, min(time_us) OVER w AS w_start, max(time_us) OVER w AS w_end FROM held0 WHERE near WINDOW w AS (PARTITION BY boat_id, trip_no, instance, g)) WHERE w_end - w_start >= 120000000""",
)
add_step(
    "held_speed",
    """SELECT h.boat_id, h.trip_no, h.instance, h.time_us, h.seq,
    (SELECT r.sog_ms FROM track r WHERE r.boat_id = h.boat_id AND r.trip_no = h.trip_no ORDER BY abs(r.time_us - h.time_us), r.time_us LIMIT 1) AS sog_ms FROM held h""",
)


@_trip_query("jn4_nearest_track_point", "instance:i | seq:i | time_us:i | sog_ms:f", "FROM held_speed")
def jn4(spark, sf):
    s = season(spark, sf)
    held = stats.cruising_rows(s.trips, s.tables["rpm"], stats.typical_rpm(s.trips, s.tables["rpm"], PARAMS), PARAMS)
    return stats.nearest_track_speed(held.select(*TRIP, "instance", "slice", "time_us", "seq"), s.track, PARAMS)


@_trip_query(
    "ag12_speed_at_typical_rpm",
    "instance:i | min_kn:f | max_kn:f | avg_kn:f | fuel_l_per_nm:f",
    f"""FROM (SELECT s.*, CASE WHEN avg_kn > 0 THEN rate / avg_kn END AS fuel_l_per_nm FROM (
      SELECT boat_id, trip_no, instance, min(sog_ms / {KN}) AS min_kn, max(sog_ms / {KN}) AS max_kn, avg(sog_ms / {KN}) AS avg_kn FROM held_speed GROUP BY ALL) s
      LEFT JOIN (SELECT w.boat_id, w.trip_no, w.instance, avg(fuel_rate_lph) AS rate FROM (SELECT DISTINCT boat_id, trip_no, instance, w_start, w_end FROM held) w
        JOIN t_engine e ON e.boat_id = w.boat_id AND e.trip_no = w.trip_no AND e.instance = w.instance AND e.time_us BETWEEN w.w_start AND w.w_end WHERE fuel_rate_lph IS NOT NULL GROUP BY ALL) f USING (boat_id, trip_no, instance))""",
)
def ag12(spark, sf):
    s = season(spark, sf)
    return stats.speed_at_typical_rpm(s.trips, s.tables["rpm"], s.tables["engine"], s.track, PARAMS)


add_step("depths", "SELECT * FROM track WHERE depth_m IS NOT NULL")


@_trip_query(
    "ag13_depth_extremes",
    "min_depth_m:f | min_us:i | min_lat:p | min_lon:p | max_depth_m:f | max_us:i",
    """FROM (SELECT boat_id, trip_no, first(depth_m ORDER BY depth_m, n) AS min_depth_m, first(time_us ORDER BY depth_m, n) AS min_us, first(lat ORDER BY depth_m, n) AS min_lat, first(lon ORDER BY depth_m, n) AS min_lon,
      first(depth_m ORDER BY depth_m DESC, n) AS max_depth_m, first(time_us ORDER BY depth_m DESC, n) AS max_us FROM depths GROUP BY ALL)""",
)
def ag13(spark, sf):
    c = F.col
    return season(spark, sf).trips.select(
        *TRIP, c("shallow.depth_m").alias("min_depth_m"), c("shallow.time_us").alias("min_us"), c("shallow.lat").alias("min_lat"),
        c("shallow.lon").alias("min_lon"), c("deep.depth_m").alias("max_depth_m"), c("deep.time_us").alias("max_us"),
    )


@_trip_query(
    "ag14_water_temperature",
    "avg_water_temp_c:g | min_water_temp_c:f | max_water_temp_c:f",
    "FROM (SELECT boat_id, trip_no, avg(water_temp_c) AS avg_water_temp_c, min(water_temp_c) AS min_water_temp_c, max(water_temp_c) AS max_water_temp_c FROM track GROUP BY ALL)",
)
def ag14(spark, sf):
    return season(spark, sf).trips


def _range(name: str, column: str) -> str:
    return f"SELECT boat_id, trip_no, avg({column}) AS avg_{column}, min({column}) AS min_{column}, max({column}) AS max_{column} FROM {name} GROUP BY ALL"


add_step("climate_t", _range("t_outside_temp", "temp_c"))
add_step("climate_h", _range("t_humidity", "humidity_pct"))


@_trip_query(
    "ag15_outside_climate",
    "avg_temp_c:g | min_temp_c:f | max_temp_c:f | avg_humidity_pct:g | min_humidity_pct:f | max_humidity_pct:f",
    "FROM climate_t FULL JOIN climate_h USING (boat_id, trip_no)",
)
def ag15(spark, sf):
    s = season(spark, sf)
    t = stats.series_range(s.trips, s.tables["outside_temp"], "temp_c", PARAMS)
    h = stats.series_range(s.trips, s.tables["humidity"], "humidity_pct", PARAMS)
    return t.join(h, TRIP, "full")


@_trip_query(
    "ag16_motion",
    "roll_variation_deg:f | pitch_variation_deg:f | roll_range_deg:f | pitch_range_deg:f",
    """FROM (SELECT boat_id, trip_no, CASE WHEN count(roll_deg) > 1 THEN stddev_samp(roll_deg) END AS roll_variation_deg, CASE WHEN count(pitch_deg) > 1 THEN stddev_samp(pitch_deg) END AS pitch_variation_deg,
      max(roll_deg) - min(roll_deg) AS roll_range_deg, max(pitch_deg) - min(pitch_deg) AS pitch_range_deg FROM t_attitude GROUP BY ALL)""",
)
def ag16(spark, sf):
    s = season(spark, sf)
    return stats.motion(s.trips, s.tables["attitude"], PARAMS)


add_step(
    "top_rpm",
    "SELECT boat_id, trip_no, instance, first(rpm ORDER BY abs(time_us - max_speed_us), time_us, seq) AS rpm FROM t_rpm WHERE rpm IS NOT NULL GROUP BY ALL",
)


@_trip_query("jn3_rpm_at_top_speed", "instance:i | rpm:f", "FROM top_rpm")
def jn3(spark, sf):
    s = season(spark, sf)
    return stats.rpm_at_top_speed(s.trips, s.tables["rpm"], PARAMS)


@_trip_query("ag17_top_speed_engine", "max_speed_us:i | max_speed_kn:f | instance:i | rpm:f", "FROM trips LEFT JOIN top_rpm USING (boat_id, trip_no)")
def ag17(spark, sf):
    s = season(spark, sf)
    return s.trips.join(stats.rpm_at_top_speed(s.trips, s.tables["rpm"], PARAMS), TRIP, "left")


@_trip_query("jn2_engine_in_trip", "instance:i | seq:i | time_us:i | fuel_rate_lph:f", "FROM t_engine")
def jn2(spark, sf):
    s = season(spark, sf)
    return stats.in_trips(s.trips, s.tables["engine"], PARAMS)


@query(
    "jn5_fix_with_engine_on",
    "boat_id:i | seq:i | time_us:i | engine_on:b",
    "FROM nv",
)
def jn5(spark, sf):
    return season(spark, sf).rows


def trip_fuel_table(s):
    """Trips with calculated and metered fuel."""
    total = stats.fuel_litres(s.trips, s.tables["engine"], PARAMS).groupBy(*TRIP).agg(F.sum("fuel_l").alias("fuel_liters"))
    device = stats.device_fuel(s.trips, s.tables["trip_fuel"], PARAMS)
    df = s.trips.join(total, TRIP, "left").join(device, TRIP, "left")
    return df.withColumn("fuel_liters", F.coalesce("fuel_liters", F.lit(0.0)))


add_step(
    "trips_fuel",
    """SELECT t.*, coalesce(f.l, 0e0) AS fuel_liters, d.fuel_liters_device FROM trips t LEFT JOIN (SELECT boat_id, trip_no, sum(fuel_l) AS l FROM fuel GROUP BY ALL) f USING (boat_id, trip_no)
    LEFT JOIN device_fuel d USING (boat_id, trip_no)""",
)


def consumption(df):
    c = F.col
    hours = c("duration_us") / 3.6e9
    return df.withColumns(
        {
            "l_per_hour": F.when(c("duration_us") > 0, F.try_divide(c("fuel_liters"), hours)),
            "l_per_nm": F.when(c("distance_nm") > 0, F.try_divide(c("fuel_liters"), c("distance_nm"))),
        }
    )


@_trip_query(
    "ag18_consumption",
    "fuel_liters:f | l_per_hour:f | l_per_nm:f",
    "FROM (SELECT *, CASE WHEN duration_us > 0 THEN fuel_liters / (duration_us / 36e8) END AS l_per_hour, CASE WHEN distance_nm > 0 THEN fuel_liters / distance_nm END AS l_per_nm FROM trips_fuel)",
)
def ag18(spark, sf):
    return consumption(trip_fuel_table(season(spark, sf)))


@_trip_query("ag19_low_battery", "instance:i | min_voltage_v:f | min_voltage_us:i", "FROM bat WHERE min_voltage_v < 122e-1")
def ag19(spark, sf):
    s = season(spark, sf)
    return stats.low_batteries(stats.battery_health(s.trips, s.tables["battery"], PARAMS), PARAMS)


add_step(
    "alerts",
    """SELECT boat_id, trip_no, at_us, what FROM (SELECT boat_id, trip_no, first_seen_us AS at_us, 'engine ' || instance || ': ' || warning AS what FROM warn
    UNION ALL SELECT boat_id, trip_no, min_voltage_us, 'battery ' || instance || ': low battery' FROM bat WHERE min_voltage_v < 122e-1)""",
)


@_trip_query("ag20_warning_timeline", "n:i | timeline:s", "FROM (SELECT boat_id, trip_no, count(*) AS n, string_agg(what, ', ' ORDER BY at_us, what) AS timeline FROM alerts GROUP BY ALL)")
def ag20(spark, sf):
    s = season(spark, sf)
    warn = stats.engine_warnings(s.trips, s.tables["engine"], PARAMS)
    low = stats.low_batteries(stats.battery_health(s.trips, s.tables["battery"], PARAMS), PARAMS)
    return logbook.warning_timeline(warn, low)


# Periods ------------------------------------------------------------------------------------------

add_step(
    "local_trips",
    """SELECT *, CAST(make_timestamp(depart_local_us) AS DATE) AS local_date, year(make_timestamp(depart_local_us)) AS y, isoyear(make_timestamp(depart_local_us)) AS iso_year, weekofyear(make_timestamp(depart_local_us)) AS iso_week FROM (
    SELECT *, depart_us + CAST(offset_h * 3600000000 AS BIGINT) AS depart_local_us, arrive_us + CAST(offset_h * 3600000000 AS BIGINT) AS arrive_local_us FROM (
    SELECT *, CASE WHEN (depart_lat BETWEEN 495e-1 AND 61e0 AND depart_lon BETWEEN -11e0 AND 2e0) OR (depart_lat BETWEEN 368e-1 AND 422e-1 AND depart_lon BETWEEN -96e-1 AND -6e0) THEN 0
      WHEN depart_lat BETWEEN 36e0 AND 71e0 AND depart_lon BETWEEN -95e-1 AND 155e-1 THEN 1 ELSE greatest(-12, least(14, CAST(round_even(depart_lon / 15, 0) AS BIGINT))) END
      + CASE WHEN strftime(make_timestamp(depart_us), '%m-%d') BETWEEN '04-01' AND '10-24' THEN 1 ELSE 0 END AS offset_h FROM trips_fuel))""",
)


def local_trips(s):
    return periods.with_local_time(trip_fuel_table(s), PARAMS)


_TOTALS = f"""count(*) AS trip_count, sum(distance_nm) AS distance_nm, sum(fuel_liters) AS fuel_liters, sum(fuel_liters_device) AS fuel_liters_device,
    sum(CAST(round_even(duration_us / 6e7, 0) AS BIGINT)) / 6e1 AS moving_hours, max(max_speed_kn) AS max_speed_kn"""
add_step("totals", f"SELECT boat_id, y AS year, {_TOTALS} FROM local_trips GROUP BY GROUPING SETS ((boat_id), (boat_id, y))")
_TOT = "boat_id:i | year:i | trip_count:i | distance_nm:f | fuel_liters:f | fuel_liters_device:f | moving_hours:f | max_speed_kn:f"


@query("per1_totals", _TOT, "FROM totals WHERE year IS NULL")
def per1(spark, sf):
    return periods.totals(local_trips(season(spark, sf))).where("year IS NULL")


add_step(
    "trip_engines",
    "SELECT t.boat_id, t.trip_no, t.y, t.depart_us, instance, engine_hours, engine_hours_total FROM local_trips t JOIN (SELECT * FROM engine_hours FULL JOIN engine_totals USING (boat_id, trip_no, instance)) USING (boat_id, trip_no)",
)


@query(
    "per1_engine_totals",
    "boat_id:i | year:i | instance:i | engine_hours:f | engine_hours_current:f",
    """FROM (SELECT boat_id, y AS year, instance, sum(engine_hours) AS engine_hours, arg_max(engine_hours_total, depart_us) FILTER (engine_hours_total IS NOT NULL) AS engine_hours_current
      FROM trip_engines GROUP BY GROUPING SETS ((boat_id, instance), (boat_id, y, instance)))""",
)
def per1_engine(spark, sf):
    s = season(spark, sf)
    keys = [*TRIP, "instance"]
    hours = stats.engine_hours(s.trips, s.tables["engine"], s.instance_intervals, PARAMS)
    total = stats.engine_hours_total(s.trips, s.tables["engine"], PARAMS)
    local = periods.with_local_time(s.trips, PARAMS).select(*TRIP, "year", "depart_us")
    return periods.engine_totals(hours.join(total, keys, "full").join(local, TRIP))


@query(
    "per2_derived_totals",
    "boat_id:i | year:i | avg_l_per_nm:f | avg_l_per_hour:f | avg_speed_kn:f",
    "FROM (SELECT boat_id, year, fuel_liters / distance_nm AS avg_l_per_nm, fuel_liters / moving_hours AS avg_l_per_hour, distance_nm / moving_hours AS avg_speed_kn FROM totals)",
)
def per2(spark, sf):
    return periods.totals(local_trips(season(spark, sf)))


@query("per3_overall_and_year", _TOT, "FROM totals WHERE true")
def per3(spark, sf):
    return periods.totals(local_trips(season(spark, sf)))


@query("per4_calendar_keys", f"{T} | year:i=y | iso_year:i | iso_week:i | offset_h:f", "FROM local_trips")
def per4(spark, sf):
    return periods.with_local_time(season(spark, sf).trips, PARAMS)


@query("per5_sequence_in_year", f"{T} | year:i=y | seq_in_year:i=row_number() OVER (PARTITION BY boat_id, y ORDER BY depart_us, trip_no)", "FROM local_trips")
def per5(spark, sf):
    return periods.with_sequence(periods.with_local_time(season(spark, sf).trips, PARAMS))


@query(
    "per6_season_overview",
    "boat_id:i | year:i | n:i | trips:s",
    "FROM (SELECT boat_id, y AS year, count(*) AS n, string_agg(trip_no, ',' ORDER BY depart_us, trip_no) AS trips FROM local_trips GROUP BY ALL)",
)
def per6(spark, sf):
    df = periods.with_sequence(periods.with_local_time(season(spark, sf).trips, PARAMS)).where("n_rows > 0")
    ordered = F.array_sort(F.collect_list(F.struct("seq_in_year", "trip_no")))
    return df.groupBy("boat_id", "year").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(ordered, lambda x: x["trip_no"].cast("string")), ",").alias("trips"))


@query("sc3_local_time", f"{T} | depart_local_us:i | arrive_local_us:i | local_date:s=strftime(local_date, '%Y-%m-%d')", "FROM local_trips")
def sc3(spark, sf):
    df = periods.with_local_time(season(spark, sf).trips, PARAMS)
    return df.withColumn("local_date", F.date_format("local_date", "yyyy-MM-dd"))


def _f3(x: str) -> str:
    return f"printf('%.3f', {x})"


add_step(
    "uid_keys",
    f"""SELECT *, base || '|' || (row_number() OVER (PARTITION BY boat_id, base ORDER BY depart_us, trip_no) - 1) AS trip_key FROM (
    SELECT *, strftime(local_date, '%Y-%m-%d') || '|' || {_f3('depart_lat')} || ',' || {_f3('depart_lon')} || '|' || {_f3('arrive_lat')} || ',' || {_f3('arrive_lon')} AS base FROM local_trips)""",
)
add_step(
    "uids",
    """SELECT *, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || CASE WHEN h[17] IN ('0','4','8','c') THEN '8' WHEN h[17] IN ('1','5','9','d') THEN '9' WHEN h[17] IN ('2','6','a','e') THEN 'a' ELSE 'b' END || h[18:20] || '-' || h[21:32] AS trip_uid
    FROM (SELECT *, sha1(from_hex('c6f6f5c02b8a4b7a9b2a6f5c0c6f6f5c') || encode(trip_key)) AS h FROM uid_keys)""",
)


@query("id1_trip_uid", f"{T} | trip_key:s | trip_uid:s", "FROM uids")
def id1(spark, sf):
    return periods.with_trip_uid(periods.with_local_time(season(spark, sf).trips, PARAMS))


# Tracks and logs ----------------------------------------------------------------------------------


@query("tk1_latest_position", "boat_id:i | time_us:i | lat:p | lon:p", "FROM (SELECT boat_id, max(time_us) AS time_us, arg_max(lat, time_us) AS lat, arg_max(lon, time_us) AS lon FROM fix1 GROUP BY boat_id)")
def tk1(spark, sf):
    fixes = season(spark, sf).tables["fixes"]
    last = F.max_by(F.struct("time_us", "lat", "lon"), F.struct("clock_epoch", "time_us", "seq"))
    return fixes.groupBy("boat_id").agg(last.alias("m")).select("boat_id", "m.*")


@query("tk2_order_trips", f"{T} | newest_first:i=row_number() OVER (PARTITION BY boat_id, y, iso_year, iso_week ORDER BY depart_us DESC, trip_no DESC)", "FROM local_trips")
def tk2(spark, sf):
    from pyspark.sql import Window

    df = periods.with_local_time(season(spark, sf).trips, PARAMS)
    w = Window.partitionBy("boat_id", "year", "iso_year", "iso_week").orderBy(F.col("depart_us").desc(), F.col("trip_no").desc())
    return df.withColumn("newest_first", F.row_number().over(w)).orderBy("boat_id", F.col("depart_us").desc())


def marked(s):
    return s.marked


add_step("thin", "SELECT * FROM marked WHERE (pos - 1) % greatest(1, points // 500) = 0 OR pos = points")


@query("tk3_decimate_track", f"{T} | pos:i | time_us:i | lat:p | lon:p", "FROM thin")
def tk3(spark, sf):
    return logbook.decimate(marked(season(spark, sf)))


def _r(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS BIGINT)"


@query(
    "tk5_probe_rows",
    f"{T} | pos:i | s:i | sog_01kn:i | depth_01m:i | cog:i | wind_01kn:i | wind_angle:i | wind_reference:i",
    f"""FROM (SELECT boat_id, trip_no, pos, (time_us - min(time_us) OVER (PARTITION BY boat_id, trip_no)) // 1000000 AS s, {_r(f'sog_ms / {KN} * 10')} AS sog_01kn, {_r('depth_m * 10')} AS depth_01m,
      {_r('cog_deg')} % 360 AS cog, {_r(f'wind_speed_ms / {KN} * 10')} AS wind_01kn, {_r('wind_angle_deg')} % 360 AS wind_angle, CASE WHEN wind_speed_ms IS NOT NULL OR wind_angle_deg IS NOT NULL THEN wind_reference END AS wind_reference FROM thin)""",
)
def tk5(spark, sf):
    return logbook.probe_rows(logbook.decimate(marked(season(spark, sf))))


add_step(
    "log_ticks",
    """SELECT m.*, t.offset_h, m.time_us + CAST(t.offset_h * 3600000000 AS BIGINT) AS local_us FROM marked m JOIN local_trips t USING (boat_id, trip_no)""",
)
add_step(
    "log_rows",
    """SELECT *, row_number() OVER (PARTITION BY boat_id, trip_no ORDER BY pos) - 1 AS no, count(*) OVER (PARTITION BY boat_id, trip_no) - 1 AS last_no FROM (
    SELECT *, max(local_us // 1800000000) OVER (PARTITION BY boat_id, trip_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM log_ticks)
    WHERE seen IS NULL OR local_us // 1800000000 > seen OR pos = points""",
)
_LOGCOLS = f"{T} | no:i | entry:s=CASE WHEN no = 0 THEN 'departure' WHEN no = last_no THEN 'arrival' ELSE CAST(no AS VARCHAR) END | time_us:i | lat:p | lon:p"


@query("tk4_periodic_log", _LOGCOLS, "FROM log_rows")
def tk4(spark, sf):
    s = season(spark, sf)
    return logbook.periodic_log(marked(s), periods.with_local_time(s.trips, PARAMS), PARAMS)


add_step(
    "marker_rows",
    f"""SELECT m.boat_id, m.trip_no, 'top_speed' AS marker, first(m.lat ORDER BY pos) AS lat, first(m.lon ORDER BY pos) AS lon, first(m.time_us ORDER BY pos) AS time_us, any_value(t.max_speed_kn) AS value
      FROM marked m JOIN trips t USING (boat_id, trip_no) WHERE m.time_us = t.max_speed_us GROUP BY ALL
    UNION ALL SELECT boat_id, trip_no, marker, lat, lon, time_us, value FROM (SELECT d.boat_id, d.trip_no, x.marker, m.lat, m.lon, m.time_us, m.depth_m AS value FROM
      (SELECT boat_id, trip_no, first(pos ORDER BY depth_m, pos) AS lo, first(pos ORDER BY depth_m DESC, pos) AS hi FROM marked WHERE depth_m IS NOT NULL GROUP BY ALL) d,
      (VALUES ('shallowest'), ('deepest')) x(marker), marked m WHERE m.boat_id = d.boat_id AND m.trip_no = d.trip_no AND m.pos = CASE WHEN x.marker = 'shallowest' THEN d.lo ELSE d.hi END AND (x.marker = 'shallowest' OR d.lo <> d.hi))""",
)


@query("tk7_markers", f"{T} | marker:s | lat:p | lon:p | time_us:i | value:f", "FROM marker_rows")
def tk7(spark, sf):
    s = season(spark, sf)
    return logbook.markers(marked(s), s.trips)


_n1 = "replace(printf('%.1f', round_even({x}, 1)), '.', ',')"
_hm = "strftime(make_timestamp(local_us), '%H:%M')"


@query(
    "tk6_log_points",
    f"{T} | no:i | entry:s=CASE WHEN no = 0 THEN 'departure' WHEN no = last_no THEN 'arrival' ELSE CAST(no AS VARCHAR) END | clock:s={_hm} | lat:f | lon:f | sog:s",
    f"FROM (SELECT *, {_n1.format(x=f'sog_ms / {KN}')} || ' kn' AS sog FROM log_rows) WHERE last_no > 0",
)
def tk6(spark, sf):
    s = season(spark, sf)
    return logbook.log_points(logbook.periodic_log(marked(s), periods.with_local_time(s.trips, PARAMS), PARAMS))
