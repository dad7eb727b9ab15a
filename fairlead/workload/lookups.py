"""Queries: places, hourly data, remarks, texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.functions import clocktime, geo, text
from fairlead.operators import logbook, periods, places
from fairlead.operators.scan import settle
from fairlead.workload.figures import local_trips, marked, trip_fuel_table
from fairlead.workload.oracle import KN, add_step, hav
from fairlead.workload.registry import PARAMS, landed, query, season

# Lookup tables derived from suppliers (names) around the positions the boats were at rest ------------

_PLACE_COLS = """CASE WHEN seq % 3 = 0 THEN 'leisure' ELSE 'place' END AS category, CASE WHEN seq % 4 = 0 THEN 'marina' ELSE 'pier' END AS type,
    CASE WHEN seq % 5 = 0 THEN NULL ELSE concat('Haven ', CAST(s_nationkey AS STRING)) END AS name, CASE WHEN seq % 6 = 0 THEN 1e-5 WHEN seq % 7 = 0 THEN NULL ELSE 17e-2 END AS importance"""


def _rest(spark, sf):
    tele = landed(spark, sf).where("kind = 'view' AND o < 300")
    supp = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_nationkey")
    n = supp.agg(F.count(F.lit(1)).alias("n"))
    return tele.withColumn("s_suppkey", F.col("seq") % n.scalar()).join(supp, "s_suppkey")


def place_table(spark, sf):
    """One place per rounded position: the one of its first fix."""
    df = _rest(spark, sf).withColumn("lat", F.col("lat_raw") * 1e-7).withColumn("lon", F.col("lon_raw") * 1e-7)
    df = df.withColumn("cell", places.position_key(F.col("lat"), F.col("lon")))
    df = df.select("cell", "seq", (F.col("lat") + (F.col("seq") % 2) * 0.004).alias("lat"), "lon", "s_nationkey", *[F.expr(e) for e in _exprs(_PLACE_COLS)])
    cols = ["seq", "lat", "lon", "s_nationkey", "category", "type", "name", "importance"]
    first = df.groupBy("cell").agg(F.min_by(F.struct(*cols), "seq").alias("r")).select("cell", "r.*")
    entries = F.when(F.col("seq") % 2 == 0, F.create_map(F.lit("town"), F.concat(F.lit("Town "), F.col("s_nationkey").cast("string"))))
    entries = entries.when(F.col("seq") % 9 == 1, F.create_map(F.lit("marina"), F.lit("Marina M"), F.lit("village"), F.lit("Dorp D")))
    return first.withColumn("address", entries.otherwise(F.create_map(F.lit("road"), F.lit("R")))).withColumn(
        "display_name", F.concat(F.lit("Quay "), F.col("s_nationkey").cast("string"), F.lit(", Land"))
    )


def _exprs(text_: str) -> list[str]:
    import re

    return [e.strip() for e in re.split(r",\s*(?=CASE)", text_)]


def landmark_table(spark, sf):
    c = F.col
    df = landed(spark, sf).where("kind = 'view' AND o < 300 AND cyc % 3 = 0 AND e % 40 < 4 AND boat_id = 1")
    return df.select(
        (c("lat_raw") * 1e-7 + (c("e") % 5) * 0.0008).alias("lat"), (c("lon_raw") * 1e-7 + (c("e") % 3) * 0.0005).alias("lon"),
        F.when(c("e") % 2 == 0, "lock").otherwise("islet").alias("kind"), F.concat(F.lit("Mark "), c("e").cast("string")).alias("name"),
    )


def _key(lat: str, lon: str) -> str:
    return f"(CAST(round_even({lat}, 3) AS VARCHAR) || ',' || CAST(round_even({lon}, 3) AS VARCHAR))"


add_step(
    "place_rows",
    """SELECT t.seq, t.lat_raw * 1e-7 AS plat, t.lon_raw * 1e-7 AS plon, s.s_nationkey FROM tele t JOIN supplier s ON s.s_suppkey = t.seq % (SELECT count(*) FROM supplier) WHERE kind = 'view' AND o < 300""",
)
add_step(
    "places",
    f"""SELECT {_key('plat', 'plon')} AS cell, seq, plat + (seq % 2) * 4e-3 AS lat, plon AS lon, {_PLACE_COLS.replace('AS STRING', 'AS VARCHAR')},
    CASE WHEN seq % 2 = 0 THEN 'Town ' || s_nationkey END AS town, CASE WHEN seq % 2 = 1 AND seq % 9 = 1 THEN 'Dorp D' END AS village, CASE WHEN seq % 2 = 1 AND seq % 9 = 1 THEN 'Marina M' END AS marina,
    'Quay ' || s_nationkey AS shown FROM place_rows QUALIFY row_number() OVER (PARTITION BY {_key('plat', 'plon')} ORDER BY seq) = 1""",
)
add_step(
    "landmarks",
    """SELECT lat_raw * 1e-7 + (e % 5) * 8e-4 AS lat, lon_raw * 1e-7 + (e % 3) * 5e-4 AS lon, e % 2 = 0 AS mooring, 'Mark ' || e AS name
    FROM tele WHERE kind = 'view' AND o < 300 AND cyc % 3 = 0 AND e % 40 < 4 AND boat_id = 1""",
)
_M = "6371000e0"
add_step(
    "mark_hits",
    f"""SELECT s.boat_id, s.final_no, m.name, m.mooring, {hav('s.lat', 's.lon', 'm.lat', 'm.lon', _M)} AS d FROM stays s, landmarks m WHERE abs(s.lat - m.lat) < 1e-2 AND {hav('s.lat', 's.lon', 'm.lat', 'm.lon', _M)} <= 300
    QUALIFY row_number() OVER (PARTITION BY s.boat_id, s.final_no ORDER BY {hav('s.lat', 's.lon', 'm.lat', 'm.lon', _M)}, m.name) = 1""",
)
_PICKED = """CASE WHEN category = 'leisure' AND p.name IS NOT NULL AND coalesce(importance, 1e0) < 1e-3 THEN coalesce(town, village, p.name)
    WHEN category = 'leisure' AND p.name IS NOT NULL THEN p.name ELSE coalesce(marina, town, village, p.name, shown) END"""
add_step(
    "named_stays",
    f"""SELECT s.boat_id, s.final_no, CASE WHEN h.name IS NOT NULL THEN CASE WHEN h.d <= 250 THEN h.name WHEN h.mooring THEN 'aan de kant, bij ' || h.name ELSE 'op het water, bij ' || h.name END
      WHEN p.cell IS NOT NULL THEN CASE WHEN {hav('s.lat', 's.lon', 'p.lat', 'p.lon', _M)} <= 250 THEN {_PICKED} WHEN type = 'marina' THEN 'aan de kant, bij ' || {_PICKED} ELSE 'op het water, bij ' || {_PICKED} END
      ELSE printf('%.4f', s.lat) || ', ' || printf('%.4f', s.lon) END AS place
    FROM stays s LEFT JOIN places p ON p.cell = {_key('s.lat', 's.lon')} LEFT JOIN mark_hits h ON h.boat_id = s.boat_id AND h.final_no = s.final_no""",
)


@query("jn8_gazetteer", "boat_id:i | final_no:i | place:s", "FROM named_stays")
def jn8(spark, sf):
    return places.resolve_places(season(spark, sf).stays, place_table(spark, sf), landmark_table(spark, sf), ["boat_id", "final_no"])


@query("jn9_place_name_rules", "cell:s | place:s", f"FROM (SELECT cell, {_PICKED} AS place FROM places p)")
def jn9(spark, sf):
    return place_table(spark, sf).withColumn("place", places.place_name(F.col("lat"), F.col("lon")))


add_step(
    "trip_places",
    """SELECT t.boat_id, t.trip_no, coalesce(a.place, 'Unknown (start outside log file)') AS depart_place, coalesce(b.place, 'Unknown (end outside log file)') AS arrive_place
      FROM trips t LEFT JOIN named_stays a ON a.boat_id = t.boat_id AND a.final_no = t.final_no - 1 LEFT JOIN named_stays b ON b.boat_id = t.boat_id AND b.final_no = t.final_no + 1""",
)


@query("jn13_resolve_trip_places", "boat_id:i | trip_no:i | depart_place:s | arrive_place:s", "FROM trip_places")
def jn13(spark, sf):
    return places.resolve_trip_places(season(spark, sf).trips, place_table(spark, sf), landmark_table(spark, sf))


@query(
    "jn15_position_key",
    "cell:s | name:s",
    """FROM (SELECT CAST(round_even((lat_raw + 3) * 1e-7, 3) AS VARCHAR) || ',' || CAST(round_even((lon_raw + 3) * 1e-7, 3) AS VARCHAR) AS cell, arg_max('P' || e, e) AS name
      FROM tele WHERE kind = 'view' AND e % 50 <> 0 GROUP BY ALL)""",
)
def jn15(spark, sf):
    c = F.col
    old = landed(spark, sf).where("kind = 'view'").select(
        F.when(c("e") % 50 == 0, F.lit("not a key")).otherwise(places.position_key((c("lat_raw") + 3) * 1e-7, (c("lon_raw") + 3) * 1e-7, 7)).alias("cell"),
        F.concat(F.lit("P"), c("e").cast("string")).alias("name"), c("e").alias("entry_no"),
    )
    return places.rekey_cache(old)


# Hourly data: a model value for every visited day and rounded position -------------------------------


def _days(spark, sf):
    c = F.col
    pts = landed(spark, sf).where("kind = 'view'").select(
        F.floor(c("time_us") / 86_400_000_000).cast("bigint").alias("d"), F.bround(c("lat_raw") * 1e-7, 2).alias("lat2"), F.bround(c("lon_raw") * 1e-7, 2).alias("lon2")
    ).distinct()
    date = F.date_format(clocktime.day_of(c("d") * 86_400_000_000), "yyyy-MM-dd")
    hours = F.expr("transform(sequence(0, 23), h -> concat(date, 'T', lpad(cast(h as string), 2, '0'), ':00'))")
    return pts.withColumn("date", date).withColumn("time", hours)


def _ramp(mult: int, add: int, count: int = 24):
    return F.expr(f"transform(sequence(0, {count - 1}), h -> cast(h * {mult} + d % 7 + {add} as double))")


def weather_table(spark, sf):
    return places.weather_hours(
        _days(spark, sf).withColumns({"wind_speed_10m": _ramp(1, 2), "wind_direction_10m": _ramp(14, 3), "precipitation": _ramp(0, 1), "cloud_cover": _ramp(2, 20, 12)})
    )


def marine_table(spark, sf):
    return places.marine_hours(
        _days(spark, sf).withColumns(
            {"wave_height": _ramp(0, 1), "wave_direction": _ramp(13, 1), "wave_period": _ramp(1, 3, 20), "ocean_current_velocity": _ramp(1, 1), "ocean_current_direction": _ramp(11, 2)}
        )
    )


add_step("visited", "SELECT DISTINCT time_us // 86400000000 AS d, round_even(lat_raw * 1e-7, 2) AS lat2, round_even(lon_raw * 1e-7, 2) AS lon2 FROM tele WHERE kind = 'view'")
add_step(
    "hours",
    """SELECT d, lat2, lon2, h, h + d % 7 + 2 AS wind_kn, h * 14 + d % 7 + 3 AS wind_deg, d % 7 + 1 AS precip_mm, CASE WHEN h < 12 THEN h * 2 + d % 7 + 20 END AS cloud_pct,
    d % 7 + 1 AS wave_height_m, h * 13 + d % 7 + 1 AS wave_direction_deg, CASE WHEN h < 20 THEN h + d % 7 + 3 END AS wave_period_s, (h + d % 7 + 1) / 1852e-3 AS current_kn, h * 11 + d % 7 + 2 AS current_direction_deg
    FROM visited, (SELECT unnest(range(24)) AS h)""",
)
_HK = "strftime(make_timestamp(d * 86400000000 + h * 3600000000), '%Y-%m-%dT%H:00')"


@query("jn12_explode_hours", "hour:s | lat2:f | lon2:f | wind_kn:f | wind_deg:f | precip_mm:f | cloud_pct:f", f"FROM (SELECT *, {_HK} AS hour FROM hours)")
def jn12(spark, sf):
    return weather_table(spark, sf)


_HJ = "FROM (SELECT l.boat_id, l.trip_no, l.no, h.* EXCLUDE (d, lat2, lon2, h) FROM log_rows l LEFT JOIN hours h ON h.d = l.time_us // 86400000000 AND h.h = (l.time_us // 3600000000) % 24 AND h.lat2 = round_even(l.lat, 2) AND h.lon2 = round_even(l.lon, 2))"


def log_entries(s):
    return logbook.periodic_log(marked(s), periods.with_local_time(s.trips, PARAMS), PARAMS)


@query("jn10_weather", "boat_id:i | trip_no:i | no:i | wind_kn:f | wind_deg:f | precip_mm:f | cloud_pct:f", _HJ)
def jn10(spark, sf):
    return places.join_hourly(log_entries(season(spark, sf)), weather_table(spark, sf))


@query("jn11_marine", "boat_id:i | trip_no:i | no:i | wave_height_m:f | wave_direction_deg:f | wave_period_s:f | current_kn:f | current_direction_deg:f", _HJ)
def jn11(spark, sf):
    return places.join_hourly(log_entries(season(spark, sf)), marine_table(spark, sf))


@query("jn14_remarks", "boat_id:i | trip_no:i | trip_uid:s | remark:s=CASE WHEN trip_no % 2 = 0 THEN concat('Remark ', trip_no) END", "FROM uids")
def jn14(spark, sf):
    df = settle(periods.with_trip_uid(periods.with_local_time(season(spark, sf).trips, PARAMS)).select("boat_id", "trip_no", "trip_uid"))
    remarks = df.where("trip_no % 2 = 0").withColumn("remark", F.concat(F.lit("Remark "), F.col("trip_no").cast("string")))
    return places.with_remarks(df, remarks)


# Scalar functions over whole series -------------------------------------------------------------------


@query(
    "sc1_haversine",
    "seq:i | nm:f | m:f",
    f"FROM (SELECT seq, {hav('lat', 'lon', 'lat + 1e-3 * (seq % 90)', 'lon - 2e-3 * (seq % 70)')} AS nm, {hav('lat', 'lon', 'lat + 1e-3 * (seq % 90)', 'lon - 2e-3 * (seq % 70)', _M)} AS m FROM s_fixes)",
)
def sc1(spark, sf):
    c = F.col
    df = landed(spark, sf).where("kind = 'view'").select("seq", (c("lat_raw") * 1e-7).alias("a"), (c("lon_raw") * 1e-7).alias("b"))
    p, q = c("a") + 0.001 * (c("seq") % 90), c("b") - 0.002 * (c("seq") % 70)
    return df.select("seq", geo.haversine_nm(c("a"), c("b"), p, q).alias("nm"), geo.haversine_m(c("a"), c("b"), p, q).alias("m"))


@query(
    "sc2_utc_offset",
    "seq:i | offset_h:f",
    """FROM (SELECT seq, CASE WHEN (lat BETWEEN 495e-1 AND 61 AND lon BETWEEN -11 AND 2) OR (lat BETWEEN 368e-1 AND 422e-1 AND lon BETWEEN -96e-1 AND -6) THEN 0
      WHEN lat BETWEEN 36 AND 71 AND lon BETWEEN -95e-1 AND 155e-1 THEN 1 ELSE greatest(-12, least(14, CAST(round_even(lon / 15, 0) AS BIGINT))) END
      + CASE WHEN t >= epoch_us((mar - INTERVAL (dayofweek(mar)) DAY) + INTERVAL 1 HOUR) AND t < epoch_us((oct - INTERVAL (dayofweek(oct)) DAY) + INTERVAL 1 HOUR) THEN 1 ELSE 0 END AS offset_h FROM (
      SELECT *, CAST(make_date(year(make_timestamp(t)), 3, 31) AS TIMESTAMP) AS mar, CAST(make_date(year(make_timestamp(t)), 10, 31) AS TIMESTAMP) AS oct FROM (
      SELECT seq, (seq * 37 % 1600) / 1e1 - 80 AS lat, (seq * 53 % 3599) / 1e1 - 180 AS lon, time_us + seq * 3600000000 * 11 AS t FROM tele)))""",
)
def sc2(spark, sf):
    c = F.col
    df = landed(spark, sf).select("seq", "time_us")
    lat, lon = (c("seq") * 37 % 1600) / 10.0 - 80, (c("seq") * 53 % 3599) / 10.0 - 180
    return df.select("seq", clocktime.utc_offset_hours(lat, lon, c("time_us") + c("seq") * 3_600_000_000 * 11).alias("offset_h"))


@query(
    "sc4_rounded_minutes",
    "seq:i | minutes:i | h_mm:s",
    "FROM (SELECT seq, m AS minutes, CAST(m // 60 AS VARCHAR) || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') AS h_mm FROM (SELECT seq, CAST(round_even(seq * 30e0 / 60, 0) AS BIGINT) AS m FROM tele))",
)
def sc4(spark, sf):
    us = F.col("seq") * 30_000_000
    return landed(spark, sf).select("seq", clocktime.rounded_minutes(us).alias("minutes"), clocktime.hours_text(us).alias("h_mm"))


@query(
    "sc5_beaufort",
    "seq:i | force:i",
    "FROM (SELECT seq, CASE WHEN kn < 1 THEN 0 WHEN kn < 4 THEN 1 WHEN kn < 7 THEN 2 WHEN kn < 11 THEN 3 WHEN kn < 17 THEN 4 WHEN kn < 22 THEN 5 WHEN kn < 28 THEN 6 WHEN kn < 34 THEN 7 WHEN kn < 41 THEN 8 WHEN kn < 48 THEN 9 WHEN kn < 56 THEN 10 WHEN kn < 64 THEN 11 ELSE 12 END AS force FROM (SELECT seq, (seq % 140) / 2e0 AS kn FROM tele))",
)
def sc5(spark, sf):
    return landed(spark, sf).select("seq", text.beaufort((F.col("seq") % 140) / 2.0).alias("force"))


@query(
    "sc6_compass",
    "seq:i | point:s",
    "FROM (SELECT seq, ['N','NNO','NO','ONO','O','OZO','ZO','ZZO','Z','ZZW','ZW','WZW','W','WNW','NW','NNW'][CAST(round_even((seq % 1440) / 4e0 / 225e-1, 0) AS BIGINT) % 16 + 1] AS point FROM tele)",
)
def sc6(spark, sf):
    return landed(spark, sf).select("seq", text.compass((F.col("seq") % 1440) / 4.0).alias("point"))


@query(
    "sc7_wind_side",
    "seq:i | side:s",
    """FROM (SELECT seq, CASE WHEN ref IN (2, 3, 4) THEN CASE WHEN a > 180 THEN CAST(360 - a AS VARCHAR) || '° port' ELSE CAST(a AS VARCHAR) || '° starboard' END ELSE CAST(a AS VARCHAR) || '°' END AS side
      FROM (SELECT seq, seq * 7 % 360 AS a, seq % 6 AS ref FROM tele))""",
)
def sc7(spark, sf):
    return landed(spark, sf).select("seq", text.wind_side((F.col("seq") * 7 % 720).cast("double"), F.col("seq") % 6).alias("side"))


@query(
    "sc8_place_prefix",
    "boat_id:i | final_no:i | kind:s | name:s",
    """FROM (SELECT boat_id, final_no, CASE WHEN place LIKE 'aan de kant, bij %' THEN 'mooring' WHEN place LIKE 'op het water, bij %' THEN 'water' END AS kind,
      replace(replace(place, 'aan de kant, bij ', ''), 'op het water, bij ', '') AS name FROM named_stays)""",
)
def sc8(spark, sf):
    named = places.resolve_places(season(spark, sf).stays, place_table(spark, sf), landmark_table(spark, sf), ["boat_id", "final_no"])
    return named.select("boat_id", "final_no", text.place_kind(F.col("place")).alias("kind"), text.place_plain(F.col("place")).alias("name"))


@query(
    "sc9_decimal_comma",
    "seq:i | one:s | two:s",
    "FROM (SELECT seq, replace(printf('%.1f', round_even(x, 1)), '.', ',') AS one, replace(printf('%.2f', round_even(x, 2)), '.', ',') AS two FROM (SELECT seq, seq / 8e0 AS x FROM tele))",
)
def sc9(spark, sf):
    x = F.col("seq") / 8.0
    return landed(spark, sf).select("seq", text.comma(x).alias("one"), text.comma(x, 2).alias("two"))



def _num(x: str, d: int = 1) -> str:
    return f"replace(printf('%.{d}f', round_even({x}, {d})), '.', ',')"


def _range_sql(table: str, col: str, unit: str, d: int, wide: str) -> str:
    a, lo, hi = f"avg_{col}", f"min_{col}", f"max_{col}"
    return f"SELECT boat_id, trip_no, {_num(a, d)} || '{unit}' || CASE WHEN {hi} - {lo} > {wide} THEN ' (' || {_num(lo, d)} || '–' || {_num(hi, d)} || '{unit})' ELSE '' END AS t FROM {table}"


@query(
    "sc10_notable_range",
    "boat_id:i | trip_no:i | temperature:s | humidity:s",
    f"FROM (SELECT a.boat_id, a.trip_no, a.t AS temperature, b.t AS humidity FROM ({_range_sql('climate_t', 'temp_c', '°C', 1, '5e-1')}) a JOIN ({_range_sql('climate_h', 'humidity_pct', '%', 0, '2e0')}) b USING (boat_id, trip_no))",
)
def sc10(spark, sf):
    from fairlead.operators import stats

    s = season(spark, sf)
    t = stats.series_range(s.trips, s.tables["outside_temp"], "temp_c", PARAMS)
    h = stats.series_range(s.trips, s.tables["humidity"], "humidity_pct", PARAMS)
    c = F.col
    df = t.join(h, stats.TRIP)
    return df.select(
        "boat_id", "trip_no",
        text.range_text(c("avg_temp_c"), c("min_temp_c"), c("max_temp_c"), "°C", 1, 0.5).alias("temperature"),
        text.range_text(c("avg_humidity_pct"), c("min_humidity_pct"), c("max_humidity_pct"), "%", 0, 2.0).alias("humidity"),
    )
