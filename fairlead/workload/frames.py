"""Queries: records, multi-frame messages, bus clock, decoders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.operators import decode
from fairlead.operators import frames as fr
from fairlead.operators.scan import settle
from fairlead.workload import fixture
from fairlead.workload.oracle import add_step
from fairlead.workload.registry import landed, query


def _tele(spark, sf):
    return landed(spark, sf)


def _frames(spark, sf, *pgns):
    df = landed(spark, sf, "frames")
    return df.where(F.col("pgn").isin(*pgns)) if pgns else df


def _hex(c: str, n: int) -> str:
    v = f"(CASE WHEN {c} < 0 THEN {c} + {1 << (8 * n)} ELSE {c} END)"
    return " || ".join(f"printf('%02X', CAST(({v} // {1 << (8 * i)}) % 256 AS BIGINT))" for i in range(n))


_POS = _hex("lat_raw", 4) + " || " + _hex("lon_raw", 4)
add_step(
    "records",
    f"""SELECT boat_id, file_no, seq, source, e % 8 AS priority, CASE WHEN e % 10 = 3 THEN 59904 ELSE 129025 END AS pgn, CASE WHEN e % 10 = 3 THEN e % 200 ELSE 255 END AS destination,
    CASE WHEN e % 10 = 3 THEN '01F801' ELSE {_POS} END AS data FROM tele WHERE kind = 'view' AND e % 31 <> 0 AND e % 37 <> 0""",
)


@query("src2_parse_records", "boat_id:i | file_no:i | seq:i | source:i | priority:i | pgn:i | destination:i | data:s", "FROM records")
def src2(spark, sf):
    return fr.parse_records(landed(spark, sf, "records")).withColumn("data", F.hex("data"))


# Which events send a message of each type, in the order that numbers an event's messages.
_SENT = {
    129025: "kind = 'view'", 129026: "kind IN ('view', 'click')", 127489: "kind = 'purchase'", 127488: "kind = 'purchase'", 127497: "kind = 'purchase'",
    128267: "kind = 'signup'", 130312: "kind = 'signup'", 130313: "kind = 'signup'", 128259: "kind = 'signup'", 129539: "kind = 'error'",
    130306: "kind = 'error'", 127508: "kind = 'error'", 127257: "kind = 'click'", 126992: "e % 3 = 0",
}
_K = {p: k for k, p in enumerate(_SENT)}
add_step("sent", " UNION ALL ".join(f"SELECT boat_id, file_no, e * 16 + {_K[p]} AS seq, {p} AS pgn FROM tele WHERE {w}" for p, w in _SENT.items()))


@query(
    "src3_keep_pgns",
    "pgn:i | n:i",
    "FROM (SELECT pgn, count(*) AS n FROM sent WHERE pgn IN (129025, 127488, 126992) GROUP BY pgn)",
)
def src3(spark, sf):
    return fr.keep_pgns(landed(spark, sf, "frames"), [129025, 127488]).groupBy("pgn").agg(F.count(F.lit(1)).alias("n"))


_ENGINE = " || ".join(
    [_hex("inst", 1), _hex("oilp_raw", 2), _hex("oilt_raw", 2), _hex("cool_raw", 2), _hex("alt_raw", 2), _hex("fuel_raw", 2), _hex("hours_raw", 4),
     "'FFFFFFFFFF'", _hex("st1_raw", 2), _hex("st2_raw", 2), _hex("load_raw", 1), "'FF'"]
)


@query(
    "src5_fast_packet",
    "boat_id:i | file_no:i | source:i | seq:i | data:s",
    f"FROM (SELECT boat_id, file_no, source, e * 16 + 6 AS seq, {_ENGINE} AS data FROM tele WHERE kind = 'purchase' AND e % 7 <> 0 AND e % 13 <> 0)",
)
def src5(spark, sf):
    return fr.reassemble(landed(spark, sf, "fast")).withColumn("data", F.hex("data"))


add_step(
    "clock_msgs",
    """SELECT boat_id, file_no, e * 16 + 13 AS seq, src AS source, time_us + CASE WHEN src = 12 THEN 1000000 ELSE 0 END AS clock_us FROM (
    SELECT *, CASE WHEN (e // 400) % 2 = 0 THEN CASE WHEN e % 5 < 3 THEN 10 ELSE 12 END ELSE CASE WHEN e % 5 < 1 THEN 10 ELSE 12 END END AS src FROM tele WHERE e % 3 = 0 AND e % 51 <> 0)""",
)


def _elected(part: str, readings: str = "clock_msgs") -> str:
    return f"""SELECT boat_id, file_no, seq, source, clock_us, nth, last_value(lead IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY seq) AS leader FROM (
    SELECT *, CASE WHEN coalesce(nth > max(nth) OVER (PARTITION BY {part} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN source END AS lead FROM (
    SELECT *, row_number() OVER (PARTITION BY {part}, source ORDER BY seq) AS nth FROM {readings}))"""


add_step("elected", _elected("boat_id"))
add_step("elected_own", _elected("boat_id, file_no"))


def _clock(spark, sf):
    return fr.elect_clock(fr.system_times(_frames(spark, sf, 126992)))


@query("src6_clock_election", "boat_id:i | file_no:i | seq:i | source:i | clock_us:i | nth:i | leader:i | trusted:b=source = leader", "FROM elected")
def src6(spark, sf):
    return _clock(spark, sf)


def _stamped(elected: str, same_file: str) -> str:
    return f"""SELECT x.boat_id, x.file_no, x.seq, x.pgn, c.clock_us AS time_us FROM (SELECT * FROM sent WHERE pgn <> 126992) x
      ASOF JOIN (SELECT * FROM {elected} WHERE source = leader) c ON x.boat_id = c.boat_id {same_file} AND x.seq >= c.seq"""


add_step("stamped", _stamped("elected", ""))
add_step("stamped_own", _stamped("elected_own", "AND x.file_no = c.file_no"))


@query("src7_stamp", "boat_id:i | file_no:i | seq:i | pgn:i | time_us:i", "FROM stamped")
def src7(spark, sf):
    frames = _frames(spark, sf).drop("time_us")
    return fr.stamp(frames, fr.elect_clock(fr.system_times(frames)))


@query(
    "src8_clock_state",
    "boat_id:i | file_no:i | last_us:i | leader:i | n10:i | n12:i",
    """FROM (SELECT f.boat_id, f.file_no,
      (SELECT arg_max(clock_us, seq) FROM elected e WHERE e.boat_id = f.boat_id AND e.file_no <= f.file_no AND e.source = e.leader) AS last_us,
      (SELECT arg_max(leader, seq) FROM elected e WHERE e.boat_id = f.boat_id AND e.file_no <= f.file_no) AS leader,
      (SELECT count(*) FROM elected e WHERE e.boat_id = f.boat_id AND e.file_no <= f.file_no AND e.source = 10) AS n10,
      (SELECT count(*) FROM elected e WHERE e.boat_id = f.boat_id AND e.file_no <= f.file_no AND e.source = 12) AS n12
      FROM (SELECT DISTINCT boat_id, file_no FROM elected) f)""",
)
def src8(spark, sf):
    state = fr.clock_state(_clock(spark, sf))
    count = lambda s: F.coalesce(F.try_element_at("source_counts", F.lit(s)), F.lit(0))
    return state.withColumn("n10", count(10)).withColumn("n12", count(12))


@query(
    "src8_resumed_stamp",
    "boat_id:i | file_no:i | seq:i | pgn:i | time_us:i",
    "FROM (SELECT s.* FROM stamped s JOIN (SELECT boat_id, (max(file_no) + 1) // 2 AS start FROM tele GROUP BY boat_id) x ON s.boat_id = x.boat_id AND s.file_no >= x.start)",
)
def src8_resumed(spark, sf):
    """The later half of every boat's files, stamped with the clock carried over from the earlier half."""
    frames = _frames(spark, sf).drop("time_us")
    starts = settle(_tele(spark, sf).groupBy("boat_id").agg(F.expr("(max(file_no) + 1) div 2").alias("file_no")))
    carried = settle(fr.carried_clock(fr.clock_state(_clock(spark, sf)), starts))
    later = fr.from_files(frames, starts)
    return fr.stamp(later, fr.elect_clock(fr.system_times(later), carried=carried), carried=carried)


@query(
    "src9_first_timestamp",
    "boat_id:i | file_no:i | first_us:i",
    "FROM (SELECT f.boat_id, f.file_no, (SELECT arg_min(time_us, seq) FROM stamped_own s WHERE s.boat_id = f.boat_id AND s.file_no = f.file_no) AS first_us FROM (SELECT DISTINCT boat_id, file_no FROM tele) f)",
)
def src9(spark, sf):
    tele = _tele(spark, sf)
    frames = _frames(spark, sf).drop("time_us")
    return fr.first_timestamps(frames, tele.select("boat_id", "file_no").distinct())


# Decoders: expected values straight from the integers the payloads were packed from. ---------------

_WHOLE = "e % 19 <> 3"


def _dec(name: str, pgn: int, fn, columns: str, where: str, values: str, pick_cols=None):
    cols = f"boat_id:i | seq:i | source:i | {columns}"
    rest = f"FROM (SELECT boat_id, e * 16 + {_K[pgn]} AS seq, source, {values} FROM tele WHERE {where})"
    query(name, cols, rest)(lambda spark, sf: fn(_frames(spark, sf, pgn)))


def _v(raw: str, scale: str, missing: int, name: str) -> str:
    return f"CASE WHEN {raw} = {missing} OR e % 19 = 3 THEN NULL ELSE {raw} * {scale} END AS {name}"


def _deg(raw: str, missing: int, name: str) -> str:
    return f"CASE WHEN {raw} = {missing} OR e % 19 = 3 THEN NULL ELSE degrees({raw} * 1e-4) END AS {name}"


_dec("dec1_position", 129025, decode.position, "lat:p | lon:p", f"kind = 'view' AND {_WHOLE}", "lat_raw * 1e-7 AS lat, lon_raw * 1e-7 AS lon")
_SOG = f"kind IN ('view', 'click') AND {_WHOLE}"
_dec("dec2_speed_over_ground", 129026, decode.speed_over_ground, "sog_ms:f", _SOG, "sog_raw * 1e-2 AS sog_ms")
_dec("dec3_course_over_ground", 129026, decode.speed_over_ground, "cog_deg:f", _SOG, _deg("cog_raw", 65535, "cog_deg"))
_dec("dec4_engine_rapid", 127488, decode.engine_rapid, "instance:i | rpm:f", "kind = 'purchase'", f"inst AS instance, {_v('rpm_raw', '25e-2', 65535, 'rpm')}")
_dec(
    "dec5_engine_dynamic",
    127489,
    decode.engine_dynamic,
    "instance:i | fuel_rate_lph:f | total_hours_s:i | oil_pressure_pa:f | oil_temperature_k:f | coolant_temperature_k:f | alternator_voltage_v:f | engine_load_pct:f",
    "kind = 'purchase'",
    ", ".join(
        [
            "inst AS instance",
            _v("fuel_raw", "1e-1", 32767, "fuel_rate_lph"),
            _v("hours_raw", "1", 4294967295, "total_hours_s"),
            _v("oilp_raw", "1e2", 65535, "oil_pressure_pa"),
            _v("oilt_raw", "1e-1", 65535, "oil_temperature_k"),
            _v("cool_raw", "1e-2", 65535, "coolant_temperature_k"),
            _v("alt_raw", "1e-2", 32767, "alternator_voltage_v"),
            _v("load_raw", "1e0", 127, "engine_load_pct"),
        ]
    ),
)
_WARN = """CASE WHEN e % 19 = 3 THEN '' ELSE concat_ws(', ', CASE WHEN st1_raw = 260 THEN 'Low Oil Pressure' END, CASE WHEN st1_raw = 32768 THEN 'Emergency Stop' END,
  CASE WHEN st2_raw = 8 THEN 'Maintenance Needed' END, CASE WHEN st1_raw = 260 THEN 'Water In Fuel' END) END"""
query(
    "dec6_warning_bits",
    "boat_id:i | seq:i | warnings:s",
    f"""FROM (SELECT boat_id, e * 16 + 2 AS seq, array_to_string(list_sort(string_split({_WARN}, ', ')), ', ') AS warnings FROM tele WHERE kind = 'purchase')""",
)(
    lambda spark, sf: decode.with_warnings(decode.engine_dynamic(_frames(spark, sf, 127489))).withColumn(
        "warnings", F.array_join("warnings", ", ")
    )
)
_dec(
    "dec7_depth", 128267, decode.depth, "depth_m:f", f"kind = 'signup' AND {_WHOLE} AND depth_raw <> 4294967295",
    "depth_raw * 1e-2 + CASE WHEN e % 3 = 0 THEN 35e-2 ELSE 0e0 END AS depth_m",
)
_dec("dec8_sea_temperature", 130312, decode.water_temperature, "temp_c:f", f"kind = 'signup' AND {_WHOLE} AND e % 2 = 0 AND wt_raw <> 65535", "wt_raw * 1e-2 - 27315e-2 AS temp_c")
_dec("dec9_outside_temperature", 130312, decode.outside_temperature, "temp_c:f", f"kind = 'signup' AND {_WHOLE} AND e % 2 = 1 AND ot_raw <> 65535", "ot_raw * 1e-2 - 27315e-2 AS temp_c")
_dec("dec10_humidity", 130313, decode.humidity, "humidity_pct:f", f"kind = 'signup' AND {_WHOLE} AND e % 3 = 1 AND hum_raw <> 32767", "hum_raw * 4e-3 AS humidity_pct")
_dec(
    "dec11_wind", 130306, decode.wind, "speed_ms:f | angle_deg:f | reference:i", f"kind = 'error' AND {_WHOLE} AND NOT (ws_raw = 65535 AND wa_raw = 65535)",
    f"{_v('ws_raw', '1e-2', 65535, 'speed_ms')}, {_deg('wa_raw', 65535, 'angle_deg')}, {_v('wref_raw', '1', 7, 'reference')}",
)
_dec("dec12_speed_through_water", 128259, decode.speed_through_water, "stw_ms:f", f"kind = 'signup' AND {_WHOLE} AND stw_raw <> 65535", "stw_raw * 1e-2 AS stw_ms")
_dec("dec13_battery", 127508, decode.battery, "instance:i | voltage_v:f", "kind = 'error'", f"e % 2 AS instance, {_v('volt_raw', '1e-2', 32767, 'voltage_v')}")
_dec(
    "dec14_attitude", 127257, decode.attitude, "pitch_deg:f | roll_deg:f", f"kind = 'click' AND {_WHOLE} AND NOT (pitch_raw = 32767 AND roll_raw = 32767)",
    "CAST(CASE WHEN pitch_raw = 32767 THEN NULL ELSE degrees(pitch_raw * 1e-4) END AS FLOAT) AS pitch_deg, CAST(CASE WHEN roll_raw = 32767 THEN NULL ELSE degrees(roll_raw * 1e-4) END AS FLOAT) AS roll_deg",
)
_dec("dec15_gnss_dops", 129539, decode.gnss_dops, "actual_mode:i | hdop:f", f"kind = 'error' AND {_WHOLE}", f"{_v('mode_raw', '1', 7, 'actual_mode')}, {_v('hdop_raw', '1e-2', 32767, 'hdop')}")
_dec("dec16_trip_fuel", 127497, decode.trip_fuel, "instance:i | trip_fuel_used_l:f", "kind = 'purchase'", f"inst AS instance, {_v('tfuel_raw', '1e0', 65535, 'trip_fuel_used_l')}")


@query("dec17_system_time", "boat_id:i | seq:i | source:i | clock_us:i", "FROM clock_msgs")
def dec17(spark, sf):
    return fr.system_times(_frames(spark, sf, 126992))


_SERIES_WHERE = {
    "fixes": f"kind = 'view' AND {_WHOLE}",
    "sog": _SOG,
    "engine": "kind = 'purchase'",
    "rpm": "kind = 'purchase'",
    "trip_fuel": "kind = 'purchase'",
    "depth": f"kind = 'signup' AND {_WHOLE} AND depth_raw <> 4294967295",
    "water_temp": f"kind = 'signup' AND {_WHOLE} AND e % 2 = 0 AND wt_raw <> 65535",
    "outside_temp": f"kind = 'signup' AND {_WHOLE} AND e % 2 = 1 AND ot_raw <> 65535",
    "humidity": f"kind = 'signup' AND {_WHOLE} AND e % 3 = 1 AND hum_raw <> 32767",
    "wind": f"kind = 'error' AND {_WHOLE} AND NOT (ws_raw = 65535 AND wa_raw = 65535)",
    "stw": f"kind = 'signup' AND {_WHOLE} AND stw_raw <> 65535",
    "battery": "kind = 'error'",
    "attitude": f"kind = 'click' AND {_WHOLE} AND NOT (pitch_raw = 32767 AND roll_raw = 32767)",
    "dops": f"kind = 'error' AND {_WHOLE}",
}
_ROUTED = " UNION ALL ".join(f"SELECT '{n}' AS series, boat_id, source, count(*) AS n, min(time_us) AS first_us FROM tele WHERE {w} GROUP BY ALL" for n, w in _SERIES_WHERE.items())


@query("dec18_route_series", "series:s | boat_id:i | source:i | n:i | first_us:i", f"FROM ({_ROUTED})")
def dec18(spark, sf):
    out = None
    for name, df in decode.decode_all(_frames(spark, sf)).items():
        part = df.groupBy("boat_id", "source").agg(F.count(F.lit(1)).alias("n"), F.min("time_us").alias("first_us")).withColumn("series", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_PGN_OF = {
    "fixes": 129025, "sog": 129026, "engine": 127489, "rpm": 127488, "trip_fuel": 127497, "depth": 128267, "water_temp": 130312, "outside_temp": 130312,
    "humidity": 130313, "wind": 130306, "stw": 128259, "battery": 127508, "attitude": 127257, "dops": 129539,
}
_KEPT = " UNION ALL ".join(f"SELECT '{n}' AS series, {p} AS pgn, (SELECT count(*) FROM sent WHERE pgn = {p}) AS sent, (SELECT count(*) FROM tele WHERE {_SERIES_WHERE[n]}) AS kept" for n, p in _PGN_OF.items())


@query("dq7_null_filter", "series:s | pgn:i | sent:i | kept:i", f"FROM ({_KEPT})")
def dq7(spark, sf):
    """Messages of every series' type, and how many of them say anything."""
    frames = _frames(spark, sf)
    counts = [df.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(n).alias("series"), F.lit(_PGN_OF[n]).alias("pgn"), "kept") for n, df in decode.decode_all(frames).items()]
    return reduce(DataFrame.unionByName, counts).join(frames.groupBy("pgn").agg(F.count(F.lit(1)).alias("sent")), "pgn")


add_step("all_series", " UNION ALL ".join(f"SELECT '{n}' AS series, boat_id, file_no, source, seq, time_us FROM s_{n}" for n in fixture.SERIES))


@query("set1_union_series", "series:s | boat_id:i | file_no:i | source:i | seq:i | time_us:i", "FROM all_series")
def set1(spark, sf):
    tele = _tele(spark, sf)
    columns = ["boat_id", "file_no", "source", "seq", "time_us"]
    return reduce(DataFrame.unionByName, [fixture.series(tele, n).select(F.lit(n).alias("series"), *columns) for n in fixture.SERIES])
