"""Telemetry derived from the `events` table, the only table with a time-like order.

Every event becomes one bus message (or a few) of a boat: `event_id` is the arrival order and drives
the clock; all fields are integers in the resolution of the wire format, so both engines compute the
very same numbers. The expressions below are plain SQL that Spark and the checking engine both accept
(`//` is integer division, written `div` for Spark).

A cycle is 600 events: 300 at rest, 300 underway. Every fourth cycle runs at half speed (30 min
rest) and holds a four-minute speed blip at the quay; in every third cycle the rest is a lock (no
drift at all); elsewhere the boat swings on its mooring by about 30 m. Two rules insert long gaps,
one while underway, one at rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_S = 1766995200  # 2025-12-29 08:00:00 UTC

LEVELS: list[dict[str, str]] = [
    {
        "e": "event_id",
        "seq": "event_id",
        "boat_id": "CAST(user_id % 2 AS INT)",
        "clock_epoch": "0",
        "file_no": "event_id // 1000",
        "source": "CASE WHEN user_id % 5 = 0 THEN 22 ELSE 11 END",
        "kind": "event_type",
        "cyc": "event_id // 600",
        "o": "event_id % 600",
    },
    {
        "warp": "CASE WHEN cyc % 4 = 1 THEN 1 ELSE 0 END",
        "warps": "(cyc + 2) // 4",
        "is_lock": "CASE WHEN cyc % 3 = 2 THEN 1 ELSE 0 END",
        "next_lock": "CASE WHEN cyc % 3 = 1 THEN 1 ELSE 0 END",
    },
    {
        "ticks": "e - e % 2 + warps * 600 + warp * (o - o % 2)",
        "moved": "250 * (cyc + warps) + (LEAST(GREATEST(o, 310), 560) - 310) * (1 + warp)",
        "gap_s": "((e + 1300) // 3000) * 108000 + ((e + 4000) // 4800) * 18000",
        "swing": "CASE WHEN o >= 300 OR is_lock = 1 THEN 0 WHEN o % 200 < 50 THEN o % 200 "
        "WHEN o % 200 < 150 THEN 100 - o % 200 ELSE o % 200 - 200 END",
        "blip": "CASE WHEN warp = 1 AND o >= 110 AND o < 150 THEN 1 ELSE 0 END",
        "eng_on": "CASE WHEN o >= 302 AND o < 588 THEN 1 WHEN is_lock = 0 AND o >= 285 AND o < 302 THEN 1 "
        "WHEN o >= 588 AND next_lock = 0 THEN 1 WHEN o < 12 AND is_lock = 0 THEN 1 "
        "WHEN cyc % 5 = 3 AND is_lock = 0 AND o >= 200 AND o < 215 THEN 1 ELSE 0 END",
    },
    {
        "time_us": f"CAST({BASE_S} + ticks * 3 + gap_s AS BIGINT) * 1000000",
        "lat_raw": "460000000 + boat_id * 5000000 + moved * 900 + swing * 60 + ((e * 7919) % 11 - 5) * 10",
        "lon_raw": "ABS(moved % 6000 - 3000) * 300 - 30000000 + ((e * 104729) % 13 - 6) * 10",
        "sog_raw": "CASE WHEN o >= 300 THEN 250 + (e * 37) % 150 WHEN blip = 1 THEN 60 + e % 50 ELSE (e * 13) % 20 END",
        "cog_raw": "CASE WHEN e % 23 = 0 THEN 65535 ELSE (e * 211) % 62832 END",
        "inst": "CASE WHEN (e // 5) % 4 = 0 THEN 1 ELSE 0 END",
        "fuel_raw": "CASE WHEN e % 29 = 0 THEN 32767 WHEN eng_on = 1 THEN 60 + (e * 17) % 40 ELSE e % 3 END",
        "hours_raw": "CASE WHEN e % 31 = 0 THEN 4294967295 ELSE 3600000 + ticks * 2 END",
        "oilp_raw": "CASE WHEN e % 37 = 0 THEN 65535 ELSE 3000 + (e * 7) % 500 END",
        "oilt_raw": "CASE WHEN e % 38 = 0 THEN 65535 ELSE 3600 + (e * 11) % 100 END",
        "cool_raw": "CASE WHEN e % 36 = 0 THEN 65535 ELSE 35000 + (e * 19) % 900 END",
        "alt_raw": "CASE WHEN e % 34 = 0 THEN 32767 ELSE 1380 + (e * 3) % 60 END",
        "st1_raw": "CASE WHEN e % 41 = 0 THEN 65535 WHEN e % 43 = 0 THEN 260 WHEN e % 47 = 0 THEN 32768 ELSE 0 END",
        "st2_raw": "CASE WHEN e % 61 = 0 THEN 8 WHEN e % 59 = 0 THEN 256 ELSE 0 END",
        "load_raw": "CASE WHEN e % 33 = 0 THEN 127 ELSE e % 100 END",
        "rpm_raw": "CASE WHEN e % 67 = 0 THEN 65535 WHEN eng_on = 0 THEN 0 WHEN e % 40 = 0 THEN 4800 ELSE 8000 + (e * 29) % 400 END",
        "tfuel_raw": "CASE WHEN e % 71 = 0 THEN 65535 ELSE (ticks // 40) % 60000 END",
        "depth_raw": "CASE WHEN e % 73 = 0 THEN 4294967295 ELSE 500 + (e * 97) % 2000 END",
        "doff_raw": "CASE WHEN e % 3 = 0 THEN 350 WHEN e % 3 = 1 THEN -400 ELSE 32767 END",
        "wt_raw": "CASE WHEN e % 74 = 0 THEN 65535 ELSE 28500 + (e * 5) % 400 END",
        "ot_raw": "CASE WHEN e % 76 = 0 THEN 65535 ELSE 28800 + (e * 7) % 900 END",
        "hum_raw": "CASE WHEN e % 77 = 0 THEN 32767 ELSE 12000 + (e * 13) % 6000 END",
        "ws_raw": "CASE WHEN e % 13 = 0 THEN 65535 ELSE 300 + (e * 17) % 900 END",
        "wa_raw": "CASE WHEN e % 17 = 0 THEN 65535 ELSE (e * 389) % 62832 END",
        "wref_raw": "CASE WHEN e % 11 = 0 THEN 7 ELSE e % 5 END",
        "volt_raw": "CASE WHEN e % 27 = 0 THEN 32767 ELSE 1190 + (e * 23) % 120 END",
        "pitch_raw": "CASE WHEN e % 39 = 0 THEN 32767 ELSE (e * 53) % 2000 - 1000 END",
        "roll_raw": "CASE WHEN e % 26 = 0 THEN 32767 ELSE (e * 71) % 3000 - 1500 END",
        "mode_raw": "CASE WHEN e % 9 = 0 THEN 7 WHEN e % 9 = 1 THEN 6 ELSE e % 4 END",
        "hdop_raw": "CASE WHEN e % 10 = 0 THEN 9900 WHEN e % 9 = 0 OR e % 7 = 1 THEN 32767 ELSE 80 + e % 100 END",
    },
    {"stw_raw": "CASE WHEN e % 19 = 0 THEN 65535 ELSE sog_raw + e % 7 END"},
    # The same messages with faults: far-away positions, small steps back, clock resets.
    {
        "bad_lat_raw": "CASE WHEN e % 97 = 5 THEN lat_raw + 200000000 WHEN e % 101 = 7 THEN lat_raw + 40000 ELSE lat_raw END",
        "bad_time_us": "time_us - CASE WHEN e % 53 = 0 THEN 40000000 ELSE 0 END"
        " - CASE WHEN (e // 700) % 3 = 1 THEN 40 * CAST(86400000000 AS BIGINT) ELSE 0 END",
    },
]

_DEG = "degrees({c} * 1e-4)"


def _q(c: str, scale: str, missing: int) -> str:
    return f"CASE WHEN {c} = {missing} THEN NULL ELSE {c} * {scale} END"


# Decoded series: name -> (event kinds, {column: expression}); all carry boat, epoch, file, seq, source, time.
SERIES: dict[str, tuple[str, dict[str, str]]] = {
    "fixes": ("kind = 'view'", {"lat": "lat_raw * 1e-7", "lon": "lon_raw * 1e-7"}),
    "sog": (
        "kind IN ('view', 'click')",
        {
            "sog_ms": "sog_raw * 1e-2",
            "cog_deg": "CASE WHEN cog_raw = 65535 THEN NULL ELSE degrees(cog_raw * 1e-4) END",
        },
    ),
    "engine": (
        "kind = 'purchase'",
        {
            "instance": "inst",
            "fuel_rate_lph": _q("fuel_raw", "1e-1", 32767),
            "total_hours_s": "CASE WHEN hours_raw = 4294967295 THEN NULL ELSE hours_raw END",
            "oil_pressure_pa": _q("oilp_raw", "1e2", 65535),
            "oil_temperature_k": _q("oilt_raw", "1e-1", 65535),
            "coolant_temperature_k": _q("cool_raw", "1e-2", 65535),
            "alternator_voltage_v": _q("alt_raw", "1e-2", 32767),
            "engine_load_pct": _q("load_raw", "1e0", 127),
            "status1": "CASE WHEN st1_raw = 65535 THEN 0 ELSE st1_raw END",
            "status2": "st2_raw",
        },
    ),
    "rpm": ("kind = 'purchase'", {"instance": "inst", "rpm": _q("rpm_raw", "25e-2", 65535)}),
    "trip_fuel": ("kind = 'purchase'", {"instance": "inst", "trip_fuel_used_l": _q("tfuel_raw", "1e0", 65535)}),
    "depth": (
        "kind = 'signup' AND depth_raw <> 4294967295",
        {"depth_m": "depth_raw * 1e-2 + CASE WHEN doff_raw > 0 AND doff_raw <> 32767 THEN doff_raw * 1e-3 ELSE 0e0 END"},
    ),
    "water_temp": ("kind = 'signup' AND wt_raw <> 65535", {"temp_c": "wt_raw * 1e-2 - 27315e-2"}),
    "outside_temp": ("kind = 'signup' AND ot_raw <> 65535", {"temp_c": "ot_raw * 1e-2 - 27315e-2"}),
    "humidity": ("kind = 'signup' AND hum_raw <> 32767", {"humidity_pct": "hum_raw * 4e-3"}),
    "stw": ("kind = 'signup' AND stw_raw <> 65535", {"stw_ms": "stw_raw * 1e-2"}),
    "wind": (
        "kind = 'error' AND (ws_raw <> 65535 OR wa_raw <> 65535)",
        {
            "speed_ms": _q("ws_raw", "1e-2", 65535),
            "angle_deg": "CASE WHEN wa_raw = 65535 THEN NULL ELSE degrees(wa_raw * 1e-4) END",
            "reference": "CASE WHEN wref_raw = 7 THEN NULL ELSE wref_raw END",
        },
    ),
    "battery": ("kind = 'error'", {"instance": "e % 2", "voltage_v": _q("volt_raw", "1e-2", 32767)}),
    "attitude": (
        "kind = 'click' AND (pitch_raw <> 32767 OR roll_raw <> 32767)",
        {
            "pitch_deg": "CASE WHEN pitch_raw = 32767 THEN NULL ELSE degrees(pitch_raw * 1e-4) END",
            "roll_deg": "CASE WHEN roll_raw = 32767 THEN NULL ELSE degrees(roll_raw * 1e-4) END",
        },
    ),
    "dops": (
        "kind = 'error'",
        {
            "actual_mode": "CASE WHEN mode_raw = 7 THEN NULL ELSE mode_raw END",
            "hdop": _q("hdop_raw", "1e-2", 32767),
        },
    ),
}
COMMON = ["boat_id", "clock_epoch", "file_no", "seq", "source", "time_us"]


def for_spark(sql: str) -> str:
    return sql.replace("//", "div")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    for level in LEVELS:
        df = df.select("*", *[F.expr(for_spark(e)).alias(n) for n, e in level.items()])
    return df


def series(tele: DataFrame, name: str, time_col: str = "time_us") -> DataFrame:
    condition, columns = SERIES[name]
    common = [F.col(time_col).alias("time_us") if c == "time_us" else F.col(c) for c in COMMON]
    return tele.where(for_spark(condition)).select(*common, *[F.expr(for_spark(e)).alias(n) for n, e in columns.items()])


def all_series(tele: DataFrame) -> dict[str, DataFrame]:
    return {name: series(tele, name) for name in SERIES}


def telemetry_cte() -> str:
    """The same view as a chain of subqueries for the checking engine."""
    inner = "SELECT event_id, user_id, event_type, ts, value, props FROM events"
    for level in LEVELS:
        inner = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in level.items()) + f" FROM ({inner})"
    return inner


def series_cte(name: str) -> str:
    condition, columns = SERIES[name]
    return "SELECT " + ", ".join(COMMON + [f"{e} AS {n}" for n, e in columns.items()]) + f" FROM tele WHERE {condition}"
