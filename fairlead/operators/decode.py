"""Message payloads to typed series: one projection per message type.

Offsets and resolutions are the public ones of the message dictionary; a field that is missing or
marked "not available" is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions.bits import bits, payload_hex
from fairlead.operators.stats import warning_names
from fairlead.params import KELVIN_TO_CELSIUS

COMMON = ["boat_id", "clock_epoch", "file_no", "seq", "source", "time_us"]


def _of(frames: DataFrame, pgn: int) -> DataFrame:
    return frames.where(F.col("pgn") == pgn).withColumn("_h", payload_hex(F.col("data")))


def _u(offset: int, width: int) -> Column:
    return bits(F.col("_h"), offset, width, False)


def _s(offset: int, width: int) -> Column:
    return bits(F.col("_h"), offset, width, True)


def _degrees(raw: Column) -> Column:
    return F.degrees(raw * 1e-4)


def _out(df: DataFrame, **columns: Column) -> DataFrame:
    common = [c for c in COMMON if c in df.columns]
    return df.select(*common, *[e.alias(n) for n, e in columns.items()])


def position(frames: DataFrame) -> DataFrame:
    df = _out(_of(frames, 129025), lat=_s(0, 32) * 1e-7, lon=_s(32, 32) * 1e-7)
    return df.where("lat IS NOT NULL AND lon IS NOT NULL")


def speed_over_ground(frames: DataFrame) -> DataFrame:
    df = _out(_of(frames, 129026), sog_ms=_u(32, 16) * 0.01, cog_deg=_degrees(_u(16, 16)))
    return df.where("sog_ms IS NOT NULL")


def engine_rapid(frames: DataFrame) -> DataFrame:
    return _out(_of(frames, 127488), instance=_u(0, 8).cast("int"), rpm=_u(8, 16) * 0.25).where("instance IS NOT NULL")


def engine_dynamic(frames: DataFrame) -> DataFrame:
    df = _out(
        _of(frames, 127489),
        instance=_u(0, 8).cast("int"),
        fuel_rate_lph=_s(72, 16) * 0.1,
        total_hours_s=_u(88, 32),
        oil_pressure_pa=_u(8, 16) * 100.0,
        oil_temperature_k=_u(24, 16) * 0.1,
        coolant_temperature_k=_u(40, 16) * 0.01,
        alternator_voltage_v=_s(56, 16) * 0.01,
        engine_load_pct=_s(192, 8).cast("double"),
        status1=F.coalesce(_u(160, 16), F.lit(0)),
        status2=F.coalesce(_u(176, 16), F.lit(0)),
    )
    return df.where("instance IS NOT NULL")


def with_warnings(engine: DataFrame) -> DataFrame:
    return engine.withColumn("warnings", warning_names(F.col("status1"), F.col("status2")))


def trip_fuel(frames: DataFrame) -> DataFrame:
    df = _out(_of(frames, 127497), instance=_u(0, 8).cast("int"), trip_fuel_used_l=_u(8, 16).cast("double"))
    return df.where("instance IS NOT NULL")


def depth(frames: DataFrame) -> DataFrame:
    offset = _s(40, 16)
    surface = _u(8, 32) * 0.01 + F.when(offset > 0, offset * 0.001).otherwise(0.0)
    return _out(_of(frames, 128267), depth_m=surface).where("depth_m IS NOT NULL")


def _temperature(frames: DataFrame, place: int) -> DataFrame:
    df = _of(frames, 130312).where(_u(16, 8) == place)
    return _out(df, temp_c=_u(24, 16) * 0.01 - KELVIN_TO_CELSIUS).where("temp_c IS NOT NULL")


def water_temperature(frames: DataFrame) -> DataFrame:
    return _temperature(frames, 0)


def outside_temperature(frames: DataFrame) -> DataFrame:
    return _temperature(frames, 1)


def humidity(frames: DataFrame) -> DataFrame:
    df = _of(frames, 130313).where(_u(16, 8) == 1)
    return _out(df, humidity_pct=_s(24, 16) * 0.004).where("humidity_pct IS NOT NULL")


def wind(frames: DataFrame) -> DataFrame:
    df = _out(_of(frames, 130306), speed_ms=_u(8, 16) * 0.01, angle_deg=_degrees(_u(24, 16)), reference=_u(40, 3).cast("int"))
    return df.where("speed_ms IS NOT NULL OR angle_deg IS NOT NULL")


def speed_through_water(frames: DataFrame) -> DataFrame:
    return _out(_of(frames, 128259), stw_ms=_u(8, 16) * 0.01).where("stw_ms IS NOT NULL")


def battery(frames: DataFrame) -> DataFrame:
    return _out(_of(frames, 127508), instance=_u(0, 8).cast("int"), voltage_v=_s(8, 16) * 0.01).where("instance IS NOT NULL")


def attitude(frames: DataFrame) -> DataFrame:
    df = _out(
        _of(frames, 127257), pitch_deg=_degrees(_s(24, 16)).cast("float"), roll_deg=_degrees(_s(40, 16)).cast("float")
    )
    return df.where("pitch_deg IS NOT NULL OR roll_deg IS NOT NULL")


def gnss_dops(frames: DataFrame) -> DataFrame:
    df = _of(frames, 129539).where(F.length("data") >= 4)
    return _out(df, actual_mode=_u(11, 3).cast("int"), hdop=_s(16, 16) * 0.01)


# Series name -> decoder; messages of one type may feed two series.
DECODERS = {
    "fixes": position,
    "sog": speed_over_ground,
    "engine": engine_dynamic,
    "rpm": engine_rapid,
    "trip_fuel": trip_fuel,
    "depth": depth,
    "water_temp": water_temperature,
    "outside_temp": outside_temperature,
    "humidity": humidity,
    "wind": wind,
    "stw": speed_through_water,
    "battery": battery,
    "attitude": attitude,
    "dops": gnss_dops,
}


def decode_all(frames: DataFrame) -> dict[str, DataFrame]:
    """All series. Each is a filter on ``pgn`` and a projection; land the frames partitioned or
    clustered by ``pgn`` and every branch reads only its own part."""
    return {name: fn(frames) for name, fn in DECODERS.items()}
