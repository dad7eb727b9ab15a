import struct

import pytest

from fairlead.operators import decode


def frame(spark, pgn, *payloads):
    rows = [(1, 0, 0, i, 5, 1000 + i, pgn, bytearray(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "boat_id int, clock_epoch int, file_no bigint, seq bigint, source int, time_us bigint, pgn int, data binary")


def test_engine_dynamic_full_and_missing(spark):
    full = struct.pack("<BHHHhhIHHBHHbb", 0, 4500, 3700, 35900, 1420, 82, 3600 * 1234, 0, 0, 0, 0b101, 0x80, 45, 0)
    none = struct.pack("<BHHHhhIHHBHHbb", 1, 0xFFFF, 0xFFFF, 0xFFFF, 0x7FFF, 0x7FFF, 0xFFFFFFFF, 0, 0, 0, 0xFFFF, 0xFFFF, 0x7F, 0)
    a, b, = decode.with_warnings(decode.engine_dynamic(frame(spark, 127489, full, none))).orderBy("seq").collect()
    assert a.fuel_rate_lph == pytest.approx(8.2) and a.total_hours_s == 3600 * 1234 and a.oil_pressure_pa == 450000.0
    assert a.coolant_temperature_k == pytest.approx(359.0) and a.alternator_voltage_v == pytest.approx(14.2) and a.engine_load_pct == 45.0
    assert a.warnings == ["Check Engine", "Engine Shutting Down", "Low Oil Pressure"]
    assert b.instance == 1 and b.warnings == []
    assert [b[c] for c in ("fuel_rate_lph", "total_hours_s", "oil_pressure_pa", "oil_temperature_k", "alternator_voltage_v", "engine_load_pct")] == [None] * 6


def test_negative_position_and_short_payload(spark):
    whole = struct.pack("<ii", -331234567, 1512345678)
    rows = decode.position(frame(spark, 129025, whole, whole[:7], struct.pack("<ii", 0x7FFFFFFF, 5))).collect()
    assert len(rows) == 1
    assert rows[0].lat == pytest.approx(-33.1234567) and rows[0].lon == pytest.approx(151.2345678)


def test_depth_adds_only_a_positive_offset(spark):
    make = lambda off: struct.pack("<BIhB", 0, 1234, off, 0xFF)
    rows = decode.depth(frame(spark, 128267, make(500), make(-400), make(0x7FFF))).orderBy("seq").collect()
    assert [r.depth_m for r in rows] == pytest.approx([12.84, 12.34, 12.34])


def test_bit_fields_inside_bytes(spark):
    row = decode.gnss_dops(frame(spark, 129539, bytes([0xFF, 0b00010000, 0x78, 0x00, 0, 0]))).collect()[0]
    assert (row.actual_mode, row.hdop) == (2, pytest.approx(1.2))
    assert decode.gnss_dops(frame(spark, 129539, b"\xff\x10\x78")).count() == 0
