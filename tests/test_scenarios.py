"""Voyages with known outcome: every scenario is one boat of one build."""

import pytest
from pyspark.sql import functions as F

from fairlead.functions.ids import uuid5
from fairlead.operators import rows
from fairlead.params import US, TripParams
from fairlead.plans.trips import Season
from fairlead.sinks import logbook as sink
from fairlead.operators.logbook import marked_track

START = 1784102400  # 2026-07-15 08:00 UTC
MIN = 60 * US
A, B = (52.30, 4.90), (52.40, 4.95)


def at(minute):
    return START * US + int(minute * MIN)


def rest(minutes, place, sog=0.0):
    return [(m, *place, sog) for m in minutes]


def sail(minutes, a=A, b=B, sog=3.0):
    n = len(minutes)
    return [(m, a[0] + (b[0] - a[0]) * (i + 1) / n, a[1] + (b[1] - a[1]) * (i + 1) / n, sog) for i, m in enumerate(minutes)]


LEG = rest(range(0, 12), A) + sail(range(12, 42))
NEAR = (B[0] + 0.0006, B[1] + 0.0003)
SWING = [(m, B[0] + (0.0002 if m % 2 else -0.0002), B[1], 0.0) for m in range(42, 78)]  # too wide for a lock
LOCK = rest(range(0, 11), A) + sail(range(11, 21), A, (52.33, 4.92)) + rest(range(21, 41), (52.33, 4.92)) + sail(range(41, 56), (52.33, 4.92), B) + rest(range(56, 67), B)
SCENARIOS = {
    1: LEG + rest(range(42, 54), B),
    2: LEG + rest(range(180, 192), B),
    3: rest(range(0, 12), A) + sail(range(100, 130)) + rest(range(130, 142), B),
    4: LEG + SWING + [(78, B[0] + 0.0003, B[1], 0.6), (79, *NEAR, 0.6)] + rest(range(80, 104), NEAR),
    5: LOCK,
    6: LEG,
}
ENGINE = {
    1: [(m, 8.0 if 12 <= m < 42 else 0.2) for m in range(0, 54)],
    5: [(m, 0.0 if 21 <= m < 40 else 8.0) for m in range(11, 57)],
}


@pytest.fixture(scope="module")
def season(spark):
    fixes = [(b, 0, 0, i, 1, at(m), la, lo) for b, s in SCENARIOS.items() for i, (m, la, lo, _) in enumerate(s)]
    sogs = [(b, 0, 0, i, 1, at(m), sog, 10.0) for b, s in SCENARIOS.items() for i, (m, _, _, sog) in enumerate(s)]
    eng = [(b, 0, 0, i, 1, at(m), 0, r, 1000 + m * 60, 3e5, 360.0, 355.0, 14.1, 50.0, 4 if m == 20 else 0, 0) for b, s in ENGINE.items() for i, (m, r) in enumerate(s)]
    common = "boat_id int, clock_epoch int, file_no bigint, seq bigint, source int, time_us bigint, "
    tables = {
        "fixes": spark.createDataFrame(fixes, common + "lat double, lon double"),
        "sog": spark.createDataFrame(sogs, common + "sog_ms double, cog_deg double"),
        "engine": spark.createDataFrame(
            eng, common + "instance int, fuel_rate_lph double, total_hours_s bigint, oil_pressure_pa double, oil_temperature_k double, coolant_temperature_k double, "
            "alternator_voltage_v double, engine_load_pct double, status1 bigint, status2 bigint"
        ),
    }
    return Season(tables, TripParams())


@pytest.fixture(scope="module")
def trips(season):
    out = {}
    for r in season.trips.collect():
        out.setdefault(r.boat_id, []).append(r)
    return out


def test_base_is_one_trip(trips):
    (t,) = trips[1]
    assert (t.depart_us, t.arrive_us) == (at(11), at(42))
    assert t.distance_nm == pytest.approx(6.27, abs=0.25) and t.max_speed_kn == pytest.approx(3.0 / 0.514444)


def test_gap_after_the_trip_ends_it_where_data_ended(trips):
    (t,) = trips[2]
    assert t.arrive_us == at(41) and (t.arrive_lat, t.arrive_lon) == pytest.approx(B)


def test_gap_before_the_trip_starts_it_where_data_resumes(trips):
    (t,) = trips[3]
    assert t.depart_us == at(100) and (t.depart_lat, t.depart_lon) == pytest.approx(A)


def test_short_move_along_the_quay_is_no_trip(trips):
    (t,) = trips[4]
    assert t.arrive_us == at(42) and t.p1.time_us == at(79)


def test_lock_is_part_of_the_trip(trips):
    (t,) = trips[5]
    assert (t.depart_us, t.arrive_us) == (at(10), at(56))


def test_open_end(trips):
    (t,) = trips[6]
    assert t.next_stay is None and t.arrive_unknown == "Unknown (end outside log file)" and t.arrive_us == at(41)


def test_boat_state(season):
    state = {r.boat_id: r for r in season.state.collect()}
    assert not state[1].underway and state[1].stationary_since_us == at(42) and state[1].engine_off_since_us == at(41)
    assert state[6].underway and state[6].stationary_since_us is None and state[6].engine_running is None


def test_figures_and_files(season, tmp_path):
    facts = rows.trip_facts(season).withColumn("depart_place", F.lit("A & B")).withColumn("arrive_place", F.lit("C"))
    for missing in ("fuel_liters_device", "roll_variation_deg", "pitch_variation_deg", "roll_range_deg", "pitch_range_deg"):
        facts = facts.withColumn(missing, F.lit(None).cast("double"))
    facts = facts.withColumn("typical_rpm", F.lit(None).cast("array<struct<instance:int,typical_rpm:bigint,n:bigint>>"))
    facts = facts.withColumn("battery_health", F.lit(None).cast("array<struct<instance:int,avg_voltage_v:double,min_voltage_v:double,min_voltage_us:bigint>>"))
    one = facts.where("boat_id = 1").collect()[0]
    # 29 minutes at 8 L/h, and half a minute's ramp on both sides.
    assert one.fuel_liters == pytest.approx(8 * 29 / 60 + 2 * 0.5 * 8.2 / 60, abs=1e-6)
    assert [w for x in one.engine_health for w in (x.warnings or [])] == ["Low Oil Pressure"]
    sink.write_csv(facts, str(tmp_path / "csv"), TripParams())
    back = season.trips.sparkSession.read.option("sep", ";").option("header", "true").csv(str(tmp_path / "csv"))
    row = back.where("boat_id = 1").collect()[0]
    assert (row.date, row.departure_time, row.arrival_time, row.warnings) == ("2026-07-15", "10:11", "10:42", "Low Oil Pressure")
    marked = marked_track(season.trips, season.track, season.params)
    sink.write_gpx(facts, marked, str(tmp_path / "gpx"), TripParams())
    (path,) = (tmp_path / "gpx" / "boat_id=1" / "trip_no=1").glob("*.txt")
    import xml.etree.ElementTree as ET

    tree = ET.fromstring(path.read_text().split("\n", 1)[1])
    points = [e for e in tree.iter() if e.tag.endswith("trkpt")]
    stamps = [e.text for e in tree.iter() if e.tag.endswith("time")]
    assert len(points) == 32 and stamps == sorted(stamps) and points[0].get("lat") == "52.3000000"


def test_uuid5(spark):
    import uuid

    ns, key = uuid.UUID("c6f6f5c0-2b8a-4b7a-9b2a-6f5c0c6f6f5c"), "2026-07-15|52.300,4.900|52.400,4.950|0"
    got = spark.range(1).select(uuid5(F.lit(key)).alias("u")).collect()[0].u
    assert got == str(uuid.uuid5(ns, key))


def test_tables_and_run_log_as_files(spark, tmp_path):
    from fairlead.sinks.logbook import write_tables
    from fairlead.sources.runlog import read_run_log

    trips = spark.createDataFrame([(1, 1, 2.5), (2, 1, 3.5)], "boat_id int, trip_no int, nm double")
    write_tables({"trips": trips}, f"{tmp_path}/book")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/book/trips").select(*trips.columns).collect())) == [(1, 1, 2.5), (2, 1, 3.5)]
    (tmp_path / "run.log").write_text("2026-01-02 03:04:05 [error] no answer\nno time here\n")
    assert [(r.severity, r.logged_at is None) for r in read_run_log(spark, f"{tmp_path}/run.log").collect()] == [("error", False), ("info", True)]


def test_a_local_folder_is_refused_on_a_cluster():
    import pytest
    from types import SimpleNamespace

    from fairlead.operators.scan import shared_folder

    conf = {"spark.sql.warehouse.dir": "file:/home/x/warehouse"}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_folder(session)
    conf["spark.checkpoint.dir"] = "hdfs://all/steps/"
    assert shared_folder(session) == "hdfs://all/steps"
