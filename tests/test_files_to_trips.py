"""From the bytes of several log files to trips: multi-frame messages, two clocks, faults; and resuming."""

import struct

import pytest
from pyspark.sql import functions as F

from fairlead.operators import frames as fr
from fairlead.params import US, TripParams
from fairlead.plans.trips import build_trips, decode_archive
from fairlead.sources.ebl import read_ebl

START, STEP = 1784102400, 20  # seconds
GPS, CLOCK_A, CLOCK_B = 11, 10, 12
REST, SAIL = 60, 90  # samples: 20 and 30 minutes
LEGS = 5
FILES = 4


def wrap(pgn, source, data):
    can_id = bytes([source, pgn & 0xFF, (pgn >> 8) & 0xFF, (3 << 2) | (pgn >> 16)])
    body = b"\x07\x95" + bytes([6 + len(data)]) + b"\0\0" + can_id + data
    return b"\x1b\x01" + body.replace(b"\x1b", b"\x1b\x1b") + b"\x1b\n"


def system_time(source, at, lag=0):
    days, seconds = divmod(at - lag, 86400)
    return wrap(126992, source, b"\x00\xf0" + struct.pack("<HI", days, seconds * 10000))


def engine(counter, rate):
    whole = struct.pack("<BHHHHhI5xHHBx", 0, 3000, 3600, 35000, 1400, rate, 1000, 0, 0, 50)
    parts = [bytes([counter << 5, len(whole)]) + whole[:6]]
    parts += [bytes([counter << 5 | i]) + whole[6 + 7 * (i - 1) : 6 + 7 * i].ljust(7, b"\xff") for i in range(1, 4)]
    return [wrap(127489, 5, p) for p in parts]


def cruise():
    """Samples (latitude, speed in m/s) of rests and legs to the north."""
    lat, out = 52.0, []
    for _ in range(LEGS):
        out += [(lat, 0.0)] * REST
        for _ in range(SAIL):
            lat += 0.0006
            out.append((lat, 3.3))
    return out + [(lat, 0.0)] * REST


def files():
    samples = cruise()
    content = [b""] * FILES
    for i, (lat, sog) in enumerate(samples):
        at = START + i * STEP
        lag = 40 if i == 200 else 0  # one reading steps back
        parts = [system_time(CLOCK_A, at, lag)] + ([system_time(CLOCK_B, at + 1)] if i % 3 == 0 else [])
        lost = 320 <= i < 325  # no fix while at rest, and positions to match
        parts.append(wrap(129539, GPS, b"\xff" + bytes([(7 if lost else 3) * 8]) + struct.pack("<H", 9900 if lost else 90) + b"\xff" * 4))
        shown = 0.0 if lost else lat + (1.0 if i in (100, 450) else 0.0)  # two jumps by sixty miles
        parts.append(wrap(129025, GPS, struct.pack("<ii", round(shown * 1e7), round(4.9 * 1e7))))
        parts.append(wrap(129026, GPS, b"\x00\xfc" + struct.pack("<HH", 0, round(sog * 100)) + b"\xff\xff"))
        parts += engine(i % 8, 80 if sog else 0)
        content[i * FILES // len(samples)] += b"".join(parts)
    return content


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")
    # Names as they come: folders of a year, renamed ones, loose files.
    names = ["2025/EBL000012-ab12/000012_007.ebl", "2026/EBL000000/000000_000.ebl", "2026/EBL000000/000000_001-1.ebl", "2026/late.ebl"]
    for name, data in zip(names, files()):
        path = root / "boat=2" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return fr.parse_records(read_ebl(spark, str(root), pgns=fr.WANTED_PGNS))


@pytest.fixture(scope="module")
def decoded(parsed):
    return decode_archive(parsed)


def test_five_trips_from_files(decoded):
    trips = build_trips(decoded, TripParams()).trips.orderBy("trip_no").collect()
    assert len(trips) == LEGS
    for k, t in enumerate(trips):
        left = START + (k * (REST + SAIL) + REST) * STEP
        assert abs(t.depart_us / US - left) <= 2 * STEP
        assert abs(t.arrive_us / US - (left + SAIL * STEP)) <= 2 * STEP
        assert t.distance_nm == pytest.approx(SAIL * 0.0006 * 60, rel=0.02)
        assert t.max_speed_kn == pytest.approx(3.3 / 0.514444, rel=0.01)


def test_multi_frame_messages_and_lost_fixes(decoded):
    n = len(cruise())
    assert decoded["engine"].count() == n
    assert decoded["fixes"].where("lat < 1").count() == 0


def test_decoding_from_a_file_on_gives_the_same_rows(parsed, decoded):
    clock = fr.elect_clock(fr.system_times(fr.messages(parsed)))
    states = fr.clock_state(clock)
    starts = parsed.select("boat_id", F.lit(2).cast("bigint").alias("file_no")).distinct()
    carried = fr.carried_clock(states, starts)
    later = fr.from_files(parsed, starts)
    again = decode_archive(later, carried)
    for name in ("fixes", "sog", "engine"):
        want, got = (df.select("seq", "time_us").orderBy("seq").collect() for df in (decoded[name].where("file_no >= 2"), again[name]))
        assert got == want and got, name
    columns = ["boat_id", "file_no", "leader", "last_us", F.array_sort(F.map_entries("source_counts")).alias("n")]
    resumed = fr.clock_state(fr.elect_clock(fr.system_times(fr.messages(later)), carried=carried), carried)
    assert resumed.select(*columns).orderBy("file_no").collect() == states.where("file_no >= 2").select(*columns).orderBy("file_no").collect()
