import pytest
import random

from pyspark.sql import functions as F

from fairlead.operators import frames as fr
from fairlead.operators import quality
from fairlead.sources import ebl

BODY = bytes.fromhex("07950e289a0001f8093d0db3224832590d")


def wrap(body: bytes) -> bytes:
    return b"\x1b\x01" + body.replace(b"\x1b", b"\x1b\x1b") + b"\x1b\n"


def by_byte(data: bytes) -> list[bytes]:
    """The framing rule one byte at a time."""
    out, reading, buf, i = [], False, bytearray(), 0
    while i < len(data):
        if not reading:
            if data[i : i + 2] == b"\x1b\x01":
                reading, buf, i = True, bytearray(), i + 2
            else:
                i += 1
        elif data[i] != 0x1B:
            buf.append(data[i])
            i += 1
        else:
            if i + 1 >= len(data):
                return out
            after = data[i + 1]
            i += 2
            if after == 0x1B:
                buf.append(0x1B)
            else:
                if after == 0x0A and len(buf) > 4:
                    out.append(bytes(buf))
                reading = False
    return out


def test_random_streams_match_the_byte_rule():
    rng = random.Random(3)
    alphabet = [0x1B, 0x1B, 0x1B, 1, 10, 7, 0x95, 0, 0x41, 0xFF]
    for _ in range(5000):
        data = bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert list(ebl.record_bodies(data)) == by_byte(data), data


def test_filter_is_the_same_as_filtering_afterwards():
    position, other = BODY, bytes.fromhex("07950e289a0002f8093d0db3224832590d")
    data = wrap(position) + wrap(other) + wrap(position)
    assert list(ebl.record_bodies(data, frozenset({129025}))) == [position, position]


def test_files_to_frames(spark, tmp_path):
    folder = tmp_path / "boat=3" / "EBL000012"
    folder.mkdir(parents=True)
    (folder / "000012_007.ebl").write_bytes(b"junk" + wrap(BODY) + wrap(BODY[:-1]) + wrap(BODY) + b"\x1b\x01unfinished")
    df = fr.parse_records(ebl.read_ebl(spark, str(tmp_path)))
    rows = df.withColumn("data", F.hex("data")).orderBy("seq").collect()
    assert [(r.boat_id, r.file_no, r.seq) for r in rows] == [(3, 0, 0), (3, 0, 2)]
    r = rows[0]
    assert (r.priority, r.pgn, r.source, r.destination, r.data) == (2, 129025, 0, 255, "3D0DB3224832590D")


def test_files_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "000000_000.ebl").write_bytes(wrap(BODY) * 3)
    stream = ebl.stream_ebl(spark, str(tmp_path / "in"), [129025], boat=0)
    q = stream.writeStream.format("memory").queryName("framed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("framed").count() == 3


def test_files_are_numbered_by_path_and_records_by_arrival(spark, tmp_path):
    """Renamed folders, loose files and the same number in two years: every file stays a file of its own."""
    names = ["2025/EBL000012-ab12cd34/000012_007.ebl", "2025/EBL000012/000012_008-1.ebl", "2025/log7-1.ebl", "2025/log7.ebl", "2026/EBL000012/000012_007.ebl"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(wrap(BODY) * 2)
    rows = ebl.read_ebl(spark, str(tmp_path), boat=4).orderBy("seq").collect()
    want = sorted(str(tmp_path / n) for n in names)
    assert [(r.boat_id, r.path.removeprefix("file:"), r.file_no, r.seq % ebl.FILE_RECORDS) for r in rows] == [(4, p, i, k) for i, p in enumerate(want) for k in (0, 1)]
    assert len({r.seq for r in rows}) == 10


def test_a_path_without_boat_is_refused(spark, tmp_path):
    (tmp_path / "000000_000.ebl").write_bytes(wrap(BODY))
    with pytest.raises(Exception, match="no boat=N/ in the path"):
        ebl.read_ebl(spark, str(tmp_path)).collect()


def test_a_step_back_in_one_file_drops_one_row(spark, tmp_path):
    """Arrival numbers of three files in order: the step back in the first one costs its one row only."""
    for i in range(3):
        (tmp_path / f"log{i}.ebl").write_bytes(wrap(BODY) * 10)
    arrived = ebl.read_ebl(spark, str(tmp_path), boat=1).withColumn("k", F.col("seq") % ebl.FILE_RECORDS)
    timed = arrived.withColumn("time_us", (F.col("file_no") * 100 + F.col("k") * 10 - F.when((F.col("file_no") == 0) & (F.col("k") == 5), 15).otherwise(0)) * 1_000_000)
    kept = quality.drop_time_regressions(timed, ["boat_id"], "file_no")
    assert kept.count() == 29
