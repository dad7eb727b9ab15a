"""The ``ebl`` source in ranges and triggers, and stateful decoding: one or many, the result is the same."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from fairlead.operators import decode
from fairlead.operators import frames as fr
from fairlead.sources import ebl, ebl_source
from fairlead.sources.ebl_source import Range, border, complete_end, cut, list_files, read_ranges
from fairlead.streaming import decode as sd
from test_files_to_trips import engine, files, system_time, wrap


def by_ranges(folder, data, size, begin=0, limit=None):
    path = folder / "f.ebl"
    path.write_bytes(data)
    ranges = list(cut(1, str(path), 0, begin, len(data) if limit is None else limit, size))
    return [(r["seq"], r["pgn"], r["data"]) for b in read_ranges(ranges, str(folder), None) for r in b.to_pylist()]


def whole(data):
    at, fields, payloads = ebl_source.frames_of(data, 0, None)
    return list(zip(at.tolist(), fields["pgn"].tolist(), payloads))


def noisy(rng, n):
    """Records with many escapes, cut ones and noise between them."""
    out = b""
    for _ in range(n):
        kind = rng.random()
        data = bytes(rng.choice([0x1B, 0x1B, 0x0A, 0x01, 0x41, 0xFF]) for _ in range(rng.randint(0, 12)))
        record = wrap(129025, rng.randint(0, 3), data)
        if kind < 0.6:
            out += record
        elif kind < 0.8:
            out += record[: rng.randint(0, len(record))]
        else:
            out += bytes(rng.choice([0x1B, 0x0A, 0x01, 0x07, 0x95]) for _ in range(rng.randint(0, 9)))
    return out


def test_ranges_of_any_size_give_the_whole_file(tmp_path):
    rng = random.Random(11)
    for _ in range(150):
        data = noisy(rng, rng.randint(0, 25))
        want = whole(data)
        # The fields of parse_records over the plain framing rule.
        assert [d for _, _, d in want] == [b[9:] for b in ebl.record_bodies(data) if len(b) >= 10 and b[:2] == b"\x07\x95" and b[2] == len(b) - 3]
        for size in (1, 3, 17, 64, 1000):
            assert by_ranges(tmp_path, data, size) == want, (data, size)


def test_a_growing_file_is_read_up_to_its_last_complete_record(tmp_path, monkeypatch):
    monkeypatch.setattr(ebl_source, "PEEK_BYTES", 16)
    rng = random.Random(12)
    path = tmp_path / "f.ebl"
    for _ in range(150):
        data = noisy(rng, 20)
        got, done = [], 0
        while done < len(data):
            shown = rng.randint(done, len(data))
            path.write_bytes(data[:shown])
            store, _ = ebl_source.filesystem(str(path))
            with store.open_input_file(str(path)) as file:
                end = complete_end(file, done, shown)
            if end > done:
                got += by_ranges(tmp_path, data[:shown], 7, done, end)
            done = end
            if shown == len(data):
                got += by_ranges(tmp_path, data, 7, done)
                break
        assert got == whole(data)


def test_border_is_found_across_peeks(tmp_path, monkeypatch):
    monkeypatch.setattr(ebl_source, "PEEK_BYTES", 5)
    path = tmp_path / "f.ebl"
    path.write_bytes(b"x" * 20 + b"\x1b\x1b\n" + b"y" * 7 + b"\x1b\nz")
    store, _ = ebl_source.filesystem(str(path))
    with store.open_input_file(str(path)) as file:
        assert [border(file, p, 33) for p in (0, 1, 22, 23, 32, 33)] == [0, 32, 32, 32, 32, 33]


NAMES = ["2025/EBL000012-ab12/000012_007.ebl", "2026/EBL000000/000000_000.ebl", "2026/EBL000000/000000_001-1.ebl", "2026/late.ebl"]


def land(root, boat, content, names=NAMES):
    for name, data in zip(names, content):
        path = root / f"boat={boat}" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


def batch_messages(spark, root):
    """What the batch operators make of all files."""
    ebl_source.register(spark)
    frames = spark.read.format("ebl").option("rangeBytes", 3000).load(str(root))
    messages = fr.messages(fr.keep_pgns(frames))
    return fr.stamp(messages, fr.elect_clock(fr.system_times(messages)))


COLUMNS = ["boat_id", "file_no", "seq", "source", "destination", "priority", "pgn", "time_us", "data"]


def rows(df):
    return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*COLUMNS).collect())


def stream(spark, root, folder, steps=(lambda: None,), **options):
    """All messages a stream gives, as the archive changes by ``steps``; and how many triggers had rows."""
    ebl_source.register(spark)
    pgns = ",".join(map(str, fr.WANTED_PGNS))
    frames = spark.readStream.format("ebl").option("pgns", pgns).options(**options).load(str(root))
    sizes = []

    def write(batch, i):
        batch.write.mode("append").parquet(f"{folder}/out")
        sizes.append(i)

    for step in steps:
        step()
        q = sd.stamped(frames).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    return spark.read.parquet(f"{folder}/out"), len(sizes)


def test_batch_filter_is_pushed_into_the_scan(spark, tmp_path, capsys):
    land(tmp_path, 2, files())
    ebl_source.register(spark)
    df = spark.read.format("ebl").option("pushdown", "true").load(str(tmp_path)).where("pgn IN (129025, 126992)")
    df.explain()
    assert "- Filter" not in capsys.readouterr().out
    parsed = fr.parse_records(ebl.read_ebl(spark, str(tmp_path), pgns=[129025]))
    fields = ["boat_id", "file_no", "priority", "pgn", "source", "destination", "data"]
    assert df.select(*fields).exceptAll(parsed.select(*fields)).count() == 0 and df.count() == parsed.count()
    reader = ebl_source.EblReader({"path": str(tmp_path), "pushdown": "true"})
    assert list(reader.pushFilters([ebl_source.In(("pgn",), (129025, 1)), ebl_source.EqualTo(("pgn",), 129025)])) == [] and reader.wanted == {129025}


def test_one_table_read_in_several_places(spark, tmp_path):
    land(tmp_path, 2, files())
    ebl_source.register(spark)
    df = spark.read.format("ebl").load(str(tmp_path))
    a, b = df.where("pgn = 126992"), df.where("pgn = 129025")
    assert a.unionByName(b).count() == a.count() + b.count() and a.count() != b.count()


def test_many_small_triggers_equal_the_batch(spark, tmp_path):
    land(tmp_path / "in", 2, files())
    land(tmp_path / "in", 3, files()[1:])
    want = rows(batch_messages(spark, tmp_path / "in"))
    out, triggers = stream(spark, tmp_path / "in", tmp_path, boatBytesPerTrigger=9001, rangeBytes=1000, partitionBytes=4000, progress=f"file://{tmp_path}/progress")
    assert rows(out) == want and triggers > 8
    assert {r["boat_id"] for r in out.select("boat_id").distinct().collect()} == {2, 3}
    series = decode.decode_all(out.withColumn("clock_epoch", F.lit(0)))
    assert series["engine"].count() > 500 and series["fixes"].count() > 500


def test_growing_files_and_restarts_equal_the_batch(spark, tmp_path):
    """Files that grow by pieces and come one after another, with the stream stopped and started in between."""
    content = files()
    root = tmp_path / "in" / "boat=2"
    steps = []
    for name, data in zip(NAMES, content):
        for share in (0.3, 0.61, 1.0):
            def step(name=name, data=data, share=share):
                (root / name).parent.mkdir(parents=True, exist_ok=True)
                (root / name).write_bytes(data[: int(len(data) * share)])
            steps.append(step)
    out, triggers = stream(spark, tmp_path / "in", tmp_path, steps, boatBytesPerTrigger=20_000, progress=str(tmp_path / "progress"))
    assert rows(out) == rows(batch_messages(spark, tmp_path / "in")) and triggers >= 12


def test_a_message_open_between_triggers(spark, tmp_path):
    """A multi-frame message whose frames come in two triggers is whole; one cut by the end of a file is not."""
    head = system_time(10, 1784102400)
    first, second = engine(1, 80), engine(2, 90)
    (tmp_path / "in").mkdir()
    one, two = tmp_path / "in" / "a.ebl", tmp_path / "in" / "b.ebl"
    steps = [lambda: one.write_bytes(head + b"".join(first[:2])), lambda: one.write_bytes(head + b"".join(first + second[:1])), lambda: two.write_bytes(b"".join(second[1:]) + b"".join(first))]
    out, _ = stream(spark, tmp_path / "in", tmp_path, steps, boat=7)
    got = rows(out)
    assert [(r[1], struct.unpack_from("<h", r[8], 9)[0]) for r in got] == [(0, 80), (1, 80)]
    assert {r[7] for r in got} == {1784102400 * 10**6}


def test_a_late_file_stops_the_stream(spark, tmp_path):
    land(tmp_path / "in", 2, files()[:2], ["b.ebl", "c.ebl"])
    steps = [lambda: None, lambda: land(tmp_path / "in", 2, files()[2:3], ["a.ebl"])]
    with pytest.raises(Exception, match="came after it was read"):
        stream(spark, tmp_path / "in", tmp_path / "x", steps)
    out, _ = stream(spark, tmp_path / "in", tmp_path / "y", [lambda: (tmp_path / "in/boat=2/a.ebl").unlink(), steps[1]], late="skip")
    assert {r["file_no"] for r in out.select("file_no").distinct().collect()} == {0, 1}


def test_progress_of_another_stream_is_refused(tmp_path):
    reader = ebl_source.EblStreamReader({"path": str(tmp_path), "progress": str(tmp_path / "p")})
    assert reader.latestOffset() == {}
    with pytest.raises(ValueError, match="progress"):
        reader.partitions({"1": ["b.ebl", 3, 2]}, {"1": ["a.ebl", 9, 1]})


def test_a_backlog_is_put_in_order_slice_by_slice(spark, tmp_path, monkeypatch):
    """All files in one trigger, shuffled in many small batches."""
    land(tmp_path / "in", 2, files())
    want = rows(batch_messages(spark, tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    monkeypatch.setattr(sd, "SLICE_BYTES", 5000)
    try:
        out, triggers = stream(spark, tmp_path / "in", tmp_path, rangeBytes=2000, partitionBytes=5000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert triggers <= 2 and rows(out) == want


def test_files_by_boat(tmp_path):
    land(tmp_path, 12, [b"1", b"2"], ["x/b.ebl", "x/a.ebl"])
    (tmp_path / "loose.ebl").write_bytes(b"")
    assert [f.path.rsplit("/", 1)[1] for f in list_files(f"file://{tmp_path}", 5)[12]] == ["a.ebl", "b.ebl"]
    with pytest.raises(ValueError, match="no boat"):
        list_files(str(tmp_path), None)
    assert Range(1, "p", 0, 0, 1, 1, True).exact
