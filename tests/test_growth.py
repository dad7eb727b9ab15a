"""Steps that have to grow in proportion with their input."""

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from fairlead.operators import archive, quality, runs
from fairlead.operators.scan import JIT_BYTES, scan
from fairlead.operators.frames import SYSTEM_TIME
from fairlead.sources.ebl import FILE_RECORDS
from fairlead.streaming.decode import Stamper
from fairlead.workload import output, registry


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_names_taken_many_times_get_the_free_numbers(spark):
    """4,000 files of one name, every third number taken, among them gaps, zeros and names of other years."""
    used = sorted({*range(3, 3000, 3), 1, 2, 5000})
    staged = spark.range(4000).select(
        F.lit("in").alias("folder"), F.lit("a.ebl").alias("file_name"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("sha1"),
        F.lit(1_750_000_000_000_000).alias("first_us"), F.col("id").alias("entry_no"),
    )
    rows = [("2025", "x", "a.ebl", "old"), ("2025", "x", "a-0.ebl", "z"), ("2024", "x", "a-4.ebl", "z"), ("2025", "x", "a-007.ebl", "z")]
    held = spark.createDataFrame(rows + [("2025", "x", f"a-{n}.ebl", "z") for n in used], "year string, folder string, file_name string, sha1 string")
    plan = archive.import_plan(staged, held)
    assert "array_contains" not in _plan(plan)  # a list of all numbers per row
    got = [r["target"] for r in plan.orderBy("entry_no").collect()]
    taken, free, n = {*used, 7}, [], 0
    while len(free) < 4000:
        n += 1
        if n not in taken:
            free.append(f"2025/a-{n}.ebl")
    assert got == free


def _engine_runs(spark):
    runs_ = spark.createDataFrame([(1, 0, k, 100 * k, 100 * k + 60) for k in range(1, 30)], "boat_id int, clock_epoch int, run_stop bigint, t0 bigint, t1 bigint")
    spans = [(130, 160), (160, 200), (305, 333), (460, 460), (1000, 1400), (2899, 2900)]
    return runs_, spans, spark.createDataFrame([(1, 0, a, b) for a, b in spans], "boat_id int, clock_epoch int, on_start bigint, on_end bigint")


def test_engine_off_spans_look_ahead_once(spark):
    table, spans, intervals = _engine_runs(spark)
    df = runs.engine_off_spans(table, intervals)
    assert "currentrow$(), unboundedfollowing$()" not in _plan(df)
    for r in df.collect():
        assert r["off_start"] == max([b for _, b in spans if b <= r["t0"]], default=r["t0"])
        assert r["off_end"] == min([a for a, _ in spans if a >= r["t1"]], default=None)


def test_scan_looks_ahead_once(spark):
    values = [None if k % 7 else k for k in range(200)]
    df = spark.createDataFrame([(1, k // 30, k, v) for k, v in enumerate(values)], "boat int, slice bigint, t bigint, v bigint")
    out = scan(df, ["boat"], "slice", ["t"], bfill={"at": F.col("v")}, bfill_after={"later": F.col("v")})
    assert "unboundedfollowing" not in _plan(out)
    for r in out.collect():
        k = r["t"]
        assert r["at"] == next((v for v in values[k:] if v is not None), None)
        assert r["later"] == next((v for v in values[k + 1 :] if v is not None), None)


def test_gnss_gate_looks_ahead_once(spark):
    fixes = spark.createDataFrame([(1, 0, 11, k) for k in range(0, 100, 2)], "boat_id int, file_no bigint, source int, seq bigint")
    marks = {k: (3 if k % 12 else 7) for k in range(1, 90, 8)}
    dops = spark.createDataFrame([(1, 0, 11, k, None if m == 7 else m, 99.0 if k % 3 == 0 else 1.0) for k, m in marks.items()], "boat_id int, file_no bigint, source int, seq bigint, actual_mode int, hdop double")
    df = quality.gnss_gate(fixes, dops)
    assert "unboundedfollowing" not in _plan(df)
    usable = {k: k % 3 != 0 and m != 7 for k, m in marks.items()}
    for r in df.collect():
        before = [usable[k] for k in marks if k < r["seq"]][-1:]
        after = [usable[k] for k in marks if k > r["seq"]][:1]
        assert r["accepted"] == all(before + after)


def test_events_are_landed_in_methods_the_jvm_compiles(spark, tmp_path, monkeypatch):
    """One method for all columns of the telemetry view has over 12,000 bytes, which stays interpreted."""
    rows = [(k, k % 7, kind) for k, kind in enumerate(["view", "click", "purchase", "signup", "error", None] * 20)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    name, seen, settle = "spark.sql.codegen.hugeMethodLimit", [], registry.settle
    before = spark.conf.get(name)
    monkeypatch.setattr(registry, "settle", lambda df: seen.append(spark.conf.get(name)) or settle(df))
    assert registry.landed(spark, str(tmp_path)).count() == len(rows)
    assert seen == [str(JIT_BYTES)] and spark.conf.get(name) == before


def test_a_trigger_of_one_file_is_landed_by_many_tasks(spark, tmp_path):
    """1.5 million events, a few without a number: a file per third, but no third in one row group, so in one task."""
    kinds = F.element_at(F.array(*map(F.lit, ["view", "click", "purchase"])), F.expr("cast(id * 7 % 3 + 1 as int)"))
    events = spark.range(1_500_000).select(F.expr("CASE WHEN id > 4 THEN id - 5 END").alias("event_id"), F.expr("id * 31 % 90000").alias("user_id"), kinds.alias("event_type"))
    output._write_thirds(events, f"{tmp_path}/in")
    for k in range(3):
        (path,) = tmp_path.glob(f"in/{k}/*.parquet")
        assert pq.ParquetFile(path).num_row_groups > 1
    back = spark.read.parquet(*[f"{tmp_path}/in/{k}" for k in range(3)])
    assert back.exceptAll(events).isEmpty() and back.count() == 1_499_995


class _Held:
    """The state variables of one key, in memory."""

    def __init__(self):
        self.value, self.entries = None, {}

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    update = lambda self, v: setattr(self, "value", v)
    iterator = lambda self: iter(list(self.entries.items()))
    getValue = lambda self, k: self.entries[k]  # noqa: E731, N815
    updateValue = lambda self, k, v: self.entries.update({k: v})  # noqa: E731, N815
    removeKey = lambda self, k: self.entries.pop(k)  # noqa: E731, N815


class _Handle:
    getValueState = getMapState = lambda self, *_: _Held()  # noqa: E731, N815


def test_messages_of_many_small_files_come_out_together(spark):
    """300 files of three frames, in two batches out of order: each file is a slice, but no output of its own."""
    tick = (20000).to_bytes(2, "little").rjust(4, b"\0") + bytes(4)
    frames = [(1, f, f * FILE_RECORDS + 10 * i, 10, 255, 3, SYSTEM_TIME if i == 0 else 129025, tick if i == 0 else bytes([f % 256] * 8)) for f in range(300) for i in range(3)]
    rows = pd.DataFrame(frames, columns=["boat_id", "file_no", "seq", "source", "destination", "priority", "pgn", "data"])
    stamper = Stamper()
    stamper.init(_Handle())
    out = list(stamper.handleInputRows((1,), iter([rows[1::2], rows[::2]]), None))
    assert len(out) == 1
    want = rows[rows["pgn"] != SYSTEM_TIME]
    assert out[0]["seq"].tolist() == want["seq"].tolist() and out[0]["data"].tolist() == want["data"].tolist()
    assert set(out[0]["time_us"]) == {20000 * 86_400_000_000}
