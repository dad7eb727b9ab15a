"""Parallel forms of sequential rules against the plain sequential rule, on random data."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fairlead.operators import frames as fr
from fairlead.operators import archive, quality, stepwise
from fairlead.operators.scan import cover, scan
from fairlead.params import US
from fairlead.plans.trips import with_clock_epochs

DAY = 86_400 * US


def test_scan_equals_a_plain_window(spark):
    rng = random.Random(5)
    # One key holds most rows; slices of very different size, some missing.
    rows = [(0 if rng.random() < 0.8 else 1, rng.choice([0, 1, 1, 1, 5, 9]), i, rng.choice([None, rng.randint(0, 99)])) for i in range(600)]
    rows = [(b, s, s * 1000 + i, v) for b, s, i, v in rows]
    df = spark.createDataFrame(rows, "b int, s int, n bigint, v int")
    v = F.col("v")
    got = scan(df, ["b"], "s", ["n"], prev={"p": v}, nxt={"x": v}, fill={"f": v}, bfill={"g": v}, fill_before={"fb": v}, bfill_after={"ga": v},
               running_sum={"r": F.coalesce(v, F.lit(0))}, max_before={"m": v})
    w = Window.partitionBy("b").orderBy("n")
    up, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    be, af = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    want = df.select(
        "*", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("x"), F.last("v", True).over(up).alias("f"), F.first("v", True).over(on).alias("g"),
        F.last("v", True).over(be).alias("fb"), F.first("v", True).over(af).alias("ga"), F.sum(F.coalesce(v, F.lit(0))).over(up).alias("r"), F.max("v").over(be).alias("m"),
    )
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def _regressions(times):
    kept, anchor = [], None
    for t in times:
        ok = anchor is None or t >= anchor or anchor - t >= DAY
        kept.append(ok)
        anchor = t if ok else anchor
    return kept


def test_time_regressions(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for boat in range(60):
        t, times = 100 * DAY, []
        for _ in range(30):
            t += rng.choice([0, 1, 5, 3600, -2, -3600, -DAY // US // 3, -DAY // US // 2, -DAY // US, -3 * DAY // US]) * US
            times.append(t)
        want.update({(boat, i): k for i, k in enumerate(_regressions(times))})
        rows += [(boat, i // 7, i, x) for i, x in enumerate(times)]
    df = spark.createDataFrame(rows, "boat_id int, file_no bigint, seq bigint, time_us bigint")
    got = {(r.boat_id, r.seq): r.kept for r in quality.time_regressions(df, ["boat_id"], "file_no").collect()}
    assert got == want


def test_gps_outliers(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for boat in range(25):
        t, lat, lon, anchor = 100 * DAY, 50.0, 4.0, None
        bad_for = 0
        for i in range(40):
            t += rng.choice([0, 1, 2, 10, 40, 400, -3, -2 * 86_400]) * US
            lat += rng.choice([0, 1e-5, 2e-5, 3e-4])
            bad_for = rng.randint(1, 12) if bad_for <= 0 and rng.random() < 0.1 else bad_for - 1
            fix = (t, lat + (0.5 if bad_for > 0 else 0), lon)
            sog = rng.choice([None, 0.1, 3.0])
            reason = quality._follow(anchor, fix, sog)
            want[(boat, i)] = reason
            anchor = fix if reason is None else anchor
            rows.append((boat, i // 6, i, *fix, sog))
    df = spark.createDataFrame(rows, "boat_id int, file_no bigint, seq bigint, time_us bigint, lat double, lon double, sog_ms double")
    got = {(r.boat_id, r.seq): r.reason for r in quality.gps_outliers(df).collect()}
    assert got == want


def test_two_clocks(spark):
    nine = 9 * 3600 * US
    times = [(10, nine), (10, nine + US), (11, nine + US // 2), (10, nine + 2 * US)]
    rows = [(0, 0, i * 2, s, t) for i, (s, t) in enumerate(times)]
    clock = fr.elect_clock(spark.createDataFrame(rows, "boat_id int, file_no bigint, seq bigint, source int, clock_us bigint"))
    marks = spark.createDataFrame([(0, 0, i, 3, 129025) for i in (3, 5, 7)], "boat_id int, file_no bigint, seq bigint, source int, pgn int")
    got = [r.time_us - nine for r in fr.stamp(marks, clock).orderBy("seq").collect()]
    assert got == [US, US, 2 * US]


def test_one_broken_message_does_not_spoil_the_next(spark):
    def frames(seq0, ctr, indexes):
        return [(0, 0, seq0 + k, 5, 127489, 255, 2, bytearray([ctr * 32 + i] + ([10] if i == 0 else []) + [65 + i] * (6 if i == 0 else 7))) for k, i in enumerate(indexes)]

    rows = frames(0, 1, [0, 1]) + frames(10, 2, [0]) + frames(20, 3, [0, 1, 2]) + frames(30, 4, [1]) + frames(40, 5, [0, 2])
    df = spark.createDataFrame(rows, "boat_id int, file_no bigint, seq bigint, source int, pgn int, destination int, priority int, data binary")
    got = sorted((r.seq, bytes(r.data)) for r in fr.reassemble(df).collect())
    assert got == [(1, b"AAAAAABBBB"), (21, b"AAAAAABBBB")]


@pytest.mark.parametrize("gap,parts", [(30, 1), (31, 2)])
def test_stretches(spark, gap, parts):
    df = spark.createDataFrame([(0, 0, 1, 0), (0, 3, 2, gap * US)], "boat_id int, file_no bigint, seq bigint, time_us bigint")
    assert quality.stretches(df, ["boat_id"], "file_no").count() == parts


def test_signature_follows_the_rules_only():
    from dataclasses import fields, replace

    from fairlead.params import TripParams

    base = TripParams()
    for f in fields(base):
        value = getattr(base, f.name)
        other = replace(base, **{f.name: (value or 0) + 1})
        assert (other.signature() == base.signature()) == (f.name == "chunk_hours")


def test_name_cache_keys_near_zero(spark):
    from fairlead.operators import places

    rows = [("1.23E-5,-0.00004", "a", 1), ("52.3004,4.9", "b", 2), ("x,1", "c", 3), ("1", "d", 4), ("NaN,1", "e", 5), ("0.0001,0", "f", 6)]
    got = places.rekey_cache(spark.createDataFrame(rows, "cell string, name string, entry_no int"))
    assert {r["cell"]: r["name"] for r in got.collect()} == {"0.0,0.0": "f", "52.3,4.9": "b"}


def test_landmark_across_the_date_line(spark):
    from fairlead.operators import places

    points = spark.createDataFrame([(1, 10.0, 179.9999), (2, 10.0, -179.9999), (3, 10.0, 0.0)], "id int, lat double, lon double")
    marks = spark.createDataFrame([(10.0, -179.9995, "L", "lock"), (10.0, 0.001, "I", "islet")], "lat double, lon double, name string, kind string")
    got = {r["id"]: r["landmark"] for r in places.nearest_landmark(points, marks, ["id"]).collect()}
    assert got == {1: "L", 2: "L", 3: "I"}


def test_steps_go_where_the_session_says_and_can_be_removed(spark):
    from fairlead.operators import scan

    df = scan.settle(spark.range(3))
    assert df.count() == 3
    folder = scan.steps_folder(spark)
    assert spark.sparkContext.applicationId in folder
    assert any(folder.removeprefix("file:") in f for f in df.inputFiles())


def test_a_wrong_position_with_a_wrong_time_is_no_clock_reset(spark):
    """20 positions at one place; the 11th is far away and 30 hours ahead: it goes, and no epoch begins."""
    from fairlead.plans.trips import accepted_resets, clean

    rows = [(0, 0, i, 5, 30 * 3600 * US if i == 10 else i * 60 * US, 10.0 if i == 10 else 52.3, 80.0 if i == 10 else 4.9) for i in range(20)]
    fixes = spark.createDataFrame(rows, "boat_id int, file_no bigint, seq bigint, source int, time_us bigint, lat double, lon double")
    sog = spark.createDataFrame([(0, 0, 100, 5, 0, 0.1, 0.0)], "boat_id int, file_no bigint, seq bigint, source int, time_us bigint, sog_ms double, cog_deg double")
    tables = {"fixes": fixes, "sog": sog}
    assert accepted_resets(tables).count() == 0
    got = clean(tables)["fixes"].collect()
    assert sorted(r.seq for r in got) == [i for i in range(20) if i != 10] and {r.clock_epoch for r in got} == {0}
    # A clock that really was set back is one.
    later = spark.createDataFrame([(0, 0, 50 + i, 5, (i - 3000) * 60 * US, 52.3, 4.9) for i in range(5)], fixes.schema)
    tables["fixes"] = fixes.unionByName(later)
    assert [r.seq for r in accepted_resets(tables).collect()] == [50]
    assert {r.seq: r.clock_epoch for r in clean(tables)["fixes"].collect()}[54] == 1


def test_a_jittery_clock_is_walked_like_row_by_row(spark):
    """Steps back and resets in any number, across files, against the plain walk."""
    rng = random.Random(17)
    day = 86_400_000_000
    rows, want = [], {}
    for boat in range(40):
        wild, t, anchor = rng.random(), 0, None
        for i in range(rng.randint(1, 260)):
            if rng.random() < wild:
                t = rng.choice([t - rng.randint(0, 3 * day), t + rng.randint(0, 2 * day), t - day, t + day - 1, t - day + 1])
            else:
                t += rng.randint(0, 10)
            rows.append((boat, i // rng.choice([1, 7, 50]) if boat % 2 else i // 90, i, t))
            reset = anchor is not None and anchor - t >= day
            kept = anchor is None or t >= anchor or reset
            anchor = t if kept else anchor
            want[boat, i] = kept, reset
    ordered, files = [], {}
    for boat, file_no, i, t in rows:  # files never go back
        files[boat] = max(files.get(boat, 0), file_no)
        ordered.append((boat, files[boat], i, t))
    df = spark.createDataFrame(ordered, "boat_id int, file_no bigint, seq bigint, time_us bigint").repartition(7)
    got = {(r.boat_id, r.seq): (r.kept, r.clock_reset) for r in quality.time_regressions(df, ["boat_id"], "file_no").collect()}
    assert got == want and any(reset for _, reset in want.values())


def test_functions_of_stretches_follow_each_other(spark):
    """Composed pieces give what one after the other gives, and stay few."""
    rng = random.Random(5)
    rows = [(k, i, rng.randint(0, 60), rng.randint(0, 60)) for k in range(60) for i in range(rng.randint(1, 12))]
    df = spark.createDataFrame(rows, "k int, no bigint, value bigint, top bigint").withColumn("f", stepwise.sets_outside(F.col("value"), F.col("top")))
    folded = df.groupBy("k").agg(stepwise._in_order("no", "f").alias("items")).select("k", stepwise._folded(F.col("items")).alias("f"))
    states = folded.select("k", "f", F.explode(F.sequence(F.lit(-2), F.lit(63))).alias("state"))
    got = {(r.k, r.state): (r.out, r.n) for r in states.select("k", "state", stepwise.apply(F.col("f"), F.col("state").cast("bigint")).alias("out"), F.size("f").alias("n")).collect()}
    for (k, state), (out, n) in got.items():
        x = state
        for _, _, value, top in (r for r in rows if r[0] == k):
            x = x if value < x < top else value
        assert out == x and n < 12


def test_epochs_of_files_with_several_resets(spark):
    resets = spark.createDataFrame([(1, 2, 25), (1, 2, 27), (1, 5, 50)], "boat_id int, file_no bigint, seq bigint")
    df = spark.createDataFrame([(b, i // 10, i) for b in (1, 2) for i in range(70)], "boat_id int, file_no bigint, seq bigint")
    got = {(r.boat_id, r.seq): r.clock_epoch for r in with_clock_epochs({"x": df}, resets)["x"].collect()}
    assert got == {(b, i): sum(i >= s for s in (25, 27, 50)) if b == 1 else 0 for b in (1, 2) for i in range(70)}


def test_files_of_trips_whatever_their_span(spark):
    """Overlap of spans against the plain rule; one file's clock jumps by decades."""
    rng = random.Random(23)
    hour = 3600 * US
    spans = lambda n: [(b, k, a, a + rng.choice([0, 1, hour, 30 * hour, 24 * 365 * hour])) for b in (1, 2) for k in range(n) for a in [rng.randint(-50, 500) * hour + rng.randint(0, 3)]]
    trips, files = spans(20), [*spans(40), (1, 99, -(10**6) * hour, 10**6 * hour)]
    t = spark.createDataFrame(trips, "boat_id int, trip_no int, depart_us bigint, arrive_us bigint")
    f = spark.createDataFrame(files, "boat_id int, file_no bigint, first_us bigint, last_us bigint").withColumn("source", F.lit(7))
    got = sorted((r.boat_id, r.trip_no, r.file_no) for r in archive.files_of_trips(t, f, 6 * hour).collect())
    assert got == sorted((b, k, n) for b, k, lo, hi in trips for c, n, a, z in files if b == c and z >= lo and a <= hi)
    long = spark.range(1).select(F.size(cover(F.lit(-(10**12)), F.lit(10**12))).alias("n")).first()["n"]
    assert long < 100
