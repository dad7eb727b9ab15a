"""A logbook kept up run by run equals one build of everything, and costs what is new."""

import os

import pytest

from fairlead.operators.scan import steps_folder
from fairlead.params import TripParams
from fairlead.plans import logbook as lb
from fairlead.plans.logbook import Logbook
from fairlead.plans.trips import build_trips, decode_archive
from fairlead.sources import ebl_source
from fairlead.streaming.follow import follow
from test_ebl_source import NAMES, land
from test_files_to_trips import LEGS, files

COLUMNS = ["boat_id", "trip_no", "depart_us", "arrive_us", "duration_us", "round(distance_nm, 9) AS nm", "round(max_speed_kn, 9) AS kn"]


def told(df):
    return sorted(tuple(r) for r in df.selectExpr(*COLUMNS).collect())


def run(spark, root, book, steps, **options):
    """The stream, stopped and started before every step."""
    for step in steps:
        step()
        q = follow(spark, str(root), book, progress=f"{book.folder}/offsets", **options).trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()


def state_rows(spark, book, n, name="tail/fixes"):
    return spark.read.parquet(book._state(n, name)).count()


@pytest.fixture(scope="module")
def followed(spark, tmp_path_factory):
    """Two boats; files that grow and come one after another."""
    folder = tmp_path_factory.mktemp("followed")
    root, content = folder / "in", files()

    def landed(boat, data, number):
        """The files before this one, and four fifths of it."""
        land(root, boat, data[:number], NAMES)
        if number < len(data):
            land(root, boat, [data[number][: int(len(data[number]) * 0.8)]], [NAMES[number]])

    steps = [lambda k=k: (landed(2, content, k), landed(3, content[:3], min(k, 3)))[0] for k in (1, 2, 3, 4)]
    book = Logbook(spark, str(folder / "book"))
    run(spark, root, book, steps)
    return root, book


def newest_run(spark, book):
    return max(int(name.rsplit("=", 1)[1]) for name in os.listdir(f"{book.folder}/state"))


def test_following_files_equals_one_build(spark, followed):
    root, book = followed
    ebl_source.register(spark)
    whole = build_trips(decode_archive(spark.read.format("ebl").load(str(root))), TripParams()).trips
    last = newest_run(spark, book)
    want = told(whole)
    assert told(book.trips(last)) == want and last == 3
    settled = told(book.settled().drop("run"))
    newest = {(b, max(t[1] for t in want if t[0] == b)) for b in (2, 3)}
    assert settled == [t for t in want if (t[0], t[1]) not in newest] and len(settled) >= LEGS


def test_tails_do_not_grow_with_the_history(spark, followed):
    _, book = followed
    last = newest_run(spark, book)
    kept = [state_rows(spark, book, n) for n in range(last + 1)]
    total = 750  # positions of a boat
    assert all(k < 2 * total * 0.55 for k in kept), kept  # the open trip and the stay before it, of two boats
    assert state_rows(spark, book, last, "tail/engine") < total


def test_a_repeated_run_changes_nothing(spark, followed, tmp_path):
    _, book = followed
    last = newest_run(spark, book)
    before = told(book.trips(last))
    new = {n: spark.read.parquet(book._state(last, f"tail/{n}")).limit(0) for n in ("fixes", "sog", "engine", "dops")}
    empty = Logbook(spark, book.folder)
    empty.advance(last + 1, new)  # a run without rows leaves all as it was
    assert told(empty.trips(last + 1)) == before
    empty.advance(last + 1, new)
    assert told(empty.trips(last + 1)) == before


def test_other_parameters_are_refused(spark, followed):
    _, book = followed
    other = Logbook(spark, book.folder, TripParams(min_stop_minutes=3.0))
    with pytest.raises(ValueError, match="other parameters"):
        other.advance(newest_run(spark, book) + 1, {})


def test_tails_are_brought_together(spark, tmp_path, monkeypatch):
    """Of boats that are seldom seen, every KEEP runs; and no intermediate table is left."""
    monkeypatch.setattr(lb, "KEEP", 2)
    land(tmp_path / "in", 2, files())
    land(tmp_path / "in", 3, files())
    ebl_source.register(spark)
    frames = spark.read.format("ebl").load(str(tmp_path / "in"))
    series = decode_archive(frames)
    book = Logbook(spark, str(tmp_path / "book"))
    before = set(os.listdir(steps_folder(spark).removeprefix("file:")))
    book.advance(0, {n: df.where("boat_id = 3") for n, df in series.items()})
    book.advance(1, {n: df.where("boat_id = 2") for n, df in series.items()})
    assert {r["tail_run"] for r in book._read(1, "boats", lb.BOATS).collect()} == {1}
    book.advance(2, {n: df.limit(0) for n, df in series.items()})
    assert set(os.listdir(steps_folder(spark).removeprefix("file:"))) == before
    assert told(book.trips(2)) == told(build_trips(series, TripParams()).trips)
