"""The whole season: from decoded series to stays, trips, tracks and boat state."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlead.operators import align, decode, engine, logbook, quality, runs, select, stats, stays
from fairlead.operators import frames as fr
from fairlead.operators.align import KEYS
from fairlead.operators.scan import settle
from fairlead.params import TripParams


class Season:
    """Lazy tables of one build. ``tables`` holds the chosen input series (operators/select.py), with
    fixes already free of outliers (operators/quality.py).

    Steps that several later ones read are written to the shared folder: the numbered navigation
    rows, the pieces (a tiny fraction of the rows), engine intervals, trips and the drawn track.
    """

    def __init__(self, tables: dict[str, DataFrame], params: TripParams | None = None, settle_steps: bool = True) -> None:
        self.tables = tables
        self.params = params or TripParams()
        self._settle = settle if settle_steps else (lambda df: df)

    @cached_property
    def intervals(self) -> DataFrame:
        if "engine" not in self.tables:
            spark = self.tables["fixes"].sparkSession
            return spark.createDataFrame([], "boat_id int, clock_epoch int, on_start bigint, on_end bigint")
        return self._settle(engine.on_intervals(self.tables["engine"], self.params))

    @cached_property
    def instance_intervals(self) -> DataFrame:
        return self._settle(engine.on_intervals(self.tables["engine"], self.params, per_instance=True))

    @cached_property
    def nav(self) -> DataFrame:
        samples = {n: self.tables[n] for n in align.SAMPLES if n in self.tables}
        return align.merge_nav(self.tables["fixes"], samples, self.params, self.intervals)

    @cached_property
    def rows(self) -> DataFrame:
        """Navigation rows with label, engine state and piece number."""
        return self._settle(align.cut_pieces(self.nav, self.params))

    @cached_property
    def stop_pieces(self) -> DataFrame:
        return self._settle(runs.merge_short_stops(runs.make_pieces(self.rows, self.params), self.params))

    @cached_property
    def lock_pieces(self) -> DataFrame:
        return runs.reclassify_locks(self.stop_pieces, self.rows, self.intervals, self.params)

    @cached_property
    def gap_pieces(self) -> DataFrame:
        return self._settle(runs.split_on_gaps(self.lock_pieces, self.params))

    @cached_property
    def legs(self) -> DataFrame:
        return runs.leg_table(self.gap_pieces, self.rows, self.params)

    @cached_property
    def folded(self) -> DataFrame:
        return runs.fold_short_legs(self.legs, self.params)

    @cached_property
    def pieces(self) -> DataFrame:
        """Final pieces: which stay or trip every stretch of rows belongs to."""
        return self._settle(runs.assign_final(self.gap_pieces, self.folded))

    @cached_property
    def stays(self) -> DataFrame:
        return stays.stay_table(self.pieces, self.params)

    @cached_property
    def ends(self) -> DataFrame:
        """Every trip with its neighbours and end points (before the minimum distance filter)."""
        return stays.trip_endpoints(stays.neighbours(self.pieces, self.stays), self.params)

    @cached_property
    def legs_stats(self) -> DataFrame:
        return stats.track_stats(self.pieces, self.params)

    @cached_property
    def trips(self) -> DataFrame:
        """Trips long enough to keep, with end points and the figures of the track. Written out once:
        a small table that every per-trip figure joins with."""
        joined = self.ends.join(self.legs_stats, [*KEYS, "final_no"])
        kept = joined.where(F.col("distance_nm") >= self.params.min_trip_distance_nm)
        by_time = Window.partitionBy("boat_id").orderBy("clock_epoch", "depart_us", "final_no")
        return self._settle(kept.withColumn("trip_no", F.row_number().over(by_time)))

    @cached_property
    def track(self) -> DataFrame:
        """The rows of the kept trips. Pieces and rows share the slice, so this joins without a new
        partitioning of the rows."""
        owner = self.pieces.where("synthetic = 0 AND final_label = 'moving'").select(*KEYS, "slice", "piece_no", "final_no")
        kept = owner.join(self.trips.select(*KEYS, "final_no", "trip_no"), [*KEYS, "final_no"])
        return self.rows.join(kept, [*KEYS, "slice", "piece_no"])

    @cached_property
    def marked(self) -> DataFrame:
        """The drawn track, which reaches the stays' positions. Written out: map, log, markers and
        GPX all read it."""
        return self._settle(logbook.marked_track(self.trips, self.track, self.params))

    @cached_property
    def state(self) -> DataFrame:
        return stays.boat_state(self.pieces, self.intervals, self.tables.get("engine"))


REGRESSION_CHECKED = ("sog", "depth", "water_temp", "wind", "stw", "outside_temp", "humidity", "attitude")


def clock_resets(fixes: DataFrame) -> DataFrame:
    """Arrival numbers (boat_id, file_no, seq) of the positions at which the clock was set back by 24 h or more."""
    rows = fixes.select("boat_id", "file_no", "seq", "time_us")
    return quality.time_regressions(rows, ["boat_id"], "file_no").where("clock_reset").select("boat_id", "file_no", "seq")


def accepted_resets(tables: dict[str, DataFrame]) -> DataFrame:
    """Clock resets between accepted positions: a position that is wrong may have a wrong time too. Only
    where raw positions show any reset are they judged for it."""
    resets = settle(clock_resets(tables["fixes"]))
    if resets.isEmpty():
        return resets
    one = {n: tables[n].withColumn("clock_epoch", F.lit(0)) for n in ("fixes", "sog")}
    judged = quality.reject_gps_outliers(quality.as_of_speed(one["fixes"], one["sog"]))
    return settle(clock_resets(judged))


def with_clock_epochs(tables: dict[str, DataFrame], resets: DataFrame) -> dict[str, DataFrame]:
    """Numbers the clock epochs of every series by arrival number: every file is one stretch of arrival numbers in
    one epoch, or several where the clock was reset inside it, and rows meet the stretch they are in."""
    if resets.isEmpty():
        return {name: df.withColumn("clock_epoch", F.lit(0)) for name, df in tables.items()}
    files = reduce(DataFrame.unionByName, [df.select("boat_id", "file_no") for df in tables.values()]).distinct()
    starts = files.select("boat_id", "file_no", F.lit(-1).cast("bigint").alias("_from"), F.lit(0).alias("n"))
    starts = starts.unionByName(resets.select("boat_id", "file_no", F.col("seq").alias("_from"), F.lit(1).alias("n")))
    in_boat = Window.partitionBy("boat_id").orderBy("file_no", "_from")
    in_file = Window.partitionBy("boat_id", "file_no").orderBy("_from")
    spans = starts.select("boat_id", "file_no", "_from", F.sum("n").over(in_boat).cast("int").alias("clock_epoch"), F.lead("_from").over(in_file).alias("_to"))
    spans = settle(spans)
    out = {}
    for name, df in tables.items():
        joined = df.drop("clock_epoch").join(spans, ["boat_id", "file_no"])
        out[name] = joined.where("seq >= _from AND (_to IS NULL OR seq < _to)").drop("_from", "_to")
    return out


ARRIVAL = ["boat_id", "file_no", "seq", "time_us"]


def late_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (series and ARRIVAL) of all checked series that came with a time before the last kept one's. One
    pass over four columns of all series together; few rows are left of it."""
    parts = [df.select(F.lit(name).alias("series"), *ARRIVAL) for name, df in tables.items() if name in REGRESSION_CHECKED]
    every = reduce(DataFrame.unionByName, parts)
    return settle(quality.time_regressions(every, ["series", "boat_id"], "file_no").where("NOT kept").select("series", *ARRIVAL))


def clean(tables: dict[str, DataFrame], resets: DataFrame | None = None) -> dict[str, DataFrame]:
    """Chosen series without time regressions and without impossible positions. ``resets``: the accepted clock
    resets, where they are known already."""
    out = with_clock_epochs(tables, accepted_resets(tables) if resets is None else resets)
    if any(name in out for name in REGRESSION_CHECKED):
        late = late_rows(out)
        # Series without late rows, mostly all of them, pass as they are.
        for name in {r["series"] for r in late.select("series").distinct().collect()}:
            out[name] = out[name].join(late.where(F.col("series") == name).select(*ARRIVAL), ARRIVAL, "left_anti")
    sped = quality.as_of_speed(out["fixes"], out["sog"])
    out["fixes"] = quality.reject_gps_outliers(sped).drop("sog_ms")
    return out


def build_trips(tables: dict[str, DataFrame], params: TripParams | None = None) -> Season:
    """From decoded series of all sources to the season: choose sources, clean, build."""
    params = params or TripParams()
    return Season(clean(select.choose_inputs(tables, params.engine_count)), params)


def decode_archive(frames: DataFrame, carried: DataFrame | None = None) -> dict[str, DataFrame]:
    """From parsed CAN frames (all files of all boats) to decoded series, with positions only from
    receivers that had a fix. ``carried``: the clock's state where the frames are those of later files only
    (see frames.carried_clock and incremental.resume_files)."""
    wanted = fr.keep_pgns(frames)
    whole = settle(fr.messages(wanted))
    clock = fr.elect_clock(fr.system_times(whole), carried=carried)
    stamped = settle(fr.stamp(whole, clock, carried=carried).withColumn("clock_epoch", F.lit(0)), ["pgn"])
    tables = decode.decode_all(stamped)
    tables["fixes"] = quality.gnss_gate(tables["fixes"], tables.pop("dops")).where("accepted").drop("accepted")
    return tables
