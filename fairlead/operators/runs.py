"""From navigation rows to runs: stays and trips.

Rows are touched once, per time slice: they shrink to *pieces* (see cut_pieces) that carry sums,
extremes and end points. All rules about stops, locks, gaps and short legs then work on pieces, which
are a tiny fraction of the rows, with windows over a boat's pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.functions.geo import haversine_nm
from fairlead.operators.align import KEYS
from fairlead.operators.scan import slices_between
from fairlead.params import METRES_PER_NM, TripParams


def boat():
    """A boat's pieces in order."""
    return Window.partitionBy(*KEYS).orderBy("t0", "synthetic")


def make_pieces(rows: DataFrame, params: TripParams) -> DataFrame:
    """Aggregates numbered rows (cut_pieces) to pieces. Grouping by slice and piece number needs no
    shuffle beyond the one by slice that is already there."""
    t, c = F.col("time_us"), F.col
    slow = c("sog_ms") <= F.lit(params.speed_threshold_ms / 2)
    off = ~c("engine_on")
    step = F.when(c("_same"), haversine_nm(c("_plat"), c("_plon"), c("lat"), c("lon"))).otherwise(0.0)

    def sums(name: str, cond: Column) -> list[Column]:
        return [
            F.sum(F.when(cond, 1).otherwise(0)).alias(f"n_{name}"),
            F.sum(F.when(cond, c("lat")).otherwise(0.0)).alias(f"lat_{name}"),
            F.sum(F.when(cond, c("lon")).otherwise(0.0)).alias(f"lon_{name}"),
        ]

    point = F.struct(t, c("lat"), c("lon"))
    measured = F.when(c("depth_m").isNotNull(), F.struct("depth_m", t))
    deepest = F.when(c("depth_m").isNotNull(), F.struct("depth_m", -t))
    has_interval = "on_end" in rows.columns
    return rows.groupBy(*KEYS, "slice", "piece_no").agg(
        F.first("label").alias("label"),
        F.min(t).alias("t0"),
        F.max(t).alias("t1"),
        F.min_by(point, t).alias("p0"),
        F.max_by(point, t).alias("p1"),
        *sums("all", F.lit(True)),
        *sums("slow", slow),
        *sums("slow_off", slow & off),
        *sums("off", off),
        F.sum(step).alias("path_nm"),
        F.sum(F.when(c("_same"), t - c("_pt")).otherwise(0)).alias("moving_us"),
        F.sum("sog_ms").alias("sog_sum"),
        F.max(F.struct(c("sog_ms"), -t)).alias("top"),
        F.min_by(F.struct("depth_m", t, "lat", "lon"), measured).alias("shallow"),
        F.max_by(F.struct("depth_m", t, "lat", "lon"), deepest).alias("deep"),
        F.count("water_temp_c").alias("wt_n"),
        F.sum("water_temp_c").alias("wt_sum"),
        F.min("water_temp_c").alias("wt_min"),
        F.max("water_temp_c").alias("wt_max"),
        F.min("lat").alias("lat_lo"),
        F.max("lat").alias("lat_hi"),
        F.min("lon").alias("lon_lo"),
        F.max("lon").alias("lon_hi"),
        (F.first("on_start") if has_interval else F.lit(None).cast("bigint")).alias("on_start"),
        (F.first("on_end") if has_interval else F.lit(None).cast("bigint")).alias("on_end"),
    ).withColumn("synthetic", F.lit(0))


def number_runs(pieces: DataFrame, label: str, out: str) -> DataFrame:
    """Neighbouring pieces with one label are one run."""
    new = F.coalesce(F.lag(label).over(boat()) != F.col(label), F.lit(True))
    return pieces.withColumn("_new", new.cast("int")).withColumn(out, F.sum("_new").over(boat())).drop("_new")


def classify_runs(pieces: DataFrame) -> DataFrame:
    return number_runs(pieces, "label", "run_no")


def run_table(pieces: DataFrame, label: str, run: str) -> DataFrame:
    return pieces.groupBy(*KEYS, run).agg(
        F.first(label).alias("label"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("n_all").alias("n")
    )


def merge_short_stops(pieces: DataFrame, params: TripParams) -> DataFrame:
    """A stop shorter than the minimum is part of the trip, unless a data gap touches it (then its
    measured length says nothing). Adds ``label_stop`` and ``run_stop``."""
    df = classify_runs(pieces)
    df = df.withColumns({"_prev": F.lag("t1").over(boat()), "_next": F.lead("t0").over(boat())})
    in_run = Window.partitionBy(*KEYS, "run_no").orderBy("t0").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    start, end = F.min("t0").over(in_run), F.max("t1").over(in_run)
    gap_before = F.coalesce(start - F.first("_prev").over(in_run) >= params.max_gap_us, F.lit(False))
    gap_after = F.coalesce(F.last("_next").over(in_run) - end >= params.max_gap_us, F.lit(False))
    short = (F.col("label") == "stationary") & (end - start < params.min_stop_us) & ~(gap_before | gap_after)
    df = df.withColumn("label_stop", F.when(short, "moving").otherwise(F.col("label"))).drop("_prev", "_next")
    return number_runs(df, "label_stop", "run_stop")


def engine_off_spans(runs: DataFrame, intervals: DataFrame) -> DataFrame:
    """For every run: the end of the last engine interval that ended at or before its start (else its
    start), and the start of the first one at or after its end (else NULL)."""
    keys = [*KEYS, "run_stop"]
    probe = runs.select(*keys, "t0", "t1")
    ends = probe.select(*KEYS, "run_stop", F.col("t0").alias("t"), F.lit(1).alias("tag"), F.lit(None).cast("bigint").alias("v"))
    ends = ends.unionByName(
        intervals.select(*KEYS, F.lit(None).cast("bigint").alias("run_stop"), F.col("on_end").alias("t"), F.lit(0).alias("tag"), F.col("on_end").alias("v"))
    )
    back = Window.partitionBy(*KEYS).orderBy("t", "tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    off_start = ends.withColumn("last_end", F.last("v", ignorenulls=True).over(back)).where("tag = 1").select(*keys, "last_end")
    starts = probe.select(*KEYS, "run_stop", F.col("t1").alias("t"), F.lit(0).alias("tag"), F.lit(None).cast("bigint").alias("v"))
    starts = starts.unionByName(
        intervals.select(*KEYS, F.lit(None).cast("bigint").alias("run_stop"), F.col("on_start").alias("t"), F.lit(1).alias("tag"), F.col("on_start").alias("v"))
    )
    # Looked at from the end: a frame that reaches to the end of the boat is gone through anew for every row.
    ahead = Window.partitionBy(*KEYS).orderBy(F.desc("t"), F.desc("tag")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    off_end = starts.withColumn("off_end", F.last("v", ignorenulls=True).over(ahead)).where("tag = 0").select(*keys, "off_end")
    return (
        runs.join(off_start, keys)
        .join(off_end, keys)
        .withColumn("off_start", F.coalesce("last_end", "t0"))
        .drop("last_end")
    )


def spread_m(spans: DataFrame, rows: DataFrame, params: TripParams, id_cols: list[str]) -> DataFrame:
    """Largest distance in metres from the centroid of the rows in [lo, hi], per span.

    The range join is an equi-join on time slices; both passes (centroid, then distance) aggregate
    before anything is shuffled by span.
    """
    sliced = spans.select(*KEYS, *id_cols, "lo", "hi", F.explode(slices_between("lo", "hi", params.chunk_us)).alias("slice"))
    points = rows.select(*KEYS, "slice", "time_us", "lat", "lon")
    inside = sliced.join(points, [*KEYS, "slice"]).where("time_us BETWEEN lo AND hi")
    keys = [*KEYS, *id_cols]
    centre = inside.groupBy(*keys).agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
    far = haversine_nm(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon")) * METRES_PER_NM
    return inside.join(centre, keys).groupBy(*keys).agg(F.max(far).alias("spread_m"))


def lock_candidates(pieces: DataFrame, intervals: DataFrame, params: TripParams) -> DataFrame:
    """Stationary runs (never the first) whose engine-off time, or own length when the engine never
    starts again but a later run exists, is within the maximum; with the time range to check."""
    runs = run_table(pieces, "label_stop", "run_stop")
    last = F.max("run_stop").over(Window.partitionBy(*KEYS))
    runs = runs.withColumn("_last", last).where("label = 'stationary' AND run_stop > 1")
    spans = engine_off_spans(runs, intervals)
    lo = F.when(F.col("off_end").isNotNull(), F.col("off_start")).otherwise(F.col("t0"))
    hi = F.when(F.col("off_end").isNotNull(), F.col("off_end")).otherwise(F.col("t1"))
    usable = F.col("off_end").isNotNull() | (F.col("run_stop") < F.col("_last"))
    return spans.withColumn("lo", lo).withColumn("hi", hi).where(usable & (F.col("hi") - F.col("lo") <= params.lock_max_us))


def reclassify_locks(pieces: DataFrame, rows: DataFrame, intervals: DataFrame, params: TripParams) -> DataFrame:
    """Locks, bridges and similar pauses become part of the trip. Adds ``label_lock``, ``run_lock``."""
    if not params.locks_on:
        return pieces.withColumn("label_lock", F.col("label_stop")).withColumn("run_lock", F.col("run_stop"))
    spans = lock_candidates(pieces, intervals, params)
    tight = spread_m(spans, rows, params, ["run_stop"]).where(F.col("spread_m") <= params.confine_radius_m)
    locks = tight.select(*KEYS, "run_stop", F.lit(True).alias("_lock"))
    df = pieces.join(locks, [*KEYS, "run_stop"], "left")
    df = df.withColumn("label_lock", F.when(F.col("_lock"), "moving").otherwise(F.col("label_stop"))).drop("_lock")
    return number_runs(df, "label_lock", "run_lock")


def split_on_gaps(pieces: DataFrame, params: TripParams) -> DataFrame:
    """Splits every run at internal gaps. After the part of a moving run before a gap comes a
    synthetic one-row stay at its last row. Adds ``run_gap`` and ``label_gap``."""
    w = boat()
    gap_after = (F.lead("run_lock").over(w) == F.col("run_lock")) & (F.lead("t0").over(w) - F.col("t1") >= params.max_gap_us)
    ends = F.coalesce(gap_after & (F.col("label_lock") == "moving"), F.lit(False))
    # The piece itself, and where it ends at a gap a second time as the synthetic stay.
    df = pieces.withColumn("_ends", ends).drop("synthetic")
    df = df.withColumn("synthetic", F.explode(F.when(F.col("_ends"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    extra = F.col("synthetic") == 1
    changed = {
        "label_lock": F.lit("stationary"),
        "t0": F.col("t1"),
        "p0": F.col("p1"),
        "path_nm": F.lit(0.0),
        "moving_us": F.lit(0).cast("bigint"),
    }
    for name in ("all", "slow", "slow_off", "off"):
        one = 1 if name == "all" else 0
        changed[f"n_{name}"] = F.lit(one).cast("bigint")
        changed[f"lat_{name}"] = F.col("p1.lat") * one
        changed[f"lon_{name}"] = F.col("p1.lon") * one
    df = df.select(*[F.when(extra, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in df.columns])
    new = (
        (F.lag("run_lock").over(w) != F.col("run_lock"))
        | (F.lag("synthetic").over(w) != F.col("synthetic"))
        | (F.col("t0") - F.lag("t1").over(w) >= params.max_gap_us)
    )
    df = df.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    return df.withColumns({"run_gap": F.sum("_new").over(w), "label_gap": F.col("label_lock")}).drop("_new", "_ends")


def add_hops(pieces: DataFrame, run: str, params: TripParams) -> DataFrame:
    """Distance and time from the end of the previous piece of the same run."""
    w = Window.partitionBy(*KEYS, run).orderBy("t0", "synthetic")
    p, q = F.lag("p1").over(w), F.col("p0")
    hop = haversine_nm(p["lat"], p["lon"], q["lat"], q["lon"])
    dt = F.col("t0") - F.lag("t1").over(w)
    return pieces.withColumn("hop_nm", F.coalesce(hop, F.lit(0.0))).withColumn(
        "hop_us", F.when(dt < params.max_gap_us, dt).otherwise(0).cast("bigint")
    )


def leg_table(pieces: DataFrame, rows: DataFrame, params: TripParams) -> DataFrame:
    """The runs after the gap split with path length and, for moving ones, whether they stayed within
    the lock radius of their own centroid. The bounding box settles nearly every run; only the rows
    of the few small ones are looked at again."""
    hops = add_hops(pieces, "run_gap", params)
    legs = hops.groupBy(*KEYS, "run_gap").agg(
        F.first("label_gap").alias("label"),
        F.max("synthetic").alias("synthetic"),
        F.min("t0").alias("t0"),
        F.max("t1").alias("t1"),
        F.sum("n_all").alias("n"),
        F.sum(F.col("path_nm") + F.col("hop_nm")).alias("path_nm"),
        F.min("lat_lo").alias("lat_lo"),
        F.max("lat_hi").alias("lat_hi"),
        F.min("lon_lo").alias("lon_lo"),
        F.max("lon_hi").alias("lon_hi"),
    )
    if params.confine_radius_m is None:
        return legs.withColumn("spread_m", F.lit(None).cast("double")).withColumn("confined", F.lit(False))
    c = F.col
    tall = haversine_nm(c("lat_lo"), c("lon_lo"), c("lat_hi"), c("lon_lo"))
    mid = (c("lat_lo") + c("lat_hi")) / 2
    wide = haversine_nm(mid, c("lon_lo"), mid, c("lon_hi"))
    # Farther apart than twice the radius (with a margin): the centroid cannot be near both ends.
    small = F.greatest(tall, wide) * METRES_PER_NM <= 2.1 * params.confine_radius_m
    spans = legs.where((c("label") == "moving") & small).withColumn("lo", c("t0")).withColumn("hi", c("t1"))
    spread = spread_m(spans, rows, params, ["run_gap"])
    legs = legs.join(spread, [*KEYS, "run_gap"], "left")
    return legs.withColumn("confined", F.coalesce(c("spread_m") <= params.confine_radius_m, F.lit(False)))


def fold_short_legs(legs: DataFrame, params: TripParams) -> DataFrame:
    """Decides per leg what it ends up in (``final_no``, ``final_label``).

    Short or confined moves are no trips of their own. A short one that did go somewhere is appended
    to the trip before it, if no data gap lies between; anything else joins the stay around it. Both
    decisions only look back to the last data gap, so they are window expressions.
    """
    c, w = F.col, boat()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    moving = c("label") == "moving"
    small = moving & (c("confined") | (c("path_nm") < params.min_leg_nm))
    df = legs.withColumn("real", moving & ~small)
    gap = F.coalesce(c("t0") - F.lag("t1").over(w) >= params.max_gap_us, F.lit(True))
    df = df.withColumn("section", F.sum(gap.cast("int")).over(w))
    section = Window.partitionBy(*KEYS, "section").orderBy("t0", "synthetic").rowsBetween(Window.unboundedPreceding, -1)
    had_trip = F.coalesce(F.max(c("real").cast("int")).over(section), F.lit(0)) == 1
    df = df.withColumn("spliced", moving & ~c("real") & ~c("confined") & had_trip)
    df = df.withColumn("final_label", F.when(c("real") | c("spliced"), "moving").otherwise("stationary"))
    kept = F.last(F.when(~c("spliced"), F.struct("final_label", "t1")), ignorenulls=True).over(before)
    df = df.withColumn("_kept", kept)
    joins = (
        (c("final_label") == "stationary")
        & (c("_kept.final_label") == "stationary")
        & (c("t0") - c("_kept.t1") < params.max_gap_us)
    )
    new = ~c("spliced") & ~F.coalesce(joins, F.lit(False))
    df = df.withColumn("_no", F.sum(new.cast("int")).over(w))
    owner = F.last(F.when(c("real"), c("_no")), ignorenulls=True).over(section)
    df = df.withColumn("final_no", F.when(c("spliced"), owner).otherwise(c("_no")))
    return df.drop("_kept", "_no")


def assign_final(pieces: DataFrame, folded: DataFrame) -> DataFrame:
    keys = [*KEYS, "run_gap"]
    return pieces.join(folded.select(*keys, "final_no", "final_label", "spliced"), keys)
