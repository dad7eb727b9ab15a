"""Stays with their settled position, and the end points of the trips between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.functions.geo import haversine_nm
from fairlead.operators.align import KEYS
from fairlead.params import METRES_PER_NM, TripParams

UNKNOWN_START = "Unknown (start outside log file)"
UNKNOWN_END = "Unknown (end outside log file)"


def stay_table(pieces: DataFrame, params: TripParams) -> DataFrame:
    """One row per stay: start, end and the mean position of the rows truly at rest.

    At rest means at most half the speed threshold with the engine off; each condition is dropped
    when nothing meets it. If the engine was restarted during the stay and the boat was somewhere
    else before that than after it, only the time after counts. Pieces never straddle the end of an
    engine interval, so their sums are enough and no row is read again.
    """
    c = F.col
    whole = Window.partitionBy(*KEYS, "final_no").orderBy("t0", "synthetic").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    df = pieces.where("final_label = 'stationary'")
    # The engine interval that started last: the one known at the last row of the stay.
    restart = F.when(F.last("on_start").over(whole) >= F.min("t0").over(whole), F.last("on_end").over(whole))
    df = df.withColumn("_restart", restart)
    late = F.coalesce(c("t0") >= c("_restart"), F.lit(False))
    aggs: list[Column] = [F.min("t0").alias("start_us"), F.max("t1").alias("end_us"), F.sum("n_all").alias("n_rows")]
    for name in ("all", "slow", "slow_off", "off"):
        for part in ("n", "lat", "lon"):
            col = f"{part}_{name}"
            aggs.append(F.sum(col).alias(f"w_{col}"))
            aggs.append(F.sum(F.when(late, c(col)).otherwise(F.lit(0))).alias(f"a_{col}"))
    g = df.groupBy(*KEYS, "final_no").agg(*aggs)
    if params.confine_radius_m is None:
        use_late = F.lit(False)
    else:
        n_before = c("w_n_all") - c("a_n_all")

        def mean_after(x: str) -> Column:
            return F.try_divide(c(f"a_{x}_all"), c("a_n_all"))

        def mean_before(x: str) -> Column:
            return F.try_divide(c(f"w_{x}_all") - c(f"a_{x}_all"), n_before)

        moved = haversine_nm(mean_before("lat"), mean_before("lon"), mean_after("lat"), mean_after("lon"))
        use_late = F.coalesce(moved * METRES_PER_NM > params.confine_radius_m, F.lit(False))
    g = g.withColumn("narrowed", use_late)

    def chosen(col: str) -> Column:
        return F.when(c("narrowed"), c(f"a_{col}")).otherwise(c(f"w_{col}"))

    def settled(axis: str) -> Column:
        pick = F.when(chosen("n_slow_off") > 0, F.try_divide(chosen(f"{axis}_slow_off"), chosen("n_slow_off")))
        pick = pick.when(chosen("n_slow") > 0, F.try_divide(chosen(f"{axis}_slow"), chosen("n_slow")))
        pick = pick.when(chosen("n_off") > 0, F.try_divide(chosen(f"{axis}_off"), chosen("n_off")))
        return pick.otherwise(F.try_divide(chosen(f"{axis}_all"), chosen("n_all")))

    return g.select(*KEYS, "final_no", "start_us", "end_us", "n_rows", settled("lat").alias("lat"), settled("lon").alias("lon"))


def trip_spans(pieces: DataFrame) -> DataFrame:
    """First and last row of every trip."""
    first = F.struct("t0", "synthetic")
    return pieces.where("final_label = 'moving'").groupBy(*KEYS, "final_no").agg(
        F.min_by("p0", first).alias("p0"), F.max_by("p1", first).alias("p1"), F.sum("n_all").alias("n_rows")
    )


def neighbours(pieces: DataFrame, stays: DataFrame) -> DataFrame:
    """Every trip with the stay right before and right after it (NULL where there is none)."""
    cols = ["start_us", "end_us", "lat", "lon"]
    near = stays.select(*KEYS, "final_no", F.struct(*cols).alias("stay"))
    groups = trip_spans(pieces).join(near, [*KEYS, "final_no"], "full")
    w = Window.partitionBy(*KEYS).orderBy("final_no")
    return (
        groups.withColumn("prev_stay", F.lag("stay").over(w))
        .withColumn("next_stay", F.lead("stay").over(w))
        .where("p0 IS NOT NULL")
        .drop("stay")
    )


def trip_endpoints(trips: DataFrame, params: TripParams) -> DataFrame:
    """Departure from the previous stay's end, arrival at the next stay's start; across a data gap the
    stay still names the place but the trip's own first or last row gives the time."""
    c = F.col
    gap = params.max_gap_us
    depart = F.when(c("prev_stay").isNull() | (c("p0.time_us") - c("prev_stay.end_us") >= gap), c("p0.time_us"))
    arrive = F.when(c("next_stay").isNull() | (c("next_stay.start_us") - c("p1.time_us") >= gap), c("p1.time_us"))
    return trips.withColumns(
        {
            "depart_us": depart.otherwise(c("prev_stay.end_us")),
            "arrive_us": arrive.otherwise(c("next_stay.start_us")),
            "depart_lat": F.coalesce("prev_stay.lat", "p0.lat"),
            "depart_lon": F.coalesce("prev_stay.lon", "p0.lon"),
            "arrive_lat": F.coalesce("next_stay.lat", "p1.lat"),
            "arrive_lon": F.coalesce("next_stay.lon", "p1.lon"),
            "depart_unknown": F.when(c("prev_stay").isNull(), UNKNOWN_START),
            "arrive_unknown": F.when(c("next_stay").isNull(), UNKNOWN_END),
        }
    )


def boat_state(pieces: DataFrame, intervals: DataFrame, engine: DataFrame | None) -> DataFrame:
    """Where things stand at the last row of a boat's data."""
    c = F.col
    at = F.struct("t0", "synthetic")
    last_epoch = pieces.groupBy("boat_id").agg(F.max("clock_epoch").alias("clock_epoch"))
    here = pieces.join(last_epoch, ["boat_id", "clock_epoch"], "left_semi")
    group_start = F.min("t0").over(Window.partitionBy(*KEYS, "run_gap" if "final_no" not in pieces.columns else "final_no"))
    state = here.withColumn("_since", group_start).groupBy(*KEYS).agg(
        F.max_by("p1", at).alias("last"),
        F.max_by(F.struct("final_label", "_since", "final_no"), F.struct("final_no", "t0")).alias("g"),
        F.min("t0").alias("first_us"),
    )
    on = intervals.groupBy(*KEYS).agg(F.max("on_end").alias("last_on"))
    state = state.join(on, KEYS, "left")
    if engine is not None:
        has = engine.groupBy("boat_id").agg(F.lit(True).alias("has_engine"))
        state = state.join(has, "boat_id", "left")
    else:
        state = state.withColumn("has_engine", F.lit(None).cast("boolean"))
    running = F.when(c("has_engine"), F.coalesce(c("last.time_us") - c("last_on") <= 60_000_000, F.lit(False)))
    state = state.withColumn("engine_running", running)
    off = F.when(c("has_engine") & ~c("engine_running"), F.coalesce("last_on", "first_us"))
    underway = c("g.final_label") == "moving"
    return state.select(
        "boat_id",
        c("last.time_us").alias("last_data_us"),
        c("last.lat").alias("lat"),
        c("last.lon").alias("lon"),
        underway.alias("underway"),
        F.when(~underway, c("g._since")).alias("stationary_since_us"),
        "engine_running",
        off.alias("engine_off_since_us"),
    ).withColumns(
        {
            "stationary_s": (c("last_data_us") - c("stationary_since_us")) / 1e6,
            "engine_off_s": (c("last_data_us") - c("engine_off_since_us")) / 1e6,
        }
    )


def in_harbour(state: DataFrame, stationary_minutes: float = 30, engine_off_minutes: float = 10) -> DataFrame:
    c = F.col
    quiet = c("engine_running").isNull() | (~c("engine_running") & (F.coalesce(F.floor("engine_off_s"), F.lit(0)) >= engine_off_minutes * 60))
    settled = F.coalesce(F.floor("stationary_s"), F.lit(0)) >= stationary_minutes * 60
    return state.withColumn("in_harbour", ~c("underway") & settled & quiet)
