"""The batch rules on streams: live boat state, harbour alerts, late data, settled trips.

State is one small row per boat. Late data is judged against the boat's own last time, not against a
watermark, because a boat's clock may be set back for good.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from fairlead.functions.clocktime import to_ntz
from fairlead.params import CLOCK_RESET_S, EARTH_RADIUS_NM, ENGINE_IDLE_FUEL_LPH, ENGINE_OFF_GAP_S, STRETCH_GAP_S, US, TripParams
from fairlead.plans.logbook import Logbook
from fairlead.streaming.ordered import InOrder, use_state_store

STATE_SCHEMA = (
    "last_us bigint, lat double, lon double, moving boolean, run_us bigint, path_nm double, underway boolean, since_us bigint, first_us bigint, "
    "last_on_us bigint, has_engine boolean, alerted_us bigint, dropped bigint, clock_resets bigint"
)
OUT_SCHEMA = (
    "boat_id int, last_data_us bigint, lat double, lon double, underway boolean, stationary_since_us bigint, engine_running boolean, "
    "engine_off_since_us bigint, in_harbour boolean, alert boolean, dropped bigint, clock_resets bigint"
)


def live_input(fixes: DataFrame, engine: DataFrame | None = None) -> DataFrame:
    """Fixes with their speed, and engine readings, in one stream of the columns the state needs."""
    none = F.lit(None).cast("double")
    df = fixes.select("boat_id", "seq", "time_us", "lat", "lon", F.col("sog_ms").cast("double"), none.alias("fuel_rate_lph"), F.lit(False).alias("is_engine"))
    if engine is None:
        return df
    return df.unionByName(
        engine.select("boat_id", "seq", "time_us", none.alias("lat"), none.alias("lon"), none.alias("sog_ms"), F.col("fuel_rate_lph").cast("double"), F.lit(True).alias("is_engine"))
    )


def _distance_nm(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    half_lat, half_lon = math.sin(math.radians(lat2 - lat1) / 2), math.sin(math.radians(lon2 - lon1) / 2)
    a = half_lat**2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * half_lon**2
    return 2 * EARTH_RADIUS_NM * math.asin(math.sqrt(min(1.0, a)))


@dataclass
class Boat:
    """What is known of a boat, sample by sample; the fields of STATE_SCHEMA in order."""

    last: int | None = None
    lat: float | None = None
    lon: float | None = None
    moving: bool | None = None  # label of the present run of samples, its begin and its path
    run: int | None = None
    path: float = 0.0
    underway: bool | None = None
    since: int | None = None
    first: int | None = None
    on: int | None = None
    has_engine: bool = False
    alerted: int | None = None
    dropped: int = 0
    resets: int = 0

    def engine(self, t: int, fuel: float | None) -> None:
        self.has_engine = True
        if fuel is not None and fuel == fuel and fuel > ENGINE_IDLE_FUEL_LPH and (self.on is None or t > self.on):
            self.on = t

    def fix(self, t: int, lat: float, lon: float, sog: float, params: TripParams) -> bool:
        """Takes a position; False if its time makes it late."""
        if self.last is not None and t < self.last:
            if self.last - t < CLOCK_RESET_S * US:
                self.dropped += 1
                return False
            self.resets += 1
            self.moving = self.underway = self.since = self.on = None
        moving = bool(sog >= params.speed_threshold_ms)
        if moving != self.moving:
            self.run, self.path = t, 0.0
        else:
            self.path += _distance_nm(self.lat, self.lon, lat, lon)
        self.first = t if self.first is None else self.first
        self.last, self.lat, self.lon, self.moving = t, lat, lon, moving
        # The first run is what it is; later ones count once they are long enough.
        if self.underway is None:
            self.underway, self.since = moving, None if moving else t
        elif moving and not self.underway and self.path >= params.min_leg_nm:
            self.underway, self.since = True, None
        elif not moving and self.underway and t - self.run >= params.min_stop_us:
            self.underway, self.since = False, self.run
        return True

    def running(self) -> bool | None:
        return (self.on is not None and self.last - self.on <= ENGINE_OFF_GAP_S * US) if self.has_engine else None

    def off_since(self) -> int | None:
        return None if self.running() or not self.has_engine else (self.on if self.on is not None else self.first)

    def in_harbour(self, stationary_s: float, engine_off_s: float) -> bool:
        if self.underway or self.since is None or (self.last - self.since) // US < stationary_s:
            return False
        off = self.off_since()
        return not self.has_engine or (off is not None and (self.last - off) // US >= engine_off_s)

    def told(self, boat: int, harbour: bool, alert: bool) -> tuple:
        return (boat, self.last, self.lat, self.lon, self.underway, self.since, self.running(), self.off_since(), harbour, alert, self.dropped, self.resets)


_OUT_TYPES = {"stationary_since_us": "Int64", "engine_off_since_us": "Int64", "engine_running": "boolean"}
_OUT_NAMES = [c.split()[0] for c in OUT_SCHEMA.split(", ")]
#: Arrival numbers of the samples that are put in order at once.
SLICE = 1 << 17


def _told(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_OUT_NAMES).astype(_OUT_TYPES)


class Watch(InOrder):
    """Takes a boat's samples in arrival order; its state is the fields of Boat."""

    def __init__(self, params: TripParams, stationary_s: float, engine_off_s: float):
        super().__init__(SLICE)
        self.params, self.stationary_s, self.engine_off_s = params, stationary_s, engine_off_s

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("boat", STATE_SCHEMA)

    def load(self, key: tuple) -> None:
        self.boat = Boat(*self.state.get()) if self.state.exists() else Boat()

    def take(self, key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        boat, alerts = self.boat, []
        columns = (rows[c].tolist() for c in ("is_engine", "time_us", "fuel_rate_lph", "lat", "lon", "sog_ms"))
        for is_engine, time, fuel, lat, lon, sog in zip(*columns):
            if is_engine:
                boat.engine(int(time), fuel)
            elif boat.fix(int(time), lat, lon, sog, self.params):
                # Judged at every position, so that an alert doesn't depend on where a trigger ends.
                if boat.since != boat.alerted and boat.in_harbour(self.stationary_s, self.engine_off_s):
                    boat.alerted = boat.since
                    alerts.append(boat.told(key[0], True, True))
        if alerts:
            yield _told(alerts)

    def save(self, key: tuple) -> Iterator[pd.DataFrame]:
        self.state.update(astuple(self.boat))
        if self.boat.last is not None:
            yield _told([self.boat.told(key[0], self.boat.in_harbour(self.stationary_s, self.engine_off_s), False)])


def live_state(stream: DataFrame, params: TripParams, stationary_minutes: float = 30, engine_off_minutes: float = 10) -> DataFrame:
    """Where each boat stands, in data time: one row per boat and trigger (``alert`` false), and one for the
    first position of each stay at which the boat counts as in harbour (``alert`` true).

    Moves shorter than the shortest leg don't end a stay, and stops shorter than the shortest stop don't end a
    trip. Every position is judged, in arrival order, so the rows of one stream give the same alerts in few
    large triggers and in many small ones. A backlog is put in order in the state store, slice by slice (see
    ``ordered``), so a trigger may hold any number of a boat's rows.
    """
    use_state_store(stream.sparkSession)
    watch = Watch(params, stationary_minutes * 60, engine_off_minutes * 60)
    return stream.groupBy("boat_id").transformWithStateInPandas(watch, OUT_SCHEMA, "Update", "None")


def latest(states: DataFrame) -> DataFrame:
    return states.where("NOT alert")


def harbour_alerts(states: DataFrame) -> DataFrame:
    return states.where("alert").select("boat_id", "stationary_since_us", "last_data_us", "lat", "lon")


def dropped_sessions(dropped: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stretches of dropped samples at most 30 s apart, as session windows."""
    timed = dropped.withColumn("at", to_ntz(F.col("time_us")).cast("timestamp")).withWatermark("at", delay)
    g = timed.groupBy("boat_id", "source", F.session_window("at", f"{STRETCH_GAP_S} seconds"))
    return g.agg(F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"), F.count(F.lit(1)).alias("n")).drop("session_window")


def emit_settled(logbook: Logbook, series: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that takes a batch into a logbook: ``series`` makes decoded series of it. A batch that
    is run again replaces what it wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        logbook.advance(batch_id, series(batch))

    return write
