"""A logbook that is kept up run by run: each run reads what is new and the tail that the last one left.

Below the logbook's folder every run writes its settled trips (``trips/run=N``, final) and its state
(``state/run=N``): one row per boat, messages per source so far, the boat's newest trip, and the tail of every
series: what the next run needs from before its new rows, which is the open trip, the stay before it and the last
value of each series before that. So a run costs what its new rows and the open trips cost, however long the history.

A run that is repeated overwrites what it wrote. Only boats with new rows are read and written; the others' tails
stay where they are, and every ``KEEP`` runs all tails are brought together, so that few folders are looked at.
Trips built with other parameters don't count: such a logbook is refused.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.operators import quality, select
from fairlead.operators.scan import passing_steps, settle
from fairlead.params import TripParams
from fairlead.plans.incremental import resume_points, resume_tables, split_settled
from fairlead.plans.trips import Season, accepted_resets, clean, with_clock_epochs

BOATS = "boat_id int, tail_run bigint, settled_trips int, epoch_base int, signature string"
COUNTS = "boat_id int, series string, source int, n bigint, first_seq bigint"
KEEP = 16

Build = Callable[[dict[str, DataFrame], DataFrame, TripParams], tuple[Season, dict[str, DataFrame]]]


def build_window(window: dict[str, DataFrame], counts: DataFrame, params: TripParams) -> tuple[Season, dict[str, DataFrame]]:
    """The season of a window of decoded series (all sources, DOPs too), its sources chosen by ``counts``; and the
    window's rows with their clock epochs."""
    chosen = select.choose_inputs(window, params.engine_count, counts)
    if "dops" in chosen:
        chosen["fixes"] = quality.gnss_gate(chosen["fixes"], chosen["dops"]).where("accepted").drop("accepted")
    resets = accepted_resets(chosen)
    return Season(clean(chosen, resets), params), with_clock_epochs(window, resets)


class Logbook:
    def __init__(self, spark: SparkSession, folder: str, params: TripParams | None = None, build: Build = build_window):
        self.spark, self.folder, self.params, self.build = spark, folder.rstrip("/"), params or TripParams(), build

    def _state(self, run: int, name: str) -> str:
        return f"{self.folder}/state/run={run}/{name}"

    def _read(self, run: int, name: str, schema: str) -> DataFrame:
        if run < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._state(run, name))

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(path)

    def _left(self, boats: DataFrame, name: str) -> DataFrame | None:
        """Rows that earlier runs left for these boats; at most KEEP runs are named."""
        runs = sorted(r["tail_run"] for r in boats.select("tail_run").distinct().collect())
        parts = [self.spark.read.parquet(self._state(r, name)).join(boats.where(F.col("tail_run") == r).select("boat_id"), "boat_id", "left_semi") for r in runs]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def advance(self, run: int, new: dict[str, DataFrame]) -> None:
        """Takes the new rows of every series. Runs are numbered from 0 on, without gaps."""
        with passing_steps(self.spark):
            self._advance(run, new)

    def _advance(self, run: int, new: dict[str, DataFrame]) -> None:
        boats, counts = self._read(run - 1, "boats", BOATS), self._read(run - 1, "counts", COUNTS)
        signature = self.params.signature()
        if not boats.where(F.col("signature") != signature).isEmpty():
            raise ValueError(f"{self.folder} was built with other parameters: build a new logbook")
        fresh = settle(select.source_counts(new))
        counts = settle(select.add_counts(counts, fresh))
        touched = settle(reduce(DataFrame.unionByName, [df.select("boat_id") for df in new.values()]).distinct())
        known = settle(boats.join(touched, "boat_id", "left_semi"))
        window = {}
        for name, df in new.items():
            tail = self._left(known, f"tail/{name}")
            window[name] = df if tail is None else tail.unionByName(df, allowMissingColumns=True)
        season, rows = self.build(window, counts.join(touched, "boat_id", "left_semi"), self.params)
        resume = settle(resume_points(season.trips, self.params))
        base = known.select("boat_id", F.col("settled_trips").alias("_trips"), F.col("epoch_base").alias("_epochs"))
        numbered = season.trips.join(base, "boat_id", "left")
        numbered = numbered.withColumn("trip_no", F.col("trip_no") + F.coalesce("_trips", F.lit(0)))
        numbered = settle(numbered.withColumn("clock_epoch", F.col("clock_epoch") + F.coalesce("_epochs", F.lit(0))).drop("_trips", "_epochs"))
        settled, newest = split_settled(numbered)
        tails = resume_tables(season.tables, resume, season.intervals, self.params, rows)
        after = touched.join(base, "boat_id", "left").join(resume.select("boat_id", "settled_trips", "clock_epoch"), "boat_id", "left")
        after = after.select(
            "boat_id", F.lit(run).cast("bigint").alias("tail_run"),
            (F.coalesce("_trips", F.lit(0)) + F.coalesce("settled_trips", F.lit(0))).cast("int").alias("settled_trips"),
            (F.coalesce("_epochs", F.lit(0)) + F.coalesce("clock_epoch", F.lit(0))).cast("int").alias("epoch_base"), F.lit(signature).alias("signature"),
        )
        others = boats.join(touched, "boat_id", "left_anti")
        left = {f"tail/{name}": df for name, df in tails.items()} | {"newest": newest}
        if run % KEEP == KEEP - 1:
            others = settle(others)
            for name in left:
                moved = self._left(others, name)
                left[name] = left[name] if moved is None else left[name].unionByName(moved, allowMissingColumns=True)
            others = others.withColumn("tail_run", F.lit(run).cast("bigint"))
        for name, df in left.items():
            self._write(df, self._state(run, name))
        self._write(settled, f"{self.folder}/trips/run={run}")
        self._write(counts, self._state(run, "counts"))
        self._write(after.unionByName(others), self._state(run, "boats"))

    def settled(self) -> DataFrame:
        """All settled trips; ``run`` says which run settled them."""
        return self.spark.read.parquet(f"{self.folder}/trips")

    def trips(self, run: int) -> DataFrame:
        """All trips after a run: the settled ones and every boat's newest."""
        newest = self._left(self._read(run, "boats", BOATS), "newest")
        done = self.settled().where(F.col("run") <= run).drop("run")
        return done if newest is None else done.unionByName(newest, allowMissingColumns=True)
