"""Registry of the queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.operators import align, select
from fairlead.operators.scan import compiled_methods, settle
from fairlead.params import TripParams
from fairlead.plans.trips import Season
from fairlead.workload import bus, fixture
from fairlead.workload.oracle import DECIMALS, oracle, pick

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PARAMS = TripParams()

_seasons: dict[tuple[str, str], Season] = {}


def plain(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Scalar columns in the types the check compares: BIGINT, rounded DOUBLE, STRING, BOOLEAN."""
    df = df.select(*columns) if columns else df
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), DECIMALS.get(columns.get(field.name, "f"), 6))
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.LongType)):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, columns: str | None = None, rest: str | None = None, sql: str | None = None):
    """Registers a query; with ``columns`` and ``rest`` (see oracle.pick) or ``sql`` also its check."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        heads = [c.split("=")[0].strip().split(":") for c in columns.split("|")] if columns else []
        kinds = {n: kind for n, kind in heads}
        QUERIES[name] = lambda spark, sf_dir: plain(fn(spark, sf_dir), kinds)
        if columns and rest:
            ORACLES[name] = oracle(pick(columns, rest))
        elif sql:
            ORACLES[name] = oracle(sql)
        return fn

    return wrap


_landed: dict[tuple[str, str, str], DataFrame] = {}


def landed(spark: SparkSession, sf_dir: str, name: str = "telemetry") -> DataFrame:
    """The telemetry view, or the bus messages built from it, written once per session like the
    landed input of a pipeline (messages partitioned by type)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _landed:
        if name == "telemetry":
            with compiled_methods(spark):
                _landed[key] = settle(fixture.telemetry(spark, sf_dir))
        else:
            tele = landed(spark, sf_dir)
            if name == "frames":
                _landed[key] = settle(bus.frames(tele), ["pgn"])
            else:
                _landed[key] = settle({"fast": bus.fast_frames, "records": bus.records}[name](tele))
    return _landed[key]


_chosen: dict[tuple[str, str], dict[str, DataFrame]] = {}


def chosen_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _chosen:
        _chosen[key] = select.choose_inputs(fixture.all_series(landed(spark, sf_dir)))
    return dict(_chosen[key])


def season(spark: SparkSession, sf_dir: str) -> Season:
    """The season over the fixture. Its written-out steps are shared by the queries of one session,
    the way a pipeline shares its intermediate tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _seasons:
        tables = chosen_tables(spark, sf_dir)
        tables["fixes"] = align.first_of_ties(tables["fixes"])
        _seasons[key] = Season(tables, PARAMS)
    return _seasons[key]
