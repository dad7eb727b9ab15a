"""Backward as-of join of all sensor series onto the accepted position fixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlead.operators.scan import scan, settle, time_slice
from fairlead.params import TripParams

KEYS = ["boat_id", "clock_epoch"]

# series -> fields it contributes; a newer row replaces all of them, also with NULL.
SAMPLES: dict[str, dict[str, str]] = {
    "sog": {"sog_ms": "sog_ms", "cog_deg": "cog_deg"},
    "depth": {"depth_m": "depth_m"},
    "water_temp": {"temp_c": "water_temp_c"},
    "wind": {"speed_ms": "wind_speed_ms", "angle_deg": "wind_angle_deg", "reference": "wind_reference"},
    "stw": {"stw_ms": "stw_ms"},
    "engine_on": {"on_start": "on_start", "on_end": "on_end"},
}
TYPES = {"wind_reference": "int", "on_start": "bigint", "on_end": "bigint"}


def merge_nav(
    fixes: DataFrame, samples: dict[str, DataFrame], params: TripParams, intervals: DataFrame | None = None
) -> DataFrame:
    """One row per fix with the latest value of every series at or before it.

    All series are brought together and reduced to one row per timestamp first (partial aggregation
    on the map side: many messages share the last clock reading, and only the last of them can ever
    be seen by a later fix). The look-back then runs per time slice, see operators/scan.py.
    ``intervals`` adds the engine interval that started last, so "was the engine on here" needs no
    range join.
    """
    parts = {name: df for name, df in samples.items() if name in SAMPLES}
    if intervals is not None:
        parts["engine_on"] = intervals.withColumn("time_us", F.col("on_start")).withColumn("seq", F.col("on_start"))
    names = [n for n in SAMPLES if n in parts]

    def struct_of(name: str):
        return F.struct(*[F.col(c).cast(TYPES.get(a, "double")).alias(a) for c, a in SAMPLES[name].items()])

    def shape(df: DataFrame, which: str) -> DataFrame:
        cols = [F.col(k) for k in KEYS] + [F.col("time_us"), F.col("seq").cast("bigint")]
        fix_type = "struct<lat:double,lon:double,seq:bigint>"
        cols.append(
            F.struct("lat", "lon", F.col("seq").cast("bigint").alias("seq")).alias("fix")
            if which == "fix"
            else F.lit(None).cast(fix_type).alias("fix")
        )
        for n in names:
            ddl = "struct<" + ",".join(f"{a}:{TYPES.get(a, 'double')}" for a in SAMPLES[n].values()) + ">"
            cols.append(struct_of(n).alias(n) if n == which else F.lit(None).cast(ddl).alias(n))
        return df.select(*cols)

    both = reduce(DataFrame.unionByName, [shape(fixes, "fix"), *[shape(parts[n], n) for n in names]])
    per_time = both.groupBy(*KEYS, time_slice("time_us", params.chunk_us).alias("slice"), "time_us").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ["fix", *names]]
    )
    # Far smaller than the input and read twice below (rows, and one summary per slice).
    filled = scan(settle(per_time), KEYS, "slice", ["time_us"], fill={f"at_{n}": F.col(n) for n in names})
    out = [F.col(k) for k in KEYS] + [F.col("slice"), F.col("time_us"), F.col("fix.seq").alias("seq")]
    out += [F.col("fix.lat").alias("lat"), F.col("fix.lon").alias("lon")]
    for name, fields in SAMPLES.items():
        if name == "engine_on" and intervals is None:
            continue
        for a in fields.values():
            value = F.col(f"at_{name}")[a] if name in names else F.lit(None).cast(TYPES.get(a, "double"))
            out.append((F.coalesce(value, F.lit(0.0)) if a == "sog_ms" else value).alias(a))
    return filled.where(F.col("fix").isNotNull()).select(*out)


def first_of_ties(fixes: DataFrame) -> DataFrame:
    """Of fixes with the same timestamp the one that arrived first."""
    at = F.struct("seq")
    cols = [c for c in fixes.columns if c not in (*KEYS, "time_us")]
    packed = fixes.groupBy(*KEYS, "time_us").agg(F.min_by(F.struct(*cols), at).alias("r"))
    return packed.select(*KEYS, "time_us", "r.*").select(*fixes.columns)


def cut_pieces(nav: DataFrame, params: TripParams) -> DataFrame:
    """Numbers, inside every time slice, the stretches with one speed label, one engine phase and no
    data gap, and adds what the previous row of the stretch contributes to path and duration."""
    here = Window.partitionBy(*KEYS, "slice").orderBy("time_us")
    label = F.when(F.col("sog_ms") < params.speed_threshold_ms, "stationary").otherwise("moving")
    df = nav.withColumn("label", label)
    if "on_end" in nav.columns:
        phase = (
            F.when(F.col("on_end").isNull(), 0)
            .when(F.col("time_us") < F.col("on_end"), 1)
            .when(F.col("time_us") == F.col("on_end"), 2)
            .otherwise(3)
        )
        df = df.withColumn("engine_on", F.coalesce(F.col("time_us") <= F.col("on_end"), F.lit(False)))
        df = df.withColumn("_mark", F.struct("label", F.coalesce("on_start", F.lit(-1)).alias("s"), phase.alias("p")))
    else:
        df = df.withColumn("engine_on", F.lit(False)).withColumn("_mark", F.struct("label"))
    df = (
        df.withColumn("_pt", F.lag("time_us").over(here))
        .withColumn("_plat", F.lag("lat").over(here))
        .withColumn("_plon", F.lag("lon").over(here))
        .withColumn("_pm", F.lag("_mark").over(here))
    )
    same = F.col("_pt").isNotNull() & (F.col("_pm") == F.col("_mark")) & (F.col("time_us") - F.col("_pt") < params.max_gap_us)
    df = df.withColumn("_same", F.coalesce(same, F.lit(False)))
    df = df.withColumn("piece_no", F.sum((~F.col("_same")).cast("int")).over(here))
    return df.drop("_mark", "_pm")
