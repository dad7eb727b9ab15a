"""Rejecting bad data: receiver without a fix, clock steps, impossible positions.

Arrival order matters here, so the slice is the log file (or any other run of arrival numbers).
"""

from __future__ import annotations

from functools import reduce
from math import asin, cos, radians, sin, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.functions.geo import haversine_nm
from fairlead.operators import stepwise
from fairlead.operators.scan import scan, settle
from fairlead.params import (
    CLOCK_RESET_S,
    EARTH_RADIUS_NM,
    MAX_PLAUSIBLE_SPEED_KN,
    METRES_PER_NM,
    NO_FIX_HDOP,
    POWER_ON_GAP_S,
    POWER_ON_SETTLE_S,
    SOG_CHECK_FACTOR,
    SOG_CHECK_MAX_DT_S,
    SOG_CHECK_SLACK_M,
    SOG_CHECK_SLACK_MS,
    STRETCH_GAP_S,
    US,
)

RESET_US = CLOCK_RESET_S * US
FILE = ["boat_id", "file_no", "source"]


# Receiver status ----------------------------------------------------------------------------------


def dop_usable(dops: DataFrame) -> DataFrame:
    """Whether each status message says the receiver has a fix. "Nothing available" only counts as a
    lost fix if this source reported a real one before in the same file; whether a message is a real
    fix does not depend on history, so that is a plain look-back."""
    c = F.col
    placeholder = F.coalesce(c("hdop") >= NO_FIX_HDOP, F.lit(False))
    mode_ok = F.coalesce(c("actual_mode").isin(0, 1, 2, 3), F.lit(False))
    before = Window.partitionBy(*FILE).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max((~placeholder & mode_ok).cast("int")).over(before), F.lit(0)) == 1
    silent = c("actual_mode").isNull() & c("hdop").isNull()
    usable = F.when(placeholder, False).when(mode_ok, True).when(silent, ~seen).otherwise(False)
    return dops.withColumn("usable", usable)


def gnss_gate(fixes: DataFrame, dops: DataFrame) -> DataFrame:
    """Adds ``accepted``: the status messages before and after a fix (same file and source) are both
    usable; a missing one counts as usable."""
    marks = dop_usable(dops).select(*FILE, "seq", "usable")
    both = fixes.withColumn("usable", F.lit(None).cast("boolean")).withColumn("_fix", F.lit(True))
    both = both.unionByName(marks.withColumn("_fix", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(*FILE)
    before = F.last("usable", ignorenulls=True).over(w.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("usable", ignorenulls=True).over(w.orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1))
    ok = F.coalesce(before, F.lit(True)) & F.coalesce(after, F.lit(True))
    return both.withColumn("accepted", ok).where("_fix").select(*fixes.columns, "accepted")


def stretches(dropped: DataFrame, keys: list[str], slice_col: str) -> DataFrame:
    """Dropped times grouped into stretches at most 30 s apart: first, last, count. Joined up inside
    a slice first, then across slice borders."""
    gap = STRETCH_GAP_S * US
    here = Window.partitionBy(*keys, slice_col).orderBy("time_us", "seq")
    part = dropped.withColumn("_new", F.coalesce(F.col("time_us") - F.lag("time_us").over(here) > gap, F.lit(True)))
    part = part.withColumn("_no", F.sum(F.col("_new").cast("int")).over(here))
    part = part.groupBy(*keys, slice_col, "_no").agg(F.min("time_us").alias("a"), F.max("time_us").alias("b"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*keys).orderBy("a", "b")
    df = part.withColumn("_new", F.coalesce(F.col("a") - F.lag("b").over(whole) > gap, F.lit(True)))
    df = df.withColumn("_no", F.sum(F.col("_new").cast("int")).over(whole))
    return df.groupBy(*keys, "_no").agg(F.min("a").alias("first_us"), F.max("b").alias("last_us"), F.sum("n").alias("n")).drop("_no")


# Clock steps --------------------------------------------------------------------------------------


def time_regressions(df: DataFrame, keys: list[str], slice_col: str) -> DataFrame:
    """Adds ``kept`` and ``clock_reset``: a row is dropped when its time is less than 24 h before the
    last kept row's; a larger step back is a corrected clock and becomes the new anchor.

    Rows shrink to blocks of ascending time (one per slice plus one per step back). A block leaves an anchor that
    is later than all of it by less than 24 h, and else takes it to its own last time (see ``stepwise``); so the
    anchor before every block follows from the functions of the slices before it, however jittery the clock.
    """
    part = [*keys, slice_col]
    here = Window.partitionBy(*part).orderBy("seq")
    before = F.lag("time_us").over(here)
    rows = df.withColumn("_head", before.isNull() | (F.col("time_us") < before))
    rows = rows.withColumn("no", F.sum(F.col("_head").cast("bigint")).over(here))
    rows = rows.withColumn("_start", F.last(F.when(F.col("_head"), F.col("time_us")), ignorenulls=True).over(here))
    blocks = rows.groupBy(*part, "no").agg(F.min("time_us").alias("_first"), F.max("time_us").alias("_last"))
    items = blocks.select(*part, "no", stepwise.sets_outside(F.col("_last"), F.col("_first") + RESET_US).alias("f"))
    joined = rows.join(stepwise.entry_states(items, keys, slice_col), [*part, "no"])
    # A reset is judged by the first row of a block; the others follow it.
    reset = (F.col("entry") > stepwise.LEAST) & (F.col("entry") - F.col("_start") >= RESET_US)
    kept = reset | (F.col("time_us") >= F.col("entry"))
    return joined.select(*df.columns, kept.alias("kept"), (reset & F.col("_head")).alias("clock_reset"))


def drop_time_regressions(df: DataFrame, keys: list[str], slice_col: str) -> DataFrame:
    return time_regressions(df, keys, slice_col).where("kept").drop("kept", "clock_reset")


def clock_epochs(df: DataFrame, keys: list[str], slice_col: str) -> DataFrame:
    """Kept rows with ``clock_epoch``, the number of clock resets before them. Everything that looks
    along time does so inside one epoch."""
    kept = time_regressions(df, keys, slice_col).where("kept").drop("clock_epoch")
    counted = scan(kept, keys, slice_col, ["seq"], running_sum={"clock_epoch": F.col("clock_reset").cast("bigint")})
    return counted.withColumn("clock_epoch", F.col("clock_epoch").cast("int")).drop("kept", "clock_reset")


def anomaly_report(series: DataFrame, keys: list[str], slice_col: str) -> DataFrame:
    """Per series: dropped rows, first dropped time, clock resets, and files that start before the
    previous file ended."""
    scanned = settle(time_regressions(series, keys, slice_col))
    counts = scanned.groupBy(*keys).agg(
        F.sum((~F.col("kept")).cast("int")).alias("dropped"),
        F.min(F.when(~F.col("kept"), F.struct("seq", "time_us")))["time_us"].alias("first_dropped_us"),
        F.sum(F.col("clock_reset").cast("int")).alias("clock_resets"),
    )
    files = scanned.groupBy(*keys, slice_col).agg(F.min("time_us").alias("a"), F.max("time_us").alias("b"))
    overlap = F.col("a") < F.lag("b").over(Window.partitionBy(*keys).orderBy(slice_col))
    seams = files.withColumn("_o", F.coalesce(overlap, F.lit(False)).cast("int")).groupBy(*keys).agg(F.sum("_o").alias("seam_overlaps"))
    return counts.join(seams, keys)


def file_summaries(series: DataFrame, keys: list[str]) -> DataFrame:
    """Per file and source: rows, first and last time, rows dropped and resets inside the file."""
    inside = time_regressions(series.withColumn("_one", F.lit(0)), [*keys, "file_no"], "_one")
    return inside.groupBy(*keys, "file_no").agg(
        F.count(F.lit(1)).alias("n"), F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"),
        F.sum((~F.col("kept")).cast("int")).alias("dropped"), F.sum(F.col("clock_reset").cast("int")).alias("clock_resets"),
    )


# Impossible positions -----------------------------------------------------------------------------

POINT = "struct<time_us:bigint,lat:double,lon:double>"


def _pair_reason(a: Column, b: Column) -> Column:
    """Why a fix ``b`` cannot follow the accepted fix ``a`` (NULL: it can)."""
    dt = (b["time_us"] - a["time_us"]) / float(US)
    nm = haversine_nm(a["lat"], a["lon"], b["lat"], b["lon"])
    allowed = SOG_CHECK_SLACK_M + dt * (SOG_CHECK_FACTOR * b["sog_ms"] + SOG_CHECK_SLACK_MS)
    off = b["sog_ms"].isNotNull() & (dt <= SOG_CHECK_MAX_DT_S) & (nm * METRES_PER_NM > allowed)
    return (
        F.when(b["time_us"] - a["time_us"] <= -RESET_US, F.lit(None).cast("string"))
        .when(dt < 0, "backward")
        .when(dt == 0, "tie")
        .when(nm / (dt / 3600.0) > MAX_PLAUSIBLE_SPEED_KN, "speed")
        .when(F.coalesce(off, F.lit(False)), "off_sog")
    )


def _nm(a: tuple, b: tuple) -> float:
    p, q = radians(a[1]), radians(b[1])
    h = sin(radians(b[1] - a[1]) / 2) ** 2 + cos(p) * cos(q) * sin(radians(b[2] - a[2]) / 2) ** 2
    return 2 * EARTH_RADIUS_NM * asin(sqrt(min(1.0, h)))


def _follow(anchor: tuple | None, fix: tuple, sog: float | None) -> str | None:
    if anchor is None or fix[0] - anchor[0] <= -RESET_US:
        return None
    dt = (fix[0] - anchor[0]) / US
    if dt <= 0:
        return "backward" if dt < 0 else "tie"
    nm = _nm(anchor, fix)
    if nm / (dt / 3600.0) > MAX_PLAUSIBLE_SPEED_KN:
        return "speed"
    if sog is not None and dt <= SOG_CHECK_MAX_DT_S:
        if nm * METRES_PER_NM > SOG_CHECK_SLACK_M + dt * (SOG_CHECK_FACTOR * sog + SOG_CHECK_SLACK_MS):
            return "off_sog"
    return None


def _walk_slice(pdf: pd.DataFrame) -> pd.DataFrame:
    """One slice (file) of one boat, from a known anchor."""
    pdf = pdf.sort_values("seq", kind="stable")
    first = pdf.iloc[0]
    anchor = None if pd.isna(first["a_time"]) else (int(first["a_time"]), first["a_lat"], first["a_lon"])
    reasons = []
    for t, lat, lon, sog in zip(pdf["time_us"], pdf["lat"], pdf["lon"], pdf["sog_ms"]):
        fix = (int(t), lat, lon)
        reason = _follow(anchor, fix, None if pd.isna(sog) else sog)
        reasons.append(reason)
        if reason is None:
            anchor = fix
    return pd.DataFrame(
        {"boat_id": pdf["boat_id"], "file_no": pdf["file_no"], "seq": pdf["seq"], "reason": pd.Series(reasons, index=pdf.index, dtype=object),
         "o_time": anchor[0], "o_lat": anchor[1], "o_lon": anchor[2]}
    )


def gps_outliers(fixes: DataFrame) -> DataFrame:
    """Adds ``reason`` (NULL: accepted) to fixes that carry the speed known at their time (``sog_ms``).

    Each fix is compared with the last *accepted* one. In a file where every fix can follow the one
    before it, that is the same thing and no row leaves the JVM. The other files are walked, each by
    its own task, from the anchor the previous file ends with. That anchor is first guessed (the last
    row) and corrected in rounds until nothing changes. A round walks only the files whose anchor has
    changed; wrong fixes seldom reach across a file, so there is normally one round. After round n the
    first n files of a boat are final, so there are never more rounds than files.
    """
    keys = ["boat_id", "file_no"]
    here = Window.partitionBy(*keys).orderBy("seq")
    row = F.struct("time_us", "lat", "lon", "sog_ms")
    df = fixes.withColumn("_row", row).withColumn("_pt", F.lag("time_us").over(here))
    df = df.withColumn("_new", F.col("_pt").isNull() | (F.col("time_us") != F.col("_pt")))
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_prev", F.last(F.when(F.col("_new"), F.col("_row")), ignorenulls=True).over(before))
    local = F.when(F.col("_prev").isNull(), F.lit(None).cast("string")).otherwise(_pair_reason(F.col("_prev"), F.col("_row")))
    rows = settle(df.withColumn("reason", local).drop("_pt", "_prev", "_row"))
    point = F.struct("time_us", "lat", "lon")
    bad = F.col("reason").isNotNull() & (F.col("reason") != "tie")
    files = settle(
        rows.groupBy(*keys).agg(
            F.max(bad.cast("int")).alias("dirty"),
            F.min_by(F.struct("time_us", "lat", "lon", "sog_ms"), "seq").alias("head"),
            F.max_by(point, F.when(F.col("_new"), F.col("seq"))).alias("tail"),
        )
    )
    boat = Window.partitionBy("boat_id").orderBy("file_no")
    walks: list[DataFrame] = []
    done: DataFrame | None = None  # per walked file: the round and the anchor it was walked with, and its end
    while True:
        ends = files.select(*keys, "dirty", "head", F.col("tail").cast(POINT).alias("out"))
        if done is not None:
            ends = ends.join(done, keys, "left").withColumn("out", F.coalesce("end", "out"))
        entry = ends.withColumn("entry", F.lag("out").over(boat))
        blocked = F.when(F.col("entry").isNull(), F.lit(None).cast("string")).otherwise(_pair_reason(F.col("entry"), F.col("head")))
        need = (F.col("dirty") == 1) | blocked.isNotNull()
        # Walked now: files that need it and were not, or were with another anchor. No longer walked: the rest of them.
        if done is None:
            open_files = settle(entry.where(need).select(*keys, "entry", F.lit(True).alias("walk")))
        else:
            again = need & (F.col("round").isNull() | ~F.col("anchor").eqNullSafe(F.col("entry")))
            drop = ~need & F.col("round").isNotNull()
            open_files = settle(entry.where(again | drop).select(*keys, "entry", need.alias("walk")))
        if open_files.isEmpty():
            break
        start = open_files.where("walk").select(*keys, F.col("entry.time_us").alias("a_time"), F.col("entry.lat").alias("a_lat"), F.col("entry.lon").alias("a_lon"))
        work = rows.select(*keys, "seq", "time_us", "lat", "lon", "sog_ms").join(start, keys)
        walks.append(
            settle(work.groupBy(*keys).applyInPandas(_walk_slice, "boat_id int, file_no bigint, seq bigint, reason string, o_time bigint, o_lat double, o_lon double"))
        )
        end = F.first(F.struct(F.col("o_time").alias("time_us"), F.col("o_lat").alias("lat"), F.col("o_lon").alias("lon")))
        new = walks[-1].groupBy(*keys).agg(end.cast(POINT).alias("end")).join(open_files.select(*keys, F.col("entry").alias("anchor")), keys)
        new = new.select(*keys, F.lit(len(walks)).alias("round"), "anchor", "end")
        done = settle(new if done is None else done.join(open_files, keys, "left_anti").unionByName(new))
    if done is None:
        return rows.select(*fixes.columns, "reason")
    every = reduce(DataFrame.unionByName, [w.withColumn("round", F.lit(n)) for n, w in enumerate(walks, 1)])
    fixed = every.join(done.select(*keys, "round"), [*keys, "round"]).select(*keys, "seq", F.struct("reason").alias("_w"))
    merged = rows.join(fixed, [*keys, "seq"], "left")
    final = F.when(F.col("_w").isNotNull(), F.col("_w.reason")).otherwise(F.col("reason"))
    return merged.withColumn("reason", final).select(*fixes.columns, "reason")


def reject_gps_outliers(fixes: DataFrame) -> DataFrame:
    return gps_outliers(fixes).where("reason IS NULL").drop("reason")


def drop_severity(judged: DataFrame) -> DataFrame:
    """Speed rejects near a power-on (first fix, or first accepted one after five silent minutes) are
    known receiver behaviour; others are anomalies."""
    accepted = F.col("reason").isNull()
    df = scan(
        judged, ["boat_id"], "file_no", ["seq"],
        fill_before={"_last": F.when(accepted, F.col("time_us"))},
    )
    on = accepted & F.coalesce(F.col("time_us") - F.col("_last") >= POWER_ON_GAP_S * US, F.col("_last").isNull())
    df = scan(df, ["boat_id"], "file_no", ["seq"], fill_before={"_on": F.when(on, F.col("time_us"))})
    df = df.where("reason IN ('speed', 'off_sog')")
    near = F.col("time_us") - F.col("_on") <= POWER_ON_SETTLE_S * US
    return df.withColumn("severity", F.when(near, "info").otherwise("anomaly")).drop("_last", "_on")


def as_of_speed(fixes: DataFrame, sog: DataFrame) -> DataFrame:
    """Fixes with the latest speed at or before them, per clock epoch, in arrival slices."""
    from fairlead.operators.scan import time_slice

    width = 6 * 3600 * US
    keys = ["boat_id", "clock_epoch"]
    samples = sog.groupBy(*keys, time_slice("time_us", width).alias("slice"), "time_us").agg(F.max_by("sog_ms", "seq").alias("_v"))
    probes = fixes.withColumn("slice", time_slice("time_us", width)).withColumn("_tag", F.lit(1))
    both = probes.unionByName(samples.withColumn("_tag", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("seq", F.coalesce("seq", F.lit(-1)))
    filled = scan(both, keys, "slice", ["time_us", "_tag", "seq"], fill={"sog_ms": F.col("_v")})
    return filled.where("_tag = 1").drop("_tag", "_v", "slice")


