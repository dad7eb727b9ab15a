"""Queries: data quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.operators import quality
from fairlead.workload import fixture
from fairlead.workload.oracle import add_step, hav
from fairlead.workload.registry import landed, query


def _series(spark, sf, name, bad_time=False):
    return fixture.series(landed(spark, sf), name, "bad_time_us" if bad_time else "time_us")


add_step(
    "dop_judged",
    """SELECT *, CASE WHEN hdop >= 50 THEN false WHEN actual_mode IN (0, 1, 2, 3) THEN true WHEN actual_mode IS NULL AND hdop IS NULL THEN NOT seen ELSE false END AS usable FROM (
    SELECT *, EXISTS (SELECT 1 FROM s_dops p WHERE p.boat_id = d.boat_id AND p.file_no = d.file_no AND p.source = d.source AND p.seq < d.seq
      AND p.actual_mode IN (0, 1, 2, 3) AND NOT coalesce(p.hdop >= 50, false)) AS seen FROM s_dops d)""",
)


@query("dq1_fix_usable", "boat_id:i | file_no:i | source:i | seq:i | usable:b", "FROM dop_judged")
def dq1(spark, sf):
    return quality.dop_usable(_series(spark, sf, "dops"))


add_step(
    "gated",
    """SELECT f.boat_id, f.file_no, f.source, f.seq, f.time_us,
    coalesce((SELECT arg_max(usable, d.seq) FROM dop_judged d WHERE d.boat_id = f.boat_id AND d.file_no = f.file_no AND d.source = f.source AND d.seq < f.seq), true)
    AND coalesce((SELECT arg_min(usable, d.seq) FROM dop_judged d WHERE d.boat_id = f.boat_id AND d.file_no = f.file_no AND d.source = f.source AND d.seq > f.seq), true) AS accepted FROM s_fixes f""",
)


@query("dq2_gnss_gate", "boat_id:i | file_no:i | source:i | seq:i | accepted:b", "FROM gated")
def dq2(spark, sf):
    return quality.gnss_gate(_series(spark, sf, "fixes"), _series(spark, sf, "dops"))


@query(
    "dq6_stretches",
    "boat_id:i | source:i | first_us:i | last_us:i | n:i",
    """FROM (SELECT boat_id, source, min(time_us) AS first_us, max(time_us) AS last_us, count(*) AS n FROM (
      SELECT *, sum(CASE WHEN time_us - pt <= 30000000 THEN 0 ELSE 1 END) OVER (PARTITION BY boat_id, source ORDER BY time_us, seq) AS g FROM (
      SELECT *, lag(time_us) OVER (PARTITION BY boat_id, source ORDER BY time_us, seq) AS pt FROM gated WHERE NOT accepted)) GROUP BY boat_id, source, g)""",
)
def dq6(spark, sf):
    gated = quality.gnss_gate(_series(spark, sf, "fixes"), _series(spark, sf, "dops"))
    return quality.stretches(gated.where("NOT accepted"), ["boat_id", "source"], "file_no")


# The sequential rules as recursive folds, one row at a time in arrival order.
add_step("late_series", " UNION ALL ".join(f"SELECT '{n}' AS series, boat_id, source, file_no, seq, bad_time_us AS t FROM tele WHERE {fixture.SERIES[n][0]}" for n in fixture.SERIES))
add_step("reg_in", "SELECT *, row_number() OVER (PARTITION BY series, boat_id ORDER BY seq) AS n FROM late_series")
add_step(
    "reg_walk",
    """SELECT series, boat_id, n, seq, file_no, t, t AS anchor, 1 AS kept, 0 AS reset FROM reg_in WHERE n = 1
    UNION ALL SELECT r.series, r.boat_id, r.n, r.seq, r.file_no, r.t, CASE WHEN r.t >= w.anchor OR w.anchor - r.t >= 86400000000 THEN r.t ELSE w.anchor END,
      CASE WHEN r.t >= w.anchor OR w.anchor - r.t >= 86400000000 THEN 1 ELSE 0 END, CASE WHEN w.anchor - r.t >= 86400000000 THEN 1 ELSE 0 END
    FROM reg_walk w JOIN reg_in r ON r.series = w.series AND r.boat_id = w.boat_id AND r.n = w.n + 1""",
    recursive=True,
)


def _late_series(spark, sf):
    """Arrivals of every series, with the faulty clock."""
    tele = landed(spark, sf)
    columns = ["boat_id", "source", "file_no", "seq", "time_us"]
    return reduce(DataFrame.unionByName, [fixture.series(tele, n, "bad_time_us").select(F.lit(n).alias("series"), *columns) for n in fixture.SERIES])


@query("dq3_time_regressions", "series:s | boat_id:i | seq:i | time_us:i | kept:b | clock_reset:b", "FROM (SELECT series, boat_id, seq, t AS time_us, kept = 1 AS kept, reset = 1 AS clock_reset FROM reg_walk)")
def dq3(spark, sf):
    return quality.time_regressions(_late_series(spark, sf), ["series", "boat_id"], "file_no")


@query(
    "dq8_anomaly_report",
    "series:s | boat_id:i | dropped:i | first_dropped_us:i | clock_resets:i | seam_overlaps:i",
    """FROM (SELECT series, boat_id, count(*) FILTER (kept = 0) AS dropped, arg_min(t, seq) FILTER (kept = 0) AS first_dropped_us, sum(reset) AS clock_resets FROM reg_walk GROUP BY series, boat_id)
      JOIN (SELECT series, boat_id, count(*) FILTER (a < pb) AS seam_overlaps FROM (SELECT series, boat_id, a, lag(b) OVER (PARTITION BY series, boat_id ORDER BY file_no) AS pb FROM
        (SELECT series, boat_id, file_no, min(t) AS a, max(t) AS b FROM reg_walk GROUP BY ALL)) GROUP BY series, boat_id) USING (series, boat_id)""",
)
def dq8(spark, sf):
    return quality.anomaly_report(_late_series(spark, sf), ["series", "boat_id"], "file_no")


add_step("fix_in", "SELECT boat_id, file_no, seq, bad_time_us AS t, bad_lat_raw * 1e-7 AS lat, lon_raw * 1e-7 AS lon, sog_raw * 1e-2 AS sog, row_number() OVER (PARTITION BY boat_id ORDER BY seq) AS n FROM tele WHERE kind = 'view'")
add_step(
    "fix_walk",
    f"""SELECT boat_id, n, seq, t, lat AS alat, lon AS alon, t AS at_us, 0 AS why, t AS session FROM fix_in WHERE n = 1
    UNION ALL SELECT boat_id, n, seq, t, CASE WHEN why = 0 THEN lat ELSE alat END, CASE WHEN why = 0 THEN lon ELSE alon END, CASE WHEN why = 0 THEN t ELSE at_us END, why,
      CASE WHEN why = 0 AND t - at_us >= 300000000 THEN t ELSE session END FROM (
    SELECT *, CASE WHEN t - at_us <= -86400000000 THEN 0 WHEN t < at_us THEN 1 WHEN t = at_us THEN 2 WHEN nm / ((t - at_us) / 36e8) > 60 THEN 3
      WHEN t - at_us <= 30000000 AND nm * 1852 > 10 + (t - at_us) / 1e6 * (3 * sog + 15e-1) THEN 4 ELSE 0 END AS why FROM (
    SELECT r.boat_id, r.n, r.seq, r.t, r.lat, r.lon, r.sog, w.alat, w.alon, w.at_us, w.session, {hav('w.alat', 'w.alon', 'r.lat', 'r.lon')} AS nm
    FROM fix_walk w JOIN fix_in r ON r.boat_id = w.boat_id AND r.n = w.n + 1))""",
    recursive=True,
)
_WHY = "CASE why WHEN 1 THEN 'backward' WHEN 2 THEN 'tie' WHEN 3 THEN 'speed' WHEN 4 THEN 'off_sog' END"


def _bad_fixes(spark, sf):
    c = F.col
    return landed(spark, sf).where("kind = 'view'").select(
        "boat_id", "file_no", "seq", c("bad_time_us").alias("time_us"), (c("bad_lat_raw") * 1e-7).alias("lat"), (c("lon_raw") * 1e-7).alias("lon"), (c("sog_raw") * 1e-2).alias("sog_ms")
    )


@query("dq4_gps_outliers", "boat_id:i | seq:i | reason:s", f"FROM (SELECT boat_id, seq, {_WHY} AS reason FROM fix_walk)")
def dq4(spark, sf):
    return quality.gps_outliers(_bad_fixes(spark, sf))


@query(
    "dq5_drop_severity",
    "boat_id:i | seq:i | reason:s | severity:s",
    f"FROM (SELECT boat_id, seq, {_WHY} AS reason, CASE WHEN t - session <= 300000000 THEN 'info' ELSE 'anomaly' END AS severity FROM fix_walk WHERE why IN (3, 4))",
)
def dq5(spark, sf):
    return quality.drop_severity(quality.gps_outliers(_bad_fixes(spark, sf)))


add_step("file_in", "SELECT *, row_number() OVER (PARTITION BY series, boat_id, source, file_no ORDER BY seq) AS n FROM late_series")
add_step(
    "file_walk",
    """SELECT series, boat_id, source, file_no, n, t, t AS anchor, 1 AS kept, 0 AS reset FROM file_in WHERE n = 1
    UNION ALL SELECT r.series, r.boat_id, r.source, r.file_no, r.n, r.t, CASE WHEN r.t >= w.anchor OR w.anchor - r.t >= 86400000000 THEN r.t ELSE w.anchor END,
      CASE WHEN r.t >= w.anchor OR w.anchor - r.t >= 86400000000 THEN 1 ELSE 0 END, CASE WHEN w.anchor - r.t >= 86400000000 THEN 1 ELSE 0 END
    FROM file_walk w JOIN file_in r ON r.series = w.series AND r.boat_id = w.boat_id AND r.source = w.source AND r.file_no = w.file_no AND r.n = w.n + 1""",
    recursive=True,
)


@query(
    "per7_file_summaries",
    "series:s | boat_id:i | source:i | file_no:i | n:i | first_us:i | last_us:i | dropped:i | clock_resets:i",
    "FROM (SELECT series, boat_id, source, file_no, count(*) AS n, min(t) AS first_us, max(t) AS last_us, count(*) FILTER (kept = 0) AS dropped, sum(reset) AS clock_resets FROM file_walk GROUP BY ALL)",
)
def per7(spark, sf):
    return quality.file_summaries(_late_series(spark, sf), ["series", "boat_id", "source"])
