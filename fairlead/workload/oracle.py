"""Hand-written SQL of the rules for the checking engine, one named subquery per step.

Each step states the rule over rows, in the way the rule is worded (row numbers, correlated ranges,
a recursive fold where the rule is a fold), not in the way the Spark plan computes it.
"""

from __future__ import annotations

import re

from fairlead.workload import fixture

THR = "(5e-1 * 514444e-6)"
GAP = "600000000"
STOP = "600000000"
LOCK_MAX = "7200000000"
RADIUS = "10e0"
LEG = "2e-1"
KN = "514444e-6"


def hav(a: str, b: str, c: str, d: str, radius: str = "3440065e-3") -> str:
    h = (
        f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) "
        f"* cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    )
    return f"(2e0 * {radius} * asin(sqrt(CASE WHEN {h} > 1 THEN 1e0 ELSE {h} END)))"


def dominant(name: str, by: str = "source") -> str:
    return f"""SELECT boat_id, {by} FROM (SELECT boat_id, {by}, count(*) AS n, min(seq) AS fs FROM {name} GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY boat_id ORDER BY n DESC, fs) = 1"""


def islands(src: str, part: str, gap: str) -> str:
    return f"""SELECT {part}, min(time_us) AS on_start, max(time_us) AS on_end FROM (
      SELECT {part}, time_us, sum(brk) OVER (PARTITION BY {part} ORDER BY time_us) AS g FROM (
        SELECT {part}, time_us, CASE WHEN time_us - lag(time_us) OVER (PARTITION BY {part} ORDER BY time_us) <= {gap} THEN 0 ELSE 1 END AS brk
        FROM (SELECT DISTINCT {part}, time_us FROM {src}))) GROUP BY {part}, g"""


STEPS: dict[str, str] = {"tele": fixture.telemetry_cte()}
for _n in fixture.SERIES:
    STEPS[f"s_{_n}"] = fixture.series_cte(_n)
    STEPS[f"c_{_n}"] = f"SELECT s.* FROM s_{_n} s JOIN ({dominant(f's_{_n}')}) d USING (boat_id, source)"
for _n in ("engine", "rpm", "trip_fuel"):
    STEPS[f"c_{_n}"] = f"SELECT * FROM s_{_n}"
STEPS["gps"] = f"""SELECT f.boat_id, f.source AS fix_source,
    coalesce((SELECT min(s.source) FROM s_sog s WHERE s.boat_id = f.boat_id AND s.source = f.source),
             (SELECT d.source FROM ({dominant('s_sog')}) d WHERE d.boat_id = f.boat_id)) AS sog_source
    FROM ({dominant('s_fixes')}) f"""
STEPS["c_sog"] = "SELECT s.* FROM s_sog s JOIN gps g ON s.boat_id = g.boat_id AND s.source = g.sog_source"
STEPS["fix1"] = "SELECT * FROM c_fixes QUALIFY row_number() OVER (PARTITION BY boat_id, time_us ORDER BY seq) = 1"
for _n in ("sog", "depth", "water_temp", "wind", "stw"):
    STEPS[f"one_{_n}"] = f"SELECT * FROM c_{_n} QUALIFY row_number() OVER (PARTITION BY boat_id, time_us ORDER BY seq DESC) = 1"
STEPS["on_readings"] = "SELECT boat_id, instance, time_us FROM c_engine WHERE fuel_rate_lph > 3e-1"
STEPS["iv"] = islands("on_readings", "boat_id", "60000000")
STEPS["ivi"] = islands("on_readings", "boat_id, instance", "60000000")
STEPS["nav"] = """SELECT f.boat_id, f.seq, f.time_us, f.lat, f.lon, coalesce(s.sog_ms, 0e0) AS sog_ms, s.cog_deg, d.depth_m,
    w.temp_c AS water_temp_c, t.stw_ms, v.speed_ms AS wind_speed_ms, v.angle_deg AS wind_angle_deg, v.reference AS wind_reference
    FROM fix1 f ASOF LEFT JOIN one_sog s ON f.boat_id = s.boat_id AND f.time_us >= s.time_us
    ASOF LEFT JOIN one_depth d ON f.boat_id = d.boat_id AND f.time_us >= d.time_us
    ASOF LEFT JOIN one_water_temp w ON f.boat_id = w.boat_id AND f.time_us >= w.time_us
    ASOF LEFT JOIN one_stw t ON f.boat_id = t.boat_id AND f.time_us >= t.time_us
    ASOF LEFT JOIN one_wind v ON f.boat_id = v.boat_id AND f.time_us >= v.time_us"""
STEPS["nv"] = f"""SELECT nav.*, row_number() OVER (PARTITION BY boat_id ORDER BY time_us) AS n,
    CASE WHEN sog_ms < {THR} THEN 'stationary' ELSE 'moving' END AS label,
    EXISTS (SELECT 1 FROM iv WHERE iv.boat_id = nav.boat_id AND nav.time_us BETWEEN iv.on_start AND iv.on_end) AS engine_on FROM nav"""


def numbered(src: str, label: str, out: str) -> str:
    return f"""SELECT *, sum(CASE WHEN {label} = pl THEN 0 ELSE 1 END) OVER (PARTITION BY boat_id ORDER BY n) AS {out}
      FROM (SELECT *, lag({label}) OVER (PARTITION BY boat_id ORDER BY n) AS pl FROM {src})"""


def drop_pl(sql: str) -> str:
    return f"SELECT * EXCLUDE (pl) FROM ({sql})"


STEPS["rows1"] = drop_pl(numbered("nv", "label", "r1"))
STEPS["runs1"] = "SELECT boat_id, r1, any_value(label) AS label, min(time_us) AS t0, max(time_us) AS t1, count(*) AS n FROM rows1 GROUP BY boat_id, r1"
STEPS["runs2"] = f"""SELECT *, CASE WHEN label = 'stationary' AND t1 - t0 < {STOP} AND NOT coalesce(t0 - pe >= {GAP}, false)
    AND NOT coalesce(ns - t1 >= {GAP}, false) THEN 'moving' ELSE label END AS label2
    FROM (SELECT *, lag(t1) OVER (PARTITION BY boat_id ORDER BY r1) AS pe, lead(t0) OVER (PARTITION BY boat_id ORDER BY r1) AS ns FROM runs1)"""
STEPS["rows2"] = drop_pl(numbered("(SELECT rows1.*, label2 FROM rows1 JOIN runs2 USING (boat_id, r1))", "label2", "r2"))
STEPS["runs2m"] = "SELECT boat_id, r2, any_value(label2) AS label, min(time_us) AS t0, max(time_us) AS t1, count(*) AS n FROM rows2 GROUP BY boat_id, r2"
STEPS["off_spans"] = """SELECT r.*, max(r2) OVER (PARTITION BY boat_id) AS last_r,
    coalesce((SELECT max(on_end) FROM iv WHERE iv.boat_id = r.boat_id AND on_end <= r.t0), r.t0) AS off_start,
    (SELECT min(on_start) FROM iv WHERE iv.boat_id = r.boat_id AND on_start >= r.t1) AS off_end FROM runs2m r"""
STEPS["lock_spans"] = f"""SELECT boat_id, r2, t0, t1, CASE WHEN off_end IS NULL THEN t0 ELSE off_start END AS lo, CASE WHEN off_end IS NULL THEN t1 ELSE off_end END AS hi
    FROM off_spans WHERE label = 'stationary' AND r2 > 1 AND (off_end IS NOT NULL OR r2 < last_r)
    AND CASE WHEN off_end IS NULL THEN t1 - t0 ELSE off_end - off_start END <= {LOCK_MAX}"""
STEPS["lock_spread"] = f"""SELECT boat_id, r2, lo, hi, max({hav('clat', 'clon', 'lat', 'lon')} * 1852e0) AS spread_m FROM (
    SELECT s.boat_id, s.r2, s.lo, s.hi, p.lat, p.lon, avg(p.lat) OVER w AS clat, avg(p.lon) OVER w AS clon
    FROM lock_spans s JOIN nv p ON p.boat_id = s.boat_id AND p.time_us BETWEEN s.lo AND s.hi WINDOW w AS (PARTITION BY s.boat_id, s.r2)) GROUP BY ALL"""
STEPS["rows3"] = drop_pl(
    numbered(
        f"""(SELECT rows2.*, CASE WHEN k.r2 IS NOT NULL THEN 'moving' ELSE label2 END AS label3 FROM rows2
      LEFT JOIN (SELECT boat_id, r2 FROM lock_spread WHERE spread_m <= {RADIUS}) k ON k.boat_id = rows2.boat_id AND k.r2 = rows2.r2)""",
        "label3",
        "r3",
    )
)
# Split at gaps: real rows keep part 0; a moving part before an internal gap adds its last row again as a stay.
STEPS["rows4"] = f"""SELECT *, sum(CASE WHEN pr = r3 AND time_us - pt < {GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY boat_id ORDER BY n) AS part,
    coalesce(nr = r3 AND nt - time_us >= {GAP}, false) AS before_gap FROM (
    SELECT *, lag(r3) OVER w AS pr, lag(time_us) OVER w AS pt, lead(r3) OVER w AS nr, lead(time_us) OVER w AS nt FROM rows3 WINDOW w AS (PARTITION BY boat_id ORDER BY n))"""
STEPS["rows5"] = """SELECT *, dense_rank() OVER (PARTITION BY boat_id ORDER BY part, syn) AS leg FROM (
    SELECT boat_id, n, time_us, lat, lon, sog_ms, depth_m, water_temp_c, cog_deg, stw_ms, wind_speed_ms, wind_angle_deg, wind_reference, engine_on, label3 AS label, part, 0 AS syn FROM rows4
    UNION ALL SELECT boat_id, n, time_us, lat, lon, sog_ms, depth_m, water_temp_c, cog_deg, stw_ms, wind_speed_ms, wind_angle_deg, wind_reference, engine_on, 'stationary', part, 1 FROM rows4 WHERE before_gap AND label3 = 'moving')"""
STEPS["legs"] = f"""SELECT boat_id, leg, any_value(label) AS label, max(syn) AS syn, min(time_us) AS t0, max(time_us) AS t1, count(*) AS n, coalesce(sum(d), 0e0) AS path_nm,
    max({hav('clat', 'clon', 'lat', 'lon')} * 1852e0) AS spread_m FROM (
    SELECT *, {hav('plat', 'plon', 'lat', 'lon')} AS d FROM (
    SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, avg(lat) OVER (PARTITION BY boat_id, leg) AS clat, avg(lon) OVER (PARTITION BY boat_id, leg) AS clon
    FROM rows5 WINDOW w AS (PARTITION BY boat_id, leg ORDER BY n))) GROUP BY boat_id, leg"""
# The fold over legs, one at a time: current trip (number of its result), last kept result and its end.
STEPS["fold"] = """SELECT g.*, w.no AS final_no, CASE WHEN w.out_moving = 1 THEN 'moving' ELSE 'stationary' END AS final_label, w.spliced = 1 AS spliced
    FROM walk w JOIN legs g USING (boat_id, leg)"""
STEPS["walk_in"] = f"""SELECT boat_id, leg, t0, t1, CASE WHEN label = 'moving' THEN 1 ELSE 0 END AS mv, CASE WHEN spread_m <= {RADIUS} THEN 1 ELSE 0 END AS confined,
    CASE WHEN path_nm < {LEG} THEN 1 ELSE 0 END AS short FROM legs"""
# States are integers: -1 stands for "none".
STEPS["walk"] = f"""SELECT boat_id, CAST(0 AS BIGINT) AS leg, CAST(0 AS BIGINT) AS no, 0 AS out_moving, 0 AS spliced, CAST(-1 AS BIGINT) AS trip_no, CAST(-1 AS BIGINT) AS prev_end,
      -1 AS last_moving, CAST(-1 AS BIGINT) AS last_end, CAST(0 AS BIGINT) AS last_no
    FROM (SELECT DISTINCT boat_id FROM walk_in)
    UNION ALL SELECT boat_id, leg,
      CASE WHEN splice = 1 THEN trip WHEN joins = 1 THEN last_no ELSE last_no + 1 END,
      CASE WHEN splice = 1 OR is_real = 1 THEN 1 ELSE 0 END, splice,
      CASE WHEN is_real = 1 THEN last_no + 1 ELSE trip END, t1,
      CASE WHEN splice = 1 THEN last_moving ELSE is_real END,
      CASE WHEN splice = 1 THEN last_end ELSE t1 END,
      CASE WHEN splice = 1 OR joins = 1 THEN last_no ELSE last_no + 1 END
    FROM (SELECT *, CASE WHEN splice = 0 AND is_real = 0 AND last_moving = 0 AND t0 - last_end < {GAP} THEN 1 ELSE 0 END AS joins
      FROM (SELECT *, CASE WHEN mv = 1 AND is_real = 0 AND confined = 0 AND trip >= 0 THEN 1 ELSE 0 END AS splice
      FROM (SELECT *, CASE WHEN mv = 1 AND confined = 0 AND short = 0 THEN 1 ELSE 0 END AS is_real
      FROM (SELECT g.boat_id, g.leg, g.t0, g.t1, g.mv, g.confined, g.short,
        CASE WHEN w.prev_end = -1 OR g.t0 - w.prev_end >= {GAP} THEN -1 ELSE w.trip_no END AS trip, w.last_moving, w.last_end, w.last_no
        FROM walk w JOIN walk_in g ON g.boat_id = w.boat_id AND g.leg = w.leg + 1))))"""
STEPS["rows6"] = "SELECT r.*, f.final_no, f.final_label, f.spliced FROM rows5 r JOIN fold f USING (boat_id, leg)"
STEPS["stay_rows"] = """SELECT *, min(time_us) OVER (PARTITION BY boat_id, final_no) AS s, max(time_us) OVER (PARTITION BY boat_id, final_no) AS e FROM rows6 WHERE final_label = 'stationary'"""
STEPS["stay_restart"] = """SELECT x.boat_id, x.final_no, x.s, x.e, x.n_rows, max(iv.on_end) AS restart FROM (SELECT boat_id, final_no, s, e, count(*) AS n_rows FROM stay_rows GROUP BY ALL) x
    LEFT JOIN iv ON iv.boat_id = x.boat_id AND iv.on_start BETWEEN x.s AND x.e GROUP BY ALL"""
STEPS["stay_move"] = f"""SELECT boat_id, final_no, coalesce({hav('blat', 'blon', 'alat', 'alon')} * 1852e0 > {RADIUS}, false) AS narrowed FROM (
    SELECT r.boat_id, r.final_no, avg(lat) FILTER (time_us < restart) AS blat, avg(lon) FILTER (time_us < restart) AS blon,
      avg(lat) FILTER (time_us >= restart) AS alat, avg(lon) FILTER (time_us >= restart) AS alon
    FROM stay_rows r JOIN stay_restart USING (boat_id, final_no) GROUP BY ALL)"""
STEPS["stays"] = f"""SELECT boat_id, final_no, s AS start_us, e AS end_us, n_rows, coalesce(l3, l2, l1, l0) AS lat, coalesce(o3, o2, o1, o0) AS lon FROM (
    SELECT r.boat_id, r.final_no, any_value(x.s) AS s, any_value(x.e) AS e, any_value(x.n_rows) AS n_rows,
      avg(lat) AS l0, avg(lat) FILTER (NOT engine_on) AS l1, avg(lat) FILTER (slow) AS l2, avg(lat) FILTER (slow AND NOT engine_on) AS l3,
      avg(lon) AS o0, avg(lon) FILTER (NOT engine_on) AS o1, avg(lon) FILTER (slow) AS o2, avg(lon) FILTER (slow AND NOT engine_on) AS o3
    FROM (SELECT *, sog_ms <= {THR} / 2 AS slow FROM stay_rows) r JOIN stay_restart x USING (boat_id, final_no) JOIN stay_move m USING (boat_id, final_no)
    WHERE NOT m.narrowed OR r.time_us >= x.restart GROUP BY r.boat_id, r.final_no)"""
STEPS["trip_rows0"] = "SELECT * FROM rows6 WHERE final_label = 'moving'"
STEPS["ends0"] = """SELECT boat_id, final_no, min(time_us) AS f_us, max(time_us) AS l_us, arg_min(lat, n) AS f_lat, arg_min(lon, n) AS f_lon, arg_max(lat, n) AS l_lat, arg_max(lon, n) AS l_lon, count(*) AS n_rows
    FROM trip_rows0 GROUP BY ALL"""
STEPS["ends"] = f"""SELECT t.boat_id, t.final_no, t.n_rows, p.start_us AS prev_start, p.end_us AS prev_end, q.start_us AS next_start, q.end_us AS next_end,
    CASE WHEN p.end_us IS NULL OR t.f_us - p.end_us >= {GAP} THEN t.f_us ELSE p.end_us END AS depart_us,
    CASE WHEN q.start_us IS NULL OR q.start_us - t.l_us >= {GAP} THEN t.l_us ELSE q.start_us END AS arrive_us,
    coalesce(p.lat, t.f_lat) AS depart_lat, coalesce(p.lon, t.f_lon) AS depart_lon, coalesce(q.lat, t.l_lat) AS arrive_lat, coalesce(q.lon, t.l_lon) AS arrive_lon
    FROM ends0 t LEFT JOIN stays p ON p.boat_id = t.boat_id AND p.final_no = t.final_no - 1 LEFT JOIN stays q ON q.boat_id = t.boat_id AND q.final_no = t.final_no + 1"""
STEPS["pairs"] = f"""SELECT *, {hav('plat', 'plon', 'lat', 'lon')} AS d, CASE WHEN time_us - pt < {GAP} THEN time_us - pt END AS dt FROM (
    SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(time_us) OVER w AS pt FROM trip_rows0 WINDOW w AS (PARTITION BY boat_id, final_no ORDER BY n))"""
STEPS["track_stats"] = f"""SELECT boat_id, final_no, coalesce(sum(d), 0e0) AS distance_nm, coalesce(sum(dt), 0) AS duration_us, avg(sog_ms / {KN}) AS avg_speed_kn, max(sog_ms / {KN}) AS max_speed_kn,
    min(n) AS n0 FROM pairs GROUP BY ALL"""
STEPS["trips"] = """SELECT e.*, s.distance_nm, s.duration_us, s.avg_speed_kn, s.max_speed_kn,
    (SELECT r.time_us FROM trip_rows0 r WHERE r.boat_id = e.boat_id AND r.final_no = e.final_no ORDER BY r.sog_ms DESC, r.n LIMIT 1) AS max_speed_us,
    row_number() OVER (PARTITION BY e.boat_id ORDER BY depart_us, e.final_no) AS trip_no
    FROM ends e JOIN track_stats s USING (boat_id, final_no) WHERE s.distance_nm >= 1e-1"""
STEPS["track"] = "SELECT r.*, t.trip_no FROM trip_rows0 r JOIN trips t USING (boat_id, final_no)"


def in_trip(name: str, where: str = "true") -> str:
    return f"SELECT s.*, t.trip_no, t.depart_us, t.arrive_us, t.max_speed_us FROM c_{name} s JOIN trips t ON s.boat_id = t.boat_id AND s.time_us BETWEEN t.depart_us AND t.arrive_us WHERE {where}"


for _n in ("engine", "rpm", "trip_fuel", "battery", "outside_temp", "humidity", "attitude"):
    STEPS[f"t_{_n}"] = in_trip(_n)

RECURSIVE = {"walk"}


# Doubles: f 6 decimals; g 8 and p 10, for means of values (of positions) with few decimals, which often
# end in a 5 one place later; e 4, for distances of a few metres from a mean position.
DECIMALS = {"f": 6, "g": 8, "p": 10, "e": 4}
CASTS = {
    **{k: "round(CAST({e} AS DOUBLE), " + str(n) + ")" for k, n in DECIMALS.items()},
    "i": "CAST({e} AS BIGINT)",
    "s": "CAST({e} AS VARCHAR)",
    "b": "CAST({e} AS BOOLEAN)",
}


def pick(columns: str, rest: str) -> str:
    """``name:type`` or ``name:type=expression`` separated by ``|``, as a SELECT over ``rest``."""
    out = []
    for item in columns.split("|"):
        head, _, expr = item.strip().partition("=")
        name, kind = head.strip().split(":")
        out.append(CASTS[kind].format(e=(expr or name).strip()) + f" AS {name}")
    return f"SELECT {', '.join(out)} {rest}"


def add_step(name: str, sql: str, recursive: bool = False) -> None:
    STEPS[name] = sql
    if recursive:
        RECURSIVE.add(name)


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", sql))
    return [n for n in STEPS if n in words]


def oracle(final: str) -> str:
    """The final query with the steps it needs, in dependency order."""
    order: list[str] = []
    state: dict[str, int] = {}

    def visit(name: str) -> None:
        if state.get(name):
            return
        state[name] = 1
        for other in _needs(STEPS[name]):
            if other != name:
                visit(other)
        order.append(name)

    for name in _needs(final):
        visit(name)
    if not order:
        return final
    parts = ", ".join(f"{n} AS ({STEPS[n]})" for n in order)
    keyword = "WITH RECURSIVE" if any(n in RECURSIVE for n in order) else "WITH"
    return f"{keyword} {parts} {final}"


# The track as drawn: the raw rows plus a point at the stay's position at both ends, where it differs.
STEPS["track_pos"] = "SELECT *, row_number() OVER (PARTITION BY boat_id, trip_no ORDER BY n) AS k, count(*) OVER (PARTITION BY boat_id, trip_no) AS cnt FROM track"
STEPS["marked"] = """SELECT boat_id, trip_no, row_number() OVER (PARTITION BY boat_id, trip_no ORDER BY k) AS pos, count(*) OVER (PARTITION BY boat_id, trip_no) AS points, * EXCLUDE (boat_id, trip_no) FROM (
    SELECT boat_id, trip_no, k, time_us, lat, lon, sog_ms, depth_m, water_temp_c, cog_deg, stw_ms, wind_speed_ms, wind_angle_deg, wind_reference FROM track_pos
    UNION ALL SELECT t.boat_id, t.trip_no, 0, t.depart_us, t.depart_lat, t.depart_lon, 0e0, p.depth_m, p.water_temp_c, NULL, NULL, NULL, NULL, NULL FROM trips t JOIN track_pos p USING (boat_id, trip_no) WHERE p.k = 1 AND (p.lat <> t.depart_lat OR p.lon <> t.depart_lon)
    UNION ALL SELECT t.boat_id, t.trip_no, p.cnt + 1, t.arrive_us, t.arrive_lat, t.arrive_lon, 0e0, p.depth_m, p.water_temp_c, NULL, NULL, NULL, NULL, NULL FROM trips t JOIN track_pos p USING (boat_id, trip_no) WHERE p.k = p.cnt AND (p.lat <> t.arrive_lat OR p.lon <> t.arrive_lon))"""
STEPS["state"] = """SELECT *, (last_data_us - stationary_since_us) / 1e6 AS stationary_s, (last_data_us - engine_off_since_us) / 1e6 AS engine_off_s FROM (
    SELECT boat_id, last_data_us, lat, lon, underway, stationary_since_us, running AS engine_running, CASE WHEN NOT running THEN coalesce(last_on, first_us) END AS engine_off_since_us FROM (
    SELECT *, coalesce(last_data_us - last_on <= 60000000, false) AS running FROM (
    SELECT v.boat_id, max(v.time_us) AS last_data_us, min(v.time_us) AS first_us, arg_max(v.lat, v.time_us) AS lat, arg_max(v.lon, v.time_us) AS lon,
      (SELECT arg_max(f.final_label, f.final_no) = 'moving' FROM fold f WHERE f.boat_id = v.boat_id) AS underway,
      (SELECT CASE WHEN arg_max(f.final_label, f.final_no) = 'stationary' THEN (SELECT min(g.t0) FROM fold g WHERE g.boat_id = v.boat_id AND g.final_no = max(f.final_no)) END FROM fold f WHERE f.boat_id = v.boat_id) AS stationary_since_us,
      (SELECT max(on_end) FROM iv WHERE iv.boat_id = v.boat_id) AS last_on FROM nv v GROUP BY v.boat_id)))"""
