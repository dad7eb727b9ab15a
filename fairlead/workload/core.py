"""Queries: source choice, alignment, runs, stays, trips."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlead.operators import align, engine, logbook, runs, select, stays
from fairlead.operators.align import KEYS
from fairlead.workload import fixture
from fairlead.workload.oracle import dominant
from fairlead.workload.registry import PARAMS, chosen_tables, landed, query, season


def _tele(spark, sf):
    return landed(spark, sf)


@query(
    "sel1_dominant_source",
    "series:s | boat_id:i | source:i | n:i",
    "FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS series, boat_id, source, (SELECT count(*) FROM s_{n} x WHERE x.boat_id = d.boat_id AND x.source = d.source) AS n FROM ({dominant('s_' + n)}) d"
        for n in select.BY_SOURCE
    )
    + ")",
)
def sel1(spark, sf):
    tele = _tele(spark, sf)
    parts = []
    for n in select.BY_SOURCE:
        counts = select.count_by(fixture.series(tele, n), "source")
        parts.append(select.top_choice(counts, "source").withColumn("series", F.lit(n)))
    return reduce(DataFrame.unionByName, parts)


@query("sel2_primary_gps", "boat_id:i | fix_source:i | sog_source:i", "FROM gps")
def sel2(spark, sf):
    tele = _tele(spark, sf)
    return select.primary_gps(fixture.series(tele, "fixes"), fixture.series(tele, "sog"))


@query(
    "sel3_dominant_engine",
    "series:s | boat_id:i | instance:i | n:i",
    "FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS series, boat_id, instance, count(*) AS n FROM s_{n} JOIN ({dominant('s_engine', 'instance')}) USING (boat_id, instance) GROUP BY ALL"
        for n in ("engine", "trip_fuel", "rpm")
    )
    + ")",
)
def sel3(spark, sf):
    tele = _tele(spark, sf)
    names = ["engine", "trip_fuel", "rpm"]
    kept = select.keep_dominant_engine(*[fixture.series(tele, n) for n in names])
    parts = [
        df.groupBy("boat_id", "instance").agg(F.count(F.lit(1)).alias("n")).withColumn("series", F.lit(n))
        for n, df in zip(names, kept)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "sel4_attitude_source",
    "boat_id:i | source:i | n:i",
    f"FROM (SELECT boat_id, source, count(*) AS n FROM s_attitude JOIN ({dominant('s_attitude')}) USING (boat_id, source) GROUP BY ALL)",
)
def sel4(spark, sf):
    # From per-file counts, without reading the samples again.
    per_file = fixture.series(_tele(spark, sf), "attitude").groupBy("boat_id", "file_no", "source").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")
    )
    counts = per_file.groupBy("boat_id", "source").agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"))
    return select.top_choice(counts, "source")


_SEASON_SERIES = ["fixes", "sog", "engine", "rpm", "trip_fuel", "depth", "water_temp", "outside_temp", "humidity", "stw", "wind", "battery", "attitude"]


@query(
    "sel5_season_inputs",
    "series:s | boat_id:i | n:i | first_us:i | last_us:i",
    "FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS series, boat_id, count(*) AS n, min(time_us) AS first_us, max(time_us) AS last_us FROM c_{n} GROUP BY ALL"
        for n in _SEASON_SERIES
    ).replace("FROM c_fixes", "FROM (SELECT f.* FROM s_fixes f JOIN gps g ON f.boat_id = g.boat_id AND f.source = g.fix_source)")
    + ")",
)
def sel5(spark, sf):
    tables = chosen_tables(spark, sf)
    out = None
    for n in _SEASON_SERIES:
        part = tables[n].groupBy("boat_id").agg(
            F.count(F.lit(1)).alias("n"), F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us")
        ).withColumn("series", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


NAV = "boat_id:i | seq:i | time_us:i | lat:p | lon:p | sog_ms:f | cog_deg:f | depth_m:f | water_temp_c:f | stw_ms:f | wind_speed_ms:f | wind_angle_deg:f | wind_reference:i"


@query("jn1_merge_nav", NAV, "FROM nav")
def jn1(spark, sf):
    tables = chosen_tables(spark, sf)
    samples = {n: tables[n] for n in ("sog", "depth", "water_temp", "wind", "stw")}
    return align.merge_nav(align.first_of_ties(tables["fixes"]), samples, PARAMS)


RUN = "boat_id:i | run_no:i | label:s | t0:i | t1:i | n:i"


@query("seg1_classify_runs", RUN, "FROM (SELECT boat_id, r1 AS run_no, label, t0, t1, n FROM runs1)")
def seg1(spark, sf):
    pieces = runs.make_pieces(season(spark, sf).rows, PARAMS)
    return runs.run_table(runs.classify_runs(pieces), "label", "run_no")


@query("seg2_merge_short_stops", RUN, "FROM (SELECT boat_id, r1 AS run_no, label2 AS label, t0, t1, n FROM runs2)")
def seg2(spark, sf):
    return runs.run_table(season(spark, sf).stop_pieces, "label_stop", "run_no")


@query("seg3_merge_adjacent", RUN, "FROM (SELECT boat_id, r2 AS run_no, label, t0, t1, n FROM runs2m)")
def seg3(spark, sf):
    return runs.run_table(season(spark, sf).stop_pieces, "label_stop", "run_stop").withColumnRenamed("run_stop", "run_no")


@query(
    "jn7_engine_off_span",
    "boat_id:i | run_no:i | t0:i | t1:i | off_start:i | off_end:i",
    "FROM (SELECT boat_id, r2 AS run_no, t0, t1, off_start, off_end FROM off_spans)",
)
def jn7(spark, sf):
    s = season(spark, sf)
    table = runs.run_table(s.stop_pieces, "label_stop", "run_stop")
    return runs.engine_off_spans(table, s.intervals).withColumnRenamed("run_stop", "run_no")


@query(
    "seg4_locks",
    "boat_id:i | run_no:i | lo:i | hi:i | spread_m:e | is_lock:b",
    "FROM (SELECT boat_id, r2 AS run_no, lo, hi, spread_m, spread_m <= 10 AS is_lock FROM lock_spread)",
)
def seg4(spark, sf):
    s = season(spark, sf)
    spans = runs.lock_candidates(s.stop_pieces, s.intervals, PARAMS)
    spread = runs.spread_m(spans, s.rows, PARAMS, ["run_stop", "lo", "hi"])
    return spread.withColumnRenamed("run_stop", "run_no").withColumn("is_lock", F.col("spread_m") <= PARAMS.lock_radius_m)


LEG = "boat_id:i | leg:i | label:s | syn:i | t0:i | t1:i | n:i"


@query("seg5_split_on_gaps", LEG, "FROM legs")
def seg5(spark, sf):
    return season(spark, sf).legs.withColumnsRenamed({"run_gap": "leg", "synthetic": "syn"})


@query("ag9_spread", "boat_id:i | leg:i | t0:i | spread_m:e", "FROM legs WHERE syn = 0")
def ag9(spark, sf):
    s = season(spark, sf)
    spans = s.legs.where("synthetic = 0").withColumn("lo", F.col("t0")).withColumn("hi", F.col("t1"))
    return runs.spread_m(spans.drop("spread_m"), s.rows, PARAMS, ["run_gap", "t0"]).withColumnRenamed("run_gap", "leg")


@query(
    "seg6_fold_negligible_legs",
    "boat_id:i | leg:i | t0:i | path_nm:f | final_no:i | final_label:s | spliced:b",
    "FROM fold",
)
def seg6(spark, sf):
    return season(spark, sf).folded.withColumnRenamed("run_gap", "leg")


STAY = "boat_id:i | final_no:i | start_us:i | end_us:i | lat:p | lon:p"


@query("seg7_settled_position", "boat_id:i | final_no:i | lat:p | lon:p", "FROM stays")
def seg7(spark, sf):
    return season(spark, sf).stays


@query("seg8_stays", STAY + " | n_rows:i", "FROM stays")
def seg8(spark, sf):
    return season(spark, sf).stays


@query(
    "jn6_neighbour_stays",
    "boat_id:i | final_no:i | prev_start:i | prev_end:i | next_start:i | next_end:i",
    "FROM ends",
)
def jn6(spark, sf):
    df = season(spark, sf).ends
    c = F.col
    return df.select(
        "boat_id", "final_no", c("prev_stay.start_us").alias("prev_start"), c("prev_stay.end_us").alias("prev_end"),
        c("next_stay.start_us").alias("next_start"), c("next_stay.end_us").alias("next_end"),
    )


@query(
    "seg9_trip_endpoints",
    "boat_id:i | final_no:i | depart_us:i | arrive_us:i | depart_lat:p | depart_lon:p | arrive_lat:p | arrive_lon:p | n_rows:i",
    "FROM ends",
)
def seg9(spark, sf):
    return season(spark, sf).ends


TRACK = "boat_id:i | trip_no:i | pos:i | time_us:i | lat:p | lon:p | sog_ms:f | depth_m:f | water_temp_c:f | cog_deg:f"


@query("seg10_marker_splice", TRACK, "FROM marked")
def seg10(spark, sf):
    s = season(spark, sf)
    return logbook.marked_track(s.trips, s.track, PARAMS)


@query("seg11_engine_on_intervals", "boat_id:i | instance:i | on_start:i | on_end:i", "FROM (SELECT boat_id, NULL AS instance, on_start, on_end FROM iv UNION ALL SELECT boat_id, instance, on_start, on_end FROM ivi)")
def seg11(spark, sf):
    e = chosen_tables(spark, sf)["engine"]
    overall = engine.on_intervals(e, PARAMS).withColumn("instance", F.lit(None).cast("int"))
    return overall.unionByName(engine.on_intervals(e, PARAMS, per_instance=True), allowMissingColumns=True)


STATE = "boat_id:i | last_data_us:i | lat:p | lon:p | underway:b | stationary_since_us:i | engine_running:b | engine_off_since_us:i | stationary_s:f | engine_off_s:f"


@query("seg12_boat_state", STATE, "FROM state")
def seg12(spark, sf):
    return season(spark, sf).state


def _at_stay_end(s):
    """Boat state at the end of every stay: what the harbour rule sees when data stops there."""
    w = Window.partitionBy(*KEYS).orderBy("final_no")
    st = s.stays
    on = s.intervals
    joined = st.join(on, KEYS).where("on_start <= end_us").groupBy(*KEYS, "final_no").agg(F.max("on_end").alias("on_end"))
    df = st.join(joined, [*KEYS, "final_no"], "left")
    running = F.coalesce(F.col("end_us") - F.col("on_end") <= 60_000_000, F.lit(False))
    first = F.min("start_us").over(w)
    return df.select(
        "boat_id", "final_no", "end_us", F.lit(False).alias("underway"),
        ((F.col("end_us") - F.col("start_us")) / 1e6).alias("stationary_s"),
        running.alias("engine_running"),
        F.when(~running, (F.col("end_us") - F.coalesce("on_end", first)) / 1e6).alias("engine_off_s"),
    )


@query(
    "seg13_in_harbour",
    "boat_id:i | final_no:i | stationary_s:f | engine_off_s:f | in_harbour:b",
    """FROM (SELECT *, floor(stationary_s) >= 1800 AND NOT running AND floor(engine_off_s) >= 600 AS in_harbour FROM (
      SELECT *, CASE WHEN NOT running THEN (end_us - coalesce(on_end, first_us)) / 1e6 END AS engine_off_s FROM (
      SELECT *, coalesce(end_us - on_end <= 60000000, false) AS running FROM (
      SELECT s.boat_id, s.final_no, s.end_us, (s.end_us - s.start_us) / 1e6 AS stationary_s,
        (SELECT max(on_end) FROM iv WHERE iv.boat_id = s.boat_id AND iv.on_start <= s.end_us) AS on_end,
        (SELECT min(x.start_us) FROM stays x WHERE x.boat_id = s.boat_id) AS first_us FROM stays s))))""",
)
def seg13(spark, sf):
    return stays.in_harbour(_at_stay_end(season(spark, sf)))


TRIP = "boat_id:i | trip_no:i | depart_us:i | arrive_us:i | depart_lat:p | depart_lon:p | arrive_lat:p | arrive_lon:p | distance_nm:f | duration_us:i | avg_speed_kn:f | max_speed_kn:f | max_speed_us:i"


@query("dq9_min_distance", "boat_id:i | trip_no:i | distance_nm:f", "FROM trips")
def dq9(spark, sf):
    return season(spark, sf).trips
