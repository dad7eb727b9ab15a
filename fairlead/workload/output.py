"""Queries: whole builds, texts and sinks, framing, incremental runs, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fairlead.operators import align, periods, rows, select
from fairlead.operators import frames as fr
from fairlead.operators.scan import compiled_methods, settle, shared_folder
from fairlead.plans import incremental
from fairlead.plans.logbook import Logbook
from fairlead.plans.trips import Season, build_trips
from fairlead.sinks import logbook as sink
from fairlead.sources import ebl
from fairlead.streaming import live
from fairlead.workload import fixture
from fairlead.workload.core import TRIP as TRIP_COLUMNS
from fairlead.workload.figures import marked
from fairlead.workload.frames import _POS
from fairlead.workload.lookups import landmark_table, log_entries, marine_table, place_table, weather_table
from fairlead.workload.oracle import add_step, hav
from fairlead.workload.registry import PARAMS, landed, query, season


@query("seg14_build_trips", TRIP_COLUMNS, "FROM trips")
def seg14(spark, sf):
    return build_trips(fixture.all_series(landed(spark, sf)), PARAMS).trips


# Framing: the records of a file glued together with their escapes, then taken apart again. ------------


def _files(spark, sf):
    recs = landed(spark, sf, "records")
    pairs = F.regexp_replace(F.hex("body"), "(..)", "$1 ")
    stuffed = F.replace(F.replace(pairs, F.lit("1B "), F.lit("1B1B ")), F.lit(" "), F.lit(""))
    one = F.concat(F.lit("1B01"), stuffed, F.lit("1B0A"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", one.alias("t"))))
    text = F.array_join(F.transform(ordered, lambda x: x["t"]), "00")
    path = F.format_string("boat=%d/EBL%06d/%06d_%03d.ebl", "boat_id", F.expr("cast(file_no div 100 as int)"), F.expr("cast(file_no div 100 as int)"), F.expr("cast(file_no % 100 as int)"))
    return recs.groupBy("boat_id", "file_no").agg(F.unhex(text).alias("content")).select(path.alias("path"), "content")


@query(
    "src1_scan_ebl",
    "boat_id:i | file_no:i | seq:i | source:i | pgn:i | data:s",
    f"""FROM (SELECT boat_id, rank - 1 AS file_no, (rank - 1) * 4294967296 + k AS seq, source, CASE WHEN e % 10 = 3 THEN 59904 ELSE 129025 END AS pgn, CASE WHEN e % 10 = 3 THEN '01F801' ELSE {_POS} END AS data FROM (
      SELECT *, dense_rank() OVER (PARTITION BY boat_id ORDER BY file_no) AS rank, row_number() OVER (PARTITION BY boat_id, file_no ORDER BY seq) - 1 AS k FROM tele WHERE kind = 'view') WHERE e % 31 <> 0 AND e % 37 <> 0)""",
)
def src1(spark, sf):
    return fr.parse_records(ebl.records(_files(spark, sf))).withColumn("data", F.hex("data"))


# Texts and sinks --------------------------------------------------------------------------------------


def facts(spark, sf):
    s = season(spark, sf)
    named = lambda df: df.withColumn("depart_place", F.lit("A")).withColumn("arrive_place", F.lit("B"))
    return named(rows.trip_facts(s))


def _p(x: str, d: int = 1) -> str:
    return f"coalesce(replace(printf('%.{d}f', {x}), '.', ','), '')"


add_step(
    "texts",
    """SELECT t.boat_id, t.trip_no,
    coalesce((SELECT string_agg(CASE WHEN n > 1 THEN 'engine ' || instance || ': ' ELSE '' END || replace(printf('%.1f', engine_hours), '.', ',') || ' h', ', ' ORDER BY instance) FROM (SELECT *, count(*) OVER () AS n FROM engine_hours h WHERE h.boat_id = t.boat_id AND h.trip_no = t.trip_no)), '') AS engine_hours,
    coalesce((SELECT string_agg(CASE WHEN c > 1 THEN 'engine ' || instance || ': ' ELSE '' END || typical_rpm, ', ' ORDER BY instance) FROM (SELECT *, count(*) OVER () AS c FROM typical h WHERE h.boat_id = t.boat_id AND h.trip_no = t.trip_no)), '') AS typical_rpm,
    concat_ws('; ', (SELECT string_agg(CASE WHEN (SELECT count(*) FROM health q WHERE q.boat_id = t.boat_id AND q.trip_no = t.trip_no) > 1 THEN 'engine ' || instance || ': ' ELSE '' END || w, '; ' ORDER BY instance)
        FROM (SELECT instance, string_agg(warning, ', ' ORDER BY warning) AS w FROM warn x WHERE x.boat_id = t.boat_id AND x.trip_no = t.trip_no GROUP BY instance)),
      (SELECT string_agg(CASE WHEN n > 1 THEN 'battery ' || instance || ': ' ELSE '' END || 'low battery ' || replace(printf('%.1f', min_voltage_v), '.', ',') || ' V', '; ' ORDER BY instance) FILTER (min_voltage_v < 122e-1)
        FROM (SELECT *, count(*) OVER () AS n FROM bat h WHERE h.boat_id = t.boat_id AND h.trip_no = t.trip_no))) AS warnings FROM trips t""",
)


@query("sc11_device_texts", "boat_id:i | trip_no:i | engine_hours:s | typical_rpm:s | warnings:s", "FROM texts")
def sc11(spark, sf):
    c = F.col
    return facts(spark, sf).select(
        "boat_id", "trip_no", rows.hours_list_text(c("engine_hours")).alias("engine_hours"), rows.rpm_list_text(c("typical_rpm")).alias("typical_rpm"),
        rows.warnings_text(c("engine_health"), c("battery_health"), PARAMS.battery_warning_voltage).alias("warnings"),
    )


@query(
    "sk1_csv_rows",
    "boat_id:i | trip_no:i | date:s | departure_time:s | arrival_time:s | duration:s | distance_nm:s | avg_speed_kn:s | max_speed_kn:s | fuel_L_calculated:s | fuel_L_engine_meter:s | avg_consumption_L_per_hour:s | avg_consumption_L_per_nm:s",
    f"""FROM (SELECT boat_id, trip_no, strftime(local_date, '%Y-%m-%d') AS date, strftime(make_timestamp(depart_local_us), '%H:%M') AS departure_time, strftime(make_timestamp(arrive_local_us), '%H:%M') AS arrival_time,
      CAST(m // 60 AS VARCHAR) || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') AS duration, {_p('distance_nm')} AS distance_nm, {_p('avg_speed_kn')} AS avg_speed_kn, {_p('max_speed_kn')} AS max_speed_kn,
      {_p('fuel_liters')} AS "fuel_L_calculated", {_p('fuel_liters_device')} AS "fuel_L_engine_meter", {_p('fuel_liters / (duration_us / 36e8)')} AS "avg_consumption_L_per_hour", {_p('fuel_liters / distance_nm', 2)} AS "avg_consumption_L_per_nm"
      FROM (SELECT *, CAST(round_even(duration_us / 6e7, 0) AS BIGINT) AS m FROM local_trips))""",
)
def sk1(spark, sf):
    return rows.csv_rows(facts(spark, sf), PARAMS)


# Seven decimals of averaged end points depend on the order of summation: checked in the tests instead.
@query("sk2_gpx_points", "boat_id:i | trip_no:i | part:i | pos:i | line:s", None)
def sk2(spark, sf):
    s = season(spark, sf)
    return sink.gpx_lines(facts(spark, sf), marked(s), PARAMS)


@query("sk3_log_table", "boat_id:i | trip_no:i | no:i | entry:s | clock:s | position:s | depth:s | cog:s | sog:s | stw:s | wind_instrument:s | wind_model:s | precip:s | cloud:s | wave:s | current:s", None)
def sk3(spark, sf):
    return sink.log_table(log_entries(season(spark, sf)), weather_table(spark, sf), marine_table(spark, sf))


@query(
    "sk3_trip_rows",
    "boat_id:i | year:i=y | iso_week:i | seq_in_year:i | trip_no:i | trip_uid:s | depart_place:s | arrive_place:s | distance_nm:f | duration_us:i",
    """FROM (SELECT *, row_number() OVER (PARTITION BY boat_id, y ORDER BY depart_us, trip_no) AS seq_in_year FROM local_trips)
      JOIN (SELECT boat_id, trip_no, trip_uid FROM uids) USING (boat_id, trip_no) JOIN trip_places USING (boat_id, trip_no)""",
)
def sk3_rows(spark, sf):
    s = season(spark, sf)
    from fairlead.operators.places import resolve_trip_places

    named = resolve_trip_places(s.trips, place_table(spark, sf), landmark_table(spark, sf))
    df = periods.with_sequence(periods.with_trip_uid(periods.with_local_time(named, PARAMS)))
    return df.select("boat_id", "year", "iso_week", "seq_in_year", "trip_no", "trip_uid", "depart_place", "arrive_place", "distance_nm", "duration_us")


@query("id2_config_signature", "boat_id:i | signature:s", f"FROM (SELECT DISTINCT boat_id, '{PARAMS.signature()}' AS signature FROM trips)")
def id2(spark, sf):
    return incremental.resume_points(season(spark, sf).trips, PARAMS).select("boat_id", "signature")


# Incremental: build a first part, resume, and get what one full build gives. -------------------------


_resumes: dict[tuple[str, str], tuple] = {}


def _resumed(spark, sf):
    """A build of the first 60 % of the events, and one that goes on from its tails with the rest."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _resumes:
        tables = dict(season(spark, sf).tables)
        cut = settle(landed(spark, sf).agg((F.max("e") * 0.6).alias("cut"))).first()["cut"]
        first = Season({n: df.where(F.col("seq") <= cut) for n, df in tables.items()}, PARAMS)
        resume = settle(incremental.resume_points(first.trips, PARAMS))
        settled, _ = incremental.split_settled(first.trips)
        tails = incremental.resume_tables(first.tables, resume, first.intervals, PARAMS)
        fresh = Season({n: settle(tails[n].unionByName(df.where(F.col("seq") > cut))) for n, df in tables.items()}, PARAMS)
        _resumes[key] = settled, fresh, resume
    return _resumes[key]


_RES = "boat_id:i | trip_no:i | depart_us:i | arrive_us:i | distance_nm:f | duration_us:i"


@query("inc2_resume", _RES, "FROM trips")
def inc2(spark, sf):
    settled, fresh, resume = _resumed(spark, sf)
    return incremental.combine(settled, fresh.trips, resume)


@query(
    "inc3_starts_in_stay",
    "boat_id:i | starts_unknown:b",
    "FROM (SELECT DISTINCT boat_id, false AS starts_unknown FROM trips)",
)
def inc3(spark, sf):
    """The first trip of a resumed run always has its stay, so no wider window is ever needed."""
    _, fresh, _ = _resumed(spark, sf)
    first = fresh.trips.groupBy("boat_id").agg(F.min_by(F.struct("depart_unknown"), "trip_no").alias("x"))
    return first.select("boat_id", F.col("x.depart_unknown").isNotNull().alias("starts_unknown"))


# Streams ----------------------------------------------------------------------------------------------


def _stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type").schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    for level in fixture.LEVELS:
        df = df.select("*", *[F.expr(fixture.for_spark(e)).alias(n) for n, e in level.items()])
    return df


def _drain(stream, mode: str = "update"):
    """Runs a stream over all there is and gives its output as a table in the shared folder."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/fairlead/streams/live_{uuid.uuid4().hex}"
    out = f"{folder}/out"
    spark.createDataFrame([], stream.schema).write.parquet(out)
    save = "overwrite" if mode == "complete" else "append"
    writer = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode(save).parquet(out)).outputMode(mode)
    writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def _live(spark, sf, time_col="time_us"):
    """The primary receiver's positions and all engines' readings; which receiver that is, landed data tell."""
    tele, known = _stream(spark, sf), landed(spark, sf)
    chosen = select.primary_gps(fixture.series(known, "fixes"), fixture.series(known, "sog")).select("boat_id", F.col("fix_source").alias("source"))
    fixes = tele.where("kind = 'view'").select(
        "boat_id", "source", "seq", F.col(time_col).alias("time_us"), (F.col("lat_raw") * 1e-7).alias("lat"), (F.col("lon_raw") * 1e-7).alias("lon"), (F.col("sog_raw") * 1e-2).alias("sog_ms")
    )
    engine = fixture.series(tele, "engine", time_col)
    return live.live_state(live.live_input(fixes.join(settle(chosen), ["boat_id", "source"]), engine), PARAMS)


# Runs of one label; moves and stops that are long enough; what the boat does after each position.
add_step("lv_in", "SELECT t.*, sog_raw * 1e-2 >= 257222e-6 AS mv, row_number() OVER (PARTITION BY t.boat_id ORDER BY seq) AS n FROM tele t JOIN gps g ON t.boat_id = g.boat_id AND t.source = g.fix_source WHERE kind = 'view'")
add_step("lv_runs", "SELECT *, sum(CASE WHEN mv = pm THEN 0 ELSE 1 END) OVER (PARTITION BY boat_id ORDER BY n) AS r FROM (SELECT *, lag(mv) OVER (PARTITION BY boat_id ORDER BY n) AS pm FROM lv_in)")
add_step(
    "lv_path",
    f"""SELECT *, min(time_us) OVER (PARTITION BY boat_id, r) AS t0, coalesce(sum({hav('pa * 1e-7', 'po * 1e-7', 'lat_raw * 1e-7', 'lon_raw * 1e-7')}) OVER (PARTITION BY boat_id, r ORDER BY n), 0e0) AS path FROM (
    SELECT *, lag(lat_raw) OVER w AS pa, lag(lon_raw) OVER w AS po FROM lv_runs WINDOW w AS (PARTITION BY boat_id, r ORDER BY n))""",
)
add_step("lv_under", "SELECT *, last_value(CASE WHEN mv AND (n = 1 OR path >= 2e-1) THEN 1 WHEN NOT mv AND (n = 1 OR time_us - t0 >= 600000000) THEN 0 END IGNORE NULLS) OVER (PARTITION BY boat_id ORDER BY n) AS under FROM lv_path")
add_step("lv_sec", "SELECT *, sum(CASE WHEN under = pu THEN 0 ELSE 1 END) OVER (PARTITION BY boat_id ORDER BY n) AS sec FROM (SELECT *, lag(under) OVER (PARTITION BY boat_id ORDER BY n) AS pu FROM lv_under)")
add_step("lv", "SELECT *, CASE WHEN under = 0 THEN first_value(t0) OVER (PARTITION BY boat_id, sec ORDER BY n) END AS since, min(time_us) OVER (PARTITION BY boat_id) AS first_us FROM lv_sec")


@query(
    "st2_live_state",
    "boat_id:i | last_data_us:i | lat:p | underway:b | stationary_since_us:i | engine_running:b | engine_off_since_us:i | in_harbour:b",
    """FROM (SELECT *, NOT underway AND (last_data_us - stationary_since_us) // 1000000 >= 1800 AND NOT engine_running AND (last_data_us - engine_off_since_us) // 1000000 >= 600 AS in_harbour FROM (
      SELECT *, last_data_us - last_on <= 60000000 AS engine_running, CASE WHEN last_data_us - last_on > 60000000 THEN last_on END AS engine_off_since_us FROM (
      SELECT boat_id, time_us AS last_data_us, lat_raw * 1e-7 AS lat, under = 1 AS underway, since AS stationary_since_us,
        (SELECT max(t.time_us) FROM tele t WHERE t.boat_id = lv.boat_id AND t.kind = 'purchase' AND t.fuel_raw BETWEEN 4 AND 32766) AS last_on
      FROM lv QUALIFY n = max(n) OVER (PARTITION BY boat_id))))""",
)
def st2(spark, sf):
    return live.latest(_drain(_live(spark, sf)))


@query(
    "st3_harbour_alert",
    "boat_id:i | stationary_since_us:i | last_data_us:i",
    """FROM (SELECT v.boat_id, v.since AS stationary_since_us, v.time_us AS last_data_us FROM lv v
      ASOF LEFT JOIN (SELECT boat_id, seq, time_us AS on_us FROM tele WHERE kind = 'purchase' AND fuel_raw BETWEEN 4 AND 32766) o ON v.boat_id = o.boat_id AND v.seq > o.seq
      ASOF LEFT JOIN (SELECT boat_id, seq, true AS any_engine FROM tele WHERE kind = 'purchase') k ON v.boat_id = k.boat_id AND v.seq > k.seq
      WHERE v.under = 0 AND (v.time_us - v.since) // 1000000 >= 1800
        AND (k.any_engine IS NULL OR (coalesce(v.time_us - o.on_us > 60000000, true) AND (v.time_us - coalesce(o.on_us, v.first_us)) // 1000000 >= 600))
      QUALIFY row_number() OVER (PARTITION BY v.boat_id, v.sec ORDER BY v.n) = 1)""",
)
def st3(spark, sf):
    return live.harbour_alerts(_drain(_live(spark, sf)))


add_step("late_in", "SELECT t.boat_id, bad_time_us AS t, row_number() OVER (PARTITION BY t.boat_id ORDER BY seq) AS n FROM tele t JOIN gps g ON t.boat_id = g.boat_id AND t.source = g.fix_source WHERE kind = 'view'")
add_step(
    "late_walk",
    """SELECT boat_id, n, t AS anchor, 0 AS dropped, 0 AS resets FROM late_in WHERE n = 1
    UNION ALL SELECT r.boat_id, r.n, CASE WHEN r.t >= w.anchor OR w.anchor - r.t >= 86400000000 THEN r.t ELSE w.anchor END,
      w.dropped + CASE WHEN r.t < w.anchor AND w.anchor - r.t < 86400000000 THEN 1 ELSE 0 END, w.resets + CASE WHEN w.anchor - r.t >= 86400000000 THEN 1 ELSE 0 END
    FROM late_walk w JOIN late_in r ON r.boat_id = w.boat_id AND r.n = w.n + 1""",
    recursive=True,
)


@query("st5_late_time", "boat_id:i | last_data_us:i | dropped:i | clock_resets:i", "FROM (SELECT boat_id, anchor AS last_data_us, dropped, resets AS clock_resets FROM late_walk QUALIFY n = max(n) OVER (PARTITION BY boat_id))")
def st5(spark, sf):
    return live.latest(_drain(_live(spark, sf, "bad_time_us")))


@query(
    "st6_dropped_sessions",
    "boat_id:i | source:i | first_us:i | last_us:i | n:i",
    """FROM (SELECT boat_id, source, min(time_us) AS first_us, max(time_us) AS last_us, count(*) AS n FROM (
      SELECT *, sum(CASE WHEN time_us - pt <= 30000000 THEN 0 ELSE 1 END) OVER (PARTITION BY boat_id, source ORDER BY time_us, seq) AS g FROM (
      SELECT *, lag(time_us) OVER (PARTITION BY boat_id, source ORDER BY time_us, seq) AS pt FROM tele WHERE kind = 'error')) GROUP BY boat_id, source, g)""",
)
def st6(spark, sf):
    dropped = _stream(spark, sf).where("kind = 'error'").select("boat_id", "source", "seq", "time_us")
    return _drain(live.dropped_sessions(dropped), "complete")


#: Row groups of a trigger's file, below the least split of a read: every task of a trigger gets its share.
TRIGGER_ROW_GROUP = 2 << 20


def _write_thirds(events, folder: str) -> None:
    """One file per third of the event numbers. A trigger takes whole files, and tasks share a file by row groups."""
    last = events.agg(F.max("event_id").alias("e")).scalar()
    for k in range(3):
        third = events.where((F.floor(F.col("event_id") * 3 / (last + 1)) == k))
        third.repartition(1).write.option("parquet.block.size", TRIGGER_ROW_GROUP).parquet(f"{folder}/{k}")


@query("st4_settled_trips", "boat_id:i | trip_no:i | depart_us:i | distance_nm:f", "FROM trips QUALIFY trip_no < max(trip_no) OVER (PARTITION BY boat_id)")
def st4(spark, sf):
    """Three triggers, each with a third of the events: the logbook goes on from the tails of the one before."""
    folder = f"{shared_folder(spark)}/fairlead/settled-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type")
    _write_thirds(events, f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    for level in fixture.LEVELS:
        stream = stream.select("*", *[F.expr(fixture.for_spark(e)).alias(n) for n, e in level.items()])

    def build(window, counts, params):
        chosen = select.choose_inputs(window, params.engine_count, counts)
        chosen["fixes"] = align.first_of_ties(chosen["fixes"])
        return Season(chosen, params), window

    book = Logbook(spark, folder, PARAMS, build)
    write = live.emit_settled(book, lambda batch: fixture.all_series(settle(batch)))
    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    with compiled_methods(spark):  # a batch is landed with all columns of the telemetry view
        run.start().awaitTermination()
    return book.settled()


@query("st1_stream_frames", "pgn:i | n:i", "FROM (SELECT 129025 AS pgn, count(*) AS n FROM tele WHERE kind = 'view' AND e % 31 <> 0 AND e % 37 <> 0 AND e % 10 <> 3)")
def st1(spark, sf):
    """Landed file contents read as a stream, framed and parsed."""
    path = f"{shared_folder(spark)}/fairlead/landing-{uuid.uuid4().hex}"
    _files(spark, sf).write.parquet(path)
    files = spark.readStream.schema("path string, content binary").parquet(path)
    parsed = fr.parse_records(ebl.records(files, [129025]))
    return _drain(parsed.groupBy("pgn").agg(F.count(F.lit(1)).alias("n")), "complete")
