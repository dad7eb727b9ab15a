"""Queries: file manifests, incremental bookkeeping, run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.operators import archive, quality
from fairlead.sources import runlog
from fairlead.workload.oracle import add_step
from fairlead.workload.registry import PARAMS, landed, query, season

_MANIFEST = {
    "boat_id": "CAST(o_orderkey % 2 AS INT)",
    "k": "o_orderkey // 2",
    "folder": "concat('EBL', lpad(CAST(o_orderkey // 200 AS {s}), 6, '0'))",
    "file_name": "concat(lpad(CAST(o_orderkey // 200 + CASE WHEN o_orderkey % 83 = 2 THEN 1 ELSE 0 END AS {s}), CASE WHEN o_orderkey % 89 = 1 THEN 5 ELSE 6 END, '0'), '_', lpad(CAST((o_orderkey // 2) % 100 AS {s}), 3, '0'), '.ebl')",
    "size": "5000000 + (o_orderkey % 7) * 1000",
    "modified_us": "CAST(1700000000 + o_orderkey AS BIGINT) * 1000000",
}


def _cols(dialect: str) -> dict[str, str]:
    s = "STRING" if dialect == "spark" else "VARCHAR"
    out = {n: e.replace("{s}", s) for n, e in _MANIFEST.items()}
    return {n: e.replace("//", "div") for n, e in out.items()} if dialect == "spark" else out


add_step("all_files", "SELECT o_orderkey, " + ", ".join(f"{e} AS {n}" for n, e in _cols("duck").items()) + " FROM orders")
add_step("manifest", "SELECT * FROM all_files WHERE o_orderkey % 97 <> 0 AND (o_orderkey // 200) % 9 <> 4")
add_step("decoded", "SELECT *, CASE WHEN o_orderkey % 41 = 0 THEN 6 ELSE 7 END AS version FROM (SELECT * REPLACE (size - CASE WHEN o_orderkey % 53 = 0 THEN 500 ELSE 0 END AS size) FROM all_files WHERE o_orderkey % 5 <> 0)")


def _all_files(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", *[F.expr(e).alias(n) for n, e in _cols("spark").items()])


def _manifest(spark, sf):
    return _all_files(spark, sf).where("o_orderkey % 97 <> 0 AND (o_orderkey div 200) % 9 <> 4")


def _decoded(spark, sf):
    df = _all_files(spark, sf).where("o_orderkey % 5 <> 0")
    smaller = F.expr("size - CASE WHEN o_orderkey % 53 = 0 THEN 500 ELSE 0 END")
    return df.withColumn("size", smaller).withColumn("version", F.expr("CASE WHEN o_orderkey % 41 = 0 THEN 6 ELSE 7 END"))


_K = "boat_id:i | folder:s | file_name:s"


@query("src4_file_discovery", f"{_K} | file_order:i", "FROM (SELECT *, row_number() OVER (PARTITION BY boat_id ORDER BY folder || '/' || file_name) AS file_order FROM manifest)")
def src4(spark, sf):
    return archive.file_order(_manifest(spark, sf))


add_step(
    "well_named",
    "SELECT *, CAST(folder[4:9] AS INT) AS fno, CAST(file_name[8:10] AS INT) AS fseq FROM manifest WHERE regexp_full_match(file_name, '[0-9]{6}_[0-9]{3}[.]ebl') AND CAST(file_name[1:6] AS INT) = CAST(folder[4:9] AS INT)",
)
add_step(
    "layout",
    """SELECT boat_id, 'bad_name' AS problem, folder, file_name FROM manifest WHERE NOT regexp_full_match(file_name, '[0-9]{6}_[0-9]{3}[.]ebl')
    UNION ALL SELECT boat_id, 'wrong_folder', folder, file_name FROM manifest WHERE regexp_full_match(file_name, '[0-9]{6}_[0-9]{3}[.]ebl') AND file_name[1:6] <> folder[4:9]
    UNION ALL SELECT b.boat_id, 'missing_folder', 'EBL' || lpad(CAST(n AS VARCHAR), 6, '0'), NULL FROM (SELECT boat_id, unnest(range(min(fno), max(fno) + 1)) AS n FROM well_named GROUP BY boat_id) b
      WHERE NOT EXISTS (SELECT 1 FROM well_named w WHERE w.boat_id = b.boat_id AND w.fno = b.n)
    UNION ALL SELECT f.boat_id, 'missing_file', 'EBL' || lpad(CAST(f.fno AS VARCHAR), 6, '0'), lpad(CAST(f.fno AS VARCHAR), 6, '0') || '_' || lpad(CAST(i AS VARCHAR), 3, '0') || '.ebl'
      FROM (SELECT boat_id, fno, min(fseq) AS lo, max(fseq) AS hi, fno = min(fno) OVER (PARTITION BY boat_id) AS is_first, fno = max(fno) OVER (PARTITION BY boat_id) AS is_last FROM well_named GROUP BY boat_id, fno) f,
      (SELECT unnest(range(100)) AS i) WHERE (NOT is_first OR i >= lo) AND (NOT is_last OR i <= hi) AND NOT EXISTS (SELECT 1 FROM well_named w WHERE w.boat_id = f.boat_id AND w.fno = f.fno AND w.fseq = i)""",
)


@query("qm1_layout", "boat_id:i | problem:s | folder:s | file_name:s", "FROM layout")
def qm1(spark, sf):
    return archive.layout_problems(_manifest(spark, sf))


add_step("local_files", "SELECT * REPLACE (size - CASE WHEN o_orderkey % 53 = 0 THEN 500 ELSE 0 END AS size) FROM all_files WHERE (o_orderkey // 200) % 3 <> 0 OR o_orderkey % 11 <> 0")


def _local(spark, sf):
    return _all_files(spark, sf).where("(o_orderkey div 200) % 3 <> 0 OR o_orderkey % 11 <> 0").withColumn("size", F.expr("size - CASE WHEN o_orderkey % 53 = 0 THEN 500 ELSE 0 END"))


@query(
    "qm2_to_download",
    f"{_K} | size:i",
    """FROM (SELECT r.* FROM all_files r WHERE NOT EXISTS (SELECT 1 FROM local_files l WHERE l.boat_id = r.boat_id AND l.folder = r.folder AND l.file_name = r.file_name AND l.size = r.size)
      AND NOT ((SELECT count(*) FROM local_files l WHERE l.boat_id = r.boat_id AND l.folder = r.folder) >= 100 AND r.folder <> (SELECT max(folder) FROM all_files x WHERE x.boat_id = r.boat_id)))""",
)
def qm2(spark, sf):
    return archive.to_download(_all_files(spark, sf), _local(spark, sf))


# Staged and archived copies: some folders new, some known, some with other content, and loose files.
add_step(
    "staged",
    """SELECT o_orderkey AS entry_no, CASE WHEN o_orderkey % 10 = 9 THEN 'copies' ELSE folder || CAST(boat_id AS VARCHAR) END AS raw_folder, CASE WHEN o_orderkey % 10 = 9 THEN 'log' || (o_orderkey % 300) || '.ebl' ELSE lpad(CAST((o_orderkey // 200) * 2 + boat_id AS VARCHAR), 6, '0') || '_' || lpad(CAST((o_orderkey // 2) % 100 AS VARCHAR), 3, '0') || '.ebl' END AS file_name,
    CASE WHEN o_orderkey % 10 = 9 THEN 'copies' ELSE 'EBL' || lpad(CAST((o_orderkey // 200) * 2 + boat_id AS VARCHAR), 6, '0') END AS folder,
    CASE WHEN o_orderkey % 10 = 9 THEN 'c' || (o_orderkey // 10 % 4) ELSE 'h' || o_orderkey END AS sha1, CASE WHEN o_orderkey % 10 = 9 THEN 1750000000000000 WHEN (o_orderkey // 200) % 7 = 6 THEN NULL ELSE (1700000000 + o_orderkey * 40000) * 1000000 END AS first_us FROM all_files""",
)
add_step(
    "archived",
    """SELECT CASE WHEN (entry_no // 200) % 2 = 0 THEN '2024' END AS year, folder, file_name, CASE WHEN (entry_no // 200) % 4 = 1 AND entry_no % 50 = 3 THEN 'x' || sha1 ELSE sha1 END AS sha1 FROM staged WHERE folder <> 'copies' AND (entry_no // 200) % 3 <> 2 AND entry_no % 4 <> 0
    UNION ALL SELECT DISTINCT '2025', 'loose', file_name, 'c1' FROM staged WHERE folder = 'copies' AND entry_no % 300 < 150 UNION ALL SELECT DISTINCT '2025', 'loose', replace(file_name, '.ebl', '-2.ebl'), 'z' FROM staged WHERE folder = 'copies' AND entry_no % 300 < 60""",
)
add_step(
    "import_plan",
    """SELECT s.entry_no, s.folder, s.file_name, s.sha1, g.year, h.folder IS NOT NULL AS known, h.year AS h_year, g.clash,
      (SELECT a.sha1 FROM archived a WHERE a.folder = s.folder AND a.file_name = s.file_name) AS a_sha1, g.digest
    FROM staged s JOIN (SELECT s.folder, coalesce(CAST(year(make_timestamp(min(first_us))) AS VARCHAR), 'onbekend') AS year,
        coalesce(bool_or(a.sha1 <> s.sha1), false) AS clash, sha1(string_agg(s.file_name || s.sha1, '' ORDER BY s.file_name || s.sha1))[1:8] AS digest
        FROM staged s LEFT JOIN archived a ON a.folder = s.folder AND a.file_name = s.file_name WHERE s.folder <> 'copies' GROUP BY s.folder) g USING (folder)
      LEFT JOIN (SELECT DISTINCT folder, year FROM archived WHERE folder <> 'loose') h ON h.folder = s.folder WHERE s.folder <> 'copies'""",
)
add_step(
    "loose_plan",
    """SELECT *, NOT is_first AND sha1 <> holder AS other, sum(CASE WHEN NOT is_first AND sha1 <> holder THEN 1 ELSE 0 END) OVER (PARTITION BY file_name ORDER BY entry_no) AS j FROM (
    SELECT s.*, a.sha1 AS a_sha1, coalesce(a.sha1, first_value(s.sha1) OVER (PARTITION BY s.file_name ORDER BY s.entry_no)) AS holder,
      a.sha1 IS NULL AND row_number() OVER (PARTITION BY s.file_name ORDER BY s.entry_no) = 1 AS is_first,
      EXISTS (SELECT 1 FROM archived z WHERE z.folder = 'loose' AND z.file_name = replace(s.file_name, '.ebl', '-2.ebl')) AS two_taken
    FROM staged s LEFT JOIN archived a ON a.folder = 'loose' AND a.file_name = s.file_name WHERE s.folder = 'copies')""",
)


@query(
    "qm3_import_plan",
    "entry_no:i | file_name:s | target:s | outcome:s | renamed:b",
    """FROM (SELECT entry_no, file_name, CASE WHEN clash THEN year || '/' || folder || '-' || digest WHEN known THEN coalesce(h_year || '/', '') || folder ELSE year || '/' || folder END || '/' || file_name AS target,
      CASE WHEN NOT clash AND a_sha1 IS NOT NULL THEN 'skipped_duplicate' ELSE 'imported' END AS outcome, clash AS renamed FROM import_plan
      UNION ALL SELECT entry_no, file_name, '2025/' || CASE WHEN other THEN replace(file_name, '.ebl', '-' || CASE WHEN two_taken AND j >= 2 THEN j + 1 ELSE j END || '.ebl') ELSE file_name END,
      CASE WHEN NOT is_first AND NOT other THEN 'skipped_duplicate' ELSE 'imported' END, other FROM loose_plan)""",
)
def qm3(spark, sf):
    c = F.col
    df = _all_files(spark, sf)
    loose = F.expr("o_orderkey % 10 = 9")
    no = F.lpad(F.expr("cast((o_orderkey div 200) * 2 + boat_id as string)"), 6, "0")
    staged = df.select(
        c("o_orderkey").alias("entry_no"),
        F.when(loose, "copies").otherwise(F.concat(F.lit("EBL"), no)).alias("folder"),
        F.when(loose, F.concat(F.lit("log"), (c("o_orderkey") % 300).cast("string"), F.lit(".ebl"))).otherwise(
            F.concat(no, F.lit("_"), F.lpad(F.expr("cast((o_orderkey div 2) % 100 as string)"), 3, "0"), F.lit(".ebl"))
        ).alias("file_name"),
        F.when(loose, F.expr("concat('c', cast(o_orderkey div 10 % 4 as string))")).otherwise(F.concat(F.lit("h"), c("o_orderkey").cast("string"))).alias("sha1"),
        F.expr("CASE WHEN o_orderkey % 10 = 9 THEN 1750000000000000 WHEN (o_orderkey div 200) % 7 = 6 THEN NULL ELSE (1700000000 + o_orderkey * 40000) * 1000000 END").alias("first_us"),
    )
    kept = staged.where("folder <> 'copies' AND (entry_no div 200) % 3 <> 2 AND entry_no % 4 <> 0").select(
        F.expr("CASE WHEN (entry_no div 200) % 2 = 0 THEN '2024' END").alias("year"), "folder", "file_name",
        F.expr("CASE WHEN (entry_no div 200) % 4 = 1 AND entry_no % 50 = 3 THEN concat('x', sha1) ELSE sha1 END").alias("sha1"),
    )
    copies = staged.where("folder = 'copies'")
    one = copies.where("entry_no % 300 < 150").select(F.lit("2025").alias("year"), F.lit("loose").alias("folder"), "file_name", F.lit("c1").alias("sha1")).distinct()
    two = copies.where("entry_no % 300 < 60").select(
        F.lit("2025").alias("year"), F.lit("loose").alias("folder"), F.replace(c("file_name"), F.lit(".ebl"), F.lit("-2.ebl")).alias("file_name"), F.lit("z").alias("sha1")
    ).distinct()
    return archive.import_plan(staged, kept.unionByName(one).unionByName(two))


@query(
    "qm4_inventory",
    "boat_id:i | files:i | bytes:i | size_text:s | to_copy:i",
    """FROM (SELECT m.boat_id, count(*) AS files, sum(m.size) AS bytes, CASE WHEN sum(m.size) >= 1e9 THEN printf('%.1f', sum(m.size) / 1e9) || ' GB' ELSE printf('%.0f', sum(m.size) / 1e6) || ' MB' END AS size_text,
      count(*) FILTER (l.file_name IS NULL) AS to_copy FROM manifest m LEFT JOIN local_files l ON l.boat_id = m.boat_id AND l.folder = m.folder AND l.file_name = m.file_name AND l.size = m.size GROUP BY m.boat_id)""",
)
def qm4(spark, sf):
    m = _manifest(spark, sf)
    diff = archive.backup_plan(m, _local(spark, sf)).groupBy("boat_id").agg(F.count(F.lit(1)).alias("to_copy"))
    return archive.inventory(m).join(diff, "boat_id", "left")


@query(
    "inc1_to_decode",
    f"{_K} | size:i",
    "FROM (SELECT m.* FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM decoded d WHERE d.boat_id = m.boat_id AND d.folder = m.folder AND d.file_name = m.file_name AND d.size = m.size AND d.version = 7))",
)
def inc1(spark, sf):
    return archive.to_decode(_manifest(spark, sf), _decoded(spark, sf), 7)


@query("set4_orphans", _K, "FROM (SELECT d.* FROM decoded d WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.boat_id = d.boat_id AND m.folder = d.folder AND m.file_name = d.file_name))")
def set4(spark, sf):
    return archive.orphans(_decoded(spark, sf), _manifest(spark, sf))


@query(
    "set5_missing_results",
    "boat_id:i | folder:s | decoded:i | missing:i",
    """FROM (SELECT m.boat_id, m.folder, count(*) AS decoded, count(*) FILTER (NOT EXISTS (SELECT 1 FROM decoded d WHERE d.boat_id = m.boat_id AND d.folder = m.folder AND d.file_name = m.file_name)) AS missing FROM manifest m GROUP BY ALL)""",
)
def set5(spark, sf):
    return archive.missing_results(_manifest(spark, sf), _decoded(spark, sf))


@query(
    "inc4_files_of_trips",
    "boat_id:i | trip_no:i | source:i | file_no:i",
    """FROM (SELECT DISTINCT t.boat_id, t.trip_no, f.source, f.file_no FROM trips t JOIN (SELECT boat_id, source, file_no, min(time_us) AS a, max(time_us) AS b FROM s_attitude GROUP BY ALL) f
      ON f.boat_id = t.boat_id AND f.b >= t.depart_us AND f.a <= t.arrive_us)""",
)
def inc4(spark, sf):
    from fairlead.workload import fixture

    summaries = quality.file_summaries(fixture.series(landed(spark, sf), "attitude"), ["boat_id", "source"])
    return archive.files_of_trips(season(spark, sf).trips, summaries, PARAMS.chunk_us)


@query(
    "inc5_up_to_date",
    "boat_id:i | current:b | trip_count:i",
    "FROM (SELECT boat_id, built >= newest AS current, CASE WHEN built >= newest THEN n END AS trip_count FROM (SELECT boat_id, max(modified_us) AS newest, max(modified_us) - boat_id AS built, count(*) AS n FROM manifest GROUP BY boat_id))",
)
def inc5(spark, sf):
    m = _manifest(spark, sf)
    builds = m.groupBy("boat_id").agg((F.max("modified_us") - F.col("boat_id")).alias("built_us"), F.count(F.lit(1)).alias("trip_count"))
    return archive.up_to_date(m, builds.withColumn("signature", F.lit(PARAMS.signature())), PARAMS.signature())


@query("set2_settled_and_fresh", "boat_id:i | trip_no:i | settled:b", "FROM (SELECT boat_id, trip_no, trip_no < max(trip_no) OVER (PARTITION BY boat_id) AS settled FROM trips)")
def set2(spark, sf):
    from fairlead.plans.incremental import split_settled

    done, fresh = split_settled(season(spark, sf).trips)
    return done.withColumn("settled", F.lit(True)).unionByName(fresh.withColumn("settled", F.lit(False)))


_LINE = """CASE WHEN event_id % 17 = 0 THEN concat('no time here ', event_type) ELSE concat({ts}, ' [', CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'anomaly' WHEN 'click' THEN 'geocode' ELSE 'info' END, '] ',
  CASE event_id % 6 WHEN 0 THEN concat('...decoded ', CAST(event_id % 50 AS {s}), '/50 logfile(s) so far') WHEN 1 THEN 'Building trips from 12 GPS position(s)...' WHEN 2 THEN '...9 run(s) classified, computing per-trip statistics...' WHEN 3 THEN '3 trip(s) found, writing logbook' ELSE props END) END"""


@query(
    "src10_run_log",
    "event_id:i | logged_s:i | severity:s | phase:s | step:i | total:i",
    """FROM (SELECT *, CASE WHEN event_id % 17 <> 0 THEN epoch_us(date_trunc('second', ts)) // 1000000 END AS logged_s,
      CASE WHEN event_id % 17 = 0 THEN 'info' WHEN event_type = 'error' THEN 'error' WHEN event_type IN ('signup', 'click') THEN 'warning' ELSE 'info' END AS severity,
      CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 6 = 0 THEN 'decoding' WHEN event_id % 6 < 4 THEN 'building_trips' END AS phase,
      CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 6 = 0 THEN event_id % 50 WHEN event_id % 6 = 1 THEN 1 WHEN event_id % 6 = 2 THEN 3 WHEN event_id % 6 = 3 THEN 4 END AS step,
      CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 6 = 0 THEN 50 WHEN event_id % 6 < 4 THEN 4 END AS total FROM events) WHERE event_id % 17 = 0 OR date_trunc('second', ts) >= TIMESTAMP '2024-01-11 00:00:00'""",
)
def src10(spark, sf):
    line = F.expr(_LINE.format(ts="date_format(ts, 'yyyy-MM-dd HH:mm:ss')", s="STRING"))
    lines = spark.read.parquet(f"{sf}/events.parquet").withColumn("value", line)
    parsed = runlog.prune(runlog.parse_lines(lines), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 20)
    seconds = F.unix_timestamp(F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss")) - F.unix_timestamp(F.lit("1970-01-01 00:00:00"))
    return parsed.withColumn("logged_s", seconds)
