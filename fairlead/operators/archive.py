"""Jobs over file manifests: completeness, what to fetch, what to import, what to decode again.

A manifest has one row per log file (boat_id, folder, file_name, size, ...). Comparisons of manifests
are anti-joins on their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.operators.scan import ancestors, cover, time_slice
from fairlead.params import FILES_PER_FOLDER

FOLDER = r"^EBL(\d{6})$"
FILE = r"^(\d{6})_(\d{3})\.ebl$"
UNKNOWN_YEAR = "onbekend"
FILE_KEY = ["boat_id", "folder", "file_name"]


def file_order(manifest: DataFrame) -> DataFrame:
    """Sorted path order is time order. Ordered per boat, over manifest rows."""
    path = F.concat_ws("/", "folder", "file_name")
    w = Window.partitionBy("boat_id").orderBy("path")
    return manifest.withColumn("path", path).where(F.col("path").endswith(".ebl")).withColumn("file_order", F.row_number().over(w))


def _numbers(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "folder_no": F.regexp_extract("folder", FOLDER, 1).try_cast("int"),
            "name_no": F.regexp_extract("file_name", FILE, 1).try_cast("int"),
            "file_seq": F.regexp_extract("file_name", FILE, 2).try_cast("int"),
        }
    )


def _folder_text(n: Column) -> Column:
    return F.concat(F.lit("EBL"), F.lpad(n.cast("string"), 6, "0"))


def _file_text(folder: Column, seq: Column) -> Column:
    return F.concat(F.lpad(folder.cast("string"), 6, "0"), F.lit("_"), F.lpad(seq.cast("string"), 3, "0"), F.lit(".ebl"))


def layout_problems(manifest: DataFrame) -> DataFrame:
    """Misnamed files, files in the wrong folder, missing folders and missing files. Folders number on
    without gaps and hold 100 files; the first may start later, the last may end earlier."""
    c = F.col
    df = _numbers(manifest).where("folder_no IS NOT NULL")
    bad = df.where("name_no IS NULL").select("boat_id", F.lit("bad_name").alias("problem"), "folder", "file_name")
    wrong = df.where("name_no <> folder_no").select("boat_id", F.lit("wrong_folder").alias("problem"), "folder", "file_name")
    good = df.where("name_no = folder_no")
    folders = good.groupBy("boat_id", "folder_no").agg(F.min("file_seq").alias("lo"), F.max("file_seq").alias("hi"))
    span = folders.groupBy("boat_id").agg(F.min("folder_no").alias("a"), F.max("folder_no").alias("b"))
    every = span.select("boat_id", F.explode(F.sequence("a", "b")).alias("folder_no"))
    gone = every.join(folders, ["boat_id", "folder_no"], "left_anti").select(
        "boat_id", F.lit("missing_folder").alias("problem"), _folder_text(c("folder_no")).alias("folder"), F.lit(None).cast("string").alias("file_name")
    )
    limits = folders.join(span, "boat_id").withColumns(
        {"x": F.when(c("folder_no") == c("a"), c("lo")).otherwise(0), "y": F.when(c("folder_no") == c("b"), c("hi")).otherwise(FILES_PER_FOLDER - 1)}
    )
    due = limits.select("boat_id", "folder_no", F.explode(F.sequence("x", "y")).alias("file_seq"))
    lost = due.join(good, ["boat_id", "folder_no", "file_seq"], "left_anti").select(
        "boat_id", F.lit("missing_file").alias("problem"), _folder_text(c("folder_no")).alias("folder"), _file_text(c("folder_no"), c("file_seq")).alias("file_name")
    )
    return bad.unionByName(wrong).unionByName(gone).unionByName(lost)


def to_download(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote files that are absent or of another size here. A folder other than the newest that
    already holds 100 files is closed and not looked at."""
    newest = remote.groupBy("boat_id").agg(F.max("folder").alias("newest"))
    full = local.groupBy("boat_id", "folder").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FILES_PER_FOLDER)
    closed = full.join(newest, "boat_id").where("folder <> newest").select("boat_id", "folder")
    plan = remote.join(closed, ["boat_id", "folder"], "left_anti")
    return plan.join(local.select(*FILE_KEY, "size"), [*FILE_KEY, "size"], "left_anti")


def to_decode(manifest: DataFrame, decoded: DataFrame, version: int) -> DataFrame:
    """New and grown files, and those decoded by another version."""
    valid = decoded.where(F.col("version") == version).select(*FILE_KEY, "size")
    return manifest.join(valid, [*FILE_KEY, "size"], "left_anti")


def orphans(cached: DataFrame, manifest: DataFrame) -> DataFrame:
    """Stored results of files that are no longer in the archive."""
    return cached.join(manifest, FILE_KEY, "left_anti")


def missing_results(decoded: DataFrame, stored: DataFrame) -> DataFrame:
    """Per folder: files decoded, and how many of them have no stored result."""
    gone = decoded.join(stored.select(*FILE_KEY).withColumn("_has", F.lit(1)), FILE_KEY, "left")
    return gone.groupBy("boat_id", "folder").agg(
        F.count(F.lit(1)).alias("decoded"), F.sum(F.when(F.col("_has").isNull(), 1).otherwise(0)).alias("missing")
    )


def human_size(n: Column) -> Column:
    """Decimal units, one decimal from GB up."""
    x = n.cast("double")

    def text(v: Column, pattern: str, unit: str) -> Column:
        return F.concat(F.call_function("format_number", v, F.lit(pattern)), F.lit(unit))

    return (
        F.when(x < 1e3, text(x, "0", " B"))
        .when(x < 1e6, text(x / 1e3, "0", " KB"))
        .when(x < 1e9, text(x / 1e6, "0", " MB"))
        .when(x < 1e12, text(x / 1e9, "0.0", " GB"))
        .otherwise(text(x / 1e12, "0.0", " TB"))
    )


def inventory(manifest: DataFrame) -> DataFrame:
    g = manifest.where(F.lower("file_name").endswith(".ebl")).groupBy("boat_id")
    g = g.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return g.withColumn("size_text", human_size(F.col("bytes")))


def backup_plan(manifest: DataFrame, copy: DataFrame) -> DataFrame:
    """What a backup has to copy: absent or of another size."""
    return manifest.join(copy.select(*FILE_KEY, "size"), [*FILE_KEY, "size"], "left_anti")


def files_of_trips(trips: DataFrame, summaries: DataFrame, width_us: int) -> DataFrame:
    """Files whose time span overlaps each trip: what a trip has to read. Of two spans that overlap, one holds the
    other's start. Spans are matched as covers of time slices, which take a few rows however long a span is: a file
    whose clock jumped by decades costs no more than another."""
    f = summaries.select(F.col("boat_id").alias("_b"), "source", "file_no", "first_us", "last_us")
    t = trips.select("boat_id", "trip_no", "depart_us", "arrive_us")
    at = lambda c: time_slice(c, width_us)
    same = (F.col("boat_id") == F.col("_b")) & (F.col("p") == F.col("n"))
    in_file = t.withColumn("p", F.explode(ancestors(at("depart_us")))).join(f.withColumn("n", F.explode(cover(at("first_us"), at("last_us")))), same)
    in_trip = f.withColumn("p", F.explode(ancestors(at("first_us")))).join(t.withColumn("n", F.explode(cover(at("depart_us"), at("arrive_us")))), same)
    columns = ["boat_id", "trip_no", "source", "file_no"]
    both = in_file.where("depart_us BETWEEN first_us AND last_us").select(*columns).unionByName(in_trip.where("first_us > depart_us AND first_us <= arrive_us").select(*columns))
    return both.distinct()


def up_to_date(manifest: DataFrame, builds: DataFrame, signature: str) -> DataFrame:
    """Per boat whether the last build still stands: same inputs, and no file newer than it."""
    newest = manifest.groupBy("boat_id").agg(F.max("modified_us").alias("newest_us"))
    df = newest.join(builds, "boat_id", "left")
    ok = (F.col("built_us") >= F.col("newest_us")) & (F.col("signature") == signature)
    return df.select("boat_id", F.coalesce(ok, F.lit(False)).alias("current"), F.when(ok, F.col("trip_count")).alias("trip_count"))


def import_plan(staged: DataFrame, archive: DataFrame) -> DataFrame:
    """Where every staged file goes.

    staged: folder, file_name, sha1, first_us (NULL: unknown), entry_no; archive: year (NULL: none),
    folder, file_name, sha1. Files of an EBLnnnnnn folder move together: into the folder of that name
    if it holds no other content under one of their names, else into a renamed one. Other files go
    one by one under their year, with -1, -2, ... when the name is taken by something else.
    """
    c = F.col
    year_of = F.coalesce(F.year(F.timestamp_seconds(F.floor(c("first_us") / 1e6))).cast("string"), F.lit(UNKNOWN_YEAR))
    numbered = staged.withColumn("_group", c("folder").rlike(FOLDER) & c("file_name").rlike(FILE))

    # Folders.
    files = numbered.where("_group")
    group = files.groupBy("folder").agg(F.min("first_us").alias("first_us"))
    group = group.select("folder", year_of.alias("year"))
    known = archive.where(c("folder").rlike(FOLDER)).select("folder", c("year").alias("a_year"), "file_name", c("sha1").alias("a_sha1"))
    homes = known.groupBy("folder").agg(F.min_by(F.struct("a_year"), F.struct(c("a_year").isNotNull(), c("a_year"))).alias("h"))
    seen = known.join(homes.select("folder", c("h.a_year").alias("h_year")), "folder").where(c("a_year").eqNullSafe(c("h_year")))
    hit = files.join(seen.select("folder", "file_name", "a_sha1"), ["folder", "file_name"], "left")
    # One hash per folder over names and content hashes, in sorted order (a folder has at most 100 files).
    digest = F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat("file_name", "sha1"))), "")), 1, 8)
    state = hit.groupBy("folder").agg(F.max((c("a_sha1") != c("sha1")).cast("int")).alias("_clash"), digest.alias("_digest"))
    plan = hit.join(state, "folder").join(group, "folder").join(homes, "folder", "left")
    clash = F.coalesce(c("_clash"), F.lit(0)) == 1
    fresh = F.concat_ws("/", "year", "folder")
    target = F.when(clash, F.concat(fresh, F.lit("-"), c("_digest"))).when(c("h").isNotNull(), F.concat_ws("/", c("h.a_year"), c("folder"))).otherwise(fresh)
    same = ~clash & c("a_sha1").isNotNull()
    moved = plan.select(
        "entry_no", "folder", "file_name", F.concat(target, F.lit("/"), c("file_name")).alias("target"),
        F.when(same, "skipped_duplicate").otherwise("imported").alias("outcome"), clash.alias("renamed"),
    )

    # Loose files: the first holder of a name (archive, else first staged) is what others compare with.
    loose = numbered.where("NOT _group").withColumn("year", year_of)
    stem = r"^(.*?)(?:-(\d+))?(\.[^.]*)?$"
    taken = archive.where(~F.coalesce(c("folder").rlike(FOLDER), F.lit(False))).select("year", "file_name", c("sha1").alias("a_sha1"))
    suffixes = taken.select(
        "year", F.concat(F.regexp_extract("file_name", stem, 1), F.coalesce(F.regexp_extract("file_name", stem, 3), F.lit(""))).alias("file_name"),
        F.regexp_extract("file_name", stem, 2).try_cast("int").alias("_n"),
    ).where("_n > 0").distinct()
    # Numbers that are free before each taken one.
    by_number = Window.partitionBy("year", "file_name").orderBy("_n")
    gaps = suffixes.select("year", "file_name", (c("_n") - F.row_number().over(by_number)).cast("bigint").alias("_at"), F.lit(1).alias("_taken"))
    df = loose.join(taken, ["year", "file_name"], "left")
    w = Window.partitionBy("year", "file_name").orderBy("entry_no")
    df = df.withColumn("_holder", F.coalesce("a_sha1", F.first("sha1").over(w)))
    first = c("a_sha1").isNull() & (F.row_number().over(w) == 1)
    df = df.withColumn("_other", ~first & (c("sha1") != c("_holder"))).withColumn("_first", first)
    df = df.withColumn("_j", F.sum(c("_other").cast("int")).over(w))
    # The j-th free number is j and as many more as taken ones have fewer than j free ones before them.
    df = df.withColumns({"_at": c("_j"), "_taken": F.lit(0)}).unionByName(gaps, allowMissingColumns=True)
    upto = Window.partitionBy("year", "file_name").orderBy("_at", "_taken").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_free", c("_j") + F.sum("_taken").over(upto)).where("_taken = 0")
    suffixed = F.concat(
        F.regexp_extract("file_name", r"^(.*?)(\.[^.]*)?$", 1), F.lit("-"), c("_free").cast("string"),
        F.regexp_extract("file_name", r"^(.*?)(\.[^.]*)?$", 2),
    )
    name = F.when(c("_other"), suffixed).otherwise(c("file_name"))
    single = df.select(
        "entry_no", "folder", "file_name", F.concat(c("year"), F.lit("/"), name).alias("target"),
        F.when(~c("_first") & ~c("_other"), "skipped_duplicate").otherwise("imported").alias("outcome"), c("_other").alias("renamed"),
    )
    return moved.unionByName(single)
