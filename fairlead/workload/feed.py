"""Queries over log files: every message of the telemetry view written as the bytes a bus logger writes, and read
back by the ``ebl`` source, as a batch and as a stream of many triggers.

Messages of two types come in several frames, some lost or sent twice; some records have a broken header, a wrong
length or end in the middle. Every fourth file has an irregular name, which sorts behind the regular ones of its
folder, so arrival order is not event order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlead.functions.bits import little_endian as le
from fairlead.operators import frames as fr
from fairlead.operators.scan import compiled_methods, steps_folder
from fairlead.sources import ebl_source
from fairlead.streaming import decode as stream_decode
from fairlead.workload import bus
from fairlead.workload.frames import _ENGINE, _K, _SENT, _elected, _hex
from fairlead.workload.oracle import add_step
from fairlead.workload.registry import landed, query

#: Bytes of a boat's files that one trigger of the query takes.
TRIGGER_BYTES = 1 << 18


def _body(pgn: str, source: str, data) -> F.Column:
    """A record's bytes in hex, before escaping: broken ones by the rules of the telemetry view."""
    can = F.concat(le(F.col(source).cast("bigint"), 1), le(F.expr(f"{pgn} % 256"), 1), le(F.expr(f"({pgn} div 256) % 256"), 1), le(F.expr(f"12 + {pgn} div 65536"), 1))
    broken = (F.col("pgn") == 129025) & F.expr("e % 31 = 0")
    wrong = (F.col("pgn") == 129025) & F.expr("e % 37 = 0")
    length = (F.length(data) / 2 + 6 + F.when(wrong, 1).otherwise(0)).cast("bigint")
    return F.concat(F.when(broken, "0796").otherwise(F.lit("0795")), le(length, 1), le(F.expr("e % 65536"), 2), can, data)


def _records(tele: DataFrame) -> DataFrame:
    """(boat_id, file_no, seq, t): the bytes of every record in hex, as they stand in the file."""
    whole = bus.frames(tele).withColumn("h", F.hex("data")).withColumn("e", F.expr("seq div 16"))
    n = F.length("h") / 2
    several = F.col("pgn").isin(fr.FAST_PACKET_PGNS)
    count = F.when(several, F.greatest(F.lit(1), F.ceil((n + 1) / 7))).otherwise(1).cast("int")
    df = whole.withColumn("i", F.explode(F.sequence(F.lit(0), count - 1)))
    counter = F.expr("(e div 5) % 8") * 32 + F.col("i")
    piece = F.when(F.col("i") == 0, F.concat(le(n.cast("bigint"), 1), F.rpad(F.substring("h", 1, 12), 12, "F"))).otherwise(F.rpad(F.expr("substring(h, 13 + (i - 1) * 14, 14)"), 14, "F"))
    data = F.when(several, F.concat(le(counter.cast("bigint"), 1), piece)).otherwise(F.col("h"))
    df = df.withColumn("data", data).where("NOT (e % 7 = 0 AND (pgn = 127489 AND i = 2 OR pgn = 127497 AND i = 1))")
    df = df.withColumn("extra", F.explode(F.when(several & F.expr("e % 13 = 0 AND i = 1"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    body = _body("pgn", "source", F.col("data"))
    escaped = F.replace(F.replace(F.regexp_replace(body, "(..)", "$1 "), F.lit("1B "), F.lit("1B1B ")), F.lit(" "), F.lit(""))
    noise = F.when(F.expr("e % 41 = 0 AND i = 0"), "001B0107951B41").otherwise(F.lit(""))
    return df.select("boat_id", "file_no", "seq", "i", "extra", F.concat(noise, F.lit("1B01"), escaped, F.lit("1B0A")).alias("t"))


def _path() -> F.Column:
    number = F.col("file_no")
    folder = F.format_string("boat=%d/EBL%06d/", "boat_id", F.expr("file_no div 100"))
    return F.concat(folder, F.when(number % 4 == 3, F.format_string("log%03d.ebl", number % 100)).otherwise(F.format_string("%06d_%03d.ebl", F.expr("file_no div 100"), number % 100)))


def write_archive(spark, sf: str) -> str:
    """Writes one log file per boat and file number below a new shared folder. A file is one row here."""
    root = f"{steps_folder(spark)}/archive-{uuid.uuid4().hex}"
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "i", "extra", "t"))), lambda x: x["t"]), "")
    files = _records(landed(spark, sf)).groupBy("boat_id", "file_no").agg(F.unhex(text).alias("content")).select(_path().alias("path"), "content")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = ebl_source.filesystem(root)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                at = f"{top}/{path}"
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                own = f"{at}.{uuid.uuid4().hex}"  # whole or not at all, also when a task runs twice
                with store.open_output_stream(own) as file:
                    file.write(content.as_buffer())
                store.move(own, at)
            yield pa.RecordBatch.from_arrays([batch.column("path")], names=["path"])

    with compiled_methods(spark):
        files.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
    return root


_archives: dict[tuple[str, str], str] = {}


def archive(spark, sf: str) -> str:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _archives:
        _archives[key] = write_archive(spark, sf)
    return _archives[key]


_CLOCK = "(time_us + CASE WHEN src = 12 THEN 1000000 ELSE 0 END)"
_DAYS = f"(CASE WHEN e % 51 = 0 THEN 65535 ELSE {_CLOCK} // 86400000000 END)"
_TICKS = f"(({_CLOCK} % 86400000000) // 100)"
_WATER = f"(CASE WHEN e % 2 = 0 THEN {_hex('wt_raw', 2)} ELSE {_hex('ot_raw', 2)} END)"
_PAYLOADS = {
    129025: f"{_hex('lat_raw', 4)} || {_hex('lon_raw', 4)}",
    129026: f"'00FC' || {_hex('cog_raw', 2)} || {_hex('sog_raw', 2)} || 'FFFF'",
    127489: _ENGINE,
    127488: f"{_hex('inst', 1)} || {_hex('rpm_raw', 2)} || 'FFFFFFFFFF'",
    127497: f"{_hex('inst', 1)} || {_hex('tfuel_raw', 2)} || 'FFFFFFFFFFFF'",
    128267: f"'FF' || {_hex('depth_raw', 4)} || {_hex('doff_raw', 2)} || 'FF'",
    130312: f"'0000' || {_hex('(e % 2)', 1)} || {_WATER} || 'FFFFFF'",
    130313: f"'0000' || {_hex('(e % 3)', 1)} || {_hex('hum_raw', 2)} || 'FFFFFF'",
    128259: f"'FF' || {_hex('stw_raw', 2)} || 'FFFFFFFFFF'",
    129539: f"'FF' || {_hex('(mode_raw * 8)', 1)} || {_hex('hdop_raw', 2)} || 'FFFFFFFF'",
    130306: f"'FF' || {_hex('ws_raw', 2)} || {_hex('wa_raw', 2)} || {_hex('wref_raw', 1)} || 'FFFF'",
    127508: f"{_hex('(e % 2)', 1)} || {_hex('volt_raw', 2)} || 'FFFFFFFFFF'",
    127257: f"'FFFFFF' || {_hex('pitch_raw', 2)} || {_hex('roll_raw', 2)} || 'FF'",
    126992: f"'00F0' || {_hex(_DAYS, 2)} || {_hex(_TICKS, 4)}",
}
# What gets lost: broken records, and whole messages of several frames with a frame missing or sent twice.
_LOST = {129025: "(e % 31 = 0 OR e % 37 = 0)", 127489: "(e % 19 <> 3 AND (e % 7 = 0 OR e % 13 = 0))", 127497: "(e % 19 <> 3 AND e % 7 = 0)"}
add_step(
    "feed_tele",
    """SELECT *, dense_rank() OVER (PARTITION BY boat_id ORDER BY path) - 1 AS file_rank, CASE WHEN (e // 400) % 2 = 0 THEN CASE WHEN e % 5 < 3 THEN 10 ELSE 12 END ELSE CASE WHEN e % 5 < 1 THEN 10 ELSE 12 END END AS src FROM (
    SELECT *, printf('EBL%06d/', file_no // 100) || CASE WHEN file_no % 4 = 3 THEN printf('log%03d.ebl', file_no % 100) ELSE printf('%06d_%03d.ebl', file_no // 100, file_no % 100) END AS path FROM tele)""",
)


def _messages_sql(pgn: int) -> str:
    data = f"CASE WHEN e % 19 = 3 THEN ({_PAYLOADS[pgn]})[1:4] ELSE {_PAYLOADS[pgn]} END" if pgn != 126992 else _PAYLOADS[pgn]
    source = "src" if pgn == 126992 else "source"
    return f"SELECT boat_id, file_rank AS file_no, file_rank * 4294967296 + e * 16 + {_K[pgn]} AS seq, {pgn} AS pgn, {source} AS source, {data} AS data, time_us, e FROM feed_tele WHERE {_SENT[pgn]} AND NOT {_LOST.get(pgn, 'false')}"


add_step("feed", " UNION ALL ".join(map(_messages_sql, _SENT)))
_NUMBERED = "row_number() OVER (PARTITION BY boat_id, file_no ORDER BY seq) - 1 AS k"


def _numbered(df: DataFrame) -> DataFrame:
    """Messages with their number in their file, in place of the record's first byte."""
    in_file = Window.partitionBy("boat_id", "file_no").orderBy("seq")
    return df.withColumn("k", F.row_number().over(in_file) - 1).withColumn("data", F.hex("data"))


@query("src1_source_messages", "boat_id:i | file_no:i | k:i | source:i | pgn:i | data:s", f"FROM (SELECT *, {_NUMBERED} FROM feed)")
def src1_source(spark, sf):
    """Log files of all message types read in byte ranges, multi-frame messages reassembled."""
    ebl_source.register(spark)
    pgns = ",".join(map(str, fr.WANTED_PGNS))
    return _numbered(fr.messages(spark.read.format("ebl").option("pgns", pgns).option("rangeBytes", 1 << 16).load(archive(spark, sf))))


add_step("feed_clock", f"SELECT boat_id, file_no, seq, source, time_us + CASE WHEN source = 12 THEN 1000000 ELSE 0 END AS clock_us FROM feed WHERE pgn = 126992 AND e % 51 <> 0")
add_step("feed_elected", _elected("boat_id", "feed_clock"))


@query(
    "st1_stream_messages",
    "boat_id:i | file_no:i | k:i | source:i | pgn:i | time_us:i | data:s",
    f"""FROM (SELECT *, {_NUMBERED} FROM (SELECT x.boat_id, x.file_no, x.seq, x.source, x.pgn, x.data, c.clock_us AS time_us FROM (SELECT * FROM feed WHERE pgn <> 126992) x
      ASOF JOIN (SELECT * FROM feed_elected WHERE source = leader) c ON x.boat_id = c.boat_id AND x.seq >= c.seq))""",
)
def st1_messages(spark, sf):
    """The same files as a stream of many triggers: frames, reassembly and clock carried over as state."""
    ebl_source.register(spark)
    out = f"{steps_folder(spark)}/messages-{uuid.uuid4().hex}"
    frames = (
        spark.readStream.format("ebl").option("pgns", ",".join(map(str, fr.WANTED_PGNS))).option("rangeBytes", 1 << 16)
        .option("boatBytesPerTrigger", max(TRIGGER_BYTES, _bytes(spark, sf) // 6)).option("progress", f"{out}-progress").load(archive(spark, sf))
    )
    messages = stream_decode.stamped(frames).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
    q = messages.trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return _numbered(spark.read.parquet(out))


def _bytes(spark, sf: str) -> int:
    """Bytes of the boat with most of them."""
    return max(sum(f.size for f in files) for files in ebl_source.list_files(archive(spark, sf), None).values())
