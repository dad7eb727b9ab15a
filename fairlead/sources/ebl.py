"""Raw log files as a DataFrame of records, for batch and streaming.

Spark lists and reads the files (binaryFile: any Hadoop file system, one row per file of about 5 MB,
also as a stream); finding the records in a file's bytes is the only Python step and runs on Arrow
batches, file by file.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.operators.frames import SYSTEM_TIME

# A record: ESC SOH, bytes with every ESC doubled, then ESC and one more byte. Only ESC NL ends a valid
# record; any other byte after the ESC discards it. An unfinished record at the end never matches.
RECORD = re.compile(rb"\x1b\x01((?:[^\x1b]++|\x1b\x1b)*+)\x1b([^\x1b])", re.DOTALL)
BATCH_ROWS = 20_000
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
RECORD_SCHEMA = "path string, seq bigint, body binary"


def record_bodies(data: bytes, wanted: frozenset[int] | None = None) -> Iterator[bytes]:
    """Unstuffed records of more than four bytes; with ``wanted`` only those messages."""
    for body, end in RECORD.findall(data):
        if end != b"\n":
            continue
        body = body.replace(b"\x1b\x1b", b"\x1b")
        if len(body) <= 4:
            continue
        if wanted is not None and (len(body) < 9 or _pgn(body) not in wanted):
            continue
        yield body


def _pgn(body: bytes) -> int:
    can_id = int.from_bytes(body[5:9], "little")
    pgn = (can_id >> 8) & 0x1FFFF
    return pgn if (pgn >> 8) & 0xFF >= 240 else pgn & 0x1FF00


def _framer(wanted: frozenset[int] | None):
    def frame(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                bodies = list(record_bodies(content.as_py(), wanted))
                for start in range(0, len(bodies), BATCH_ROWS):
                    part = bodies[start : start + BATCH_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([path.as_py()] * len(part), pa.string()),
                            pa.array(range(start, start + len(part)), pa.int64()),
                            pa.array(part, pa.binary()),
                        ],
                        names=["path", "seq", "body"],
                    )

    return frame


#: Room for the record numbers of one file in ``seq``.
FILE_RECORDS = 1 << 32


def boat_of(path: Column, boat: int | None) -> Column:
    """The boat that ``boat=N/`` in a path names, else ``boat``; a path that names none is refused."""
    named = F.regexp_extract(path, r"boat=(\d+)/", 1).try_cast("int")
    refused = F.raise_error(F.concat(F.lit("no boat=N/ in the path, and no boat given: "), path)).cast("int")
    return F.coalesce(named, refused if boat is None else F.lit(boat))


def number_files(files: DataFrame, boat: int | None = None) -> DataFrame:
    """(path, boat_id, file_no) of files: numbered per boat in sorted path order, whatever their names."""
    paths = files.select("path").distinct().withColumn("boat_id", boat_of(F.col("path"), boat))
    in_order = Window.partitionBy("boat_id").orderBy("path")
    return paths.withColumn("file_no", (F.row_number().over(in_order) - 1).cast("bigint"))


def records(files: DataFrame, pgns: Iterable[int] | None = None, boat: int | None = None) -> DataFrame:
    """Records of files (path, content) with boat, file number and arrival number. ``pgns`` drops other
    messages while scanning; System Time always stays.

    Files are numbered per boat in sorted path order. ``seq`` is the arrival number over all files of a
    boat: the file's number and the record's number in it. A stream can't number files that are still to
    come: there the number in a regular name counts, and a hash of the path for any other.
    """
    wanted = None if pgns is None else frozenset(pgns) | {SYSTEM_TIME}
    df = files.select("path", "content").mapInArrow(_framer(wanted), RECORD_SCHEMA)
    if files.isStreaming:
        name = r"EBL(\d{6})/[^/]*_(\d{3})\.ebl$"
        number = F.regexp_extract("path", name, 1).try_cast("bigint") * 1000 + F.regexp_extract("path", name, 2).try_cast("bigint")
        other = F.pmod(F.xxhash64("path"), F.lit(1 << 30)) + (1 << 30)  # behind all regular numbers
        df = df.select("path", boat_of(F.col("path"), boat).alias("boat_id"), F.coalesce(number, other).alias("file_no"), "seq", "body")
    else:
        df = df.join(number_files(files, boat), "path")
    return df.select("boat_id", "path", "file_no", (F.col("file_no") * FILE_RECORDS + F.col("seq")).alias("seq"), "body")


def read_ebl(spark: SparkSession, root: str, pgns: Iterable[int] | None = None, boat: int | None = None) -> DataFrame:
    """Records of all ``*.ebl`` files below ``root``; ``boat`` is the boat of paths without ``boat=N/``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ebl").load(root)
    return records(files, pgns, boat)


def stream_ebl(spark: SparkSession, root: str, pgns: Iterable[int] | None = None, files_per_batch: int = 1000, boat: int | None = None) -> DataFrame:
    """New files as they land."""
    files = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.ebl").option("maxFilesPerTrigger", files_per_batch).load(root)
    )
    return records(files, pgns, boat)
