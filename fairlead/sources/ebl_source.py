"""Log files as a Spark data source, ``ebl``: one reader for batch and stream.

    register(spark)
    spark.read.format("ebl").option("pgns", "129025,126992").load("/archive")
    spark.readStream.format("ebl").option("boatBytesPerTrigger", 64 << 20).option("progress", "/progress").load("/archive")

Rows are frames: boat_id, path, file_no, seq, priority, pgn, source, destination, data. A file is cut into byte
ranges, so that no row and no task holds a whole file. A range begins at its first *border* and ends at the first
one at or after its end: after ESC NL that follows another byte, the framing rule waits for a record, whatever
state it was in before. Unwanted messages are dropped while a range is scanned.

Files are numbered per boat (``boat=N/`` in the path, else the option ``boat``) in sorted path order; ``seq`` is
the arrival number over all files of a boat: the file's number and the record's first byte in it.

The stream's offset says for each boat how far it has come: path, bytes, and number of files up to it. Files are
taken in path order, whatever their names. A boat's last file may still grow: it is read up to its last complete
record; once a later file is there, to its end. A file that sorts before the offset came too late for its place:
it stops the stream (option ``late`` = skip: it is left out).

Spark asks for the latest offset before it tells where a stream stands. So a bounded first trigger needs
``progress``, a folder of this stream alone where the last planned offset is kept; without it the first trigger
after a start takes all there is, and later ones are bounded.

Options: boat; pgns (comma-separated: only those and System Time); pushdown (true: filters on ``pgn`` are answered
by the scan; only for a loaded table that a plan reads in one place, since Spark 4.1 keeps one set of pushed filters
per loaded table and would answer all places with the last one's); rangeBytes; partitionBytes (ranges read by one
task); boatBytesPerTrigger (per boat; all there is without it); progress; late (fail or skip).

Paths are those of pyarrow's file systems (local, s3, gs, hdfs); ``sources.ebl.read_ebl`` reads any other that
Spark knows. Files are listed by the driver, a few hundred bytes each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from fairlead.operators.frames import SYSTEM_TIME
from fairlead.sources.ebl import FILE_RECORDS, RECORD

SCHEMA = "boat_id int, path string, file_no bigint, seq bigint, priority int, pgn int, source int, destination int, data binary"
RANGE_BYTES, PARTITION_BYTES = 4 << 20, 32 << 20
#: What a search for the next border reads at once.
PEEK_BYTES = 1 << 16
BORDER = re.compile(rb"[^\x1b]\x1b\n")
_BOAT = re.compile(r"boat=(\d+)/")
_ARROW = pa.schema([("boat_id", pa.int32()), ("path", pa.string()), ("file_no", pa.int64()), ("seq", pa.int64()), *((c, pa.int32()) for c in ("priority", "pgn", "source", "destination")), ("data", pa.binary())])


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


@dataclass(frozen=True)
class LogFile:
    boat: int
    path: str
    size: int


def list_files(root: str, boat: int | None) -> dict[int, list[LogFile]]:
    """The ``*.ebl`` files below ``root`` by boat, in path order."""
    store, top = filesystem(root)
    found: dict[int, list[LogFile]] = {}
    for info in store.get_file_info(fs.FileSelector(top, recursive=True)):
        if info.type != fs.FileType.File or not info.path.endswith(".ebl"):
            continue
        named = _BOAT.search(info.path)
        if named is None and boat is None:
            raise ValueError(f"no boat=N/ in the path, and no boat given: {info.path}")
        own = int(named[1]) if named else boat
        found.setdefault(own, []).append(LogFile(own, info.path, info.size))
    return {b: sorted(files, key=lambda f: f.path) for b, files in sorted(found.items())}


def border(file: pa.NativeFile, at: int, limit: int) -> int:
    """The first border at or after byte ``at``, or ``limit``. The begin of a file is one."""
    if at <= 0:
        return 0
    begin = max(0, at - 3)
    while begin < limit:
        data = file.read_at(min(PEEK_BYTES, limit - begin), begin)
        m = BORDER.search(data)
        if m:
            return begin + m.end()
        if begin + len(data) >= limit:
            break
        begin += len(data) - 2
    return limit


def complete_end(file: pa.NativeFile, at: int, size: int) -> int:
    """The end of the last complete record of a file that may still grow, from ``at`` on, where a record is
    waited for."""
    tail = PEEK_BYTES
    while True:
        begin = max(at, size - tail)
        known = at if begin == at else border(file, begin, size)
        ends = [m.end() for m in RECORD.finditer(file.read_at(size - known, known))]
        if ends:
            return known + ends[-1]
        if begin == at:
            return at
        tail *= 4


@dataclass(frozen=True)
class Range:
    """Bytes of a file: from the first border at ``begin`` (``begin`` itself if ``exact``) to the first one at
    ``end``; nothing behind ``limit`` is read."""

    boat: int
    path: str
    file_no: int
    begin: int
    end: int
    limit: int
    exact: bool


class Ranges(InputPartition):
    def __init__(self, ranges: list[Range]):
        self.value = ranges


def cut(boat: int, path: str, file_no: int, begin: int, limit: int, size: int) -> Iterator[Range]:
    """Ranges of the bytes from ``begin``, where a record is waited for, to ``limit``."""
    for lo in range(begin, limit, size):
        yield Range(boat, path, file_no, lo, min(lo + size, limit), limit, lo == begin)


def bundled(ranges: Iterator[Range], size: int) -> list[Ranges]:
    """Partitions of consecutive ranges, about ``size`` bytes each."""
    out, own, held = [], [], 0
    for r in ranges:
        own.append(r)
        held += r.end - r.begin
        if held >= size:
            out.append(Ranges(own))
            own, held = [], 0
    return out + ([Ranges(own)] if own else [])


def frames_of(data: bytes, first: int, wanted: frozenset[int] | None) -> tuple[np.ndarray, dict[str, np.ndarray], list[bytes]]:
    """Frames in the bytes of a range: first byte of each, fields, payloads. Records with another header or a wrong
    length byte are dropped, with ``wanted`` also those of other messages."""
    at, bodies = [], []
    for m in RECORD.finditer(data):
        if m[2] == b"\n":
            body = m[1].replace(b"\x1b\x1b", b"\x1b")
            if len(body) >= 10:
                at.append(first + m.start())
                bodies.append(body)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    begin = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int32)
    byte = lambda i: flat[begin + i]
    source, low, high, top = byte(5), byte(6), byte(7), byte(8)
    broadcast = high >= 240
    pgn = (top & 1) << 16 | high << 8 | np.where(broadcast, low, 0)
    good = (byte(0) == 7) & (byte(1) == 0x95) & (byte(2) == sizes - 3)
    if wanted is not None:
        good &= np.isin(pgn, list(wanted))
    keep = np.flatnonzero(good)
    fields = {"priority": top >> 2 & 7, "pgn": pgn, "source": source, "destination": np.where(broadcast, 255, low)}
    return np.array(at, np.int64)[keep], {k: v[keep] for k, v in fields.items()}, [bodies[i][9:] for i in keep]


def read_ranges(ranges: list[Range], root: str, wanted: frozenset[int] | None) -> Iterator[pa.RecordBatch]:
    store, _ = filesystem(root)
    for r in ranges:
        with store.open_input_file(r.path) as file:
            lo = r.begin if r.exact else border(file, r.begin, r.limit)
            hi = r.limit if r.end >= r.limit else border(file, r.end, r.limit)
            data = file.read_at(hi - lo, lo) if hi > lo else b""
        at, fields, payloads = frames_of(data, lo, wanted)
        n = len(at)
        if n:
            columns = [pa.array(np.full(n, r.boat, np.int32)), pa.array([r.path] * n, pa.string()), pa.array(np.full(n, r.file_no)), pa.array(r.file_no * FILE_RECORDS + at)]
            columns += [pa.array(fields[c].astype(np.int32)) for c in ("priority", "pgn", "source", "destination")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(payloads, pa.binary())], schema=_ARROW)


class _Options:
    def __init__(self, options: dict):
        self.root = options["path"]
        self.boat = int(options["boat"]) if options.get("boat") else None
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.per_trigger = int(options["boatBytesPerTrigger"]) if options.get("boatBytesPerTrigger") else None
        self.progress = options.get("progress")
        self.late = options.get("late", "fail")
        self.pushdown = str(options.get("pushdown", "")).lower() == "true"
        pgns = options.get("pgns")
        self.wanted = frozenset(int(p) for p in pgns.split(",")) | {SYSTEM_TIME} if pgns else None


class EblReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = _Options(options)
        self.wanted = self.options.wanted

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Filters on ``pgn`` are answered while scanning; the others are left to Spark."""
        for f in filters:
            if self.options.pushdown and isinstance(f, (EqualTo, In)) and f.attribute == ("pgn",):
                asked = frozenset(v for v in ([f.value] if isinstance(f, EqualTo) else f.value) if v is not None)
                self.wanted = asked if self.wanted is None else self.wanted & asked
            else:
                yield f

    def partitions(self) -> Sequence[Ranges]:
        o = self.options
        files = ((n, f) for own in list_files(o.root, o.boat).values() for n, f in enumerate(own))
        return bundled((r for n, f in files for r in cut(f.boat, f.path, n, 0, f.size, o.range_bytes)), o.partition_bytes)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return read_ranges(partition.value if partition else [], self.options.root, self.wanted)


class EblStreamReader(DataSourceStreamReader):
    """Offsets: {boat: [path, bytes of it, files up to it]}."""

    def __init__(self, options: dict):
        self.options = _Options(options)
        self.planned: dict | None = None  # the last offset this reader knows to be planned

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def _known(self) -> dict | None:
        if self.planned is None and self.options.progress:
            store, top = filesystem(self.options.progress)
            at = f"{top}/offset.json"
            self.planned = {}
            if store.get_file_info(at).type == fs.FileType.File:
                with store.open_input_stream(at) as file:
                    self.planned = json.loads(file.read())
        return self.planned

    def latestOffset(self) -> dict:  # noqa: N802
        o, known = self.options, self._known()
        out = dict(known or {})
        for boat, files in list_files(o.root, o.boat).items():
            place = self._advanced(files, (known or {}).get(str(boat)), None if known is None else o.per_trigger)
            if place:
                out[str(boat)] = place
        return out

    def _advanced(self, files: list[LogFile], place: list | None, room: int | None) -> list | None:
        """How far one boat comes within ``room`` bytes."""
        path, done, count = place or ("", 0, 0)
        if sum(f.path <= path for f in files) > count and self.options.late != "skip":
            raise ValueError(f"files before {path} came after it was read: start a new stream, or set late=skip")
        store, _ = filesystem(self.options.root)
        for i, f in enumerate(files):
            if f.path < path:
                continue
            begin = done if f.path == path else 0
            with store.open_input_file(f.path) as file:
                end = f.size if i < len(files) - 1 else complete_end(file, begin, f.size)
                if room is not None and end - begin > room:
                    end = border(file, begin + max(1, room), end)
            if end > begin or f.path > path and i < len(files) - 1:
                count += f.path > path
                path, done = f.path, end
            if room is not None:
                room -= end - begin
                if room <= 0:
                    break
        return [path, done, count] if path else None

    def partitions(self, start: dict, end: dict) -> Sequence[Ranges]:
        o = self.options
        if any(place[:2] > end.get(boat, ["", 0])[:2] for boat, place in start.items()):
            raise ValueError("the progress folder is behind the checkpoint: it belongs to another stream, or was lost")
        self.planned = end
        if o.progress:
            store, top = filesystem(o.progress)
            store.create_dir(top, recursive=True)
            with store.open_output_stream(f"{top}/offset.json") as file:
                file.write(json.dumps(end).encode())
        return bundled(self._between(start, end), o.partition_bytes)

    def _between(self, start: dict, end: dict) -> Iterator[Range]:
        o = self.options
        for boat, files in list_files(o.root, o.boat).items():
            if str(boat) not in end:
                continue
            path, done, count = start.get(str(boat)) or ("", 0, 0)
            last, upto, _ = end[str(boat)]
            number = count - 1
            for f in files:
                if f.path < path or f.path > last:
                    continue
                number += f.path > path
                limit = upto if f.path == last else f.size
                yield from cut(f.boat, f.path, number, done if f.path == path else 0, limit, o.range_bytes)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return read_ranges(partition.value, self.options.root, self.options.wanted)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class EblSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ebl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EblReader:
        return EblReader(self.options)

    def streamReader(self, schema) -> EblStreamReader:  # noqa: N802
        return EblStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format ``ebl`` known to the session, with its filters pushed down."""
    spark.dataSource.register(EblSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
