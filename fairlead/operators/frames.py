"""From raw CAN records to time-stamped messages.

Files are the natural slice here: they are about 5 MB each and read by one task each, and all state
that spans files is one small row per file (see scan.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.functions.bits import bits, payload_hex
from fairlead.operators.scan import scan, settle

SYSTEM_TIME = 126992
FAST_PACKET_PGNS = [127489, 127497]
# The messages that are decoded.
WANTED_PGNS = [129025, 129026, 127489, 127488, 129539, 127497, 128267, 130312, 127508, 127257, 130306, 128259, 130313]
DAY_US = 86_400_000_000


def parse_records(records: DataFrame) -> DataFrame:
    """Splits unstuffed records (``body``: 07 95, length, two time bytes, CAN id, data) into message
    fields; drops records with another header or a wrong length byte."""
    h = F.hex("body")

    def byte(i: int) -> Column:
        return F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int")

    n = F.length("body")
    good = (F.substring(h, 1, 4) == "0795") & (n >= 10) & (byte(2) == n - 3)
    df = records.where(good)
    source, ps, pf, top = byte(5), byte(6), byte(7), byte(8)
    page = top.bitwiseAND(F.lit(1))
    base = F.shiftleft(page, 16) + F.shiftleft(pf, 8)
    keep = [c for c in records.columns if c != "body"]
    return df.select(
        *keep,
        source.alias("source"),
        F.when(pf < 240, ps).otherwise(255).alias("destination"),
        F.shiftright(top, 2).bitwiseAND(F.lit(7)).alias("priority"),
        F.when(pf < 240, base).otherwise(base + ps).alias("pgn"),
        F.expr("substring(body, 10)").alias("data"),
    )


def keep_pgns(frames: DataFrame, pgns: list[int] | None = None) -> DataFrame:
    """Only wanted messages; System Time always passes, the clock needs it. A plain IN filter, so it
    is pushed into Parquet or into the record source."""
    return frames.where(F.col("pgn").isin([*(pgns or WANTED_PGNS), SYSTEM_TIME]))


def reassemble(frames: DataFrame) -> DataFrame:
    """Joins multi-frame messages of one (file, source, PGN).

    A frame with index 0 opens a message. The following frames count while index and sequence number
    fit; the message is complete with the first frame that brings enough bytes. Everything else is
    dropped. A message has at most 32 frames, so the collected lists are tiny.
    """
    c = F.col
    keys = ["boat_id", "file_no", "source", "pgn"]
    df = frames.where(c("pgn").isin(FAST_PACKET_PGNS) & (F.length("data") >= 2)).withColumn("_h", F.hex("data"))
    head = F.conv(F.substring("_h", 1, 2), 16, 10).cast("int")
    df = df.withColumn("_idx", head.bitwiseAND(F.lit(31))).withColumn("_ctr", F.shiftright(head, 5))
    w = Window.partitionBy(*keys).orderBy("seq")
    df = df.withColumn("_msg", F.sum((c("_idx") == 0).cast("int")).over(w)).where("_msg > 0")
    m = Window.partitionBy(*keys, "_msg").orderBy("seq")
    df = df.withColumn("_rn", F.row_number().over(m) - 1)
    odd = (c("_idx") != c("_rn")) | (c("_ctr") != F.first("_ctr").over(m))
    df = df.withColumn("_odd", F.max(odd.cast("int")).over(m)).where("_odd = 0")
    piece = F.when(c("_idx") == 0, F.substring("_h", 5, 12)).otherwise(F.substring("_h", 3, 14))
    total = F.first(F.conv(F.substring("_h", 3, 2), 16, 10).cast("int")).over(m)
    df = df.withColumn("_piece", piece).withColumn("_total", total)
    df = df.withColumn("_got", F.sum(F.length("_piece") / 2).over(m))
    # Complete once the bytes before this frame were not yet enough and now they are.
    df = df.where(c("_got") - F.length("_piece") / 2 < F.greatest(c("_total"), F.lit(1)))
    parts = F.array_sort(F.collect_list(F.struct("_rn", "_piece")))
    g = df.groupBy(*keys, "_msg").agg(
        F.max("seq").alias("seq"), F.max("_got").alias("_got"), F.first("_total").alias("_total"), parts.alias("_parts"),
        F.max_by("destination", "seq").alias("destination"), F.max_by("priority", "seq").alias("priority"),
    )
    text = F.array_join(F.transform("_parts", lambda x: x["_piece"]), "")
    data = F.unhex(F.substring(text, F.lit(1), c("_total") * 2))
    return g.where("_got >= _total").select(*keys, "seq", "destination", "priority", data.alias("data"))


def messages(frames: DataFrame) -> DataFrame:
    """Single-frame messages as they are, multi-frame ones reassembled."""
    cols = ["boat_id", "file_no", "seq", "source", "destination", "priority", "pgn", "data"]
    single = frames.where(~F.col("pgn").isin(FAST_PACKET_PGNS))
    return single.select(*cols).unionByName(reassemble(frames).select(*cols))


def system_times(frames: DataFrame) -> DataFrame:
    """Readings of the bus clock that decode."""
    df = frames.where(F.col("pgn") == SYSTEM_TIME).withColumn("_h", payload_hex(F.col("data")))
    days, ticks = bits(F.col("_h"), 16, 16, False), bits(F.col("_h"), 32, 32, False)
    df = df.withColumn("clock_us", days * DAY_US + ticks * 100)
    return df.where("clock_us IS NOT NULL").select("boat_id", "file_no", "seq", "source", "clock_us")


def _keys(across_files: bool) -> tuple[list[str], str]:
    return (["boat_id"], "file_no") if across_files else (["boat_id", "file_no"], "_one")


def elect_clock(readings: DataFrame, across_files: bool = True, carried: DataFrame | None = None) -> DataFrame:
    """Which reading sets the time: the source with strictly most readings so far leads, a tie keeps
    the leader. The leader's count is always the highest so far, so a reading takes or keeps the lead
    exactly when its own count exceeds every earlier count.

    ``carried`` (boat_id, last_us, leader, source_counts; see carried_clock) is the state after the files before
    these, one row per boat at most.
    """
    keys, slice_col = _keys(across_files)
    df = readings if across_files else readings.withColumn("_one", F.lit(0))
    one = F.lit(1).cast("bigint")
    # Clock readings are a sliver of the traffic; each step is written out for the next one.
    df = scan(settle(df), [*keys, "source"], slice_col, ["seq"], running_sum={"nth": one})
    if carried is not None:
        df = df.join(carried.select("boat_id", "source_counts", F.col("leader").alias("_leader")), "boat_id", "left")
        df = df.withColumn("nth", F.col("nth") + F.coalesce(F.try_element_at("source_counts", F.col("source")), F.lit(0)))
        df = df.withColumn("_most", F.array_max(F.map_values("source_counts"))).drop("source_counts")
    df = scan(settle(df), keys, slice_col, ["seq"], max_before={"best": F.col("nth")})
    if carried is not None:
        df = df.withColumn("best", F.greatest("best", "_most")).drop("_most")
    leads = F.coalesce(F.col("nth") > F.col("best"), F.lit(True))
    df = scan(df, keys, slice_col, ["seq"], fill={"leader": F.when(leads, F.col("source"))})
    if carried is not None:
        df = df.withColumn("leader", F.coalesce("leader", "_leader")).drop("_leader")
    return df.withColumn("trusted", F.col("source") == F.col("leader")).drop("best", "_one")


def stamp(frames: DataFrame, clock: DataFrame, across_files: bool = True, carried: DataFrame | None = None) -> DataFrame:
    """Every message gets the last trusted clock reading before it, if need be the one carried over from the
    files before; earlier messages are dropped."""
    keys, slice_col = _keys(across_files)
    other = frames.where(F.col("pgn") != SYSTEM_TIME)
    ticks = clock.where("trusted").select("boat_id", "file_no", "seq", F.col("clock_us").alias("_t"))
    both = other.withColumn("_t", F.lit(None).cast("bigint")).unionByName(ticks, allowMissingColumns=True)
    both = both if across_files else both.withColumn("_one", F.lit(0))
    df = scan(both, keys, slice_col, ["seq"], fill={"time_us": F.col("_t")})
    if carried is not None:
        df = df.join(carried.select("boat_id", "last_us"), "boat_id", "left").withColumn("time_us", F.coalesce("time_us", "last_us")).drop("last_us")
    return df.where("pgn IS NOT NULL AND time_us IS NOT NULL").drop("_t", "_one")


def clock_state(clock: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """What a later run needs to go on after each file: last time, leader and readings per source."""
    per = clock.groupBy("boat_id", "file_no", "source").agg(F.count(F.lit(1)).alias("n"))
    files = per.select("boat_id", "file_no").distinct()
    sources = per.select("boat_id", "source", F.lit(0).cast("bigint").alias("before"))
    if carried is not None:
        sources = sources.unionByName(carried.select("boat_id", F.explode("source_counts").alias("source", "before")))
    sources = sources.groupBy("boat_id", "source").agg(F.max("before").alias("before"))
    # A boat has a handful of clock sources: files x sources stays a small table.
    grid = files.join(sources, "boat_id").join(per, ["boat_id", "file_no", "source"], "left")
    w = Window.partitionBy("boat_id", "source").orderBy("file_no")
    grid = grid.withColumn("total", F.col("before") + F.sum(F.coalesce("n", F.lit(0))).over(w)).where("total > 0")
    counts = grid.groupBy("boat_id", "file_no").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "total")))).alias("source_counts")
    )
    last = clock.groupBy("boat_id", "file_no").agg(
        F.max_by("leader", "seq").alias("leader"), F.max_by("clock_us", F.when(F.col("trusted"), F.col("seq"))).alias("_t")
    )
    boat = Window.partitionBy("boat_id").orderBy("file_no")
    last = last.withColumn("last_us", F.last("_t", ignorenulls=True).over(boat)).drop("_t")
    if carried is not None:
        last = last.join(carried.select("boat_id", F.col("last_us").alias("_before")), "boat_id", "left").withColumn("last_us", F.coalesce("last_us", "_before")).drop("_before")
    return last.join(counts, ["boat_id", "file_no"])


def carried_clock(states: DataFrame, starts: DataFrame) -> DataFrame:
    """Per boat the clock's state (see clock_state) after the last file before the one of ``starts`` (boat_id,
    file_no): what decoding from that file on begins with."""
    before = states.join(starts.select("boat_id", F.col("file_no").alias("_start")), "boat_id").where("file_no < _start")
    state = F.max_by(F.struct("last_us", "leader", "source_counts"), "file_no")
    return before.groupBy("boat_id").agg(state.alias("s")).select("boat_id", "s.*")


def from_files(frames: DataFrame, starts: DataFrame) -> DataFrame:
    """Frames of each boat's files from the one of ``starts`` on; boats without a start keep all."""
    marks = starts.select("boat_id", F.col("file_no").alias("_start"))
    return frames.join(marks, "boat_id", "left").where("_start IS NULL OR file_no >= _start").drop("_start")


def first_timestamps(frames: DataFrame, files: DataFrame) -> DataFrame:
    """First time each file can tell on its own; NULL where it cannot."""
    own = elect_clock(system_times(frames), across_files=False)
    stamped = stamp(keep_pgns(frames), own, across_files=False)
    first = stamped.groupBy("boat_id", "file_no").agg(F.min_by("time_us", "seq").alias("first_us"))
    return files.join(first, ["boat_id", "file_no"], "left")
