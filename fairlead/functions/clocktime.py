"""UTC microseconds, local time and calendar keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairlead.params import US

# Rough boxes (lat from, lat to, lon from, lon to) of Western Europe's civil zones.
WET_BOXES = [(49.5, 61.0, -11.0, 2.0), (36.8, 42.2, -9.6, -6.0)]
CET_BOX = (36.0, 71.0, -9.5, 15.5)


def to_ntz(us: Column) -> Column:
    """BIGINT microseconds as a TIMESTAMP_NTZ, whatever the session time zone."""
    seconds = (us / F.lit(US)).cast("decimal(20,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")
    )


def day_of(us: Column) -> Column:
    """Calendar date of a (local or UTC) microsecond count."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / F.lit(86_400 * US)).cast("int"))


def clock_text(us: Column) -> Column:
    """HH:MM of a microsecond count."""
    minutes = F.floor(F.pmod(us, F.lit(86_400 * US)) / F.lit(60 * US)).cast("int")
    return F.concat(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def last_sunday_us(year: Column, month: int) -> Column:
    """01:00 UTC on the last Sunday of a month that has 31 days."""
    eighth_last = F.make_date(year, F.lit(month), F.lit(24))
    sunday = F.next_day(eighth_last, "Sun")
    return (F.unix_date(sunday).cast("bigint") * 86_400 + 3600) * US


def is_eu_summer(us: Column) -> Column:
    year = F.year(day_of(us))
    return (us >= last_sunday_us(year, 3)) & (us < last_sunday_us(year, 10))


def utc_offset_hours(lat: Column, lon: Column, us: Column) -> Column:
    """Estimated offset: the civil zone in Western Europe, else 15 degrees per hour; plus EU summer time."""

    def inside(box):
        return lat.between(box[0], box[1]) & lon.between(box[2], box[3])

    solar = F.greatest(F.lit(-12), F.least(F.lit(14), F.bround(lon / 15).cast("int")))
    base = F.when(inside(WET_BOXES[0]) | inside(WET_BOXES[1]), 0).when(inside(CET_BOX), 1).otherwise(solar)
    return (base + F.when(is_eu_summer(us), 1).otherwise(0)).cast("double")


def local_us(us: Column, offset_hours: Column) -> Column:
    return us + (offset_hours * 3600 * US).cast("bigint")


def rounded_minutes(us: Column) -> Column:
    """Half-even, like the figures people add up by hand."""
    return F.bround(us / F.lit(60 * US)).cast("bigint")


def hours_text(us: Column) -> Column:
    m = rounded_minutes(us)
    return F.concat(F.floor(m / 60).cast("string"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))
