"""Numbers and sensor values as logbook text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds in knots of Beaufort 0 to 11, and the compass points.
BEAUFORT_KN = [1, 4, 7, 11, 17, 22, 28, 34, 41, 48, 56, 64]
COMPASS = ["N", "NNO", "NO", "ONO", "O", "OZO", "ZO", "ZZO", "Z", "ZZW", "ZW", "WZW", "W", "WNW", "NW", "NNW"]
PREFIX_MOORING = "aan de kant, bij"
PREFIX_WATER = "op het water, bij"


def fixed(value: Column, decimals: int = 1) -> Column:
    """Fixed-point text, half-even and without grouping."""
    return F.call_function("format_number", value, F.lit("0." + "0" * decimals if decimals else "0"))


def comma(value: Column, decimals: int = 1) -> Column:
    return F.replace(fixed(value, decimals), F.lit("."), F.lit(","))


def beaufort(kn: Column) -> Column:
    force = F.lit(12)
    for i, limit in reversed(list(enumerate(BEAUFORT_KN))):
        force = F.when(kn < limit, i).otherwise(force)
    return force


def compass(deg: Column) -> Column:
    index = F.pmod(F.bround(deg / 22.5).cast("int"), F.lit(16))
    return F.element_at(F.array(*[F.lit(p) for p in COMPASS]), index + 1)


def wind_side(angle: Column, reference: Column) -> Column:
    """Angle from the bow with its side for bow-related references, plain degrees otherwise."""
    a = F.pmod(angle, F.lit(360.0))
    sided = F.when(a > 180, F.concat(comma(360 - a, 0), F.lit("° port"))).otherwise(F.concat(comma(a, 0), F.lit("° starboard")))
    return F.when(reference.isin(2, 3, 4), sided).otherwise(F.concat(comma(a, 0), F.lit("°")))


def place_kind(place: Column) -> Column:
    return F.when(place.startswith(PREFIX_MOORING + " "), "mooring").when(place.startswith(PREFIX_WATER + " "), "water")


def place_plain(place: Column) -> Column:
    return F.regexp_replace(place, f"^({PREFIX_MOORING}|{PREFIX_WATER}) ", "")


def range_text(avg: Column, low: Column, high: Column, unit: str, decimals: int, notable: float) -> Column:
    """The mean, with the range only if it is wide enough to matter."""
    wide = F.concat(F.lit(" ("), comma(low, decimals), F.lit("–"), comma(high, decimals), F.lit(unit + ")"))
    return F.when(avg.isNull(), "").otherwise(
        F.concat(comma(avg, decimals), F.lit(unit), F.when(high - low > notable, wide).otherwise(F.lit("")))
    )


def joined(*parts: Column, sep: str = ", ") -> Column:
    """The non-null parts joined; NULL parts vanish."""
    return F.array_join(F.array_compact(F.array(*parts)), sep)
