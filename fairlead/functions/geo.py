"""Great-circle distances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairlead.params import EARTH_RADIUS_M, EARTH_RADIUS_NM


def _arc(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # Not least(): that skips NULLs and would turn a missing position into half the globe.
    return F.asin(F.sqrt(F.when(a > 1.0, 1.0).otherwise(a))) * 2


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return _arc(lat1, lon1, lat2, lon2) * F.lit(EARTH_RADIUS_NM)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return _arc(lat1, lon1, lat2, lon2) * F.lit(EARTH_RADIUS_M)
