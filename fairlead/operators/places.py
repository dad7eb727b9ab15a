"""Place names, hourly weather and sea data, remarks: joins with lookup tables.

Where the lookup has to be near rather than equal, both sides get a grid cell and the join is an
equi-join on cells. Lookup tables may be large, so no side is forced to be broadcast; Spark broadcasts
whichever side its statistics show to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions.geo import haversine_m
from fairlead.functions.text import PREFIX_MOORING, PREFIX_WATER, fixed
from fairlead.params import KMH_PER_KN

# Search radii, the score below which a leisure place counts as obscure, the order in
# which address parts are preferred, and what boats tie up at.
LANDMARK_RADIUS_M = 300.0
NEARBY_M = 250.0
OBSCURE_IMPORTANCE = 0.001
ADDRESS_ORDER = ["leisure", "marina", "harbour", "town", "village", "city", "municipality", "suburb", "quarter"]
VILLAGE_ORDER = ["town", "village", "city", "municipality", "suburb", "quarter"]
MOORING_TYPES = ["marina", "harbour", "quay", "mooring", "yacht_club", "boatyard"]


def _first_of(address: Column, keys: list[str]) -> Column:
    return F.coalesce(*[F.try_element_at(address, F.lit(k)) for k in keys])


def coordinates_text(lat: Column, lon: Column) -> Column:
    return F.concat(fixed(lat, 4), F.lit(", "), fixed(lon, 4))


def place_name(lat: Column, lon: Column) -> Column:
    """Name of a matched place from its columns category, name, importance, address, display_name."""
    c = F.col
    leisure = (c("category") == "leisure") & (F.coalesce(c("name"), F.lit("")) != "")
    obscure = F.coalesce(c("importance"), F.lit(1.0)) < OBSCURE_IMPORTANCE
    known = F.when(c("name") != "", c("name"))
    shown = F.when(c("display_name") != "", F.element_at(F.split("display_name", ","), 1))
    return F.coalesce(
        F.when(leisure & obscure, _first_of(c("address"), VILLAGE_ORDER)),
        F.when(leisure, c("name")),
        _first_of(c("address"), ADDRESS_ORDER),
        known,
        shown,
        F.concat(F.lit("Onbekend ("), coordinates_text(lat, lon), F.lit(")")),
    )


def with_distance(name: Column, metres: Column, mooring: Column) -> Column:
    """Says so when the name is not quite where the boat is."""
    prefix = F.when(F.coalesce(mooring, F.lit(False)), PREFIX_MOORING).otherwise(PREFIX_WATER)
    return F.when(F.coalesce(metres <= NEARBY_M, F.lit(True)), name).otherwise(F.concat(prefix, F.lit(" "), name))


def _plain_number(x: Column, decimals: int) -> Column:
    """A rounded number without exponent: at least one decimal, no zeros at the end, no negative zero."""
    text = F.bround(x, decimals).cast(f"decimal({decimals + 12},{max(1, decimals)})").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ".0")


def position_key(lat: Column, lon: Column, decimals: int = 3) -> Column:
    return F.concat(_plain_number(lat, decimals), F.lit(","), _plain_number(lon, decimals))


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("int")


def nearest_landmark(points: DataFrame, landmarks: DataFrame, id_cols: list[str]) -> DataFrame:
    """The nearest named islet or lock within 300 m of each point (lat, lon), with its distance.

    Points look into their own and the neighbouring cells of a grid of 0.005 degrees of latitude; in
    longitude a cell is widened with the latitude so that 300 m never skips one. A row of cells closes at
    180 degrees: its last cell is the neighbour of its first.
    """
    lat_size = 0.005

    def lon_cells(lat_cell: Column) -> Column:
        # Cells in the row, by the width at its edge farther from the equator (capped near the poles).
        edge = F.greatest(F.abs(lat_cell), F.abs(lat_cell + 1)) * lat_size
        return F.floor(360 / lat_size * F.greatest(F.cos(F.radians(F.least(edge, F.lit(89.0)))), F.lit(0.01)))

    def lon_cell(lon: Column, lat_cell: Column, step: Column) -> Column:
        n = lon_cells(lat_cell)
        return F.pmod(F.floor((lon + 180) / 360 * n) + step, n).cast("int")

    marks = landmarks.where("name IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").select(
        F.col("lat").alias("m_lat"), F.col("lon").alias("m_lon"), F.col("name").alias("m_name"), (F.col("kind") == "lock").alias("m_mooring")
    )
    marks = marks.withColumn("_cy", _cell(F.col("m_lat"), lat_size))
    marks = marks.withColumn("_cx", lon_cell(F.col("m_lon"), F.col("_cy"), F.lit(0)))
    near = points.select(*id_cols, "lat", "lon").withColumn("_dy", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])))
    near = near.withColumn("_cy", _cell(F.col("lat"), lat_size) + F.col("_dy"))
    near = near.withColumn("_dx", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])))
    near = near.withColumn("_cx", lon_cell(F.col("lon"), F.col("_cy"), F.col("_dx")))
    both = near.join(marks, ["_cy", "_cx"])
    dist = haversine_m(F.col("lat"), F.col("lon"), F.col("m_lat"), F.col("m_lon"))
    both = both.withColumn("m", dist).where(F.col("m") <= LANDMARK_RADIUS_M)
    best = F.min(F.struct("m", "m_name", "m_mooring"))
    return both.groupBy(*id_cols).agg(best.alias("b")).select(*id_cols, F.col("b.m").alias("metres"), F.col("b.m_name").alias("landmark"), F.col("b.m_mooring").alias("mooring"))


def resolve_places(points: DataFrame, places: DataFrame, landmarks: DataFrame, id_cols: list[str]) -> DataFrame:
    """Adds ``place``: the nearest landmark, else the looked-up place of the rounded position, else
    coordinates."""
    c = F.col
    found = nearest_landmark(points, landmarks, id_cols)
    looked = places.select(
        c("cell"), c("lat").alias("f_lat"), c("lon").alias("f_lon"), "category", "type", "name", "importance", "address", "display_name"
    )
    df = points.withColumn("cell", position_key(c("lat"), c("lon"))).join(looked, "cell", "left").join(found, id_cols, "left")
    own = with_distance(place_name(c("lat"), c("lon")), haversine_m(c("lat"), c("lon"), c("f_lat"), c("f_lon")), c("type").isin(*MOORING_TYPES))
    mark = with_distance(c("landmark"), c("metres"), c("mooring"))
    known = c("category").isNotNull() | c("address").isNotNull() | c("display_name").isNotNull() | c("name").isNotNull()
    place = F.when(c("landmark").isNotNull(), mark).when(known, own).otherwise(coordinates_text(c("lat"), c("lon")))
    return df.withColumn("place", place).select(*points.columns, "place")


def resolve_trip_places(trips: DataFrame, places: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Names for both ends of every trip, worked out anew on every run; the placeholders of trips that
    begin or end outside the data stay."""
    c = F.col
    ids = ["boat_id", "trip_no", "end"]
    ends = trips.select("boat_id", "trip_no", F.explode(F.array(
        F.struct(F.lit("depart").alias("end"), c("depart_lat").alias("lat"), c("depart_lon").alias("lon"), c("depart_unknown").alias("unknown")),
        F.struct(F.lit("arrive").alias("end"), c("arrive_lat").alias("lat"), c("arrive_lon").alias("lon"), c("arrive_unknown").alias("unknown")),
    )).alias("x")).select("boat_id", "trip_no", "x.*")
    named = resolve_places(ends.where("unknown IS NULL"), places, landmarks, ids)
    every = named.unionByName(ends.where("unknown IS NOT NULL").withColumn("place", c("unknown")))
    wide = every.groupBy("boat_id", "trip_no").agg(
        F.max(F.when(c("end") == "depart", c("place"))).alias("depart_place"), F.max(F.when(c("end") == "arrive", c("place"))).alias("arrive_place")
    )
    return trips.join(wide, ["boat_id", "trip_no"], "left")


def rekey_cache(cache: DataFrame, decimals: int = 3) -> DataFrame:
    """Entries of a name cache under the key of another precision; malformed keys vanish and of
    entries that fall together the last one (by ``entry_no``) stays."""
    parts = F.split("cell", ",")
    lat, lon = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    # A comparison with a number that could not be read, or is none, is not true.
    ok = (F.size(parts) == 2) & (F.abs(lat) <= 90) & (F.abs(lon) <= 360)
    df = cache.where(ok).withColumn("cell", position_key(lat, lon, decimals))
    return df.groupBy("cell").agg(F.max_by("name", "entry_no").alias("name"))


# Hourly data --------------------------------------------------------------------------------------


def explode_hours(raw: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Parallel hourly arrays to one row per hour; arrays shorter than the time axis give NULL."""
    values = F.arrays_zip(F.col("time"), *[F.col(src) for src in fields])
    rows = raw.select("date", "lat2", "lon2", F.explode(F.slice(values, F.lit(1), F.size("time"))).alias("h"))
    return rows.select("date", "lat2", "lon2", F.col("h.time").alias("hour"), *[F.col(f"h.{src}").alias(out) for src, out in fields.items()])


WEATHER = {"wind_speed_10m": "wind_kn", "wind_direction_10m": "wind_deg", "precipitation": "precip_mm", "cloud_cover": "cloud_pct"}
MARINE = {
    "wave_height": "wave_height_m", "wave_direction": "wave_direction_deg", "wave_period": "wave_period_s",
    "ocean_current_velocity": "current_kmh", "ocean_current_direction": "current_direction_deg",
}


def weather_hours(raw: DataFrame) -> DataFrame:
    return explode_hours(raw, WEATHER)


def marine_hours(raw: DataFrame) -> DataFrame:
    df = explode_hours(raw, MARINE)
    return df.withColumn("current_kn", F.col("current_kmh") / KMH_PER_KN).drop("current_kmh")


def join_hourly(points: DataFrame, hours: DataFrame) -> DataFrame:
    """Points (time_us, lat, lon) with the values of their hour and position rounded to 2 decimals."""
    from fairlead.functions.clocktime import day_of

    hour_us = 3_600_000_000
    hour = F.concat(
        F.date_format(day_of(F.col("time_us")), "yyyy-MM-dd"), F.lit("T"),
        F.lpad(F.pmod(F.floor(F.col("time_us") / hour_us), F.lit(24)).cast("string"), 2, "0"), F.lit(":00"),
    )
    df = points.withColumn("hour", hour).withColumn("date", F.substring("hour", 1, 10))
    df = df.withColumn("lat2", F.bround("lat", 2)).withColumn("lon2", F.bround("lon", 2))
    return df.join(hours, ["date", "lat2", "lon2", "hour"], "left").drop("date", "lat2", "lon2")


def with_remarks(trips: DataFrame, remarks: DataFrame) -> DataFrame:
    return trips.join(remarks.select("trip_uid", "remark"), "trip_uid", "left")
