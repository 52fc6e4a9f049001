"""Great-circle distance and the district gazetteer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values (must equal the source application's constants) ----------
# Earth radius in km used by the distance formula.
EARTH_RADIUS_KM = 6371.0
# District name (lower case) -> (latitude, longitude), 21 entries, in the
# application's order.
GAZETTEER: dict[str, tuple[float, float]] = {
    "orchard": (1.3048, 103.8318),
    "tanjong pagar": (1.276, 103.844),
    "marina bay": (1.284, 103.859),
    "jurong": (1.26, 103.67),
    "holland": (1.312, 103.793),
    "city hall": (1.293, 103.853),
    "clarke quay": (1.2905, 103.8468),
    "changi": (1.3592, 103.989),
    "dempsey": (1.306, 103.805),
    "tampines": (1.3546, 103.9458),
    "sentosa": (1.2543, 103.8239),
    "bugis": (1.299, 103.857),
    "geylang": (1.309, 103.892),
    "raffles place": (1.283, 103.851),
    "kallang": (1.3023, 103.864),
    "katong": (1.308, 103.901),
    "little india": (1.305, 103.855),
    "kampong glam": (1.300, 103.859),
    "harbourfront": (1.265, 103.822),
    "tanglin": (1.307, 103.816),
    "mandai": (1.4042, 103.7885),
}
# Point used when a customer's district is missing or unknown.
DEFAULT_POINT: tuple[float, float] = (1.29, 103.85)
# Merchant coordinates used when the lat / lon field is absent from a record.
DEFAULT_MERCHANT_LAT = 1.29
DEFAULT_MERCHANT_LON = 103.85
# ---------------------------------------------------------------------------


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in km; NULL when any input is NULL.

    ``1 - a`` is clamped at 0 so that rounding near antipodes cannot take
    ``sqrt`` below zero.
    """
    half_dlat = F.sin(F.radians(lat2 - lat1) / 2)
    half_dlon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_dlat * half_dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (
        half_dlon * half_dlon
    )
    c = 2 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))
    return F.lit(EARTH_RADIUS_KM) * c


def _gazetteer_map() -> Column:
    pairs = []
    for name, (lat, lon) in GAZETTEER.items():
        pairs += [F.lit(name), F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))]
    return F.create_map(*pairs)


def district_point(district: Column) -> Column:
    """``struct<lat, lon>`` of a district name: lower-cased (no trim), looked up
    in the 21-entry gazetteer, default point when missing or unknown.

    The gazetteer is a fixed 21-entry literal map, so the lookup is a codegen'd
    expression rather than a join.
    """
    key = F.lower(F.coalesce(district, F.lit("")))
    hit = F.try_element_at(_gazetteer_map(), key)
    default = F.struct(
        F.lit(DEFAULT_POINT[0]).alias("lat"), F.lit(DEFAULT_POINT[1]).alias("lon")
    )
    return F.coalesce(hit, default)


# The points requests can stand at: the gazetteer, then the default point.
POINTS: tuple[tuple[float, float], ...] = (*GAZETTEER.values(), DEFAULT_POINT)


def _points_array() -> Column:
    return F.array(
        *[F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon")) for lat, lon in POINTS]
    )


def point_index(lat: Column, lon: Column) -> Column:
    """Position of a point in ``POINTS``; -1 when it is none of them, NULL
    without a point."""
    at = F.array_position(_points_array(), F.struct(lat.alias("lat"), lon.alias("lon")))
    return F.when(lat.isNotNull(), (at - 1).cast("int"))


def distances_km(lat: Column, lon: Column) -> Column:
    """Distances from a place to every one of ``POINTS``, as array<double>."""
    return F.transform(_points_array(), lambda p: haversine_km(p["lat"], p["lon"], lat, lon))
