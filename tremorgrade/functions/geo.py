"""Great-circle distance as SQL expression text."""

from __future__ import annotations

EARTH_RADIUS_KM = 6371


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle distance in kilometres between two points in degrees.

    Rounding noise may carry two opposite points just past 1, the end of the
    arc sine; only that is cut. A missing coordinate gives null.
    """
    lat_term = f"power(sin(radians(({lat1} - {lat2}) / 2)), 2)"
    lon_term = f"power(sin(radians(({lon1} - {lon2}) / 2)), 2)"
    chord = f"{lat_term} + cos(radians({lat2})) * cos(radians({lat1})) * {lon_term}"
    held = f"CASE WHEN {chord} BETWEEN 1 AND 1.000001D THEN 1.0D ELSE {chord} END"
    return f"2 * {EARTH_RADIUS_KM} * asin(sqrt({held}))"
