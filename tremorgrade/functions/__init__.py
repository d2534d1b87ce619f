from tremorgrade.functions.geo import EARTH_RADIUS_KM, haversine_km
from tremorgrade.functions.numeric import hundredths, micros, percent_text, rounded, seconds_between

__all__ = [
    "EARTH_RADIUS_KM",
    "haversine_km",
    "hundredths",
    "micros",
    "percent_text",
    "rounded",
    "seconds_between",
]
