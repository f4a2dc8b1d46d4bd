"""Great-circle arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in km on a sphere of radius 6371 km; null if any input is null."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)) + a * 0  # least/greatest skip nulls, the sum does not
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def usable_position(lat: Column, lon: Column) -> Column:
    """True for positions in range that are neither null nor NaN nor exactly 0/0."""
    return F.coalesce(
        lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon) & ~((lat == 0) & (lon == 0)),
        F.lit(False),
    )
