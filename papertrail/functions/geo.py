"""Geography: distance, cells, days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def cell(lat: Column, lon: Column, degrees: float) -> Column:
    return F.struct(F.floor(lat / degrees).alias("y"), F.floor(lon / degrees).alias("x"))


def day_bucket(ms: Column) -> Column:
    """Whole days since the epoch, in UTC."""
    return F.floor(ms / 86_400_000)
