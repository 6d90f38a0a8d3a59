"""Distances and grid cells on latitude/longitude columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6371000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * (2 * EARTH_RADIUS_M)


def cell_index(degrees: Column, cell_degrees: float) -> Column:
    return F.floor(degrees / cell_degrees)
