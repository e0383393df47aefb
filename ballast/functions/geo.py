"""Distances and grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(chord))


def cell(coordinate: Column, size: float = 0.01) -> Column:
    """Index of the grid cell whose centre is nearest."""
    return F.floor(coordinate * (1.0 / size) + 0.5).cast("bigint")


def grid_cells(df: DataFrame, lat: str = "lat", lon: str = "lon", size: float = 0.01, reach_m: float = 0) -> DataFrame:
    """Add cell_y, cell_x; with a reach, one row per cell that holds a point so near, wider towards the poles."""
    out = df.withColumn("cell_y", cell(F.col(lat), size)).withColumn("cell_x", cell(F.col(lon), size))
    if reach_m:
        degrees = math.degrees(reach_m / EARTH_RADIUS_M)
        narrow = F.cos(F.radians(F.least(F.abs(F.col(lat)) + degrees, F.lit(89.9))))
        up, across = F.lit(math.ceil(degrees / size)), F.ceil(F.lit(degrees / size) / narrow).cast("int")
        y, x = F.col("cell_y"), F.col("cell_x")
        out = out.withColumn("cell_x", F.explode(F.sequence(x - across, x + across)))
        out = out.withColumn("cell_y", F.explode(F.sequence(y - up, y + up)))
    return out


def segment_id(a: Column, b: Column) -> Column:
    """Unordered pair of clusters in one string."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def colour_class(p90: Column) -> Column:
    """0 below one minute, 1 to two minutes, 2 to ten minutes, 3 beyond."""
    return F.when(p90 < 60, 0).when(p90 <= 120, 1).when(p90 <= 600, 2).otherwise(3)
