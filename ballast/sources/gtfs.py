"""GTFS text tables: scan and union over feeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.operators.filters import prefixed

# The columns kept of each table, and those that hold ids.
COLUMNS = {
    "routes": ["route_id", "agency_id", "route_short_name", "route_long_name", "route_type"],
    "trips": ["trip_id", "route_id", "service_id", "trip_short_name", "trip_headsign", "shape_id"],
    "stop_times": ["trip_id", "stop_sequence", "arrival_time", "departure_time", "stop_id"],
    "stops": ["stop_id", "stop_code", "stop_name", "stop_lat", "stop_lon", "parent_station", "location_type"],
    "calendar": ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
                 "start_date", "end_date"],
    "calendar_dates": ["service_id", "date", "exception_type"],
    "agency": ["agency_id", "agency_name"],
}
ID_COLUMNS = ("route_id", "agency_id", "trip_id", "service_id", "shape_id", "stop_id", "parent_station")


def read_gtfs(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """One text table, every column a string; None when the feed lacks it."""
    try:
        return (
            spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("mode", "PERMISSIVE").option("inferSchema", False).csv(f"{folder}/{table}.txt")
        )
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def merge_feeds(tables: Mapping[str, DataFrame], columns: Sequence[str], prefix: bool = True) -> DataFrame:
    """Rows of all feeds with a feed column: missing columns NULL, others dropped, ids made unique."""
    merged = None
    for feed, df in tables.items():
        def pick(name: str, df: DataFrame = df, feed: str = feed):
            if name not in df.columns:
                return F.lit(None).cast("string").alias(name)
            if prefix and name in ID_COLUMNS:
                return prefixed(name, feed).alias(name)
            return F.col(name)

        part = df.select(F.lit(feed).alias("feed"), *[pick(c) for c in columns])
        merged = part if merged is None else merged.unionByName(part)
    return merged
