"""Filters and row-wise repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.text import norm_station
from ballast.functions.time import NETWORK_ZONE, clock_seconds, dep_hour  # noqa: F401

# Rail among the GTFS route types.
RAIL_TYPE, RAIL_TYPES_FROM, RAIL_TYPES_TO = 2, 100, 117
NULL_ISLAND_DEGREES = 0.5
PRESENT_TYPES = ("MAINTENANCE", "DISRUPTION", "CALAMITY")


def is_rail() -> Column:
    kind = F.col("route_type").cast("int")
    return (kind == RAIL_TYPE) | kind.between(RAIL_TYPES_FROM, RAIL_TYPES_TO)


def rail_routes(routes: DataFrame) -> DataFrame:
    return routes.filter(is_rail())


def excluded_route_types(routes: DataFrame) -> DataFrame:
    """How many routes of each type the rail filter leaves out."""
    return routes.filter(~is_rail()).groupBy("route_type").agg(F.count("*").alias("n"))


def prefixed(col: str, feed: str) -> Column:
    return F.concat(F.lit(f"{feed}:"), F.nullif(F.col(col), F.lit("")))


def prefix_ids(df: DataFrame, feed: str, cols: list[str]) -> DataFrame:
    """Make ids unique over feeds; empty ids become NULL."""
    return df.withColumns({c: prefixed(c, feed) for c in cols})


def with_dep_s(stop_times: DataFrame) -> DataFrame:
    """Departure as seconds of day, from the arrival where no departure is given."""
    clock = F.coalesce(F.nullif(F.col("departure_time"), F.lit("")), F.col("arrival_time"))
    return stop_times.withColumn("dep_s", clock_seconds(clock))


def stations(stops: DataFrame) -> DataFrame:
    """Stops that are the parent of a stop, or have none."""
    chosen = stops.select(F.coalesce("parent_station", "stop_id").alias("stop_id"))
    return stops.join(chosen, "stop_id", "left_semi").select(
        F.col("stop_id").alias("station_id"), "feed", "stop_name",
        F.col("stop_lat").cast("double").alias("lat"), F.col("stop_lon").cast("double").alias("lon"), "stop_code",
    )


def repair_null_island(stations: DataFrame) -> DataFrame:
    """Coordinates at (0, 0) are taken from a station of the same name, else removed."""
    misplaced = (F.abs("lat") <= NULL_ISLAND_DEGREES) & (F.abs("lon") <= NULL_ISLAND_DEGREES)
    keyed = stations.withColumn("_name", norm_station(F.col("stop_name")))
    donors = (
        keyed.filter(F.col("lat").isNotNull() & ~misplaced)
        .groupBy("_name")
        .agg(F.min_by(F.struct("lat", "lon"), "station_id").alias("_donor"))
    )
    wrong = F.coalesce(misplaced, F.lit(False))
    return keyed.join(donors, "_name", "left").select(
        "station_id", "feed", "stop_name",
        F.when(wrong, F.col("_donor.lat")).otherwise(F.col("lat")).alias("lat"),
        F.when(wrong, F.col("_donor.lon")).otherwise(F.col("lon")).alias("lon"),
        "stop_code",
    )


def in_event_window(df: DataFrame, as_of: int, past: int = 2700, future: int = 900, ts: str = "event_ts") -> DataFrame:
    return df.filter(F.col(ts).between(as_of - past, as_of + future))


def sane_deltas(df: DataFrame, limit: int = 7200) -> DataFrame:
    return df.filter(F.abs("delta_s") <= limit)


def relevant_disruptions(disruptions: DataFrame, dialect: str) -> DataFrame:
    """Disruptions that can affect track: by type and activity, or by severity of effect."""
    if dialect == "sections":
        return disruptions.filter(F.col("type").isin(*PRESENT_TYPES) & F.col("is_active"))
    if dialect == "impacts":
        return disruptions.filter(F.col("effect") == "NO_SERVICE")
    if dialect == "alerts":
        return disruptions.filter(F.col("effect") == "NO_SERVICE")
    raise ValueError(f"unknown dialect {dialect!r}")


def positioned_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def visible_trains(trains: DataFrame, edge_passages: DataFrame, edge_cancels: DataFrame,
                   as_of: int, window_s: int, edge: str | None = None) -> DataFrame:
    """Trains seen in the window; with an edge, those that passed it or were cancelled over it."""
    floor = as_of - window_s
    if edge is None:
        return trains.filter(F.col("last_ts") >= floor).withColumns(
            {"edge_delta": F.lit(None).cast("int"), "edge_cancel_ts": F.lit(None).cast("bigint")}
        )
    over = F.col("edge") == edge
    passed = edge_passages.filter(over & (F.col("ts") >= floor)).select("row_id", F.col("delta_s").alias("edge_delta"))
    cancelled = edge_cancels.filter(over & (F.col("ts") >= floor)).select("row_id", F.col("ts").alias("edge_cancel_ts"))
    joined = trains.join(passed, "row_id", "left").join(cancelled, "row_id", "left")
    return joined.filter(F.col("edge_delta").isNotNull() | F.col("edge_cancel_ts").isNotNull())


def active_closures(closures: DataFrame, as_of: DataFrame | int, zone: str = NETWORK_ZONE) -> DataFrame:
    """Edges planned shut at an instant: its local date and hour lie in a block of the edge."""
    if not isinstance(as_of, DataFrame):
        as_of = closures.sparkSession.range(1).select(F.lit(as_of).cast("bigint").alias("as_of"))
    local = F.from_utc_timestamp(F.timestamp_seconds("as_of"), zone)
    instants = as_of.select("as_of", F.date_format(local, "yyyyMMdd").alias("d"), F.hour(local).alias("_hour"))
    shut = closures.join(instants, "d").filter(F.col("_hour").between(F.col("hour_start"), F.col("hour_end")))
    return shut.select("as_of", "edge").distinct()


def exclude(df: DataFrame, other: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows without a counterpart; a NULL key never has one."""
    return df.join(other, on, "left_anti")
