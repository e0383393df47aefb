"""Lookups, cascades and comparisons between tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.operators.filters import rail_routes
from ballast.operators.sequence_tools import beside, present, running_total

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def used_stops(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Ids of stops in use and of their parents."""
    used = stop_times.select("stop_id").distinct()
    parent = F.nullif(F.col("parent_station"), F.lit(""))
    parents = stops.join(used, "stop_id", "left_semi").select(parent.alias("stop_id"))
    return used.union(parents.filter(F.col("stop_id").isNotNull())).distinct()


def filter_feed(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Rail-only tables of one feed: each table keeps what the previous one still refers to."""
    out = {"routes": rail_routes(tables["routes"])}
    out["trips"] = tables["trips"].join(out["routes"], "route_id", "left_semi")
    out["stop_times"] = tables["stop_times"].join(out["trips"], "trip_id", "left_semi")
    keep = used_stops(out["stop_times"], tables["stops"])
    out["stops"] = tables["stops"].join(keep, "stop_id", "left_semi")
    if "agency" in tables:
        out["agency"] = tables["agency"].join(out["routes"], "agency_id", "left_semi").distinct()
    for name in ("calendar", "calendar_dates"):
        if name in tables:
            out[name] = tables[name].join(out["trips"], "service_id", "left_semi")
    if "transfers" in tables:
        kept = out["stops"].select("stop_id")
        transfers = tables["transfers"]
        for end in ("from_stop_id", "to_stop_id"):
            transfers = transfers.join(kept.withColumnRenamed("stop_id", end), end, "left_semi")
        out["transfers"] = transfers.select(*tables["transfers"].columns)
    if "shapes" in tables and "shape_id" in tables["trips"].columns:
        out["shapes"] = tables["shapes"].join(out["trips"], "shape_id", "left_semi")
    return out


def assign_clusters(stops: DataFrame, station_cluster: DataFrame) -> DataFrame:
    """Cluster of each stop through its station."""
    station = stops.select("stop_id", F.coalesce("parent_station", "stop_id").alias("station_id"))
    return station.join(station_cluster, "station_id").select("stop_id", "cluster_id")


def resolve_stops(updates: DataFrame, stop_cluster: DataFrame, feed_of_country: Mapping[str, str]) -> DataFrame:
    """Cluster of a realtime stop id; NULL where the timetable does not know it."""
    pairs = [F.lit(x) for item in feed_of_country.items() for x in item]
    feed = F.create_map(*pairs)[F.col("country")]
    known = stop_cluster.select(F.col("stop_id").alias("_full"), F.col("cluster_id").alias("cluster"))
    keyed = updates.withColumn("_full", F.concat(feed, F.lit(":"), F.nullif(F.col("stop_id"), F.lit(""))))
    return keyed.join(known, "_full", "left").drop("_full")


def trip_metadata(trips: DataFrame, routes: DataFrame, stop_times: DataFrame, stops: DataFrame,
                  stop_cluster: DataFrame, clusters: DataFrame) -> dict[str, DataFrame]:
    """Headers (trip_id, train_number, route) and merged stops (trip_id, pos, cluster, name, arr, dep).

    Consecutive stops of one cluster count as one: first arrival, last departure. Stops
    without a cluster never merge and show their own name or id.
    """
    named = routes.select("route_id", F.col("route_short_name").alias("route")).dropDuplicates(["route_id"])
    first = [F.nullif(F.col(c), F.lit("")) for c in ("trip_short_name", "trip_headsign", "route")]
    headers = trips.join(named, "route_id", "left").select(
        "trip_id", F.coalesce(*first, F.col("trip_id")).alias("train_number"), "route"
    )
    names = clusters.select(F.col("cluster_id").alias("cluster"), F.col("name").alias("_cname"))
    seq = (
        stop_times.join(stops.select("stop_id", "stop_name"), "stop_id", "left")
        .join(stop_cluster.select("stop_id", F.col("cluster_id").alias("cluster")), "stop_id", "left")
        .join(names, "cluster", "left")
        .select("trip_id", F.col("stop_sequence").cast("int").alias("seq"), "cluster",
                F.coalesce(F.col("_cname"), F.col("cluster"), F.nullif(F.col("stop_name"), F.lit("")), F.col("stop_id")).alias("name"),
                "arrival_time", "departure_time")
    )
    paired = beside(seq, ["trip_id"], ["seq"], ["cluster"], forward=False)
    fresh = F.coalesce(F.col("prev_cluster") != F.col("cluster"), F.lit(True)).cast("int")
    numbered = running_total(paired.withColumn("_fresh", fresh), ["trip_id"], ["seq"], F.col("_fresh"),
                             None, "pos")
    merged = numbered.groupBy("trip_id", "pos").agg(
        F.min_by(F.struct("cluster", "name", "arrival_time"), "seq").alias("_in"),
        F.max_by(F.struct("departure_time"), "seq").alias("_out"),
    )
    stops_out = merged.select(
        "trip_id", F.col("pos").cast("bigint").alias("pos"), "_in.cluster", "_in.name",
        F.col("_in.arrival_time").alias("arr"), F.col("_out.departure_time").alias("dep"),
    )
    return {"headers": headers, "stops": stops_out}


def service_days(calendar: DataFrame, calendar_dates: DataFrame, dates: DataFrame) -> DataFrame:
    """Dates each service runs on: (weekday pattern in range + additions) - removals."""
    keys = present(calendar, "feed", "service_id")
    runs = F.explode(F.filter(F.array(*[
        F.when(F.col(day) == "1", F.lit(i)) for i, day in enumerate(WEEKDAYS)
    ]), lambda w: w.isNotNull()))
    weekly = calendar.select(*keys, "start_date", "end_date", runs.alias("wd"))
    days = dates.select("d", F.weekday(F.to_date("d", "yyyyMMdd")).alias("wd"))
    regular = weekly.join(days, "wd").filter(F.col("d").between(F.col("start_date"), F.col("end_date")))
    marked = calendar_dates.select(*keys, F.col("date").alias("d"), "exception_type")
    added = marked.filter(F.col("exception_type") == "1").join(dates.select("d"), "d", "left_semi")
    removed = marked.filter(F.col("exception_type") == "2")
    either = regular.select(*keys, "d").union(added.select(*keys, "d")).distinct()
    return either.join(removed, [*keys, "d"], "left_anti")


def refine(df: DataFrame, refinement: DataFrame, on: str = "segment") -> DataFrame:
    """Add fine, fraction, ord of the segment; a segment without refinement stands for itself."""
    parts = refinement.select(F.col("coarse").alias(on), F.col("fine").alias("_fine"),
                              F.col("fraction").alias("_fraction"), F.col("ord").alias("_ord"))
    return df.join(parts, on, "left").select(
        *df.columns, F.coalesce("_fine", on).alias("fine"), F.coalesce("_fraction", F.lit(1.0)).alias("fraction"),
        F.coalesce("_ord", F.lit(0)).alias("ord"),
    )


def to_edges(df: DataFrame, segment_edges: DataFrame, on: str = "segment") -> DataFrame:
    """One row per drawn edge of the segment."""
    return df.join(segment_edges.select(F.col("segment").alias(on), "edge"), on)


def _interval_distance() -> F.Column:
    before, after = F.col("first_ts") - F.col("ts"), F.col("ts") - F.col("last_ts")
    return F.greatest(before, after, F.lit(0).cast("bigint"))


def attribute_passages(passages: DataFrame, trains: DataFrame) -> DataFrame:
    """Row of the train whose observation span is nearest to the passage; ties take the lower row.

    A trip has one row per service date still in the window, which bounds the join's fan-out. Passages that are equal in
    every column stay as many as they are.
    """
    spans = trains.select("country", "trip_id", "row_id", "first_ts", "last_ts")
    counted = passages.groupBy(*passages.columns).agg(F.count("*").alias("_times"))
    near = counted.join(spans, ["country", "trip_id"]).withColumn("_distance", _interval_distance())
    best = near.groupBy(*passages.columns, "_times").agg(F.min_by("row_id", F.struct("_distance", "row_id")).alias("row_id"))
    return best.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_times"))).select(*passages.columns, "row_id")


def synthesize_on_time(plan: DataFrame, changes: DataFrame, as_of: int, past: int = 2700) -> DataFrame:
    """Planned stops nobody reported a change for and that lie just behind count as on time."""
    event = F.coalesce("pt_arr", "pt_dep")
    quiet = plan.join(changes.select("stop_id").distinct(), "stop_id", "left_anti")
    return quiet.withColumns({"event_ts": event, "delay_s": F.lit(0), "cancelled": F.lit(False)}).filter(
        F.col("event_ts").between(as_of - past, as_of)
    )


def uncovered_closures(active: DataFrame, works_edges: DataFrame) -> DataFrame:
    """Baseline closures no notice speaks about."""
    keys = present(active, "as_of")
    shared = [k for k in keys if k in works_edges.columns]
    return active.select(*keys, "edge").distinct().join(works_edges, [*shared, "edge"], "left_anti")


def edge_status(colours: DataFrame, blocked: DataFrame, works: DataFrame) -> DataFrame:
    """One row per edge with any of colour, blockade or works."""
    shut = blocked.select("edge").distinct().withColumn("_blocked", F.lit(True))
    planned = works.select("edge", F.col("sev").alias("severity"))
    joined = colours.join(shut, "edge", "full_outer").join(planned, "edge", "full_outer")
    return joined.select("edge", "class", "p90", "n", F.coalesce("_blocked", F.lit(False)).alias("blocked"), "severity")


def resolve_uic(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster of a stop id ending in a UIC number, with or without its check digit."""
    number = F.nullif(F.regexp_extract(F.col("stop_id"), r"([0-9]{7,8})$", 1), F.lit(""))
    by_uic = clusters.filter(F.col("uic").isNotNull()).select("uic", "cluster_id")
    exact = by_uic.select(F.col("uic").alias("_full"), F.col("cluster_id").alias("_exact"))
    short = by_uic.select(F.col("uic").alias("_short"), F.col("cluster_id").alias("_cut"))
    keyed = df.withColumn("_full", number).withColumn("_short", F.expr("left(_full, length(_full) - 1)"))
    return keyed.join(exact, "_full", "left").join(short, "_short", "left").select(
        *df.columns, F.coalesce("_exact", "_cut").alias("cluster")
    )


def resolve_station_code(df: DataFrame, station_codes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster by station code, any case, else by UIC code."""
    codes = station_codes.filter(F.col("stop_code").isNotNull()).groupBy(F.lower("stop_code").alias("_code")).agg(
        F.min("cluster_id").alias("_by_code"))
    uics = clusters.filter(F.col("uic").isNotNull()).select(F.col("uic").alias("uic_code"), F.col("cluster_id").alias("_by_uic"))
    return df.withColumn("_code", F.lower("station_code")).join(codes, "_code", "left").join(uics, "uic_code", "left").select(
        *df.columns, F.coalesce("_by_code", "_by_uic").alias("cluster")
    )


def split_edges(section: DataFrame, closed: DataFrame) -> DataFrame:
    """Section edges per disruption, marked closed where a closed stretch covers them."""
    hit = closed.select("disruption_id", "edge").distinct().withColumn("_hit", F.lit(True))
    own = section.select("disruption_id", "edge").distinct()
    return own.join(hit, ["disruption_id", "edge"], "left").select(
        "disruption_id", "edge", F.coalesce("_hit", F.lit(False)).alias("closed")
    )


def all_train_keys(observed: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Trains seen running, cancelled or both."""
    keys = ["country", "trip_id", "service_date"]
    return observed.join(cancelled, keys, "full_outer")
