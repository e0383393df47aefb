"""Coverage of international trains and the inventory of tracks drawn twice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.operators import aggregates, spatial


def coverage_report(stop_times: DataFrame, stop_cluster: DataFrame, trips: DataFrame, routes: DataFrame, agency: DataFrame,
                    cluster_country: DataFrame, terms: Mapping[str, Sequence[str]], feeds: Sequence[str]) -> dict[str, DataFrame]:
    """International trips, their corridors per feed, the main series and the checklist of services."""
    countries = aggregates.trip_countries(stop_times, stop_cluster, cluster_country, trips)
    details = trips.select(*[c for c in ("trip_id", "route_id", "trip_headsign") if c in trips.columns])
    intl = aggregates.international_trips(countries).join(details, "trip_id")
    return {
        "trips": intl, "corridors": aggregates.corridor_matrix(intl, feeds),
        "series": aggregates.top_series(intl, routes, agency), "checklist": aggregates.checklist_coverage(intl, routes, agency, terms, feeds),
    }


def overlap_inventory(geometry: DataFrame, clusters: DataFrame, k: int = 5, seed: int = 42) -> dict[str, DataFrame]:
    """Edges lying on each other by cause, with counts and a few examples of each."""
    samples = spatial.sample_polyline(geometry)
    found = spatial.classify_overlaps(spatial.overlapping_edges(samples), samples, clusters)
    counts = found.groupBy("category").agg(F.count("*").alias("n"))
    keyed = found.withColumn("pair", F.concat_ws(">", "edge_a", "edge_b"))
    return {"pairs": found, "counts": counts, "examples": aggregates.stratified_sample(keyed, "category", "pair", k, seed)}
