"""Static build: feed tables to stations, clusters, segments, refinement and edges."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.operators import entities, filters, graphs, joins, sequences
from ballast.session import cut_lineage
from ballast.sinks.documents import fallback_edges
from ballast.sources.gtfs import COLUMNS, merge_feeds


def merge_tables(feeds: Mapping[str, Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
    """Rail-only tables of all feeds in one set with feed-prefixed ids."""
    kept = {feed: joins.filter_feed(tables) for feed, tables in feeds.items()}
    merged = {}
    for name, columns in COLUMNS.items():
        present = {feed: tables[name] for feed, tables in kept.items() if name in tables}
        if present:
            merged[name] = merge_feeds(present, columns)
    merged["stop_times"] = filters.with_dep_s(merged["stop_times"])
    return merged


def build_network(tables: Mapping[str, DataFrame], segment_edges: DataFrame | None = None) -> dict[str, DataFrame]:
    """Merged tables to stations, clusters, segments, leaf refinement and segment-edge pairs.

    Drawn edges come from the rare geometry job; without one every leaf gets a straight edge.
    """
    stations = cut_lineage(filters.repair_null_island(filters.stations(tables["stops"])))
    resolved = entities.resolve_stations(stations)
    clusters = cut_lineage(resolved["clusters"])
    station_cluster = cut_lineage(resolved["station_cluster"])
    stop_cluster = cut_lineage(joins.assign_clusters(tables["stops"], station_cluster))
    segments = cut_lineage(sequences.segments(sequences.hops(tables["stop_times"], stop_cluster)))
    paths = cut_lineage(graphs.refinement_paths(segments, clusters))
    lengths = graphs.segment_lengths(segments, clusters).select("segment", "w")
    refinement = cut_lineage(graphs.expand_leaves(paths, lengths))
    leaves = segments.select("segment").join(refinement.select(F.col("coarse").alias("segment")), "segment", "left_anti")
    leaves = leaves.union(refinement.select("fine")).distinct()
    if segment_edges is None:
        segment_edges = segments.limit(0).select("segment", F.col("segment").alias("edge"))
    points, pairs = fallback_edges(leaves, segment_edges, clusters)
    return {
        "stations": stations, "clusters": clusters, "station_cluster": station_cluster, "stop_cluster": stop_cluster,
        "segments": segments, "refinement": refinement, "leaves": leaves,
        "segment_edges": segment_edges.select("segment", "edge").unionByName(pairs), "fallback_points": points,
    }
