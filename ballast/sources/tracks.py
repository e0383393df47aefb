"""Drawn edges and rail ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAILWAYS = ("rail", "narrow_gauge")
EDGE_DOCUMENT = "struct<geometry:map<string,array<array<double>>>,coverage:map<string,array<string>>>"


def edges_from_json(documents: DataFrame, geometry: str = "geometry", coverage: str = "coverage") -> tuple[DataFrame, DataFrame]:
    """Points (edge, seq, lon, lat) and (segment, edge) of documents in column payload."""
    schema = EDGE_DOCUMENT.replace("geometry:", f"{geometry}:").replace("coverage:", f"{coverage}:")
    parsed = documents.select(F.from_json("payload", schema).alias("p"))
    lines = parsed.select(F.explode(F.col("p")[geometry]).alias("edge", "line"))
    points = lines.select("edge", F.posexplode("line").alias("seq", "xy")).select(
        "edge", "seq", F.col("xy")[0].alias("lon"), F.col("xy")[1].alias("lat"))
    covered = parsed.select(F.explode(F.col("p")[coverage]).alias("edge", "segments"))
    return points, covered.select(F.explode("segments").alias("segment"), "edge").distinct()


def load_edges(spark: SparkSession, path: str, geometry: str = "geometry", coverage: str = "coverage") -> tuple[DataFrame, DataFrame]:
    """Edge points and coverage from a (gzipped) JSON file, or from a folder written in rows."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"))
    return edges_from_json(raw, geometry, coverage)


def load_rail_ways(nodes: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rail ways once each, with the nodes they use; extracts of neighbours repeat border ways."""
    kept = ways.filter(F.col("railway").isin(*RAILWAYS)) if "railway" in ways.columns else ways
    kept = kept.dropDuplicates(["way_id"])
    used = kept.select(F.explode("nodes").alias("node_id")).distinct()
    return nodes.dropDuplicates(["node_id"]).join(used, "node_id", "left_semi"), kept
