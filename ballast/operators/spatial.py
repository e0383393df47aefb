"""Joins by position, over grid cells or latitude bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.geo import grid_cells, haversine_m
from ballast.operators.aggregates import polyline_steps
from ballast.operators.sequence_tools import beside, running_total

# Country of a UIC code by its first two digits.
UIC_COUNTRY = {"84": "NL", "88": "BE", "87": "FR", "80": "DE", "85": "CH"}
BAND_DEGREES = 0.5
OVERLAP_CELL = 0.004


def snap_stations(clusters: DataFrame, nodes: DataFrame, max_m: float = 1500.0) -> DataFrame:
    """Nearest rail node of each cluster nearer than ``max_m``."""
    around = grid_cells(clusters.filter(F.col("lat").isNotNull()).select("cluster_id", "lat", "lon"), reach_m=max_m)
    spots = grid_cells(nodes.select("node_id", F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon")), "n_lat", "n_lon")
    distance = haversine_m(F.col("lat"), F.col("lon"), F.col("n_lat"), F.col("n_lon"))
    near = around.join(spots, ["cell_y", "cell_x"]).withColumn("dist_m", distance).filter(F.col("dist_m") < max_m)
    best = near.groupBy("cluster_id").agg(F.min(F.struct("dist_m", "node_id")).alias("b"))
    return best.select("cluster_id", "b.node_id", "b.dist_m")


def sample_polyline(geometry: DataFrame, every_m: float = 250.0) -> DataFrame:
    """Points each ``every_m`` along a polyline and its end point: id, pos, lat, lon."""
    steps = polyline_steps(geometry)
    along = running_total(steps, ["id"], ["seq"], F.coalesce("step_m", F.lit(0.0)), None, "_from", inclusive=False)
    start, end = F.col("_from"), F.col("_from") + F.col("step_m")
    first, last = F.ceil(start / every_m).cast("bigint"), F.ceil(end / every_m).cast("bigint") - 1
    marks = F.when(F.col("step_m") > 0, F.when(last >= first, F.sequence(first, last)))
    inner = along.withColumn("pos", F.explode(marks))
    part = (F.col("pos") * every_m - start) / F.col("step_m")

    def between(a: str, b: str) -> Column:
        return F.col(a) + part * (F.col(b) - F.col(a))

    sampled = inner.select("id", "pos", between("lat", "next_lat").alias("lat"), between("lon", "next_lon").alias("lon"))
    ends = geometry.groupBy("id").agg(F.max_by(F.struct("lat", "lon"), "seq").alias("e"))
    total = along.groupBy("id").agg(F.sum(F.coalesce("step_m", F.lit(0.0))).alias("_len"))
    closing = ends.join(total, "id").select("id", (F.ceil(F.col("_len") / every_m)).cast("bigint").alias("pos"), "e.lat", "e.lon")
    return sampled.unionByName(closing)


def overlapping_edges(samples: DataFrame, near_m: float = 150.0, min_share: float = 0.6, min_points: int = 1) -> DataFrame:
    """Edge pairs where most sample points of the lower id lie beside the other edge.

    Points of an edge at the same places count together, and a place of the other edge is met once, so that places meet, however
    many points lie at each.
    """
    sizes = samples.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_points)
    places = samples.groupBy("id", "pos").agg(F.array_sort(F.collect_set(F.struct("lat", "lon"))).alias("places"))
    alike = places.groupBy("id", "places").agg(F.count("*").alias("_points")).join(sizes, "id").withColumnRenamed("id", "edge_a")
    spots = alike.withColumn("_place", F.explode("places")).select("edge_a", "n", "places", "_points", "_place.lat", "_place.lon")
    mine = grid_cells(spots, size=OVERLAP_CELL, reach_m=near_m)
    other = grid_cells(samples.select(F.col("id").alias("edge_b"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")).distinct(),
                       "b_lat", "b_lon", size=OVERLAP_CELL)
    distance = haversine_m(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon"))
    beside_it = mine.join(other, ["cell_y", "cell_x"]).filter((F.col("edge_a") < F.col("edge_b")) & (distance <= near_m))
    met = beside_it.select("edge_a", "n", "places", "_points", "edge_b").distinct()
    hits = met.groupBy("edge_a", "edge_b", "n").agg(F.sum("_points").alias("_h"))
    share = F.col("_h") / F.col("n")
    return hits.filter(share >= min_share).select("edge_a", "edge_b", share.alias("share"))


def polygon_sides(polygons: DataFrame) -> DataFrame:
    """Sides of closed rings: country, x1, y1, x2, y2."""
    paired = beside(polygons, ["country", "ring"], ["seq"], ["lon", "lat"])
    return paired.filter(F.col("next_lon").isNotNull()).select(
        "country", F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.col("next_lon").alias("x2"), F.col("next_lat").alias("y2"))


def cluster_country(clusters: DataFrame, polygons: DataFrame) -> DataFrame:
    """Country by UIC prefix, else by the polygon around the point, else '??'.

    A point is inside when a line from it to the east crosses an odd number of sides; sides
    meet points over the latitude bands they span.
    """
    by_code = F.create_map(*[F.lit(x) for item in UIC_COUNTRY.items() for x in item])[F.substring("uic", 1, 2)]
    coded = clusters.withColumn("_code", by_code)
    open_points = coded.filter(F.col("_code").isNull() & F.col("lat").isNotNull()).select("cluster_id", "lat", "lon")

    def band(col: Column) -> Column:
        return F.floor(col / BAND_DEGREES).cast("bigint")

    sides = polygon_sides(polygons).filter(F.col("y1") != F.col("y2"))
    sides = sides.withColumn("_band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
    met = open_points.withColumn("_band", band(F.col("lat"))).join(sides, "_band")
    spans = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    at = F.col("x1") + (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    crossed = met.filter(spans & (F.col("lon") < at)).groupBy("cluster_id", "country").agg(F.count("*").alias("_n"))
    inside = crossed.filter(F.col("_n") % 2 == 1).groupBy("cluster_id").agg(F.min("country").alias("_poly"))
    return coded.join(inside, "cluster_id", "left").select(
        "cluster_id", F.coalesce("_code", "_poly", F.lit("??")).alias("country"))


def edge_ends(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Coordinates of both stations of edges named after a station pair; NULL for others."""
    pair = F.split(F.regexp_replace("id", "^F:", ""), r"\|")
    named = edges.select("id", F.when(F.contains(F.col("id"), F.lit("|")), pair).alias("_p"))
    spots = clusters.select("cluster_id", F.struct("lat", "lon").alias("_at"))
    out = named.select("id", F.col("_p")[0].alias("_a"), F.col("_p")[1].alias("_b"))
    out = out.join(spots.toDF("_a", "p"), "_a", "left").join(spots.toDF("_b", "q"), "_b", "left")
    return out.select("id", "p", "q")


def classify_overlaps(overlaps: DataFrame, samples: DataFrame, clusters: DataFrame, end_m: float = 400.0,
                      line_m: float = 300.0) -> DataFrame:
    """Why two edges overlap: same stations twice, an express over a chain, parallel track, or unknown."""
    ids = overlaps.select(F.col("edge_a").alias("id")).union(overlaps.select(F.col("edge_b").alias("id"))).distinct()
    ends = edge_ends(ids, clusters)
    a, b = ends.toDF("edge_a", "a1", "a2"), ends.toDF("edge_b", "b1", "b2")
    joined = overlaps.join(a, "edge_a").join(b, "edge_b")

    def metres(p: str, q: str) -> Column:
        return haversine_m(F.col(f"{p}.lat"), F.col(f"{p}.lon"), F.col(f"{q}.lat"), F.col(f"{q}.lon"))

    apart = F.least(F.greatest(metres("a1", "b1"), metres("a2", "b2")), F.greatest(metres("a1", "b2"), metres("a2", "b1")))
    # distance from each end to the nearest sample of the other edge
    probes = joined.select("edge_a", "edge_b", F.explode(F.array(
        F.struct(F.lit("a1").alias("end"), F.col("edge_b").alias("id"), F.col("a1").alias("at")),
        F.struct(F.lit("a2").alias("end"), F.col("edge_b").alias("id"), F.col("a2").alias("at")),
        F.struct(F.lit("b1").alias("end"), F.col("edge_a").alias("id"), F.col("b1").alias("at")),
        F.struct(F.lit("b2").alias("end"), F.col("edge_a").alias("id"), F.col("b2").alias("at")),
    )).alias("x")).select("edge_a", "edge_b", "x.*").filter(F.col("at").isNotNull())
    close = probes.join(samples, "id").withColumn("_m", haversine_m(F.col("at.lat"), F.col("at.lon"), F.col("lat"), F.col("lon")))
    nearest = close.groupBy("edge_a", "edge_b").agg(*[
        F.coalesce(F.min(F.when(F.col("end") == e, F.col("_m"))) <= line_m, F.lit(False)).alias(f"{e}_on") for e in ("a1", "a2", "b1", "b2")
    ])
    known = F.col("a1").isNotNull() & F.col("a2").isNotNull() & F.col("b1").isNotNull() & F.col("b2").isNotNull()
    on_line = (F.col("a1_on") & F.col("a2_on")) | (F.col("b1_on") & F.col("b2_on"))
    category = (
        F.when(~known, "unknown").when(apart <= end_m, "duplicate-stations")
        .when(F.coalesce(on_line, F.lit(False)), "express-over-chain").otherwise("parallel")
    )
    return joined.join(nearest, ["edge_a", "edge_b"], "left").select("edge_a", "edge_b", "share", category.alias("category"))
