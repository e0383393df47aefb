"""JSON documents, one line per item so that a document of any size is written in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.functions.geo import colour_class
from ballast.operators.filters import exclude, positioned_incidents

LABEL_SEGMENTS = 3


def _line(df: DataFrame, section: str, key: Column, item: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), item.alias("json"))


def _array(*cols: str) -> Column:
    """A JSON array of mixed types."""
    parts = [F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":(.*)\}$', 1), F.lit("null")) for c in cols]
    parts = [F.when(F.col(c).isNull(), F.lit("null")).otherwise(p) for c, p in zip(cols, parts)]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def snapshot_items(coverage: DataFrame, window: DataFrame, incidents: DataFrame, blocked: DataFrame, works: DataFrame) -> DataFrame:
    """Lines of a snapshot: coverage per source, colour per edge, incidents, blocked edges, works.

    coverage: country, status, age_s; window: edge, p90, n_trains; incidents: see incidents();
    blocked: edge; works: group_seq, src, sev, until, txt, edge (one row per edge).
    """
    seg = window.select("edge", colour_class(F.col("p90")).alias("class"), "p90", F.col("n_trains").alias("n"))
    inc = positioned_incidents(incidents).withColumn("pos", F.array(F.round("lon", 4), F.round("lat", 4)))
    return (
        _line(coverage, "coverage", F.col("country"), F.to_json(F.struct("status", "age_s")))
        .unionByName(_line(seg, "seg", F.col("edge"), _array("edge", "class", "p90", "n")))
        .unionByName(_line(inc, "inc", F.concat_ws(":", "country", "alert_pos"),
                           F.to_json(F.struct(F.col("country").alias("land"), "cause", "effect", "txt", "pos", "cluster"))))
        .unionByName(_line(blocked.select("edge").distinct(), "blk", F.col("edge"), F.to_json(F.struct("edge"))))
        .unionByName(_line(works, "wrk", F.concat_ws(":", "group_seq", "edge"), _array("src", "sev", "until", "txt", "edge")))
    )


def build_snapshot(items: DataFrame, as_of: int, version: int = 1) -> DataFrame:
    """One document per section with the head of the snapshot: v, t, section, items.

    For a map of one network: a section has at most one item per drawn edge, notice edge or
    source. Larger ones stay in lines.
    """
    listed = items.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("key", "json"))).alias("i"))
    body = F.concat(F.lit("["), F.array_join("i.json", ","), F.lit("]"))
    stamp = F.date_format(F.timestamp_seconds(F.lit(as_of)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return listed.select(F.lit(version).alias("v"), stamp.alias("t"), "section", body.alias("items"))


def artifact_lines(trains: DataFrame, details: DataFrame, passages: DataFrame, cancels: DataFrame, works: DataFrame) -> DataFrame:
    """Inspection artefacts in lines: name, key, ord, json.

    Lines of one key follow ``ord``: passages by falling delta, cancellations newest first.
    """
    cols = [c for c in trains.columns if c != "row_id"]
    parts = [
        trains.select(F.lit("trains").alias("name"), F.col("row_id").alias("key"), F.lit("").alias("ord"), _array(*cols).alias("json")),
        details.select(F.lit("details").alias("name"), F.concat_ws("|", "country", "trip_id", "service_date").alias("key"),
                       F.format_string("%d:%012d", "part", "ord").alias("ord"), _array("name", "arr", "dep", "delay_s").alias("json")),
        passages.select(F.lit("edges").alias("name"), F.col("edge").alias("key"),
                        F.format_string("%012d", F.lit(10**9) - F.col("delta_s")).alias("ord"), _array("row_id", "delta_s", "ts").alias("json")),
        cancels.select(F.lit("cancels").alias("name"), F.col("edge").alias("key"),
                       F.format_string("%012d", F.lit(10**11) - F.col("ts")).alias("ord"), _array("row_id", "ts").alias("json")),
        works.select(F.lit("works").alias("name"), F.col("edge").alias("key"), F.concat_ws(":", "d", F.format_string("%02d", "hour_start")).alias("ord"),
                     _array("d", "hour_start", "hour_end").alias("json")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_artifacts(lines: DataFrame, folder: str) -> None:
    """Lines sorted over the whole artefact, split by range rather than by key."""
    placed = lines.repartitionByRange("name", "key", "ord").sortWithinPartitions("name", "key", "ord")
    placed.write.mode("overwrite").option("compression", "gzip").partitionBy("name").json(folder)


def segment_names(segments: DataFrame, clusters: DataFrame) -> DataFrame:
    """Readable name of each segment: "A – B", or its id where a cluster is unknown."""
    ends = F.split("segment", r"\|")
    names = clusters.select("cluster_id", F.col("name").alias("_n"))
    pairs = segments.select("segment", ends[0].alias("_a"), ends[1].alias("_b"))
    joined = pairs.join(names.toDF("_a", "_na"), "_a", "left").join(names.toDF("_b", "_nb"), "_b", "left")
    both = F.when(F.col("_na").isNotNull() & F.col("_nb").isNotNull(), F.concat("_na", F.lit(" – "), "_nb"))
    return joined.select("segment", F.coalesce(both, F.col("segment")).alias("segment_name"))


def fallback_edges(leaves: DataFrame, segment_edges: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Straight edges "F:a|b" for leaf segments no edge is drawn for: points, and (segment, edge)."""
    at = clusters.filter(F.col("lat").isNotNull()).select("cluster_id", "lat", "lon")
    ends = F.split("segment", r"\|")
    bare = exclude(leaves.select("segment").distinct(), segment_edges, "segment").select("segment", ends[0].alias("_a"), ends[1].alias("_b"))
    drawn = bare.join(at.toDF("_a", "a_lat", "a_lon"), "_a").join(at.toDF("_b", "b_lat", "b_lon"), "_b").withColumn("edge", F.concat(F.lit("F:"), "segment"))
    points = drawn.select("edge", F.posexplode(F.array(
        F.struct(F.round("a_lon", 5).alias("lon"), F.round("a_lat", 5).alias("lat")),
        F.struct(F.round("b_lon", 5).alias("lon"), F.round("b_lat", 5).alias("lat")))).alias("seq", "p")).select("edge", "seq", "p.lon", "p.lat")
    return points, drawn.select("segment", "edge")


def edge_features(edge_geometry: DataFrame, segment_edges: DataFrame, clusters: DataFrame, leaves: DataFrame) -> DataFrame:
    """GeoJSON feature per edge, labelled by its first segments; edges of fewer than two points have none."""
    more_points, more_pairs = fallback_edges(leaves, segment_edges, clusters)
    points = edge_geometry.select("edge", "seq", "lon", "lat").unionByName(more_points)
    covered = segment_edges.select("segment", "edge").unionByName(more_pairs)
    first = F.row_number().over(Window.partitionBy("edge").orderBy("segment"))
    shown = covered.withColumn("_r", first).filter(F.col("_r") <= LABEL_SEGMENTS)
    named = shown.join(segment_names(shown.select("segment").distinct(), clusters), "segment")
    label = named.groupBy("edge").agg(F.array_sort(F.collect_list(F.struct("_r", "segment_name"))).alias("_l"))
    total = covered.groupBy("edge").agg(F.count("*").alias("_n"))
    surplus = F.when(F.col("_n") > LABEL_SEGMENTS, F.concat(F.lit(" (+"), F.col("_n") - LABEL_SEGMENTS, F.lit(")"))).otherwise("")
    labels = label.join(total, "edge").select("edge", F.concat(F.array_join("_l.segment_name", ", "), surplus).alias("label"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.array("lon", "lat").alias("xy")))), lambda p: p["xy"])
    lines = points.groupBy("edge").agg(line.alias("_xy")).filter(F.size("_xy") >= 2).join(labels, "edge", "left")
    shown_label = F.coalesce("label", F.lit(""))
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.col("edge").alias("id"), F.struct(F.col("edge").alias("id"), shown_label.alias("lines")).alias("properties"),
        F.struct(F.lit("LineString").alias("type"), F.col("_xy").alias("coordinates")).alias("geometry")))
    return lines.select("edge", shown_label.alias("label"), feature.alias("json"))
