"""Stations of several feeds resolved to clusters, and dictionaries of their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.geo import grid_cells, haversine_m
from ballast.functions.text import name_similarity, norm_compact, norm_station, normalize_name, uic_code


def local_id(station_id: Column) -> Column:
    """Station id without its feed prefix."""
    return F.regexp_replace(station_id, "^[^:]*:", "")


def with_uic(stations: DataFrame) -> DataFrame:
    return stations.withColumn("uic", uic_code(local_id(F.col("station_id")), F.col("stop_code")))


def cluster_by_uic(stations: DataFrame) -> DataFrame:
    """One cluster per UIC code, described by its first station."""
    coded = with_uic(stations).filter(F.col("uic").isNotNull())
    first = F.min_by(F.struct(F.col("stop_name").alias("name"), "lat", "lon"), "station_id").alias("f")
    return coded.groupBy("uic").agg(first).select(F.concat(F.lit("uic:"), "uic").alias("cluster_id"), "uic", "f.*")


def name_cell_groups(stations: DataFrame) -> DataFrame:
    """Uncoded stations with the cell and name key that group them, and each group's first station."""
    located = with_uic(stations).filter(F.col("uic").isNull() & F.col("lat").isNotNull()).drop("uic")
    keyed = grid_cells(located.withColumn("name_key", norm_station(F.col("stop_name"))))
    keys = ["cell_y", "cell_x", "name_key"]
    first = F.min(F.struct("station_id", "stop_name", "lat", "lon")).alias("first")
    return keyed.join(keyed.groupBy(*keys).agg(first), keys)


def attach_groups(groups: DataFrame, uic_clusters: DataFrame, max_m: int = 300) -> DataFrame:
    """Cluster of each uncoded station: station_id, feed, stop_name, lat, lon, cluster_id.

    A group joins the nearest UIC cluster of its name within reach of its first station. Of
    such a group, members out of the cluster's reach stand alone; a group without a cluster
    becomes one of its own whatever its extent.
    """
    anchors = grid_cells(
        uic_clusters.filter(F.col("lat").isNotNull()).select(
            F.col("cluster_id").alias("anchor"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"),
            norm_station(F.col("name")).alias("name_key")),
        "a_lat", "a_lon", reach_m=max_m)
    keys = ["cell_y", "cell_x", "name_key"]
    heads = groups.select(*keys, "first").distinct()
    distance = haversine_m(F.col("first.lat"), F.col("first.lon"), F.col("a_lat"), F.col("a_lon"))
    near = heads.join(anchors, keys).withColumn("_m", distance).filter(F.col("_m") <= max_m)
    chosen = near.groupBy(*keys).agg(F.min_by(F.struct("anchor", "a_lat", "a_lon"), F.struct("_m", "anchor")).alias("to"))
    member = groups.join(chosen, keys, "left")
    off = haversine_m(F.col("lat"), F.col("lon"), F.col("to.a_lat"), F.col("to.a_lon")) > max_m
    cluster = (
        F.when(F.col("to").isNull(), F.concat(F.lit("nm:"), F.col("first.station_id")))
        .when(off, F.concat(F.lit("nm:"), F.col("station_id")))
        .otherwise(F.col("to.anchor"))
    )
    return member.select("station_id", "feed", "stop_name", "lat", "lon", cluster.alias("cluster_id"))


def resolve_stations(stations: DataFrame) -> dict[str, DataFrame]:
    """Both rounds together: station_cluster and the described clusters."""
    coded = with_uic(stations).filter(F.col("uic").isNotNull()).select(
        "station_id", "feed", "stop_name", "lat", "lon", F.concat(F.lit("uic:"), "uic").alias("cluster_id"))
    uics = cluster_by_uic(stations)
    named = attach_groups(name_cell_groups(stations), uics)
    members = coded.unionByName(named)
    first = F.min_by(F.struct(F.col("stop_name").alias("name"), "lat", "lon"), "station_id").alias("f")
    own = named.filter(F.startswith(F.col("cluster_id"), F.lit("nm:"))).groupBy("cluster_id").agg(first).select(
        "cluster_id", F.lit(None).cast("string").alias("uic"), "f.*")
    feeds = members.select("cluster_id", "feed").distinct().groupBy("cluster_id").agg(
        F.array_sort(F.collect_set("feed")).alias("_f"))
    described = uics.unionByName(own).join(feeds, "cluster_id").select(
        "cluster_id", "uic", "name", "lat", "lon", F.size("_f").alias("n_feeds"), F.array_join("_f", ",").alias("feeds"))
    return {"station_cluster": members.select("station_id", "cluster_id"), "clusters": described}


def name_dictionary(clusters: DataFrame, preferred: str = "nl") -> DataFrame:
    """Name key -> cluster; a shared name goes to the only cluster of the preferred feed, else to none."""
    favoured = F.array_contains(F.split(F.coalesce("feeds", F.lit("")), ","), preferred)
    keyed = clusters.select(normalize_name(F.col("name")).alias("name_key"), "cluster_id", favoured.alias("_own"))
    tally = keyed.groupBy("name_key").agg(
        F.count("*").alias("_n"), F.min("cluster_id").alias("_any"),
        F.sum(F.col("_own").cast("int")).alias("_m"), F.min(F.when(F.col("_own"), F.col("cluster_id"))).alias("_mine"),
    )
    pick = F.when(F.col("_n") == 1, F.col("_any")).when(F.col("_m") == 1, F.col("_mine"))
    return tally.select("name_key", pick.alias("cluster_id"))


def strict_name_dictionary(clusters: DataFrame) -> DataFrame:
    """Compact name -> cluster for names only one cluster has."""
    keyed = clusters.select(norm_compact(F.col("name")).alias("name_key"), "cluster_id")
    tally = keyed.groupBy("name_key").agg(F.count("*").alias("_n"), F.min("cluster_id").alias("cluster_id"))
    return tally.filter(F.col("_n") == 1).select("name_key", "cluster_id")


def shared_stations(clusters: DataFrame) -> DataFrame:
    """Clusters of two feeds or more, by name."""
    feeds = F.split("feeds", ",")
    return clusters.filter(F.size(feeds) >= 2).select("cluster_id", "name", "uic", "feeds").orderBy("name", "cluster_id")


def fuzzy_station_match(left: DataFrame, right: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Best candidate per name: left(id, name) with right(id, name), complete for every threshold.

    A similarity of t needs t * longer length letters in common, whatever their order. Of each compact name, its letters
    (the second "a" is another than the first) stand by how few right names have them; two names that share that many meet
    in the first n - t * n + 1 of both. Names without a Latin letter or digit meet by their words. Equal names are
    compared once. The threshold must be above 0: at 0 every name is a candidate of every other.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    def letters(df: DataFrame, side: str) -> DataFrame:
        words = F.array_distinct(F.filter(F.split(normalize_name(F.col("name")), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))
        signs = F.split(F.col("c"), "")
        nth = F.transform(signs, lambda x, i: F.concat(x, F.size(F.filter(F.slice(signs, 1, i + 1), lambda y: y == x)).cast("string")))
        named = df.select("name").distinct().withColumn("c", norm_compact(F.col("name"))).filter("c is not null")
        token = F.when(F.col("c") == "", F.transform(words, lambda w: F.concat(F.lit("word "), w))).otherwise(nth)
        return named.select(F.col("name").alias(f"{side}_name"), F.length("c").alias(f"{side}_n"), F.explode(token).alias("token"))

    lefts, rights = letters(left, "l"), letters(right, "r")
    rarity = rights.groupBy("token").agg(F.count("*").alias("df"))

    def rarest(df: DataFrame, side: str) -> DataFrame:
        placed = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")))
        n = F.col(f"{side}_n")
        some = F.when(n == 0, F.size("all")).otherwise(F.greatest(n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)) + 1, F.lit(0))).cast("int")
        lists = df.join(rarity, "token", "left").groupBy(f"{side}_name", f"{side}_n").agg(placed.alias("all"))
        return lists.select(f"{side}_name", f"{side}_n", F.explode(F.slice("all", F.lit(1), some)).alias("t")).select(f"{side}_name", f"{side}_n", "t.token")

    near = F.least("l_n", "r_n") >= F.greatest("l_n", "r_n") * F.lit(threshold) - F.lit(1e-9)
    pairs = rarest(lefts, "l").join(rarest(rights, "r"), "token").filter(near).select("l_name", "r_name").distinct()
    scored = pairs.withColumn("similarity", name_similarity(F.col("l_name"), F.col("r_name")))
    best = scored.groupBy("l_name").agg(F.min_by(F.struct("r_name", "similarity"), F.struct((-F.col("similarity")).alias("s"), "r_name")).alias("b"))
    best = best.filter(F.col("b.similarity") >= threshold).select("l_name", "b.*")
    target = right.groupBy(F.col("name").alias("r_name")).agg(F.min("id").alias("match_id"))
    found = best.join(target, "r_name")
    return left.join(found, left["name"] == found["l_name"]).select("id", "name", "match_id", F.col("r_name").alias("match_name"), "similarity")


