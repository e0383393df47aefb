"""Aggregations over observations, trips and stations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.functions.geo import haversine_m, segment_id
from ballast.operators.joins import refine, to_edges
from ballast.operators.sequence_tools import at_instants, beside, first_rows, numbered, present
from ballast.session import cut_lineage

TRAIN = ["country", "trip_id", "service_date"]
SEVERITY_RANK = {"closed": 3, "intl": 2, "reduced": 1}
SERVICE_MINUTES = 19 * 60
COLOURED_MINUTES = 30
# Lower and upper bound of each delay bin in minutes.
DELAY_BINS = (
    ("early", None, 0), ("0-1", 0, 1), ("1-2", 1, 2), ("2-5", 2, 5), ("5-10", 5, 10),
    ("10-20", 10, 20), ("20-60", 20, 60), (">=60", 60, None),
)
# Optional columns a feed may offer.
OPTIONAL_COLUMNS = {
    "routes": ["route_color"],
    "trips": ["trip_short_name", "bikes_allowed", "wheelchair_accessible", "shape_id", "block_id"],
    "stops": ["stop_code", "parent_station", "location_type", "platform_code", "wheelchair_boarding"],
    "stop_times": ["pickup_type", "drop_off_type"],
}


def rank_value(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Value at 0-based rank min(n-1, 9n div 10) of each group, from (keys, value, n) counts.

    Works on one row per distinct value, so a group's size in observations does not matter.
    """
    along = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    ranked = counts.withColumn("_upto", F.sum("n").over(along)).withColumn("_all", F.sum("n").over(whole))
    rank = F.least(F.col("_all") - 1, F.floor(F.col("_all") * 9 / 10).cast("bigint"))
    at_rank = (F.col("_upto") > rank) & (F.col("_upto") - F.col("n") <= rank)
    return ranked.filter(at_rank).select(*keys, F.col(value).alias("p90"), F.col("_all").alias("n_obs"))


def edge_delay_window(seg_obs: DataFrame, segment_edges: DataFrame, as_of: DataFrame | int,
                      seconds: int = 1800) -> DataFrame:
    """p90 of incurred delay, observations and distinct trips per edge and instant.

    Observations are counted per segment and value before they fan out to edges.
    """
    recent = at_instants(seg_obs.select("ts", "segment", "trip_id", "delta_s"), as_of, seconds)
    counts = recent.groupBy("as_of", "segment", "delta_s").agg(F.count("*").alias("n"))
    on_edge = to_edges(counts, segment_edges).groupBy("as_of", "edge", "delta_s").agg(F.sum("n").alias("n"))
    trips = to_edges(recent.select("as_of", "segment", "trip_id").distinct(), segment_edges)
    trains = trips.select("as_of", "edge", "trip_id").distinct().groupBy("as_of", "edge").agg(F.count("*").alias("n_trains"))
    return rank_value(on_edge, ["as_of", "edge"], "delta_s").join(trains, ["as_of", "edge"])


def edge_delay_by_train(seg_obs: DataFrame, segment_edges: DataFrame, as_of: DataFrame | int,
                        seconds: int = 1800) -> DataFrame:
    """As edge_delay_window over each train's latest delta on the edge only."""
    recent = at_instants(seg_obs.select("seq", "ts", "segment", "trip_id", "delta_s"), as_of, seconds)
    last = recent.groupBy("as_of", "segment", "trip_id").agg(F.max(F.struct("ts", "seq", "delta_s")).alias("_last"))
    last = to_edges(last, segment_edges).groupBy("as_of", "edge", "trip_id").agg(F.max("_last").alias("_last"))
    counts = last.groupBy("as_of", "edge", F.col("_last.delta_s").alias("delta_s")).agg(F.count("*").alias("n"))
    return rank_value(counts, ["as_of", "edge"], "delta_s").withColumnRenamed("n_obs", "n_trains")


def recent(obs: DataFrame, as_of: int, window_s: int) -> DataFrame:
    """Observations of the window, whatever their service date, null included. The log is written in order of time, so its
    files' least and greatest ``ts`` keep the scan to the window."""
    return obs.filter(F.col("ts") >= as_of - window_s)


def train_stats(stop_obs: DataFrame, as_of: int, window_s: int) -> DataFrame:
    return recent(stop_obs, as_of, window_s).groupBy(*TRAIN).agg(
        F.min("ts").alias("first_ts"), F.count("*").alias("n_obs"))


def latest_per_cluster(stop_obs: DataFrame, as_of: int, window_s: int) -> DataFrame:
    last = F.max(F.struct("ts", "seq", "delay_s")).alias("_last")
    return recent(stop_obs, as_of, window_s).groupBy(*TRAIN, "cluster").agg(last).select(
        *TRAIN, "cluster", "_last.delay_s", "_last.ts", "_last.seq")


def cancel_stats(cancel_obs: DataFrame, as_of: int, window_s: int) -> DataFrame:
    return recent(cancel_obs, as_of, window_s).groupBy(*TRAIN).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def edge_passages(seg_obs: DataFrame, segment_edges: DataFrame, as_of: int, window_s: int) -> DataFrame:
    """Latest delta of each trip on each edge it passed in the window."""
    last = recent(seg_obs, as_of, window_s).groupBy("segment", "country", "trip_id").agg(F.max(F.struct("ts", "seq", "delta_s")).alias("_last"))
    on_edge = to_edges(last, segment_edges).groupBy("edge", "country", "trip_id").agg(F.max("_last").alias("_last"))
    return on_edge.select("edge", "country", "trip_id", "_last.delta_s", "_last.ts")


def edge_cancels(cancel_obs: DataFrame, segment_edges: DataFrame, as_of: int, window_s: int) -> DataFrame:
    """First cancellation of each train on each edge in the window."""
    first = recent(cancel_obs, as_of, window_s).groupBy("segment", *TRAIN).agg(F.min("ts").alias("ts"))
    return to_edges(first, segment_edges).groupBy("edge", *TRAIN).agg(F.min("ts").alias("ts"))


def service_edge_hours(hops: DataFrame, trips: DataFrame, refinement: DataFrame, segment_edges: DataFrame, service: Sequence[str]) -> DataFrame:
    """Distinct (service, edge, hour) of scheduled trains. Trips shrink to distinct (service, segment, hour) before they meet edges."""
    trip = present(hops, "feed") + ["trip_id"]
    hour = (F.floor(F.col("dep_s") / 3600).cast("bigint") % 24).alias("hour")
    timed = hops.filter(F.col("dep_s").isNotNull()).select(*trip, segment_id(F.col("a"), F.col("b")).alias("segment"), hour)
    run = timed.join(trips.select(*dict.fromkeys([*trip, *service])), trip)
    by_service = run.select(*service, "segment", "hour").distinct()
    parts = refinement.select(F.col("coarse").alias("segment"), F.col("fine"))
    refined = by_service.join(parts, "segment").select(*service, F.col("fine").alias("segment"), "hour")
    on_edges = to_edges(by_service.union(refined.select(*by_service.columns)).distinct(), segment_edges)
    return on_edges.select(*service, "edge", "hour").distinct()


def served_edge_hours(hops: DataFrame, trips: DataFrame, refinement: DataFrame, segment_edges: DataFrame,
                      service_days: DataFrame) -> DataFrame:
    """Distinct (date, edge, hour) with a scheduled train, a row each; ``served_days`` has them as bits."""
    service = present(service_days, "feed") + ["service_id"]
    edge_hours = service_edge_hours(hops, trips, refinement, segment_edges, service)
    return edge_hours.join(service_days, service).select("d", "edge", "hour").distinct()


#: Days of one mask.
MASK_DAYS = 64


def day_bits(dates: DataFrame) -> DataFrame:
    """The dates with ``word`` and ``bit``: day i is bit i % 64 of mask i // 64."""
    return dates.withColumns({"word": F.expr(f"i div {MASK_DAYS}"), "bit": F.expr(f"shiftleft(1L, cast(i % {MASK_DAYS} as int))")})


def served_days(hops: DataFrame, trips: DataFrame, refinement: DataFrame, segment_edges: DataFrame,
                service_days: DataFrame, dates: DataFrame) -> DataFrame:
    """edge, hour, word, days: the dates on which a train is scheduled, as bits. dates: d, i (its number, from 0).

    A service's dates are one mask, so an edge hour's are the union of its services' masks, and no row stands for a date.
    """
    service = present(service_days, "feed") + ["service_id"]
    runs = service_days.join(day_bits(dates).select("d", "word", "bit"), "d").groupBy(*service, "word").agg(F.bit_or("bit").alias("days"))
    edge_hours = service_edge_hours(hops, trips, refinement, segment_edges, service)
    return edge_hours.join(runs, service).groupBy("edge", "hour", "word").agg(F.bit_or("days").alias("days"))


def days_of_type(dates: DataFrame) -> DataFrame:
    """daytype, word, mask and total: the dates of each day type as bits, and how many there are over all words."""
    masks = day_bits(dates).groupBy("daytype", "word").agg(F.bit_or("bit").alias("mask"))
    totals = dates.groupBy("daytype").agg(F.count("*").alias("total"))
    return masks.join(totals, "daytype")


def service_baseline(served: DataFrame, dates: DataFrame) -> DataFrame:
    """Edge hours served on more than half of the dates of a day type, from the masks of ``served_days``."""
    types = F.broadcast(days_of_type(dates))  # a row for each day type and 64 dates
    met = served.join(types, "word").select("edge", "hour", "daytype", "total", F.bit_count(F.col("days").bitwiseAND(F.col("mask"))).cast("bigint").alias("m"))
    counted = met.groupBy("edge", "hour", "daytype", "total").agg(F.sum("m").alias("m"))
    return counted.filter(F.col("m") * 2 > F.col("total"))


def multi_feed_clusters(stations: DataFrame, station_cluster: DataFrame) -> DataFrame:
    """Feeds of each cluster; feeds are few, stations per cluster need not be."""
    pairs = stations.join(station_cluster, "station_id").select("cluster_id", "feed").distinct()
    feeds = F.array_sort(F.collect_set("feed"))
    return pairs.groupBy("cluster_id").agg(feeds.alias("_f")).select(
        "cluster_id", F.array_join("_f", ",").alias("feeds"), F.size("_f").alias("n_feeds"))


def uic_coverage(stations: DataFrame, station_cluster: DataFrame) -> DataFrame:
    joined = stations.join(station_cluster, "station_id", "left")
    hit = F.coalesce(F.startswith(F.col("cluster_id"), F.lit("uic:")), F.lit(False)).cast("int")
    return joined.groupBy("feed").agg(F.round(F.sum(hit) * 100 / F.count("*"), 1).alias("pct"))


def trip_countries(stop_times: DataFrame, stop_cluster: DataFrame, cluster_country: DataFrame,
                   trips: DataFrame) -> DataFrame:
    """Sorted distinct countries each trip calls at."""
    cluster_of = stop_cluster.join(cluster_country, "cluster_id").select("stop_id", "country")
    pairs = stop_times.select("trip_id", "stop_id").join(cluster_of, "stop_id").select("trip_id", "country").distinct()
    gathered = pairs.groupBy("trip_id").agg(F.array_sort(F.collect_set("country")).alias("countries"))
    return gathered.join(trips.select("trip_id", "feed"), "trip_id")


def international_trips(trip_countries: DataFrame) -> DataFrame:
    return trip_countries.filter(F.size("countries") >= 2).select(
        "trip_id", "feed", F.array_join("countries", "-").alias("corridor"))


def corridor_matrix(intl: DataFrame, feeds: Sequence[str]) -> DataFrame:
    return intl.groupBy("corridor").pivot("feed", list(feeds)).agg(F.count(F.lit(1))).na.fill(0, list(feeds))


def checklist_coverage(intl: DataFrame, routes: DataFrame, agency: DataFrame, terms: Mapping[str, Sequence[str]],
                       feeds: Sequence[str]) -> DataFrame:
    """International trips per expected service and feed whose descriptions hold one of its terms."""
    names = agency.select("agency_id", "agency_name")
    described = intl.join(routes, "route_id").join(names, "agency_id", "left")
    parts = [c for c in ("route_short_name", "route_long_name", "trip_headsign", "agency_name") if c in described.columns]
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in parts]))
    hits = F.array(*[
        F.when(F.exists(F.array(*[F.lit(t) for t in wanted]), lambda t: F.contains(text, t)), F.lit(service))
        for service, wanted in terms.items()
    ])
    served = described.select("feed", F.explode(F.filter(hits, lambda s: s.isNotNull())).alias("service"))
    return served.groupBy("service").pivot("feed", list(feeds)).agg(F.count(F.lit(1))).na.fill(0, list(feeds))


def feed_profile(tables: Mapping[str, DataFrame], feed: str) -> DataFrame:
    """Long-form profile of one feed: type and agency counts, optional columns, horizons, sizes."""
    rows = []

    def fact(df: DataFrame, metric: str, key: Column, value: Column) -> None:
        rows.append(df.select(F.lit(feed).alias("feed"), F.lit(metric).alias("metric"), key.alias("key"), value.alias("value")))

    if "routes" in tables:
        kinds = tables["routes"].groupBy("route_type").agg(F.count("*").alias("n"))
        fact(kinds, "route_type", F.col("route_type"), F.col("n").cast("string"))
    for name, df in tables.items():
        if name in ("routes", "trips", "stops", "agency"):
            fact(df.agg(F.count("*").alias("n")), "rows", F.lit(name), F.col("n").cast("string"))
    for name, starts, ends in (("calendar", "start_date", "end_date"), ("calendar_dates", "date", "date")):
        if name in tables:
            span = tables[name].agg(F.min(starts).alias("lo"), F.max(ends).alias("hi"))
            fact(span, "horizon", F.lit(name), F.concat_ws("-", "lo", "hi"))
    for name, optional in OPTIONAL_COLUMNS.items():
        if name in tables:
            have = F.array(*[
                F.struct(F.lit(c).alias("k"), F.lit("yes" if c in tables[name].columns else "no").alias("v")) for c in optional
            ])
            one = tables[name].agg(F.count("*").alias("n")).select(F.explode(have).alias("x"))
            fact(one, f"column:{name}", F.col("x.k"), F.col("x.v"))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def duplicate_pair_counts(dups: DataFrame) -> DataFrame:
    """Duplicate pairs per pair of feeds, from feed-prefixed trip ids or feed columns; a row of groups counts for all its pairs."""
    if "feed_a" in dups.columns:
        a, b = F.col("feed_a"), F.col("feed_b")
    else:
        a, b = F.split("trip_a", ":")[0], F.split("trip_b", ":")[0]
    pairs = F.sum(F.size("members_a").cast("bigint") * F.size("members_b")) if "members_a" in dups.columns else F.count("*")
    return dups.groupBy(F.concat(a, F.lit("<->"), b).alias("feed_pair")).agg(pairs.alias("n"))


def delay_bin(delay_s: Column) -> Column:
    """Number of the delay bin, from 0."""
    minutes = delay_s / 60
    branch = None
    for i, (_, _, upper) in enumerate(DELAY_BINS):
        if upper is not None:
            branch = F.when(minutes < upper, i) if branch is None else branch.when(minutes < upper, i)
    return branch.otherwise(len(DELAY_BINS) - 1)


def delay_histogram(trains: DataFrame) -> DataFrame:
    """Trains per delay bin with their share in percent; empty bins show 0."""
    known = trains.filter(F.col("delay_s").isNotNull())
    counted = known.groupBy(delay_bin(F.col("delay_s")).alias("bin_no")).agg(F.count("*").alias("n"))
    # one row of eight counters, so the share needs no second pass
    wide = counted.agg(*[
        F.coalesce(F.sum(F.when(F.col("bin_no") == i, F.col("n"))), F.lit(0)).alias(f"_{i}") for i in range(len(DELAY_BINS))
    ])
    total = sum((F.col(f"_{i}") for i in range(1, len(DELAY_BINS))), F.col("_0"))
    bins = F.explode(F.array(*[
        F.struct(F.lit(i).alias("bin_no"), F.lit(label).alias("bin"), F.col(f"_{i}").alias("n"))
        for i, (label, _, _) in enumerate(DELAY_BINS)
    ]))
    out = wide.select(total.alias("_total"), bins.alias("b")).select("_total", "b.*")
    share = F.floor(100 * F.col("n") / F.greatest("_total", F.lit(1)) + 0.5).cast("bigint")
    return out.select("bin_no", "bin", "n", share.alias("pct"))


def delay_percentile(trains: DataFrame) -> DataFrame:
    """Inclusive percentile rank of each train's delay; NULL without a delay.

    Ranks come from counts per distinct delay (whole seconds), not from a sort of all trains.
    """
    counts = trains.filter(F.col("delay_s").isNotNull()).groupBy("delay_s").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("delay_s"))
    whole = F.sum("_n").over(Window.orderBy("delay_s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranks = counts.select("delay_s", F.floor(100 * upto / whole + 0.5).cast("int").alias("percentile"))
    return trains.join(ranks, "delay_s", "left").select(*trains.columns, "percentile")


def order_trains(trains: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """Table order: the column, then last sighting; NULL sorts lowest."""
    if descending:
        return trains.orderBy(F.col(column).desc_nulls_last(), F.col("last_ts").desc_nulls_last())
    return trains.orderBy(F.col(column).asc_nulls_first(), F.col("last_ts").asc_nulls_first())


def source_coverage(poll_log: DataFrame, sources: DataFrame, as_of: int, stale_s: int = 300) -> DataFrame:
    """Status and age of each source: off, waiting, ok or partial; an old one shows stale."""
    last = poll_log.groupBy("country").agg(F.max("ok_ts").alias("_ok"))
    age = (F.lit(as_of).cast("bigint") - F.col("_ok")).alias("age_s")
    status = (
        F.when(~F.col("enabled"), F.col("off_status"))
        .when(F.col("_ok").isNull(), "wait")
        .otherwise(F.when(F.col("partial"), "partial").otherwise("ok"))
    )
    joined = sources.join(last, "country", "left").select("country", status.alias("status"), age)
    live = F.col("status").isin("ok", "partial")
    shown = F.when(live & (F.col("age_s") > stale_s), "stale").otherwise(F.col("status"))
    return joined.select("country", "status", F.when(live, F.col("age_s")).alias("age_s"), shown.alias("shown"))


def edge_cover(node_paths: DataFrame) -> DataFrame:
    """Which segments run over each pair of neighbouring nodes: u, v, segment (distinct rows)."""
    paired = beside(node_paths, ["segment"], ["pos"], ["node_id"])
    pairs = paired.filter(F.col("next_node_id").isNotNull() & (F.col("node_id") != F.col("next_node_id")))
    return pairs.select(
        F.least("node_id", "next_node_id").alias("u"), F.greatest("node_id", "next_node_id").alias("v"), "segment"
    ).distinct()


def polyline_steps(geometry: DataFrame, key: str = "id") -> DataFrame:
    """Consecutive points of each polyline with the distance between them."""
    paired = beside(geometry, [key], ["seq"], ["lat", "lon"])
    step = haversine_m(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon"))
    return paired.withColumn("step_m", step)


def polyline_length(geometry: DataFrame, key: str = "id") -> DataFrame:
    return polyline_steps(geometry, key).groupBy(key).agg(F.coalesce(F.sum("step_m"), F.lit(0.0)).alias("length_m"))


def works_by_edge(groups: DataFrame) -> DataFrame:
    """The gravest notice of each edge; among equals the first group."""
    rank = F.lit(0)
    for name, value in SEVERITY_RANK.items():
        rank = F.when(F.col("sev") == name, value).otherwise(rank)
    info = F.struct("src", "sev", "until", "txt")
    top = groups.groupBy("edge").agg(F.min_by(info, F.struct((-rank).alias("r"), F.col("group_seq"))).alias("w"))
    return top.select("edge", "w.*")


def station_frequency(patterns: DataFrame, tier_a: int = 80) -> DataFrame:
    """Trips calling at each cluster, busiest first, with polling tier.

    A cluster met twice in a pattern counts twice. Ranks are global, hence numbered by ranges of the per-cluster totals.
    """
    totals = patterns.groupBy(F.col("cluster").alias("cluster_id")).agg(F.sum("n_trips").alias("n_trips"))
    ranked = numbered(totals, [F.desc("n_trips"), F.col("cluster_id").asc()], "rank").withColumn("rank", F.col("rank").cast("int"))
    return ranked.withColumn("tier", F.when(F.col("rank") <= tier_a, "A").otherwise("B"))


def busiest_stations(frequency: DataFrame, k: int) -> DataFrame:
    return frequency.orderBy(F.desc("n_trips"), "cluster_id").limit(k)


def freshest_keys(obs: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    last = obs.groupBy(*keys).agg(F.max("ts").alias("ts"))
    return last.orderBy(F.desc("ts"), *keys).limit(k)


def top_series(intl: DataFrame, routes: DataFrame, agency: DataFrame, k: int = 8) -> DataFrame:
    """The k most frequent agency / route series per corridor and feed."""
    names = agency.select("agency_id", "agency_name")
    long_name = [F.nullif(F.col("route_long_name"), F.lit(""))] if "route_long_name" in routes.columns else []
    label = F.coalesce(F.nullif(F.col("route_short_name"), F.lit("")), *long_name, F.col("route_id"))
    kept = intl.select("trip_id", "feed", "corridor", "route_id")
    joined = kept.join(routes.drop("feed"), "route_id").join(names, "agency_id", "left")
    series = F.concat(F.coalesce("agency_name", F.lit("?")), F.lit(" / "), label).alias("series")
    counted = joined.groupBy("corridor", "feed", series).agg(F.count("*").alias("n"))
    along = Window.partitionBy("corridor", "feed").orderBy(F.desc("n"), "series")
    return counted.withColumn("rank", F.row_number().over(along)).filter(F.col("rank") <= k)


def stratified_sample(df: DataFrame, category: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """At most k rows per category in seeded pseudo-random order."""
    return first_rows(df, category, [F.xxhash64(F.lit(seed), key), F.col(key)], k, "pick")


def pattern_links(patterns: DataFrame, pair_edges: DataFrame) -> DataFrame:
    """Edges under each link of each pattern: pattern_id, n_trips, pos, edge (link pos -> pos+1)."""
    paired = beside(patterns, ["pattern_id"], ["pos"], ["cluster"])
    links = paired.filter(F.col("next_cluster").isNotNull()).withColumn(
        "segment", segment_id(F.col("cluster"), F.col("next_cluster")))
    return links.join(pair_edges, "segment", "left").select("pattern_id", "n_trips", "pos", "edge")


def pair_edges(segments: DataFrame, refinement: DataFrame, segment_edges: DataFrame) -> DataFrame:
    """Drawn edges of each cluster pair, over its refinement."""
    fine = refine(segments.select("segment"), refinement)
    return to_edges(fine, segment_edges, on="fine").select("segment", "edge").distinct()


def observed_span(patterns: DataFrame, stations: DataFrame) -> DataFrame:
    """First and last position of a selected station per pattern."""
    chosen = patterns.join(stations.select(F.col("cluster_id").alias("cluster")), "cluster", "left_semi")
    return chosen.groupBy("pattern_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))


def _laid_out(patterns: DataFrame, stations: DataFrame, pair_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Patterns, the edges of their links and their observed spans, each worked out once: patterns come from all calls of all trips."""
    patterns = cut_lineage(patterns)
    return patterns, cut_lineage(pattern_links(patterns, pair_edges)), observed_span(patterns, stations)


def _between(links: DataFrame, spans: DataFrame) -> DataFrame:
    inside = (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")) & F.col("edge").isNotNull()
    return links.join(spans, "pattern_id").filter(inside).select("edge").distinct()


def static_edge_coverage(patterns: DataFrame, stations: DataFrame, pair_edges: DataFrame) -> DataFrame:
    """Edges between the outermost selected stations of any pattern."""
    _, links, spans = _laid_out(patterns, stations, pair_edges)
    return _between(links, spans)


def marginal_gain(patterns: DataFrame, stations: DataFrame, pair_edges: DataFrame) -> DataFrame:
    """Edges each further station would add to the coverage, over patterns already open.

    A candidate widens a pattern's span by the links between the span and its own outermost
    positions; links meet candidates by pattern and side, and only uncovered edges take part.
    """
    patterns, links, spans = _laid_out(patterns, stations, pair_edges)
    covered = _between(links, spans)
    chosen = stations.select(F.col("cluster_id").alias("cluster"))
    reach = (
        patterns.join(chosen, "cluster", "left_anti")
        .groupBy("pattern_id", "cluster").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
        .join(spans, "pattern_id")
    )
    links = links.filter(F.col("edge").isNotNull()).join(covered, "edge", "left_anti")
    met = links.select("pattern_id", "pos", "edge").join(reach, "pattern_id")
    before = (F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("lo"))
    after = (F.col("pos") >= F.col("hi")) & (F.col("pos") < F.col("last"))
    return met.filter(before | after).select(F.col("cluster").alias("cluster_id"), "edge").distinct().groupBy(
        "cluster_id").agg(F.count("*").alias("gain"))


def pattern_opening_value(patterns: DataFrame, stations: DataFrame, pair_edges: DataFrame) -> DataFrame:
    """Expected coloured edges of opening a pattern without any selected station."""
    _, links, spans = _laid_out(patterns, stations, pair_edges)
    covered = _between(links, spans)
    fresh = links.join(spans, "pattern_id", "left_anti")
    new = fresh.filter(F.col("edge").isNotNull()).join(covered, "edge", "left_anti")
    counted = new.select("pattern_id", "n_trips", "edge").distinct().groupBy("pattern_id", "n_trips").agg(F.count("*").alias("_e"))
    duty = F.least(F.lit(1.0), F.col("n_trips") * COLOURED_MINUTES / SERVICE_MINUTES)
    return counted.select("pattern_id", (duty * F.col("_e")).alias("value"))
