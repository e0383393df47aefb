"""Per-train and per-edge inspection tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.operators.aggregates import TRAIN, cancel_stats, edge_cancels, edge_passages, latest_per_cluster, recent
from ballast.operators.joins import all_train_keys, attribute_passages, trip_metadata

WINDOW_S = 4 * 3600


def row_id() -> Column:
    """Key of a train's row; rows order by it."""
    return F.concat_ws("|", *TRAIN).alias("row_id")


def metadata_of(keys: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Timetable headers and stops of the trips among the keys only."""
    wanted = keys.select("trip_id").distinct()
    trips = tables["trips"].join(wanted, "trip_id", "left_semi")
    times = tables["stop_times"].join(wanted, "trip_id", "left_semi")
    return trip_metadata(trips, tables["routes"], times, tables["stops"], tables["stop_cluster"], tables["clusters"])


def train_table(stop_obs: DataFrame, cancel_obs: DataFrame, metadata: dict[str, DataFrame], clusters: DataFrame,
                as_of: int, window_s: int = WINDOW_S) -> DataFrame:
    """One row per train seen running or cancelled in the window: row_id and the 16 columns.

    A train seen only as cancelled has no delay and takes its bounds from the cancellations;
    without a timetable its first and last observed stations stand for origin and destination.
    """
    # Per cluster first, as a train repeats itself at every poll; origin and destination are told by each cluster's last row.
    per_cluster = recent(stop_obs, as_of, window_s).groupBy(*TRAIN, "cluster").agg(
        F.max(F.struct("ts", "seq", "delay_s")).alias("_at"), F.min("ts").alias("_begun"), F.count("*").alias("_n"))
    order = F.struct("_at.ts", "_at.seq")
    observed = per_cluster.groupBy(*TRAIN).agg(
        F.max_by(F.struct("cluster", "_at.delay_s", "_at.ts"), order).alias("_last"), F.min_by("cluster", order).alias("_first_cluster"),
        F.min("_begun").alias("first_ts"), F.sum("_n").alias("n_obs"))
    cancelled = cancel_stats(cancel_obs, as_of, window_s).select(
        *TRAIN, F.col("first_ts").alias("_c_first"), F.col("last_ts").alias("_c_last"), F.lit(True).alias("_cancelled"))
    both = all_train_keys(observed, cancelled)
    plan = metadata["stops"].groupBy("trip_id").agg(
        F.min_by(F.struct("name", "dep"), "pos").alias("_from"), F.max_by(F.struct("name", "arr"), "pos").alias("_to"))
    heads = metadata["headers"].join(plan, "trip_id", "left").withColumn("_known", F.col("_from").isNotNull())
    names = clusters.select("cluster_id", "name")
    joined = (
        both.join(heads, "trip_id", "left")
        .join(names.toDF("_lc", "_last_name"), F.col("_last.cluster") == F.col("_lc"), "left")
        .join(names.toDF("_fc", "_first_name"), F.col("_first_cluster") == F.col("_fc"), "left")
    )
    last_name = F.coalesce("_last_name", F.col("_last.cluster"))
    first_name = F.coalesce("_first_name", "_first_cluster")
    known = F.coalesce("_known", F.lit(False))
    return joined.select(
        row_id(), *TRAIN, F.coalesce("train_number", "trip_id").alias("train_number"), "route",
        F.when(known, F.col("_from.name")).otherwise(first_name).alias("origin"),
        F.when(known, F.col("_to.name")).otherwise(last_name).alias("destination"),
        F.when(known, F.col("_from.dep")).alias("sched_dep"), F.when(known, F.col("_to.arr")).alias("sched_arr"),
        F.col("_last.delay_s").alias("delay_s"), last_name.alias("last_stop"),
        F.least("first_ts", "_c_first").alias("first_ts"), F.greatest("_last.ts", "_c_last").alias("last_ts"),
        F.coalesce("n_obs", F.lit(0)).alias("n_obs"), known.alias("sched_known"), F.coalesce("_cancelled", F.lit(False)).alias("cancelled"),
    )


def train_details(trains: DataFrame, stop_obs: DataFrame, metadata: dict[str, DataFrame], clusters: DataFrame,
                  as_of: int, window_s: int = WINDOW_S) -> DataFrame:
    """Planned stops with observed delay (part 0), then observed stops outside the plan by time (part 1)."""
    seen = latest_per_cluster(stop_obs, as_of, window_s).select(*TRAIN, "cluster", "delay_s", "ts", "seq")
    keys = trains.select(*TRAIN)
    planned = keys.join(metadata["stops"], "trip_id")
    late = seen.select(*TRAIN, "cluster", "delay_s")
    part0 = planned.join(late, [*TRAIN, "cluster"], "left").select(
        *TRAIN, F.lit(0).alias("part"), F.col("pos").cast("bigint").alias("ord"), "name", "arr", "dep", "delay_s")
    off_plan = seen.join(planned.select(*TRAIN, "cluster").distinct(), [*TRAIN, "cluster"], "left_anti")
    # a train meets each cluster once here, so its rows are at most the clusters of the network
    place = F.row_number().over(Window.partitionBy(*TRAIN).orderBy("ts", "seq")).cast("bigint")
    names = clusters.select(F.col("cluster_id").alias("cluster"), F.col("name").alias("_n"))
    part1 = off_plan.withColumn("ord", place).join(names, "cluster", "left").select(
        *TRAIN, F.lit(1).alias("part"), "ord", F.coalesce("_n", "cluster").alias("name"),
        F.lit(None).cast("string").alias("arr"), F.lit(None).cast("string").alias("dep"), "delay_s")
    return part0.unionByName(part1)


def edge_activity(seg_obs: DataFrame, cancel_obs: DataFrame, segment_edges: DataFrame, trains: DataFrame,
                  as_of: int, window_s: int = WINDOW_S) -> dict[str, DataFrame]:
    """Trains that passed each edge and trains cancelled over it, by their row in the train table."""
    rows = trains.select("row_id", *TRAIN, "first_ts", "last_ts")
    passed = attribute_passages(edge_passages(seg_obs, segment_edges, as_of, window_s), rows)
    off = edge_cancels(cancel_obs, segment_edges, as_of, window_s).join(rows.select("row_id", *TRAIN), TRAIN)
    return {"passages": passed.select("edge", "row_id", "delta_s", "ts"), "cancels": off.select("edge", "row_id", "ts")}


def planned_works(closures: DataFrame) -> DataFrame:
    """Blocks of each edge in order; a few per day and edge, so one row per edge stays small."""
    blocks = F.array_sort(F.collect_list(F.struct("d", "hour_start", "hour_end")))
    return closures.groupBy("edge").agg(F.to_json(blocks).alias("blocks"), F.count("*").alias("n_blocks"))
