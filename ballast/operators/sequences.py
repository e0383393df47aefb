"""Operators over the order of stops, updates and observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.functions.geo import segment_id
from ballast.operators.joins import refine
from ballast.operators.sequence_tools import beside, day_chunk, present, running_total

SKIPPED, CANCELED = "SKIPPED", "CANCELED"
MAX_SANE_DELTA_S = 7200


def stop_sequence(stop_times: DataFrame, stop_cluster: DataFrame) -> DataFrame:
    """Stops with a cluster, in trip order; stops without one are bridged over later."""
    keys = present(stop_times, "feed", "trip_id")
    dep = present(stop_times, "dep_s", "service_id")
    return stop_times.join(stop_cluster.select("stop_id", "cluster_id"), "stop_id").select(
        *keys, F.col("stop_sequence").cast("int").alias("seq"), F.col("cluster_id").alias("cluster"), *dep
    )


def hops(stop_times: DataFrame, stop_cluster: DataFrame) -> DataFrame:
    """Consecutive different clusters of each trip: keys, seq, a, b and the departure at a."""
    seq = stop_sequence(stop_times, stop_cluster)
    keys = present(seq, "feed", "trip_id")
    paired = beside(seq, keys, ["seq"], ["cluster"])
    moved = paired.filter(F.col("next_cluster").isNotNull() & (F.col("cluster") != F.col("next_cluster")))
    extra = present(seq, "dep_s", "service_id")
    return moved.select(*keys, "seq", F.col("cluster").alias("a"), F.col("next_cluster").alias("b"), *extra)


def segments(hops: DataFrame) -> DataFrame:
    """Distinct unordered cluster pairs."""
    pairs = hops.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.withColumn("segment", F.concat_ws("|", "a", "b"))


def collapse_repeats(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str,
                     chunk: Column | None = None) -> DataFrame:
    """Keep the first row of each run of equal values."""
    paired = beside(df, key, order, [value], chunk, forward=False)
    before = F.col(f"prev_{value}")
    return paired.filter(before.isNull() | (before != F.col(value))).select(*df.columns)


def _entity(updates: DataFrame) -> list[str]:
    return present(updates, "country", "poll_ts", "entity_pos", "trip_id", "service_date")


def _listed(updates: DataFrame) -> DataFrame:
    """Updates of running trips at known clusters."""
    known = updates.filter(F.col("cluster").isNotNull())
    if "trip_rel" in updates.columns:
        known = known.filter(~F.col("trip_rel").eqNullSafe(CANCELED))
    return known


def segment_deltas(updates: DataFrame, refinement: DataFrame) -> DataFrame:
    """Delay incurred between consecutive stops with an explicit delay, spread over fine segments."""
    keys = _entity(updates)
    explicit = _listed(updates).filter(~F.col("stop_rel").eqNullSafe(SKIPPED) & F.col("delay_s").isNotNull())
    explicit = explicit.select(*keys, "stu_pos", "cluster", "delay_s", "event_ts")
    paired = beside(explicit, keys, ["stu_pos"], ["cluster", "delay_s", "event_ts"])
    moved = paired.filter(F.col("next_cluster").isNotNull() & (F.col("cluster") != F.col("next_cluster")))
    coarse = moved.select(
        *keys, "stu_pos", segment_id(F.col("cluster"), F.col("next_cluster")).alias("segment"),
        (F.col("next_delay_s") - F.col("delay_s")).alias("_delta"), F.col("next_event_ts").alias("event_ts"),
    )
    share = F.bround(F.col("_delta") * F.col("fraction")).cast("int")
    return refine(coarse, refinement).select(*keys, "stu_pos", "ord", "fine", share.alias("delta_s"), "event_ts")


def realised_passages(deltas: DataFrame, as_of: int | None = None) -> DataFrame:
    """Fine segments a train has demonstrably run over: its event lies in the past or has no time."""
    now = F.lit(as_of) if as_of is not None else F.col("poll_ts")
    done = deltas.filter(F.col("event_ts").isNull() | (F.col("event_ts") <= now))
    return done.select(F.col("fine").alias("segment"), now.cast("bigint").alias("ts"))


def skipped_stretches(updates: DataFrame, refinement: DataFrame) -> DataFrame:
    """Fine segments between two skipped stops that follow each other among known stops."""
    keys = _entity(updates)
    known = _listed(updates).select(*keys, "stu_pos", "cluster", "stop_rel")
    paired = beside(known, keys, ["stu_pos"], ["cluster", "stop_rel"], forward=False)
    both = (F.col("stop_rel") == SKIPPED) & (F.col("prev_stop_rel") == SKIPPED)
    coarse = paired.filter(both & (F.col("cluster") != F.col("prev_cluster"))).select(
        *keys, segment_id(F.col("cluster"), F.col("prev_cluster")).alias("segment")
    )
    rest = [k for k in keys if k not in ("poll_ts", "entity_pos")]
    return refine(coarse, refinement).select(F.col("fine").alias("segment"), *rest, F.col("poll_ts").alias("ts"))


def cancelled_trip_segments(cancelled: DataFrame, stop_times: DataFrame, stop_cluster: DataFrame,
                            refinement: DataFrame) -> DataFrame:
    """Fine segments of the timetable path of trips cancelled as a whole."""
    keys = present(stop_times, "feed", "trip_id")
    wanted = stop_times.join(cancelled.select(*keys).distinct(), keys, "left_semi")
    path = hops(wanted, stop_cluster).withColumn("segment", segment_id(F.col("a"), F.col("b")))
    fine = refine(path, refinement).select(*keys, F.col("fine").alias("segment"))
    return cancelled.join(fine, keys)


def latest_stop_state(records: DataFrame) -> DataFrame:
    """Last known state per trip and stop index."""
    payload = F.struct("label", "cluster", "delay_s", "event_ts", "service_date", "cancelled")
    last = records.groupBy("head", "idx").agg(F.max_by(payload, F.struct("seen_ts", "seq")).alias("s"))
    return last.select("head", "idx", "s.*")


def neighbour_pairs(stop_state: DataFrame) -> DataFrame:
    """Known stops of a trip paired with the next known one, however far apart."""
    values = ["cluster", "delay_s", "event_ts", "service_date", "cancelled"]
    paired = beside(stop_state, ["head"], ["idx"], values)
    return paired.filter(F.col("next_cluster").isNotNull() & (F.col("cluster") != F.col("next_cluster")))


def neighbour_deltas(stop_state: DataFrame, refinement: DataFrame, as_of: int,
                     expansion: DataFrame | None = None) -> dict[str, DataFrame]:
    """Deltas, cancels and passages between neighbouring known stops of each trip."""
    pairs = neighbour_pairs(stop_state).withColumn("ts", F.lit(as_of).cast("bigint"))
    return {kind: rows.drop(*(["ts"] if kind == "deltas" else [])) for kind, rows in pair_deltas(pairs, refinement, expansion).items()}


def pair_deltas(pairs: DataFrame, refinement: DataFrame, expansion: DataFrame | None = None) -> dict[str, DataFrame]:
    """Deltas, cancels and passages of pairs of neighbouring stops as they stand at ``ts``, batch or stream.

    ``expansion`` (head, a, b -> fine, fraction) replaces the refinement of pairs it knows.
    """
    pairs = pairs.withColumn("segment", segment_id(F.col("cluster"), F.col("next_cluster")))
    if expansion is None:
        fine = refine(pairs, refinement)
    else:
        known = expansion.select("head", "cluster", "next_cluster", "fine", "fraction", "ord")
        fine = pairs.join(known, ["head", "cluster", "next_cluster"])
    both = F.col("cancelled") & F.col("next_cancelled")
    neither = ~F.col("cancelled") & ~F.col("next_cancelled")
    delta = F.col("next_delay_s") - F.col("delay_s")
    run = fine.filter(neither & (F.abs(delta) <= MAX_SANE_DELTA_S))
    past = (F.col("event_ts") <= F.col("ts")) & (F.col("next_event_ts") <= F.col("ts"))
    date = F.coalesce(F.nullif(F.col("service_date"), F.lit("")), F.col("next_service_date"))
    return {
        "deltas": run.select(F.col("label").alias("trip_id"), F.col("fine").alias("segment"),
                             F.bround(delta * F.col("fraction")).cast("int").alias("delta_s"), "ts"),
        "cancels": fine.filter(both).select(F.col("fine").alias("segment"), F.col("label").alias("trip_id"), date.alias("service_date"), "ts"),
        "passages": run.filter(past).select(F.col("fine").alias("segment"), "ts"),
    }


def closed_runs(candidates: DataFrame, min_run: int = 2) -> DataFrame:
    """Blocks of consecutive hours per day and edge; a group has at most 24 rows."""
    along = Window.partitionBy("d", "edge").orderBy("hour")
    island = candidates.withColumn("_island", F.col("hour") - F.row_number().over(along))
    runs = island.groupBy("d", "edge", "_island").agg(
        F.min("hour").cast("int").alias("hour_start"), F.max("hour").cast("int").alias("hour_end"),
        F.count("*").alias("_n"),
    )
    return runs.filter(F.col("_n") >= min_run).select("d", "edge", "hour_start", "hour_end")


def deleted_runs(impacted_stops: DataFrame) -> DataFrame:
    """Chains of deleted stops, one row per known stop: a stop with another effect ends a chain."""
    keys = ["disruption_id", "object_no"]
    broken = (~F.col("effect").eqNullSafe("deleted")).cast("int")
    numbered = running_total(impacted_stops, keys, ["stop_no"], broken, None, "run_no")
    deleted = numbered.filter((F.col("effect") == "deleted") & F.col("cluster").isNotNull())
    return deleted.select(*keys, F.col("run_no").cast("bigint").alias("run_no"), F.col("stop_no").alias("pos"), "cluster")


def changes_only(obs: DataFrame, keys: Sequence[str], value: str, order: Sequence[str],
                 chunk: Column | None = None) -> DataFrame:
    """Observations whose value differs from the previous one of the same key."""
    paired = beside(obs, keys, order, [value], day_chunk() if chunk is None else chunk, forward=False)
    before = F.col(f"prev_{value}")
    return paired.filter(before.isNull() | ~before.eqNullSafe(F.col(value))).select(*obs.columns)


def trip_patterns(stop_seq: DataFrame) -> DataFrame:
    """Identical cluster sequences with their number of trips: pattern_id, pattern[], n_trips.

    Trips are first compared by a digest of their stops, so that the sequence itself is
    gathered for one trip of each pattern only.
    """
    keys = present(stop_seq, "feed", "trip_id")
    runs = collapse_repeats(stop_seq.filter(F.col("cluster").isNotNull()), keys, ["seq"], "cluster")
    numbered = running_total(runs, keys, ["seq"], F.lit(1), None, "pos")
    part = F.struct("pos", "cluster")
    digests = numbered.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64(part).cast("decimal(38,0)")).alias("h1"),
        F.sum(F.xxhash64(F.lit(7), part).cast("decimal(38,0)")).alias("h2"),
    )
    weighted = digests.filter(F.col("n") >= 2).groupBy("n", "h1", "h2").agg(
        F.count("*").alias("n_trips"), F.min(F.struct(*keys)).alias("_example")
    )
    examples = weighted.select("n_trips", *[F.col("_example")[k].alias(k) for k in keys])
    return numbered.join(examples, keys).select(
        F.concat_ws("/", *keys).alias("pattern_id"), "n_trips", (F.col("pos") - 1).cast("int").alias("pos"), "cluster"
    )
