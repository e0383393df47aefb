"""Segments where trains are cancelled and none gets through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.operators.sequence_tools import at_instants

WINDOW_S = 5400
MIN_TRIPS = 2


def blocked_segments(cancels: DataFrame, passages: DataFrame, as_of: DataFrame | int,
                     window_s: int = WINDOW_S, min_trips: int = MIN_TRIPS) -> DataFrame:
    """Segments with cancellations of several trips in the window and no later passage.

    Takes the raw, repeated cancellations. A passage older than the window cannot follow a
    cancellation inside it, so both sides are read for the window only, and each trip
    shrinks to its last cancellation before the two meet.
    """
    last_cancel = (
        at_instants(cancels.select("segment", "trip_id", "ts"), as_of, window_s)
        .groupBy("as_of", "segment", "trip_id").agg(F.max("ts").alias("last_cancel"))
    )
    last_passage = (
        at_instants(passages.select("segment", "ts"), as_of, window_s)
        .groupBy("as_of", "segment").agg(F.max("ts").alias("last_passage"))
    )
    standing = last_cancel.join(last_passage, ["as_of", "segment"], "left").filter(
        F.col("last_passage").isNull() | (F.col("last_cancel") > F.col("last_passage")))
    counted = standing.groupBy("as_of", "segment").agg(F.count("*").alias("n_trips"))
    return counted.filter(F.col("n_trips") >= min_trips)
