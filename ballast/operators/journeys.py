"""Earliest arrivals for many journey queries at once."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.session import cut_lineage


def earliest_arrivals(queries: DataFrame, stop_times_on_day: DataFrame, max_rounds: int | None = None,
                      transfer_s: int = 300) -> DataFrame:
    """Arrival at the destination per number of trains, where one more train is faster; rounds go on until none is.

    queries: query_id, origin, destination, depart_s. stop_times_on_day: trip_id, seq, cluster,
    dep_s. Each round boards, per query and trip, at the first stop that can be caught from a
    cluster reached in the round before; arrivals later than one known for the cluster or the
    destination are dropped.
    """
    times = cut_lineage(stop_times_on_day.filter(F.col("dep_s").isNotNull()).select("trip_id", "seq", "cluster", "dep_s"))
    goals = queries.select(F.col("query_id").alias("_q"), "destination")
    best = cut_lineage(queries.select("query_id", F.col("origin").alias("cluster"), F.col("depart_s").cast("int").alias("arr"), F.lit(0).alias("round")))
    results = None
    for number in count(1) if max_rounds is None else range(1, max_rounds + 1):
        ready = F.col("arr") + F.lit(0 if number == 1 else transfer_s)
        target = best.join(goals, (F.col("query_id") == F.col("_q")) & (F.col("cluster") == F.col("destination"))).select(
            F.col("_q").alias("query_id"), F.col("arr").alias("_limit"))
        reached = best.filter(F.col("round") == number - 1).select("query_id", "cluster", ready.alias("ready")).join(target, "query_id", "left")
        catch = reached.join(times, "cluster").filter((F.col("dep_s") >= F.col("ready")) & (F.col("_limit").isNull() | (F.col("dep_s") < F.col("_limit"))))
        boarded = catch.groupBy("query_id", "trip_id", "_limit").agg(F.min("seq").alias("_from"))
        ridden = boarded.join(times, "trip_id").filter((F.col("seq") > F.col("_from")) & (F.col("_limit").isNull() | (F.col("dep_s") < F.col("_limit"))))
        arrivals = ridden.groupBy("query_id", "cluster").agg(F.min("dep_s").alias("_new"))
        merged = best.join(arrivals, ["query_id", "cluster"], "full_outer")
        better = F.col("_new").isNotNull() & (F.col("arr").isNull() | (F.col("_new") < F.col("arr")))
        best = cut_lineage(merged.select(
            "query_id", "cluster", F.when(better, F.col("_new")).otherwise(F.col("arr")).alias("arr"),
            F.when(better, F.lit(number)).otherwise(F.col("round")).alias("round")))
        improved = best.filter(F.col("round") == number)
        hit = improved.join(goals, (F.col("query_id") == F.col("_q")) & (F.col("cluster") == F.col("destination"))).select(
            "query_id", "round", F.col("arr").alias("arrival_s"))
        results = hit if results is None else results.unionByName(hit)
        if improved.isEmpty():
            break
    return results
