"""Planned closures: edge hours a majority of like days serves and a coming day does not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.time import day_type
from ballast.operators.aggregates import day_bits, days_of_type, served_days, service_baseline
from ballast.operators.joins import service_days
from ballast.operators.sequences import closed_runs
from ballast.session import cut_lineage

SAMPLE_DAYS, LOOKAHEAD_DAYS, MIN_RUN_HOURS = 35, 14, 2


def sample_dates(spark, start: str, days: int = SAMPLE_DAYS) -> DataFrame:
    """The sample dates from a yyyyMMdd start on, with day type."""
    day = F.date_format(F.date_add(F.to_date(F.lit(start), "yyyyMMdd"), F.col("id").cast("int")), "yyyyMMdd")
    return spark.range(days).select(day.alias("d"), F.col("id").cast("int").alias("i")).withColumn("daytype", day_type(F.col("d")))


def closure_candidates(served: DataFrame, dates: DataFrame, lookahead: int = LOOKAHEAD_DAYS) -> DataFrame:
    """Unserved (date, edge, hour) of the coming days that are in the baseline of their day type.

    What is missing of a coming type's days is found on masks; only missing days become rows.
    """
    strong = service_baseline(served, dates).select("edge", "hour", "daytype")
    coming = dates.filter(F.col("i") < lookahead)
    masks = F.broadcast(days_of_type(coming).drop("total"))  # a row for each day type and 64 dates
    have = served.select("edge", "hour", "word", "days")
    missing = strong.join(masks, "daytype").join(have, ["edge", "hour", "word"], "left").withColumn(
        "open", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("days", F.lit(0).cast("bigint"))))).filter("open <> 0")
    bits = F.broadcast(day_bits(coming).select("d", "word", "bit"))  # a row for each coming date
    return missing.join(bits, "word").filter(F.col("open").bitwiseAND(F.col("bit")) != 0).select("d", "edge", "hour")


def planned_closures(hops: DataFrame, trips: DataFrame, refinement: DataFrame, segment_edges: DataFrame,
                     calendar: DataFrame, calendar_dates: DataFrame, dates: DataFrame,
                     lookahead: int = LOOKAHEAD_DAYS, min_run: int = MIN_RUN_HOURS) -> DataFrame:
    """Blocks (d, edge, hour_start, hour_end) without planned service. dates: d, i (0 = first), daytype.

    The served days, a mask for each edge and hour, are used twice and kept in the shared checkpoint folder between.
    """
    days = service_days(calendar, calendar_dates, dates)
    served = cut_lineage(served_days(hops, trips, refinement, segment_edges, days, dates))
    return closed_runs(closure_candidates(served, dates, lookahead), min_run)
