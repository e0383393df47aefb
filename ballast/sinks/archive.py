"""Append-only observation log and its daily archive."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ballast.functions.time import service_day, utc_day


def archive_days(seg_obs: DataFrame, stop_obs: DataFrame, exported: DataFrame, as_of: int, max_days: int | None = None) -> DataFrame:
    """Completed days not yet exported, oldest first: all of them, or the first ``max_days`` if a caller asks for that.

    Logs that are partitioned by ``day`` give their days from the folder names alone.
    """
    def days_of(obs: DataFrame, otherwise) -> DataFrame:
        day = F.col("day").cast("date") if "day" in obs.columns else otherwise
        return obs.select(day.alias("day")).distinct()

    seg_days, stop_days = days_of(seg_obs, utc_day(F.col("ts"))), stop_obs.select(service_day(F.col("service_date")).alias("day")).distinct()
    today = F.to_date(F.timestamp_seconds(F.lit(as_of)))
    days = seg_days.union(stop_days).distinct().filter(F.col("day").isNotNull() & (F.col("day") < today))
    days = days.join(exported.select(F.col("day").cast("date")), "day", "left_anti").orderBy("day")
    return days if max_days is None else days.limit(max_days)


def archive_rows(seg_obs: DataFrame, stop_obs: DataFrame, days: list[date]) -> dict[str, DataFrame]:
    """Rows of those days: segment rows by UTC day of ts, stop rows by service date; the days are literals, so scans prune."""
    seg = seg_obs if "day" in seg_obs.columns else seg_obs.withColumn("day", utc_day(F.col("ts")))
    first, last = (min(days), max(days)) if days else (date.max, date.min)
    seg = seg.filter(F.col("day").cast("date").isin(days) & F.col("ts").between(_epoch(first), _epoch(last) + 86399))
    names = [d.strftime("%Y%m%d") for d in days]
    stops = stop_obs.filter(F.substring("service_date", 1, 8).isin(names)).withColumn("day", service_day(F.col("service_date")))
    return {"seg": seg, "stops": stops}


def _epoch(day: date) -> int:
    return (day - date(1970, 1, 1)).days * 86400


def archive_completed_days(seg_obs: DataFrame, stop_obs: DataFrame, exported: DataFrame, as_of: int, folder: str,
                           max_days: int | None = None) -> DataFrame:
    """Write the open days as zstd Parquet, one partition per day, and return them.

    The driver sees the list of days. A day is split over as many files as its rows fill, so one day may hold most of them.
    """
    open_days = [r.day for r in archive_days(seg_obs, stop_obs, exported, as_of, max_days).collect()]
    for name, rows in archive_rows(seg_obs, stop_obs, open_days).items():
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
         .option("maxRecordsPerFile", 5_000_000).partitionBy("day").parquet(f"{folder}/{name}"))
    return seg_obs.sparkSession.createDataFrame([(d,) for d in open_days], "day date")


def append_observations(stream: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of observations to the log, partitioned by day.

    The file sink keeps a record of the batches it holds, so a batch that is run again after a failure adds nothing.
    """
    placed = stream.withColumn("day", utc_day(F.col("ts")))
    writer = placed.writeStream.format("parquet").partitionBy("day").option("compression", "zstd").option("path", folder)
    return writer.option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
