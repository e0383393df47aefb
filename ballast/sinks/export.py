"""Dataset export and run metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def export_dataset(tables: Mapping[str, DataFrame], folder: str, formats: Sequence[str] = ("csv", "parquet")) -> DataFrame:
    """Write each table per format; returns name, format, rows, bytes of what was written."""
    facts, spark = [], None
    for name, df in tables.items():
        spark = df.sparkSession
        for fmt in formats:
            seen = Observation()
            path = f"{folder}/{fmt}/{name}"
            writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
            if fmt == "csv":
                writer.option("header", True).option("escape", '"').csv(path)
            else:
                writer.option("compression", "zstd").parquet(path)
            pattern = "*.csv" if fmt == "csv" else "*.parquet"
            sizes = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("length")
            facts.append(sizes.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).select(
                F.lit(name).alias("name"), F.lit(fmt).alias("format"), F.lit(int(seen.get["rows"])).cast("bigint").alias("rows"), "bytes"))
    out = facts[0]
    for more in facts[1:]:
        out = out.unionByName(more)
    return out


def collect_metrics(items: Sequence[tuple[str, str, str, DataFrame]]) -> DataFrame:
    """Row counts in long form, one per (stage, feed, metric, table)."""
    out = None
    for stage, feed, metric, df in items:
        part = df.agg(F.count(F.lit(1)).alias("value")).select(
            F.lit(stage).alias("stage"), F.lit(feed).alias("feed"), F.lit(metric).alias("metric"), "value")
        out = part if out is None else out.unionByName(part)
    return out
