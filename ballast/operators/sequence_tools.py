"""Order-dependent building blocks that split a group too large for one task.

A group is cut into chunks along its order. Neighbours and running totals are found inside a
chunk; only one summary row per chunk travels to the group level, so a key holding a large
share of all rows is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.session import cut_lineage


def day_chunk(col: str = "ts") -> Column:
    return F.floor(F.col(col) / 86400).cast("bigint")


def beside(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
           chunk: Column | None = None, forward: bool = True, prefix: str | None = None) -> DataFrame:
    """Add the named columns of the next (or previous) row of the same group, as next_<v> / prev_<v>.

    Without ``chunk`` a group is one window: for trips, polylines and chains, which are short. With it, for groups of
    any size, windows end at chunk borders (``chunk`` must not decrease along ``order``), and only the first and last
    row of each chunk meet those of the others, in a second window.
    """
    keys, order = list(keys), list(order)
    prefix = prefix or ("next_" if forward else "prev_")
    shift = F.lead if forward else F.lag
    payload = F.struct(*[F.col(v).alias(v) for v in values])
    added = [F.col("_side")[v].alias(f"{prefix}{v}") for v in values]
    whole = Window.partitionBy(*keys).orderBy(*order)
    if chunk is None:
        return df.withColumn("_side", shift(payload).over(whole)).select(*df.columns, *added)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    back = F.lag if forward else F.lead
    local = df.withColumn("_chunk", chunk).withColumns({
        "_side": shift(payload).over(inside), "_other": back(F.lit(1)).over(inside),
    })
    rims = local.filter(F.col("_side").isNull() | F.col("_other").isNull())
    met = rims.withColumn("_open", F.col("_side").isNull()).withColumn("_side", shift(payload).over(whole)).filter("_open")
    return local.filter(F.col("_side").isNotNull()).select(*df.columns, *added).unionByName(met.select(*df.columns, *added))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                  chunk: Column | None, name: str, inclusive: bool = True) -> DataFrame:
    """Add the running sum of ``value`` along the order of each group; without ``chunk`` a group is one window."""
    keys, order = list(keys), list(order)
    if chunk is None:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        return df.withColumn("_value", value).select(*df.columns, F.coalesce(F.sum("_value").over(frame), F.lit(0)).alias(name))
    chunked = df.withColumn("_chunk", chunk).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = chunked.withColumn("_local", F.coalesce(F.sum("_value").over(frame), F.lit(0)))
    sums = chunked.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_chunk", F.sum("_sum").over(before).alias("_before"))
    sums = sums.filter(F.col("_before").isNotNull())
    joined = local.join(sums, [*keys, "_chunk"], "left")
    total = F.col("_local") + F.coalesce("_before", F.lit(0))
    return joined.select(*df.columns, total.alias(name))


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add the row's number, from 1, in the order of all rows: each range is numbered on its own, after the rows of those before it."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once, so that the ids stay: their upper bits are the range, the lower 33 the place in it.
    placed = cut_lineage(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("_id", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shuffle partition
    bases = F.broadcast(sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    place = F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("_range", F.shiftright("_id", 33)).join(bases, "_range").select(*df.columns, place.alias(name))


def first_rows(df: DataFrame, group: str, order: Sequence[Column], k: int, name: str, parts: int = 64) -> DataFrame:
    """The first k rows of each group with their rank; a group of any size is cut into ``parts`` first, each of which keeps k."""
    part = Window.partitionBy(group, "_part").orderBy(*order)
    salted = df.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))  # which part a row falls into does not matter
    few = salted.withColumn(name, F.row_number().over(part)).filter(F.col(name) <= k).drop("_part", name)
    return few.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(name) <= k)


def at_instants(events: DataFrame, as_of: DataFrame | int, seconds: int, ts: str = "ts") -> DataFrame:
    """Events no older than ``seconds`` at an instant, once per instant they belong to.

    Many instants meet their events over equal time buckets, never by comparing all pairs.
    """
    if not isinstance(as_of, DataFrame):
        recent = events.filter(F.col(ts).between(as_of - seconds, as_of))
        return recent.withColumn("as_of", F.lit(as_of).cast("bigint"))
    bucket = F.floor(F.col(ts) / seconds).cast("bigint")
    placed = events.withColumn("_bucket", F.explode(F.array(bucket, bucket + 1)))
    instants = as_of.select("as_of", F.floor(F.col("as_of") / seconds).cast("bigint").alias("_bucket"))
    age = F.col("as_of") - F.col(ts)
    return placed.join(instants, "_bucket").filter((age >= 0) & (age <= seconds)).drop("_bucket")


def present(df: DataFrame, *names: str) -> list[str]:
    """Those of the columns the table has."""
    return [n for n in names if n in df.columns]
