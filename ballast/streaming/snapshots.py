"""A snapshot for every poll that lands: stream state in a log, joined with what stands still."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ballast.plans.snapshot import BLOCKADE_WINDOW_S, DELAY_WINDOW_S, minute_snapshot

#: What a poll says: a delay on a segment, a cancellation or a passage.
LOG = "kind string, seq long, ts long, segment string, trip_id string, delta_s int"


class Publisher:
    """Writes each batch into the log, by hour and batch, and the snapshot of its minute beside it, under the batch's number.

    The snapshot's instant is the full minute after the batch's latest row; the log is read for the longest window before it.
    Rows that land after an instant has been published, but lie at it or before, belong to its snapshot too: a batch writes
    all snapshots anew whose windows its rows reach. Each is made of the whole log of its window, so a batch that runs again
    overwrites its own folders, adds nothing and gives the same lines.
    """

    def __init__(self, folder: str, statics: Mapping[str, DataFrame], delay_window_s: int = DELAY_WINDOW_S, blockade_window_s: int = BLOCKADE_WINDOW_S):
        self.folder, self.statics = folder.rstrip("/"), dict(statics)
        self.delay_window_s, self.blockade_window_s = delay_window_s, blockade_window_s

    def __call__(self, batch: DataFrame, number: int) -> None:
        # A batch's session is a copy of the stream's; the static tables belong to the latter.
        spark = next(iter(self.statics.values())).sparkSession
        seen = Observation()
        placed = batch.observe(seen, F.min("ts").alias("first"), F.max("ts").alias("last")).withColumns({"hour": F.expr("ts div 3600"), "batch": F.lit(number)})
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "batch").parquet(f"{self.folder}/log")
        first, last = seen.get["first"], seen.get["last"]
        if last is None:
            return
        as_of, window = (last // 60 + 1) * 60, max(self.delay_window_s, self.blockade_window_s)
        instant = spark.range(1).select(F.lit(as_of).cast("long").alias("as_of"))
        instant.write.mode("overwrite").parquet(f"{self.folder}/instants/day={as_of // 86400}/batch={number}")
        days = self._folders("instants/day", first, max(as_of, last + window), 86400)
        known = spark.read.schema("as_of long, day long, batch int").option("basePath", f"{self.folder}/instants").parquet(days)
        reached = known.filter((F.col("as_of") >= first) & ((F.col("as_of") - window <= last) | (F.col("batch") == number)))
        for row in reached.orderBy("batch").collect():
            self._publish(spark, row.as_of, row.batch)

    def _folders(self, kind: str, since: int, until: int, seconds: int) -> str:
        """The folders of a stretch of time, however many there are beside them; some of them must exist."""
        return f"{self.folder}/{kind}={{{','.join(str(n) for n in range(since // seconds, until // seconds + 1))}}}"

    def _publish(self, spark: SparkSession, as_of: int, number: int) -> None:
        since = as_of - max(self.delay_window_s, self.blockade_window_s)
        reader = spark.read.schema(f"{LOG}, hour long, batch int").option("basePath", f"{self.folder}/log")
        log = reader.parquet(self._folders("log/hour", since, as_of, 3600)).filter(F.col("ts").between(since, as_of))
        parts = {kind: log.filter(F.col("kind") == kind) for kind in ("delta", "cancel", "passage")}
        lines = minute_snapshot(parts["delta"], parts["cancel"], parts["passage"], as_of=as_of, delay_window_s=self.delay_window_s,
                                blockade_window_s=self.blockade_window_s, **self.statics)
        lines.select(F.lit(as_of).cast("long").alias("as_of"), "section", "key", "json").write.mode("overwrite").parquet(f"{self.folder}/snapshots/batch={number}")


def publish_snapshots(observations: DataFrame, folder: str, statics: Mapping[str, DataFrame], **windows: int) -> StreamingQuery:
    """Start publishing; ``statics`` are segment_edges, closures, works, incidents and coverage of ``minute_snapshot``."""
    rows = observations.select(*[F.col(name).cast(kind).alias(name) for name, kind in (field.split() for field in LOG.split(", "))])
    writer = rows.writeStream.foreachBatch(Publisher(folder, statics, **windows))
    return writer.option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint").trigger(availableNow=True).start()


def published(spark, folder: str) -> DataFrame:
    return spark.read.schema("as_of long, section string, key string, json string, batch int").parquet(f"{folder.rstrip('/')}/snapshots").drop("batch")
