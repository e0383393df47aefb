"""Observation logs and blockades as streams, with state that expires and can be carried over."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from ballast.operators.joins import to_edges
from ballast.session import checkpoint_root

SEGMENT_KEY = ("country", "trip_id", "segment")
STOP_KEY = ("country", "trip_id", "service_date", "cluster")
CANCEL_KEY = ("country", "trip_id", "service_date", "segment")
#: A segment key unseen for this long counts as new; keys of a service day end so long after the day.
SEGMENT_UNSEEN_S, DAY_SLACK_S = 3 * 3600, 4 * 3600
#: How far the watermark stays behind the latest row.
DELAY = "10 minutes"
WINDOW_S, MIN_TRIPS = 5400, 2
#: State groups of the keyed logs: a key costs a row of its group's state, not calls to the state store of its own.
BUCKETS = 1024


def use_state_store(spark: SparkSession) -> None:
    """Keyed state of any size lives in RocksDB, on the executors' disks and in the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def timed(stream: DataFrame, delay: str) -> DataFrame:
    """The rows with their time as ``at``, on which the watermark follows ``delay`` behind."""
    return stream.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", delay)


def end_of_day(service_date: str = "service_date", slack_s: int = DAY_SLACK_S) -> Column:
    """When the feeds have no more to say of a service day: ``slack_s`` after it ends. NULL where the date is none."""
    day = F.try_to_timestamp(F.col(service_date), F.lit("yyyyMMdd"))
    return F.when(F.length(service_date) == 8, F.unix_timestamp(day) + 86400 + slack_s)


def gathered(rows: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    """A group's rows of a batch in order."""
    frames = list(rows)
    frame = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
    return frame if len(frame) == 1 else frame.sort_values(list(order), kind="stable")


def plain(column: pd.Series) -> list:
    """Values as Python's own, nulls as None."""
    return column.astype(object).where(column.notna(), None).tolist()


def in_bucket(keys: Sequence[str]) -> Column:
    """The state group of a key."""
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


class Changes(StatefulProcessor):
    """Lets a key's row through when its value is not the one seen last; rows of a batch go in order of ``order``.

    A key unseen for more than ``unseen_s`` of the data's own time counts as new. Of a key with an end (``until_ts``), rows
    from then on pass as they are. Both follow from the rows alone; the timers only free what can no longer matter, once
    the watermark has passed. The group is a bucket of keys: its state, a row a key, is read and written once a batch.
    """

    def __init__(self, keys: StructType, value: str, order: Sequence[str], columns: Sequence[str], unseen_s: int | None, ends: bool):
        self.state = StructType([*keys.fields, *[StructField(name, LongType()) for name in ("last_value", "last_ts", "until_ts")]])
        self.keys = keys.fieldNames()
        self.value, self.order, self.columns, self.unseen_s, self.ends = value, list(order), list(columns), unseen_s, ends
        self.ageing = ends or unseen_s is not None

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", self.state)

    def known(self) -> dict[tuple, tuple]:
        """Per key the last value, when it was seen, and the key's end."""
        return {row[:-3]: row[-3:] for row in map(tuple, self.last.get())}

    def mark(self, seen: tuple) -> int | None:
        """When a key can be forgotten."""
        _, ts, until = seen
        marks = [t for t in (until, None if self.unseen_s is None else ts + self.unseen_s + 1) if t is not None]
        return min(marks, default=None)

    def keep(self, known: dict[tuple, tuple], watermark_ms: int) -> None:
        """Remember what the watermark has left, and wake when the next of it can be forgotten."""
        if self.ageing:
            marks = {key: self.mark(seen) for key, seen in known.items()}
            known = {key: seen for key, seen in known.items() if marks[key] is None or marks[key] * 1000 > watermark_ms}
            wake = min((marks[key] for key in known if marks[key] is not None), default=None)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if wake is not None:
                self.handle.registerTimer(wake * 1000)
        if known:
            self.last.put([(*key, *seen) for key, seen in known.items()])
        else:
            self.last.clear()

    def watermark(self, timerValues) -> int:
        return timerValues.getCurrentWatermarkInMs() if self.ageing else 0

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = gathered(rows, self.order)
        known, changed = self.known(), []
        ends = plain(frame["until_ts"]) if self.ends else [None] * len(frame)
        for one, now, ts, until in zip(zip(*[plain(frame[k]) for k in self.keys], strict=True), plain(frame[self.value]), plain(frame["ts"]), ends, strict=True):
            value, ts, until = int(now), int(ts), None if until is None else int(until)
            over = until is not None and ts >= until
            seen = known.get(one)
            changed.append(over or seen is None or value != seen[0] or (self.unseen_s is not None and ts - seen[1] > self.unseen_s))
            if not over:
                known[one] = (value, ts, until)
        self.keep(known, self.watermark(timerValues))
        yield frame.loc[changed, self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.keep(self.known(), self.watermark(timerValues))
        return iter([])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        known = self.known()
        ends = plain(initialState["until_ts"]) if self.ends else [None] * len(initialState)
        for one, value, ts, until in zip(zip(*[plain(initialState[k]) for k in self.keys], strict=True), plain(initialState[self.value]), plain(initialState["ts"]), ends, strict=True):
            known[one] = (int(value), int(ts), None if until is None else int(until))
        self.keep(known, self.watermark(timerValues))

    def close(self) -> None:
        pass


def stream_changes(obs: DataFrame, keys: Sequence[str], value: str, unseen_s: int | None = None, known: DataFrame | None = None,
                   until: Column | None = None, delay: str = DELAY) -> DataFrame:
    """Rows of a stream (seq, ts, keys, value) whose value differs from the key's last.

    ``known`` (keys, value and, for keys that can be forgotten, ts) starts the state from the log, so that a first run after a move or
    an upgrade repeats nothing. State ends by the data's clock: ``unseen_s`` after a key was seen last, or at ``until``
    (seconds, a function of the key), each once the watermark, ``delay`` behind the latest row, is past it.
    """
    use_state_store(obs.sparkSession)
    schema = StructType([f for f in obs.schema.fields if f.name in {*keys, "seq", "ts", value}])
    ends, ageing = until is not None, until is not None or unseen_s is not None
    start = None
    if known is not None:
        seen = F.col("ts").cast("long") if "ts" in known.columns else F.lit(0).cast("long")
        start = known.select(in_bucket(keys).alias("bucket"), *keys, F.col(value).cast("long").alias(value), seen.alias("ts"),
                             *([until.cast("long").alias("until_ts")] if ends else [])).groupBy("bucket")
    rows = obs.withColumn("bucket", in_bucket(keys))
    rows = rows.withColumn("until_ts", until.cast("long")) if ends else rows
    rows = timed(rows, delay) if ageing else rows
    key_fields = StructType([StructField(k, schema[k].dataType) for k in keys])
    processor = Changes(key_fields, value, ["ts", "seq"], schema.fieldNames(), unseen_s, ends)
    return rows.groupBy("bucket").transformWithStateInPandas(processor, schema, "Append", "EventTime" if ageing else "None", initialState=start)


def stream_seg_changes(obs: DataFrame, unseen_s: int | None = SEGMENT_UNSEEN_S, known: DataFrame | None = None, delay: str = DELAY) -> DataFrame:
    """Segment keys are forgotten when no poll has named them for three hours."""
    return stream_changes(obs, SEGMENT_KEY, "delta_s", unseen_s, known, delay=delay)


def stream_stop_changes(obs: DataFrame, by_day: bool = True, known: DataFrame | None = None, delay: str = DELAY) -> DataFrame:
    """Stop keys end with their service day."""
    return stream_changes(obs, STOP_KEY, "delay_s", None, known, end_of_day() if by_day else None, delay)


def stream_first_cancels(cancels: DataFrame, by_day: bool = True, delay: str = DELAY) -> DataFrame:
    """One row per cancelled train and segment; a key ends with its service day, without ``by_day`` never."""
    if not by_day:
        return cancels.select(*CANCEL_KEY).dropDuplicates(list(CANCEL_KEY))
    rows = cancels.select("seq", "ts", *CANCEL_KEY, F.lit(0).alias("seen"))
    return stream_changes(rows, CANCEL_KEY, "seen", None, None, end_of_day(), delay).select(*CANCEL_KEY)


class Blockade(StatefulProcessor):
    """Per segment the last cancellation of each trip since the last passage; a row when the segment's state changes.

    A cancellation counts for ``window_s`` and unless a passage follows it, one at the same instant included. What the
    window takes away is reported with the instant at which it does, as soon as a later row or the watermark tells that it has come.
    """

    def __init__(self, window_s: int, min_trips: int):
        self.window_s, self.min_trips = window_s, min_trips

    def init(self, handle) -> None:
        self.handle = handle
        self.trips = handle.getMapState("trips", "trip_id string", "ts long")
        self.passed = handle.getValueState("passed", "ts long")

    def end(self, trips: dict[str, int]) -> int | None:
        """When the window will have left too few of the trips; None where they are too few already."""
        standing = sorted(trips.values(), reverse=True)
        return standing[self.min_trips - 1] + self.window_s + 1 if len(standing) >= self.min_trips else None

    def standing(self, trips: dict[str, int], now: int) -> dict[str, int]:
        return {t: at for t, at in trips.items() if now - at <= self.window_s}

    def save(self, trips: dict[str, int], passed: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.trips.clear()
        for trip, at in trips.items():
            self.trips.updateValue((trip,), (at,))
        if passed is not None:
            self.passed.update((passed,))
        else:
            self.passed.clear()
        marks = [at + self.window_s + 1 for at in trips.values()] + ([passed + self.window_s + 1] if passed is not None else [])
        if marks:
            self.handle.registerTimer(min(marks) * 1000)

    def rows(self, key, out: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *row) for row in out], columns=["segment", "ts", "blocked", "n_trips"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = gathered(rows, ["ts", "kind"])  # at one instant a cancel comes before a passage
        passed = self.passed.get()[0] if self.passed.exists() else None
        trips = {k[0]: v[0] for k, v in self.trips.iterator()}
        out: list[tuple] = []
        for ts, group in frame.groupby("ts", sort=True):
            end = self.end(trips)
            if end is not None and end < ts:
                out.append((end, False, len(self.standing(trips, end))))
                end = None
            trips = self.standing(trips, int(ts))
            for kind, trip in zip(group["kind"], group["trip_id"], strict=True):
                if kind == "passage":
                    passed, trips = max(int(ts), passed or 0), {}
                elif passed is None or ts > passed:
                    trips[trip] = max(int(ts), trips.get(trip, 0))
            blocked = len(trips) >= self.min_trips
            if blocked != (end is not None):
                out.append((int(ts), blocked, len(trips)))
        self.save(trips, passed)
        yield self.rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000  # whatever comes is later
        passed = self.passed.get()[0] if self.passed.exists() else None
        trips = {k[0]: v[0] for k, v in self.trips.iterator()}
        end = self.end(trips)
        out = [] if end is None or end > now else [(end, False, len(self.standing(trips, end)))]
        trips = self.standing(trips, now)
        self.save(trips, None if passed is not None and now - passed > self.window_s else passed)
        yield self.rows(key, out)

    def close(self) -> None:
        pass


def stream_blockades(cancels: DataFrame, passages: DataFrame, window_s: int = WINDOW_S, min_trips: int = MIN_TRIPS, delay: str = DELAY) -> DataFrame:
    """When a segment becomes blocked or free: segment, ts, blocked, n_trips. Nothing is kept beyond the window."""
    use_state_store(cancels.sparkSession)
    one = cancels.select("segment", "ts", F.lit("cancel").alias("kind"), "trip_id")
    two = passages.select("segment", "ts", F.lit("passage").alias("kind"), F.lit("").alias("trip_id"))
    schema = "segment string, ts long, blocked boolean, n_trips long"
    # One clock for both: a quiet side must not hold the other's watermark back.
    rows = timed(one.unionByName(two), delay)
    return rows.groupBy("segment").transformWithStateInPandas(Blockade(window_s, min_trips), schema, "Append", "EventTime")


def stream_edge_panes(seg_obs: DataFrame, segment_edges: DataFrame, pane: str = "1 minute", delay: str = DELAY) -> DataFrame:
    """Observations per pane, edge and value: each observation is counted once.

    Appended, a pane comes once the watermark has passed it; in update mode with every batch that adds to it (``latest_panes``).
    """
    placed = to_edges(timed(seg_obs.select("ts", "segment", "delta_s"), delay), segment_edges)
    counted = placed.groupBy(F.window("at", pane).alias("w"), "edge", "delta_s").agg(F.count("*").alias("n"))
    return counted.select(F.unix_timestamp("w.end").alias("pane_end"), "edge", "delta_s", "n")


def latest_panes(panes: DataFrame) -> DataFrame:
    """Of panes given out as they grew, open ones included, the last count of each."""
    return panes.groupBy("pane_end", "edge", "delta_s").agg(F.max("n").alias("n"))


def edge_windows(panes: DataFrame, panes_each: int = 30, pane_s: int = 60) -> DataFrame:
    """Counts per window end, edge and value from logged panes: as_of, edge, delta_s, n. A window is ``panes_each`` panes long."""
    ends = F.expr(f"explode(sequence(pane_end, pane_end + {(panes_each - 1) * pane_s}, {pane_s}L))")
    return panes.select(ends.alias("as_of"), "edge", "delta_s", "n").groupBy("as_of", "edge", "delta_s").agg(F.sum("n").alias("n"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, by way of the shared folder, where its checkpoint lies too.

    In update mode the rows of every batch, in complete mode those of the last.
    """
    spark = stream.sparkSession
    folder = f"{checkpoint_root(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/rows").start()
    else:
        place = f"{folder}/rows/batch={{}}" if mode == "update" else f"{folder}/rows"
        query = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(place.format(number))).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns)
