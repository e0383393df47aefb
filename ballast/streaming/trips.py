"""Trips as streams: neighbouring known stops, and the planned times of updates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ballast.streaming.changes import DELAY, gathered, in_bucket, plain, timed, use_state_store

#: A stop of a trip that no poll has named for this long is no neighbour any more.
STOP_UNSEEN_S = 4 * 3600
#: A plan slice serves updates for this long after it was fetched.
SLICE_TTL_S = 3 * 3600
STOP = ("label", "cluster", "delay_s", "event_ts", "service_date", "cancelled")
_STOP_TYPES = "label string, cluster string, delay_s int, event_ts long, service_date string, cancelled boolean"


class Neighbours(StatefulProcessor):
    """The known stops of a trip by index; each update gives its pairs with the nearest known stops before and after it.

    A stop counts while it was seen within ``unseen_s`` of the update, by the data's clock; a timer at the earliest end frees
    the stops that the watermark has left behind. The group is a bucket of trips: its state, a row a stop, is read and
    written once a batch.
    """

    def __init__(self, unseen_s: int | None, columns: Sequence[str]):
        self.unseen_s, self.columns = unseen_s, list(columns)

    def init(self, handle) -> None:
        self.handle = handle
        self.stops = handle.getListState("stops", f"head string, idx int, {_STOP_TYPES}, ts long")

    def trips(self) -> dict[str | None, dict[int, tuple]]:
        known: dict[str | None, dict[int, tuple]] = {}
        for head, idx, *stop in self.stops.get():
            known.setdefault(head, {})[idx] = tuple(stop)
        return known

    def keep(self, trips: dict[str | None, dict[int, tuple]], timerValues) -> None:
        """Remember what the watermark has left, and wake when the next of it ends."""
        rows = [(head, idx, *stop) for head, known in trips.items() for idx, stop in known.items()]
        if self.unseen_s is not None:
            now = timerValues.getCurrentWatermarkInMs() // 1000  # whatever comes is later
            rows = [row for row in rows if now - row[-1] <= self.unseen_s]
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if rows:
                self.handle.registerTimer((min(row[-1] for row in rows) + self.unseen_s + 1) * 1000)
        if rows:
            self.stops.put(rows)
        else:
            self.stops.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = gathered(rows, ["ts", "seq"])
        trips, out = self.trips(), []
        for seq, ts, head, idx, *stop in zip(*[plain(frame[c]) for c in ("seq", "ts", "head", "idx", *STOP)], strict=True):
            idx, ts = int(idx), int(ts)
            known = trips.setdefault(head, {})
            known[idx] = (*self.cleaned(stop), ts)
            near = [i for i in known if i != idx and (self.unseen_s is None or ts - known[i][-1] <= self.unseen_s)]
            before, after = max((i for i in near if i < idx), default=None), min((i for i in near if i > idx), default=None)
            for a, b in ((before, idx), (idx, after)):
                if a is not None and b is not None and known[a][1] != known[b][1]:
                    out.append((head, int(seq), ts, a, *known[a][:-1], b, *known[b][1:-1]))
        self.keep(trips, timerValues)
        yield pd.DataFrame(out, columns=self.columns)

    @staticmethod
    def cleaned(stop: Sequence) -> tuple:
        label, cluster, delay_s, event_ts, service_date, cancelled = stop
        return label, cluster, None if delay_s is None else int(delay_s), None if event_ts is None else int(event_ts), service_date, bool(cancelled)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.keep(self.trips(), timerValues)
        return iter([])

    def close(self) -> None:
        pass


PAIRS = ("head string, seq long, ts long, idx int, label string, cluster string, delay_s int, event_ts long, service_date string, cancelled boolean, "
         "next_idx int, next_cluster string, next_delay_s int, next_event_ts long, next_service_date string, next_cancelled boolean")  # fmt: skip


def stream_trip_neighbours(updates: DataFrame, unseen_s: int | None = STOP_UNSEEN_S, delay: str = DELAY) -> DataFrame:
    """Pairs of neighbouring known stops, given out whenever an update touches one of the two.

    updates: seq, ts, head (the trip), idx, label, cluster, delay_s, event_ts, service_date, cancelled. The pairs have the
    columns of ``sequences.neighbour_pairs`` and the update's seq and ts; ``sequences.pair_deltas`` turns them into deltas.
    """
    use_state_store(updates.sparkSession)
    schema = StructType.fromDDL(PAIRS)
    rows = updates.select("seq", F.col("ts").cast("long").alias("ts"), "head", F.col("idx").cast("int").alias("idx"), *STOP)
    rows = rows.withColumn("bucket", in_bucket(["head"]))
    rows = rows if unseen_s is None else timed(rows, delay)
    mode = "None" if unseen_s is None else "EventTime"
    return rows.groupBy("bucket").transformWithStateInPandas(Neighbours(unseen_s, schema.fieldNames()), schema, "Append", mode)


def stream_planned(updates: DataFrame, slices: DataFrame, ttl_s: int = SLICE_TTL_S, delay: str = DELAY) -> DataFrame:
    """Updates with the times of their planned call, from every slice of the station that was fetched in the ``ttl_s`` before them.

    A join of two streams whose rows wait for each other for as long as a slice serves, so neither side's state grows beyond that.
    updates: seq, ts, station, stop_id and more; slices: slice_seq, station, ts (when fetched), stop_id, pt_arr, pt_dep. A slice fetched
    again gives a row of its own; ``latest_slice`` keeps the last. An update without a slice comes out once none can come any more.
    """
    ours = timed(updates, delay).alias("u")
    plan = slices.select("slice_seq", "station", "stop_id", "pt_arr", "pt_dep", F.col("ts").alias("slice_ts"), F.timestamp_seconds("ts").alias("slice_at"))
    theirs = plan.withWatermark("slice_at", delay).alias("p")
    same = (F.col("u.station") == F.col("p.station")) & (F.col("u.stop_id") == F.col("p.stop_id"))
    served = (F.col("p.slice_at") <= F.col("u.at")) & (F.col("p.slice_at") >= F.col("u.at") - F.make_interval(secs=F.lit(ttl_s)))
    joined = ours.join(theirs, same & served, "left_outer")
    return joined.select(*[F.col(f"u.{c}") for c in updates.columns], "p.slice_seq", "p.slice_ts", "p.pt_arr", "p.pt_dep")


def latest_slice(planned: DataFrame, key: str = "seq") -> DataFrame:
    """Of the slices that served an update the last one fetched (of equal times the greater number); one row per update."""
    rest = [c for c in planned.columns if c not in (key, "slice_seq", "slice_ts", "pt_arr", "pt_dep")]
    order: Column = F.struct("slice_ts", "slice_seq")
    last = planned.groupBy(key, *rest).agg(F.max_by(F.struct("slice_seq", "slice_ts", "pt_arr", "pt_dep"), order).alias("p"))
    return last.select(key, *rest, "p.*")
