"""What a batch costs in calls to the state store: they follow the state groups, not the keys."""

import pandas as pd
from pyspark.sql.types import StringType, StructField, StructType

from ballast.streaming.changes import Changes, drained, latest_panes, stream_edge_panes
from ballast.streaming.trips import Neighbours, PAIRS


class Handle:
    """A group's state in memory, which counts the calls."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], [], 0

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = list(rows)

    def clear(self):
        self.calls += 1
        self.rows = []

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class At:
    def __init__(self, second):
        self.second = second

    def getCurrentWatermarkInMs(self):
        return self.second * 1000


def test_keys_share_the_calls_of_their_group():
    keys = StructType([StructField("trip_id", StringType())])
    log, handle = Changes(keys, "delta_s", ["ts", "seq"], ["seq"], 100, False), Handle()
    log.init(handle)
    seqs = lambda frame, now: [s for f in log.handleInputRows((1,), iter([frame]), At(now)) for s in f["seq"].tolist()]
    many = pd.DataFrame({"trip_id": [None, *[f"t{i}" for i in range(1, 500)]], "seq": range(500), "ts": 1000, "delta_s": 5})
    assert seqs(many, 0) == list(range(500)) and handle.calls < 10 and len(handle.rows) == 500
    assert seqs(many.assign(ts=1050, delta_s=[6, *[5] * 499]), 0) == [0] and handle.calls < 20
    assert seqs(many.head(1).assign(ts=1150, delta_s=6), 1100) == []  # a hundred seconds ago: still known, a null key too
    log.handleExpiredTimer((1,), At(1151), None)
    assert [row[0] for row in handle.rows] == [None] and handle.timers == [1251 * 1000]
    log.handleExpiredTimer((1,), At(1251), None)
    assert handle.rows == [] and handle.timers == []


def test_trips_share_the_calls_of_their_group():
    stops, handle = Neighbours(100, [f.split()[0] for f in PAIRS.split(", ")]), Handle()
    stops.init(handle)
    rows = [(i, 1000, f"t{i % 300}", i // 300, "L", f"c{i // 300}", None if i % 7 else 3, None, "20240101", False) for i in range(600)]
    frame = pd.DataFrame(rows, columns=["seq", "ts", "head", "idx", "label", "cluster", "delay_s", "event_ts", "service_date", "cancelled"])
    (pairs,) = stops.handleInputRows((1,), iter([frame]), At(0))
    assert pairs["head"].tolist() == [f"t{i}" for i in range(300)] and handle.calls < 10 and len(handle.rows) == 600
    stops.handleExpiredTimer((1,), At(1101), None)
    assert handle.rows == [] and handle.timers == []


def test_open_panes_are_given_out_too(spark, tmp_path):
    rows = [(1000, "s", 5), (1001, "s", 5), (5000, "s", 7)]
    edges = spark.createDataFrame([("s", "E1")], "segment string, edge string")
    spark.createDataFrame(rows[:1], "ts long, segment string, delta_s int").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    spark.createDataFrame(rows[1:], "ts long, segment string, delta_s int").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    stream = spark.readStream.schema("ts long, segment string, delta_s int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    panes = latest_panes(drained(stream_edge_panes(stream, edges), "update")).collect()
    assert sorted((r.pane_end, r.edge, r.delta_s, r.n) for r in panes) == [(1020, "E1", 5, 2), (5040, "E1", 7, 1)]


def test_edge_windows_reach_the_last_observation():
    from ballast.registry import ORACLES, load_all

    load_all()
    assert "as_of<" not in ORACLES["str_06_edge_windows"]
