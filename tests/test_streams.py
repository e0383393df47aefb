"""Streams over several batches: restarts, state that ends by the data's clock, and batches that run again."""

from collections import defaultdict


from ballast.streaming import changes as C
from ballast.streaming.snapshots import LOG, Publisher, publish_snapshots, published
from ballast.streaming.trips import latest_slice, stream_planned, stream_trip_neighbours

SEG = "seq long, ts long, country string, segment string, trip_id string, delta_s int"
UPDATE = "seq long, ts long, head string, idx int, label string, cluster string, delay_s int, event_ts long, service_date string, cancelled boolean"


class Landing:
    """A folder into which batches land one by one, and a stream that takes up where it stopped."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.number = spark, str(folder), schema, 0
        self.progress = []

    def land(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/in/{self.number}")
        self.number += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in/*")

    def run(self, made):
        """Run what a function of the stream gives until all that landed is through; the rows so far."""
        query = made(self.stream()).writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").format("parquet").option("path", f"{self.folder}/rows").trigger(availableNow=True).start()
        query.awaitTermination()
        self.progress += [p for p in query.recentProgress if p.stateOperators]
        return self.spark.read.parquet(f"{self.folder}/rows").collect()

    def state_rows(self):
        return self.progress[-1].stateOperators[0].numRowsTotal


def test_unseen_keys_are_new_and_leave_the_state(spark, tmp_path):
    land = Landing(spark, tmp_path, SEG)
    made = lambda s: C.stream_seg_changes(s, 100, delay="0 seconds")
    land.land([(1, 1000, "nl", "a", "t", 5), (2, 1000, "nl", "b", "t", 5)])
    land.land([(3, 1050, "nl", "a", "t", 5), (4, 1100, "nl", "b", "t", 6)])
    assert sorted(r.seq for r in land.run(made)) == [1, 2, 4]
    before = land.state_rows()
    land.land([(5, 1150, "nl", "a", "t", 5)])  # seen a hundred seconds ago: still known
    land.land([(6, 1260, "nl", "a", "t", 5), (7, 1260, "nl", "b", "t", 6)])  # 110 and 160 seconds ago: both are new
    assert sorted(r.seq for r in land.run(made)) == [1, 2, 4, 6, 7]
    land.land([(8, 9000, "nl", "c", "t", 1)])
    land.run(made)
    land.land([(9, 9001, "nl", "c", "t", 1)])
    assert sorted(r.seq for r in land.run(made)) == [1, 2, 4, 6, 7, 8]
    assert land.state_rows() < before


def test_day_keys_end_with_their_day(spark, tmp_path):
    day = 1704067200  # 2024-01-01
    land = Landing(spark, tmp_path, "seq long, ts long, country string, trip_id string, service_date string, cluster string, delay_s int")
    made = lambda s: C.stream_stop_changes(s, delay="0 seconds")
    row = lambda seq, ts, date="20240101", c="a": (seq, ts, "nl", "t", date, c, 5)
    land.land([row(1, day + 100), row(2, day + 100, c="b"), row(3, day + 100, "")])
    land.land([row(4, day + 200), row(5, day + 30 * 3600), row(6, day + 30 * 3600, "")])
    assert sorted(r.seq for r in land.run(made)) == [1, 2, 3, 5]  # from four hours after the day each row passes; no day, no end
    assert max(p.stateOperators[0].numRowsTotal for p in land.progress) >= 3
    assert land.state_rows() == 1  # the key without a day
    land.land([row(7, day + 31 * 3600, "20240102")])
    assert sorted(r.seq for r in land.run(made)) == [1, 2, 3, 5, 7]


def test_blockades_end_with_the_watermark(spark, tmp_path):
    land = Landing(spark, tmp_path, "segment string, trip_id string, ts long, kind string")

    def made(s):
        return C.stream_blockades(s.filter("kind='cancel'"), s.filter("kind='passage'"), 100, 2, delay="0 seconds")

    land.land([("s", "a", 1000, "cancel"), ("s", "b", 1010, "cancel"), ("s", "b", 1020, "cancel"), ("s", "x", 1000, "passage")])
    land.run(made)
    land.land([("s", "c", 1030, "cancel"), ("u", "p", 1040, "passage")])
    assert [(r.ts, r.blocked, r.n_trips) for r in land.run(made)] == [(1030, True, 2)]
    land.land([("v", "z", 2000, "passage")])
    assert sorted((r.ts, r.blocked, r.n_trips) for r in land.run(made)) == [(1030, True, 2), (1121, False, 1)]
    land.land([("v", "z", 3000, "passage")])
    land.run(made)
    land.land([("w", "z", 3001, "passage")])
    land.run(made)
    assert land.state_rows() <= 6  # the two last segments and their timers


def plain_neighbours(rows, unseen):
    state, out = defaultdict(dict), []
    for seq, ts, head, idx, _, cluster, *_ in rows:
        known = state[head]
        known[idx] = (ts, cluster)
        near = [i for i, (seen, _) in known.items() if i != idx and ts - seen <= unseen]
        for a, b in ((max((i for i in near if i < idx), default=None), idx), (idx, min((i for i in near if i > idx), default=None))):
            if a is not None and b is not None and known[a][1] != known[b][1]:
                out.append((seq, a, b, known[a][1], known[b][1]))
    return sorted(out)


def test_neighbours_at_every_prefix_and_after_a_restart(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = []
    for seq in range(60):
        idx = rng.randrange(6)
        rows.append((seq, 1000 + 20 * seq, rng.choice("tu"), idx, "L", f"c{idx % 4}", None if rng.random() < 0.2 else seq, None, "20240101", rng.random() < 0.3))
    land = Landing(spark, tmp_path, UPDATE)
    for upto in (20, 40, 60):
        land.land(rows[upto - 20 : upto])
        got = land.run(lambda s: stream_trip_neighbours(s, 150, delay="0 seconds"))
        assert sorted((r.seq, r.idx, r.next_idx, r.cluster, r.next_cluster) for r in got) == plain_neighbours(rows[:upto], 150)
    assert any(r.delay_s is None for r in got) and any(r.cancelled for r in got)
    most = max(p.stateOperators[0].numRowsTotal for p in land.progress)
    for ts in (9000, 9001):
        land.land([(100 + ts, ts, "v", 0, "L", "c0", 1, None, "", False)])
        land.run(lambda s: stream_trip_neighbours(s, 150, delay="0 seconds"))
    assert land.state_rows() < most


def test_slices_late_replaced_and_missing(spark, tmp_path):
    u = Landing(spark, tmp_path / "u", "seq long, ts long, station string, stop_id string")
    p = Landing(spark, tmp_path / "p", "slice_seq long, ts long, station string, stop_id string, pt_arr long, pt_dep long")
    u.land([(1, 1000, "e", "e-1"), (2, 1000, "e", "e-2"), (3, 1000, "f", "f-1")])
    p.land([(10, 900, "e", "e-1", 5, 6), (11, 950, "e", "e-1", 7, 8), (12, 100, "f", "f-1", 1, 1), (13, 1001, "e", "e-1", 9, 9)])

    def made(stream):
        return stream_planned(stream, p.stream(), 500, delay="1 minute")

    u.run(made)
    p.land([(14, 980, "e", "e-2", 3, None)])  # late, within the watermark
    u.run(made)
    u.land([(4, 5000, "g", "g-1")])
    p.land([(15, 5000, "g", "g-2", 1, 1)])
    u.run(made)
    u.land([(5, 5100, "g", "g-1")])
    p.land([(16, 5100, "g", "g-2", 1, 1)])
    u.run(made)
    got = {r.seq: r.slice_seq for r in latest_slice(spark.read.parquet(f"{tmp_path}/u/rows")).collect()}
    assert {k: got[k] for k in (1, 2, 3)} == {1: 11, 2: 14, 3: None}


def test_snapshot_batches_that_run_again_add_nothing(spark, tmp_path):
    rows = [("delta", 1, 1000, "a|b", "t", 90), ("delta", 2, 1010, "a|b", "u", 700), ("cancel", 3, 1000, "a|b", "t", None), ("cancel", 4, 1001, "a|b", "u", None)]
    later = [("passage", 5, 1100, "a|b", None, None), ("delta", 6, 1110, "a|b", "u", 30)]
    land = Landing(spark, tmp_path, LOG)
    land.land(rows)
    edges = spark.createDataFrame([("a|b", "E1"), ("a|b", "E2")], "segment string, edge string")
    statics = {
        "segment_edges": edges, "closures": spark.createDataFrame([], "d string, edge string, hour_start int, hour_end int"),
        "works": spark.createDataFrame([("g", "s", "closed", None, "x", "E2")], "group_seq string, src string, sev string, until string, txt string, edge string"),
        "incidents": spark.createDataFrame([], "country string, alert_pos int, cause string, effect string, txt string, lat double, lon double, cluster string"),
        "coverage": spark.createDataFrame([("nl", "on", 3)], "country string, status string, age_s int"),
    }
    out = f"{tmp_path}/out"
    publish_snapshots(land.stream(), out, statics).awaitTermination()
    land.land(later)
    publish_snapshots(land.stream(), out, statics).awaitTermination()
    lines = lambda: sorted((r.as_of, r.section, r.key, r.json) for r in published(spark, out).collect())
    first = lines()
    assert {(a, s, k) for a, s, k, _ in first} == {(t, s, k) for t in (1020, 1140) for s, k in (("coverage", "nl"), ("seg", "E1"), ("seg", "E2"), ("wrk", "g:E2"))} | {(1020, "blk", "E1"), (1020, "blk", "E2")}
    Publisher(out, statics)(spark.createDataFrame(rows, LOG), 0)  # the first batch again, after the second
    assert lines() == first
    assert spark.read.parquet(f"{out}/log").count() == 6 and dict((k, j) for a, s, k, j in first if s == "seg" and a == 1020)["E1"] == '["E1",3,700,2]'
