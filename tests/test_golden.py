"""Hand-computed results on small inputs."""

import pytest
from pyspark.sql import functions as F

from ballast.functions import text as X
from ballast.functions.geo import colour_class
from ballast.operators import aggregates as A
from ballast.operators import duplicates as D
from ballast.operators import graphs as R
from ballast.operators import joins as J
from ballast.operators import sequences as S
from ballast.operators.blockades import blocked_segments


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def refinement(spark, *parts):
    return spark.createDataFrame(list(parts), "coarse string, fine string, fraction double, ord int")


def test_hops_bridge_unknown_stops(spark):
    times = spark.createDataFrame([("T", i + 1, f"s{i + 1}", 60 * i) for i in range(5)], "trip_id string, stop_sequence int, stop_id string, dep_s int")
    cl = spark.createDataFrame([("s1", "c1"), ("s2", "c1"), ("s4", "c2"), ("s5", "c3")], "stop_id string, cluster_id string")
    assert rows(S.hops(times, cl), "a", "b") == [("c1", "c2"), ("c2", "c3")]


def test_neighbours_cross_chunks(spark):
    from ballast.operators.sequence_tools import beside, running_total

    df = spark.createDataFrame([("k", i) for i in range(50)], "key string, seq int")
    chunk = F.floor(F.col("seq") / 7).cast("bigint")
    assert rows(beside(df, ["key"], ["seq"], ["seq"], chunk), "seq", "next_seq")[:-1] == [(i, i + 1) for i in range(49)]
    assert rows(beside(df, ["key"], ["seq"], ["seq"], chunk, forward=False).filter("seq>0"), "seq", "prev_seq") == [(i, i - 1) for i in range(1, 50)]
    assert rows(running_total(df, ["key"], ["seq"], F.col("seq"), chunk, "s"), "seq", "s") == [(i, i * (i + 1) // 2) for i in range(50)]


UPDATE = "country string, poll_ts long, trip_id string, service_date string, stu_pos int, cluster string, stop_rel string, delay_s int, event_ts long"


def test_delta_spreads_over_refinement(spark):
    ref = refinement(spark, ("c1|c3", "c1|c2", 0.4, 0), ("c1|c3", "c2|c3", 0.6, 1))
    up = spark.createDataFrame([("x", 0, "t", "d", 0, "c1", "SCHEDULED", 0, None), ("x", 0, "t", "d", 1, "c2", "SKIPPED", None, None),
                                ("x", 0, "t", "d", 2, "c3", "SCHEDULED", 125, 11)], UPDATE)
    deltas = S.segment_deltas(up, ref)
    assert rows(deltas, "fine", "delta_s") == [("c1|c2", 50), ("c2|c3", 75)]
    assert S.realised_passages(deltas, 10).count() == 0 and S.realised_passages(deltas, 11).count() == 2


def test_skipped_stretch(spark):
    cells = [("c1", "SKIPPED"), (None, "SKIPPED"), ("c2", "SKIPPED"), ("c3", "SCHEDULED"), ("c4", "SKIPPED")]
    up = spark.createDataFrame([("x", 0, "t", "d", i, c, r, None, None) for i, (c, r) in enumerate(cells)], UPDATE)
    assert rows(S.skipped_stretches(up, refinement(spark, ("q", "q", 1.0, 0))), "segment") == [("c1|c2",)]


def test_changes_only(spark):
    obs = spark.createDataFrame([("k", i, i, v) for i, v in enumerate([60, 60, 0, 60])], "k string, ts long, seq long, v int")
    assert [r[0] for r in S.changes_only(obs, ["k"], "v", ["ts", "seq"]).orderBy("seq").select("v").collect()] == [60, 0, 60]


def test_blockade(spark):
    cancels = spark.createDataFrame([("s", "tA", 200), ("s", "tB", 200), ("r", "tA", 0), ("r", "tA", 5)], "segment string, trip_id string, ts long")
    none = spark.createDataFrame([], "segment string, ts long")
    at = lambda n, p=none: rows(blocked_segments(cancels, p, n), "segment")
    assert at(200) == [("s",)] and at(5600) == [("s",)] and at(5601) == []
    assert at(200, spark.createDataFrame([("s", 200)], "segment string, ts long")) == []


def test_p90_and_colour(spark):
    edges = spark.createDataFrame([("a|b", "E")], "segment string, edge string")

    def p90(values):
        obs = spark.createDataFrame([(i, 100, "a|b", f"t{i}", v) for i, v in enumerate(values)], "seq long, ts long, segment string, trip_id string, delta_s int")
        return A.edge_delay_window(obs, edges, 100).collect()[0]["p90"]

    assert p90([300] * 6 + [0] * 4) == 300 and p90(range(1, 11)) == 10 and p90([7]) == 7
    values = spark.createDataFrame([(59,), (60,), (120,), (121,), (600,), (601,)], "v int")
    assert [r[0] for r in values.select(colour_class(F.col("v"))).collect()] == [0, 1, 1, 2, 2, 3]


def test_text_keys(spark):
    df = spark.createDataFrame([("Liège-Guillemins",), ("Köln  Hbf",), ("Straße",), ("Gare de Lyon",), ("Frankfurt(Main)Hbf",)], "n string")
    out = df.select("n", X.normalize_name(F.col("n")), X.norm_station(F.col("n")), X.norm_compact(F.col("n"))).collect()
    assert [r[1] for r in out[:3]] == ["liege guillemins", "koln hbf", "strasse"]
    assert out[3][2] == "lyon" and out[4][3] == "frankfurtmainhbf"
    codes = spark.createDataFrame([("S:8400058", None), ("87686006", None), ("184000581", None), (None, "8814001")], "a string, b string")
    assert [r[0] for r in codes.select(X.uic_code(F.col("a"), F.col("b"))).collect()] == ["8400058", "8768600", None, "8814001"]


def test_refinement_of_a_line(spark):
    seg = spark.createDataFrame([(a, b, f"{a}|{b}") for a, b in ("AB", "BC", "CD", "AC", "AD")], "a string, b string, segment string")
    at = spark.createDataFrame([(c, 50 + i * 0.09, 5.0) for i, c in enumerate("ABCD")], "cluster_id string, lat double, lon double")
    paths = R.refinement_paths(seg, at)
    leaves = R.expand_leaves(paths, R.segment_lengths(seg, at))
    got = [(c, f, round(x, 3), o) for c, f, x, o in rows(leaves, "coarse", "fine", "fraction", "ord")]
    assert [g for g in got if g[0] == "A|D"] == [("A|D", "A|B", 0.333, 0), ("A|D", "B|C", 0.333, 1), ("A|D", "C|D", 0.333, 2)]
    assert [g for g in got if g[0] == "A|C"] == [("A|C", "A|B", 0.5, 0), ("A|C", "B|C", 0.5, 1)]


def test_dissolve(spark):
    paths = spark.createDataFrame([("s1", i, n) for i, n in enumerate([1, 2, 3, 4])] + [("s2", i, n) for i, n in enumerate([2, 3, 4, 5])],
                                  "segment string, pos int, node_id long")
    out = R.dissolve(paths)
    assert rows(out["geometry"], "edge", "pos", "node_id") == [("E1-2", 0, 1), ("E1-2", 1, 2), ("E2-4", 0, 2), ("E2-4", 1, 3), ("E2-4", 2, 4), ("E4-5", 0, 4), ("E4-5", 1, 5)]
    assert rows(out["coverage"], "edge", "segment") == [("E1-2", "s1"), ("E2-4", "s1"), ("E2-4", "s2"), ("E4-5", "s2")]


def test_duplicates_by_brute_force(spark):
    import random

    rng = random.Random(3)
    events = [(f"t{i}", f"f{i % 3}", f"c{rng.randrange(4)}", rng.randrange(0, 4000)) for i in range(40) for _ in range(rng.randrange(1, 5))]
    want, n = set(), {}
    for e in events:
        n[e[0]] = n.get(e[0], 0) + 1
    for a in n:
        for b in n:
            shared = sum(1 for x in events for y in events if x[0] == a and y[0] == b and x[1] < y[1] and x[2] == y[2] and abs(x[3] - y[3]) <= 120)
            if shared and min(n[a], n[b]) >= 2 and shared >= 0.8 * min(n[a], n[b]):
                want.add((a, b, shared))
    df = spark.createDataFrame(events, "trip_id string, feed string, cluster_id string, dep_s int")
    assert set(rows(D.duplicate_trips(df), "trip_a", "trip_b", "shared")) == want
    trips = spark.createDataFrame([(t, "v") for t in n], "trip_id string, service_id string")
    days = spark.createDataFrame([("v", "20240101")], "service_id string, d string")
    assert D.duplicate_trips_by_day(df, trips, days).count() == len(want)


@pytest.mark.parametrize("share", [0.8, 0.5])
def test_duplicates_of_long_trips(spark, share):
    """Trips of up to fourteen calls and copies of them, moved, thinned out, with calls in between and back at one place."""
    import random

    rng = random.Random(5)
    events = []
    for i in range(30):
        at, calls = rng.randrange(0, 3000), []
        for _ in range(rng.randrange(2, 15)):
            at += rng.choice([60, 130, 400])
            calls.append((f"c{rng.randrange(9)}", at))
        events += [(f"t{i}", f"f{i % 3}", *c) for c in calls]
        kept = [(c, d + rng.randrange(-110, 111)) for c, d in calls if rng.random() < 0.9]
        kept += [(f"c{rng.randrange(9)}", rng.randrange(0, 5000)) for _ in range(rng.randrange(4))]
        events += [(f"u{i}", f"f{(i + 1) % 3}", *c) for c in kept]
    events += [("u0", "f1", "c1", None), ("t1", "f1", "c2", None)]
    df = spark.createDataFrame(events, "trip_id string, feed string, cluster_id string, dep_s int")
    n, feed, shared = {}, {}, {}
    for t, f, *_ in events:
        n[t], feed[t] = n.get(t, 0) + 1, f
    for a, fa, ca, da in events:
        for b, fb, cb, db in events:
            if fa < fb and ca == cb and None not in (da, db) and abs(da - db) <= 120:
                shared[a, b] = shared.get((a, b), 0) + 1
    want = {(a, b, s) for (a, b), s in shared.items() if min(n[a], n[b]) >= 2 and s >= share * min(n[a], n[b])}
    assert len(want) > 15
    assert set(rows(D.duplicate_trips(df, 120, share), "trip_a", "trip_b", "shared")) == want


def test_nearest_span(spark):
    trains = spark.createDataFrame([("c", "t", "R1", 100, 200), ("c", "t", "R2", 500, 600)], "country string, trip_id string, row_id string, first_ts long, last_ts long")
    met = J.attribute_passages(spark.createDataFrame([("c", t, ts) for t, ts in [("t", 150), ("t", 340), ("t", 350), ("t", 550), ("u", 1)]],
                                                     "country string, trip_id string, ts long"), trains)
    assert rows(met, "ts", "row_id") == [(150, "R1"), (340, "R1"), (350, "R1"), (550, "R2")]


def test_no_row_is_lost_at_the_edges(spark, tmp_path):
    """A week's window, a node at 52 degrees north, a short edge, a backlog of 45 days, a chain of 40 links."""
    import datetime

    from ballast.operators import aggregates, graphs, spatial
    from ballast.sinks.archive import archive_completed_days

    as_of = 1705000000
    obs = spark.createDataFrame([("nl", "t", "20240105", "c", as_of - 6 * 86400, 1, 5)], "country string, trip_id string, service_date string, cluster string, ts long, seq long, delay_s int")
    assert aggregates.train_stats(obs, as_of, 7 * 86400).count() == 1
    undated = spark.createDataFrame([("nl", "t", d, "c", as_of - 10, 1, 5) for d in (None, "", "20231201")], obs.schema)
    assert aggregates.latest_per_cluster(undated, as_of, 3600).count() == 3
    station = spark.createDataFrame([("c", 52.0, 5.0)], "cluster_id string, lat double, lon double")
    node = spark.createDataFrame([(1, 52.0, 5.021)], "node_id long, lat double, lon double")
    assert [round(r.dist_m) for r in spatial.snap_stations(station, node, 1500.0).collect()] == [1438]
    samples = spark.createDataFrame([("a", 0, 52.0, 5.0), ("b", 0, 52.0, 5.001)], "id string, pos long, lat double, lon double")
    assert spatial.overlapping_edges(samples).count() == 1
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(i) for i in range(45)]
    seg = spark.createDataFrame([(int(datetime.datetime.combine(d, datetime.time(12), datetime.UTC).timestamp()), "s") for d in days], "ts long, segment string")
    stops = spark.createDataFrame([(d.strftime("%Y%m%d"),) for d in days], "service_date string")
    none = spark.createDataFrame([], "day date")
    done = archive_completed_days(seg, stops, none, 1712000000, str(tmp_path))
    assert done.count() == 45 and spark.read.parquet(f"{tmp_path}/seg").select("day").distinct().count() == 45
    assert archive_completed_days(seg, stops, done, 1712000000, str(tmp_path / "again")).count() == 0
    links = [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)]
    graph = spark.createDataFrame(links + [(b, a) for a, b in links], "u string, v string")
    assert graphs.bfs_paths(spark.createDataFrame([("p", "c00", "c40")], "pair_id string, a string, b string"), graph).count() == 40


def test_stream_state_is_carried_over(spark, tmp_path):
    """A first run that knows the log repeats nothing of it."""
    from ballast.streaming.changes import drained, stream_seg_changes

    schema = "seq long, ts long, country string, segment string, trip_id string, delta_s int"
    spark.createDataFrame([(1, 10, "nl", "s", "t", 5), (2, 20, "nl", "s", "t", 5), (3, 30, "nl", "s", "t", 6), (4, 30, "nl", "s", "u", 1)], schema).write.parquet(f"{tmp_path}/in")
    known = spark.createDataFrame([("nl", "t", "s", 5)], "country string, trip_id string, segment string, delta_s int")

    def landed():
        return spark.readStream.schema(schema).parquet(f"{tmp_path}/in")

    assert sorted(r.seq for r in drained(stream_seg_changes(landed(), None)).collect()) == [1, 3, 4]
    assert sorted(r.seq for r in drained(stream_seg_changes(landed(), None, known)).collect()) == [3, 4]


def test_blockades_come_and_go(spark, tmp_path):
    from ballast.streaming.changes import drained, stream_blockades

    rows = [("s", "a", 100, "cancel"), ("s", "b", 200, "cancel"), ("s", "", 300, "passage"), ("s", "c", 400, "cancel"), ("s", "d", 400 + 5401, "cancel")]
    spark.createDataFrame(rows, "segment string, trip_id string, ts long, kind string").write.parquet(f"{tmp_path}/in")

    def landed(kind):
        return spark.readStream.schema("segment string, trip_id string, ts long, kind string").parquet(f"{tmp_path}/in").filter(f"kind='{kind}'")

    got = drained(stream_blockades(landed("cancel"), landed("passage"))).orderBy("ts").collect()
    assert [(r.ts, r.blocked) for r in got] == [(200, True), (300, False)]


def test_name_variants(spark):
    from ballast.functions.text import name_variants

    names = [("S+U Alexanderplatz Bhf (Berlin)", 52.52, 13.41), ("D-Benrath S", 51.16, 6.87), ("Köln, Hauptbahnhof", 50.94, 6.96), ("Ostbahnhof", 48.12, 11.60), ("Poststr. (Bus)", 0.0, 0.0), ("Plain", 0.0, 0.0)]
    got = {r.name: r.v for r in spark.createDataFrame(names, "name string, lat double, lon double").select("name", name_variants(F.col("name"), F.col("lat"), F.col("lon")).alias("v")).collect()}
    assert all(v[0] == name for name, v in got.items()) and got["Plain"] == ["Plain"]
    assert {"Berlin Alexanderplatz", "Alexanderplatz"} <= set(got[names[0][0]]) and "Düsseldorf-Benrath" in got["D-Benrath S"]
    assert {"Hauptbahnhof", "Köln Hauptbahnhof", "Köln Hbf", "Köln-Hbf", "Hbf"} <= set(got["Köln, Hauptbahnhof"])
    assert {"München Ostbahnhof", "München Ost", "München-Ost", "Ost"} <= set(got["Ostbahnhof"])
    assert {"Poststraße (Bus)", "Poststraße", "Poststr."} <= set(got["Poststr. (Bus)"])
