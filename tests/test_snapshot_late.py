"""Rows that land after a snapshot's instant was published, but lie at it or before."""

import json

from ballast.streaming.snapshots import LOG, Publisher, published


def test_snapshots_take_rows_that_land_later(spark, tmp_path):
    statics = {
        "segment_edges": spark.createDataFrame([("a|b", "E1")], "segment string, edge string"),
        "closures": spark.createDataFrame([], "d string, edge string, hour_start int, hour_end int"),
        "works": spark.createDataFrame([], "group_seq string, src string, sev string, until string, txt string, edge string"),
        "incidents": spark.createDataFrame([], "country string, alert_pos int, cause string, effect string, txt string, lat double, lon double, cluster string"),
        "coverage": spark.createDataFrame([], "country string, status string, age_s int"),
    }
    batches = [
        [("delta", 1, 1010, "a|b", "t", 90), ("cancel", 2, 1000, "a|b", "t", None)],  # published for 1020
        [("delta", 3, 1020, "a|b", "u", 700), ("delta", 4, 100_000, "a|b", "u", 5)],  # at that instant, and a day later
        [("cancel", 5, 1015, "a|b", "u", None), ("delta", 6, 100_010, "a|b", "u", 7)],  # before it; the second instant has this minute too
        [("delta", 7, 300_000, "a|b", "u", 1)],  # reaches none of them
    ]

    def lines():
        return sorted((r.as_of, r.section, json.loads(r.json)) for r in published(spark, f"{tmp_path}/out").collect())

    publisher = Publisher(f"{tmp_path}/out", statics)
    for number, rows in enumerate(batches):
        publisher(spark.createDataFrame(rows, LOG), number)
    want = [(1020, "blk", {"edge": "E1"}), (1020, "seg", ["E1", 3, 700, 2]), (100_020, "seg", ["E1", 0, 7, 1]), (100_020, "seg", ["E1", 0, 7, 1]), (300_060, "seg", ["E1", 0, 1, 1])]
    assert [(a, s, j) for a, s, j in lines()] == want
    for number in (3, 0):  # again, the last one and an early one
        publisher(spark.createDataFrame(batches[number], LOG), number)
        assert lines() == want
