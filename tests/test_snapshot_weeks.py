"""Snapshots over a log of any length."""

import os

from pyspark.sql import functions as F

from ballast.registry import QUERIES, load_all

SMALL = "/root/testdata/sf0.001"


def test_snapshots_of_all_weeks(spark, tmp_path):
    load_all()
    for name in os.listdir(SMALL):
        if name != "events.parquet":
            os.symlink(f"{SMALL}/{name}", f"{tmp_path}/{name}")
    events = spark.read.parquet(f"{SMALL}/events.parquet").filter("event_id % 10 = 0")
    late = events.limit(5).withColumn("ts", F.expr("timestamp'2024-02-20 10:00:00'"))
    events.filter("ts < '2024-01-09'").unionByName(late).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    (part,) = [f for f in os.listdir(f"{tmp_path}/events.parquet") if f.endswith(".parquet")]
    os.rename(f"{tmp_path}/events.parquet/{part}", f"{tmp_path}/one")
    os.rename(f"{tmp_path}/events.parquet", f"{tmp_path}/folder")
    os.rename(f"{tmp_path}/one", f"{tmp_path}/events.parquet")
    out = QUERIES["str_10_published_snapshots"](spark, str(tmp_path))
    assert max(r.as_of for r in out.select("as_of").distinct().collect()) == 1708423260
