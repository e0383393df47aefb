"""Name matches against a comparison of all pairs."""

import random

from pyspark.sql import functions as F

from ballast.functions.text import name_similarity
from ballast.operators.entities import fuzzy_station_match


def test_fuzzy_station_match_equals_all_pairs(spark):
    rng = random.Random(3)
    parts = ["Amsterdam", "RAI", "Zuid", "Halte", "Hal", "X", "Strasbourg", "Strassburg", "Ville", "Bad", "Berlin", "Süd", "S,", "Nord"]
    names = ["Halte Amsterdam RAI", "Strasbourg Ville", "東京 駅", None] + [" ".join(rng.sample(parts, rng.randrange(1, 4))) for _ in range(40)]
    others = ["Amsterdam RAI", "Amsterdam Zuid", "RAI Hal", "Halte X", "東京", "大阪"] + [" ".join(rng.sample(parts, rng.randrange(1, 4))) for _ in range(40)]
    left = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    right = spark.createDataFrame(list(enumerate(others)), "id long, name string")
    pairs = left.filter("name is not null and not startswith(name, '東')").select("id", "name").crossJoin(right.filter("not startswith(name, '東') and not startswith(name, '大')").select(F.col("id").alias("r_id"), F.col("name").alias("r_name")))
    scored = pairs.withColumn("s", name_similarity(F.col("name"), F.col("r_name"))).collect()
    for t in (0.3, 0.5, 0.8):
        best = {}
        for r in scored:
            if r.s >= t:
                best[r.id] = min(best.get(r.id, (0, "~")), (-r.s, r.r_name))
        got = {r.id: (-r.similarity, r.match_name) for r in fuzzy_station_match(left, right, t).collect()}
        assert got.pop(2) == (-1.0, "東京") and got == best
    small = right.filter("id < 4")
    assert [r.match_name for r in fuzzy_station_match(left.filter("id = 0"), small).collect()] == ["Amsterdam RAI"]
