"""Edges beside each other: work follows the places, not the points."""

from ballast.operators.spatial import overlapping_edges


def test_points_at_one_place_meet_once(spark):
    rows = [("a", i, 50.0, 5.0) for i in range(1500)] + [("a", 5000, 50.0, 5.0), ("a", 5000, 51.0, 5.0), ("a", 6000, 51.0, 5.0)]
    samples = spark.createDataFrame(rows + [("b", i, 50.0, 5.0001) for i in range(1500)], "id string, pos long, lat double, lon double")
    out = overlapping_edges(samples, 150.0, 0.3)
    assert [(r.edge_a, r.edge_b, r.share) for r in out.collect()] == [("a", "b", 1501 / 1503)]
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert joins and "pos" not in "".join(joins)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("collect_set") == 1
