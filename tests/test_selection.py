"""Station selection works its patterns out once."""

from pyspark.sql import functions as F

from ballast.operators import aggregates as A


def test_patterns_are_worked_out_once(spark):
    """Each row of the patterns passes a counter once per query; the values are counted by hand."""
    rows = [("p1", 40, 0, "a"), ("p1", 40, 1, "b"), ("p1", 40, 2, "c"), ("p2", 19, 0, "c"), ("p2", 19, 1, "d"), ("p2", 19, 2, "e")]
    edges = spark.createDataFrame([("a|b", "E1"), ("b|c", "E2"), ("c|d", "E2"), ("d|e", "E3")], "segment string, edge string")
    chosen = spark.createDataFrame([("a",), ("b",)], "cluster_id string")
    for query, want in ((A.static_edge_coverage, [("E1",)]), (A.marginal_gain, [("c", 1)]), (A.pattern_opening_value, [("p2", 1.0)])):
        seen = spark.sparkContext.accumulator(0)

        def passed(n, seen=seen):
            seen.add(1)
            return n

        counter = F.udf(passed, "int").asNondeterministic()
        patterns = spark.createDataFrame(rows, "pattern_id string, n_trips int, pos int, cluster string").withColumn("n_trips", counter("n_trips"))
        assert sorted(tuple(r) for r in query(patterns, chosen, edges).collect()) == want
        assert seen.value == len(rows)
