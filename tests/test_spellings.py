"""Spellings of a name: an expression of bounded size."""

from pyspark.sql import functions as F

from ballast.functions.text import name_variants


def test_spellings_do_not_double_the_expression(spark):
    names = spark.createDataFrame([("Ort Hauptbahnhof",)], "name string").select(name_variants(F.col("name"), F.lit(0.0), F.lit(0.0)).alias("v"))
    assert names.first().v == ["Ort Hauptbahnhof", "Ort Hbf"]
    assert names._jdf.queryExecution().analyzed().toString().count("Hauptbahnhof") < 10
