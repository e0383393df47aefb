"""German station timetables in XML: planned slices and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.time import iris_epoch

_CALL = "struct<_pt:string,_ct:string,_cs:string,_ppth:string>"
SLICE_SCHEMA = f"struct<_station:string,s:array<struct<_id:string,tl:struct<_c:string,_n:string>,ar:{_CALL},dp:{_CALL}>>>"


def split_iris_stop_id(col: Column) -> Column:
    """"{trip}-{start}-{idx}" as struct<head, idx, service_date>; NULL without a numeric index."""
    head = F.regexp_extract(col, r"^(.*)-([0-9]+)$", 1)
    idx = F.regexp_extract(col, r"^(.*)-([0-9]+)$", 2)
    start = F.regexp_extract(head, r"(?:^|-)([0-9]{6})[0-9]{4}$", 1)
    date = F.when(start != "", F.concat(F.lit("20"), start)).otherwise(F.lit(""))
    return F.when(col.rlike("-[0-9]+$"), F.struct(head.alias("head"), idx.cast("int").alias("idx"), date.alias("service_date")))


def _stops(xml: DataFrame) -> DataFrame:
    keep = [c for c in xml.columns if c != "payload"]
    parsed = xml.select(*keep, F.from_xml("payload", SLICE_SCHEMA).alias("t"))
    return parsed.select(*keep, F.coalesce("t._station", F.lit("")).alias("station"), F.explode("t.s").alias("s"))


def _names(path: Column) -> Column:
    return F.filter(F.split(F.coalesce(path, F.lit("")), r"\|"), lambda p: p != "")


def parse_iris_plan(xml: DataFrame) -> DataFrame:
    """Planned calls with train label and the train's whole planned path."""
    ident = split_iris_stop_id(F.col("s._id"))
    number = F.nullif(F.col("s.tl._n"), F.lit(""))
    label = F.when(number.isNotNull(), F.concat_ws(" ", "s.tl._c", "s.tl._n"))
    path = F.concat(_names(F.col("s.ar._ppth")), F.array("station"), _names(F.col("s.dp._ppth")))
    listed = _stops(xml).filter(F.coalesce("s._id", F.lit("")) != "").withColumn("i", ident)
    keep = [c for c in xml.columns if c != "payload"]
    head = F.coalesce("i.head", F.regexp_replace("s._id", "-[^-]*$", ""))
    return listed.select(
        *keep, "station", F.col("s._id").alias("stop_id"), head.alias("head"), "i.idx", "i.service_date",
        label.alias("label"), iris_epoch(F.col("s.ar._pt")).alias("pt_arr"), iris_epoch(F.col("s.dp._pt")).alias("pt_dep"),
        F.when((F.col("station") != "") & (F.size(path) > 2), path).alias("path"),
    )


def parse_iris_changes(xml: DataFrame, plan: DataFrame) -> DataFrame:
    """Delay or cancellation per changed call; the arrival speaks first, times missing come from the plan.

    A departure with a changed time overrides a cancelled arrival. The event time is the
    planned one.
    """
    known = plan.groupBy("stop_id").agg(F.max("pt_arr").alias("plan_arr"), F.max("pt_dep").alias("plan_dep"))
    listed = _stops(xml).filter(F.coalesce("s._id", F.lit("")) != "").withColumn("i", split_iris_stop_id(F.col("s._id")))
    keep = [c for c in xml.columns if c != "payload"]
    calls = listed.filter(F.col("i").isNotNull()).select(*keep, F.col("s._id").alias("stop_id"), "i.*", "s.ar", "s.dp").join(known, "stop_id", "left")

    def call(kind: str, planned: str):
        pt = F.when(F.col(kind).isNotNull(), F.coalesce(iris_epoch(F.col(kind)["_pt"]), F.col(planned)))
        cancelled = F.coalesce(F.col(kind)["_cs"] == "c", F.lit(False))
        delay = F.when(~cancelled, iris_epoch(F.col(kind)["_ct"]) - pt)
        return pt, cancelled, delay

    (pt_a, off_a, late_a), (pt_d, off_d, late_d) = call("ar", "plan_arr"), call("dp", "plan_dep")
    event = (
        F.when(late_a.isNotNull(), pt_a).when(late_d.isNotNull(), pt_d)
        .otherwise(F.coalesce(F.when(off_a, pt_a), F.when(off_d, pt_d)))
    )
    delay = F.coalesce(late_a, late_d)
    off = delay.isNull() & (off_a | off_d)
    return calls.select(
        *keep, "stop_id", "head", "idx", "service_date",
        F.when(off, 0).otherwise(delay).cast("int").alias("delay_s"), event.alias("event_ts"), off.alias("cancelled"),
    ).filter(F.col("event_ts").isNotNull() & F.col("delay_s").isNotNull())
