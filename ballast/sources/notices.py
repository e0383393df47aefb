"""Disruption documents of two dialects as typed rows: (disruption_id, payload) in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.text import CLOSED_STRETCH  # noqa: F401
from ballast.functions.time import iso_epoch

SECTIONS_SCHEMA = (
    "struct<type:string,isActive:boolean,title:string,start:string,end:string,"
    "timespans:array<struct<start:string,end:string,situation:struct<label:string>>>,"
    "publicationSections:array<struct<section:struct<stations:array<struct<stationCode:string,uicCode:string,countryCode:string>>>>>>"
)
IMPACTS_SCHEMA = (
    "struct<severity:struct<effect:string>,"
    "impacted_objects:array<struct<impacted_stops:array<struct<stop_time_effect:string,stop_point:struct<id:string>>>>>,"
    "application_periods:array<struct<begin:string,end:string>>,messages:array<struct<text:string>>>"
)


def parse_disruptions(raw: DataFrame, dialect: str) -> DataFrame:
    """Rows with nested arrays; "sections" documents list station sections, "impacts" list stops per train."""
    if dialect == "sections":
        parsed = raw.select("disruption_id", F.from_json("payload", SECTIONS_SCHEMA).alias("p"))
        return parsed.select("disruption_id", "p.type", F.coalesce("p.isActive", F.lit(False)).alias("is_active"), "p.title",
                             "p.start", "p.end", "p.timespans", F.col("p.publicationSections").alias("sections"))
    if dialect == "impacts":
        parsed = raw.select("disruption_id", F.from_json("payload", IMPACTS_SCHEMA).alias("p"))
        return parsed.select("disruption_id", F.col("p.severity.effect").alias("effect"), F.col("p.impacted_objects").alias("objects"),
                             F.col("p.application_periods.end").alias("ends"), F.try_element_at("p.messages.text", F.lit(1)).alias("text"))
    raise ValueError(f"unknown dialect {dialect!r}")


def section_stations(disruptions: DataFrame) -> DataFrame:
    """Stations of each section in order."""
    sections = disruptions.select("disruption_id", F.posexplode("sections").alias("section_no", "sec"))
    stations = sections.select("disruption_id", "section_no", F.posexplode("sec.section.stations").alias("pos", "st"))
    return stations.select("disruption_id", "section_no", "pos", F.col("st.stationCode").alias("station_code"),
                           F.col("st.uicCode").alias("uic_code"), F.col("st.countryCode").alias("country_code"))


def impacted_stops(disruptions: DataFrame) -> DataFrame:
    """Stops of each impacted train in order, with the effect on them."""
    objects = disruptions.select("disruption_id", F.posexplode("objects").alias("object_no", "obj"))
    stops = objects.select("disruption_id", "object_no", F.posexplode("obj.impacted_stops").alias("stop_no", "st"))
    return stops.select("disruption_id", "object_no", "stop_no", F.col("st.stop_time_effect").alias("effect"),
                        F.col("st.stop_point.id").alias("stop_id"))


def current_situations(disruptions: DataFrame, as_of: int) -> DataFrame:
    """Situation texts of the time spans that hold the instant; without spans, the title in its own period.

    A period open at one end counts, one open at both or with an unreadable end does not.
    """
    def covers(start, end):
        start, end = F.nullif(start, F.lit("")), F.nullif(end, F.lit(""))
        begins = F.when(start.isNull(), F.lit(True)).otherwise(F.coalesce(iso_epoch(start) <= as_of, F.lit(False)))
        lasts = F.when(end.isNull(), F.lit(True)).otherwise(F.coalesce(iso_epoch(end) >= as_of, F.lit(False)))
        return (start.isNotNull() | end.isNotNull()) & begins & lasts

    spans = F.coalesce("timespans", F.array())
    open_spans = F.filter(spans, lambda s: covers(s["start"], s["end"]))
    labels = F.filter(F.transform(open_spans, lambda s: F.trim(s["situation"]["label"])), lambda t: t.isNotNull() & (t != ""))
    own = F.when((F.size(spans) == 0) & covers(F.col("start"), F.col("end")), F.array(F.coalesce("title", F.lit(""))))
    texts = F.when(F.size(spans) > 0, labels).otherwise(own)
    return disruptions.select("disruption_id", F.explode(texts).alias("situation"))
