"""Realtime feed messages in JSON form, landed as rows (country, poll_ts, payload)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Enumerations of the realtime specification, by number.
TRIP_RELATIONS = {0: "SCHEDULED", 1: "ADDED", 2: "UNSCHEDULED", 3: "CANCELED", 5: "REPLACEMENT", 6: "DUPLICATED", 7: "DELETED"}
STOP_RELATIONS = {0: "SCHEDULED", 1: "SKIPPED", 2: "NO_DATA", 3: "UNSCHEDULED"}
CAUSES = {
    1: "UNKNOWN_CAUSE", 2: "OTHER_CAUSE", 3: "TECHNICAL_PROBLEM", 4: "STRIKE", 5: "DEMONSTRATION", 6: "ACCIDENT",
    7: "HOLIDAY", 8: "WEATHER", 9: "MAINTENANCE", 10: "CONSTRUCTION", 11: "POLICE_ACTIVITY", 12: "MEDICAL_EMERGENCY",
}
EFFECTS = {
    1: "NO_SERVICE", 2: "REDUCED_SERVICE", 3: "SIGNIFICANT_DELAYS", 4: "DETOUR", 5: "ADDITIONAL_SERVICE",
    6: "MODIFIED_SERVICE", 7: "OTHER_EFFECT", 8: "UNKNOWN_EFFECT", 9: "STOP_MOVED", 10: "NO_EFFECT", 11: "ACCESSIBILITY_ISSUE",
}

_EVENT = "struct<delay:string,time:string>"
_STOP = ("struct<stop_id:string,stopId:string,schedule_relationship:string,scheduleRelationship:string,"
         f"arrival:{_EVENT},departure:{_EVENT}>")
_TRIP = ("struct<trip_id:string,tripId:string,start_date:string,startDate:string,"
         "schedule_relationship:string,scheduleRelationship:string>")
_UPDATE = f"struct<trip:{_TRIP},stop_time_update:array<{_STOP}>,stopTimeUpdate:array<{_STOP}>>"
_TEXT = "struct<translation:array<struct<language:string,text:string>>>"
_ENTITY = "array<struct<stop_id:string,stopId:string>>"
_ALERT = (f"struct<cause:string,effect:string,header_text:{_TEXT},headerText:{_TEXT},"
          f"informed_entity:{_ENTITY},informedEntity:{_ENTITY}>")
MESSAGE_SCHEMA = f"struct<entity:array<struct<trip_update:{_UPDATE},tripUpdate:{_UPDATE},alert:{_ALERT}>>>"


def either(parent: Column, snake: str) -> Column:
    """A field under its original or its camel-case name."""
    head, *rest = snake.split("_")
    return F.coalesce(parent[snake], parent[head + "".join(w.title() for w in rest)])


def whole_number(col: Column) -> Column:
    """A number, or the low and high halves some feeds write 64-bit numbers as."""
    halves = F.from_json(col, "struct<low:bigint,high:bigint>")
    joined = halves["low"].bitwiseAND(F.lit(0xFFFFFFFF)) + F.shiftleft(halves["high"], 32)
    return F.coalesce(F.when(F.startswith(col, F.lit("{")), joined), col.try_cast("bigint"))


def enum_name(col: Column, names: dict[int, str], default: str) -> Column:
    """Name of an enumeration value written as number or name."""
    by_number = F.create_map(*[F.lit(x) for k, v in names.items() for x in (str(k), v)])
    return F.coalesce(by_number[col], col, F.lit(default))


def _entities(raw: DataFrame) -> DataFrame:
    message = F.from_json("payload", MESSAGE_SCHEMA)
    return raw.select("country", "poll_ts", F.posexplode(message["entity"]).alias("entity_pos", "e"))


def parse_trip_updates(raw: DataFrame) -> DataFrame:
    """One row per stop update in feed order; a trip without stop updates keeps one row."""
    update = either(F.col("e"), "trip_update")
    trips = _entities(raw).withColumn("u", update).filter(F.col("u").isNotNull())
    trip = F.col("u")["trip"]
    listed = trips.select(
        "country", "poll_ts", "entity_pos", either(trip, "trip_id").alias("trip_id"),
        F.coalesce(F.nullif(either(trip, "start_date"), F.lit("")), F.date_format(F.timestamp_seconds("poll_ts"), "yyyyMMdd")).alias("service_date"),
        enum_name(either(trip, "schedule_relationship"), TRIP_RELATIONS, "SCHEDULED").alias("trip_rel"),
        F.posexplode_outer(either(F.col("u"), "stop_time_update")).alias("stu_pos", "s"),
    )
    stop = F.col("s")

    def arrival_first(field: str) -> Column:
        return F.coalesce(whole_number(stop["arrival"][field]), whole_number(stop["departure"][field]))

    return listed.select(
        "country", "poll_ts", "entity_pos", "trip_id", "service_date", "trip_rel", "stu_pos", either(stop, "stop_id").alias("stop_id"),
        enum_name(either(stop, "schedule_relationship"), STOP_RELATIONS, "SCHEDULED").alias("stop_rel"),
        arrival_first("delay").cast("int").alias("delay_s"), arrival_first("time").alias("event_ts"),
    )


def parse_alerts(raw: DataFrame) -> DataFrame:
    """One row per alert: cause and effect names, texts by language, informed stops."""
    alerts = _entities(raw).filter(F.col("e.alert").isNotNull())
    alert = F.col("e.alert")
    texts = F.transform(F.coalesce(either(alert, "header_text")["translation"], F.array()),
                        lambda t: F.struct(F.coalesce(t["language"], F.lit("")).alias("lang"), t["text"].alias("text")))
    informed = F.transform(F.coalesce(either(alert, "informed_entity"), F.array()), lambda i: either(i, "stop_id"))
    return alerts.select(
        "country", "poll_ts", F.col("entity_pos").alias("alert_pos"), enum_name(alert["cause"], CAUSES, "UNKNOWN_CAUSE").alias("cause"),
        enum_name(alert["effect"], EFFECTS, "UNKNOWN_EFFECT").alias("effect"), texts.alias("texts"), informed.alias("stop_ids"),
    )


RAW_SCHEMA = "country string, poll_ts bigint, payload string"


def stream_updates(spark: SparkSession, folder: str, schema: str = RAW_SCHEMA, fmt: str = "parquet",
                   files_per_trigger: int | None = None) -> DataFrame:
    """Landed polls as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def union_feeds(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows by column name."""
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
