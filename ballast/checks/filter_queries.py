"""Queries of the row filters and repairs."""

from pyspark.sql import functions as F

from ballast.functions import time as T
from ballast.operators import filters as P
from ballast.registry import query

AS_OF = 1705000000
STATIONS = """select s.stop_id as station_id, s.feed, s.stop_name, s.stop_lat as lat, s.stop_lon as lon, s.stop_code from b_stops s
 where s.stop_id in (select coalesce(parent_station, stop_id) from b_stops)"""
NORM = r"""trim(regexp_replace(regexp_replace(lower(stop_name), '\b(centraal|central|hbf|hauptbahnhof|gare de|gare du|gare d''|station|bahnhof|railway station|sncb|sncf|cff|sbb)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"""
REPAIRED = f"""with st as ({STATIONS}), k as (select *, {NORM} nk from st),
 donor as (select nk, min_by(lat, station_id) lat, min_by(lon, station_id) lon from k where lat is not null and not (abs(lat)<=0.5e0 and abs(lon)<=0.5e0) group by nk),
 repaired as (select k.station_id, k.feed, k.stop_name, k.stop_code, case when abs(k.lat)<=0.5e0 and abs(k.lon)<=0.5e0 then d.lat else k.lat end lat,
  case when abs(k.lat)<=0.5e0 and abs(k.lon)<=0.5e0 then d.lon else k.lon end lon from k left join donor d on d.nk=k.nk)"""


@query("flt_01_rail_routes", "select * from b_routes where cast(route_type as int)=2 or cast(route_type as int) between 100 and 117")
def _(t):
    return P.rail_routes(t.routes)


@query("flt_02_excluded_route_types", """select route_type, count(*) n from b_routes
where not (cast(route_type as int)=2 or cast(route_type as int) between 100 and 117) group by route_type""")
def _(t):
    return P.excluded_route_types(t.routes)


@query("flt_03_prefix_ids", """select 'nl:'||nullif(trip_id,'') trip_id, 'nl:'||nullif(route_id,'') route_id,
 case when trip_short_name is null or trip_short_name='' then null else 'nl:'||trip_short_name end trip_short_name from b_trips""")
def _(t):
    return P.prefix_ids(t.trips, "nl", ["trip_id", "route_id", "trip_short_name"]).select("trip_id", "route_id", "trip_short_name")


@query("flt_04_with_dep_s", """select trip_id, stop_sequence, cast(split_part(c,':',1) as int)*3600+cast(split_part(c,':',2) as int)*60+cast(split_part(c,':',3) as int) dep_s
from (select trip_id, cast(stop_sequence as int) stop_sequence, coalesce(nullif(departure_time,''), arrival_time) c from b_clock_times) q""")
def _(t):
    return P.with_dep_s(t.clock_times.drop("dep_s")).select("trip_id", F.col("stop_sequence").cast("int").alias("stop_sequence"), "dep_s")


@query("flt_05_stations", STATIONS)
def _(t):
    return P.stations(t.stops)


@query("flt_06_repair_null_island", REPAIRED + " select * from repaired")
def _(t):
    return P.repair_null_island(P.stations(t.stops))


@query("flt_07_in_event_window", f"select seq, ts, trip_id from b_poll where ts between {AS_OF}-2700 and {AS_OF}+900")
def _(t):
    return P.in_event_window(t.poll, AS_OF, ts="ts").select("seq", "ts", "trip_id")


@query("flt_08_sane_deltas", "select trip_id, delta_s from (select trip_id, cast(total as int) delta_s from (select trip_id, sum(delta_s)-1500 total from b_seg_obs group by trip_id) q) r where abs(delta_s)<=7200")
def _(t):
    return P.sane_deltas(t.seg_obs.groupBy("trip_id").agg((F.sum("delta_s") - 1500).cast("int").alias("delta_s")))


@query("flt_12_service_day_floor", """select seq, strftime(to_timestamp(ts-28800) at time zone 'UTC','%Y%m%d') log_floor,
 strftime(to_timestamp(ts-172800) at time zone 'UTC','%Y%m%d') inspection_floor from b_poll""")
def _(t):
    return t.poll.select("seq", T.service_day_floor(F.col("ts"), 8).alias("log_floor"), T.service_day_floor(F.col("ts"), 48).alias("inspection_floor"))


CLOSURES = """select service_date as d, cluster as edge, cast(min(ts/3600%24) as int) as hour_start, cast(max(ts/3600%24) as int) as hour_end
 from (select service_date, cluster, ts, cast(floor(ts/3600) as bigint) h from b_poll) q group by service_date, cluster"""


@query("flt_14_active_closures", f"""
with c as ({CLOSURES}), a as (select as_of, strftime(timezone('Europe/Amsterdam', to_timestamp(as_of)),'%Y%m%d') d, extract(hour from timezone('Europe/Amsterdam', to_timestamp(as_of))) h from b_noons)
select distinct a.as_of, c.edge from a join c on c.d=a.d and a.h between c.hour_start and c.hour_end""")
def _(t):
    return P.active_closures(t.sql(CLOSURES), t.noons)


@query("jn_20_exclude", "select r.* from b_routes r where not exists (select 1 from b_trips t where t.route_id=r.route_id and t.trip_short_name is null)")
def _(t):
    return P.exclude(t.routes, t.trips.filter("trip_short_name is null"), "route_id")
