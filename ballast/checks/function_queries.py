"""Queries of the column functions, entity resolution, decoding and graph programs."""

from pyspark.sql import functions as F

from ballast.checks.filter_queries import REPAIRED
from ballast.checks.join_queries import META, metadata_tables
from ballast.functions import geo as G
from ballast.functions import text as X
from ballast.functions import time as T
from ballast.operators import aggregates as A
from ballast.operators import entities as E
from ballast.operators import filters as P
from ballast.operators import graphs as R
from ballast.plans import inspection as I
from ballast.registry import query
from ballast.sources.realtime import parse_trip_updates

AS_OF, WEEK = 1705000000, 7 * 86400


@query("fn_03_norm_compact", "select doc_id, md5(regexp_replace(replace(strip_accents(lower(text)),'ß','ss'),'[^a-z0-9]','','g')) k from documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.norm_compact(F.col("text"))).alias("k"))


@query("fn_04_uic_code", "select stop_id, substring(stop_code,1,7) uic from b_stops")
def _(t):
    return t.stops.select("stop_id", X.uic_code(F.col("stop_id"), F.concat(F.lit("S:"), "stop_code")).alias("uic"))


@query("fn_05_haversine_m", """select s.stop_id, round(2*6371000e0*asin(sqrt(pow(sin(radians(c.lat-s.stop_lat)/2),2)+cos(radians(s.stop_lat))*cos(radians(c.lat))*pow(sin(radians(c.lon-s.stop_lon)/2),2))),1) m
 from b_stops s join b_clusters c on c.cluster_id=s.cluster_id""")
def _(t):
    both = t.stops.join(t.clusters.select("cluster_id", "lat", "lon"), "cluster_id")
    return both.select("stop_id", F.round(G.haversine_m(F.col("stop_lat"), F.col("stop_lon"), F.col("lat"), F.col("lon")), 1).alias("m"))


@query("fn_08_local_minute", "select seq, strftime(timezone('Europe/Amsterdam', to_timestamp(ts)),'%Y-%m-%d %H:%M') until from b_poll")
def _(t):
    return t.poll.select("seq", T.local_minute(F.col("ts")).alias("until"))


@query("fn_09_day_type", "select d, daytype from b_dates")
def _(t):
    return t.dates.select("d", T.day_type(F.col("d")).alias("daytype"))


@query("fn_10_dep_hour", """select trip_id, cast(stop_sequence as int) stop_sequence, cast(floor(dep_s/3600) as bigint)%24 "hour" from b_stop_times""")
def _(t):
    return t.stop_times.select("trip_id", F.col("stop_sequence").cast("int").alias("stop_sequence"), T.dep_hour(F.col("dep_s")).alias("hour"))


@query("fn_20_train_number", """select t.trip_id, coalesce(nullif(trip_short_name,''), nullif(trip_headsign,''), nullif(route_short_name,''), trip_id) train_number from b_trips t left join b_routes r on r.route_id=t.route_id""")
def _(t):
    both = t.trips.join(t.routes.select("route_id", "route_short_name"), "route_id", "left")
    return both.select("trip_id", X.train_number(F.col("trip_short_name"), F.col("trip_headsign"), F.col("route_short_name"), F.col("trip_id")).alias("train_number"))


@query("fn_21_contains_any", "select doc_id, contains(lower(text),'ous') or contains(lower(text),'the ') hit from documents")
def _(t):
    return t.documents.select("doc_id", X.contains_any(F.col("text"), ["ous", "the "]).alias("hit"))


@query("ent_04_name_dictionary", """with k as (select lower(replace(name,'-',' ')) name_key, cluster_id, list_contains(string_split(feeds,','),'f0') own from b_clusters)
 select name_key, case when count(*)=1 then min(cluster_id) when count(*) filter (own)=1 then min(cluster_id) filter (own) end cluster_id from k group by 1""")
def _(t):
    return E.name_dictionary(t.clusters, "f0")


@query("ent_05_strict_name_dictionary", "select regexp_replace(lower(name),'[^a-z0-9]','','g') name_key, min(cluster_id) cluster_id from b_clusters group by 1 having count(*)=1")
def _(t):
    return E.strict_name_dictionary(t.clusters)


@query("ent_06_shared_stations", "select cluster_id, name, uic, feeds from b_clusters where contains(feeds,',')")
def _(t):
    return E.shared_stations(t.clusters)


@query("ent_01_cluster_by_uic", REPAIRED + """ select 'uic:'||substring(stop_code,1,7) cluster_id, substring(stop_code,1,7) uic, arg_min(stop_name, station_id) name, arg_min_null(lat, station_id) lat, arg_min_null(lon, station_id) lon
 from repaired where stop_code is not null group by 1,2""")
def _(t):
    return E.cluster_by_uic(P.repair_null_island(P.stations(t.stops)))


NAME_KEY = r"trim(regexp_replace(regexp_replace(lower({0}), '\b(hbf|station)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
METRES = "2*6371000.0*asin(sqrt(pow(sin(radians({2}-{0})/2),2)+cos(radians({0}))*cos(radians({2}))*pow(sin(radians({3}-{1})/2),2)))"


@query("ent_03_attach_groups", REPAIRED + f""", uic as (select 'uic:'||substring(stop_code,1,7) cid, {NAME_KEY.format('arg_min(stop_name, station_id)')} key, arg_min_null(lat, station_id) y, arg_min_null(lon, station_id) x
   from repaired where stop_code is not null group by 1),
 open_ as (select station_id, feed, stop_name, lat, lon, {NAME_KEY.format('stop_name')} key, floor(lat*100+0.5) cy, floor(lon*100+0.5) cx from repaired where stop_code is null and lat is not null),
 head as (select cy, cx, key, min(station_id) sid, arg_min(lat, station_id) y, arg_min(lon, station_id) x from open_ group by 1,2,3),
 reach as (select h.*, u.cid, u.y uy, u.x ux, {METRES.format('h.y', 'h.x', 'u.y', 'u.x')} m from head h join uic u on u.key=h.key),
 best as (select * from reach where m<=300 qualify row_number() over (partition by cy, cx, key order by m, cid)=1)
 select o.station_id, o.feed, o.stop_name, o.lat, o.lon, case when b.cid is null then 'nm:'||h.sid when {METRES.format('o.lat', 'o.lon', 'b.uy', 'b.ux')}>300 then 'nm:'||o.station_id else b.cid end cluster_id
 from open_ o join head h using (cy, cx, key) left join best b on b.cy=o.cy and b.cx=o.cx and b.key=o.key""")
def _(t):
    stations = P.repair_null_island(P.stations(t.stops))
    return E.attach_groups(E.name_cell_groups(stations), E.cluster_by_uic(stations))


RAW = """select country, ts as poll_ts, to_json(named_struct('entity', array(named_struct('trip_update', named_struct('trip', named_struct('trip_id', trip_id),
 'stop_time_update', array(named_struct('stop_id', cluster, 'schedule_relationship', case when event_type='error' then 'SKIPPED' else 'SCHEDULED' end,
 'arrival', named_struct('delay', delay_s, 'time', named_struct('low', cast(ts as int), 'high', 0, 'unsigned', false))))))))) as payload from b_poll"""


@query("src_03_parse_trip_updates", """select country, ts poll_ts, 0 entity_pos, trip_id, service_date, 'SCHEDULED' trip_rel, 0 stu_pos, cluster stop_id,
 case when event_type='error' then 'SKIPPED' else 'SCHEDULED' end stop_rel, delay_s, ts event_ts from b_poll""")
def _(t):
    return parse_trip_updates(t.sql(RAW))


@query("agg_24_polyline_length", """with p as (select trip_id id, dep_s, stop_sequence seq, stop_lat lat, stop_lon lon from b_stop_times st join b_stops s on s.stop_id=st.stop_id),
 n as (select id, lat, lon, lead(lat) over (partition by id order by seq) lat2, lead(lon) over (partition by id order by seq) lon2 from p)
 select id, round(coalesce(sum(2*6371000e0*asin(sqrt(pow(sin(radians(lat2-lat)/2),2)+cos(radians(lat))*cos(radians(lat2))*pow(sin(radians(lon2-lon)/2),2)))),0e0),0) length_m from n group by id""")
def _(t):
    points = t.stop_times.join(t.stops, "stop_id").select(F.col("trip_id").alias("id"), F.col("stop_sequence").alias("seq"), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    return A.polyline_length(points).select("id", F.round("length_m", 0).alias("length_m"))


# All chains of strictly shorter segments within the cap, the shortest of each express segment kept.
M = "2*6371000e0*asin(sqrt(pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2)))"


@query("gr_01_refinement_paths", f"""with recursive s as (select g.segment, g.a, g.b, y.lat, y.lon, greatest({M.format(a='x.lat', b='x.lon', c='y.lat', d='y.lon')}, 1) w from b_segments g join b_clusters x on x.cluster_id=g.a join b_clusters y on y.cluster_id=g.b),
 l as (select a u, b v, w, segment from s union all select b, a, w, segment from s),
 r as (select segment express, a node, 0e0 g, []::varchar[] path, [a] seen, w, b goal, lat, lon from s where w>=8000
  union all select express, l.v, g+l.w, list_append(path, l.segment), list_append(seen, l.v), r.w, goal, r.lat, r.lon from r join l on l.u=r.node join b_clusters c on c.cluster_id=l.v
   where r.node<>goal and l.w<r.w and not list_contains(seen, l.v) and g+l.w+{M.format(a='c.lat', b='c.lon', c='r.lat', d='r.lon')}<=1.3*r.w+3000),
 best as (select express, arg_min(path, g) p from r where node=goal group by 1)
 select express segment, cast(i-1 as int) pos, p[i] link from best, unnest(range(1, len(p)+1)) u(i) where len(p)>1""")
def _(t):
    return R.refinement_paths(t.segments, t.clusters)


TRAIN_ROWS = f"""with {META}, rec as (select * from b_stop_obs where ts>={AS_OF}-{WEEK}),
 latest as (select * from rec qualify row_number() over (partition by country, trip_id, service_date, cluster order by ts desc, seq desc)=1),
 ends as (select country, trip_id, service_date, first(cluster order by ts, seq) fc, last(cluster order by ts, seq) lc, last(delay_s order by ts, seq) delay_s, max(ts) seen from latest group by 1,2,3),
 runs as (select country, trip_id, service_date, min(ts) since, count(*) n from rec group by 1,2,3),
 off as (select country, trip_id, service_date, min(ts) since, max(ts) seen from b_cancels where ts>={AS_OF}-{WEEK} group by 1,2,3),
 k as (select country, trip_id, service_date from runs union select country, trip_id, service_date from off),
 path as (select trip_id, first(name order by pos) o, last(name order by pos) d, first(dep order by pos) dep, last(arr order by pos) arr from ms group by 1)
select k.country||'|'||k.trip_id||'|'||k.service_date row_id, k.country, k.trip_id, k.service_date, coalesce(hd.train_number, k.trip_id) train_number, hd.route,
 case when path.trip_id is null then coalesce(cf.name, fc) else path.o end origin, case when path.trip_id is null then coalesce(cl.name, lc) else path.d end destination,
 path.dep sched_dep, path.arr sched_arr, ends.delay_s, coalesce(cl.name, lc) last_stop, least(runs.since, off.since) first_ts, greatest(ends.seen, off.seen) last_ts,
 coalesce(runs.n, 0) n_obs, path.trip_id is not null sched_known, off.trip_id is not null cancelled
from k left join runs using (country, trip_id, service_date) left join ends using (country, trip_id, service_date) left join off using (country, trip_id, service_date)
 left join hd on hd.trip_id=k.trip_id left join path on path.trip_id=hd.trip_id left join b_clusters cf on cf.cluster_id=fc left join b_clusters cl on cl.cluster_id=lc"""


@query("job_04_train_table", TRAIN_ROWS)
def _(t):
    tables = metadata_tables(t)
    keys = t.stop_obs.select("trip_id").union(t.cancels.select("trip_id"))
    return I.train_table(t.stop_obs, t.cancels, I.metadata_of(keys, tables), t.clusters, AS_OF, WEEK)
