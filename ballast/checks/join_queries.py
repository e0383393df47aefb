"""Queries of lookups, cascades and comparisons."""

from pyspark.sql import functions as F

from ballast.operators import aggregates as A
from ballast.operators import duplicates as D
from ballast.operators import joins as J
from ballast.plans.inspection import row_id
from ballast.registry import query
from ballast.sources.gtfs import merge_feeds
from ballast.sources.realtime import union_feeds

AS_OF = 1705000000
# A service runs on a date if that is added, or if its weekday is flagged within its period; unless it is removed.
SVC = """
 known as (select service_id from b_calendar union select service_id from b_calendar_dates),
 net as (select k.service_id, b.d from known k cross join b_dates b
   where not exists (from b_calendar_dates x where x.service_id=k.service_id and x.date=b.d and x.exception_type='2')
   and (exists (from b_calendar_dates x where x.service_id=k.service_id and x.date=b.d and x.exception_type='1')
     or exists (from b_calendar c where c.service_id=k.service_id and c.start_date<=b.d and c.end_date>=b.d
       and [c.monday, c.tuesday, c.wednesday, c.thursday, c.friday, c.saturday, c.sunday][b.wd+1]='1')))"""
RAIL = """
 kinds(low, high) as (values (2, 2), (100, 117)),
 rr as (select r.* from b_routes r semi join kinds k on cast(r.route_type as int) between k.low and k.high),
 rt as (select t.* from b_trips t semi join rr on rr.route_id=t.route_id),
 rst as (select st.* from b_stop_times st semi join rt on rt.trip_id=st.trip_id),
 called as (select s.stop_id, nullif(s.parent_station, '') up from b_stops s semi join rst on rst.stop_id=s.stop_id),
 rk as (select stop_id from called union select up from called where up is not null),
 rs as (select s.* from b_stops s semi join rk on rk.stop_id=s.stop_id)"""
TRANSFERS = "select stop_id as from_stop_id, parent_station as to_stop_id from b_stops where parent_station is not null"


def feed_tables(t):
    return {
        "routes": t.routes, "trips": t.trips, "stop_times": t.stop_times, "stops": t.stops, "agency": t.agency,
        "calendar": t.calendar, "calendar_dates": t.calendar_dates, "transfers": t.sql(TRANSFERS),
    }


@query("jn_01_filter_feed", f"""with {RAIL},
 ra as (select distinct a.* from b_agency a where a.agency_id in (select agency_id from rr)),
 rc as (select * from b_calendar where service_id in (select service_id from rt)), rd as (select * from b_calendar_dates where service_id in (select service_id from rt)),
 tf as (select * from ({TRANSFERS}) x where from_stop_id in (select stop_id from rs) and to_stop_id in (select stop_id from rs))
select 'routes' tab, route_id id, cast(1 as bigint) n from rr union all select 'trips', trip_id, 1 from rt union all select 'stop_times', trip_id, count(*) from rst group by trip_id
union all select 'stops', stop_id, 1 from rs union all select 'agency', agency_id, 1 from ra union all select 'calendar', service_id, 1 from rc
union all select 'calendar_dates', service_id, count(*) from rd group by service_id union all select 'transfers', from_stop_id, count(*) from tf group by from_stop_id""")
def _(t):
    kept = J.filter_feed(feed_tables(t))
    ids = {"routes": "route_id", "trips": "trip_id", "stop_times": "trip_id", "stops": "stop_id", "agency": "agency_id",
           "calendar": "service_id", "calendar_dates": "service_id", "transfers": "from_stop_id"}
    return union_feeds([kept[n].groupBy(F.col(c).alias("id")).agg(F.count("*").alias("n")).withColumn("tab", F.lit(n)) for n, c in ids.items()])


@query("set_01_used_stops", """select stop_id from b_stop_times union
select parent_station from b_stops where stop_id in (select stop_id from b_stop_times) and parent_station is not null and parent_station<>''""")
def _(t):
    return J.used_stops(t.stop_times, t.stops)


@query("set_02_union_feeds", "select trip_id, feed, cast(null as varchar) as d from b_trips union all select service_id, null, d from (select 'v'||cast(o_custkey%40 as varchar) service_id, o_orderpriority d from orders) q")
def _(t):
    second = t.orders.select(F.concat(F.lit("v"), (F.col("o_custkey") % 40).cast("string")).alias("trip_id"), F.col("o_orderpriority").alias("d"))
    return union_feeds([t.trips.select("trip_id", "feed"), second])


@query("src_02_merge_feeds", """select 'nl' feed, 'nl:'||trip_id trip_id, 'nl:'||route_id route_id, 'nl:'||service_id service_id, trip_short_name, trip_headsign, cast(null as varchar) shape_id from b_trips
union all select 'be', 'be:'||trip_id, 'be:'||route_id, null, trip_short_name, null, null from b_trips""")
def _(t):
    return merge_feeds({"nl": t.trips.drop("feed"), "be": t.trips.select("trip_id", "route_id", "trip_short_name")},
                       ["trip_id", "route_id", "service_id", "trip_short_name", "trip_headsign", "shape_id"])


@query("jn_02_assign_clusters", "select s.stop_id, p.cluster_id from b_stops s join b_stops p on p.stop_id=coalesce(s.parent_station, s.stop_id)")
def _(t):
    return J.assign_clusters(t.stops, t.stops.select(F.col("stop_id").alias("station_id"), "cluster_id"))


@query("jn_03_resolve_stops", """select u.trip_id, u.stop_sequence, u.stop_id, c.cluster_id cluster from (select trip_id, cast(stop_sequence as int) stop_sequence, stop_id, 'f'||cast(dep_s%3 as varchar) country from b_stop_times) u
 left join (select 'x'||substring(feed,2,1)||':'||stop_id stop_id, cluster_id from b_stops) c on c.stop_id='x'||substring(u.country,2,1)||':'||u.stop_id""")
def _(t):
    updates = t.sql("select trip_id, cast(stop_sequence as int) stop_sequence, stop_id, 'f'||cast(dep_s%3 as string) country from b_stop_times")
    known = t.sql("select 'x'||substring(feed,2,1)||':'||stop_id stop_id, cluster_id from b_stops")
    return J.resolve_stops(updates, known, {f"f{i}": f"x{i}" for i in range(5)}).drop("country")


META = """
 hd as (select t.trip_id, coalesce(nullif(t.trip_short_name,''), nullif(t.trip_headsign,''), nullif(r.route_short_name,''), t.trip_id) train_number, r.route_short_name route
   from b_trips t left join b_routes r on r.route_id=t.route_id),
 sq as (select st.trip_id, st.stop_sequence seq, st.arrival_time, st.departure_time, case when s.feed='f3' then null else s.cluster_id end cluster,
   case when s.feed='f3' then s.stop_name else coalesce(c.name, s.cluster_id) end name
   from b_clock_times st left join b_stops s on s.stop_id=st.stop_id left join b_clusters c on c.cluster_id=s.cluster_id),
 fr as (select *, case when lag(cluster) over (partition by trip_id order by seq)=cluster then 0 else 1 end fresh from sq),
 ps as (select *, sum(fresh) over (partition by trip_id order by seq) pos from fr),
 ms as (select trip_id, cast(pos as bigint) pos, min(cluster) cluster, arg_min(name, seq) name, arg_min_null(arrival_time, seq) arr, arg_max_null(departure_time, seq) dep from ps group by trip_id, pos)"""


def metadata_tables(t):
    return {"trips": t.trips, "routes": t.routes, "stop_times": t.clock_times, "stops": t.stops,
            "stop_cluster": t.stops.filter("feed<>'f3'").select("stop_id", "cluster_id"), "clusters": t.clusters}


def metadata(t):
    x = metadata_tables(t)
    return J.trip_metadata(x["trips"], x["routes"], x["stop_times"], x["stops"], x["stop_cluster"], x["clusters"])


@query("jn_04_trip_metadata", f"with {META} select m.*, h.train_number, h.route from ms m join hd h on h.trip_id=m.trip_id")
def _(t):
    m = metadata(t)
    return m["stops"].join(m["headers"], "trip_id")


@query("jn_05_service_days", f"with {SVC} select * from net")
def _(t):
    return J.service_days(t.calendar, t.calendar_dates, t.dates)


@query("jn_06_refine", """select h.trip_id, cast(h.seq as int) seq, coalesce(r.fine, h.segment) fine, coalesce(r.fraction, 1e0) fraction, cast(coalesce(r.ord,0) as int) ord
from (select *, least(a,b)||'|'||greatest(a,b) segment from b_hops) h left join b_refinement r on r.coarse=h.segment""")
def _(t):
    h = t.sql("select trip_id, cast(seq as int) seq, least(a,b)||'|'||greatest(a,b) segment from b_hops")
    return J.refine(h, t.refinement).drop("segment")


@query("jn_07_to_edges", "select s.seq, e.edge from b_seg_obs s join b_segment_edges e on e.segment=s.segment")
def _(t):
    return J.to_edges(t.seg_obs.select("seq", "segment"), t.segment_edges).select("seq", "edge")


DUP_EVENTS = "select st.trip_id, t.feed, s.cluster_id, st.dep_s from b_stop_times st join b_stops s on s.stop_id=st.stop_id join b_trips t on t.trip_id=st.trip_id"
# The same rows by number of the order: lines and orders meet on it, so lines are shuffled once. Of a line only the columns travel
# that decide its place, up to lines that are equal in all that is used, and stops are looked up by number of the supplier.
NUMBERED_EVENTS = """select st.trip_id, t.feed, s.cluster_id, st.dep_s
  from (select l_orderkey as trip_id, l_suppkey, cast(3600*(4+l_orderkey%20)+seq*900+(l_partkey%10)*60 as int) as dep_s
    from (select l_orderkey, l_suppkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey) as seq from lineitem) x) st
  join (select s_suppkey, 'c'||lpad(cast(s_nationkey as string),2,'0') as cluster_id from supplier) s on s.s_suppkey=st.l_suppkey
  join (select o_orderkey as trip_id, 'f'||cast(o_custkey%5 as string) as feed from orders) t on t.trip_id=st.trip_id"""
NUMBERED_TRIPS = "select o_orderkey as trip_id, 'v'||cast(o_custkey%40 as string) as service_id from orders"
# Departures lie on whole minutes: each is laid out over the five minutes it may meet, and equal minutes are counted.
DUPS = f"""
 call as (select *, dep_s//60 as mi from ({DUP_EVENTS}) q),
 wide as (select trip_id, feed, cluster_id, mi+k as mi from call, unnest([-2,-1,0,1,2]) o(k)),
 met as (select w.trip_id trip_a, c.trip_id trip_b, count(*) shared from wide w join call c using (cluster_id, mi) where w.feed<c.feed group by all),
 size as (select trip_id, count(*) n from call group by all),
 dup as (select m.*, x.n n_a, y.n n_b from met m join size x on x.trip_id=m.trip_a join size y on y.trip_id=m.trip_b
   where least(x.n, y.n)>1 and 5*m.shared>=4*least(x.n, y.n))"""


def named(number):
    """Numbers of orders as ids of trips."""
    return F.concat(F.lit("t"), number.cast("string"))


@query("jn_08_duplicate_trips", f"with {DUPS} select * from dup")
def _(t):
    return D.duplicate_trips(t.sql(NUMBERED_EVENTS), name=named)


@query("jn_09_duplicate_trips_by_day", f"""with {DUPS}, {SVC}
 select p.d, dup.* from dup join b_trips ta on ta.trip_id=trip_a join b_trips tb on tb.trip_id=trip_b
 join net p on p.service_id=ta.service_id join net q on q.service_id=tb.service_id and q.d=p.d""")
def _(t):
    days = J.service_days(t.calendar, t.calendar_dates, t.dates)
    return D.duplicate_trips_by_day(t.sql(NUMBERED_EVENTS), t.sql(NUMBERED_TRIPS), days, name=named)


@query("agg_18_duplicate_pair_counts", f"with {DUPS} select ta.feed||'<->'||tb.feed feed_pair, count(*) n from dup join b_trips ta on ta.trip_id=trip_a join b_trips tb on tb.trip_id=trip_b group by 1")
def _(t):
    return A.duplicate_pair_counts(D.duplicate_groups(t.sql(NUMBERED_EVENTS)))


TRAIN_ROWS = "select country||'|'||trip_id||'|'||service_date row_id, country, trip_id, first_ts, last_ts from b_trains"


@query("jn_10_attribute_passages", f"""with tr as ({TRAIN_ROWS}), p as (select seq, ts, country, trip_id from b_poll where event_type='purchase'),
 c as (select p.*, tr.row_id, greatest(tr.first_ts-p.ts, p.ts-tr.last_ts, 0) dist from p join tr on tr.country=p.country and tr.trip_id=p.trip_id)
 select seq, ts, country, trip_id, row_id from (select *, row_number() over (partition by seq order by dist, row_id) rn from c) q where rn=1""")
def _(t):
    passages = t.poll.filter("event_type='purchase'").select("seq", "ts", "country", "trip_id")
    return J.attribute_passages(passages, t.trains.withColumn("row_id", row_id()))


PLAN = """select 'x'||cast(seq as string) as stop_id, trip_id as head, ts as pt_arr, case when seq%3=0 then null else ts+60 end as pt_dep from (select seq, trip_id, case when seq%5=0 then null else ts end as ts from b_poll) q"""
CHANGES = "select 'x'||cast(seq as string) as stop_id from b_poll where event_type='error'"


@query("jn_15_synthesize_on_time", f"""with p as ({PLAN}) select stop_id, head, coalesce(pt_arr, pt_dep) event_ts, 0 delay_s from p
 where stop_id not in (select stop_id from ({CHANGES}) c) and coalesce(pt_arr, pt_dep) between {AS_OF}-2700 and {AS_OF}""")
def _(t):
    return J.synthesize_on_time(t.sql(PLAN), t.sql(CHANGES), AS_OF).select("stop_id", "head", "event_ts", "delay_s")


# planned closures of a source are those that no closure of another source covers
PLANNED = "select distinct edge from b_edge_groups where src='src1'"


@query("jn_16_uncovered_closures", f"select edge from ({PLANNED}) p except select edge from b_edge_groups where sev='closed' and src<>'src1'")
def _(t):
    return J.uncovered_closures(t.sql(PLANNED), t.edge_groups.filter("sev='closed' and src<>'src1'"))


STATUS_SQL = """
 col as (select edge, cast(max(delta_s) as int) p90, count(*) n from b_seg_obs s join b_segment_edges e on e.segment=s.segment group by edge),
 blk as (select distinct e.edge from b_cancels c join b_segment_edges e on e.segment=c.segment),
 wrk as (select edge, case max(case sev when 'closed' then 3 when 'intl' then 2 else 1 end) when 3 then 'closed' when 2 then 'intl' else 'reduced' end sev from b_edge_groups group by edge)"""


@query("jn_17_edge_status", f"""with {STATUS_SQL}
 select coalesce(col.edge, blk.edge, wrk.edge) edge, case when p90<60 then 0 when p90<=120 then 1 when p90<=600 then 2 when p90 is not null then 3 end "class", p90, n, blk.edge is not null blocked, wrk.sev severity
 from col full outer join blk on blk.edge=col.edge full outer join wrk on wrk.edge=coalesce(col.edge, blk.edge)""")
def _(t):
    from ballast.functions.geo import colour_class

    colours = t.sql("select edge, cast(max(delta_s) as int) p90, count(*) n from b_seg_obs s join b_segment_edges e on e.segment=s.segment group by edge")
    blocked = t.sql("select distinct e.edge from b_cancels c join b_segment_edges e on e.segment=c.segment")
    return J.edge_status(colours.withColumn("class", colour_class(F.col("p90"))), blocked, A.works_by_edge(t.edge_groups))


UIC_STOPS = "select s_suppkey k, 'stop_point:X:'||case when s_suppkey%4=0 then 'none' else (case s_nationkey%5 when 0 then '84' when 1 then '88' when 2 then '87' when 3 then '80' else '85' end)||lpad(cast(s_nationkey as string),5,'0') end||case when s_suppkey%2=0 then '6' else '' end as stop_id from supplier"


@query("jn_18_resolve_uic", f"""with s as ({UIC_STOPS}), m as (select *, regexp_extract(stop_id, '([0-9]{{7,8}})$', 1) u from s)
 select m.k, m.stop_id, coalesce(c1.cluster_id, c2.cluster_id) cluster from m left join b_clusters c1 on c1.uic=m.u left join b_clusters c2 on c2.uic=left(m.u, length(m.u)-1)""")
def _(t):
    return J.resolve_uic(t.sql(UIC_STOPS), t.clusters)


CODES = "select o_orderkey k, case when o_orderkey%2=0 then upper('code'||cast(o_custkey%25 as string)) end as station_code, case when o_orderkey%3=0 then (case o_custkey%25%5 when 0 then '84' when 1 then '88' when 2 then '87' when 3 then '80' else '85' end)||lpad(cast(o_custkey%25 as string),5,'0') end as uic_code from orders"
STATION_CODES = "select 'Code'||cast(n_nationkey as string) as stop_code, 'c'||lpad(cast(n_nationkey as string),2,'0') as cluster_id from nation where n_nationkey%4<>1"


@query("jn_19_resolve_station_code", f"""with o as ({CODES}), sc as ({STATION_CODES}) select o.*, coalesce(sc.cluster_id, c.cluster_id) cluster from o left join sc on lower(sc.stop_code)=lower(o.station_code) left join b_clusters c on c.uic=o.uic_code""")
def _(t):
    return J.resolve_station_code(t.sql(CODES), t.sql(STATION_CODES), t.clusters)


SECTION, CLOSED = "select distinct src as disruption_id, edge from b_edge_groups where sev<>'intl'", "select distinct src as disruption_id, edge from b_edge_groups where sev='closed'"


@query("set_03_split_edges", f"with s as ({SECTION}), c as ({CLOSED}) select s.*, exists(select 1 from c where c.disruption_id=s.disruption_id and c.edge=s.edge) closed from s")
def _(t):
    return J.split_edges(t.sql(SECTION), t.sql(CLOSED))


@query("set_04_all_train_keys", """with o as (select country, trip_id, service_date, count(*) n_obs from b_poll where event_type<>'error' group by 1,2,3), c as (select country, trip_id, service_date, count(*) n from b_cancels group by 1,2,3)
 select coalesce(o.country,c.country) country, coalesce(o.trip_id,c.trip_id) trip_id, coalesce(o.service_date,c.service_date) service_date, o.n_obs, c.n from o full outer join c on o.country=c.country and o.trip_id=c.trip_id and o.service_date=c.service_date""")
def _(t):
    keys = ["country", "trip_id", "service_date"]
    return J.all_train_keys(t.poll.filter("event_type<>'error'").groupBy(*keys).agg(F.count("*").alias("n_obs")), t.cancels.groupBy(*keys).agg(F.count("*").alias("n")))
