"""Queries of windows over observations, trains, closures and blockades."""

from pyspark.sql import functions as F

from ballast.checks.join_queries import SVC
from ballast.checks.sequence_queries import PATTERNS, patterns
from ballast.functions.geo import colour_class
from ballast.operators import aggregates as A
from ballast.operators.blockades import blocked_segments
from ballast.plans.closures import planned_closures
from ballast.registry import query

AS_OF, DAY = 1705000000, 86400
WEEK = 7 * DAY
POINTS = f"""
 pt as (select a.as_of, e.edge, s.delta_s, s.trip_id, s.ts, s.seq from b_noons a join b_seg_obs s on s.ts between a.as_of-{WEEK} and a.as_of join b_segment_edges e on e.segment=s.segment)"""
RANK = "list_sort(list({0}))[1 + least(count(*)-1, 9*count(*)//10)]"


@query("agg_01_edge_delay_window", f"""with {POINTS}, g as (select as_of, edge, {RANK.format('delta_s')} p90, count(*) n_obs, count(distinct trip_id) n_trains from pt group by as_of, edge)
 select *, case when p90<60 then 0 when p90<=120 then 1 when p90<=600 then 2 else 3 end "class" from g""")
def _(t):
    window = A.edge_delay_window(t.seg_obs, t.segment_edges, t.noons, WEEK)
    return window.withColumn("class", colour_class(F.col("p90")))


@query("agg_02_edge_delay_by_train", f"""with {POINTS}, l as (select as_of, edge, trip_id, arg_max(delta_s, seq) d from pt group by 1,2,3)
 select as_of, edge, {RANK.format('d')} p90, count(*) n_trains from l group by as_of, edge""")
def _(t):
    return A.edge_delay_by_train(t.seg_obs, t.segment_edges, t.noons, WEEK)


@query("agg_03_colour_class", """select seq, case when delta_s<60 then 0 when delta_s<=120 then 1 when delta_s<=600 then 2 else 3 end "class" from b_seg_obs""")
def _(t):
    return t.seg_obs.select("seq", colour_class(F.col("delta_s")).alias("class"))


RECENT = f"ts>={AS_OF}-{WEEK}"


@query("agg_04_train_stats", f"select country, trip_id, service_date, min(ts) first_ts, count(*) n_obs from b_stop_obs where {RECENT} group by 1,2,3")
def _(t):
    return A.train_stats(t.stop_obs, AS_OF, WEEK)


@query("agg_05_latest_per_cluster", f"select country, trip_id, service_date, cluster, arg_max(delay_s, seq) delay_s, max(ts) ts, max(seq) seq from b_stop_obs where {RECENT} group by 1,2,3,4")
def _(t):
    return A.latest_per_cluster(t.stop_obs, AS_OF, WEEK)


@query("agg_06_cancel_stats", f"select country, trip_id, service_date, min(ts) first_ts, max(ts) last_ts, count(*) n from b_cancels where {RECENT} group by 1,2,3")
def _(t):
    return A.cancel_stats(t.cancels, AS_OF, WEEK)


@query("agg_07_edge_passages", f"select edge, country, trip_id, arg_max(delta_s, seq) delta_s, max(ts) ts from b_seg_obs s join b_segment_edges e on e.segment=s.segment where ts>={AS_OF}-{WEEK} group by 1,2,3")
def _(t):
    return A.edge_passages(t.seg_obs, t.segment_edges, AS_OF, WEEK)


@query("agg_08_edge_cancels", f"select edge, country, trip_id, service_date, min(ts) ts from b_cancels s join b_segment_edges e on e.segment=s.segment where {RECENT} group by 1,2,3,4")
def _(t):
    return A.edge_cancels(t.cancels, t.segment_edges, AS_OF, WEEK)


# From the full grid of dates, edges and hours: hours served on most dates of a kind, and not on this one.
CLOSED = f"""with {SVC},
 leaf as (select segment, segment as part from b_segments union select coarse, fine from b_refinement),
 run as (select distinct t.service_id, e.edge, cast(h.dep_s//3600 as bigint)%24 as hr from b_hops h join b_trips t on t.trip_id=h.trip_id
   join leaf l on l.segment=least(h.a,h.b)||'|'||greatest(h.a,h.b) join b_segment_edges e on e.segment=l.part),
 day_run as (select distinct n.d, r.edge, r.hr from net n join run r on r.service_id=n.service_id),
 grid as (select b.d, b.i, b.daytype, k.edge, k.hr, exists (from day_run x where x.d=b.d and x.edge=k.edge and x.hr=k.hr) as served
   from b_dates b cross join (select distinct edge, hr from day_run) k),
 habit as (select *, avg(served::int) over (partition by edge, hr, daytype)>0.5 as usual from grid),
 gap as (select d, edge, hr, coalesce(hr-lag(hr) over (partition by d, edge order by hr)<>1, true)::int as opens from habit where usual and not served and i<14),
 block as (select d, edge, hr, sum(opens) over (partition by d, edge order by hr) as no from gap)
 select d, edge, cast(min(hr) as int) hour_start, cast(max(hr) as int) hour_end from block group by d, edge, no having count(*)>1"""


@query("job_03_planned_closures", CLOSED)
def _(t):
    hops = t.sql("select trip_id, a, b, dep_s from b_hops")
    return planned_closures(hops, t.trips.select("trip_id", "service_id"), t.refinement, t.segment_edges, t.calendar, t.calendar_dates, t.dates)


@query("str_04_blocked_segments", f"""with lp as (select a.as_of, p.segment, max(p.ts) lp from b_noons a join b_passages p on p.ts<=a.as_of group by 1,2)
 select a.as_of, c.segment, count(distinct c.trip_id) n_trips from b_noons a join b_cancels c on c.ts<=a.as_of and a.as_of-c.ts<={DAY}
 left join lp on lp.as_of=a.as_of and lp.segment=c.segment where lp.lp is null or c.ts>lp.lp group by 1,2 having count(distinct c.trip_id)>=2""")
def _(t):
    return blocked_segments(t.cancels, t.passages, t.noons, DAY)


@query("agg_19_delay_histogram", """with k as (select delay_s/60 m from b_trains where delay_s is not null), b(bin_no, bin, lo, hi) as (values (0,'early',-1e9,0),(1,'0-1',0,1),(2,'1-2',1,2),(3,'2-5',2,5),(4,'5-10',5,10),(5,'10-20',10,20),(6,'20-60',20,60),(7,'>=60',60,1e9)),
 c as (select b.bin_no, b.bin, count(k.m) n from b left join k on k.m>=b.lo and k.m<b.hi group by 1,2)
 select bin_no, bin, n, cast(floor(100*n/greatest((select count(*) from k),1)+0.5) as bigint) pct from c""")
def _(t):
    return A.delay_histogram(t.trains)


@query("win_12_delay_percentile", """select country, trip_id, service_date, delay_s, case when delay_s is not null then cast(floor(100*cume_dist() over (partition by delay_s is null order by delay_s)+0.5) as int) end percentile from b_trains""")
def _(t):
    return A.delay_percentile(t.trains).select("country", "trip_id", "service_date", "delay_s", "percentile")


@query("agg_25_works_by_edge", """select edge, src, sev, until, txt from (select *, row_number() over (partition by edge order by case sev when 'closed' then 3 when 'intl' then 2 else 1 end desc, group_seq) rn from b_edge_groups) q where rn=1""")
def _(t):
    return A.works_by_edge(t.edge_groups)


@query("agg_21_station_frequency", PATTERNS + """, f as (select cluster cluster_id, cast(sum(n_trips) as bigint) n_trips from pos group by 1), r as (select *, cast(row_number() over (order by n_trips desc, cluster_id) as int) "rank" from f)
 select *, case when "rank"<=8 then 'A' else 'B' end tier from r""")
def _(t):
    return A.station_frequency(patterns(t), 8)


@query("top_03_freshest_keys", "select country, trip_id, max(ts) ts from b_poll group by 1,2 order by ts desc, country, trip_id limit 50")
def _(t):
    return A.freshest_keys(t.poll, ["country", "trip_id"], 50)


COUNTRIES = """with tc as (select st.trip_id, string_agg(distinct cc.country, '-' order by cc.country) corridor, count(distinct cc.country) n
 from b_stop_times st join b_stops s on s.stop_id=st.stop_id join b_cluster_country cc on cc.cluster_id=s.cluster_id group by 1), it as (select tc.trip_id, t.feed, tc.corridor from tc join b_trips t on t.trip_id=tc.trip_id where n>=2)"""


def intl(t):
    countries = A.trip_countries(t.stop_times, t.stops.select("stop_id", "cluster_id"), t.cluster_country, t.trips)
    return A.international_trips(countries)


@query("agg_14_international_trips", COUNTRIES + " select * from it")
def _(t):
    return intl(t)


@query("agg_15_corridor_matrix", COUNTRIES + " select corridor, " + ", ".join(f"count(*) filter (feed='f{i}') f{i}" for i in range(5)) + " from it group by corridor")
def _(t):
    return A.corridor_matrix(intl(t), [f"f{i}" for i in range(5)])
