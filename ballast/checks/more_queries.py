"""Queries of reports, selections and closure parts that no other query shows alone."""

from pyspark.sql import functions as F

from ballast.checks.aggregate_queries import COUNTRIES, intl
from ballast.checks.join_queries import SVC
from ballast.checks.sequence_queries import PATTERNS, patterns
from ballast.functions.geo import segment_id
from ballast.functions.text import is_international, norm_station, normalize_name, severity
from ballast.functions.time import service_day
from ballast.operators import aggregates as A
from ballast.operators import joins as J
from ballast.operators.entities import fuzzy_station_match
from ballast.registry import query

STATIONS = "select feed||':'||stop_id as station_id, feed from b_stops"
CLUSTERED = "select feed||':'||stop_id as station_id, case when stop_code is null then 'nm:' else 'uic:' end||cluster_id as cluster_id from b_stops"


@query("agg_11_multi_feed_clusters", f"""with f as (select distinct c.cluster_id, s.feed from ({STATIONS}) s join ({CLUSTERED}) c using (station_id))
 select cluster_id, string_agg(feed, ',' order by feed) feeds, cast(count(*) as int) n_feeds from f group by 1""")
def _(t):
    return A.multi_feed_clusters(t.sql(STATIONS), t.sql(CLUSTERED))


@query("agg_12_uic_coverage", "select feed, round(100.0*count(stop_code)/count(*), 1)::double pct from b_stops group by 1")
def _(t):
    return A.uic_coverage(t.sql(STATIONS), t.sql(CLUSTERED)).withColumn("pct", F.col("pct").cast("double"))


@query("agg_13_trip_countries", """with c as (select distinct st.trip_id, k.country from b_stop_times st join b_stops s using (stop_id) join b_cluster_country k using (cluster_id))
 select c.trip_id, string_agg(country, '-' order by country) countries, any_value(t.feed) feed from c join b_trips t on t.trip_id=c.trip_id group by 1""")
def _(t):
    got = A.trip_countries(t.stop_times, t.stops.select("stop_id", "cluster_id"), t.cluster_country, t.trips)
    return got.withColumn("countries", F.array_join("countries", "-"))


RUNS = f"""with {SVC}, leaf as (select segment, segment as part from b_segments union select coarse, fine from b_refinement),
 day_run as (select distinct n.d, e.edge, cast(h.dep_s//3600 as bigint)%24 as "hour" from b_hops h join b_trips t on t.trip_id=h.trip_id join net n on n.service_id=t.service_id
   join leaf l on l.segment=least(h.a,h.b)||'|'||greatest(h.a,h.b) join b_segment_edges e on e.segment=l.part)"""


def served(t):
    days = J.service_days(t.calendar, t.calendar_dates, t.dates)
    return A.served_edge_hours(t.sql("select trip_id, a, b, dep_s from b_hops"), t.trips.select("trip_id", "service_id"), t.refinement, t.segment_edges, days)


@query("agg_10_served_edge_hours", RUNS + " select * from day_run")
def _(t):
    return served(t).select("d", "edge", "hour")


@query("agg_09_service_baseline", RUNS + """, total as (select daytype, count(*) total from b_dates group by 1)
 select edge, "hour", b.daytype, count(*) m, any_value(total) total from day_run r join b_dates b on b.d=r.d join total k on k.daytype=b.daytype group by all having 2*count(*)>any_value(k.total)""")
def _(t):
    days = J.service_days(t.calendar, t.calendar_dates, t.dates)
    masks = A.served_days(t.sql("select trip_id, a, b, dep_s from b_hops"), t.trips.select("trip_id", "service_id"), t.refinement, t.segment_edges, days, t.dates)
    return A.service_baseline(masks, t.dates).select("edge", "hour", "daytype", "m", "total")


TERMS = {"build": ["building", "auto"], "home": ["household"], "farm": ["machinery", "furniture"]}


@query("agg_16_checklist_coverage", COUNTRIES + f""", w(service, term) as (values {', '.join(f"('{s}','{x}')" for s, xs in TERMS.items() for x in xs)}),
 hit as (select distinct w.service, it.trip_id, it.feed from it join b_trips t on t.trip_id=it.trip_id join b_routes r on r.route_id=t.route_id join w on contains(lower(r.route_short_name), w.term))
 select service, {', '.join(f"count(*) filter (feed='f{i}') f{i}" for i in range(5))} from hit group by 1""")
def _(t):
    with_route = intl(t).join(t.trips.select("trip_id", "route_id"), "trip_id")
    return A.checklist_coverage(with_route, t.routes.drop("feed"), t.agency, TERMS, [f"f{i}" for i in range(5)])


@query("top_01_top_series", COUNTRIES + """, c as (select it.corridor, it.feed, g.agency_name||' / '||r.route_short_name series, count(*) n
  from it join b_trips t on t.trip_id=it.trip_id join b_routes r on r.route_id=t.route_id join b_agency g on g.agency_id=r.agency_id group by all)
 select *, cast(row_number() over (partition by corridor, feed order by n desc, series) as int) "rank" from c qualify "rank"<=8""")
def _(t):
    return A.top_series(intl(t).join(t.trips.select("trip_id", "route_id"), "trip_id"), t.routes, t.agency, 8)


@query("top_02_busiest_stations", PATTERNS + """, f as (select cluster cluster_id, cast(sum(n_trips) as bigint) n_trips from pos group by 1)
 select cluster_id, n_trips from f order by n_trips desc, cluster_id limit 10""")
def _(t):
    return A.busiest_stations(A.station_frequency(patterns(t), 8), 10).select("cluster_id", "n_trips")


@query("win_13_order_trains", """select country, trip_id, service_date, delay_s, last_ts from b_trains""")
def _(t):
    return A.order_trains(t.trains, "delay_s").select("country", "trip_id", "service_date", "delay_s", "last_ts")


POLLS = "select country, case when event_type='click' then ts end as ok_ts from b_poll"
SOURCES = "select 'f'||cast(n_nationkey as string) as country, n_nationkey%4<>1 as enabled, 'no key' as off_status, n_nationkey%3=0 as partial from nation"


@query("agg_22_source_coverage", f"""with p as (select country, max(ok_ts) ok from ({POLLS}) q group by 1),
 j as (select s.country, case when not enabled then off_status when ok is null then 'wait' when partial then 'partial' else 'ok' end status, 1706659200-ok age from ({SOURCES}) s left join p on p.country=s.country)
 select country, status, case when status in ('ok','partial') then age end age_s, case when status in ('ok','partial') and age>300 then 'stale' else status end shown from j""")
def _(t):
    return A.source_coverage(t.sql(POLLS), t.sql(SOURCES), 1706659200)


NODES = "select segment, cast(row_number() over (partition by segment order by ts, seq) as int) as pos, cluster as node_id from b_poll"


@query("agg_23_edge_cover", f"""with n as ({NODES}), p as (select segment, node_id a, lead(node_id) over (partition by segment order by pos) b from n)
 select distinct least(a,b) u, greatest(a,b) v, segment from p where b is not null and a<>b""")
def _(t):
    return A.edge_cover(t.sql(NODES))


@query("fn_02_norm_station", r"select s_suppkey k, trim(regexp_replace(regexp_replace(lower(stop_name), '\b(hbf|station)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) name_key from supplier join b_stops on stop_id='s'||s_suppkey")
def _(t):
    return t.stops.select(F.substring("stop_id", 2, 20).cast("bigint").alias("k"), norm_station(F.col("stop_name")).alias("name_key"))


@query("fn_01_normalize_name", "select stop_id, trim(replace(lower(stop_name), '-', ' ')) name_key from b_stops")
def _(t):
    return t.stops.select("stop_id", normalize_name(F.col("stop_name")).alias("name_key"))


@query("fn_06_segment_id", "select distinct case when a<b then a||'|'||b else b||'|'||a end segment from b_hops")
def _(t):
    return t.hops.select(segment_id(F.col("a"), F.col("b")).alias("segment")).distinct()


@query("fn_14_severity", "select group_seq, case when sev='closed' then 'closed' when txt='1-URGENT' then 'intl' else 'reduced' end sev from b_edge_groups")
def _(t):
    return t.edge_groups.select("group_seq", severity(F.col("sev") == "closed", F.col("txt") == "1-URGENT").alias("sev"))


@query("snk_02_service_day", "select distinct service_date, cast(strptime(service_date, '%Y%m%d') as date) d from b_stop_obs")
def _(t):
    return t.stop_obs.select("service_date", service_day(F.col("service_date")).alias("d")).distinct()


@query("flt_10_international_texts", "select o_orderkey, regexp_matches(o_orderpriority||' internationale dienstregeling'[1:o_orderkey%40], 'internationale dienstregeling') intl from orders")
def _(t):
    text = F.expr("concat(o_orderpriority, left(' internationale dienstregeling', cast(o_orderkey % 40 as int)))")
    return t.orders.select("o_orderkey", is_international(text).alias("intl"))


KINDS = "select p_type as name, min(p_partkey) as id from part group by p_type"
TURNED = "select substr(p_type, instr(p_type, ' ')+1) as name, min(p_partkey) as id from part group by 1"


@query("fn_17_fuzzy_station_match", f"""with l as ({TURNED}), r as ({KINDS}), c as (select *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') k from r),
 p as (select l.id, l.name, c.id match_id, c.name match_name, 1-levenshtein(replace(lower(l.name), ' ', ''), c.k)/greatest(length(replace(l.name, ' ', '')), length(c.k))::double similarity from l cross join c)
 select * from p where similarity>=0.5 qualify row_number() over (partition by id, name order by similarity desc, match_name)=1""")
def _(t):
    return fuzzy_station_match(t.sql(TURNED), t.sql(KINDS))
