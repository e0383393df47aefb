"""Queries of inspection details, station selection, reports, places and paths."""

import uuid

from pyspark.sql import functions as F

from ballast.checks.aggregate_queries import CLOSED
from ballast.checks.function_queries import AS_OF, TRAIN_ROWS, WEEK
from ballast.checks.join_queries import META, metadata, metadata_tables
from ballast.checks.sequence_queries import PATTERNS, patterns
from ballast.functions.geo import grid_cells
from ballast.operators import aggregates as A
from ballast.operators import filters as P
from ballast.operators import graphs as R
from ballast.operators import spatial as X
from ballast.plans import inspection as I
from ballast.plans.closures import planned_closures
from ballast.registry import query
from ballast.session import checkpoint_root, cut_lineage
from ballast.sinks import archive, export
from ballast.sinks.documents import artifact_lines, write_artifacts


def trains(t):
    keys = t.stop_obs.select("trip_id").union(t.cancels.select("trip_id"))
    return I.train_table(t.stop_obs, t.cancels, I.metadata_of(keys, metadata_tables(t)), t.clusters, AS_OF, WEEK)


# Planned calls with what was seen last at their cluster, then what was seen elsewhere in the order of time.
@query("job_05_train_details", f"""with {META}, k as (select distinct country, trip_id, service_date from b_stop_obs where ts>={AS_OF}-{WEEK} union select distinct country, trip_id, service_date from b_cancels where ts>={AS_OF}-{WEEK}),
 latest as (select * from b_stop_obs where ts>={AS_OF}-{WEEK} qualify row_number() over (partition by country, trip_id, service_date, cluster order by ts desc, seq desc)=1),
 pl as (select k.*, ms.pos, ms.cluster, ms.name, ms.arr, ms.dep from k join ms on ms.trip_id=k.trip_id),
 off as (select l.*, row_number() over (partition by country, trip_id, service_date order by ts, seq) n from latest l where not exists (select 1 from pl where pl.country=l.country and pl.trip_id=l.trip_id and pl.service_date=l.service_date and pl.cluster=l.cluster))
 select pl.country, pl.trip_id, pl.service_date, 0 part, pl.pos ord, pl.name, pl.arr, pl.dep, l.delay_s from pl left join latest l on l.country=pl.country and l.trip_id=pl.trip_id and l.service_date=pl.service_date and l.cluster=pl.cluster
 union all select country, trip_id, service_date, 1, n, coalesce(c.name, off.cluster), null, null, delay_s from off left join b_clusters c on c.cluster_id=off.cluster""")
def _(t):
    return I.train_details(trains(t), t.stop_obs, metadata(t), t.clusters, AS_OF, WEEK)


ACTIVITY = f""", tr as (select row_id, country, trip_id, service_date, first_ts, last_ts from tt),
 lp as (select e.edge, s.country, s.trip_id, arg_max(s.delta_s, s.seq) delta_s, max(s.ts) ts from b_seg_obs s join b_segment_edges e on e.segment=s.segment where s.ts>={AS_OF}-{WEEK} group by 1,2,3)"""


@query("job_06_edge_activity", f"""with tt as ({TRAIN_ROWS}){ACTIVITY},
 near as (select lp.edge, tr.row_id, lp.delta_s, lp.ts from lp join tr on tr.country=lp.country and tr.trip_id=lp.trip_id
   qualify row_number() over (partition by lp.edge, lp.country, lp.trip_id order by greatest(tr.first_ts-lp.ts, lp.ts-tr.last_ts, 0), tr.row_id)=1),
 off as (select e.edge, c.country||'|'||c.trip_id||'|'||c.service_date row_id, min(c.ts) ts from b_cancels c join b_segment_edges e on e.segment=c.segment where c.ts>={AS_OF}-{WEEK} group by 1,2)
 select 'passage' kind, edge, row_id, delta_s, ts from near union all select 'cancel', edge, row_id, null, ts from off""")
def _(t):
    out = I.edge_activity(t.seg_obs, t.cancels, t.segment_edges, trains(t), AS_OF, WEEK)
    none = F.lit(None).cast("int").alias("delta_s")
    return out["passages"].select(F.lit("passage").alias("kind"), "edge", "row_id", "delta_s", "ts").unionByName(
        out["cancels"].select(F.lit("cancel").alias("kind"), "edge", "row_id", none, "ts"))


# At an edge: trains of the window that passed it last in the window, or were cancelled over it.
@query("flt_13_visible_trains", f"""with tt as ({TRAIN_ROWS}){ACTIVITY},
 near as (select lp.edge, tr.row_id, lp.delta_s, lp.ts from lp join tr on tr.country=lp.country and tr.trip_id=lp.trip_id
   qualify row_number() over (partition by lp.edge, lp.country, lp.trip_id order by greatest(tr.first_ts-lp.ts, lp.ts-tr.last_ts, 0), tr.row_id)=1),
 off as (select e.edge, c.country||'|'||c.trip_id||'|'||c.service_date row_id, min(c.ts) ts from b_cancels c join b_segment_edges e on e.segment=c.segment where c.ts>={AS_OF}-{WEEK} group by 1,2)
 select tr.row_id, n.delta_s edge_delta, o.ts edge_cancel_ts from tr left join near n on n.row_id=tr.row_id and n.edge='E9' left join off o on o.row_id=tr.row_id and o.edge='E9' where n.row_id is not null or o.row_id is not null""")
def _(t):
    table = trains(t)
    out = I.edge_activity(t.seg_obs, t.cancels, t.segment_edges, table, AS_OF, WEEK)
    return P.visible_trains(table, out["passages"], out["cancels"], AS_OF, WEEK, "E9").select("row_id", "edge_delta", "edge_cancel_ts")


@query("snk_06_write_artifacts", f"""with tt as ({TRAIN_ROWS}){ACTIVITY},
 near as (select lp.edge, tr.row_id, lp.delta_s, lp.ts from lp join tr on tr.country=lp.country and tr.trip_id=lp.trip_id
   qualify row_number() over (partition by lp.edge, lp.country, lp.trip_id order by greatest(tr.first_ts-lp.ts, lp.ts-tr.last_ts, 0), tr.row_id)=1)
 select 'edges' "name", edge "key", '["'||row_id||'",'||delta_s||','||ts||']' json from near""")
def _(t):
    folder = f"{checkpoint_root(t.spark).rstrip('/')}/artifacts-{uuid.uuid4().hex}"
    table = cut_lineage(trains(t))  # read by all three kinds of lines
    out = I.edge_activity(t.seg_obs, t.cancels, t.segment_edges, table, AS_OF, WEEK)
    details = t.spark.createDataFrame([], "country string, trip_id string, service_date string, part int, ord long, name string, arr string, dep string, delay_s int")
    works = t.spark.createDataFrame([], "edge string, d string, hour_start int, hour_end int")
    write_artifacts(artifact_lines(table, details, out["passages"], out["cancels"], works), folder)
    return t.spark.read.schema("name string, key string, json string").json(folder).filter("name='edges'")


SELECTED = "select cluster_id from b_clusters where cluster_id in ('c03','c14')"
HUNDREDTH = "pattern_id like '%77'"
# Edges of every link of the patterns (each segment an edge of its own, so that some stay uncovered), and the outermost selected places.
LINKS = PATTERNS + f""", po as (select * from pos{{}}), ln as (select pattern_id, n_trips, pos, least(cluster, nx)||'|'||greatest(cluster, nx) segment from (select *, lead(cluster) over (partition by pattern_id order by pos) nx from po) q where nx is not null),
 le as (select distinct ln.pattern_id, ln.n_trips, ln.pos, coalesce(r.fine, ln.segment) edge from ln left join b_refinement r on r.coarse=ln.segment),
 sp as (select pattern_id, min(pos) lo, max(pos) hi from po where cluster in ({SELECTED}) group by 1), cov as (select distinct edge from le join sp using (pattern_id) where pos>=lo and pos<hi)"""


def selection(t, which="true"):
    # Few rows from all calls of all trips: they are worked out once.
    segments, refinement = cut_lineage(t.segments), cut_lineage(t.refinement)
    own = segments.select("segment", F.col("segment").alias("edge")).union(refinement.select("fine", "fine")).distinct()
    return patterns(t).filter(which), t.sql(SELECTED), A.pair_edges(segments, refinement, own)


@query("win_14_static_edge_coverage", LINKS.format(f" where {HUNDREDTH}") + " select edge from cov")
def _(t):
    return A.static_edge_coverage(*selection(t, HUNDREDTH))


@query("win_15_marginal_gain", LINKS.format(f" where {HUNDREDTH}") + f""" , re as (select p.pattern_id, p.cluster, min(p.pos) f, max(p.pos) l from po p where p.cluster not in ({SELECTED}) group by 1,2)
 select cluster cluster_id, count(distinct le.edge) gain from re join sp using (pattern_id) join le using (pattern_id) where ((le.pos>=f and le.pos<lo) or (le.pos>=hi and le.pos<l)) and le.edge not in (select edge from cov) group by 1""")
def _(t):
    return A.marginal_gain(*selection(t, HUNDREDTH))


@query("win_16_pattern_opening_value", LINKS.format("") + f""" select le.pattern_id, least(1e0, any_value(n_trips)*{A.COLOURED_MINUTES}/{A.SERVICE_MINUTES}::double)*count(distinct edge) "value" from le where pattern_id not in (select pattern_id from sp) and edge not in (select edge from cov) group by 1""")
def _(t):
    return A.pattern_opening_value(*selection(t))


GRID = "select cast(c_custkey as bigint) as node_id, 46e0+(c_custkey*7919%5300)/1e3 as lat, 2e0+(c_custkey*104729%7100)/1e3 as lon from customer"
METRES = "2*6371000e0*asin(sqrt(pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2)))"


@query("jn_12_snap_stations", f"""with n as ({GRID}), d as (select c.cluster_id, n.node_id, {METRES.format(a='c.lat', b='c.lon', c='n.lat', d='n.lon')} m from b_clusters c, n)
 select cluster_id, node_id, round(m, 3) dist_m from d where m<9000 qualify row_number() over (partition by cluster_id order by m, node_id)=1""")
def _(t):
    return X.snap_stations(t.clusters, t.sql(GRID), 9000.0).withColumn("dist_m", F.round("dist_m", 3))


SAMPLES = "select 'e'||cast(c_custkey%150 as string) as id, cast(c_custkey as bigint) as pos, 46e0+(c_custkey%150*7%40)/2e2+(c_custkey%11)/1e3 as lat, 5e0+(c_custkey%150*3%20)/2e2+(c_custkey%7)/1e3 as lon from customer"


@query("jn_13_overlapping_edges", f"""with s as ({SAMPLES}), n as (select id, count(*) n from s group by 1),
 h as (select a.id edge_a, b.id edge_b, count(distinct a.pos) h from s a join s b on a.id<b.id and {METRES.format(a='a.lat', b='a.lon', c='b.lat', d='b.lon')}<=150 group by 1,2)
 select edge_a, edge_b, h/n.n::double "share" from h join n on n.id=edge_a where h/n.n::double>=0.3""")
def _(t):
    return X.overlapping_edges(t.sql(SAMPLES), 150.0, 0.3)


# Countries as rings of a ragged star each; a point is inside where a ray to the east crosses an odd number of sides.
RINGS = """select 'N'||cast(r_regionkey as string) as country, 0 as ring, i as seq, 46e0+(r_regionkey*11%25)/5e0+sin(radians(i*30))*(2+(i%12*7%5)/4e0) as lat, 4e0+(r_regionkey*7%20)/4e0+cos(radians(i*30))*(2+(i%12*7%5)/4e0) as lon from region{each}"""
RINGS_SPARK = RINGS.replace("{each}", " lateral view explode(sequence(0, 12)) e as i")
RINGS_DUCK = RINGS.replace("{each}", ", unnest(generate_series(0, 12)) as e(i)")


@query("jn_14_cluster_country", f"""with g as ({RINGS_DUCK}), s as (select country, lat y1, lon x1, lead(lat) over (partition by country order by seq) y2, lead(lon) over (partition by country order by seq) x2 from g),
 h as (select c.cluster_id, s.country, count(*) n from b_clusters c join s on (s.y1>c.lat)<>(s.y2>c.lat) and c.lon<s.x1+(c.lat-s.y1)/(s.y2-s.y1)*(s.x2-s.x1) where c.uic is null group by 1,2),
 i as (select cluster_id, min(country) p from h where n%2=1 group by 1)
 select c.cluster_id, coalesce(case substr(c.uic,1,2) when '84' then 'NL' when '88' then 'BE' when '87' then 'FR' when '80' then 'DE' when '85' then 'CH' end, p, '??') country from b_clusters c left join i using (cluster_id)""")
def _(t):
    return X.cluster_country(t.clusters, t.sql(RINGS_SPARK))


@query("fn_19_grid_cells", f"with n as ({GRID}) select node_id, cast(floor((lat+5e-4)*250+0.5) as bigint) cell_y, cast(floor((lon+5e-4)*250+0.5) as bigint) cell_x from n")
def _(t):
    return grid_cells(t.sql(GRID).withColumns({c: F.col(c) + 5e-4 for c in ("lat", "lon")}), size=0.004).select("node_id", "cell_y", "cell_x")


@query("fn_18_sample_polyline", f"""with p as (select trip_id id, stop_sequence seq, stop_lat lat, stop_lon lon from b_stop_times st join b_stops s on s.stop_id=st.stop_id where s.stop_lat<>0 and st.trip_id like '%7'),
 n as (select *, lead(lat) over w lat2, lead(lon) over w lon2 from p window w as (partition by id order by seq)), l as (select *, {METRES.format(a='lat', b='lon', c='lat2', d='lon2')} m from n where lat2 is not null),
 a as (select *, coalesce(sum(m) over (partition by id order by seq rows between unbounded preceding and 1 preceding), 0) f from l),
 i as (select id, k pos, lat+(k*50000-f)/m*(lat2-lat) lat, lon+(k*50000-f)/m*(lon2-lon) lon from a, unnest(range(cast(ceil(f/50000) as bigint), cast(ceil((f+m)/50000) as bigint))) u(k) where m>0),
 e as (select p.id, cast(ceil(coalesce(t.len, 0)/50000) as bigint) pos, arg_max(p.lat, p.seq) lat, arg_max(p.lon, p.seq) lon from p left join (select id, sum(m) len from l group by 1) t using (id) group by p.id, t.len)
 select id, pos, round(lat, 6) lat, round(lon, 6) lon from (select * from i union all select * from e) q""")
def _(t):
    points = t.stop_times.join(t.stops, "stop_id").filter("stop_lat<>0 and trip_id like '%7'").select(F.col("trip_id").alias("id"), F.col("stop_sequence").alias("seq"), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    return X.sample_polyline(points, 50000.0).select("id", "pos", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("job_07_planned_works", f"""with c as ({CLOSED}) select edge, '['||string_agg('{{"d":"'||d||'","hour_start":'||hour_start||',"hour_end":'||hour_end||'}}', ',' order by d, hour_start)||']' blocks, count(*) n_blocks from c group by 1""")
def _(t):
    hops = t.sql("select trip_id, a, b, dep_s from b_hops")
    return I.planned_works(planned_closures(hops, t.trips.select("trip_id", "service_id"), t.refinement, t.segment_edges, t.calendar, t.calendar_dates, t.dates))


@query("snk_01_archive_completed_days", "select strftime(d, '%Y%m%d') \"day\", sum(s)::bigint seg_rows, sum(p)::bigint stop_rows from (select cast(to_timestamp(ts) at time zone 'UTC' as date) d, count(*) s, 0 p from b_seg_obs where ts<1706227200 group by 1 union all select cast(strptime(service_date, '%Y%m%d') as date), 0, count(*) from b_stop_obs where service_date<'20240126' group by 1) q where d<>date '2024-01-03' group by 1")
def _(t):
    folder = f"{checkpoint_root(t.spark).rstrip('/')}/archive-{uuid.uuid4().hex}"
    exported = t.spark.createDataFrame([("2024-01-03",)], "day string").select(F.to_date("day").alias("day"))
    archive.archive_completed_days(t.seg_obs, t.stop_obs, exported, 1706227200, folder)
    seg = t.spark.read.parquet(f"{folder}/seg").groupBy("day").agg(F.count("*").alias("seg_rows"))
    stops = t.spark.read.parquet(f"{folder}/stops").groupBy("day").agg(F.count("*").alias("stop_rows"))
    both = seg.join(stops, "day", "full_outer")
    return both.select(F.date_format("day", "yyyyMMdd").alias("day"), F.coalesce("seg_rows", F.lit(0)).alias("seg_rows"), F.coalesce("stop_rows", F.lit(0)).alias("stop_rows"))


@query("snk_03_export_dataset", """select "name", "format", n "rows" from (values ('stops', (select count(*) from b_stops)), ('routes', (select count(*) from b_routes))) v("name", n), (values ('csv'), ('parquet')) f("format")""")
def _(t):
    folder = f"{checkpoint_root(t.spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    return export.export_dataset({"stops": t.stops, "routes": t.routes}, folder).filter("bytes > 0").select("name", "format", "rows")


@query("snk_08_collect_metrics", """select 'read' stage, 'f1' feed, 'stops' metric, (select count(*) from b_stops where feed='f1') "value" union all select 'read', 'f1', 'trips', (select count(*) from b_trips where feed='f1')""")
def _(t):
    return export.collect_metrics([("read", "f1", "stops", t.stops.filter("feed='f1'")), ("read", "f1", "trips", t.trips.filter("feed='f1'"))])


@query("top_04_stratified_sample", "select sev, least(count(*), 5) n from b_edge_groups group by 1")
def _(t):
    return A.stratified_sample(t.edge_groups, "sev", "group_seq").groupBy("sev").agg(F.count("*").alias("n"))


@query("gr_03_bfs_paths", """with recursive g as (select distinct a u, b v from b_segments union select distinct b, a from b_segments), q as (select distinct a, 'c24' b from b_segments where a<>'c24'),
 w(s, n, hops) as (select a, a, 0 from q union select w.s, g.v, hops+1 from w join g on g.u=w.n where hops<24 and g.v<>w.s), d as (select s, n, min(hops) hops from w group by 1,2)
 select q.a||'>'||q.b pair_id, d.hops::bigint n from q join d on d.s=q.a and d.n=q.b""")
def _(t):
    graph = t.segments.selectExpr("a as u", "b as v").union(t.segments.selectExpr("b as u", "a as v")).distinct()
    pairs = t.segments.select("a").distinct().filter("a<>'c24'").select(F.concat_ws(">", "a", F.lit("c24")).alias("pair_id"), "a", F.lit("c24").alias("b"))
    return R.bfs_paths(pairs, graph).groupBy("pair_id").agg(F.count("*").alias("n"))


# Express segments down to leaves: each part that is express itself is opened in turn; shares by length.
PATHS = "select coarse as segment, ord as pos, fine as link from b_refinement"


@query("gr_02_expand_leaves", f"""with recursive p as ({PATHS}), e as (select segment coarse, link, [pos] trail from p union all select e.coarse, p.link, list_append(trail, p.pos) from e join p on p.segment=e.link),
 leaf as (select * from e where link not in (select segment from p)), w as (select *, 1000e0+ascii(substr(link,3,1))*10+ascii(substr(link,7,1)) w from leaf)
 select coarse, link fine, round(w/sum(w) over (partition by coarse), 9) fraction, cast(row_number() over (partition by coarse order by trail)-1 as int) ord from w""")
def _(t):
    parts = t.sql(PATHS)
    lengths = parts.select(F.col("link").alias("segment")).distinct().withColumn("w", 1000.0 + F.ascii(F.substring("segment", 3, 1)) * 10 + F.ascii(F.substring("segment", 7, 1)))
    return R.expand_leaves(parts, lengths).withColumn("fraction", F.round("fraction", 9))


CHAINS = "select 'k'||cast(c_custkey as string) as chain_id, i as pos, 'c'||lpad(cast((c_nationkey+i*i*(1+c_custkey%3))%25 as string),2,'0') as cluster from customer{each} where c_custkey%10=1"
CHAINS_SPARK, CHAINS_DUCK = CHAINS.replace("{each}", " lateral view explode(sequence(0, 3)) e as i"), CHAINS.replace("{each}", ", unnest(generate_series(0, 3)) as e(i)")


# Pairs with edges of their own, over their refinement; which of the others are bridged is left to the search.
@query("gr_04_chain_edges", f"""with c as ({CHAINS_DUCK}), l as (select chain_id, least(cluster, nx)||'|'||greatest(cluster, nx) segment from (select *, lead(cluster) over (partition by chain_id order by pos) nx from c) q where nx is not null and nx<>cluster)
 select distinct l.chain_id, e.edge from l left join b_refinement r on r.coarse=l.segment join b_segment_edges e on e.segment=coalesce(r.fine, l.segment)""")
def _(t):
    chains = t.sql(CHAINS_SPARK).select("chain_id", F.col("pos").cast("int").alias("pos"), "cluster")
    return R.chain_edges(chains, t.refinement, t.segment_edges)["edges"]


# A grid of ways, a row and a column for each of twelve nations; every node is a crossing, so each link joins two neighbours.
WAYS = "select 'r'||cast(n_nationkey as string) as way_id, transform(sequence(0, 11), j -> cast(n_nationkey*12+j as bigint)) as nodes from nation where n_nationkey<12 union all select 'k'||cast(n_nationkey as string), transform(sequence(0, 11), j -> cast(j*12+n_nationkey as bigint)) from nation where n_nationkey<12"
RAIL_NODES = "select cast(a.n_nationkey*12+b.n_nationkey as bigint) as node_id, 46e0+a.n_nationkey*3e-2+(a.n_nationkey*b.n_nationkey%7)*1e-3 as lat, 5e0+b.n_nationkey*4e-2+((a.n_nationkey+3)*(b.n_nationkey+5)%11)*1e-3 as lon from nation a join nation b on a.n_nationkey<12 and b.n_nationkey<12"
RAIL = f"""nd as ({RAIL_NODES}), wy as (select 'r'||i way, i*12+j a, i*12+j+1 b, j p from (select n_nationkey i from nation where n_nationkey<12) x, unnest(generate_series(0, 10)) u(j) union all select 'k'||i, j*12+i, (j+1)*12+i, j from (select n_nationkey i from nation where n_nationkey<12) x, unnest(generate_series(0, 10)) u(j)),
 lk as (select way, p, a, b, {METRES.format(a='x.lat', b='x.lon', c='y.lat', d='y.lon')} m from wy join nd x on x.node_id=a join nd y on y.node_id=b)"""


@query("gr_06_rail_links", f"with {RAIL} select a, b, round(m, 6) length_m from lk")
def _(t):
    return R.link_ends(R.rail_links(t.sql(RAIL_NODES), t.sql(WAYS))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("length_m", 6).alias("length_m"))


#: Clusters snapped to nodes of the grid.
SNAP = "select 'c'||lpad(cast(n_nationkey as string),2,'0') as cluster_id, cast((n_nationkey*7%12)*12+n_nationkey*5%11 as bigint) as node_id from nation"


# The least total by rounds over all nodes, as lengths; the route's own nodes are added up beside it.
@query("gr_07_route_pairs", f"""with recursive {RAIL}, arc as (select a u, b v, m from lk union all select b, a, m from lk), sn as ({SNAP}), pr as (select segment, x.node_id na, y.node_id nb from b_segments join sn x on x.cluster_id=a join sn y on y.cluster_id=b where b='c24'),
 d(segment, node, g) using key (segment, node) as (select segment, na, 0e0 from pr union select d.segment, arc.v, min(d.g+arc.m) from d join arc on arc.u=d.node left join recurring.d o on o.segment=d.segment and o.node=arc.v where o.g is null or d.g+arc.m<o.g-1e-9 group by 1, 2)
 select d.segment, round(d.g, 3) length_m from d join pr on pr.segment=d.segment and pr.nb=d.node""")
def _(t):
    nodes, snap = t.sql(RAIL_NODES), t.sql(SNAP)
    places = snap.join(nodes, "node_id").select("cluster_id", "lat", "lon")
    route = R.route_pairs(t.segments.filter("b='c24'"), R.rail_links(nodes, t.sql(WAYS)), snap, places)
    line = route.join(nodes, "node_id").select(F.col("segment").alias("id"), F.col("pos").alias("seq"), "lat", "lon")
    return A.polyline_length(line).select(F.col("id").alias("segment"), F.round("length_m", 3).alias("length_m"))


# Three tracks that share stretches: on the grid's rows, from a column on; each stretch run by the same ones is an edge.
RUNS = "select 's'||cast(n_nationkey%5 as string)||'x'||cast(n_regionkey as string) as segment, cast(i as int) as pos, cast(n_regionkey*100+i+n_nationkey%5*3 as bigint) as node_id from nation{each}"
RUNS_SPARK, RUNS_DUCK = RUNS.replace("{each}", " lateral view explode(sequence(0, 9)) e as i"), RUNS.replace("{each}", ", unnest(generate_series(0, 9)) as e(i)")


@query("gr_08_dissolve", f"""with p as (select distinct * from ({RUNS_DUCK})), s as (select node_id u, node_id+1 v, string_agg(segment, ',' order by segment) segs from p where pos<9 group by 1),
 b as (select *, case when lag(v) over (order by u)=u and lag(segs) over (order by u)=segs then 0 else 1 end fresh from s), k as (select *, sum(fresh) over (order by u) no from b)
 select min(u) first_node, max(v) last_node, count(*) links, any_value(segs) segments from k group by no""")
def _(t):
    out = R.dissolve(t.sql(RUNS_SPARK).distinct())
    line = out["geometry"].groupBy("edge").agg(F.min("node_id").alias("first_node"), F.max("node_id").alias("last_node"), (F.count("*") - 1).alias("links"))
    over = out["coverage"].groupBy("edge").agg(F.array_join(F.array_sort(F.collect_set("segment")), ",").alias("segments"))
    return line.join(over, "edge").drop("edge")


# Journeys: one ride, or two with a change; the earliest arrival of each number of rides that is better than fewer.
DAY_TIMES = "select st.trip_id, cast(st.stop_sequence as int) as seq, s.cluster_id as cluster, st.dep_s from b_stop_times st join b_stops s on s.stop_id=st.stop_id where st.trip_id like '%7'"
ASKS = "select 'q'||cast(n_nationkey as string) as query_id, 'c'||lpad(cast(n_nationkey as string),2,'0') as origin, 'c'||lpad(cast((n_nationkey+9)%25 as string),2,'0') as destination, 18000+n_nationkey*900 as depart_s from nation"


@query("gr_10_earliest_arrivals", f"""with s as ({DAY_TIMES}), q as ({ASKS}), one as (select q.query_id, b.cluster, min(b.dep_s) t from q join s a on a.cluster=q.origin and a.dep_s>=q.depart_s join s b on b.trip_id=a.trip_id and b.seq>a.seq group by 1,2),
 two as (select o.query_id, b.cluster, min(b.dep_s) t from one o join q on q.query_id=o.query_id join s a on a.cluster=o.cluster and a.dep_s>=o.t+300 join s b on b.trip_id=a.trip_id and b.seq>a.seq group by 1,2),
 k as (select query_id, 1 round, cluster, t from one union all select query_id, 2, cluster, t from two), g as (select k.query_id, k.round, k.t from k join q on q.query_id=k.query_id and q.destination=k.cluster)
 select query_id, cast(round as int) round, t arrival_s from g x where not exists (select 1 from g y where y.query_id=x.query_id and y.round<x.round and y.t<=x.t)""")
def _(t):
    from ballast.operators.journeys import earliest_arrivals

    return earliest_arrivals(t.sql(ASKS), t.sql(DAY_TIMES), 2)


@query("job_08_coverage_report", """with c as (select st.trip_id, string_agg(distinct k.country, '-' order by k.country) corridor, count(distinct k.country) n from b_stop_times st join b_stops s using (stop_id) join b_cluster_country k using (cluster_id) group by 1)
 select corridor, count(*) filter (t.feed='f0') f0, count(*) filter (t.feed='f1') f1, count(*) filter (t.feed='f2') f2 from c join b_trips t on t.trip_id=c.trip_id where c.n>1 group by 1""")
def _(t):
    from ballast.plans.reports import coverage_report

    feeds = ["f0", "f1", "f2"]
    report = coverage_report(t.stop_times, t.stops.select("stop_id", "cluster_id"), t.trips, t.routes.drop("feed"), t.agency, t.cluster_country, {"a": ["building"]}, feeds)
    return report["corridors"]


@query("ent_02_name_cell_groups", """select feed||':'||stop_id station_id, cast(floor(stop_lat*100+0.5) as bigint) cell_y, cast(floor(stop_lon*100+0.5) as bigint) cell_x, 'town '||nation name_key
 from (select *, regexp_extract(stop_name, '([0-9]+)', 1) nation from b_stops where stop_code is null) q""")
def _(t):
    from ballast.operators.entities import name_cell_groups

    stations = t.stops.select(F.concat_ws(":", "feed", "stop_id").alias("station_id"), "feed", "stop_name", "stop_code", F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    return name_cell_groups(stations).select("station_id", "cell_y", "cell_x", "name_key")


@query("agg_17_feed_profile", """select 'f1' feed, 'rows' metric, k "key", cast(n as varchar) "value" from (select 'routes' k, count(*) n from b_routes union all select 'trips', count(*) from b_trips union all select 'stops', count(*) from b_stops) q
 union all select 'f1', 'route_type', route_type, cast(count(*) as varchar) from b_routes group by route_type union all select 'f1', 'horizon', 'calendar', min(start_date)||'-'||max(end_date) from b_calendar""")
def _(t):
    tables = {"routes": t.routes, "trips": t.trips, "stops": t.stops, "calendar": t.calendar}
    return A.feed_profile(tables, "f1").filter("metric not like 'column%'")


@query("snk_04_append_observations", "select service_date \"day\", count(*) n, count(distinct seq) seqs from b_poll group by 1")
def _(t):
    from ballast.checks.streaming_queries import poll

    folder = f"{checkpoint_root(t.spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    archive.append_observations(poll(t).select("seq", "ts", "trip_id"), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    log = t.spark.read.parquet(f"{folder}/log")
    return log.groupBy(F.date_format(F.col("day").cast("date"), "yyyyMMdd").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("seq").alias("seqs"))
