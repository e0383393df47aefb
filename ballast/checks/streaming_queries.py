"""Queries of the streams over ``events`` as a landing folder."""

import uuid

from pyspark.sql import functions as F

from ballast.operators.aggregates import rank_value
from ballast.operators.sequences import pair_deltas
from ballast.plans.snapshot import minute_snapshot
from ballast.registry import query
from ballast.session import checkpoint_root, cut_lineage
from ballast.streaming import changes as C
from ballast.streaming.snapshots import publish_snapshots, published
from ballast.streaming.trips import latest_slice, stream_planned, stream_trip_neighbours
from ballast.testbed import DIALECTS, VIEWS

MONTH = 1704067200
#: Beyond this instant a watermark may or may not have come; what timers and windows give out later is left aside.
CUT = MONTH + 29 * 86400
HOUR = 3600


def view_over(spark, events, view="b_poll"):
    """The poll view over a stream of events."""
    name = f"landed_{uuid.uuid4().hex}"
    events.createOrReplaceTempView(name)
    text = VIEWS[view].replace("from events", f"from {name}")
    for key, value in DIALECTS["spark"].items():
        text = text.replace("{" + key + "}", value)
    return spark.sql(text)


def poll(t):
    """The poll view over the files of ``events`` as a stream."""
    return view_over(t.spark, t.spark.readStream.schema(t.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir))


def seg_obs(t):
    return poll(t).select("seq", "ts", "country", "segment", "trip_id", F.col("delay_s").alias("delta_s"))


def stop_obs(t):
    return poll(t).select("seq", "ts", "country", "trip_id", "service_date", "cluster", "delay_s")


def changed(keys: str, value: str, more: str = "") -> str:
    return f"from (select *, lag({value}) over (partition by {keys} order by ts, seq) p, lag(ts) over (partition by {keys} order by ts, seq) pt from b_poll) q where (p is null or p<>{value}{more})"


SEGS = "select seq, ts, country, segment, trip_id, delay_s as delta_s "


@query("str_01_seg_changes", SEGS + changed("country, trip_id, segment", "delay_s"))
def _(t):
    return C.drained(C.stream_seg_changes(seg_obs(t), None))


@query("str_02_stop_changes", "select seq, ts, country, trip_id, service_date, cluster, delay_s " + changed("country, trip_id, service_date, cluster", "delay_s"))
def _(t):
    return C.drained(C.stream_stop_changes(stop_obs(t)))


@query("str_03_first_cancels", "select distinct country, trip_id, service_date, segment from b_cancels")
def _(t):
    return C.drained(C.stream_first_cancels(poll(t).filter("event_type='error'")))


# Cancels and passages as steps: at every instant at which one happens or a cancel leaves the window, how many trips count.
@query("str_04_blockade_stream", f"""with mo as (select segment, ts from b_cancels union select segment, ts from b_passages union select segment, ts+6*{HOUR}+1 from b_cancels),
 n as (select a.segment, a.ts, (select count(distinct c.trip_id) from b_cancels c where c.segment=a.segment and c.ts between a.ts-6*{HOUR} and a.ts
   and not exists (select 1 from b_passages p where p.segment=a.segment and p.ts>=c.ts and p.ts<=a.ts)) n_trips from mo a),
 s as (select *, n_trips>=2 blocked, coalesce(lag(n_trips>=2) over (partition by segment order by ts), false) was from n)
 select segment, ts, blocked, n_trips from s where blocked<>was and ts<{CUT}""")
def _(t):
    cancels, passages = poll(t).filter("event_type='error'"), poll(t).filter("event_type='purchase'")
    return C.drained(C.stream_blockades(cancels, passages, 6 * HOUR)).filter(F.col("ts") < CUT)


# Stops of a trip: the event's number gives the place along it, the cluster follows from the place.
def updates(t):
    return poll(t).selectExpr("seq", "ts", "trip_id as head", "cast(seq%13 as int) as idx", "'L'||trip_id as label", "'c'||lpad(cast(seq%13%9 as string),2,'0') as cluster",
                              "delay_s", "ts+cast(seq%7-3 as bigint)*600 as event_ts", "service_date", "event_type='error' as cancelled")


UPDATES = """u as (select seq, ts, trip_id as head, cast(seq%13 as int) as idx, 'L'||trip_id as label, 'c'||lpad(cast(seq%13%9 as string),2,'0') as cluster,
 delay_s, ts+cast(seq%7-3 as bigint)*600 as event_ts, service_date, event_type='error' as cancelled from b_poll)"""
# Of every earlier stop of the trip its last state, then the nearest index on either side.
NEAR = UPDATES + f""", seen as (select u.seq, u.ts, u.head, u.idx me, v.idx other, arg_max(v, v.seq) s from u join u v on v.head=u.head and v.seq<u.seq and v.idx<>u.idx where u.ts-v.ts<={{}} group by all),
 near as (select seq, min(case when other>me then other end) hi, max(case when other<me then other end) lo from seen group by seq),
 pr as (select u.seq, u.ts, u.head, u.label, s.s.idx idx, s.s.cluster cluster, s.s.delay_s delay_s, s.s.event_ts event_ts, s.s.service_date service_date, s.s.cancelled cancelled,
   u.idx next_idx, u.cluster next_cluster, u.delay_s next_delay_s, u.event_ts next_event_ts, u.service_date next_service_date, u.cancelled next_cancelled from near join u using (seq) join seen s on s.seq=u.seq and s.other=near.lo
  union all select u.seq, u.ts, u.head, u.label, u.idx, u.cluster, u.delay_s, u.event_ts, u.service_date, u.cancelled, s.s.idx, s.s.cluster, s.s.delay_s, s.s.event_ts, s.s.service_date, s.s.cancelled
   from near join u using (seq) join seen s on s.seq=u.seq and s.other=near.hi),
 pairs as (select * from pr where cluster<>next_cluster)"""


@query("str_05_trip_neighbours", "with " + NEAR.format(48 * HOUR) + " select * from pairs")
def _(t):
    return C.drained(stream_trip_neighbours(updates(t), 48 * HOUR))


@query("str_05_neighbour_deltas", "with " + NEAR.format(10**9) + """, pf as (select p.*, coalesce(r.fine, least(p.cluster,p.next_cluster)||'|'||greatest(p.cluster,p.next_cluster)) fine, coalesce(r.fraction, 1e0) fraction,
   next_delay_s-delay_s d from pairs p left join b_refinement r on r.coarse=least(p.cluster,p.next_cluster)||'|'||greatest(p.cluster,p.next_cluster))
 select 'deltas' kind, label trip_id, fine segment, cast(round_even(d*fraction,0) as int) delta_s, ts from pf where not cancelled and not next_cancelled and abs(d)<=7200
 union all select 'cancels', label, fine, null, ts from pf where cancelled and next_cancelled
 union all select 'passages', null, fine, null, ts from pf where not cancelled and not next_cancelled and abs(d)<=7200 and event_ts<=ts and next_event_ts<=ts""")
def _(t):
    out = pair_deltas(C.drained(stream_trip_neighbours(updates(t), None)), t.refinement)
    none_s, none_i = F.lit(None).cast("string").alias("trip_id"), F.lit(None).cast("int").alias("delta_s")
    deltas = out["deltas"].select(F.lit("deltas").alias("kind"), "trip_id", "segment", "delta_s", "ts")
    cancels = out["cancels"].select(F.lit("cancels").alias("kind"), "trip_id", "segment", none_i, "ts")
    return deltas.unionByName(cancels).unionByName(out["passages"].select(F.lit("passages").alias("kind"), none_s, "segment", none_i, "ts"))


@query("str_06_edge_windows", """with p as (select 60*(ts//60+k) as_of, e.edge, s.delta_s from b_seg_obs s join b_segment_edges e on e.segment=s.segment, unnest(generate_series(1,30)) o(k)),
 r as (select as_of, edge, delta_s, row_number() over (partition by as_of, edge order by delta_s)-1 no, count(*) over (partition by as_of, edge) n_obs from p)
 select as_of, edge, delta_s p90, n_obs from r where no=least(n_obs-1, 9*n_obs//10)""")
def _(t):
    panes = C.latest_panes(C.drained(C.stream_edge_panes(seg_obs(t), t.segment_edges), "update"))
    return rank_value(C.edge_windows(panes), ["as_of", "edge"], "delta_s")


@query("str_07_unseen_segments", SEGS + changed("country, trip_id, segment", "delay_s", f" or ts-pt>24*{HOUR}"))
def _(t):
    return C.drained(C.stream_seg_changes(seg_obs(t), 24 * HOUR))


@query("str_08_warm_start", SEGS + changed("country, trip_id, segment", "delay_s") + f" and ts>={MONTH + 15 * 86400}")
def _(t):
    known = t.sql(f"select country, trip_id, segment, max(ts) as ts, cast(max_by(delay_s, seq) as bigint) as delta_s from b_poll where ts<{MONTH + 15 * 86400} group by 1,2,3")
    return C.drained(C.stream_seg_changes(seg_obs(t).filter(F.col("ts") >= MONTH + 15 * 86400), None, known))


# Slices of planned times: every tenth event is one, for a station of fifteen; a later one of the same call replaces it.
CALL = "'e'||cast(seq%15 as string) as station, 'e'||cast(seq%15 as string)||'-'||cast(seq%4 as string) as stop_id"
SLICE = f"select seq as slice_seq, ts, {CALL}, ts+600 as pt_arr, ts+cast(delay_s as bigint) as pt_dep"


@query("str_09_planned_updates", f"""with u as (select seq, ts, {CALL}, delay_s from b_poll where seq%10<>3), p as ({SLICE} from b_poll where seq%10=3)
 select u.*, p.slice_seq, p.ts slice_ts, p.pt_arr, p.pt_dep from u left join p on p.station=u.station and p.stop_id=u.stop_id and p.ts<=u.ts and p.ts>=u.ts-3*{HOUR} where u.ts<{CUT}
 qualify row_number() over (partition by u.seq order by p.ts desc nulls last, p.slice_seq desc)=1""")
def _(t):
    ours = poll(t).filter("seq%10<>3").selectExpr("seq", "ts", *CALL.split(", "), "delay_s")
    slices = poll(t).filter("seq%10=3").selectExpr(*SLICE.removeprefix("select ").split(", "))
    return latest_slice(C.drained(stream_planned(ours, slices)).filter(F.col("ts") < CUT))


COVERAGE = "select country, 'on' as status, cast(count(*) as int) as age_s from b_poll group by country"
WORKS = "select distinct 'g'||cast(n_nationkey as string) as group_seq, 'src'||cast(n_regionkey as string) as src, case when n_nationkey%2=0 then 'closed' else 'reduced' end as sev, case when n_nationkey%3=0 then '20240131' end as until, n_name as txt, 'E'||cast(n_nationkey*2 as string) as edge from nation"
INCIDENTS = "select 'f'||cast(c_nationkey%5 as string) as country, cast(c_custkey as int) as alert_pos, c_mktsegment as cause, 'NO_SERVICE' as effect, c_name as txt, case when c_custkey%3<>0 then 40+c_custkey%7/2e0 end as lat, 5+c_custkey%9/4e0 as lon, 'c'||lpad(cast(c_nationkey as string),2,'0') as cluster from customer where c_custkey%10=1"
SHUT = "select service_date as d, cluster as edge, cast(min(h%24) as int) as hour_start, cast(max(h%24) as int) as hour_end from (select service_date, cluster, cast(floor(ts/3600) as bigint) h from b_poll) q group by service_date, cluster"
WIDE = 24 * HOUR


def snapshot_sql(instants: str) -> str:
    """The lines of a snapshot at each as_of of a view, in text."""
    return f"""with t as ({instants}), o as (select t.as_of, e.edge, s.delta_s, s.trip_id from t join b_seg_obs s on s.ts between t.as_of-{WIDE} and t.as_of join b_segment_edges e on e.segment=s.segment),
 r as (select *, row_number() over (partition by as_of, edge order by delta_s)-1 no, count(*) over (partition by as_of, edge) n from o), k as (select as_of, edge, count(distinct trip_id) n from o group by all),
 seg as (select r.as_of, r.edge, delta_s p90, k.n from r join k on k.as_of=r.as_of and k.edge=r.edge where no=least(r.n-1, 9*r.n//10)),
 lp as (select t.as_of, p.segment, max(p.ts) lp from t join b_passages p on p.ts between t.as_of-{WIDE} and t.as_of group by 1,2),
 bs as (select t.as_of, c.segment from t join b_cancels c on c.ts between t.as_of-{WIDE} and t.as_of left join lp on lp.as_of=t.as_of and lp.segment=c.segment where lp.lp is null or c.ts>lp.lp group by 1,2 having count(distinct c.trip_id)>=2),
 blk as (select distinct bs.as_of, e.edge from bs join b_segment_edges e on e.segment=bs.segment), wrk as ({WORKS}), shut as ({SHUT}), inc as ({INCIDENTS}), cov as ({COVERAGE}),
 loc as (select as_of, strftime(timezone('Europe/Amsterdam', to_timestamp(as_of)),'%Y%m%d') d, extract(hour from timezone('Europe/Amsterdam', to_timestamp(as_of))) h from t),
 pl as (select distinct a.as_of, c.edge from loc a join shut c on c.d=a.d and a.h between c.hour_start and c.hour_end where c.edge not in (select edge from wrk)),
 allw as (select as_of, '' group_seq, 'plan' src, 'closed' sev, null until, null txt, edge from pl union all select t.as_of, group_seq, src, sev, until, txt, edge from wrk, t)
 select as_of, 'coverage' section, country "key", '{{"status":"'||status||'","age_s":'||age_s||'}}' json from cov, t
 union all select as_of, 'seg', edge, '["'||edge||'",'||case when p90<60 then 0 when p90<=120 then 1 when p90<=600 then 2 else 3 end||','||p90||','||n||']' from seg
 union all select as_of, 'blk', edge, '{{"edge":"'||edge||'"}}' from blk
 union all select as_of, 'wrk', group_seq||':'||edge, '["'||src||'","'||sev||'",'||coalesce('"'||until||'"','null')||','||coalesce('"'||txt||'"','null')||',"'||edge||'"]' from allw
 union all select as_of, 'inc', country||':'||alert_pos, '{{"land":"'||country||'","cause":"'||cause||'","effect":"'||effect||'","txt":"'||txt||'","pos":['||cast(lon as double)||','||cast(lat as double)||'],"cluster":"'||cluster||'"}}' from inc, t where lat is not null"""


def statics(t) -> dict:
    return {"segment_edges": t.segment_edges, "closures": t.sql(SHUT), "works": t.sql(WORKS), "incidents": t.sql(INCIDENTS), "coverage": t.sql(COVERAGE)}


NOON = MONTH + 15 * 86400 + 43200


@query("job_02_minute_snapshot", snapshot_sql(f"select cast({NOON} as bigint) as_of"))
def _(t):
    lines = minute_snapshot(t.seg_obs, t.cancels, t.passages, as_of=NOON, delay_window_s=WIDE, blockade_window_s=WIDE, **statics(t))
    return lines.withColumn("as_of", F.lit(NOON).cast("long"))


@query("str_10_published_snapshots", snapshot_sql(f"select (max(ts)//60+1)*60 as_of from b_poll group by (ts-{MONTH})//(8*86400)"))
def _(t):
    folder = f"{checkpoint_root(t.spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    weeks = F.expr(f"(unix_timestamp(ts) - {MONTH}) div {8 * 86400}")
    for (week,) in t.table("events").select(weeks.alias("week")).na.drop().distinct().orderBy("week").collect():  # files land one after another, as polls do
        t.table("events").filter(weeks == week).coalesce(1).write.parquet(f"{folder}/landed/{week}")
    landed = t.spark.readStream.schema(t.table("events").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/landed/*")
    kind = F.expr("explode(filter(array('delta', case event_type when 'error' then 'cancel' when 'purchase' then 'passage' end), x -> x is not null))")
    rows = view_over(t.spark, landed).select(kind.alias("kind"), "seq", "ts", "segment", "trip_id", F.col("delay_s").alias("delta_s"))
    still = {name: cut_lineage(df) for name, df in statics(t).items()}  # every snapshot takes them
    publish_snapshots(rows, f"{folder}/out", still, delay_window_s=WIDE, blockade_window_s=WIDE).awaitTermination()
    return published(t.spark, f"{folder}/out")
