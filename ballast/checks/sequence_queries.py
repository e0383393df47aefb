"""Queries over stop order, updates and observation order."""

from pyspark.sql import functions as F

from ballast.operators import sequences as S
from ballast.registry import query

NOON = 1704067200


@query("win_01_hops", "select trip_id, cast(seq as int) seq, a, b, dep_s from b_hops")
def _(t):
    return S.hops(t.stop_times, t.stops)


@query("win_02_segments", "select a, b, segment from b_segments")
def _(t):
    return S.segments(S.hops(t.stop_times, t.stops))


@query("win_03_collapse_repeats", """
select trip_id, cast(seq as int) seq, cluster from (select st.trip_id, st.stop_sequence seq, s.cluster_id cluster,
  lag(s.cluster_id) over (partition by st.trip_id order by st.stop_sequence) p from b_stop_times st join b_stops s on s.stop_id=st.stop_id) q
where p is null or p<>cluster""")
def _(t):
    seq = S.stop_sequence(t.stop_times, t.stops).select("trip_id", "seq", "cluster")
    return S.collapse_repeats(seq, ["trip_id"], ["seq"], "cluster")


EXPLICIT = """
with ex as (select * from b_updates where stop_rel<>'SKIPPED' and delay_s is not null),
 pr as (select country, trip_id, stu_pos, cluster c1, delay_s d1, lead(cluster) over w c2, lead(delay_s) over w d2, lead(event_ts) over w event_ts
   from ex window w as (partition by country, trip_id order by stu_pos)),
 seg as (select *, least(c1,c2)||'|'||greatest(c1,c2) segment, d2-d1 delta from pr where c2 is not null and c1<>c2),
 fine as (select s.country, s.trip_id, s.stu_pos, cast(coalesce(r.ord,0) as int) ord, coalesce(r.fine, s.segment) fine,
   cast(round_even(s.delta*coalesce(r.fraction,1e0),0) as int) delta_s, s.event_ts from seg s left join b_refinement r on r.coarse=s.segment)
"""


@query("win_04_segment_deltas", EXPLICIT + "select * from fine")
def _(t):
    return S.segment_deltas(t.updates, t.refinement).drop("poll_ts", "service_date")


@query("win_05_realised_passages", EXPLICIT + f"""
select fine as segment, cast({NOON} as bigint) ts from fine where event_ts is null or event_ts<={NOON}""")
def _(t):
    return S.realised_passages(S.segment_deltas(t.updates, t.refinement), NOON)


@query("win_06_skipped_stretches", """
with pr as (select country, trip_id, service_date, poll_ts, cluster, stop_rel, lag(cluster) over w pc, lag(stop_rel) over w pr
   from b_updates window w as (partition by country, trip_id order by stu_pos)),
 seg as (select *, least(cluster,pc)||'|'||greatest(cluster,pc) segment from pr where stop_rel='SKIPPED' and pr='SKIPPED' and cluster<>pc)
select coalesce(r.fine, s.segment) segment, country, trip_id, service_date, poll_ts as ts from seg s left join b_refinement r on r.coarse=s.segment""")
def _(t):
    return S.skipped_stretches(t.updates, t.refinement)


@query("win_07_cancelled_trip_segments", """
select h.trip_id, o.service_date, coalesce(r.fine, least(a,b)||'|'||greatest(a,b)) segment
from b_hops h join (select distinct 't'||cast(o_orderkey as varchar) trip_id, '20240101' service_date from orders where o_orderstatus='F') o on o.trip_id=h.trip_id
left join b_refinement r on r.coarse=least(a,b)||'|'||greatest(a,b)""")
def _(t):
    off = t.sql("select distinct 't'||cast(o_orderkey as string) trip_id, '20240101' service_date from orders where o_orderstatus='F'")
    return S.cancelled_trip_segments(off, t.stop_times, t.stops, t.refinement)


STATE = """select trip_id as head, stu_pos as idx, 'L'||trip_id as label, cluster, coalesce(delay_s, 0) as delay_s,
 coalesce(event_ts, cast(1704067200 as bigint)) as event_ts, service_date, stop_rel='SKIPPED' as cancelled, poll_ts as seen_ts, cast(stu_pos as bigint) as seq from b_updates"""
NEIGHBOURS = f"""
with st as ({STATE}),
 pr as (select *, lead(cluster) over w c2, lead(delay_s) over w d2, lead(event_ts) over w e2, lead(cancelled) over w x2, lead(service_date) over w s2
   from st window w as (partition by head order by idx)),
 pf as (select pr.*, coalesce(r.fine, least(cluster,c2)||'|'||greatest(cluster,c2)) fine, coalesce(r.fraction,1e0) fraction
   from pr left join b_refinement r on r.coarse=least(cluster,c2)||'|'||greatest(cluster,c2) where c2 is not null and cluster<>c2)
"""


@query("win_08_neighbour_deltas", NEIGHBOURS + f"""
select 'deltas' kind, label trip_id, fine segment, cast(round_even((d2-delay_s)*fraction,0) as int) delta_s from pf where not cancelled and not x2 and abs(d2-delay_s)<=7200
union all select 'cancels', label, fine, null from pf where cancelled and x2
union all select 'passages', null, fine, null from pf where not cancelled and not x2 and abs(d2-delay_s)<=7200 and event_ts<={NOON} and e2<={NOON}""")
def _(t):
    out = S.neighbour_deltas(S.latest_stop_state(t.sql(STATE)), t.refinement, NOON)
    none_s, none_i = F.lit(None).cast("string").alias("trip_id"), F.lit(None).cast("int").alias("delta_s")
    return (
        out["deltas"].select(F.lit("deltas").alias("kind"), "trip_id", "segment", "delta_s")
        .unionByName(out["cancels"].select(F.lit("cancels").alias("kind"), "trip_id", "segment", none_i))
        .unionByName(out["passages"].select(F.lit("passages").alias("kind"), none_s, "segment", none_i))
    )


CANDIDATES = "select service_date d, cluster edge, cast(floor(ts/3600) as bigint)%24 \"hour\" from b_poll"


@query("win_09_closed_runs", f"""
with c as (select distinct * from ({CANDIDATES}) q), i as (select *, "hour"-row_number() over (partition by d, edge order by "hour") g from c)
select d, edge, cast(min("hour") as int) hour_start, cast(max("hour") as int) hour_end from i group by d, edge, g having count(*)>=2""")
def _(t):
    return S.closed_runs(t.sql(CANDIDATES.replace('"', "`")).distinct(), 2)


IMPACTED = """select trip_id as disruption_id, 0 as object_no, stu_pos as stop_no, case when stop_rel='SKIPPED' or delay_s is null then 'deleted' else 'unchanged' end as effect,
 case when delay_s=90 then null else cluster end as cluster from b_updates"""


@query("win_10_deleted_runs", f"""
with s as ({IMPACTED}), r as (select *, sum(case when effect='deleted' then 0 else 1 end) over (partition by disruption_id, object_no order by stop_no) run_no from s)
select disruption_id, object_no, cast(run_no as bigint) run_no, stop_no as pos, cluster from r where effect='deleted' and cluster is not null""")
def _(t):
    return S.deleted_runs(t.sql(IMPACTED))


@query("win_11_changes_only", """
select seq, ts, country, segment, trip_id, delta_s from (select *, lag(delta_s) over (partition by country, trip_id, segment order by seq) p from b_seg_obs) q where p is null or p<>delta_s""")
def _(t):
    return S.changes_only(t.seg_obs, ["country", "trip_id", "segment"], "delta_s", ["ts", "seq"])


PATTERNS = """
with c as (select trip_id, seq, cluster from (select st.trip_id, st.stop_sequence seq, s.cluster_id cluster,
   lag(s.cluster_id) over (partition by st.trip_id order by st.stop_sequence) p from b_stop_times st join b_stops s on s.stop_id=st.stop_id) q where p is null or p<>cluster),
 tp as (select trip_id, string_agg(cluster, '>' order by seq) pat, count(*) n from c group by trip_id having count(*)>=2),
 pt as (select pat, count(*) n_trips, min(trip_id) pattern_id from tp group by pat),
 pos as (select p.pattern_id, p.n_trips, cast(row_number() over (partition by p.pattern_id order by c.seq)-1 as int) pos, c.cluster from pt p join c on c.trip_id=p.pattern_id)
"""


def patterns(t):
    return S.trip_patterns(S.stop_sequence(t.stop_times, t.stops))


@query("agg_20_trip_patterns", PATTERNS + "select * from pos")
def _(t):
    return patterns(t)
