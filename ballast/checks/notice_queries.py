"""Queries of decoding: alerts, station timetables, disruption notices, and what is made of their texts."""

from pyspark.sql import functions as F

from ballast.functions.text import closed_pairs, name_variants, preferred_text
from ballast.functions.time import iris_epoch, latest_end
from ballast.operators.filters import positioned_incidents
from ballast.plans import works as W
from ballast.registry import query
from ballast.sources import iris as I
from ballast.sources import notices as N
from ballast.sources.realtime import parse_alerts

#: Alerts out of events: numbered and named enumerations, texts of up to three languages, one or two informed stops.
ALERTS = """select country, ts as poll_ts, to_json(named_struct('entity', array(named_struct('alert', named_struct('cause', case seq%3 when 0 then '6' when 1 then 'STRIKE' end,
 'effect', case seq%4 when 0 then '1' when 1 then 'DETOUR' when 2 then '99' end,
 'header_text', named_struct('translation', case when seq%5=0 then array(named_struct('language', 'xx', 'text', 'only '||trip_id)) else array(named_struct('language', 'fr', 'text', 'fr '||trip_id), named_struct('language', 'en', 'text', 'en '||trip_id)) end),
 'informed_entity', array(named_struct('stop_id', 's'||cast(seq%30 as string)), named_struct('stop_id', cluster))))))) as payload from b_poll where event_type='signup'"""
CAUSE = "case seq%3 when 0 then 'ACCIDENT' when 1 then 'STRIKE' else 'UNKNOWN_CAUSE' end"
EFFECT = "case seq%4 when 0 then 'NO_SERVICE' when 1 then 'DETOUR' when 2 then '99' else 'UNKNOWN_EFFECT' end"
TEXT = "case when seq%5=0 then 'only '||trip_id else 'fr '||trip_id end"


def alerts(t):
    return parse_alerts(t.sql(ALERTS))


@query("src_04_parse_alerts", f"select country, ts poll_ts, 0 alert_pos, {CAUSE} cause, {EFFECT} effect, {TEXT} txt, 's'||(seq%30)||','||cluster stops from b_poll where event_type='signup'")
def _(t):
    return alerts(t).select("country", "poll_ts", "alert_pos", "cause", "effect", preferred_text(F.col("texts")).alias("txt"), F.array_join("stop_ids", ",").alias("stops"))


# The first informed stop that has a place; the second one is a cluster, which is no stop.
PLACED = f"""p as (select country, ts poll_ts, seq, {CAUSE} cause, {EFFECT} effect, {TEXT} txt, 's'||(seq%30) stop_id from b_poll where event_type='signup'),
 k as (select s.stop_id, c.cluster_id cluster, c.lat, c.lon from b_stops s join b_clusters c on c.cluster_id=s.cluster_id where c.uic is not null)"""


def places(t):
    return t.clusters.withColumns({c: F.when(F.col("uic").isNotNull(), F.col(c)) for c in ("lat", "lon")})


@query("top_05_alert_position", f"with {PLACED} select country, poll_ts, 0 alert_pos, cluster, lat, lon from p join k on k.stop_id=p.stop_id")
def _(t):
    return W.alert_position(alerts(t), t.stops.select("stop_id", "cluster_id"), places(t))


@query("job_10_incidents", f"with {PLACED} select country, poll_ts, 0 alert_pos, cause, effect, txt, cluster, lat, lon from p left join k on k.stop_id=p.stop_id")
def _(t):
    return W.incidents(alerts(t), t.stops.select("stop_id", "cluster_id"), places(t))


@query("flt_11_positioned_incidents", f"with {PLACED} select country, poll_ts, cluster from p join k on k.stop_id=p.stop_id")
def _(t):
    return positioned_incidents(W.incidents(alerts(t), t.stops.select("stop_id", "cluster_id"), places(t))).select("country", "poll_ts", "cluster")


# Station timetables: each order is a train's call at one station, with planned path, label and times.
HEAD = "'-'||cast(o_orderkey as string)||'-24'||lpad(cast(1+o_custkey%12 as string),2,'0')||lpad(cast(1+o_orderkey%26 as string),2,'0')||'0715'"
IDENT = f"{HEAD}||'-'||cast(o_orderkey%9 as string)"
ARR = "'24'||lpad(cast(1+o_custkey%12 as string),2,'0')||lpad(cast(1+o_orderkey%26 as string),2,'0')||lpad(cast(o_orderkey%24 as string),2,'0')||lpad(cast(o_custkey%60 as string),2,'0')"
NEW = ARR.replace("o_custkey%60", "59")
PLAN_XML = f"""select '<timetable station="Ort '||cast(o_custkey%7 as string)||'"><s id="'||{IDENT}||'">'||case when o_orderkey%4=0 then '' else '<tl c="RE" n="'||cast(o_custkey as string)||'"/>' end||
 case when o_orderkey%3=0 then '' else '<ar pt="'||{ARR}||'" ppth="A|B"/>' end||case when o_orderkey%5=0 then '' else '<dp pt="'||{ARR}||'" ppth="Y"/>' end||'</s></timetable>' as payload from orders"""
AT = f"cast(epoch(timezone('Europe/Berlin', strptime({ARR}, '%y%m%d%H%M'))) as bigint)"
THEN = AT.replace("o_custkey%60", "59")


@query("src_05_parse_iris_plan", f"""select 'Ort '||(o_custkey%7) station, {IDENT} stop_id, {HEAD} head, cast(o_orderkey%9 as int) idx, '20'||substr({ARR},1,6) service_date, case when o_orderkey%4<>0 then 'RE '||o_custkey end as "label",
 case when o_orderkey%3<>0 then {AT} end pt_arr, case when o_orderkey%5<>0 then {AT} end pt_dep,
 case when o_orderkey%3<>0 then 'A|B|Ort '||(o_custkey%7)||case when o_orderkey%5<>0 then '|Y' else '' end end as "path" from orders""")
def _(t):
    return I.parse_iris_plan(t.sql(PLAN_XML)).withColumn("path", F.array_join("path", "|"))


@query("src_07_split_iris_stop_id", f"select o_orderkey, case when o_orderkey%6<>0 then {HEAD} end head, case when o_orderkey%6<>0 then cast(o_orderkey%9 as int) end idx, case when o_orderkey%6<>0 then '20'||substr({ARR},1,6) end service_date from orders")
def _(t):
    ident = t.sql(f"select o_orderkey, case when o_orderkey%6=0 then {HEAD}||'-x' else {IDENT} end as i from orders")
    return ident.select("o_orderkey", I.split_iris_stop_id(F.col("i")).alias("s")).select("o_orderkey", "s.head", "s.idx", "s.service_date")


CHANGES_XML = f"""select '<timetable><s id="'||{IDENT}||'">'||case o_orderkey%4 when 0 then '<ar ct="'||{NEW}||'"/>' when 1 then '<ar cs="c"/>' when 2 then '<ar cs="c"/><dp ct="'||{NEW}||'"/>' else '<dp pt="'||{ARR}||'" cs="c"/>' end||'</s></timetable>' as payload from orders"""
# Arrival first, planned times from the plan; a changed departure overrides a cancelled arrival.
CHANGED = f"""c as (select {IDENT} stop_id, {HEAD} head, cast(o_orderkey%9 as int) idx, '20'||substr({ARR},1,6) service_date, o_orderkey%4 k, {THEN} fresh, {AT} pl,
  case when o_orderkey%3<>0 then {AT} end pa, case when o_orderkey%5<>0 then {AT} end pd from orders),
 e as (select *, case k when 0 then pa when 1 then pa when 2 then coalesce(pd, pa) else pl end event_ts, case when k=0 and pa is not null then fresh-pa when k=2 and pd is not null then fresh-pd when k=0 then null else 0 end delay, k<>0 and not (k=2 and pd is not null) off from c)"""


@query("src_06_parse_iris_changes", f"with {CHANGED} select stop_id, head, idx, service_date, cast(delay as int) delay_s, event_ts, off cancelled from e where event_ts is not null and delay is not null")
def _(t):
    return I.parse_iris_changes(t.sql(CHANGES_XML), I.parse_iris_plan(t.sql(PLAN_XML)))


@query("fn_07_iris_epoch", f"select o_orderkey, case when o_orderkey%7=0 then null else {AT} end ts from orders")
def _(t):
    return t.sql(f"select o_orderkey, case o_orderkey%14 when 0 then '2413992575' when 7 then 'x' else {ARR} end as c from orders").select("o_orderkey", iris_epoch(F.col("c")).alias("ts"))


# Notices: two sections of two or three stations, two spans of which one may hold the instant, a text that names a closed stretch.
NOON = "2024-01-15T12:00:00+0100"
SECTIONS = """select o_orderkey as disruption_id, to_json(named_struct('type', case o_orderkey%3 when 0 then 'MAINTENANCE' when 1 then 'DISRUPTION' else 'CALAMITY' end, 'isActive', o_orderkey%5<>0, 'title', 'T'||cast(o_custkey as string),
 'start', '2024-01-01T00:00:00+0100', 'end', case when o_orderkey%4=0 then '' else '2024-02-0'||cast(1+o_orderkey%9 as string)||'T10:00:00+0100' end,
 'timespans', case when o_orderkey%6=0 then null else array(named_struct('start', '2024-01-0'||cast(1+o_orderkey%9 as string)||'T00:00:00+0100', 'end', '2024-01-'||cast(11+o_orderkey%9 as string)||'T00:00:00+0100', 'situation',
   named_struct('label', 'Tussen A'||cast(o_custkey%5 as string)||' en B'||cast(o_custkey%3 as string)||' rijden er '||case when o_orderkey%2=0 then 'geen treinen' else 'minder treinen' end)),
   named_struct('start', '', 'end', '', 'situation', named_struct('label', 'nooit'))) end,
 'publicationSections', array(named_struct('section', named_struct('stations', array(named_struct('stationCode', 'X'||cast(o_custkey%25 as string), 'uicCode', cast(8400000+o_custkey%25 as string), 'countryCode', 'NL'),
   named_struct('stationCode', 'Y', 'uicCode', '', 'countryCode', 'D'))))))) as payload from orders"""


@query("src_08_parse_disruptions", """select o_orderkey disruption_id, case o_orderkey%3 when 0 then 'MAINTENANCE' when 1 then 'DISRUPTION' else 'CALAMITY' end "type", o_orderkey%5<>0 is_active, 'T'||o_custkey title,
 case when o_orderkey%6=0 then -1 else 2 end n_spans, cast(p as int) pos, case when p=0 then 'X'||(o_custkey%25) else 'Y' end station_code, case when p=0 then 'NL' else 'D' end country_code from orders, unnest([0,1]) u(p)""")
def _(t):
    parsed = N.parse_disruptions(t.sql(SECTIONS), "sections")
    facts = parsed.select("disruption_id", "type", "is_active", "title", F.coalesce(F.size("timespans"), F.lit(-1)).alias("n_spans"))
    return facts.join(N.section_stations(parsed), "disruption_id").select(*facts.columns, "pos", "station_code", "country_code")


SITUATION = "'Tussen A'||(o_custkey%5)||' en B'||(o_custkey%3)||' rijden er '||case when o_orderkey%2=0 then 'geen treinen' else 'minder treinen' end"
CURRENT = f"""select o_orderkey disruption_id, case when o_orderkey%6=0 then 'T'||o_custkey else {SITUATION} end situation from orders
 where (o_orderkey%6=0 and (o_orderkey%4=0 or 1+o_orderkey%9>=1)) or (o_orderkey%6<>0 and 11+o_orderkey%9>=16)"""


@query("flt_09_current_situations", CURRENT)
def _(t):
    return N.current_situations(N.parse_disruptions(t.sql(SECTIONS), "sections"), 1705316400)  # noon of 15 January in Amsterdam


@query("fn_13_closed_pairs", f"with c as ({CURRENT}) select disruption_id, 'A'||(o_custkey%5) a, 'B'||(o_custkey%3) b from c join orders on o_orderkey=disruption_id where o_orderkey%6<>0 and o_orderkey%2=0")
def _(t):
    texts = N.current_situations(N.parse_disruptions(t.sql(SECTIONS), "sections"), 1705316400)
    return texts.select("disruption_id", F.explode(closed_pairs(F.col("situation"))).alias("x")).select("disruption_id", "x.a", "x.b")


@query("fn_11_preferred_text", f"select seq, {TEXT} txt, substr({TEXT}, 1, 4) lead from b_poll where event_type='signup'")
def _(t):
    texts = t.sql("select seq, trip_id from b_poll where event_type='signup'").withColumn("texts", F.expr(
        "case when seq%5=0 then array(named_struct('lang', 'xx', 'text', 'only '||trip_id)) else array(named_struct('lang', 'en', 'text', 'en '||trip_id), named_struct('lang', 'fr', 'text', 'old'), named_struct('lang', 'fr', 'text', 'fr '||trip_id)) end"))
    return texts.select("seq", preferred_text(F.col("texts")).alias("txt"), preferred_text(F.col("texts"), length=4).alias("lead"))


ENDS = "case o_orderkey%4 when 0 then [] when 1 then ['2024010'||(1+o_orderkey%9)||'T101500', ''] when 2 then ['20240715T235900', '2024010'||(1+o_orderkey%9)||'T101500'] else ['20240101T000000', 'soon'] end"


@query("fn_15_latest_end", f"select o_orderkey, case o_orderkey%4 when 1 then '2024-01-0'||(1+o_orderkey%9)||' 10:15' when 2 then '2024-07-15 23:59' end until from orders")
def _(t):
    ends = "case o_orderkey%4 when 0 then array() when 1 then array('2024010'||cast(1+o_orderkey%9 as string)||'T101500', '') when 2 then array('20240715T235900', '2024010'||cast(1+o_orderkey%9 as string)||'T101500') else array('20240101T000000', 'soon') end"
    return t.sql(f"select o_orderkey, {ends} as e from orders").select("o_orderkey", latest_end(F.col("e")).alias("until"))


@query("fn_16_name_variants", """with n as (select s_suppkey k, 'Ort'||(s_nationkey) o, s_suppkey%3 m from supplier),
 v as (select k, unnest(case m when 0 then [o||' Hauptbahnhof', o||' Hbf'] when 1 then [o] else [o||' Bf', o] end) "name" from n)
 select distinct k, "name" from v""")
def _(t):
    rows = t.sql("select s_suppkey as k, 'Ort'||cast(s_nationkey as string)||case s_suppkey%3 when 0 then ' Hauptbahnhof' when 1 then '' else ' Bf' end as name from supplier")
    each = rows.select("name").distinct().select(F.col("name").alias("own"), F.explode(name_variants(F.col("name"), F.lit(0.0), F.lit(0.0))).alias("name"))
    return rows.withColumnRenamed("name", "own").join(each, "own").select("k", "name").distinct()


ROUTES = "select seq as alert_id, array(named_struct('lang', 'nl', 'text', 'Town-'||cast(seq%20 as string)||' - nergens'), named_struct('lang', 'fr', 'text', 'Town-'||cast(seq%20 as string)||' - Town-'||cast((seq+3)%20 as string)||' - rien - Town-'||cast((seq+1)%23 as string))) as texts from b_poll where event_type='signup'"


@query("fn_12_text_route_chain", """with d as (select "name", max(cluster_id) c from b_clusters group by 1), a as (select seq, ['Town-'||(seq%20), 'Town-'||((seq+3)%20), 'rien', 'Town-'||((seq+1)%23)] p from b_poll where event_type='signup')
 select seq alert_id, cast(i-1 as int) pos, d.c cluster from a, unnest([1,2,3,4]) u(i) join d on d."name"=p[i]""")
def _(t):
    names = t.clusters.groupBy("name").agg(F.max("cluster_id").alias("cluster_id"))
    from ballast.functions.text import normalize_name

    return W.text_route_chain(t.sql(ROUTES), names.select(normalize_name(F.col("name")).alias("name_key"), "cluster_id"))
