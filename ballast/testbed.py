"""Transit-shaped views over the bound test tables, in SQL both Spark and DuckDB accept.

Engine differences are the few placeholders in DIALECTS. The views are the inputs of the
registered queries; no operator depends on them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

DIALECTS = {
    "spark": {
        "epoch": "unix_timestamp(ts)",
        "each_day": "lateral view explode(sequence(0, 34)) e as i",
        "epoch_order": "unix_timestamp(o_orderdate)",
    },
    "duckdb": {
        "epoch": "cast(floor(epoch(ts)) as bigint)",
        "each_day": ", unnest(generate_series(0, 34)) as e(i)",
        "epoch_order": "cast(floor(epoch(o_orderdate)) as bigint)",
    },
}

_WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_FLAGS = ", ".join(
    f"case when (k+{i}*3)%7<5 then '1' else '0' end as {name}" for i, name in enumerate(_WEEKDAYS)
)
_CLUSTER = "'c'||lpad(cast({} as string),2,'0')"
_UIC = "(case {0}%5 when 0 then '84' when 1 then '88' when 2 then '87' when 3 then '80' else '85' end)||lpad(cast({0} as string),5,'0')"

VIEWS = {
    "b_stops": f"""
select 's'||cast(s_suppkey as string) as stop_id, 'f'||cast(s_nationkey%5 as string) as feed,
  case when s_suppkey%3=0 then {_UIC.format('s_nationkey')} end as stop_code,
  case when s_suppkey%2=0 then 'Town '||cast(s_nationkey as string)||' Hbf' else 'Town-'||cast(s_nationkey as string)||' Station' end as stop_name,
  case when s_suppkey%37=5 then 0e0 else 46e0+(s_nationkey*37%53)/1e1+(s_suppkey%2)*4e-4 end as stop_lat,
  case when s_suppkey%37=5 then 0e0 else 2e0+(s_nationkey*29%71)/1e1 end as stop_lon,
  case when s_suppkey%4=1 then 's'||cast(s_suppkey-1 as string) end as parent_station,
  {_CLUSTER.format('s_nationkey')} as cluster_id from supplier""",
    "b_routes": """
select 'r'||cast(c_custkey as string) as route_id, 'f'||cast(c_nationkey%5 as string) as feed, 'a'||cast(c_nationkey as string) as agency_id,
  c_mktsegment as route_short_name, case c_custkey%10 when 0 then '3' when 1 then '714' when 2 then '109' when 3 then '100' else '2' end as route_type from customer""",
    "b_agency": """
select 'a'||cast(n_nationkey as string) as agency_id, 'Rail '||n_name as agency_name from nation""",
    "b_trips": """
select 't'||cast(o_orderkey as string) as trip_id, 'f'||cast(o_custkey%5 as string) as feed, 'r'||cast(o_custkey as string) as route_id, 'v'||cast(o_custkey%40 as string) as service_id,
  case when o_orderkey%3<>0 then cast(o_orderkey%9000 as string) end as trip_short_name,
  case when o_orderkey%5<>0 then 'to '||o_orderpriority end as trip_headsign from orders""",
    "b_stop_times": """
select 't'||cast(l_orderkey as string) as trip_id, seq as stop_sequence, 's'||cast(l_suppkey as string) as stop_id, cast(3600*(4+l_orderkey%20)+seq*900+(l_partkey%10)*60 as int) as dep_s
  from (select l_orderkey,l_suppkey,l_partkey,row_number() over (partition by l_orderkey order by l_linenumber,l_suppkey,l_partkey,l_extendedprice,l_shipdate,l_quantity,l_discount,l_tax,l_returnflag,l_linestatus) as seq from lineitem) x""",
    "b_clock_times": """
select trip_id, stop_sequence, stop_id, dep_s,
  lpad(cast(cast(floor(dep_s/3600) as int) as string),2,'0')||':'||lpad(cast(cast(floor(dep_s/60) as int)%60 as string),2,'0')||':00' as arrival_time,
  case when stop_sequence%4=3 then '' when stop_sequence%5=4 then null else
  lpad(cast(cast(floor((dep_s+60)/3600) as int) as string),2,'0')||':'||lpad(cast(cast(floor((dep_s+60)/60) as int)%60 as string),2,'0')||':00' end as departure_time from b_stop_times""",
    "b_dates": """
select d, i, case i%7 when 5 then 'sat' when 6 then 'sun' else 'wd' end as daytype, cast(i%7 as int) as wd
  from (select distinct replace(substring(cast(ts as string),1,10),'-','') as d, cast(floor({epoch}/86400) as int)-19723 as i from events) q""",
    "b_calendar": f"""
select 'v'||cast(k as string) as service_id, {_FLAGS}, '20240101' as start_date, case when k%5=0 then '20240120' else '20240204' end as end_date from (select distinct o_custkey%40 as k from orders) q""",
    "b_calendar_dates": """
select 'v'||cast(q.k as string) as service_id, b.d as date, case when b.i=9 or (q.k+b.i)%2=0 then '2' else '1' end as exception_type
  from (select k, i from (select distinct o_custkey%40 as k from orders) p {each_day} where i=9 or (k*5+i)%11=0) q join b_dates b on b.i=q.i""",
    "b_hops": """
select trip_id, seq, a, b, dep_s from (select st.trip_id, st.stop_sequence as seq, s.cluster_id as a, lead(s.cluster_id) over (partition by st.trip_id order by st.stop_sequence) as b, st.dep_s from b_stop_times st join b_stops s on st.stop_id=s.stop_id) h where b is not null and a<>b""",
    "b_segments": """
select distinct least(a,b) as a, greatest(a,b) as b, least(a,b)||'|'||greatest(a,b) as segment from b_hops""",
    "b_segment_edges": """
select segment, 'E'||cast((ia*7+ib*13)%60 as string) as edge from (select segment, cast(substring(a,2,2) as int) ia, cast(substring(b,2,2) as int) ib from b_segments) q
  union select segment, 'E'||cast((ia*11+ib*5)%60 as string) from (select segment, cast(substring(a,2,2) as int) ia, cast(substring(b,2,2) as int) ib from b_segments) q where (ia+ib)%3=0""",
    "b_refinement": """
select segment as coarse, a||'|'||m as fine, 0.4e0 as fraction, 0 as ord from (select a,b,segment,'c'||lpad(cast(cast(substring(a,2,2) as int)+1 as string),2,'0') as m, cast(substring(a,2,2) as int) ia, cast(substring(b,2,2) as int) ib from b_segments) q where ib-ia>=2 and (ia+ib)%4=0
  union all select segment, m||'|'||b, 0.6e0, 1 from (select a,b,segment,'c'||lpad(cast(cast(substring(a,2,2) as int)+1 as string),2,'0') as m, cast(substring(a,2,2) as int) ia, cast(substring(b,2,2) as int) ib from b_segments) q where ib-ia>=2 and (ia+ib)%4=0""",
    "b_poll": """
select event_id as seq, {epoch} as ts, 'f'||cast(user_id%5 as string) as country, 't'||cast(user_id as string) as trip_id,
  'c'||lpad(cast(least(user_id%25,(user_id*7+event_id%3+1)%25) as string),2,'0')||'|c'||lpad(cast(greatest(user_id%25,(user_id*7+event_id%3+1)%25) as string),2,'0') as segment,
  'c'||lpad(cast(event_id%25 as string),2,'0') as cluster, replace(substring(cast(ts as string),1,10),'-','') as service_date, cast(floor(value/25)*60 as int) as delay_s, event_type from events""",
    "b_seg_obs": "select seq, ts, country, segment, trip_id, delay_s as delta_s from b_poll",
    "b_stop_obs": "select seq, ts, country, trip_id, service_date, cluster, delay_s from b_poll",
    "b_cancels": "select seq, ts, country, trip_id, service_date, segment from b_poll where event_type='error'",
    "b_passages": "select seq, ts, segment from b_poll where event_type='purchase'",
    "b_noons": "select 1704067200+cast(i as bigint)*86400+43200 as as_of from b_dates where i<30",
    "b_clusters": f"""
select {_CLUSTER.format('n_nationkey')} as cluster_id, case when n_nationkey%3=0 then {_UIC.format('n_nationkey')} end as uic,
  'Town-'||cast(n_nationkey%20 as string) as name, 46e0+(n_nationkey*37%53)/1e1 as lat, 2e0+(n_nationkey*29%71)/1e1 as lon,
  case when n_nationkey%4=0 then 'f0,f'||cast(1+n_nationkey%4 as string) else 'f'||cast(n_nationkey%5 as string) end as feeds from nation""",
    "b_cluster_country": f"""
select {_CLUSTER.format('n_nationkey')} as cluster_id, case n_regionkey when 0 then 'NL' when 1 then 'BE' when 2 then 'FR' when 3 then 'DE' else 'CH' end as country from nation""",
    # trip updates: an order is a polled trip, its lines are the ordered stop updates
    "b_updates": """
select t.feed as country, cast(1704067200 as bigint) as poll_ts, st.trip_id, '20240101' as service_date,
  cast(st.stop_sequence as int) as stu_pos, s.cluster_id as cluster,
  case when (st.dep_s/60)%7=3 then 'SKIPPED' else 'SCHEDULED' end as stop_rel,
  case when (st.dep_s/60)%7=3 or (st.dep_s/60)%5=1 then null else cast((st.dep_s/60)%10*30-60 as int) end as delay_s,
  case when (st.dep_s/60)%4=0 then null else cast(1704067200-43200+st.dep_s as bigint) end as event_ts
  from b_stop_times st join b_stops s on st.stop_id=s.stop_id join b_trips t on t.trip_id=st.trip_id""",
    "b_trains": """
select country, trip_id, service_date, min(ts) as first_ts, max(ts) as last_ts, cast(count(*) as bigint) as n_obs,
  cast(case when max(seq)%9=4 then null else (max(seq)*37)%4200-240 end as int) as delay_s,
  sum(case when event_type='error' then 1 else 0 end)>0 as cancelled
  from b_poll group by country, trip_id, service_date""",
    "b_edge_groups": """
select 'g'||lpad(cast(o_orderkey as string),9,'0') as group_seq, 'src'||cast(o_custkey%3 as string) as src,
  case o_orderkey%3 when 0 then 'closed' when 1 then 'intl' else 'reduced' end as sev, cast(null as string) as until, o_orderpriority as txt,
  'E'||cast(o_custkey as string) as edge from orders""",
}


def _sql(name: str, dialect: str) -> str:
    text = VIEWS[name]
    for key, value in DIALECTS[dialect].items():
        text = text.replace("{" + key + "}", value)
    return text.strip()


def _referenced(sql: str) -> list[str]:
    """Views a statement needs, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bb_[a-z_]+\b", text)):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    return order


def duckdb_sql(statement: str) -> str:
    """Prefix a DuckDB statement with the views it uses as common table expressions."""
    views = [f"{name} as (\n{_sql(name, 'duckdb')}\n)" for name in _referenced(statement)]
    statement = statement.strip()
    if not views:
        return statement
    if statement.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join(views) + ",\n" + statement[len("with recursive "):]
    if statement.lower().startswith("with "):
        return "with " + ",\n".join(views) + ",\n" + statement[len("with "):]
    return "with " + ",\n".join(views) + "\n" + statement


class Testbed:
    """Bound views of one scale-factor folder as Spark DataFrames: ``Testbed(spark, dir).hops``."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, statement: str) -> DataFrame:
        views = _referenced(statement)
        text = " ".join(_sql(name, "spark") for name in views) + " " + statement
        for name in BASE_TABLES:
            if re.search(rf"\b{name}\b", text):
                self.table(name).createOrReplaceTempView(name)
        for name in views:
            self.spark.sql(f"create or replace temp view {name} as {_sql(name, 'spark')}")
        return self.spark.sql(statement)

    def __getattr__(self, name: str) -> DataFrame:
        if f"b_{name}" in VIEWS:
            return self.sql(f"select * from b_{name}")
        if name in BASE_TABLES:
            return self.table(name)
        raise AttributeError(name)
