"""Inputs of the queries, derived from the given tables by Spark.

`SQL` holds the same derivations as text for the comparison engine.  Both are built from the same
row expressions, so that only the operator under test differs.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import CHUNK, with_position

START = 1647338400  # 2022-03-15 10:00:00 UTC
ZONE = "GMT+3"
ZONE_S = 10800

PINGS = [
    "concat('d',cast(user_id as string)) as caid",
    f"cast({START} + seq*60 + event_id%50 as bigint) as utc_timestamp",
    "49.05D + (user_id%5)*0.2D + floor(seq/22)*0.002D + (event_id%7)*0.00002D as latitude",
    "30.1D + (user_id%97)*0.005D + (event_id%5)*0.00002D as longitude",
    "case when event_id%13=0 then null else 100 + value end as altitude",
    "cast(event_id%200 as double) as horizontal_accuracy",
    "case when event_type='signup' then 'PL' else 'UA' end as iso_country_code",
]
DWELLS = [
    "concat('d',cast(user_id as string)) as caid",
    "unix_seconds(cast(ts as timestamp)) as utc_timestamp_start",
    "cast(3600*(1+event_id%12) as int) as stay_length_sec",
    "49.05D + (user_id%5)*0.2D + case when event_id%3=0 then 0.01D*(1+event_id%7)"
    " else 0.00002D*(event_id%5) end as latitude",
    "30.1D + (user_id%97)*0.005D + 0.00002D*(event_id%3) as longitude",
]
ALERTS = [
    "concat('R',cast(r_regionkey as string)) as region_english",
    f"cast({START}+1920+r_regionkey*67 as bigint) as start_s",
    f"cast({START}+1920+r_regionkey*67+1860+60*(1+r_regionkey) as bigint) as end_s",
]
NESTED_ALERT = ["'R01' as region_english", f"cast({START + 2010} as bigint) as start_s",
                f"cast({START + 4200} as bigint) as end_s"]
#: Device paths for the studies: `period_pings` has devices in one, two or all periods of the conflict, 61 days apart;
#: `long_pings` has 500 minutes around one long alert.
BLOCK_S = 61 * 86400
PERIOD_PINGS = [
    "concat('d',cast(user_id%30 as string)) as caid",
    f"cast({START} + seq*60 + event_id%50 + {BLOCK_S}*least(floor(user_id/30)%3, case when user_id%30<10 then 1 else 2 end)"
    " as bigint) as utc_timestamp",
    "49.05D + (user_id%5)*0.2D + floor(seq/22)*0.002D + (event_id%7)*0.00002D as latitude",
    "30.1D + (user_id%30)*0.005D + (event_id%5)*0.00002D + floor(user_id/30)*0.000003D as longitude",
    *PINGS[4:],
]
LONG_PINGS = [
    "concat('d',cast(user_id%40 as string)) as caid",
    f"cast({START} + (event_id%500)*60 + user_id%50 as bigint) as utc_timestamp",
    "49.05D + (event_id%7)*0.00002D as latitude",
    "30.1D + (user_id%40)*0.005D + (event_id%5)*0.00002D + floor(event_id/500)*0.0000003D as longitude",
    *PINGS[4:],
]
LONG_ALERTS = ["concat('R',cast(r_regionkey as string)) as region_english", f"cast({START + 15000} as bigint) as start_s",
               f"cast({START + 15000 + 245 * 60} as bigint) as end_s"]
#: Dwells in the month of the event study; a third of the devices live away from where their pings are.
STUDY_DWELLS = [
    DWELLS[0], "unix_seconds(cast(ts as timestamp)) + 5097600 as utc_timestamp_start", DWELLS[2],
    DWELLS[3].replace(" as latitude", " + case when user_id%3=0 then 0.05D else 0.0D end as latitude"), DWELLS[4],
]
STUDY_SPAN = ("2024-02-18", "2024-05-20")
BOXES = [
    "concat('R',cast(r_regionkey as string)) as region_english",
    "30.0D as x0", "30.7D as x1", "49.0D+0.2D*r_regionkey as y0", "49.18D+0.2D*r_regionkey as y1",
]
NESTED_BOX = ["'R01' as region_english", "29.9D as x0", "30.8D as x1", "48.9D as y0", "49.4D as y1"]
# Cities: one box per nation, some of them overlapping and some reaching over a region's edge.
CITIES = [
    "n_name as city",
    "30.05D+0.02D*n_nationkey as x0", "30.05D+0.02D*n_nationkey+0.035D as x1",
    "49.03D+0.2D*n_regionkey as y0", "49.0515D+0.2D*n_regionkey as y1",
]
TOGGLES = [
    "concat('R',cast(user_id%5 as string)) as region_ukrainian",
    "unix_seconds(cast(ts as timestamp)) as t", "event_id as seq",
]
CONTROL = [
    "s_suppkey as locality", "30.0D+0.04D*(s_suppkey%20) as longitude",
    "49.0D+0.1D*floor((s_suppkey%100)/20) as latitude",
    "case when s_suppkey%20>=10 then 'RU' else 'UA' end as ctr_20220315",
    "case when s_suppkey%20>=12 then 'RU' when s_suppkey%20=11 then 'CONTESTED' else 'UA' end as ctr_20220316",
]
CASUALTIES = [
    "date_add(date '2022-03-01', cast(o_orderkey%220 as int)) as event_date",
    "case when o_custkey%3=0 then 'Civilians' else 'Other' end as actor2",
    "case when o_orderkey%11=0 then null else cast(o_orderkey%4 as bigint) end as fatalities",
]
# days on which nothing was recorded
QUIET_DAYS = "event_date not in (date '2022-04-10', date '2022-04-11', date '2022-06-04')"
# Alert count and movement per day; five days of it have no casualty row, one date is only here.
ALERT_DAYS = [
    "date_add(date '2022-03-10', cast(o_custkey%200 as int)) as smart_date",
    "o_totalprice as price",
]
CELLS = [
    "p_partkey as wp_index", "30.0D+0.02D*(p_partkey%35) as x",
    "49.0D+0.02D*(floor(p_partkey/35)%50) as y", "p_retailprice-950 as raster_val",
]
ECON = [
    "concat('N',cast(user_id%25 as string)) as name_2", "concat('R',cast(user_id%5 as string)) as name_1",
    "date_add(date '2021-12-20', cast(event_id%120 as int)) as day",
    "value as dwells_shops", "1+user_id%9 as caid_unique",
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _timed_events(spark, sf) -> DataFrame:
    """The columns of events that the ping views read."""
    return table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def raw_pings(spark, sf) -> DataFrame:
    ranked = with_position(_timed_events(spark, sf), ["user_id"], ["ts", "event_id"], F.to_date("ts"), "seq")
    return ranked.drop(CHUNK).selectExpr(*PINGS)


def period_pings(spark, sf) -> DataFrame:
    ranked = with_position(_timed_events(spark, sf), ["user_id"], ["ts", "event_id"], F.to_date("ts"), "seq")
    return ranked.drop(CHUNK).selectExpr(*PERIOD_PINGS)


def long_pings(spark, sf) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*LONG_PINGS)


def period_alerts(spark, sf) -> DataFrame:
    later = F.explode(F.array(*[F.lit(k * BLOCK_S) for k in range(3)]))
    return alerts(spark, sf).withColumn("later", later).select(
        "region_english", (F.col("start_s") + F.col("later")).alias("start_s"), (F.col("end_s") + F.col("later")).alias("end_s")
    )


def long_alerts(spark, sf) -> DataFrame:
    return table(spark, sf, "region").filter("r_regionkey = 0").selectExpr(*LONG_ALERTS)


def study_dwells(spark, sf) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*STUDY_DWELLS)


def dwells(spark, sf) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*DWELLS)


def alerts(spark, sf) -> DataFrame:
    region = table(spark, sf, "region")
    return region.selectExpr(*ALERTS).unionByName(
        region.filter("r_regionkey = 0").selectExpr(*NESTED_ALERT)
    )


def boxes(spark, sf) -> DataFrame:
    region = table(spark, sf, "region")
    return region.selectExpr(*BOXES).unionByName(region.filter("r_regionkey = 0").selectExpr(*NESTED_BOX))


def box_wkt(df: DataFrame) -> DataFrame:
    """WKT text of the boxes x0, x1, y0, y1."""
    point = lambda x, y: F.concat_ws(" ", F.col(x).cast("string"), F.col(y).cast("string"))
    ring = F.concat_ws(
        ", ", point("x0", "y0"), point("x1", "y0"), point("x1", "y1"), point("x0", "y1"), point("x0", "y0")
    )
    return df.withColumn("geometry", F.concat(F.lit("POLYGON (("), ring, F.lit("))"))).drop(
        "x0", "x1", "y0", "y1"
    )


def regions(spark, sf) -> DataFrame:
    return box_wkt(boxes(spark, sf))


def cities(spark, sf) -> DataFrame:
    return box_wkt(table(spark, sf, "nation").selectExpr(*CITIES))


def toggles(spark, sf) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*TOGGLES)


def control(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr(*CONTROL)


def casualties(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*CASUALTIES).filter(QUIET_DAYS)


def alert_days(spark, sf) -> DataFrame:
    return (
        table(spark, sf, "orders").selectExpr(*ALERT_DAYS).groupBy("smart_date")
        .agg(F.count(F.lit(1)).alias("alert"), F.round(F.sum("price") / 10000, 2).alias("movement"))
    )


def cells(spark, sf) -> DataFrame:
    return table(spark, sf, "part").selectExpr(*CELLS)


def econ(spark, sf) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*ECON)


# --- the same views as text -------------------------------------------------------------------

def _text(exprs: list[str]) -> str:
    text = ", ".join(exprs)
    text = re.sub(r"(\d+\.\d+)D", r"cast(\1 as double)", text)
    text = text.replace("unix_seconds(cast(ts as timestamp))", "cast(floor(epoch(ts)) as bigint)")
    text = re.sub(r"date_add\((date '[^']+'), cast\(([^()]+) as int\)\)", r"(\1 + cast(\2 as integer))", text)
    return text.replace(" as string)", " as varchar)").replace(" as int)", " as integer)")


SQL = {
    "raw_pings": f"""select {_text(PINGS)} from (select *, row_number() over
        (partition by user_id order by ts, event_id)-1 as seq from events)""",
    "pings": "select caid, utc_timestamp, latitude, longitude, altitude from raw_pings "
             "where horizontal_accuracy <= 150 and iso_country_code = 'UA'",
    "dwells": f"select {_text(DWELLS)} from events",
    "study_dwells": f"select {_text(STUDY_DWELLS)} from events",
    "period_pings": f"""select {_text(PERIOD_PINGS)} from (select *, row_number() over
        (partition by user_id order by ts, event_id)-1 as seq from events)""",
    "long_pings": f"select {_text(LONG_PINGS)} from events",
    "period_alerts": f"""select region_english, start_s + k*{BLOCK_S} as start_s, end_s + k*{BLOCK_S} as end_s from
        (select {_text(ALERTS)} from region union all select {_text(NESTED_ALERT)}), range(3) t(k)""",
    "long_alerts": f"select {_text(LONG_ALERTS)} from region where r_regionkey = 0",
    "alerts": f"select {_text(ALERTS)} from region union all select {_text(NESTED_ALERT)}",
    "boxes": f"select {_text(BOXES)} from region union all select {_text(NESTED_BOX)}",
    "cities": f"select {_text(CITIES)} from nation",
    "toggles": f"select {_text(TOGGLES)} from events",
    "control": f"select {_text(CONTROL)} from supplier",
    "casualties": f"select * from (select {_text(CASUALTIES)} from orders) where {QUIET_DAYS}",
    "alert_days": f"""select smart_date, count(*) as alert, round(sum(price)/10000, 2) as movement
        from (select {_text(ALERT_DAYS)} from orders) group by smart_date""",
    "cells": f"select {_text(CELLS)} from part",
    "econ": f"select {_text(ECON)} from events",
}
NEEDS = {"pings": ["raw_pings"]}


def with_views(*names: str, recursive: bool = False) -> str:
    """`WITH a AS (...), b AS (...)` for the named views and everything they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for part in NEEDS.get(name, []):
            add(part)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n"


def instead(text: str, **views: str) -> str:
    """The text of `with_views` with other views in the place of some: raw_pings="long_pings" and so on."""
    for name, other in views.items():
        text = text.replace(f"{name} AS ({SQL[name]})", f"{name} AS ({SQL[other]})")
    return text


def _chain(name: str, needs: list[str], text: str) -> None:
    SQL[name], NEEDS[name] = text, needs


def _chord(a: str, b: str, c: str, d: str) -> str:
    """Chord in metres from (a lat, b lon) to (c lat, d lon)."""
    return (
        f"2*6378000*sqrt(pow(sin((radians({c})-radians({a}))/2),2)"
        f"+cos(radians({a}))*cos(radians({c}))*pow(sin((radians({d})-radians({b}))/2),2))"
    )


def sql_arc(a: str, b: str, c: str, d: str, radius: float = 6371009) -> str:
    return (
        f"2*{radius}*asin(sqrt(pow(sin((radians({c})-radians({a}))/2),2)"
        f"+cos(radians({a}))*cos(radians({c}))*pow(sin((radians({d})-radians({b}))/2),2)))"
    )


def sql_time(epoch: str) -> str:
    return f"strftime(make_timestamp(cast({epoch} as bigint)*1000000), '%Y-%m-%d %H:%M:%S')"


def sql_day(epoch: str) -> str:
    return f"strftime(make_timestamp(cast({epoch} as bigint)*1000000), '%Y-%m-%d')"


# --- panel and event panel; minutes and alert times are local epoch seconds ---------------------
_chain("lagged", ["pings"], """select *, lag(latitude) over w as plat, lag(longitude) over w as plon,
    lag(utc_timestamp) over w as pt from pings
    window w as (partition by caid order by utc_timestamp, latitude, longitude)""")
_chain("speeds", ["lagged"], f"""select *, utc_timestamp-pt as time_diff,
    {_chord('plat', 'plon', 'latitude', 'longitude')} as distance,
    3.6*{_chord('plat', 'plon', 'latitude', 'longitude')}/nullif(utc_timestamp-pt, 0) as kmh from lagged""")
_chain("minutes", ["speeds"], f"""select caid, (utc_timestamp+{ZONE_S})//60*60 as minute,
    (utc_timestamp+{ZONE_S})//86400*86400 as day, avg(kmh) as kmh_avg, avg(distance) as distance_avg,
    sum(distance) as distance_sum, avg(longitude) as longitude_center, avg(latitude) as latitude_center,
    avg(altitude) as altitude_avg from speeds where kmh <= 300 group by 1, 2, 3""")
_chain("local_alerts", ["alerts"], f"""select region_english, start_s+{ZONE_S} as start_dt,
    end_s+{ZONE_S} as end_dt from alerts""")
_chain("located", ["minutes", "boxes"], """select m.*, b.region_english from minutes m join boxes b
    on longitude_center > x0 and longitude_center < x1 and latitude_center > y0 and latitude_center < y1""")
_chain("matched", ["located", "local_alerts"], """select l.*, a.start_dt, a.end_dt from located l
    left join local_alerts a on l.region_english = a.region_english and l.minute between a.start_dt and a.end_dt""")
_chain("panel", ["matched"], """select caid, minute, day, any_value(kmh_avg) as kmh_avg,
    any_value(distance_avg) as distance_avg, any_value(distance_sum) as distance_sum,
    any_value(longitude_center) as longitude_center, any_value(latitude_center) as latitude_center,
    any_value(altitude_avg) as altitude_avg,
    first(region_english order by start_dt nulls last, region_english) as region_english,
    max(case when start_dt is not null then 1 else 0 end) as alert,
    min(start_dt) as start_raid_min, max(end_dt) as end_raid_max from matched group by 1, 2, 3""")
_chain("city_panel", ["panel", "cities"], """select p.*, c.city, case when c.city is null then 1 else 0 end as rural
    from panel p left join cities c on longitude_center > x0 and longitude_center < x1
    and latitude_center > y0 and latitude_center < y1""")
_chain("good_days", ["city_panel"], """select * from city_panel anti join
    (select caid, day from city_panel group by 1, 2
     having not (sum(distance_sum) > 0 and sum(distance_sum) < 100000)) using (caid, day)""")
_chain("nexts", ["good_days"], """select * from (select *, minute - start_raid_next as time_to_raid from
    (select * replace (start_raid_min//60*60 as start_raid_min),
     last_value(start_raid_min//60*60 ignore nulls) over (partition by caid order by minute desc) as start_raid_next
     from good_days where region_english is not null)) where time_to_raid is not null""")
_chain("anchors", ["nexts"], """select caid, start_raid_next, region_english,
    arg_max(latitude_center, time_to_raid) as lat_pre, arg_max(longitude_center, time_to_raid) as lon_pre
    from nexts where time_to_raid between -86400 and -0.1 and latitude_center <> 0 group by 1, 2, 3""")
_chain("anchored", ["nexts", "anchors"], f"""select n.*, case when latitude_center <> 0 and lat_pre <> 0 then
    {_chord('latitude_center', 'longitude_center', 'lat_pre', 'lon_pre')} end as distance_point
    from nexts n left join anchors using (caid, start_raid_next, region_english)""")
_chain("windowed", ["anchored"], "select * from anchored where time_to_raid between -1800 and 1800")
_chain("balanced", ["windowed"], """select * from windowed join (select start_raid_next, region_english,
    count(distinct minute) as minute_count from windowed group by 1, 2 having count(distinct minute) = 61)
    using (start_raid_next, region_english)""")
_chain("event_panel", ["balanced"], """select *, case when time_to_raid >= -600 then time_to_raid else -1 end
    as time_to_raid_post from balanced""")


def sql_effects(source: str, y: str, keys: str = "start_raid_next, region_english") -> str:
    """Cell means minus the base mean (or the minimum-norm constant) for a table of event rows."""
    return f"""select {keys}, cell, n, m - coalesce(base_m, case when k = 1 then 0 else total_m/(k+1) end) as b from
    (select *, max(case when cell = -1 then m end) over g as base_m,
     count(case when cell <> -1 then 1 end) over g as k,
     sum(case when cell <> -1 then m end) over g as total_m from
     (select {keys}, time_to_raid_post as cell, avg({y}) as m, count({y}) as n from {source}
      where {y} is not null group by all) window g as (partition by {keys})) where cell <> -1"""


_chain("effects", ["event_panel"], sql_effects("event_panel", "distance_sum"))

# --- stays ---------------------------------------------------------------------------------------
_chain("numbered", ["pings"], """select *, row_number() over (partition by caid
    order by utc_timestamp, latitude, longitude) - 1 as pos, count(*) over (partition by caid) as n from pings""")
_chain("near", ["numbered"], f"""select a.caid, a.pos, a.n, a.utc_timestamp as t, b.pos as q, b.utc_timestamp as qt
    from numbered a join numbered b on a.caid = b.caid and b.pos between a.pos-18 and a.pos+18 and a.pos <> b.pos
    where {sql_arc('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 25""")
_chain("spans", ["near"], """select caid, pos, any_value(n) as n, least(any_value(t), min(qt)) as s,
    greatest(any_value(t), max(qt)) as e from near group by 1, 2""")
_chain("cores", ["spans"], "select * from spans where e - s >= 60 and pos <= n - 1 - 18")
_chain("stay_cores", ["cores"], """select *, sum(fresh) over (partition by caid order by pos) - 1 as group_no from
    (select *, case when s <= max(e) over (partition by caid order by pos rows between unbounded preceding
     and 1 preceding) then 0 else 1 end as fresh from cores)""")
_chain("members", ["near", "stay_cores"], """select distinct c.caid, c.group_no, near.q as pos
    from stay_cores c join near on near.caid = c.caid and near.pos = c.pos""")
_chain("stays", ["members", "numbered"], """select caid, group_no, avg(latitude) as latitude,
    avg(longitude) as longitude, min(utc_timestamp) as utc_timestamp_start,
    max(utc_timestamp)-min(utc_timestamp) as stay_length_sec, count(*) as n_members
    from members join numbered using (caid, pos) group by 1, 2""")

# --- homes (EET is UTC+2 in the months of the data) -----------------------------------------------
HOME_SPAN = ("2023-12-20", "2024-03-20")
_chain("nights", ["dwells"], f"""select caid, latitude, longitude, utc_timestamp_start+7200 as t_local,
    (utc_timestamp_start+7200+stay_length_sec)//86400 - (utc_timestamp_start+7200)//86400 as num_days
    from dwells where stay_length_sec > 7200
    and utc_timestamp_start+7200 between epoch(timestamp '{HOME_SPAN[0]}') and epoch(timestamp '{HOME_SPAN[1]}')
    and (utc_timestamp_start+7200+stay_length_sec)//86400 <> (utc_timestamp_start+7200)//86400""")
_chain("centres", [], f"""select cast(date '{HOME_SPAN[0]}' + (1 + 30*k)::integer as date) as start_date
    from range(0, 100) t(k) where 1 + 30*k < date '{HOME_SPAN[1]}' - date '{HOME_SPAN[0]}'""")
_chain("night_windows", ["nights", "centres"], """select start_date, n.* from nights n join centres
    on t_local between epoch(start_date - 21) and epoch(start_date + 21)""")
_chain("night_places", ["night_windows"], """select start_date, caid, latitude, longitude, sum(num_days) as weight
    from night_windows semi join (select start_date, caid from night_windows group by 1, 2
    having sum(num_days) >= 4) using (start_date, caid) group by 1, 2, 3, 4""")
_chain("place_ids", ["night_places"], """select *, row_number() over
    (partition by start_date, caid order by latitude, longitude) as id from night_places""")
_chain("close_places", ["place_ids"], f"""select a.start_date, a.caid, a.id, b.id as other, b.weight as other_w
    from place_ids a join place_ids b using (start_date, caid)
    where {sql_arc('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude', 6371)} <= 0.05""")
_chain("core_places", ["close_places"], """select start_date, caid, id from close_places group by 1, 2, 3
    having sum(other_w) >= 3""")
_chain("core_links", ["close_places", "core_places"], """select c.start_date, c.caid, c.id, c.other
    from close_places c semi join core_places p on c.start_date = p.start_date and c.caid = p.caid and c.id = p.id
    semi join core_places q on c.start_date = q.start_date and c.caid = q.caid and c.other = q.id""")
_chain("reach", ["core_links"], """select start_date, caid, id, id as low from core_links
    union select l.start_date, l.caid, l.other, r.low from reach r join core_links l
    on r.start_date = l.start_date and r.caid = l.caid and r.id = l.id""")
_chain("core_labels", ["reach"], "select start_date, caid, id, min(low) as label from reach group by 1, 2, 3")
_chain("place_labels", ["core_labels", "close_places"], """select start_date, caid, id, label from core_labels
    union all select c.start_date, c.caid, c.id, min(l.label) from close_places c
    join core_labels l on l.start_date = c.start_date and l.caid = c.caid and l.id = c.other
    anti join core_labels o on o.start_date = c.start_date and o.caid = c.caid and o.id = c.id group by 1, 2, 3""")
_chain("home_clusters", ["place_labels", "place_ids"], """select start_date, caid, label,
    sum(latitude*weight)/sum(weight) as latitude, sum(longitude*weight)/sum(weight) as longitude,
    sum(weight) as num_members from place_labels join place_ids using (start_date, caid, id) group by 1, 2, 3""")
_chain("homes", ["home_clusters"], """select caid, latitude, longitude, strftime(start_date, '%Y-%m-%d') as start_date
    from (select *, row_number() over (partition by start_date, caid order by num_members desc, label) as rn
    from home_clusters) where rn = 1""")

# --- contact zone ------------------------------------------------------------------------------------
LAT0 = 49.5
_chain("status", ["control"], """select locality, longitude, latitude, strptime(col[5:], '%Y%m%d')::date as day,
    case when st = 'CONTESTED' then 'RU' else st end as status from
    (unpivot control on ctr_20220315, ctr_20220316 into name col value st)""")
_chain("spots", ["status"], f"""select distinct day, status, radians(longitude)*cos(radians({LAT0}))*6371.009 as x,
    radians(latitude)*6371.009 as y from status""")
_chain("lenses", ["spots"], """select a.day, a.x as ax, a.y as ay, b.x as bx, b.y as by_ from spots a join spots b
    on a.day = b.day and a.status = 'RU' and b.status = 'UA'
    where sqrt(pow(a.x-b.x, 2)+pow(a.y-b.y, 2)) <= 10""")
