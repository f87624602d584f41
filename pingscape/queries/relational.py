"""Joins, aggregates, windows, ordering and reshaping, and the jobs made of them."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock
from ..functions import fixed_values as K
from ..operators import alerts as A
from ..operators import context, estimates, events, front, homes, joins, ordered, panel, polygons, trajectory
from ..operators.quantiles import describe, group_quantiles
from . import views as V
from .common import (
    city_panel, event_keys, event_panel, local_alerts, minute_panel, minutes, night_windows, pings, r, speeds, text,
)
from .registry import query
from .views import sql_day, sql_time, with_views

# --- joins ----------------------------------------------------------------------------------------------

@query("jn1_keepers", with_views("night_places") + "select strftime(start_date, '%Y-%m-%d') as start_date, caid, "
       "count(*) as places from night_places group by 1, 2")
def _(spark, sf):
    return homes.night_places(night_windows(spark, sf)).groupBy(
        F.col("start_date").cast("string").alias("start_date"), "caid"
    ).agg(F.count(F.lit(1)).alias("places"))


@query("jn2_left", "select o_orderkey, c_name, c_mktsegment from orders left join customer on o_custkey = c_custkey and c_acctbal > 0")
def _(spark, sf):
    rich = V.table(spark, sf, "customer").filter("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey")
    return V.table(spark, sf, "orders").join(rich, "o_custkey", "left").select("o_orderkey", "c_name", "c_mktsegment")


@query("jn3_inner_keys", """select a.l_orderkey, a.l_linenumber, a.l_quantity, b.n from lineitem a join
    (select l_orderkey, l_suppkey, count(*) as n from lineitem group by 1, 2) b
    on a.l_orderkey = b.l_orderkey and a.l_suppkey = b.l_suppkey""")
def _(spark, sf):
    lines = V.table(spark, sf, "lineitem")
    counts = lines.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return lines.join(counts, ["l_orderkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_quantity", "n")


@query("jn4_anti", "select doc_id, lang from documents anti join labels using (doc_id)")
def _(spark, sf):
    labelled = V.table(spark, sf, "labels").select("doc_id")
    return V.table(spark, sf, "documents").join(labelled, "doc_id", "left_anti").select("doc_id", "lang")


@query("jn5_semi", """select event_id, user_id from events semi join
    (select user_id, max(ts) as ts from events group by 1) m on events.user_id = m.user_id and events.ts = m.ts""")
def _(spark, sf):
    rows = V.table(spark, sf, "events").select("event_id", "user_id", "ts")
    last = rows.groupBy("user_id").agg(F.max("ts").alias("ts"))
    return rows.join(last, ["user_id", "ts"], "left_semi").select("event_id", "user_id")


@query("jn6_interval_join", with_views("matched") + f"""select caid, {sql_time('minute')} as minute, region_english,
    {sql_time('min(start_dt)')} as start_raid, {sql_time('max(end_dt)')} as end_raid from matched
    group by caid, minute, region_english""")
def _(spark, sf):
    placed = polygons.locate(minutes(spark, sf), V.regions(spark, sf), "region_english")
    out = panel.attach_alerts(placed, local_alerts(spark, sf))
    return out.select(
        "caid", text("minute").alias("minute"), "region_english", text("start_raid").alias("start_raid"),
        text("end_raid").alias("end_raid"),
    )


@query("jn7_point_polygon_left", with_views("minutes", "cities") + f"""select caid, {sql_time('minute')} as minute, city
    from minutes left join cities on longitude_center > x0 and longitude_center < x1 and latitude_center > y0
    and latitude_center < y1""")
def _(spark, sf):
    found = polygons.locate(minutes(spark, sf), V.cities(spark, sf), "city", how="left")
    return found.select("caid", text("minute").alias("minute"), "city")


UNITS_SQL = """with units as (select n_name as name_1, n_name || ' raion|N' || n_nationkey || '|shared' || n_regionkey as variants
    from nation), labels_ as (select doc_id, case doc_id % 4 when 0 then 'NATION_' || (doc_id % 25)
    when 1 then 'N' || (doc_id % 30) when 2 then 'shared' || (doc_id % 7) else 'NATION_' || (doc_id % 40) || ' raion' end
    as label from documents)"""


def _units(spark, sf):
    key = F.col("n_nationkey").cast("string")
    variants = F.concat(
        "n_name", F.lit(" raion|N"), key, F.lit("|shared"), F.col("n_regionkey").cast("string")
    )
    return V.table(spark, sf, "nation").select(F.col("n_name").alias("name_1"), variants.alias("variants"))


def _labels(spark, sf):
    m = lambda k: (F.col("doc_id") % k).cast("string")
    label = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("NATION_"), m(25)))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("N"), m(30)))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("shared"), m(7)))
        .otherwise(F.concat(F.lit("NATION_"), m(40), F.lit(" raion")))
    )
    return V.table(spark, sf, "documents").select("doc_id", label.alias("label"))


@query("jn8_alias_join", UNITS_SQL + """, alias as (select name_1, name_1 as a, -1 as p from units union all
    select name_1, unnest(string_split(variants, '|')), unnest(range(0, len(string_split(variants, '|')))) from units),
    best as (select a, name_1, row_number() over (partition by a order by p desc, name_1 desc) as rn from alias)
    select doc_id, label, name_1 from labels_ left join best on a = label and rn = 1""")
def _(spark, sf):
    return joins.alias_join(_labels(spark, sf), "label", _units(spark, sf), "name_1", "variants").select(
        "doc_id", "label", "name_1"
    )


@query("jn9_month_home", with_views("night_windows", "dwells") + """select caid, utc_timestamp_start, h.start_date from
    (select *, month(make_timestamp(cast(utc_timestamp_start as bigint)*1000000)) as m from dwells) d
    join (select distinct caid, strftime(start_date, '%Y-%m-%d') as start_date, month(start_date + 5) as m from night_windows) h
    using (caid, m)""")
def _(spark, sf):
    place = night_windows(spark, sf).select("caid", F.col("start_date").cast("string").alias("start_date")).distinct()
    by_month = place.withColumn("m", F.month(F.date_add(F.to_date("start_date"), 5)))
    stays = V.dwells(spark, sf).withColumn("m", F.month(F.timestamp_seconds("utc_timestamp_start")))
    return stays.join(by_month, ["caid", "m"]).select("caid", "utc_timestamp_start", "start_date")


@query("jn10_daily_front", """with f as (select cast(ts as date) as day, arg_min(event_type, (event_type, event_id)) as geometry
    from events group by 1) select o_orderkey, geometry from orders join f on day = cast(o_orderdate as date) + 9862""")
def _(spark, sf):
    texts = V.table(spark, sf, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("geometry"))
    per_day = front.one_front_per_day(texts)
    orders = V.table(spark, sf, "orders").withColumn("day", F.date_add(F.to_date("o_orderdate"), 9862))
    return joins.reference_join(orders, per_day, ["day"]).select("o_orderkey", "geometry")


@query("jn11_match_check", with_views("effects", "local_alerts") + f"""select a.region_english, {sql_time('a.start_dt')} as start_dt,
    round((end_dt-start_dt)/60.0, 6) as duration, count(*) as cells from local_alerts a join effects e
    on a.region_english = e.region_english and e.start_raid_next = start_dt//60*60 group by all""")
def _(spark, sf):
    from ..operators.regression import dummy_effects

    fit = dummy_effects(event_panel(spark, sf), events.EVENT, "distance_sum").withColumn("id", events.event_id())
    found = A.matched_alerts(local_alerts(spark, sf), fit)
    minutes_ = clock.seconds_between(F.col("end_dt"), F.col("start_dt")) / 60
    return found.groupBy("region_english", text("start_dt").alias("start_dt"), r(minutes_).alias("duration")).agg(
        F.count(F.lit(1)).alias("cells")
    )


@query("jn13_join_coalesce", """select d.doc_id, coalesce(a.v, b.v, -1) as v from documents d
    left join (select doc_id, nullif(quality, 0)*10 as v from labels) a on d.doc_id = a.doc_id
    left join (select doc_id, nullif(toxic, 0)*20 as v from labels) b on d.doc_id = b.doc_id""")
def _(spark, sf):
    labels = V.table(spark, sf, "labels")
    level = lambda c, n: labels.select("doc_id", (F.nullif(c, F.lit(0)) * n).alias("v"))
    docs = V.table(spark, sf, "documents").select("doc_id")
    both = joins.join_coalesced(docs.join(level("quality", 10), "doc_id", "left"), level("toxic", 20), ["doc_id"], ["v"])
    return both.select("doc_id", F.coalesce("v", F.lit(-1)).alias("v"))


@query("jn14_region_lookup", with_views("econ") + """select name_2, strftime(day, '%Y-%m-%d') as day, count(*) as n,
    round(any_value(first_mean), 6) as first_mean from econ left join (select name_2, avg(dwells_shops) as first_mean
    from econ where day <= date '2022-01-10' group by 1) using (name_2) group by 1, 2""")
def _(spark, sf):
    tagged = estimates.early_mean(V.econ(spark, sf), ["name_2"], "day", "2022-01-10", "dwells_shops", "first_mean")
    return tagged.groupBy("name_2", F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), r(F.first("first_mean")).alias("first_mean")
    )


EDGE_SQL = """with p as (select p_partkey, (p_partkey % 21) / 4.0 as x, (p_partkey % 13) / 4.0 as y from part),
    b as (select r_name as name, r_regionkey * 1.0 as x0, r_regionkey * 1.0 + 1.5 as x1, 0.5 as y0, 2.0 as y1 from region)"""


def _edge_points(spark, sf):
    return V.table(spark, sf, "part").select(
        "p_partkey", ((F.col("p_partkey") % 21) / 4).alias("x"), ((F.col("p_partkey") % 13) / 4).alias("y")
    )


def _edge_boxes(spark, sf):
    k = F.col("r_regionkey").cast("double")
    return V.box_wkt(V.table(spark, sf, "region").select(
        F.col("r_name").alias("name"), k.alias("x0"), (k + 1.5).alias("x1"), F.lit(0.5).alias("y0"), F.lit(2.0).alias("y1")
    ))


@query("jn15_intersects", EDGE_SQL + """ select p_partkey, name, 'intersects' as rule from p join b on x >= x0 and x <= x1
    and y >= y0 and y <= y1 union all select p_partkey, name, 'within' from p join b on x > x0 and x < x1 and y > y0 and y < y1""")
def _(spark, sf):
    points, boxes = _edge_points(spark, sf), _edge_boxes(spark, sf)
    touch = polygons.locate(points, boxes, "name", "x", "y", boundary=True, cell=1.0)
    inner = polygons.locate(points, boxes, "name", "x", "y", boundary=False, cell=1.0)
    return touch.select("p_partkey", "name", F.lit("intersects").alias("rule")).unionByName(
        inner.select("p_partkey", "name", F.lit("within").alias("rule"))
    )


OVERLAP_SQL = with_views("cells", "boxes").rstrip() + """, o as (select wp_index, x, y, raster_val, region_english,
    greatest(least(x+0.02, x1)-greatest(x, x0), 0)*greatest(least(y+0.02, y1)-greatest(y, y0), 0) as area from cells, boxes),
    best as (select *, row_number() over (partition by wp_index order by round(area, 12) desc, region_english) as rn from o
    where area > 1e-12)"""


def _overlap(spark, sf):
    return context.largest_overlap(V.cells(spark, sf), V.regions(spark, sf), "region_english", 0.02)


@query("jn16_largest_overlap", OVERLAP_SQL + " select wp_index, round(area, 9) as area from best where rn = 1")
def _(spark, sf):
    return _overlap(spark, sf).filter("area > 1e-12").select("wp_index", r("area", 9).alias("area"))


@query("ge9_cells_to_units", with_views("cells").rstrip() + """, b as (select r_name as unit, 30.0+0.11*r_regionkey as x0,
    30.095+0.11*r_regionkey as x1, 49.013 as y0, 49.8 as y1 from region), o as (select wp_index, raster_val, unit,
    greatest(least(x+0.02, x1)-greatest(x, x0), 0)*greatest(least(y+0.02, y1)-greatest(y, y0), 0) as area from cells, b),
    best as (select *, row_number() over (partition by wp_index order by area desc, unit) as rn from o where area > 1e-10)
    select unit, count(*) as cells, round(sum(greatest(raster_val, 0)), 4) as population, round(sum(area), 8) as area
    from best where rn = 1 group by 1""")
def _(spark, sf):
    k = F.col("r_regionkey")
    units = V.box_wkt(V.table(spark, sf, "region").select(
        F.col("r_name").alias("unit"), (30.0 + 0.11 * k).alias("x0"), (30.095 + 0.11 * k).alias("x1"),
        F.lit(49.013).alias("y0"), F.lit(49.8).alias("y1"),
    ))
    best = context.largest_overlap(V.cells(spark, sf), units, "unit", 0.02).filter("area > 1e-10")
    return best.groupBy("unit").agg(
        F.count(F.lit(1)).alias("cells"),
        r(F.sum(F.greatest("raster_val", F.lit(0.0))), 4).alias("population"), r(F.sum("area"), 8).alias("area"),
    )


@query("ge12_city_layer", """select city, length(geometry) > 0 as has_geometry from (select n_name as city, n_name as geometry,
    case n_nationkey % 4 when 0 then 'Misto' when 1 then 'Mis''ka Rada' when 2 then 'Raion' end as type_2 from nation)
    where type_2 in ('Misto', 'Mis''ka Rada') or type_2 is null
    union all select case r_regionkey when 0 then 'Kiev City' else 'Sevastopol''' end, true from region where r_regionkey < 2""")
def _(spark, sf):
    kind = F.when(F.col("n_nationkey") % 4 == 0, "Misto").when(F.col("n_nationkey") % 4 == 1, "Mis'ka Rada").when(
        F.col("n_nationkey") % 4 == 2, "Raion"
    )
    two = V.cities(spark, sf).join(
        V.table(spark, sf, "nation").select(F.col("n_name").alias("city"), kind.alias("type_2")), "city"
    ).withColumnRenamed("city", "name_2")
    name = F.when(F.col("r_regionkey") == 0, "Kiev City").when(F.col("r_regionkey") == 1, "Sevastopol'").otherwise(
        F.col("r_name")
    )
    one = V.table(spark, sf, "region").select(name.alias("NAME_1"), F.lit("POINT EMPTY").alias("geometry"))
    layer = A.city_layer(two, one, K.CITY_TYPES, K.LEVEL1_CITIES)
    return layer.select("city", (F.length("geometry") > 0).alias("has_geometry"))


@query("jn17_neighbour_pairs", with_views("numbered") + """select a.caid, count(*) as pairs, sum(b.pos - a.pos) as offsets
    from numbered a join numbered b on a.caid = b.caid and b.pos between a.pos - 18 and a.pos + 18 and a.pos <> b.pos group by 1""")
def _(spark, sf):
    near = trajectory.neighbours(trajectory.numbered_pings(pings(spark, sf)), distance=1e9).filter("inner")
    offset = F.aggregate("near", F.lit(0).cast("long"), lambda acc, q: acc + q["pos"] - F.col("pos"))
    return near.groupBy("caid").agg(F.sum(F.size("near")).alias("pairs"), F.sum(offset).alias("offsets"))


@query("jn18_next_event", """select event_id, strftime(min(case when event_type = 'error' then ts end) over (partition by
    user_id order by ts, event_id rows between current row and unbounded following), '%Y-%m-%d %H:%M:%S') as next_error
    from events""")
def _(spark, sf):
    # events of one user in time order, the next error carried back
    rows = V.table(spark, sf, "events").select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") == "error", F.col("ts")).alias("error_at")
    )
    known = ordered.next_known(rows, ["user_id"], ["ts", "event_id"], "error_at", F.to_date("ts"), "next_error")
    return known.select("event_id", text("next_error").alias("next_error"))


PAIRS_SQL = with_views("toggles").rstrip() + """, n as (select *, row_number() over (partition by region_ukrainian order by t, seq)-1
    as pos, lead(t) over (partition by region_ukrainian order by t, seq) as end_t from toggles)"""


@query("jn19_pairing", PAIRS_SQL + " select region_ukrainian, t as start, end_t as \"end\" from n where pos % 2 = 0")
def _(spark, sf):
    return A.alert_intervals(V.toggles(spark, sf), "region_ukrainian", "EET", order=["t", "seq"]).select(
        "region_ukrainian", "start", "end"
    )


# --- alert log ---------------------------------------------------------------------------------------------

@query("wn4_alternating_pairs", PAIRS_SQL + """ select region_ukrainian, count(*) as intervals,
    count(*) filter (where end_t is null) as open_ones from n where pos % 2 = 0 group by 1""")
def _(spark, sf):
    paired = A.alert_intervals(V.toggles(spark, sf), "region_ukrainian", "EET", order=["t", "seq"])
    return paired.groupBy("region_ukrainian").agg(
        F.count(F.lit(1)).alias("intervals"), F.count_if(F.col("end").isNull()).alias("open_ones")
    )


NAMED_SQL = PAIRS_SQL + """, named as (select region_ukrainian, t as s, end_t as e, case region_ukrainian when 'R0' then 'Kiev'
    when 'R1' then 'Kiev City' when 'R2' then 'Izium' when 'R3' then 'Lviv' end as region_english,
    case region_ukrainian when 'R0' then 'Kiev unit' when 'R1' then 'City unit' when 'R2' then 'Iziums''ka'
    when 'R3' then 'Lviv district' end as unit from n where pos % 2 = 0 and region_ukrainian <> 'R4')"""


def _clean_alerts(spark, sf):
    region = V.table(spark, sf, "region")
    k = F.col("r_regionkey")
    code = F.concat(F.lit("R"), k.cast("string"))
    label = F.element_at(
        F.array(*[F.lit(n) for n in ("Kyiv oblast", "Kyiv", "Izium raion", "Lviv oblast")]), (k + 1).cast("int")
    )
    names = region.filter("r_regionkey < 4").select(code.alias("key"), label.alias("value"))
    one = region.filter("r_regionkey < 2").select(
        F.when(k == 0, "Kiev unit").otherwise("City unit").alias("NAME_1"),
        F.when(k == 0, "Kiev|Kiev region").otherwise("Kiev City").alias("VARNAME_1"),
    )
    two = region.filter("r_regionkey = 3").select(
        F.lit("Lviv district").alias("name_2"), F.lit("Lvivskyi|Lviv").alias("varname_2")
    )
    return A.clean_alerts(
        V.toggles(spark, sf), names, one, two, A.region_fixes(spark), zone="EET", order=["t", "seq"]
    )


@query("tr21_alert_cleaning", NAMED_SQL + f""" select region_ukrainian, region_english, unit as name_1,
    {sql_time('s + 7200')} as start_dt, {sql_time('e + 7200')} as end_dt, round((e - s)/60.0, 6) as duration from named""")
def _(spark, sf):
    clean = _clean_alerts(spark, sf)
    return clean.select(
        "region_ukrainian", "region_english", F.col("NAME_1").alias("name_1"), text("start_dt").alias("start_dt"),
        text("end_dt").alias("end_dt"), r("duration").alias("duration"),
    )


DAYS_SQL = NAMED_SQL + """, days as (select region_english, cast(d as date) as day from (select region_english,
    unnest(generate_series(make_timestamp(cast(s + 7200 as bigint)*1000000), make_timestamp(cast(e + 7200 as bigint)*1000000),
    interval 1 day)) as d from named where e is not null))"""


@query("se10_interval_days", DAYS_SQL + " select region_english, strftime(day, '%Y-%m-%d') as day, count(*) as n from days group by 1, 2")
def _(spark, sf):
    return A.alert_days(_clean_alerts(spark, sf)).groupBy(
        "region_english", F.col("day").cast("string").alias("day")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("ag22_alerts_per_day", DAYS_SQL + " select region_english, strftime(day, '%Y-%m-%d') as day, count(*) as alerts from days group by 1, 2")
def _(spark, sf):
    return A.alert_counts(_clean_alerts(spark, sf)).select("region_english", F.col("day").cast("string").alias("day"), "alerts")


HEAT_DAYS = [f"2024-01-{d:02d}" for d in range(1, 32)]
HEAT_SQL = DAYS_SQL + " select region_english, " + ", ".join(
    f"count(*) filter (where day = date '{d}') as \"{d}\"" for d in HEAT_DAYS
) + ", count(*) filter (where day between date '2024-01-01' and date '2024-01-31') as total from days group by 1"


@query("tr22_heat_table", HEAT_SQL)
def _(spark, sf):
    return A.heat_table(A.alert_counts(_clean_alerts(spark, sf)), HEAT_DAYS)


# --- aggregates --------------------------------------------------------------------------------------------

@query("ag1_device_minute", with_views("minutes") + f"""select caid, {sql_time('minute')} as minute, {sql_day('day')} as day,
    round(kmh_avg, 6) as kmh_avg, round(distance_avg, 6) as distance_avg, round(distance_sum, 6) as distance_sum,
    round(longitude_center, 10) as longitude_center, round(latitude_center, 10) as latitude_center,
    round(altitude_avg, 6) as altitude_avg from minutes""")
def _(spark, sf):
    return minutes(spark, sf).select(
        "caid", text("minute").alias("minute"), F.col("day").cast("string").alias("day"),
        *[r(c).alias(c) for c in ("kmh_avg", "distance_avg", "distance_sum", "altitude_avg")],
        *[r(c, 10).alias(c) for c in ("longitude_center", "latitude_center")],
    )


@query("ag2_device_day", with_views("minutes") + f"""select caid, {sql_day('day')} as day, round(sum(distance_sum), 4) as distance_sum
    from minutes group by caid, day""")
def _(spark, sf):
    return minutes(spark, sf).groupBy("caid", F.col("day").cast("string").alias("day")).agg(
        r(F.sum("distance_sum"), 4).alias("distance_sum")
    )


@query("ag3_distinct_minutes", with_views("windowed") + f"""select {sql_time('start_raid_next')} as start_raid_next, region_english,
    count(distinct minute) as minute_count from windowed group by all""")
def _(spark, sf):
    near = events.event_window(events.next_alert(events.plausible_days(city_panel(spark, sf))), 0.5)
    return near.groupBy(*event_keys()).agg(F.countDistinct("minute").alias("minute_count"))


@query("ag4_distinct_periods", """select o_custkey, count(distinct case when month(o_orderdate) between 3 and 4 then 1
    when month(o_orderdate) between 5 and 6 then 2 when month(o_orderdate) between 7 and 9 then 3 end) as n from orders group by 1""")
def _(spark, sf):
    from ..functions.clock import conflict_period

    period = conflict_period(F.month("o_orderdate"))
    return V.table(spark, sf, "orders").groupBy("o_custkey").agg(F.countDistinct(period).alias("n"))


@query("ag5_last_before", with_views("anchors") + f"""select caid, {sql_time('start_raid_next')} as start_raid_next, region_english,
    round(lat_pre, 10) as latitude, round(lon_pre, 10) as longitude from anchors""")
def _(spark, sf):
    near = events.next_alert(events.plausible_days(city_panel(spark, sf)))
    before = near.filter(F.col("time_to_raid").between(-K.ANCHOR_SECONDS, -0.1) & (F.col("latitude_center") != 0))
    last = F.max_by(F.struct("latitude_center", "longitude_center"), "time_to_raid")
    return before.groupBy("caid", *event_keys()).agg(last.alias("p")).select(
        "caid", "start_raid_next", "region_english", r("p.latitude_center", 10).alias("latitude"),
        r("p.longitude_center", 10).alias("longitude"),
    )


@query("ag6_min_distance", with_views("speeds") + "select caid, round(min(distance), 6) as d from speeds group by 1")
def _(spark, sf):
    return speeds(spark, sf).groupBy("caid").agg(r(F.min("distance")).alias("d"))


@query("ag7_min_speed", with_views("event_panel") + f"""select caid, {sql_time('start_raid_next')} as start_raid_next,
    region_english, round(min(kmh_avg), 6) as kmh_avg_min from event_panel group by all""")
def _(spark, sf):
    return event_panel(spark, sf).groupBy("caid", *event_keys()).agg(r(F.min("kmh_avg")).alias("kmh_avg_min"))


@query("ag8_spread", "select o_custkey, round(max(o_totalprice)-min(o_totalprice), 4) as spread from orders group by 1")
def _(spark, sf):
    return V.table(spark, sf, "orders").groupBy("o_custkey").agg(
        r(F.max("o_totalprice") - F.min("o_totalprice"), 4).alias("spread")
    )


@query("ag9_counts", with_views("event_panel") + f"""select {sql_time('start_raid_next')} as start_raid_next, region_english,
    count(caid) as obs, count(distinct caid) as devices from event_panel group by all""")
def _(spark, sf):
    return event_panel(spark, sf).groupBy(*event_keys()).agg(
        F.count("caid").alias("obs"), F.countDistinct("caid").alias("devices")
    )


@query("ag10_stay_centres", with_views("stays") + """select caid, count(*) as stays, sum(stay_length_sec) as seconds,
    sum(n_members) as members from stays group by 1""")
def _(spark, sf):
    per_stay = trajectory.stay_members(pings(spark, sf)).groupBy("caid", "group_no").agg(
        (F.max("utc_timestamp") - F.min("utc_timestamp")).alias("s"), F.count(F.lit(1)).alias("m")
    )
    return per_stay.groupBy("caid").agg(
        F.count(F.lit(1)).alias("stays"), F.sum("s").alias("seconds"), F.sum("m").alias("members")
    )


@query("ag11_place_sizes", with_views("night_places") + """select strftime(start_date, '%Y-%m-%d') as start_date, caid,
    max(weight) as biggest, round(sum(latitude*weight)/sum(weight), 10) as latitude from night_places group by 1, 2""")
def _(spark, sf):
    places = homes.night_places(night_windows(spark, sf))
    centre = F.sum(F.col("latitude") * F.col("weight")) / F.sum("weight")
    return places.groupBy(F.col("start_date").cast("string").alias("start_date"), "caid").agg(
        F.max("weight").alias("biggest"), r(centre, 10).alias("latitude")
    )


@query("ag12_mean_sd_bands", """select event_type, round(avg(value), 6) as x_mean, round(stddev_samp(value), 6) as x_sd,
    round(avg(value)+2*stddev_samp(value), 6) as max_tick, round(avg(value)-2*stddev_samp(value), 6) as min_tick from events group by 1""")
def _(spark, sf):
    bands = estimates.mean_bands(V.table(spark, sf, "events"), ["event_type"], "value")
    return bands.select("event_type", *[r(c).alias(c) for c in ("x_mean", "x_sd", "max_tick", "min_tick")])


@query("ag13_region_day_sums", with_views("econ") + """select name_1, strftime(day, '%Y-%m-%d') as day,
    round(sum(dwells_shops*caid_unique), 4) as dwells_shops, sum(caid_unique) as caid_unique from econ group by 1, 2""")
def _(spark, sf):
    one, _two = estimates.shop_levels(V.econ(spark, sf))
    return one.select("name_1", F.col("day").cast("string").alias("day"), r("dwells_shops", 4).alias("dwells_shops"), "caid_unique")


@query("ag14_january_mean", with_views("econ") + """select name_2, round(avg(case when month(day) = 1 then dwells_shops end), 6) as jan
    from econ group by 1""")
def _(spark, sf):
    return V.econ(spark, sf).groupBy("name_2").agg(r(F.avg(F.when(F.month("day") == 1, F.col("dwells_shops")))).alias("jan"))


@query("ag15_early_mean", with_views("econ") + """select name_2, round(avg(dwells_shops), 6) as early from econ
    where day <= date '2022-01-10' group by 1""")
def _(spark, sf):
    early = V.econ(spark, sf).filter(F.col("day") <= "2022-01-10")
    return early.groupBy("name_2").agg(r(F.avg("dwells_shops")).alias("early"))


@query("ag16_median", "select l_returnflag, round(median(l_extendedprice), 6) as med from lineitem group by 1")
def _(spark, sf):
    med = group_quantiles(V.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"med": 0.5})
    return med.select("l_returnflag", r("med").alias("med"))


@query("ag17_quantiles", """select l_linenumber, round(quantile_cont(l_extendedprice, 0.25), 6) as q25,
    round(quantile_cont(l_extendedprice, 0.75), 6) as q75, round(quantile_cont(l_extendedprice, 0.99), 6) as q99
    from lineitem group by 1""")
def _(spark, sf):
    q = group_quantiles(
        V.table(spark, sf, "lineitem"), ["l_linenumber"], "l_extendedprice", {"q25": 0.25, "q75": 0.75, "q99": 0.99}
    )
    return q.select("l_linenumber", *[r(c).alias(c) for c in ("q25", "q75", "q99")])


@query("ag17_pooled_quantile", "select round(quantile_cont(l_extendedprice, 0.99), 6) as q99, round(median(l_extendedprice), 6) as q50 from lineitem")
def _(spark, sf):
    q = group_quantiles(V.table(spark, sf, "lineitem"), [], "l_extendedprice", {"q99": 0.99, "q50": 0.5})
    return q.select(r("q99").alias("q99"), r("q50").alias("q50"))


@query("ag19_describe", """select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd,
    min(value) as min, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.5), 6) as q50,
    round(quantile_cont(value, 0.75), 6) as q75, max(value) as max from events group by 1""")
def _(spark, sf):
    table = describe(V.table(spark, sf, "events"), ["event_type"], "value")
    return table.select("event_type", "n", "min", "max", *[r(c).alias(c) for c in ("mean", "sd", "q25", "q50", "q75")])


HOMES_IN = """, h as (select caid, longitude as lon, latitude as lat from dwells),
    u as (select h.caid, b.region_english as unit from h join boxes b on lon >= x0 and lon <= x1 and lat >= y0 and lat <= y1
    and region_english <> 'R01'), pop as (select region_english as unit, sum(greatest(raster_val, 0)) as population from best
    where rn = 1 and region_english <> 'R01' group by 1)"""


def _device_units(spark, sf):
    places = V.dwells(spark, sf).select("caid", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    units = V.regions(spark, sf).filter("region_english <> 'R01'").withColumnRenamed("region_english", "unit")
    located = polygons.locate(places, units, "unit", "lon", "lat", boundary=True)
    best = context.largest_overlap(V.cells(spark, sf), units, "unit", 0.02)
    pop = context.unit_population(best, "unit")
    return context.devices_and_population(located, "unit", pop)


UNIT_SQL = with_views("cells", "boxes", "dwells").rstrip() + """, o as (select wp_index, raster_val, region_english,
    greatest(least(x+0.02, x1)-greatest(x, x0), 0)*greatest(least(y+0.02, y1)-greatest(y, y0), 0) as area from cells, boxes
    where region_english <> 'R01'), best as (select *, row_number() over (partition by wp_index
    order by round(area, 12) desc, region_english) as rn from o where area > 0)""" + HOMES_IN + """, du as (select unit, count(*)/1e6 as devices,
    any_value(population)/1e6 as population from u left join pop using (unit) group by 1)"""


@query("ag23_devices_per_unit", UNIT_SQL + " select unit, round(devices, 9) as devices, round(population, 9) as population from du")
def _(spark, sf):
    return _device_units(spark, sf).select("unit", r("devices", 9).alias("devices"), r("population", 9).alias("population"))


@query("ag24_unit_population", with_views("cells") + """select wp_index % 9 as unit, round(sum(greatest(raster_val, 0)), 4) as population
    from cells group by 1""")
def _(spark, sf):
    tagged = V.cells(spark, sf).withColumn("unit", F.col("wp_index") % 9)
    return context.unit_population(tagged, "unit").select("unit", r("population", 4).alias("population"))


PARENT_SQL = UNIT_SQL + """, par as (select case when unit in ('R0', 'R2', 'R4') then 'even' else 'odd' end as parent,
    sum(devices) as devices, sum(population) as population from du group by 1)"""


@query("st13_population_and_devices", PARENT_SQL + """ select 'unit' as level, count(*) as n, round(corr(devices, population), 6) as r,
    round(sum(devices)/nullif(sum(population), 0), 9) as ratio from du union all select 'parent', count(*), round(corr(devices, population), 6),
    round(sum(devices)/nullif(sum(population), 0), 9) from par""")
def _(spark, sf):
    from ..operators.checkpoints import cut
    from ..operators.estimates import simple_fit

    units = cut(_device_units(spark, sf))
    parent = F.when(F.col("unit").isin("R0", "R2", "R4"), "even").otherwise("odd")
    parents = context.roll_up(units, units.select("unit", parent.alias("parent")), "unit", "parent")
    both = units.select(F.lit("unit").alias("level"), "devices", "population").unionByName(
        parents.select(F.lit("parent").alias("level"), "devices", "population")
    )
    fit = simple_fit(both, "population", "devices", ["level"])
    n = both.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return fit.join(n, "level").select("level", "n", r("r").alias("r"), r("ratio", 9).alias("ratio"))


@query("st12_simple_fit", """select l_returnflag, round(corr(l_extendedprice, l_quantity), 9) as r,
    round(regr_r2(l_extendedprice, l_quantity), 9) as r2, round(regr_slope(l_extendedprice, l_quantity), 6) as slope,
    round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(sum(l_extendedprice)/sum(l_quantity), 6) as ratio,
    min(l_quantity) as x_min, max(l_quantity) as x_max, round(sum(l_extendedprice)/sum(l_quantity)*min(l_quantity), 4) as y_at_min,
    round(sum(l_extendedprice)/sum(l_quantity)*max(l_quantity), 4) as y_at_max from lineitem group by 1""")
def _(spark, sf):
    fit = estimates.simple_fit(V.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return fit.select(
        "l_returnflag", r("r", 9).alias("r"), r("r2", 9).alias("r2"), r("slope").alias("slope"),
        r("intercept", 4).alias("intercept"), r("ratio").alias("ratio"), "x_min", "x_max",
        r("y_at_min", 4).alias("y_at_min"), r("y_at_max", 4).alias("y_at_max"),
    )


@query("ag25_repeated_coordinates", with_views("dwells") + "select longitude, latitude, count(*) as n from dwells group by 1, 2 having count(*) > 3")
def _(spark, sf):
    return V.dwells(spark, sf).groupBy("longitude", "latitude").agg(F.count(F.lit(1)).alias("n")).filter("n > 3")


@query("ag26_share", with_views("econ") + """select name_1, strftime(day, '%Y-%m-%d') as day,
    round(sum(caid_unique)/nullif(sum(caid_unique)+count(*), 0), 9) as rate,
    case when sum(caid_unique)/nullif(sum(caid_unique)+count(*), 0) > 0.769 then 1 else 0 end as above from econ group by 1, 2""")
def _(spark, sf):
    days = V.econ(spark, sf).groupBy("name_1", "day").agg(
        F.sum("caid_unique").alias("false_alarm"), F.count(F.lit(1)).alias("true_alarm")
    )
    return estimates.false_alarm_rates(days).select(
        "name_1", F.col("day").cast("string").alias("day"), r("false_alarm_rate", 9).alias("rate"),
        F.col("abv_med_falserate").alias("above"),
    )


@query("ag27_weighted_mean", with_views("econ") + """select name_1, round(sum(dwells_shops*caid_unique)/sum(caid_unique), 6) as mean
    from econ group by 1""")
def _(spark, sf):
    weighted = F.sum(F.col("dwells_shops") * F.col("caid_unique")) / F.sum("caid_unique")
    return V.econ(spark, sf).groupBy("name_1").agg(r(weighted).alias("mean"))


@query("ag28_missing_counts", with_views("city_panel") + """select count(*) as n, count(*) - count(city) as no_city,
    count(*) - count(altitude_avg) as no_altitude, count(*) - count(start_raid_min) as no_alert from city_panel""")
def _(spark, sf):
    missing = lambda c: F.count_if(F.col(c).isNull())
    return city_panel(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), missing("city").alias("no_city"), missing("altitude_avg").alias("no_altitude"),
        missing("start_raid_min").alias("no_alert"),
    )


# --- windows ------------------------------------------------------------------------------------------------

@query("wn1_lag", with_views("lagged") + "select caid, utc_timestamp, pt as prev_t, plat as prev_lat, plon as prev_lon from lagged")
def _(spark, sf):
    return speeds(spark, sf).select(
        "caid", "utc_timestamp", F.col("prev_utc_timestamp").alias("prev_t"), F.col("prev_latitude").alias("prev_lat"),
        F.col("prev_longitude").alias("prev_lon"),
    )


@query("wn2_partition_extremes", """select event_id, min(value) over (partition by user_id, date_trunc('hour', ts)) as lo,
    max(value) over (partition by user_id, date_trunc('hour', ts)) as hi from events""")
def _(spark, sf):
    whole = W.partitionBy("user_id", F.date_trunc("hour", "ts"))
    return V.table(spark, sf, "events").select(
        "event_id", F.min("value").over(whole).alias("lo"), F.max("value").over(whole).alias("hi")
    )


@query("wn3_next_known", with_views("nexts") + f"""select caid, {sql_time('minute')} as minute, city,
    {sql_time('start_raid_next')} as start_raid_next from nexts""")
def _(spark, sf):
    near = events.next_alert(events.plausible_days(city_panel(spark, sf)))
    return near.select("caid", text("minute").alias("minute"), "city", text("start_raid_next").alias("start_raid_next"))


@query("wn5_trailing_mean", with_views("econ").rstrip() + """, d as (select name_1, day, avg(dwells_shops) as v from econ group by 1, 2)
    select name_1, strftime(day, '%Y-%m-%d') as day, round(case when count(*) over a = 3 then avg(v) over a end, 6) as m3,
    round(case when count(*) over b = 7 then avg(v) over b end, 6) as m7 from d
    window a as (partition by name_1 order by day rows between 2 preceding and current row),
    b as (partition by name_1 order by day rows between 6 preceding and current row)""")
def _(spark, sf):
    daily = V.econ(spark, sf).groupBy("name_1", "day").agg(F.avg("dwells_shops").alias("v"))
    three = estimates.trailing_mean(daily, ["name_1"], "day", "v", 3, "m3")
    both = estimates.trailing_mean(three, ["name_1"], "day", "v", 7, "m7")
    return both.select("name_1", F.col("day").cast("string").alias("day"), r("m3").alias("m3"), r("m7").alias("m7"))


@query("wn8_median_threshold", with_views("event_panel").rstrip() + f""", m as (select start_raid_next, region_english,
    quantile_disc(distance_sum, 0.5) as med from event_panel group by 1, 2)
    select caid, {sql_time('minute')} as minute, city, case when distance_sum >= med then 1 else 0 end as flag
    from event_panel join m using (start_raid_next, region_english)""")
def _(spark, sf):
    flagged = events.approx_median_flag(event_panel(spark, sf), "distance_sum", "flag")
    return flagged.select("caid", text("minute").alias("minute"), "city", "flag")


@query("wn9_above_median", """with l as (select l_orderkey, l_linenumber, l_extendedprice as v from lineitem),
    m as (select l_linenumber, median(v) as med from l group by 1)
    select l_orderkey, l_linenumber, v > med as grp from l join m using (l_linenumber)""")
def _(spark, sf):
    rows = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"))
    return estimates.above_median(rows, "v", ["l_linenumber"]).select("l_orderkey", "l_linenumber", "grp")


@query("wn10_position", with_views("numbered") + "select caid, utc_timestamp, pos from numbered")
def _(spark, sf):
    return trajectory.numbered_pings(pings(spark, sf)).select("caid", "utc_timestamp", "pos")


@query("wn11_running_groups", with_views("stay_cores") + """select caid, count(distinct group_no) as stays, max(pos) as last_core
    from stay_cores group by 1""")
def _(spark, sf):
    cores = trajectory.core_pings(trajectory.numbered_pings(pings(spark, sf)))
    return trajectory.stay_groups(cores).groupBy("caid").agg(
        F.count(F.lit(1)).alias("stays"), F.max("last_pos").alias("last_core")
    )


# --- order, dedup, reshape ------------------------------------------------------------------------------------

@query("so1_order_in_key", with_views("numbered") + "select caid, pos, utc_timestamp from numbered")
def _(spark, sf):
    return trajectory.numbered_pings(pings(spark, sf)).select("caid", "pos", "utc_timestamp")


@query("so2_biggest_group", """select user_id, event_type, n from (select user_id, event_type, count(*) as n, row_number() over
    (partition by user_id order by count(*) desc, event_type) as rn from events group by 1, 2) where rn = 1""")
def _(spark, sf):
    sizes = V.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return joins.first_row(sizes, ["user_id"], [-F.col("n"), F.col("event_type")])


@query("so3_largest_part", """select l_orderkey, l_linenumber, l_extendedprice from (select *, row_number() over (partition by l_orderkey
    order by l_extendedprice desc, l_linenumber, l_partkey) as rn from lineitem) where rn = 1""")
def _(spark, sf):
    lines = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    best = joins.first_row(lines, ["l_orderkey"], [-F.col("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")])
    return best.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("so4_dedup", with_views("panel") + f"select caid, {sql_time('minute')} as minute, region_english from panel")
def _(spark, sf):
    return minute_panel(spark, sf).select("caid", text("minute").alias("minute"), "region_english")


@query("so5_order_by_total", "select event_type, round(sum(value), 4) as total from events group by 1 order by total desc")
def _(spark, sf):
    totals = V.table(spark, sf, "events").groupBy("event_type").agg(r(F.sum("value"), 4).alias("total"))
    return totals.orderBy(F.desc("total"))


@query("so7_order_by_date", with_views("alert_days") + "select strftime(smart_date, '%Y-%m-%d') as smart_date, alert from alert_days order by 1")
def _(spark, sf):
    return V.alert_days(spark, sf).orderBy("smart_date").select(F.col("smart_date").cast("string").alias("smart_date"), "alert")


@query("se1_union", "select n_name as name, 'nation' as level from nation union all select r_name, 'region' from region")
def _(spark, sf):
    nations = V.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("level"))
    return nations.unionByName(
        V.table(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("level"))
    )


@query("se2_union_layers", """select n_name as name_2, cast(null as varchar) as name_1, n_name as filled from nation
    union all select null, r_name, r_name from region""")
def _(spark, sf):
    two = V.table(spark, sf, "nation").select(F.col("n_name").alias("name_2"))
    one = V.table(spark, sf, "region").select(F.col("r_name").alias("name_1"))
    return two.unionByName(one, allowMissingColumns=True).withColumn("filled", F.coalesce("name_1", "name_2"))


CONTROL_LONG_SQL = with_views("status") + "select locality, longitude, latitude, strftime(day, '%Y-%m-%d') as day, status from status"


@query("se3_dates_in_one_job", CONTROL_LONG_SQL)
def _(spark, sf):
    return front.control_long(V.control(spark, sf)).select(
        "locality", "longitude", "latitude", F.col("day").cast("string").alias("day"), "status"
    )


@query("se4_column_patterns", "select l_orderkey, l_linenumber, l_shipdate::varchar as l_shipdate from lineitem")
def _(spark, sf):
    lines = V.table(spark, sf, "lineitem")
    dates = [c for c in lines.columns if "date" in c]
    keys = [c for c in lines.columns if c in ("l_orderkey", "l_linenumber")]
    return lines.select(*keys, *[text(c).alias(c) for c in dates])


@query("se5_explode", "select doc_id, unnest(string_split(source, '/')) as part from documents")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.explode(F.split("source", "/")).alias("part"))


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("se6_pivot", "select user_id, " + ", ".join(f"nullif(count(*) filter (where event_type = '{t}'), 0) as \"{t}\"" for t in TYPES)
       + " from events group by 1")
def _(spark, sf):
    return V.table(spark, sf, "events").groupBy("user_id").pivot("event_type", TYPES).agg(F.count(F.lit(1)))


@query("se7_unpivot", """select l_orderkey, l_linenumber, name, round(v, 6) as v from (unpivot (select l_orderkey, l_linenumber, l_quantity,
    l_discount, l_tax from lineitem) on l_quantity, l_discount, l_tax into name name value v)""")
def _(spark, sf):
    lines = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return lines.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "name", "v").withColumn(
        "v", r("v")
    )


@query("se8_zero_fill", "select user_id, " + ", ".join(f"count(*) filter (where event_type = '{t}') as \"{t}\"" for t in TYPES)
       + " from events group by 1")
def _(spark, sf):
    wide = V.table(spark, sf, "events").groupBy("user_id").pivot("event_type", TYPES).agg(F.count(F.lit(1)))
    return wide.fillna(0, TYPES)


@query("se9_row_per_night", with_views("nights") + f"""select caid, {sql_time('t_local')} as date,
    unnest(range(1, greatest(1, num_days) + 1)) as night from nights""")
def _(spark, sf):
    stays = homes.overnight_stays(V.dwells(spark, sf), *V.HOME_SPAN)
    return homes.one_row_per_night(stays).select("caid", text("date").alias("date"), "night")


@query("se11_upper_lower", """select l_orderkey, l_linenumber, conf, round(case conf when 'upper' then l_quantity + l_tax*276.56 else l_quantity end, 6)
    as movement from lineitem, (values ('upper'), ('lower')) t(conf)""")
def _(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.explode(estimates.upper_lower(F.col("l_quantity"), F.col("l_tax"), F.lit(276.56))).alias("e")
    )
    return rows.select("l_orderkey", "l_linenumber", "e.conf", r("e.movement").alias("movement"))
