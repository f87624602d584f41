"""Scans, sinks, projections, filters and scalar functions."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock, geo
from ..functions import fixed_values as K
from ..operators import alerts as A
from ..operators import checkpoints, context, front, homes, joins, panel
from ..sources import sinks, tables
from . import views as V
from .common import local_alerts, minute_panel, minutes, night_windows, pings, r, speeds, text
from .registry import query
from .views import sql_arc, sql_time, with_views

# --- scans ---------------------------------------------------------------------------------------------

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()),
    ]
)


@query("src1_parquet_schema_scan", "select event_type, count(*) as n, count(distinct user_id) as users from events group by 1")
def _(spark, sf):
    scan = tables.scan_parquet(spark, f"{sf}/events.parquet", schema=EVENT_SCHEMA)
    return scan.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("src2_day_folders", """with s as (select user_id, min(cast(ts as date)) as a, max(cast(ts as date)) as b from events
    group by 1) select user_id, strftime(d, '%Y/%m/%d') as folder from
    (select user_id, unnest(generate_series(a, b, interval 1 day)) as d from s)""")
def _(spark, sf):
    day = F.to_date("ts").cast("string")
    spans = V.table(spark, sf, "events").groupBy("user_id").agg(
        F.concat(F.min(day), F.lit("/"), F.max(day)).alias("span")
    )
    return tables.day_rows(spans, "span").select("user_id", "folder")


@query("src3_narrow_scan", "select user_id, round(sum(value), 4) as total from events group by 1")
def _(spark, sf):
    narrow = T.StructType([f for f in EVENT_SCHEMA if f.name in ("user_id", "value")])
    scan = tables.scan_parquet(spark, f"{sf}/events.parquet", schema=narrow)
    return scan.groupBy("user_id").agg(r(F.sum("value"), 4).alias("total"))


@query("src4_parquet_scan", "select o_orderstatus, count(*) as n from orders group by 1")
def _(spark, sf):
    return tables.scan_parquet(spark, f"{sf}/orders.parquet").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def _scratch(spark, name):
    """A new folder for a round trip, in the shared folder of the session."""
    import uuid

    return f"{checkpoints.checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


ALERTS_TEXT_SQL = with_views("local_alerts") + f"""select region_english, {sql_time('start_dt')} as start_dt,
    {sql_time('end_dt')} as end_dt, round((end_dt-start_dt)/60.0, 6) as duration from local_alerts"""


@query("src5_csv_text_scan", ALERTS_TEXT_SQL)
def _(spark, sf):
    folder = _scratch(spark, "alerts-csv")
    out = local_alerts(spark, sf).select("region_english", text("start_dt").alias("start_dt"), text("end_dt").alias("end_dt"))
    sinks.write_csv(out, folder)
    back = tables.scan_csv(spark, folder)
    minutes_ = clock.seconds_between(F.to_timestamp("end_dt"), F.to_timestamp("start_dt")) / 60
    return back.select("region_english", "start_dt", "end_dt", r(minutes_).alias("duration"))


@query("src6_csv_typed_scan", "select l_returnflag, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by 1")
def _(spark, sf):
    folder = _scratch(spark, "lineitem-csv")
    sinks.write_csv(V.table(spark, sf, "lineitem").select("l_returnflag", "l_quantity"), folder)
    back = tables.scan_csv(spark, folder, schema="l_returnflag string, l_quantity double")
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity"), 2).alias("qty"))


@query("src7_toggle_json", with_views("toggles") + """select cast(dense_rank() over (order by name, hour) - 1 as bigint) as place,
    row_number() over (partition by name, hour order by t) - 1 as position, t from
    (select *, region_ukrainian || '-' || cast(t//86400 as varchar) as name, t//3600 as hour from toggles)""")
def _(spark, sf):
    # one file of lists per region and day, with a list of switch times per hour, written and read back
    name = F.concat_ws("-", "region_ukrainian", F.floor(F.col("t") / 86400).cast("string"))
    lists = V.toggles(spark, sf).groupBy(name.alias("name"), F.floor(F.col("t") / 3600).alias("hour")).agg(
        F.sort_array(F.collect_list("t")).alias("locations")
    )
    files = lists.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("hour", "locations"))).alias("entries"))
    body = F.concat(F.lit("\ufeff"), F.to_json(F.transform("entries", lambda e: F.struct(e["locations"].alias("locations")))))
    folder = _scratch(spark, "toggles")
    sinks.write_text(files.select("name", body.alias("value")), folder, ["name"])
    return tables.scan_toggle_log(spark, folder).select("place", "position", "t")


LINK = '<a href="([^"]*)">([^<]*)</a>'


@query("src8_label_dictionary", f"""with f as (select page_id, unnest(regexp_extract_all(html, '{LINK}', 1)) as v,
    unnest(regexp_extract_all(html, '{LINK}', 2)) as label,
    unnest(range(1, 1 + len(regexp_extract_all(html, '{LINK}', 1)))) as pos from pages),
    s as (select page_id, pos, label, unnest(string_split(v, ', ')) as value from f)
    select page_id, value, arg_max(label, pos) as label from s group by 1, 2""")
def _(spark, sf):
    return tables.label_dictionary(V.table(spark, sf, "pages"), "html", ["page_id"], LINK, "${indent}")


@query("src9_wkt_rings", with_views("boxes") + """select region_english, 5 as corners, round(x0, 9) as x_min,
    round(x1, 9) as x_max, round(y0, 9) as y_min, round(y1, 9) as y_max from boxes""")
def _(spark, sf):
    ring = F.element_at("rings", 1)
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return V.regions(spark, sf).withColumn("rings", tables.wkt_rings(F.col("geometry"))).select(
        "region_english", F.size(ring).alias("corners"),
        r(F.array_min(xs), 9).alias("x_min"), r(F.array_max(xs), 9).alias("x_max"),
        r(F.array_min(ys), 9).alias("y_min"), r(F.array_max(ys), 9).alias("y_max"),
    )


@query("src10_checked_broadcast", """select n_name, r_name, count(*) as n from customer join nation on c_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey group by 1, 2""")
def _(spark, sf):
    nation = V.table(spark, sf, "nation").withColumnsRenamed({"n_nationkey": "c_nationkey"})
    region = V.table(spark, sf, "region").withColumnsRenamed({"r_regionkey": "n_regionkey"})
    named = joins.reference_join(V.table(spark, sf, "customer"), nation, ["c_nationkey"])
    both = joins.reference_join(named, region, ["n_regionkey"])
    return both.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))


@query("src11_table_as_frame", "select label, count(*) as n from embeddings group by 1")
def _(spark, sf):
    return V.table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# --- sinks: written by the tasks, read back ----------------------------------------------------------------

@query("snk1_parquet", with_views("pings") + "select caid, count(*) as n, min(utc_timestamp) as first_t from pings group by 1")
def _(spark, sf):
    folder = _scratch(spark, "pings")
    sinks.write_parquet(pings(spark, sf), folder)
    back = tables.scan_parquet(spark, folder, schema=tables.PING_SCHEMA)
    return back.groupBy("caid").agg(F.count(F.lit(1)).alias("n"), F.min("utc_timestamp").alias("first_t"))


@query("snk2_parquet_by_day", "select cast(cast(ts as date) as varchar) as day, count(*) as n from events "
       "where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-15' group by 1")
def _(spark, sf):
    folder = _scratch(spark, "events-by-day")
    sinks.write_parquet(V.table(spark, sf, "events").withColumn("day", F.to_date("ts")), folder, ["day"])
    back = tables.scan_parquet(spark, folder).filter(F.col("day").between("2024-01-10", "2024-01-14"))
    return back.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("snk3_csv", "select o_orderpriority, count(*) as n from orders group by 1")
def _(spark, sf):
    folder = _scratch(spark, "orders-csv")
    sinks.write_csv(V.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), folder)
    return tables.scan_csv(spark, folder).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("snk4_summary_csv", "select c_mktsegment, count(*) as n, round(avg(c_acctbal), 4) as mean from customer group by 1")
def _(spark, sf):
    folder = _scratch(spark, "segments-csv")
    summary = V.table(spark, sf, "customer").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("c_acctbal"), 4).alias("mean")
    )
    sinks.write_csv(summary, folder)
    return tables.scan_csv(spark, folder, schema="c_mktsegment string, n long, mean double")


# --- projections --------------------------------------------------------------------------------------------

@query("prj1_select", with_views("pings") + "select caid, latitude, longitude, utc_timestamp, altitude from pings")
def _(spark, sf):
    return pings(spark, sf)


@query("prj2_drop", "select * exclude (ts, props) from events")
def _(spark, sf):
    return V.table(spark, sf, "events").drop("ts", "props")


@query("prj3_derive", "select event_id, value*2 as doubled, cast(ts as date)::varchar as day, month(ts) as month from events")
def _(spark, sf):
    return V.table(spark, sf, "events").select("event_id", "value", "ts").withColumns(
        {"doubled": F.col("value") * 2, "day": F.to_date("ts").cast("string"), "month": F.month("ts")}
    ).drop("value", "ts")


@query("prj4_rename", "select s_suppkey as locality, s_name as city from supplier")
def _(spark, sf):
    return V.table(spark, sf, "supplier").select("s_suppkey", "s_name").withColumnsRenamed(
        {"s_suppkey": "locality", "s_name": "city"}
    )


@query("prj5_conditional", """select event_id, case when value > 100 then 'high' when value > 10 then 'mid' else 'low' end as band
    from events""")
def _(spark, sf):
    band = F.when(F.col("value") > 100, "high").otherwise(F.when(F.col("value") > 10, "mid").otherwise("low"))
    return V.table(spark, sf, "events").select("event_id", band.alias("band"))


FIX_ROWS = ", ".join("('{}', '{}')".format(a.replace("'", "''"), b.replace("'", "''")) for a, b in K.REGION_FIXES)


@query("prj7_value_map", f"""with m as (select doc_id, case doc_id % 4 when 0 then 'Izium' when 1 then 'Lubny' when 2 then
    'Nikopol' else 'Kherson' end as region from documents) select doc_id, region, fixed from m
    left join (values {FIX_ROWS}) f(k, fixed) on region = k""")
def _(spark, sf):
    names = F.element_at(F.array(*[F.lit(n) for n in ("Izium", "Lubny", "Nikopol", "Kherson")]),
                         (F.col("doc_id") % 4 + 1).cast("int"))
    docs = V.table(spark, sf, "documents").select("doc_id", names.alias("region"))
    return joins.map_values(docs, "region", A.region_fixes(spark), "fixed")


@query("prj8_fill_chain", """select d.doc_id, coalesce(nullif(quality, 0)*10, nullif(toxic, 0)*20, -1) as q,
    coalesce(nullif(lang, 'en'), nullif(source, 'web'), 'none') as lang from documents d left join labels l on d.doc_id = l.doc_id""")
def _(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "lang", "source")
    q = F.coalesce(F.nullif("quality", F.lit(0)) * 10, F.nullif("toxic", F.lit(0)) * 20, F.lit(-1))
    lang = F.coalesce(F.nullif("lang", F.lit("en")), F.nullif("source", F.lit("web")), F.lit("none"))
    return docs.join(V.table(spark, sf, "labels"), "doc_id", "left").select("doc_id", q.alias("q"), lang.alias("lang"))


@query("prj9_sentinel_null", with_views("raw_pings") + """select caid, utc_timestamp,
    nullif(cast(horizontal_accuracy as integer) % 5, 0) as acc, round(coalesce(altitude, 0), 4) as alt from raw_pings""")
def _(spark, sf):
    return V.raw_pings(spark, sf).select(
        "caid", "utc_timestamp", F.nullif(F.col("horizontal_accuracy").cast("int") % 5, F.lit(0)).alias("acc"),
        r(F.coalesce("altitude", F.lit(0.0)), 4).alias("alt"),
    )


@query("prj10_flags", with_views("city_panel") + f"""select caid, {sql_time('minute')} as minute, city, alert, rural,
    case when kmh_avg > 1 then 1 else 0 end as fast from city_panel""")
def _(spark, sf):
    from .common import city_panel

    return city_panel(spark, sf).select(
        "caid", text("minute").alias("minute"), "city", "alert", "rural",
        F.when(F.col("kmh_avg") > 1, 1).otherwise(0).alias("fast"),
    )


@query("prj13_list_position", """select doc_id, unnest(string_split(text, ' ')) as word,
    unnest(range(0, len(string_split(text, ' ')))) as position from documents""")
def _(spark, sf):
    docs = V.table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("position", "word"))


@query("prj14_window_tag", with_views("night_windows") + """select strftime(start_date, '%Y-%m-%d') as start_date, caid,
    count(*) as n from night_windows group by 1, 2""")
def _(spark, sf):
    return night_windows(spark, sf).groupBy(F.col("start_date").cast("string").alias("start_date"), "caid").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("prj15_unit_scaling", with_views("speeds") + """select caid, utc_timestamp, round(distance/1000, 9) as km,
    round(time_diff/60.0, 9) as mins, round(kmh/3.6, 6) as ms from speeds""")
def _(spark, sf):
    return speeds(spark, sf).select(
        "caid", "utc_timestamp", r(F.col("distance") / 1000, 9).alias("km"),
        r(F.col("time_diff") / 60, 9).alias("mins"), r(F.col("kmh") / 3.6).alias("ms"),
    )


@query("prj16_snapshot", "select count(*) as n_all, count(*) filter (where value > 50) as n_high from events")
def _(spark, sf):
    # a frame is immutable: the same variable serves both samples
    base = V.table(spark, sf, "events")
    return base.agg(F.count(F.lit(1)).alias("n_all"), F.count(F.when(F.col("value") > 50, 1)).alias("n_high"))


# --- filters ------------------------------------------------------------------------------------------------

@query("fil1_accuracy", with_views("raw_pings") + """select caid, utc_timestamp, horizontal_accuracy from raw_pings
    where horizontal_accuracy <= 150""")
def _(spark, sf):
    return V.raw_pings(spark, sf).filter(F.col("horizontal_accuracy") <= K.MAX_ACCURACY_M).select(
        "caid", "utc_timestamp", "horizontal_accuracy"
    )


@query("fil2_country", with_views("raw_pings") + "select caid, utc_timestamp from raw_pings where iso_country_code = 'UA'")
def _(spark, sf):
    return V.raw_pings(spark, sf).filter("iso_country_code = 'UA'").select("caid", "utc_timestamp")


@query("fil3_jump_filter", with_views("speeds") + "select caid, utc_timestamp, round(kmh, 6) as kmh from speeds where kmh <= 5")
def _(spark, sf):
    return panel.drop_jumps(speeds(spark, sf), 5).select("caid", "utc_timestamp", r("kmh").alias("kmh"))


@query("fil4_long_stays", with_views("dwells") + """select caid, utc_timestamp_start, stay_length_sec from dwells
    where stay_length_sec > 7200""")
def _(spark, sf):
    return V.dwells(spark, sf).filter(F.col("stay_length_sec") > K.MIN_NIGHT_STAY_S).select(
        "caid", "utc_timestamp_start", "stay_length_sec"
    )


@query("fil5_between_dates", "select event_id from events where cast(ts as date) between date '2024-01-05' and date '2024-01-09'")
def _(spark, sf):
    return V.table(spark, sf, "events").filter(F.to_date("ts").between("2024-01-05", "2024-01-09")).select("event_id")


@query("fil6_overnight", with_views("dwells") + """select caid, utc_timestamp_start from dwells where
    (utc_timestamp_start+7200)//86400 <> (utc_timestamp_start+7200+stay_length_sec)//86400""")
def _(spark, sf):
    begin = clock.local_time(F.col("utc_timestamp_start"), K.HOME_ZONE)
    finish = clock.local_time(F.col("utc_timestamp_start") + F.col("stay_length_sec"), K.HOME_ZONE)
    return V.dwells(spark, sf).filter(F.to_date(begin) != F.to_date(finish)).select("caid", "utc_timestamp_start")


@query("fil7_not_null", with_views("raw_pings") + """select caid, count(altitude) as known, count(*) - count(altitude) as missing
    from raw_pings group by 1""")
def _(spark, sf):
    alt = F.col("altitude")
    return V.raw_pings(spark, sf).groupBy("caid").agg(
        F.count_if(alt.isNotNull()).alias("known"), F.count_if(alt.isNull()).alias("missing")
    )


@query("fil8_unmatched_points", with_views("city_panel") + f"""select caid, {sql_time('minute')} as minute from city_panel
    where city is null""")
def _(spark, sf):
    from .common import city_panel

    return city_panel(spark, sf).filter("city IS NULL").select("caid", text("minute").alias("minute"))


@query("fil19_enough_nights", with_views("night_windows") + """select strftime(start_date, '%Y-%m-%d') as start_date, caid,
    sum(num_days) as nights from night_windows group by 1, 2 having sum(num_days) >= 4""")
def _(spark, sf):
    return homes.night_places(night_windows(spark, sf)).groupBy(
        F.col("start_date").cast("string").alias("start_date"), "caid"
    ).agg(F.sum("weight").alias("nights"))


@query("fil21_list_or_null", """select name, kind from (select n_name as name, case n_regionkey when 0 then 'Misto'
    when 1 then 'Mis''ka Rada' when 2 then null else 'Raion' end as kind from nation)
    where kind in ('Misto', 'Mis''ka Rada') or kind is null""")
def _(spark, sf):
    kind = F.when(F.col("n_regionkey") == 0, "Misto").when(F.col("n_regionkey") == 1, "Mis'ka Rada").when(
        F.col("n_regionkey") != 2, "Raion"
    )
    units = V.table(spark, sf, "nation").select(F.col("n_name").alias("name"), kind.alias("kind"))
    return units.filter(F.col("kind").isin(K.CITY_TYPES) | F.col("kind").isNull())


@query("fil23_drop_any_null", with_views("panel") + f"""select caid, {sql_time('minute')} as minute,
    round(altitude_avg, 6) as altitude_avg from panel
    where altitude_avg is not null and start_raid_min is not null and end_raid_max is not null""")
def _(spark, sf):
    panel_ = minute_panel(spark, sf).select("caid", "minute", "altitude_avg", "start_raid_min", "end_raid_max")
    return panel_.dropna("any").select("caid", text("minute").alias("minute"), r("altitude_avg").alias("altitude_avg"))


@query("fil25_guarded_compare", with_views("casualties") + """select strftime(event_date, '%Y-%m-%d') as event_date,
    fatalities from casualties where fatalities >= 1""")
def _(spark, sf):
    return V.casualties(spark, sf).filter("fatalities >= 1").select(
        F.col("event_date").cast("string").alias("event_date"), "fatalities"
    )


WORLD_SQL = """with world as (select case when n_nationkey = 3 then 'Antarctica' else n_name end as name,
    n_nationkey*1000000 as pop_est from nation), systems as (select n_name as country,
    case n_nationkey % 3 when 0 then 1 when 1 then 0 end as cell_broadcast,
    case n_nationkey % 4 when 0 then 1 when 1 then 0 end as sirens from nation where n_regionkey <> 4)"""


def _world(spark, sf):
    name = F.when(F.col("n_nationkey") == 3, "Antarctica").otherwise(F.col("n_name"))
    return V.table(spark, sf, "nation").select(name.alias("name"), (F.col("n_nationkey") * 1000000).alias("pop_est"))


def _systems(spark, sf):
    flag = lambda m: F.when(F.col("n_nationkey") % m == 0, 1).when(F.col("n_nationkey") % m == 1, 0)
    return V.table(spark, sf, "nation").filter("n_regionkey <> 4").select(
        F.col("n_name").alias("country"), flag(3).alias("cell_broadcast"), flag(4).alias("sirens")
    )


@query("fil26_populated_countries", WORLD_SQL + " select name, pop_est from world where pop_est > 0 and name <> 'Antarctica'")
def _(spark, sf):
    return context.alert_systems(_world(spark, sf), _systems(spark, sf)).select("name", "pop_est")


@query("tr23_alert_systems", WORLD_SQL + """ select name, coalesce(cell_broadcast, 0) as cell_broadcast,
    coalesce(sirens, 0) as sirens, case when greatest(coalesce(sirens, 0), coalesce(cell_broadcast, 0)) > 0
    then 'National Alert System' else 'No System' end as any_system from world left join systems on name = country
    where pop_est > 0 and name <> 'Antarctica'""")
def _(spark, sf):
    return context.alert_systems(_world(spark, sf), _systems(spark, sf)).select(
        "name", "cell_broadcast", "sirens", "any_system"
    )


@query("fil27_negative_to_zero", with_views("cells") + "select wp_index, round(greatest(raster_val, 0), 6) as v from cells")
def _(spark, sf):
    return V.cells(spark, sf).select("wp_index", r(F.greatest("raster_val", F.lit(0.0))).alias("v"))


@query("fil29_label_equality", with_views("night_places") + """select caid, sum(weight) as nights from night_places
    where strftime(start_date, '%Y-%m-%d') = '2024-01-20' group by 1""")
def _(spark, sf):
    places = homes.night_places(night_windows(spark, sf)).filter(F.col("start_date") == "2024-01-20")
    return places.groupBy("caid").agg(F.sum("weight").alias("nights"))


# --- scalar functions --------------------------------------------------------------------------------------

@query("fn1_local_time", with_views("dwells") + f"""select caid, utc_timestamp_start,
    {sql_time('utc_timestamp_start + 7200')} as eet, {sql_time('utc_timestamp_start + 7200')} as kyiv,
    {sql_time('utc_timestamp_start + 10800')} as fixed from dwells""")
def _(spark, sf):
    t = F.col("utc_timestamp_start")
    return V.dwells(spark, sf).select(
        "caid", t, text(clock.local_time(t, "EET")).alias("eet"), text(clock.local_time(t)).alias("kyiv"),
        text(clock.local_time(t, "GMT+3")).alias("fixed"),
    )


@query("fn2_minute_floor", "select event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') as minute from events")
def _(spark, sf):
    return V.table(spark, sf, "events").select("event_id", text(clock.minute_of(F.col("ts"))).alias("minute"))


@query("fn3_date_parts", "select event_id, year(ts) as y, month(ts) as m, day(ts) as d from events")
def _(spark, sf):
    return V.table(spark, sf, "events").select(
        "event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("d")
    )


@query("fn4_day_of_year", "select o_orderkey, dayofyear(o_orderdate) as doy from orders")
def _(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", F.dayofyear("o_orderdate").alias("doy"))


@query("fn5_shifted_month", "select o_orderkey, month(cast(o_orderdate as date) + 5) as m from orders")
def _(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", F.month(F.date_add(F.to_date("o_orderdate"), 5)).alias("m"))


@query("fn6_seconds_between", ALERTS_TEXT_SQL)
def _(spark, sf):
    minutes_ = clock.seconds_between(F.col("end_dt"), F.col("start_dt")) / 60
    return local_alerts(spark, sf).select(
        "region_english", text("start_dt").alias("start_dt"), text("end_dt").alias("end_dt"), r(minutes_).alias("duration")
    )


@query("fn7_make_date", "select o_orderkey, make_date(year(o_orderdate), month(o_orderdate), 1)::varchar as d from orders")
def _(spark, sf):
    day = F.make_date(F.year("o_orderdate"), F.month("o_orderdate"), F.lit(1))
    return V.table(spark, sf, "orders").select("o_orderkey", day.cast("string").alias("d"))


@query("fn8_previous_sunday", """select o_orderkey, strftime(cast(o_orderdate as date) - cast(case when
    dayofweek(o_orderdate) = 0 then 7 else dayofweek(o_orderdate) end as integer), '%Y-%m-%d') as sunday from orders""")
def _(spark, sf):
    return V.table(spark, sf, "orders").select(
        "o_orderkey", clock.previous_sunday(F.to_date("o_orderdate")).cast("string").alias("sunday")
    )


@query("fn9_replace_strip", """select n_nationkey, trim(replace(regexp_replace('[''' || n_name || ' oblast'']', '[\\[\\]'']', '', 'g'),
    ' oblast', '')) as name from nation""")
def _(spark, sf):
    label = F.concat(F.lit("['"), "n_name", F.lit(" oblast']"))
    return V.table(spark, sf, "nation").select(
        "n_nationkey", F.trim(A.tidy_region(homes.clean_zone(label))).alias("name")
    )


@query("fn10_substring", "select doc_id, substr(text, 6, 2) as part, substr(text, 20) as rest, length(text) as n from documents")
def _(spark, sf):
    return V.table(spark, sf, "documents").select(
        "doc_id", F.substring("text", 6, 2).alias("part"), F.expr("substring(text, 20)").alias("rest"),
        F.length("text").alias("n"),
    )


@query("fn11_split_concat", """select event_id, concat(strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S'), event_type) as id,
    contains(event_type, 'i') as has_i, len(string_split(props, '"')) as pieces from events""")
def _(spark, sf):
    return V.table(spark, sf, "events").select(
        "event_id", F.concat(text("ts"), "event_type").alias("id"), F.col("event_type").contains("i").alias("has_i"),
        F.size(F.split("props", '"')).alias("pieces"),
    )


@query("fn12_asinh_log", "select event_id, round(asinh(value), 9) as a, round(ln(1+value), 9) as l from events")
def _(spark, sf):
    return V.table(spark, sf, "events").select(
        "event_id", r(F.asinh("value"), 9).alias("a"), r(F.log1p("value"), 9).alias("l")
    )


@query("fn13_distances", with_views("lagged") + f"""select caid, utc_timestamp,
    round({V._chord('plat', 'plon', 'latitude', 'longitude')}, 4) as chord,
    round({sql_arc('plat', 'plon', 'latitude', 'longitude')}, 4) as arc from lagged""")
def _(spark, sf):
    s = speeds(spark, sf)
    pair = [F.col(c) for c in ("prev_latitude", "prev_longitude", "latitude", "longitude")]
    return s.select("caid", "utc_timestamp", r(geo.chord_m(*pair), 4).alias("chord"), r(geo.arc_m(*pair), 4).alias("arc"))


@query("fn14_radians", with_views("pings") + "select caid, utc_timestamp, round(radians(latitude), 12) as rad from pings")
def _(spark, sf):
    return pings(spark, sf).select("caid", "utc_timestamp", r(F.radians("latitude"), 12).alias("rad"))


@query("fn15_speed", with_views("speeds") + "select caid, utc_timestamp, time_diff, round(kmh, 6) as kmh from speeds")
def _(spark, sf):
    return speeds(spark, sf).select("caid", "utc_timestamp", "time_diff", r("kmh").alias("kmh"))


@query("fn16_row_max_label", """select doc_id, case when greatest(quality, toxic) > 0 then 'yes' else 'no' end as any_flag from labels""")
def _(spark, sf):
    return V.table(spark, sf, "labels").select(
        "doc_id", F.when(F.greatest("quality", "toxic") > 0, "yes").otherwise("no").alias("any_flag")
    )


@query("fn17_safe_cast", "select conv_id, turn, try_cast(text as double) as num, try_cast(cast(turn as varchar) as double) as t from conversations")
def _(spark, sf):
    return V.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("text").try_cast("double").alias("num"),
        F.col("turn").cast("string").try_cast("double").alias("t"),
    )


@query("fn18_row_id", "select count(*) as n, count(*) as ids from events")
def _(spark, sf):
    tagged = V.dwells(spark, sf).withColumn("rowid", F.monotonically_increasing_id())
    return tagged.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rowid").alias("ids"))


@query("fn19_interval_test", with_views("located", "local_alerts") + f"""select caid, {sql_time('minute')} as minute,
    count(*) as n from located l join local_alerts a on l.region_english = a.region_english
    and minute >= start_dt and minute <= end_dt group by 1, 2""")
def _(spark, sf):
    from ..operators.polygons import locate

    placed = locate(minutes(spark, sf), V.regions(spark, sf), "region_english")
    return panel.active_alerts(placed, local_alerts(spark, sf)).groupBy(
        "caid", text("minute").alias("minute")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("fn20_range_helpers", with_views("cores") + """select caid, pos, least(s, lag(s) over w) as start_t,
    greatest(e, lag(e) over w) as end_t, coalesce(lag(e) over w >= s, false) as joinable from cores
    window w as (partition by caid order by pos)""")
def _(spark, sf):
    from ..operators import trajectory
    from ..operators.ordered import previous_row

    cores = trajectory.core_pings(trajectory.numbered_pings(pings(spark, sf))).filter("inner AND is_core")
    # positions in blocks are chunks too: the last core of a block is handed to the next one
    pairs = previous_row(
        cores.select("caid", "pos", "span_start", "span_end"), ["caid"], ["pos"], ["span_start", "span_end"],
        F.floor(F.col("pos") / trajectory.BLOCK),
    )
    return pairs.select(
        "caid", "pos", F.least("span_start", "prev_span_start").alias("start_t"),
        F.greatest("span_end", "prev_span_end").alias("end_t"),
        F.coalesce(F.col("prev_span_end") >= F.col("span_start"), F.lit(False)).alias("joinable"),
    )


@query("fn23_base_ratio", with_views("econ") + """select name_1, month(day) as m, round(sum(dwells_shops)/
    nullif(sum(sum(case when month(day) = 1 then dwells_shops end)) over (partition by name_1), 0), 6) as ratio
    from econ group by 1, 2""")
def _(spark, sf):
    monthly = V.econ(spark, sf).groupBy("name_1", F.month("day").alias("m")).agg(F.sum("dwells_shops").alias("v"))
    from pyspark.sql import Window as W

    base = F.sum(F.when(F.col("m") == 1, F.col("v"))).over(W.partitionBy("name_1"))
    return monthly.withColumn("base", base).select("name_1", "m", r(F.try_divide("v", "base")).alias("ratio"))


CONTROL_SQL = with_views("status") + "select locality, strftime(day, '%Y-%m-%d') as day, status from status"


@query("fn24_date_from_name", with_views("status") + "select strftime(day, '%Y-%m-%d') as day, count(*) as n from status group by 1")
def _(spark, sf):
    long = front.control_long(V.control(spark, sf))
    return long.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("fn25_status_recode", CONTROL_SQL)
def _(spark, sf):
    return front.control_long(V.control(spark, sf)).select("locality", F.col("day").cast("string").alias("day"), "status")


@query("st18_install_series", """with i as (select o_orderkey, cast(o_orderdate as date) as d, case when o_orderkey % 7 = 0
    then 'n/a' else cast(cast(floor(o_totalprice) as bigint) as varchar) end as unique_installs from orders)
    select o_orderkey, strftime(d, '%Y-%m-%d') as date, round(try_cast(unique_installs as double)/1e6, 9) as unique_installs
    from i where try_cast(unique_installs as double) is not null and d < date '1996-10-01'""")
def _(spark, sf):
    installs = V.table(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.floor("o_totalprice").cast("string"))
        .alias("unique_installs"),
    )
    out = context.install_series(installs, "date", "unique_installs", "1996-10-01")
    return out.select("o_orderkey", F.col("date").cast("string").alias("date"), r("unique_installs", 9).alias("unique_installs"))
