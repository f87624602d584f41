"""Geometry, panel, trajectory and home queries."""

from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import events, homes, polygons, trajectory
from ..sources.tables import wkt_rings
from . import views as V
from .common import city_panel, event_panel, home_table, minute_panel, minutes, night_windows, pings, r, text
from .registry import query
from .views import sql_day, sql_time, with_views

PANEL_COLS = ["kmh_avg", "distance_avg", "distance_sum", "longitude_center", "latitude_center", "altitude_avg"]
PANEL_SQL = ", ".join(f"round({c}, 6) as {c}" for c in PANEL_COLS)


def _panel_out(df):
    return df.select(
        "caid", text("minute").alias("minute"), F.col("day").cast("string").alias("day"),
        *[r(c).alias(c) for c in PANEL_COLS], "region_english", "alert",
        text("start_raid_min").alias("start_raid_min"), text("end_raid_max").alias("end_raid_max"),
    )


PANEL_OUT_SQL = f"""caid, {sql_time('minute')} as minute, {sql_day('day')} as day, {PANEL_SQL}, region_english,
    alert, {sql_time('start_raid_min')} as start_raid_min, {sql_time('end_raid_max')} as end_raid_max"""


# --- geometry -----------------------------------------------------------------------------------

@query("ge1_points", with_views("pings") + "select caid, utc_timestamp, longitude as x, latitude as y from pings")
def _(spark, sf):
    point = F.struct(F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    return pings(spark, sf).withColumn("point", point).select("caid", "utc_timestamp", "point.x", "point.y")


# Star-shaped polygons with a hole, one per nation: the ray test needs more than boxes.
RING = [(0.0, 0.0), (0.16, 0.02), (0.11, 0.07), (0.17, 0.15), (0.06, 0.12), (0.01, 0.17), (0.0, 0.0)]
HOLE = [(0.05, 0.05), (0.05, 0.09), (0.09, 0.08), (0.05, 0.05)]


def _star_points():
    for ring in (RING, HOLE):
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            yield f"({ax}, {ay}, {bx}, {by})"


STAR_EDGES_SQL = f"""stars as (select n_name as unit, 30.0303+0.01307*n_nationkey + ax as x1, 49.0003+0.04103*n_nationkey + ay as y1,
    30.0303+0.01307*n_nationkey + bx as x2, 49.0003+0.04103*n_nationkey + by_ as y2 from nation,
    (values {', '.join(_star_points())}) e(ax, ay, bx, by_))"""


def stars(spark, sf):
    """Polygons as text, built from the nation table."""
    def ring(points):
        corner = [
            F.concat_ws(" ", (F.lit(30.0303) + F.lit(0.01307) * F.col("n_nationkey") + x).cast("string"),
                        (F.lit(49.0003) + F.lit(0.04103) * F.col("n_nationkey") + y).cast("string"))
            for x, y in points
        ]
        return F.concat(F.lit("("), F.concat_ws(", ", *corner), F.lit(")"))

    text_ = F.concat(F.lit("POLYGON ("), ring(RING), F.lit(", "), ring(HOLE), F.lit(")"))
    return V.table(spark, sf, "nation").select(F.col("n_name").alias("unit"), text_.alias("geometry"))


@query("ge2_point_in_polygon", with_views("minutes").rstrip() + f""", {STAR_EDGES_SQL},
    hits as (select caid, minute, unit, count(*) filter (where (y1 > latitude_center) <> (y2 > latitude_center)
      and longitude_center < (x2-x1)*(latitude_center-y1)/(y2-y1)+x1) as n from minutes, stars group by 1, 2, 3)
    select caid, {sql_time('minute')} as minute, unit from hits where n % 2 = 1""")
def _(spark, sf):
    found = polygons.locate(minutes(spark, sf), stars(spark, sf), "unit", cell=0.1)
    return found.select("caid", text("minute").alias("minute"), "unit")


@query("ge3_region_attribution", with_views("located") + f"""select caid, {sql_time('minute')} as minute,
    region_english from located""")
def _(spark, sf):
    found = polygons.locate(minutes(spark, sf), V.regions(spark, sf), "region_english")
    return found.select("caid", text("minute").alias("minute"), "region_english")


@query("ge4_city_rural", with_views("city_panel") + f"""select caid, {sql_time('minute')} as minute, city, rural
    from city_panel""")
def _(spark, sf):
    return city_panel(spark, sf).select("caid", text("minute").alias("minute"), "city", "rural")


@query("ge5_planar_km", with_views("pings") + f"""select caid, utc_timestamp,
    round(radians(longitude)*cos(radians({V.LAT0}))*6371.009, 6) as x, round(radians(latitude)*6371.009, 6) as y
    from pings""")
def _(spark, sf):
    return pings(spark, sf).select(
        "caid", "utc_timestamp", r(G.x_km(F.col("longitude"), V.LAT0)).alias("x"),
        r(G.y_km(F.col("latitude"))).alias("y"),
    )


@query("ge10_ring_area", with_views("boxes") + """select region_english,
    round((x1-x0)*(y1-y0) - 0.1*0.05 + 0.02*0.02 + 0.3*0.2, 9) as area, 4 as rings from boxes""")
def _(spark, sf):
    # a box with a hole, an island in the hole and a second part, their rings in no fixed direction
    def ring(x0, y0, dx, dy, turned=False):
        corners = [(0, 0), (dx, 0), (dx, dy), (0, dy), (0, 0)]
        points = [F.concat_ws(" ", x0 + x, y0 + y) for x, y in (corners[::-1] if turned else corners)]
        return F.concat(F.lit("("), F.concat_ws(", ", *points), F.lit(")"))

    x0, y0 = F.col("x0"), F.col("y0")
    outer = F.concat(F.lit("("), F.concat_ws(", ", *[F.concat_ws(" ", x, y) for x, y in (
        ("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))]), F.lit(")"))
    hole, island = ring(x0 + 0.1, y0 + 0.05, 0.1, 0.05), ring(x0 + 0.12, y0 + 0.06, 0.02, 0.02, True)
    text_of = F.concat(F.lit("MULTIPOLYGON (("), outer, F.lit(", "), hole, F.lit("), ("), island, F.lit("), ("), ring(x0 + 3, y0, 0.3, 0.2, True), F.lit("))"))
    shapes = V.boxes(spark, sf).select("region_english", text_of.alias("geometry"))
    counted = shapes.select("region_english", F.size(wkt_rings(F.col("geometry"))).alias("rings"))
    return polygons.polygon_areas(shapes, "region_english").join(counted, "region_english").select(
        "region_english", r("area", 9).alias("area"), "rings"
    )


@query("ge11_crowded_spots", with_views("dwells") + """select caid, longitude, latitude from dwells anti join
    (select longitude, latitude from dwells group by 1, 2 having count(*) > 3) using (longitude, latitude)""")
def _(spark, sf):
    return homes.drop_crowded_spots(V.dwells(spark, sf)).select("caid", "longitude", "latitude")


# --- panel ------------------------------------------------------------------------------------------

@query("tr12_minute_panel", with_views("panel") + f"select {PANEL_OUT_SQL} from panel")
def _(spark, sf):
    return _panel_out(minute_panel(spark, sf))


@query("tr13_alert_flag", with_views("panel") + f"""select caid, {sql_time('minute')} as minute, alert,
    {sql_time('start_raid_min')} as start_raid_min, {sql_time('end_raid_max')} as end_raid_max
    from panel where alert = 1""")
def _(spark, sf):
    return minute_panel(spark, sf).filter("alert = 1").select(
        "caid", text("minute").alias("minute"), "alert", text("start_raid_min").alias("start_raid_min"),
        text("end_raid_max").alias("end_raid_max"),
    )


EVENT_SQL = f"""caid, {sql_time('minute')} as minute, {sql_time('start_raid_next')} as start_raid_next,
    region_english, time_to_raid"""


def _event_out(df, *more):
    return df.select(
        "caid", text("minute").alias("minute"), text("start_raid_next").alias("start_raid_next"),
        "region_english", "time_to_raid", *more,
    )


@query("tr14_next_raid", with_views("nexts") + f"""select {EVENT_SQL},
    concat({sql_time('start_raid_next')}, region_english) as id from nexts""")
def _(spark, sf):
    near = events.next_alert(events.plausible_days(city_panel(spark, sf)))
    return _event_out(near, events.event_id().alias("id"))


@query("tr15_anchor_distance", with_views("anchored") + f"""select {EVENT_SQL},
    round(distance_point, 6) as distance_point from anchored""")
def _(spark, sf):
    near = events.next_alert(events.plausible_days(city_panel(spark, sf)))
    return _event_out(events.with_anchor(near), r("distance_point").alias("distance_point"))


@query("tr16_event_window", with_views("windowed") + f"select {EVENT_SQL} from windowed")
def _(spark, sf):
    near = events.next_alert(events.plausible_days(city_panel(spark, sf)))
    return _event_out(events.event_window(near, 0.5))


@query("tr17_event_cells", with_views("windowed") + """select case when time_to_raid >= -600 then time_to_raid
    else -1 end as time_to_raid_post, count(*) as n from windowed group by 1""")
def _(spark, sf):
    near = events.event_window(events.next_alert(events.plausible_days(city_panel(spark, sf))), 0.5)
    return events.with_cell(near).groupBy("time_to_raid_post").agg(F.count(F.lit(1)).alias("n"))


@query("tr18_event_panel", with_views("event_panel") + f"""select {EVENT_SQL}, minute_count, time_to_raid_post,
    round(distance_point, 6) as distance_point, city, rural from event_panel""")
def _(spark, sf):
    return _event_out(
        event_panel(spark, sf), "minute_count", "time_to_raid_post", r("distance_point").alias("distance_point"),
        "city", "rural",
    )


# --- stays ------------------------------------------------------------------------------------------

@query("tr1_window_range", with_views("numbered") + """select caid, pos, greatest(pos-18, 0) as lo,
    least(pos+18, n-1) as hi from numbered""")
def _(spark, sf):
    from pyspark.sql import Window as W

    numbered = trajectory.numbered_pings(pings(spark, sf))
    blocks = trajectory.with_halo(numbered, "pos", trajectory.BLOCK, 18)
    around = W.partitionBy("caid", "block").orderBy("pos").rowsBetween(-18, 18)
    return blocks.withColumns({"lo": F.min("pos").over(around), "hi": F.max("pos").over(around)}).filter(
        "inner"
    ).select("caid", "pos", "lo", "hi")


@query("tr2_neighbours", with_views("numbered", "near") + """select caid, pos, count(near.q) as n_near,
    coalesce(sum(near.q), 0) as q_sum from numbered left join near using (caid, pos) group by 1, 2""")
def _(spark, sf):
    near = trajectory.neighbours(trajectory.numbered_pings(pings(spark, sf))).filter("inner")
    total = F.aggregate("near", F.lit(0).cast("long"), lambda acc, q: acc + q["pos"])
    return near.select("caid", "pos", F.size("near").alias("n_near"), total.alias("q_sum"))


@query("tr3_core_test", with_views("cores") + "select caid, pos, s as span_start, e as span_end from cores")
def _(spark, sf):
    cores = trajectory.core_pings(trajectory.numbered_pings(pings(spark, sf)))
    return cores.filter("inner AND is_core").select("caid", "pos", "span_start", "span_end")


@query("tr4_stay_merging", with_views("stay_cores") + """select caid, group_no, min(pos) as first_pos,
    max(pos) as last_pos from stay_cores group by 1, 2""")
def _(spark, sf):
    cores = trajectory.core_pings(trajectory.numbered_pings(pings(spark, sf)))
    return trajectory.stay_groups(cores).select("caid", "group_no", "first_pos", "last_pos")


@query("tr5_stay_members", with_views("members") + "select caid, group_no, pos from members")
def _(spark, sf):
    return trajectory.stay_members(pings(spark, sf)).select("caid", "group_no", "pos")


STAYS_SQL = with_views("stays") + """select caid, round(latitude, 10) as latitude, round(longitude, 10) as longitude,
    utc_timestamp_start, stay_length_sec from stays"""


@query("tr6_dwell_job", STAYS_SQL)
def _(spark, sf):
    return trajectory.stays(pings(spark, sf)).select(
        "caid", r("latitude", 10).alias("latitude"), r("longitude", 10).alias("longitude"), "utc_timestamp_start",
        "stay_length_sec",
    )


# --- homes ------------------------------------------------------------------------------------------

@query("tr7_overnight_dwells", with_views("nights") + f"""select caid, round(latitude, 10) as latitude,
    round(longitude, 10) as longitude, {sql_time('t_local')} as date, num_days from nights""")
def _(spark, sf):
    nights = homes.overnight_stays(V.dwells(spark, sf), *V.HOME_SPAN)
    return nights.select(
        "caid", r("latitude", 10).alias("latitude"), r("longitude", 10).alias("longitude"), text("date").alias("date"),
        "num_days",
    )


@query("tr7_overnight_zone_column", with_views("dwells").rstrip() + """, z as (select *,
    case when caid like '%7' then 10800 else 7200 end as off from dwells)
    select caid, off, sum((utc_timestamp_start+off+stay_length_sec)//86400 - (utc_timestamp_start+off)//86400) as nights
    from z where stay_length_sec > 7200 and (utc_timestamp_start+off+stay_length_sec)//86400 <>
    (utc_timestamp_start+off)//86400 group by 1, 2""")
def _(spark, sf):
    zone = F.when(F.col("caid").endswith("7"), "['GMT+3']").otherwise("['EET']")
    dwells = V.dwells(spark, sf).withColumn("TZID", zone)
    stays = homes.overnight_stays(dwells, "2023-01-01", "2025-01-01", homes.clean_zone(F.col("TZID")))
    off = F.when(F.col("caid").endswith("7"), 10800).otherwise(7200)
    return stays.groupBy("caid", off.alias("off")).agg(F.sum("num_days").alias("nights"))


@query("tr8_home_windows", with_views("night_windows") + """select strftime(start_date, '%Y-%m-%d') as start_date,
    count(*) as stays, sum(num_days) as nights, count(distinct caid) as devices from night_windows group by 1""")
def _(spark, sf):
    return night_windows(spark, sf).groupBy(F.col("start_date").cast("string").alias("start_date")).agg(
        F.count(F.lit(1)).alias("stays"), F.sum("num_days").alias("nights"),
        F.countDistinct("caid").alias("devices"),
    )


@query("tr9_enough_nights", with_views("night_places") + """select strftime(start_date, '%Y-%m-%d') as start_date,
    caid, round(latitude, 10) as latitude, round(longitude, 10) as longitude, weight from night_places""")
def _(spark, sf):
    return homes.night_places(night_windows(spark, sf)).select(
        F.col("start_date").cast("string").alias("start_date"), "caid", r("latitude", 10).alias("latitude"),
        r("longitude", 10).alias("longitude"), "weight",
    )


@query("tr10_home_clusters", with_views("home_clusters", recursive=True) + """select
    strftime(start_date, '%Y-%m-%d') as start_date, caid, round(latitude, 10) as latitude,
    round(longitude, 10) as longitude, num_members from home_clusters""")
def _(spark, sf):
    clusters = homes.home_clusters(homes.night_places(night_windows(spark, sf)))
    return clusters.select(
        F.col("start_date").cast("string").alias("start_date"), "caid", r("latitude", 10).alias("latitude"),
        r("longitude", 10).alias("longitude"), "num_members",
    )


@query("tr11_home_locations", with_views("homes", recursive=True) + """select caid, round(latitude, 10) as latitude,
    round(longitude, 10) as longitude, start_date from homes""")
def _(spark, sf):
    return home_table(spark, sf).select(
        "caid", r("latitude", 10).alias("latitude"), r("longitude", 10).alias("longitude"), "start_date"
    )
