"""Event study queries: samples, regressions, scenario grid, front distance and estimate tables."""

from pyspark.sql import functions as F

from ..operators import estimates as T
from ..operators import events, front, regression
from ..operators.checkpoints import cut
from ..operators.quantiles import describe
from ..plans.study import event_study, sample_rules, scenario_grid, window_study, with_periods
from . import views as V
from .common import city_panel, event_keys, event_panel, local_alerts, r, study_homes, text
from .registry import query
from .views import sql_effects, sql_time, with_views

KEYS = ["start_raid_next", "region_english"]
KEYS_SQL = f"{sql_time('start_raid_next')} as start_raid_next, region_english"


# --- samples ----------------------------------------------------------------------------------------

@query("fil9_plausible_device_days", with_views("good_days") + f"""select caid, {sql_time('minute')} as minute,
    city from good_days""")
def _(spark, sf):
    return events.plausible_days(city_panel(spark, sf)).select("caid", text("minute").alias("minute"), "city")


@query("fil10_nonzero_anchor_distance", with_views("event_panel") + f"""select caid, {KEYS_SQL},
    count(*) as n from event_panel where distance_point is not null and distance_point <> 0 group by all""")
def _(spark, sf):
    rows = regression.long_outcomes(event_panel(spark, sf), ["distance_point"]).filter("scale = ''")
    return rows.groupBy("caid", *event_keys()).agg(F.count(F.lit(1)).alias("n"))


@query("fil11_consistent_sample", with_views("nights").rstrip() + """, m as (select caid,
    case when m between 3 and 4 then 1 when m between 5 and 6 then 2 when m between 7 and 9 then 3 end as period
    from (select 'c'||cast(o_custkey as varchar) as caid, month(o_orderdate) as m from orders))
    select caid, count(*) as n from m semi join (select caid from m group by 1 having count(distinct period) = 3)
    using (caid) group by 1""")
def _(spark, sf):
    rows = V.table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("caid"),
        F.to_date("o_orderdate").alias("day"),
    )
    return events.consistent_sample(events.with_period(rows)).groupBy("caid").agg(F.count(F.lit(1)).alias("n"))


@query("fil12_balanced_minutes", with_views("balanced") + f"select caid, {sql_time('minute')} as minute, city, "
       f"{KEYS_SQL}, minute_count from balanced")
def _(spark, sf):
    near = events.next_alert(events.plausible_days(city_panel(spark, sf)))
    kept = events.balanced_events(events.event_window(near, 0.5), 0.5)
    return kept.select("caid", text("minute").alias("minute"), "city", *event_keys(), "minute_count")


@query("fil13_urban_rural", with_views("event_panel") + """select rural, count(*) as n,
    count(distinct caid) as devices from event_panel group by 1""")
def _(spark, sf):
    panel = event_panel(spark, sf)
    count = [F.count(F.lit(1)).alias("n"), F.countDistinct("caid").alias("devices")]
    return panel.groupBy("rural").agg(*count)


def _with_homes(*names: str) -> str:
    """Views with the homes of the events' month, from the dwells of that month."""
    views = with_views(*names, "homes", recursive=True)
    for given, own in zip(V.HOME_SPAN, V.STUDY_SPAN):
        views = views.replace(f"'{given}'", f"'{own}'")
    return V.instead(views, dwells="study_dwells")


HOMES_SQL = """, home_d as (select e.*, """ + V._chord("latitude_center", "longitude_center", "latitude", "longitude") + f""" as
    distance_home from event_panel e join homes h on e.caid = h.caid and
    month(cast({sql_time('start_raid_next')} as timestamp)) = month(cast(h.start_date as date) + 5)),
    home_min as (select *, min(distance_home) over (partition by caid, start_raid_next, region_english)
    as distance_home_min from home_d)"""


@query("tr19_home_distance", _with_homes("event_panel").rstrip() + HOMES_SQL + f"""
    select caid, {sql_time('minute')} as minute, city, {KEYS_SQL}, round(distance_home, 4) as distance_home,
    round(distance_home_min, 4) as distance_home_min from home_min""")
def _(spark, sf):
    near = events.home_distances(event_panel(spark, sf), study_homes(spark, sf))
    return near.select(
        "caid", text("minute").alias("minute"), "city", *event_keys(), r("distance_home", 4).alias("distance_home"),
        r("distance_home_min", 4).alias("distance_home_min"),
    )


@query("fil14_away_from_home", _with_homes("event_panel").rstrip() + HOMES_SQL + f"""
    select caid, {KEYS_SQL}, count(*) as n from home_min where distance_home_min > 1000 group by all""")
def _(spark, sf):
    near = events.away_from_home(event_panel(spark, sf), study_homes(spark, sf), 1000)
    return near.groupBy("caid", *event_keys()).agg(F.count(F.lit(1)).alias("n"))


@query("fil15_on_the_move", with_views("event_panel").rstrip() + f""", m as (select *, min(kmh_avg) over
    (partition by caid, start_raid_next, region_english) as low from event_panel)
    select caid, {KEYS_SQL}, count(*) as n, round(min(low), 6) as kmh_avg_min from m where low > 0.02 group by all""")
def _(spark, sf):
    near = events.on_the_move(event_panel(spark, sf), 0.02)
    return near.groupBy("caid", *event_keys()).agg(
        F.count(F.lit(1)).alias("n"), r(F.min("kmh_avg_min")).alias("kmh_avg_min")
    )


@query("fil16_exclude_names", with_views("event_panel") + f"""select {KEYS_SQL}, count(*) as n from event_panel
    where not (region_english like '%R3%' or region_english like '%R01%') group by all""")
def _(spark, sf):
    kept = events.exclude_names(event_panel(spark, sf), ["R3", "R01"])
    return kept.groupBy(*event_keys()).agg(F.count(F.lit(1)).alias("n"))


@query("fil17_wide_spread_events", with_views("event_panel") + f"""select {KEYS_SQL}, count(*) as n,
    round(max(altitude_avg)-min(altitude_avg), 6) as spread from event_panel group by all
    having max(altitude_avg)-min(altitude_avg) >= 250""")
def _(spark, sf):
    kept = events.wide_spread_events(event_panel(spark, sf), "altitude_avg", 250)
    spread = F.max("altitude_avg") - F.min("altitude_avg")
    return kept.groupBy(*event_keys()).agg(F.count(F.lit(1)).alias("n"), r(spread).alias("spread"))


@query("fil18_large_events", with_views("windowed") + f"""select {KEYS_SQL}, count(*) as n from windowed
    group by all having count(*) >= 700""")
def _(spark, sf):
    near = events.event_window(events.next_alert(events.plausible_days(city_panel(spark, sf))), 0.5)
    return events.large_events(near, 700).groupBy(*event_keys()).agg(F.count(F.lit(1)).alias("n"))


LONG_SQL = """, long_alerts as (select distinct region_english, start_dt//60*60 as start_raid_next from local_alerts
    where (end_dt - start_dt)/60.0 > 34)"""


@query("fil20_long_alerts", with_views("nexts", "local_alerts").rstrip() + LONG_SQL + f"""
    select {KEYS_SQL}, count(*) as n from nexts semi join long_alerts using (region_english, start_raid_next)
    group by all""")
def _(spark, sf):
    near = events.next_alert(events.plausible_days(city_panel(spark, sf)))
    long = events.long_alerts(local_alerts(spark, sf), 34 / 60)
    return near.join(long, events.EVENT, "left_semi").groupBy(*event_keys()).agg(F.count(F.lit(1)).alias("n"))


# --- regressions --------------------------------------------------------------------------------------

@query("st1_event_ols", with_views("effects") + f"""select {KEYS_SQL}, cell as time_to_raid_post, n,
    round(b, 6) as b from effects""")
def _(spark, sf):
    fit = regression.dummy_effects(event_panel(spark, sf), KEYS, "distance_sum")
    return fit.select(*event_keys(), "time_to_raid_post", "n", r("b").alias("b"))


@query("st1_event_ols_without_base", with_views("event_panel").rstrip() + """, late as
    (select * from event_panel where time_to_raid_post >= 0), fx as (""" + sql_effects("late", "distance_sum") +
       f") select {KEYS_SQL}, cell as time_to_raid_post, round(b, 6) as b from fx")
def _(spark, sf):
    late = event_panel(spark, sf).filter("time_to_raid_post >= 0")
    fit = regression.dummy_effects(late, KEYS, "distance_sum")
    return fit.select(*event_keys(), "time_to_raid_post", r("b").alias("b"))


# distance stand-in for the interaction: km to a fixed point, different for every device
DIST_SQL = "(longitude_center - 30)*72 + (latitude_center - 49)*7"


def _with_distance(panel):
    return panel.withColumn(
        "distance_to_front", (F.col("longitude_center") - 30) * 72 + (F.col("latitude_center") - 49) * 7
    )


LINES_SQL = with_views("event_panel").rstrip() + f""", lines as (select start_raid_next, region_english,
    time_to_raid_post as cell, regr_slope(distance_sum, {DIST_SQL}) as s, regr_intercept(distance_sum, {DIST_SQL}) as a
    from event_panel group by 1, 2, 3), based as (select *, max(case when cell = -1 then s end) over g as s0,
    max(case when cell = -1 then a end) over g as a0 from lines
    window g as (partition by start_raid_next, region_english))"""
TERMS_SQL = f"""select {KEYS_SQL}, 'cell' as term, cell, round(a - a0, 4) as b from based where cell <> -1
    union all select {KEYS_SQL}, 'cell_x', cell, round(s - s0, 4) from based where cell <> -1
    union all select {KEYS_SQL}, 'x', null, round(s0, 4) from based where cell = -1"""


@query("st2_interacted_ols", LINES_SQL + TERMS_SQL)
def _(spark, sf):
    fit = regression.interacted_effects(
        _with_distance(event_panel(spark, sf)), KEYS, "distance_sum", "distance_to_front"
    )
    return fit.select(*event_keys(), "term", "cell", r("b", 4).alias("b"))


@query("st3_interacted_solver", LINES_SQL + TERMS_SQL)
def _(spark, sf):
    sums = regression.cell_slopes(
        _with_distance(event_panel(spark, sf)), KEYS, "distance_sum", "distance_to_front"
    )
    return regression.solve_interacted(sums, KEYS).select(*event_keys(), "term", "cell", r("b", 4).alias("b"))


@query("st3_grouped_ols", """select l_returnflag, term, round(case term when 'l_quantity' then
    (sxy*sww-swy*sxw)/(sxx*sww-sxw*sxw) else (swy*sxx-sxy*sxw)/(sxx*sww-sxw*sxw) end, 4) as b from
    (select l_returnflag, covar_pop(l_quantity, l_extendedprice) as sxy, covar_pop(l_discount, l_extendedprice) as swy,
     var_pop(l_quantity) as sxx, var_pop(l_discount) as sww, covar_pop(l_quantity, l_discount) as sxw
     from lineitem group by 1), (values ('l_quantity'), ('l_discount')) t(term)""")
def _(spark, sf):
    fit = regression.grouped_ols(
        V.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", ["l_quantity", "l_discount"]
    )
    return fit.select("l_returnflag", "term", r("b", 4).alias("b"))


# the sample of devices seen in all three periods needs pings in all of them
PERIOD_SQL = V.instead(with_views("event_panel").rstrip(), raw_pings="period_pings", alerts="period_alerts")
OUTCOMES = ["distance_sum", "kmh_avg", "distance_point", "altitude_avg"]


def _period_panel(spark, sf):
    return event_panel(spark, sf, ping_view=V.period_pings, alert_view=V.period_alerts)


@query("st4_outcome_grid", PERIOD_SQL + f""", periods as (select caid, count(distinct case
    when m between 3 and 4 then 1 when m between 5 and 6 then 2 when m between 7 and 9 then 3 end) as n_periods
    from (select caid, month(cast({sql_time('day')} as timestamp)) as m from event_panel) group by 1),
    seen as (select * from event_panel join periods using (caid)), grid as (
    select s.*, outcome, scale, sample, case when scale = 'log' then asinh(v) else v end as y from
    (select *, unnest(['distance_sum', 'kmh_avg', 'distance_point', 'altitude_avg']) as outcome,
     unnest([distance_sum, kmh_avg, distance_point, altitude_avg]) as v from seen) s,
    (values (''), ('log')) t(scale), (values (''), ('_sample')) u(sample)
    where v is not null and (outcome <> 'distance_point' or v <> 0) and (sample = '' or n_periods = 3)), fx as (""" +
       sql_effects("grid", "y", "start_raid_next, region_english, outcome, scale, sample") +
       f""") select {KEYS_SQL}, outcome, scale, sample, cell as time_to_raid_post, n, round(b, 6) as b from fx""")
def _(spark, sf):
    rules = {(name,): rule for name, rule in sample_rules().items()}
    fit = regression.grid_effects(with_periods(_period_panel(spark, sf)), KEYS, OUTCOMES, rules)
    return fit.select(*event_keys(), "outcome", "scale", "sample", "time_to_raid_post", "n", r("b").alias("b"))


SAMPLES_SQL = HOMES_SQL + """, moves as (select *,
    min(kmh_avg) over (partition by caid, start_raid_next, region_english) as low from event_panel), samples as (
    select 'base' as scenario, start_raid_next, region_english, time_to_raid_post, distance_sum as y from event_panel
    union all select 'rural', start_raid_next, region_english, time_to_raid_post, distance_sum from event_panel where rural = 1
    union all select 'urban', start_raid_next, region_english, time_to_raid_post, distance_sum from event_panel where rural = 0
    union all select 'away_from_home', start_raid_next, region_english, time_to_raid_post, distance_sum from home_min
      where distance_home_min > 100
    union all select 'moving', start_raid_next, region_english, time_to_raid_post, distance_sum from moves where low > 0.3
    )"""


@query("st5_scenario_samples", _with_homes("event_panel").rstrip() + SAMPLES_SQL + """, scaled as (select scenario, start_raid_next,
    region_english, time_to_raid_post, scale, case when scale = 'log' then asinh(y) else y end as y
    from samples, (values (''), ('log')) t(scale)), fx as (""" +
       sql_effects("scaled", "y", "scenario, scale, start_raid_next, region_english") +
       f""") select scenario, scale, {KEYS_SQL}, cell as time_to_raid_post, n, round(b, 6) as b from fx""")
def _(spark, sf):
    fit = event_study(event_panel(spark, sf), study_homes(spark, sf), ["distance_sum"]).filter("sample = ''")
    return fit.select("scenario", "scale", *event_keys(), "time_to_raid_post", "n", r("b").alias("b"))


# --- longer windows: 500 minutes around one alert of 245 minutes ----------------------------------------

def _long_sql(hours: int) -> str:
    """Event panel of a longer window, as the text of common table expressions."""
    minutes = 60 * hours
    return f""", long_events_{hours} as (select distinct region_english, start_dt//60*60 as start_raid_next from local_alerts
    where (end_dt - start_dt)/60.0 > {minutes}),
    windowed_{hours} as (select * from anchored semi join long_events_{hours} using (region_english, start_raid_next)
    where time_to_raid between {-60 * minutes} and {60 * minutes}),
    panel_{hours} as (select *, {hours} as hours, case when time_to_raid >= -600 then time_to_raid else -1 end as time_to_raid_post
    from windowed_{hours} semi join (select start_raid_next, region_english from windowed_{hours} group by 1, 2
    having count(distinct minute) = {2 * minutes + 1}) using (start_raid_next, region_english))"""


LONG_WINDOW_SQL = V.instead(with_views("anchored", "local_alerts").rstrip(), raw_pings="long_pings", alerts="long_alerts")


def _long_inputs(spark, sf):
    return city_panel(spark, sf, V.long_pings, V.long_alerts), local_alerts(spark, sf, V.long_alerts)


@query("tr18_long_windows", LONG_WINDOW_SQL + _long_sql(1) + _long_sql(4) + f""", long_panels as (select * from panel_1 union all
    select * from panel_4) select hours, caid, {sql_time('minute')} as minute, city, {KEYS_SQL}, time_to_raid,
    time_to_raid_post, round(distance_point, 4) as distance_point from long_panels""")
def _(spark, sf):
    given, alerts = _long_inputs(spark, sf)
    given = cut(given)
    windows = [events.event_panel(given, alerts, h, extend=True).withColumn("hours", F.lit(h)) for h in (1, 4)]
    both = windows[0].unionByName(windows[1])
    return both.select(
        "hours", "caid", text("minute").alias("minute"), "city", *event_keys(), "time_to_raid", "time_to_raid_post",
        r("distance_point", 4).alias("distance_point"),
    )


@query("st5_long_windows", LONG_WINDOW_SQL + _long_sql(1) + _long_sql(4) + """, long_panels as (
    select hours, start_raid_next, region_english, time_to_raid_post, distance_sum as y from panel_1 union all
    select hours, start_raid_next, region_english, time_to_raid_post, distance_sum from panel_4), scaled as (
    select b.* replace (case when scale = 'log' then asinh(y) else y end as y), scale from long_panels b, (values (''), ('log')) t(scale)),
    fx as (""" + sql_effects("scaled", "y", "hours, scale, start_raid_next, region_english") +
       f""") select cast(60*hours as varchar) as scenario, scale, {KEYS_SQL}, cell as time_to_raid_post, n, round(b, 6) as b from fx""")
def _(spark, sf):
    given, alerts = _long_inputs(spark, sf)
    given = cut(given)
    fits = [window_study(given, alerts, h, ["distance_sum"]).filter("sample = ''") for h in (1, 4)]
    both = fits[0].unionByName(fits[1])
    return both.select("scenario", "scale", *event_keys(), "time_to_raid_post", "n", r("b").alias("b"))


# --- long estimates -------------------------------------------------------------------------------------

EST_SQL = with_views("effects").rstrip() + f""", est as (select concat({sql_time('start_raid_next')}, region_english) as id,
    cell, cell/60.0 as period_num, b as movement from effects)"""
CELLS = list(range(-600, 1801, 60))


def _wide(spark, sf):
    fit = regression.dummy_effects(event_panel(spark, sf), KEYS, "distance_sum")
    return regression.wide_estimates(fit, CELLS).withColumn("id", events.event_id()).drop(*KEYS)


def _long(spark, sf):
    long = T.decode_id(T.long_estimates(_wide(spark, sf), ["id"], cells=None))
    return T.with_time_period(long)


@query("prj11_dummy_columns", with_views("event_panel") + f"""select {KEYS_SQL}, sum(case when time_to_raid_post = -600
    then 1 else 0 end) as c_600, sum(case when time_to_raid_post = 0 then 1 else 0 end) as c0,
    sum(case when time_to_raid_post = 1800 then 1 else 0 end) as c1800 from event_panel group by all""")
def _(spark, sf):
    wide = events.dummy_columns(event_panel(spark, sf), CELLS)
    return wide.groupBy(*event_keys()).agg(
        F.sum("e_TYPE_-600").alias("c_600"), F.sum("e_TYPE_0").alias("c0"), F.sum("e_TYPE_1800").alias("c1800")
    )


@query("prj12_interactions", with_views("event_panel") + f"""select {KEYS_SQL}, round(sum(case when
    time_to_raid_post = 600 then altitude_avg else 0 end), 6) as total from event_panel group by all""")
def _(spark, sf):
    wide = events.dummy_columns(event_panel(spark, sf), CELLS)
    inter = events.interaction_columns(wide, ["e_TYPE_600"], "altitude_avg")
    total = F.coalesce(F.sum("(e_TYPE_600 * altitude_avg)"), F.lit(0))
    return inter.groupBy(*event_keys()).agg(r(total).alias("total"))


@query("st6_long_estimates", EST_SQL + """ select id, substr(id, 20) as region_english, substr(id, 1, 10) as day,
    substr(id, 6, 2) as month, period_num, round(movement, 6) as movement, 1 as time_period from est""")
def _(spark, sf):
    return _long(spark, sf).select(
        "id", "region_english", F.col("day").cast("string").alias("day"), "month", "period_num",
        r("movement").alias("movement"), "time_period",
    )


@query("st7_drop_unobserved", EST_SQL + """ select id, period_num, round(movement, 6) as movement from est
    where movement <> 0""")
def _(spark, sf):
    return T.drop_unobserved(_long(spark, sf)).select("id", "period_num", r("movement").alias("movement"))


BANDS_SQL = """round(avg(movement), 6) as x_mean, round(stddev_samp(movement), 6) as x_sd,
    round(avg(movement)+2*stddev_samp(movement), 6) as max_tick, round(avg(movement)-2*stddev_samp(movement), 6) as min_tick"""
BANDS = ["x_mean", "x_sd", "max_tick", "min_tick"]


@query("st8_period_bands", EST_SQL + f""" select period_num, 1 as time_period, {BANDS_SQL} from est
    where movement <> 0 group by 1""")
def _(spark, sf):
    bands = T.mean_bands(T.drop_unobserved(_long(spark, sf)), ["period_num", "time_period"])
    return bands.select("period_num", "time_period", *[r(c).alias(c) for c in BANDS])


ECON_SQL = """, base as (select name_1, name_2, day, dwells_shops*caid_unique as shops, caid_unique from econ),
    one as (select name_1, day, sum(shops) as shops, sum(caid_unique) as w from base group by 1, 2),
    idx as (select name_1, day, shops/w as v, avg(case when month(day) = 1 then shops/w end) over (partition by name_1) as jan,
    case when count(*) over a = 15 then avg(shops/w) over a end as ma from one
    window a as (partition by name_1 order by day rows between 14 preceding and current row))"""


@query("st9_shop_index", with_views("econ").rstrip() + ECON_SQL + """ select name_1, strftime(day, '%Y-%m-%d') as day,
    round(v, 6) as dwells_shops, round(jan, 6) as dwells_shops_jan, round(ma, 6) as dwells_shops_ma,
    round(ma/nullif(jan, 0), 6) as dwells_shops_norm from idx""")
def _(spark, sf):
    one, _two = T.shop_levels(V.econ(spark, sf))
    cols = ["dwells_shops", "dwells_shops_jan", "dwells_shops_ma", "dwells_shops_norm"]
    return T.shop_index(one, "name_1").select(
        "name_1", F.col("day").cast("string").alias("day"), *[r(c).alias(c) for c in cols]
    )


REGION_DAYS_SQL = """, region_days as (select name_1 as region_english, day, avg(dwells_shops) as duration_ma from econ
    group by 1, 2), false_days as (select name_1 as region_english, day, sum(caid_unique) as false_alarm,
    count(*) as true_alarm from econ group by 1, 2)"""


@query("st9_merged_context", with_views("effects", "econ").rstrip() + ECON_SQL + REGION_DAYS_SQL + f""" select
    concat({sql_time('e.start_raid_next')}, e.region_english) as id, e.cell/60.0 as period_num, round(e.b, 6) as movement,
    round(i.v, 6) as dwells_shops, round(i.ma, 6) as dwells_shops_ma, round(i.ma/nullif(i.jan, 0), 6) as dwells_shops_norm,
    round(g.duration_ma, 6) as duration_ma, round(f.false_alarm/(f.false_alarm+f.true_alarm), 6) as false_alarm_rate,
    case when f.false_alarm/(f.false_alarm+f.true_alarm) > 0.769 then 1 else 0 end as abv_med_falserate
    from (select *, cast(make_timestamp(cast(start_raid_next as bigint)*1000000) as date) as day from effects) e
    left join idx i on i.day = e.day and i.name_1 = e.region_english
    join region_days g on g.day = e.day and g.region_english = e.region_english
    join false_days f on f.day = e.day and f.region_english = e.region_english""")
def _(spark, sf):
    econ = V.econ(spark, sf)
    days = econ.withColumnRenamed("name_1", "region_english").groupBy("region_english", "day")
    merged = T.merge_context(
        _long(spark, sf), econ,
        econ.select(F.col("name_1").alias("NAME_1"), F.col("name_1").alias("region_english")),
        days.agg(F.avg("dwells_shops").alias("duration_ma")),
        days.agg(F.sum("caid_unique").alias("false_alarm"), F.count(F.lit(1)).alias("true_alarm")),
    )
    cols = ["movement", "dwells_shops", "dwells_shops_ma", "dwells_shops_norm", "duration_ma", "false_alarm_rate"]
    return merged.select("id", "period_num", *[r(c).alias(c) for c in cols], "abv_med_falserate")


@query("st10_median_split", """with l as (select l_shipmode_q as facet, l_discount as period_num, l_tax as split,
    l_quantity as movement from (select *, l_linenumber % 3 as l_shipmode_q from lineitem)),
    m as (select facet, median(split) as med from l group by 1)
    select period_num, split > med as grp, facet, round(avg(movement), 6) as x_mean,
    round(stddev_samp(movement), 6) as x_sd, round(avg(movement)+2*stddev_samp(movement), 6) as max_tick,
    round(avg(movement)-2*stddev_samp(movement), 6) as min_tick from l join m using (facet) group by 1, 2, 3""")
def _(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") % 3).alias("facet"), F.col("l_discount").alias("period_num"),
        F.col("l_tax").alias("split"), F.col("l_quantity").alias("movement"),
    )
    bands = T.split_bands(rows, "split", ["facet"])
    return bands.select("period_num", "grp", "facet", *[r(c).alias(c) for c in BANDS])


@query("st10_group_column", """with l as (select l_linenumber % 3 as facet, l_discount as period_num, l_returnflag as grp,
    l_quantity as movement from lineitem) select period_num, grp, facet, round(avg(movement), 6) as x_mean,
    round(stddev_samp(movement), 6) as x_sd, round(avg(movement)+2*stddev_samp(movement), 6) as max_tick,
    round(avg(movement)-2*stddev_samp(movement), 6) as min_tick from l group by 1, 2, 3""")
def _(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") % 3).alias("facet"), F.col("l_discount").alias("period_num"), F.col("l_tax").alias("split"),
        "l_returnflag", F.col("l_quantity").alias("movement"),
    )
    bands = T.split_bands(rows, "split", ["facet"], group="l_returnflag")
    return bands.select("period_num", "grp", "facet", *[r(c).alias(c) for c in BANDS])


@query("st11_distance_bands", LINES_SQL + f""", sd as (select stddev_samp({DIST_SQL}) as sd from event_panel),
    ends as (select cell/60.0 as period_num, 'lower' as conf, a - a0 as movement from based where cell <> -1
    union all select cell/60.0, 'upper', a - a0 + (s - s0)*sd from based, sd where cell <> -1),
    q as (select quantile_cont(movement, 0.25) as q1, quantile_cont(movement, 0.75) as q3 from ends)
    select period_num, 1 as time_period, conf, round(avg(movement), 4) as x_mean, round(stddev_samp(movement), 4) as x_sd
    from ends, q where movement >= q1-10*(q3-q1) and movement < q3+10*(q3-q1) group by all""")
def _(spark, sf):
    panel = _with_distance(cut(event_panel(spark, sf)))
    fit = regression.interacted_effects(panel, KEYS, "distance_sum", "distance_to_front")
    sd = panel.agg(F.stddev_samp("distance_to_front")).first()[0]  # one number
    bands = T.distance_bands(fit, KEYS, sd or 0.0, ["period_num", "time_period", "conf"])
    return bands.select("period_num", "time_period", "conf", r("x_mean", 4).alias("x_mean"), r("x_sd", 4).alias("x_sd"))


@query("fil22_trim_outliers", """with l as (select l_linenumber as k, pow(l_extendedprice, 3)/1e9 as v, l_orderkey
    from lineitem), q as (select k, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from l group by 1)
    select k, count(*) as n, round(max(v), 4) as top from l join q using (k)
    where v >= q1-2*(q3-q1) and v < q3+2*(q3-q1) group by 1""")
def _(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("k"), (F.pow("l_extendedprice", F.lit(3)) / 1e9).alias("v"), "l_orderkey"
    )
    kept = T.trim_outliers(rows, ["k"], "v", 2)
    return kept.groupBy("k").agg(F.count(F.lit(1)).alias("n"), r(F.max("v"), 4).alias("top"))


@query("st17_local_curve", EST_SQL + """, bands as (select period_num as x, avg(movement) as y, case when period_num < 0
    then 'before' else 'after' end as side from est where movement <> 0 group by 1),
    pairs as (select a.side, a.x as x0, b.x, b.y, abs(b.x-a.x) as u, b.x-a.x as t, row_number() over
    (partition by a.side, a.x order by abs(b.x-a.x), b.x) as rk, count(*) over (partition by a.side, a.x) as n
    from bands a join bands b on a.side = b.side),
    w as (select *, pow(1-pow(u/h, 3), 3) as w from (select *, max(case when rk <= floor(n*0.75+1e-5) then u end)
    over (partition by side, x0) as h from pairs) where u < h),
    s as (select side, x0, sum(w) as s0, sum(w*t) as s1, sum(w*t*t) as s2, sum(w*t*t*t) as s3, sum(w*t*t*t*t) as s4,
    sum(w*y) as r0, sum(w*y*t) as r1, sum(w*y*t*t) as r2 from w group by 1, 2)
    select 1 as time_period, side, x0 as period_num, round((r0*(s2*s4-s3*s3)-s1*(r1*s4-r2*s3)+s2*(r1*s3-r2*s2))
    / nullif(s0*(s2*s4-s3*s3)-s1*(s1*s4-s2*s3)+s2*(s1*s3-s2*s2), 0), 4) as smooth from s""")
def _(spark, sf):
    bands = T.mean_bands(T.drop_unobserved(_long(spark, sf)), ["period_num", "time_period"])
    return T.local_curve(bands, ["time_period"]).withColumn("smooth", r("smooth", 4))


# --- contact zone -----------------------------------------------------------------------------------------

@query("ge6_near_localities", with_views("spots", "cells") + f"""select distinct wp_index,
    strftime(day, '%Y-%m-%d') as day, status from (select wp_index, radians(x)*cos(radians({V.LAT0}))*6371.009 as px,
    radians(y)*6371.009 as py from cells) c join spots s on sqrt(pow(px-s.x, 2)+pow(py-s.y, 2)) <= 5""")
def _(spark, sf):
    points = V.cells(spark, sf).select("wp_index", F.col("x").alias("longitude"), F.col("y").alias("latitude"))
    near = front.near_localities(points, front.control_long(V.control(spark, sf)), ["wp_index"], V.LAT0)
    return near.select("wp_index", F.col("day").cast("string").alias("day"), "status")


@query("ge7_contact_lenses", with_views("lenses") + """select strftime(day, '%Y-%m-%d') as day, round(ax, 6) as ax,
    round(ay, 6) as ay, round(bx, 6) as bx, round(by_, 6) as by_ from lenses""")
def _(spark, sf):
    lenses = front.contact_lenses(front.control_long(V.control(spark, sf)), V.LAT0)
    return lenses.select(
        F.col("day").cast("string").alias("day"), r("ax").alias("ax"), r("ay").alias("ay"), r("bx").alias("bx"),
        r("by").alias("by_"),
    )


# lens distance as the minimum over candidate points: both discs' nearest points and the corners
FRONT_SQL = with_views("event_panel", "lenses").rstrip() + f""", pos as (select caid, start_raid_next, region_english,
    cast(make_timestamp(cast(day as bigint)*1000000) as date) as day,
    radians(first(longitude_center order by minute))*cos(radians({V.LAT0}))*6371.009 as x,
    radians(first(latitude_center order by minute))*6371.009 as y from event_panel group by 1, 2, 3, 4),
    d as (select p.*, ax, ay, bx, by_, sqrt(pow(x-ax, 2)+pow(y-ay, 2)) as da, sqrt(pow(x-bx, 2)+pow(y-by_, 2)) as db,
    sqrt(pow(ax-bx, 2)+pow(ay-by_, 2)) as g from pos p join lenses l on l.day = p.day),
    c as (select *, sqrt(greatest(25-g*g/4, 0)) as h from d),
    k as (select *, sqrt(pow(x-(ax+bx)/2+h*(by_-ay)/g, 2)+pow(y-(ay+by_)/2-h*(bx-ax)/g, 2)) as k1,
    sqrt(pow(x-(ax+bx)/2-h*(by_-ay)/g, 2)+pow(y-(ay+by_)/2+h*(bx-ax)/g, 2)) as k2,
    case when da > 5 and sqrt(pow(ax+(x-ax)*5/da-bx, 2)+pow(ay+(y-ay)*5/da-by_, 2)) <= 5 then da-5 end as ta,
    case when db > 5 and sqrt(pow(bx+(x-bx)*5/db-ax, 2)+pow(by_+(y-by_)*5/db-ay, 2)) <= 5 then db-5 end as tb from c),
    front as (select caid, start_raid_next, region_english, min(case when da <= 5 and db <= 5 then 0.0
    else least(k1, k2, coalesce(ta, 1e9), coalesce(tb, 1e9)) end) as distance_to_front from k group by 1, 2, 3)"""


def _front_distances(spark, sf, panel):
    lenses = front.contact_lenses(front.control_long(V.control(spark, sf)), V.LAT0)
    spots = events.event_positions(panel)
    # the control dates are those of the events in the sample views
    return front.front_distance(spots, lenses, ["caid", *KEYS], V.LAT0)


@query("ge8_front_distance", FRONT_SQL + f""" select caid, {KEYS_SQL}, round(distance_to_front, 6)
    as distance_to_front from front""")
def _(spark, sf):
    return _front_distances(spark, sf, cut(event_panel(spark, sf))).select(
        "caid", *event_keys(), r("distance_to_front").alias("distance_to_front")
    )


@query("tr20_front_dataset", FRONT_SQL + f""", j as (select e.caid, e.minute, e.city, e.start_raid_next,
    e.region_english, e.time_to_raid, f.distance_to_front from event_panel e
    join front f using (caid, start_raid_next, region_english)),
    m as (select start_raid_next, region_english, quantile_disc(distance_to_front, 0.5) as med from j group by 1, 2)
    select caid, {sql_time('minute')} as minute, city, {KEYS_SQL}, round(distance_to_front, 6) as distance_to_front,
    round(ln(1+distance_to_front), 6) as distance_to_front_log,
    case when distance_to_front >= med then 1 else 0 end as distance_med,
    case when time_to_raid >= 0 then 1 else 0 end as post,
    round(case when time_to_raid >= 0 then ln(1+distance_to_front) else 0 end, 6) as post_inter
    from j join m using (start_raid_next, region_english)""")
def _(spark, sf):
    panel = cut(event_panel(spark, sf))
    joined = events.with_front_distance(panel, _front_distances(spark, sf, panel))
    cols = ["distance_to_front", "distance_to_front_log", "post_inter"]
    return joined.select(
        "caid", text("minute").alias("minute"), "city", *event_keys(), "distance_med", "post",
        *[r(c).alias(c) for c in cols],
    )


@query("ag18_approx_median", FRONT_SQL + f""" select {KEYS_SQL}, round(quantile_disc(distance_to_front, 0.5), 6)
    as median from front group by all""")
def _(spark, sf):
    distances = _front_distances(spark, sf, cut(event_panel(spark, sf)))
    return distances.groupBy(*event_keys()).agg(r(F.percentile_approx("distance_to_front", 0.5)).alias("median"))


@query("st14_front_summary", FRONT_SQL + """ select count(*) as n, round(avg(distance_to_front), 6) as mean,
    round(stddev_samp(distance_to_front), 6) as sd, round(min(distance_to_front), 6) as min,
    round(quantile_cont(distance_to_front, 0.25), 6) as q25, round(quantile_cont(distance_to_front, 0.5), 6) as q50,
    round(quantile_cont(distance_to_front, 0.75), 6) as q75, round(max(distance_to_front), 6) as max from front having count(*) > 0""")
def _(spark, sf):
    table = describe(_front_distances(spark, sf, cut(event_panel(spark, sf))), [], "distance_to_front")
    return table.select("n", *[r(c).alias(c) for c in ("mean", "sd", "min", "q25", "q50", "q75", "max")])


# --- every scenario -------------------------------------------------------------------------------------

GRID_SQL = _with_homes("event_panel", "lenses").rstrip() + SAMPLES_SQL + FRONT_SQL[len(with_views("event_panel", "lenses").rstrip()):] + """,
    near as (select e.*, f.distance_to_front as dist from event_panel e join front f using (caid, start_raid_next, region_english)),
    kept as (select start_raid_next, region_english from near where region_english not like '%R3%' group by 1, 2
    having max(dist) - min(dist) >= 5 and count(*) >= 200),
    lines as (select start_raid_next, region_english, time_to_raid_post as cell, regr_slope(distance_sum, dist) as s,
    regr_intercept(distance_sum, dist) as a from near semi join kept using (start_raid_next, region_english) group by 1, 2, 3),
    based as (select *, max(case when cell = -1 then s end) over g as s0, max(case when cell = -1 then a end) over g as a0
    from lines window g as (partition by start_raid_next, region_english)), fx as (""" + sql_effects(
    "samples", "y", "scenario, start_raid_next, region_english") + f""")
    select scenario, {KEYS_SQL}, 'cell' as term, cell, round(b, 4) as b from fx
    union all select 'interaction', {KEYS_SQL}, 'cell', cell, round(a - a0, 4) from based where cell <> -1
    union all select 'interaction', {KEYS_SQL}, 'cell_x', cell, round(s - s0, 4) from based where cell <> -1
    union all select 'interaction', {KEYS_SQL}, 'x', null, round(s0, 4) from based where cell = -1"""


@query("st5_scenario_grid", GRID_SQL)
def _(spark, sf):
    panel = cut(event_panel(spark, sf))
    grid = scenario_grid(
        panel, study_homes(spark, sf), _front_distances(spark, sf, panel), panel, local_alerts(spark, sf), "distance_sum", hours=[],
        names=["R3"], spread=5, rows=200,
    )
    return grid.select("scenario", *event_keys(), "term", "cell", r("b", 4).alias("b"))
