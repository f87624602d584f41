"""Counterfactual and resampling queries."""

from pyspark.sql import functions as F

from ..operators import counterfactual as C
from ..operators import resample as B
from ..operators.checkpoints import cut
from ..operators.quantiles import describe
from . import views as V
from .common import r
from .registry import query
from .views import with_views

ACTOR = "Civilians"
V._chain("harm", ["casualties"], """select event_date, civcas, civcas_event, civcas_elasticity,
    case when count(civcas_elasticity) over w = 7 then avg(civcas_elasticity) over w end as elasticity_ma from
    (select event_date, coalesce(sum(case when actor2 = 'Civilians' then fatalities end), 0) as civcas,
     count(case when actor2 = 'Civilians' and fatalities >= 1 then 1 end) as civcas_event,
     coalesce(sum(case when actor2 = 'Civilians' then fatalities end), 0)/nullif(count(case when actor2 = 'Civilians'
     and fatalities >= 1 then 1 end), 0) as civcas_elasticity from casualties group by 1)
    window w as (order by event_date range between interval 6 days preceding and current row)""")
V._chain("harm_days", ["harm"], """select * from harm where event_date between date '2022-03-15' and date '2022-09-30'""")
V._chain("merged_days", ["harm_days", "alert_days"], """select coalesce(h.event_date, a.smart_date) as smart_date, h.*,
    a.alert, a.movement, case when h.event_date is null then 2 when a.smart_date is null then 1 else 3 end as merge_code,
    month(h.event_date) as month, case when month(event_date) in (3, 4) then 1 when month(event_date) in (5, 6) then 2
    when month(event_date) >= 7 then 3 end as period_of_conflict,
    1938 + (421.85-1938)*(h.event_date - date '2022-03-15')/(date '2022-09-30' - date '2022-03-15') as mvmt_trend
    from harm_days h full join alert_days a on h.event_date = a.smart_date""")
V._chain("counterfactuals", ["merged_days"], """select smart_date, month, period_of_conflict, civcas,
    alert*civcas_elasticity*(0-movement)*-0.0000674 as deaths_avoided_1,
    alert*civcas_elasticity*(421.8466-movement)*-0.0000674 as deaths_avoided_2,
    case when period_of_conflict is distinct from 1 then alert*civcas_elasticity*(mvmt_trend-1938)*-0.0000674 end as excess_deaths_1,
    case when period_of_conflict is distinct from 1 then alert*civcas_elasticity*(movement-1938)*-0.0000674 end as excess_deaths_2,
    case when period_of_conflict is distinct from 1 then alert*elasticity_ma*(mvmt_trend-1938)*-0.0000674 end as excess_deaths_3
    from merged_days""")
V._chain("avoided", ["counterfactuals"], "select *, row_number() over (order by smart_date) - 1 as idx, "
         "count(*) over () as n from counterfactuals where deaths_avoided_1 is not null")


def merged(spark, sf, missing_is_last: bool = False):
    return C.merged_days(C.harm_series(V.casualties(spark, sf), ACTOR), V.alert_days(spark, sf), missing_is_last)


def table(spark, sf):
    return C.counterfactuals(merged(spark, sf))


def avoided(spark, sf):
    """Rows with an outcome, numbered by date; stored once, as every resample reads them."""
    rows = table(spark, sf).filter("deaths_avoided_1 IS NOT NULL")
    return cut(B.indexed(rows, ["smart_date"], F.date_trunc("month", "smart_date")))


def excess(spark, sf):
    return cut(table(spark, sf).filter("period_of_conflict >= 2"))


@query("ag20_conditional_sums", with_views("harm") + """select strftime(event_date, '%Y-%m-%d') as event_date, civcas,
    civcas_event from harm""")
def _(spark, sf):
    return C.daily_harm(V.casualties(spark, sf), ACTOR).select(
        F.col("event_date").cast("string").alias("event_date"), "civcas", "civcas_event"
    )


@query("fn22_elasticity", with_views("harm") + """select strftime(event_date, '%Y-%m-%d') as event_date,
    round(civcas_elasticity, 9) as civcas_elasticity from harm""")
def _(spark, sf):
    return C.daily_harm(V.casualties(spark, sf), ACTOR).select(
        F.col("event_date").cast("string").alias("event_date"), r("civcas_elasticity", 9).alias("civcas_elasticity")
    )


@query("wn6_calendar_mean", with_views("harm") + """select strftime(event_date, '%Y-%m-%d') as event_date,
    round(elasticity_ma, 9) as elasticity_ma from harm""")
def _(spark, sf):
    daily = C.calendar_mean(
        C.daily_harm(V.casualties(spark, sf), ACTOR), "event_date", "civcas_elasticity", 7, "elasticity_ma"
    )
    return daily.select(
        F.col("event_date").cast("string").alias("event_date"), r("elasticity_ma", 9).alias("elasticity_ma")
    )


@query("st15_harm_series", with_views("harm_days") + """select strftime(event_date, '%Y-%m-%d') as event_date, civcas,
    civcas_event, round(civcas_elasticity, 9) as civcas_elasticity, round(elasticity_ma, 9) as elasticity_ma from harm_days""")
def _(spark, sf):
    return C.harm_series(V.casualties(spark, sf), ACTOR).select(
        F.col("event_date").cast("string").alias("event_date"), "civcas", "civcas_event",
        r("civcas_elasticity", 9).alias("civcas_elasticity"), r("elasticity_ma", 9).alias("elasticity_ma"),
    )


@query("fil24_date_range", with_views("harm_days") + """select count(*) as days,
    strftime(min(event_date), '%Y-%m-%d') as first_day, strftime(max(event_date), '%Y-%m-%d') as last_day from harm_days""")
def _(spark, sf):
    return C.harm_series(V.casualties(spark, sf), ACTOR).agg(
        F.count(F.lit(1)).alias("days"), F.min("event_date").cast("string").alias("first_day"),
        F.max("event_date").cast("string").alias("last_day"),
    )


@query("jn12_full_merge", with_views("merged_days") + """select strftime(smart_date, '%Y-%m-%d') as smart_date,
    merge_code, civcas, alert from merged_days""")
def _(spark, sf):
    return merged(spark, sf).select(F.col("smart_date").cast("string").alias("smart_date"), "merge_code", "civcas", "alert")


@query("prj6_conflict_period", with_views("merged_days") + """select strftime(smart_date, '%Y-%m-%d') as smart_date,
    period_of_conflict, case when event_date is null then 3 else period_of_conflict end as with_missing_last from merged_days""")
def _(spark, sf):
    days = merged(spark, sf, missing_is_last=True)
    return days.select(
        F.col("smart_date").cast("string").alias("smart_date"),
        C.conflict_period(F.col("month"), open_end=True).alias("period_of_conflict"),
        F.col("period_of_conflict").alias("with_missing_last"),
    )


@query("wn7_interpolation", with_views("merged_days") + """select strftime(smart_date, '%Y-%m-%d') as smart_date,
    round(mvmt_trend, 6) as mvmt_trend from merged_days""")
def _(spark, sf):
    return merged(spark, sf).select(
        F.col("smart_date").cast("string").alias("smart_date"), r("mvmt_trend").alias("mvmt_trend")
    )


HARM = ["deaths_avoided_1", "deaths_avoided_2", "excess_deaths_1", "excess_deaths_2", "excess_deaths_3"]


@query("st16_counterfactuals", with_views("counterfactuals") + "select strftime(smart_date, '%Y-%m-%d') as smart_date, "
       "month, period_of_conflict, civcas, " + ", ".join(f"round({c}, 6) as {c}" for c in HARM) + " from counterfactuals")
def _(spark, sf):
    return table(spark, sf).select(
        F.col("smart_date").cast("string").alias("smart_date"), "month", "period_of_conflict", "civcas",
        *[r(c).alias(c) for c in HARM],
    )


@query("fn21_counterfactual_totals", with_views("counterfactuals") + "select period_of_conflict, "
       + ", ".join(f"round(sum({c}), 6) as {c}" for c in HARM) + " from counterfactuals group by 1")
def _(spark, sf):
    return table(spark, sf).groupBy("period_of_conflict").agg(*[r(F.sum(c)).alias(c) for c in HARM])


@query("fil28_first_period_null", with_views("counterfactuals") + """select period_of_conflict, count(*) as n,
    count(excess_deaths_1) as n1, count(excess_deaths_3) as n3 from counterfactuals group by 1""")
def _(spark, sf):
    return table(spark, sf).groupBy("period_of_conflict").agg(
        F.count(F.lit(1)).alias("n"), F.count("excess_deaths_1").alias("n1"), F.count("excess_deaths_3").alias("n3")
    )


@query("ag21_whole_sums", with_views("counterfactuals") + """select round(sum(deaths_avoided_1), 6) as avoided_1,
    round(sum(deaths_avoided_2), 6) as avoided_2, sum(civcas) as civcas,
    round(sum(case when period_of_conflict >= 2 then excess_deaths_1 end), 6) as excess_1 from counterfactuals""")
def _(spark, sf):
    return table(spark, sf).agg(
        r(F.sum("deaths_avoided_1")).alias("avoided_1"), r(F.sum("deaths_avoided_2")).alias("avoided_2"),
        F.sum("civcas").alias("civcas"),
        r(F.sum(F.when(F.col("period_of_conflict") >= 2, F.col("excess_deaths_1")))).alias("excess_1"),
    )


@query("bt6_sample_sets", with_views("counterfactuals") + """select count(deaths_avoided_1) as avoided_rows,
    count(case when period_of_conflict >= 2 then 1 end) as excess_rows from counterfactuals""")
def _(spark, sf):
    return table(spark, sf).agg(
        F.count("deaths_avoided_1").alias("avoided_rows"),
        F.count(F.when(F.col("period_of_conflict") >= 2, 1)).alias("excess_rows"),
    )


# --- resampling: all 10,000 repetitions -------------------------------------------------------------

HASH = "cast(concat('0x', substr(md5(concat(cast(rep as varchar), '-', cast(draw as varchar))), 1, 8)) as bigint)"
AVOIDED = ["deaths_avoided_1", "deaths_avoided_2"]
EXCESS = ["excess_deaths_1", "excess_deaths_2", "excess_deaths_3"]


def _sums_sql(values):
    return ", ".join(f"coalesce(sum({v}), 0) as {v}" for v in values)


def _rates_sql(values, source):
    return "select rep, " + ", ".join(f"round({v}/nullif(civcas, 0), 6) as {v}_rate" for v in values) + f" from {source}"


def _rate_rows(sums, values):
    return B.rates(sums, values).select("rep", *[r(f"{v}_rate", 6).alias(f"{v}_rate") for v in values])


BT1 = with_views("avoided").rstrip() + f""", draws as (select rep, {HASH} % n as idx from range(1, 10001) a(rep),
    (select any_value(n) as n from avoided), range(0, (select count(*) from avoided)) b(draw)),
    sums as (select rep, {_sums_sql([*AVOIDED, 'civcas'])} from draws join avoided using (idx) group by 1)
    """


@query("bt1_row_bootstrap", BT1 + _rates_sql(AVOIDED, "sums"))
def _(spark, sf):
    return _rate_rows(B.bootstrap_sums(avoided(spark, sf), [*AVOIDED, "civcas"]), AVOIDED)


def _cluster_sql(source, where, cluster, values):
    return with_views(source).rstrip() + f""", c as (select *, row_number() over (order by {cluster}) - 1 as idx,
    count(*) over () as n from (select {cluster}, {', '.join(f'sum({v}) as {v}' for v in [*values, 'civcas'])}
    from {source} {where} group by 1)), draws as (select rep, {HASH} % n as idx from range(1, 10001) a(rep),
    (select any_value(n) as n from c), range(0, (select count(*) from c)) b(draw)),
    sums as (select rep, {_sums_sql([*values, 'civcas'])} from draws join c using (idx) group by 1) """ + _rates_sql(values, "sums")


@query("bt2_period_bootstrap", _cluster_sql("avoided", "", "period_of_conflict", AVOIDED))
def _(spark, sf):
    sums = B.cluster_bootstrap_sums(avoided(spark, sf), "period_of_conflict", [*AVOIDED, "civcas"])
    return _rate_rows(sums, AVOIDED)


@query("bt3_month_bootstrap", _cluster_sql("avoided", "", "month", AVOIDED))
def _(spark, sf):
    return _rate_rows(B.cluster_bootstrap_sums(avoided(spark, sf), "month", [*AVOIDED, "civcas"]), AVOIDED)


@query("bt3_month_bootstrap_excess", _cluster_sql("counterfactuals", "where period_of_conflict >= 2", "month", EXCESS))
def _(spark, sf):
    return _rate_rows(B.cluster_bootstrap_sums(excess(spark, sf), "month", [*EXCESS, "civcas"]), EXCESS)


BT4 = with_views("avoided").rstrip() + f""", draws as (select rep, idx from (select rep, draw as idx, row_number() over
    (partition by rep order by {HASH}, draw) as place from range(1, 10001) a(rep),
    range(0, (select count(*) from avoided)) b(draw)) where place <= 90),
    sums as (select rep, {_sums_sql([*AVOIDED, 'civcas'])} from draws join avoided using (idx) group by 1)
    """


@query("bt4_subsample", BT4 + _rates_sql(AVOIDED, "sums"))
def _(spark, sf):
    return _rate_rows(B.subsample_sums(avoided(spark, sf), [*AVOIDED, "civcas"]), AVOIDED)


@query("so6_random_first_rows", BT4 + "select rep, round(cast(civcas as double), 6) as civcas from sums")
def _(spark, sf):
    return B.subsample_sums(avoided(spark, sf), ["civcas"]).select("rep", r("civcas").alias("civcas"))


@query("bt5_rate_summary", BT1 + """, q as (select deaths_avoided_1/nullif(civcas, 0) as v from sums)
    select count(v) as n, round(avg(v), 8) as mean, round(stddev_samp(v), 8) as sd, round(min(v), 8) as min,
    round(quantile_cont(v, 0.25), 8) as q25, round(quantile_cont(v, 0.5), 8) as q50,
    round(quantile_cont(v, 0.75), 8) as q75, round(max(v), 8) as max from q""")
def _(spark, sf):
    sums = B.bootstrap_sums(avoided(spark, sf), [*AVOIDED, "civcas"])
    table_ = describe(B.rates(sums, AVOIDED), [], "deaths_avoided_1_rate")
    return table_.select("n", *[r(c, 8).alias(c) for c in ("mean", "sd", "min", "q25", "q50", "q75", "max")])
