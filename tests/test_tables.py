import json
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pingscape.functions import clock
from pingscape.functions.fixed_values import MOVEMENT_COEF
from pingscape.operators import alerts, context, counterfactual, estimates, joins, resample
from pingscape.operators import quantiles
from pingscape.operators.quantiles import describe, group_quantiles
from pingscape.sources import sinks, tables


# --- quantiles ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("sketch", [8, 800])
def test_quantiles_are_exact_for_any_sketch(spark, monkeypatch, sketch):
    rng = np.random.default_rng(21)
    groups = {"hot": rng.normal(0, 1, 4000), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([7.0]),
              "two": np.array([1.0, 4.0]), "long_tail": np.exp(rng.normal(0, 4, 900))}
    pdf = pd.concat([pd.DataFrame({"g": k, "v": v}) for k, v in groups.items()])
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    monkeypatch.setattr(quantiles, "SKETCH", sketch)
    monkeypatch.setattr(quantiles, "MOST_VALUES", 20)
    out = group_quantiles(spark.createDataFrame(pdf), ["g"], "v", probs).collect()
    for r in out:
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(groups[r.g], p), rel=1e-12), (r.g, name)
    assert len(out) == len(groups)


@pytest.mark.parametrize("lo, hi", [(-9.0, -8.0), (8.0, 9.0), (0.3, 0.3), (-1e300, 1e300)])
def test_a_bracket_that_misses_its_rank_is_repaired(spark, monkeypatch, lo, hi):
    monkeypatch.setattr(quantiles, "MOST_VALUES", 10)
    v = np.random.default_rng(2).random(3000)
    data = spark.createDataFrame([(float(x), 1) for x in v], "v double, all_rows int")
    wrong = data.groupBy("all_rows").agg(F.count("v").alias("n")).select("all_rows", F.array(F.struct(
        F.lit("q").alias("name"), ((F.col("n") - 1) * 0.37).alias("rank"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")
    )).alias("want"))
    assert quantiles._quantiles(data, ["all_rows"], {"q": 0.37}, wrong).first()["q"] == pytest.approx(np.quantile(v, 0.37), rel=1e-12)


def test_values_far_from_the_rank_are_not_shuffled(spark):
    """The last step reads the few values of its bins; before it only sketches and counts are shuffled."""
    df = spark.range(0, 200_000, 1, 4).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    plan = group_quantiles(df, [], "v", {"m": 0.5})
    assert plan.first()["m"] == np.median(np.arange(200_000) * 7919 % 200_003)
    tree = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in tree and "SortMergeJoin" not in tree


def test_describe_ignores_nulls(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (6.0,)], "v double")
    row = describe(df, [], "v").first()
    assert (row.n, row["mean"], row["min"], row["q50"], row["max"]) == (3, 3.0, 1.0, 2.0, 6.0)


def test_trim_keeps_the_half_open_range(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 24, 24.1, -18, -18.1]], "g string, movement double")
    kept = sorted(r.movement for r in estimates.trim_outliers(df, ["g"], width=2).collect())
    v = np.array([1, 2, 3, 4, 5, 24, 24.1, -18, -18.1])
    q1, q3 = np.quantile(v, [0.25, 0.75])
    assert kept == sorted(x for x in v if q1 - 2 * (q3 - q1) <= x < q3 + 2 * (q3 - q1))


# --- joins ---------------------------------------------------------------------------------------------

@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    rng = np.random.default_rng(22)
    facts = spark.createDataFrame([(int(i), "hot" if rng.random() < 0.6 else f"k{rng.integers(9)}") for i in range(500)], "i int, k string")
    dim = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k5", 4)], "k string, v int")
    salted = joins.salted_join(facts, dim, ["k"], how)
    plain = facts.join(dim, ["k"], how)
    assert sorted(map(str, salted.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_alias_priority_and_full_merge(spark):
    units = spark.createDataFrame([("A", "x|y"), ("B", "z|x"), ("C", None)], "NAME_1 string, VARNAME_1 string")
    df = spark.createDataFrame([("A",), ("x",), ("y",), ("C",), ("q",)], "label string")
    out = {r.label: r.NAME_1 for r in joins.alias_join(df, "label", units, "NAME_1", "VARNAME_1").collect()}
    assert out == {"A": "A", "x": "B", "y": "A", "C": "C", "q": None}
    left = spark.createDataFrame([(1, "a"), (2, "b")], "d int, l string")
    right = spark.createDataFrame([(2, "c"), (3, "e")], "d int, r string")
    assert {r.d: r.merge_code for r in joins.full_merge(left, right, ["d"]).collect()} == {1: 1, 2: 3, 3: 2}


# --- sources --------------------------------------------------------------------------------------------

def test_day_list():
    assert tables.day_list("2020-02-28/2020-03-01") == ["2020/02/28", "2020/02/29", "2020/03/01"]
    assert tables.day_list("2020-04-01") == ["2020/04/01"]


def test_day_folders_and_ping_filters(spark, tmp_path, capsys):
    raw = spark.createDataFrame(
        [(1, "a", 1.0, 2.0, 3.0, "t", "g", acc, "ip", c) for acc, c in ((150.0, "UA"), (150.1, "UA"), (3.0, "PL"))],
        tables.RAW_PING_SCHEMA,
    )
    for day in tables.day_list("2022-01-01/2022-01-03"):
        sinks.write_parquet(raw, f"{tmp_path}/{day}")
    out = tables.select_pings(tables.scan_days(spark, f"{tmp_path}/", "2022-01-02/2022-01-03"), "UA")
    assert out.columns == ["caid", "latitude", "longitude", "utc_timestamp", "altitude"]
    assert out.count() == 2
    out.explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "LessThanOrEqual(horizontal_accuracy,150.0)" in pushed and "EqualTo(iso_country_code,UA)" in pushed
    assert "geo_hash" not in next(line for line in plan.splitlines() if line.startswith("ReadSchema"))


def test_toggle_log_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text("﻿" + json.dumps([{"locations": [10, 20, None, 30]}, {"locations": [5]}]), encoding="utf-8")
    out = sorted((r.place, r.position, r.t) for r in tables.scan_toggle_log(spark, str(path)).collect())
    assert out == [(0, 0, 10), (0, 1, 20), (0, 3, 30), (1, 0, 5)]


def test_option_dictionary(spark):
    html = ('<select><option value="Харків, Лозова">${indent}Kharkiv oblast</option>'
            '<option class="x" value="Київ">Kyiv</option><option value="Київ">Kyiv city</option></select>')
    out = tables.label_dictionary(spark.createDataFrame([(html,)], "html string"), "html").collect()
    assert {r.value: r.label for r in out} == {
        "Харків": "Kharkiv oblast", "Лозова": "Kharkiv oblast", "Київ": "Kyiv city"
    }


def test_csv_and_partitioned_parquet(spark, tmp_path):
    df = spark.createDataFrame([("1.5", "2022-01-01"), ("x", "2022-01-02")], "v string, day string")
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert sorted(r.v for r in tables.scan_csv(spark, f"{tmp_path}/csv").collect()) == ["1.5", "x"]
    sinks.write_parquet(df, f"{tmp_path}/days", ["day"])
    one = tables.scan_parquet(spark, f"{tmp_path}/days").filter("day = '2022-01-02'")
    assert [r.v for r in one.collect()] == ["x"]
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().toString()


# --- alerts -----------------------------------------------------------------------------------------------

def test_alert_over_midnight_counts_for_its_first_day(spark):
    df = spark.createDataFrame(
        [("a", datetime(2022, 3, 1, 23, 50), datetime(2022, 3, 2, 0, 20)), ("a", datetime(2022, 3, 5, 1), datetime(2022, 3, 7, 2)),
         ("b", datetime(2022, 3, 1, 5), None)],
        "region_english string, start_dt timestamp, end_dt timestamp",
    )
    counts = alerts.alert_counts(df)
    assert {(r.region_english, str(r.day)): r.alerts for r in counts.collect()} == {
        ("a", "2022-03-01"): 1, ("a", "2022-03-05"): 1, ("a", "2022-03-06"): 1, ("a", "2022-03-07"): 1
    }
    days = [f"2022-03-0{d}" for d in range(1, 8)]
    for wide in (alerts.heat_table(counts), alerts.heat_table(counts, days)):
        assert [tuple(r) for r in wide.collect()] == [("a", 1, 0, 0, 0, 1, 1, 1, 4)]
    with pytest.raises(Exception, match="not in the list"):
        alerts.heat_table(counts, days[:2]).collect()


def test_region_names(spark):
    names = ["Kyiv oblast", "Kyiv", "Izium raion", "Lviv oblast"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(alerts.tidy_region(F.col("n"))).collect()] == ["Kiev", "Kiev City", "Izium", "Lviv"]


def test_alert_systems(spark):
    world = spark.createDataFrame([("A", 1), ("B", 1), ("C", 0), ("Antarctica", 5)], "name string, pop_est long")
    systems = spark.createDataFrame([("A", None, 1), ("B", 0, None)], "country string, cell_broadcast int, sirens int")
    out = {r.name: r.any_system for r in context.alert_systems(world, systems).collect()}
    assert out == {"A": "National Alert System", "B": "No System"}


# --- time -----------------------------------------------------------------------------------------------------

def test_previous_sunday_and_periods(spark):
    days = ["2022-03-06", "2022-03-07", "2022-03-12"]  # Sunday, Monday, Saturday
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("d"))
    assert [str(r[0]) for r in df.select(clock.previous_sunday(F.col("d"))).collect()] == ["2022-02-27", "2022-03-06", "2022-03-06"]
    months = spark.createDataFrame([(m,) for m in range(1, 13)], "m int")
    m = F.col("m")
    rows = months.orderBy("m").select(
        clock.conflict_period(m).alias("a"), clock.conflict_period(m, default=0).alias("b"),
        clock.conflict_period(m, open_end=True).alias("c"),
    ).collect()
    assert [r.a for r in rows] == [None, None, 1, 1, 2, 2, 3, 3, 3, None, None, None]
    assert [r.b for r in rows] == [0, 0, 1, 1, 2, 2, 3, 3, 3, 0, 0, 0]
    assert [r.c for r in rows] == [None, None, 1, 1, 2, 2, 3, 3, 3, 3, 3, 3]


def test_local_time_follows_the_zone(spark):
    df = spark.createDataFrame([(1647338400,), (1656072000,)], "t long")  # March (winter) and June
    out = [str(r[0]) for r in df.select(clock.local_time(F.col("t"))).collect()]
    assert out == ["2022-03-15 12:00:00", "2022-06-24 15:00:00"]


# --- harm and resampling ------------------------------------------------------------------------------------

def conflict(spark, missing=()):
    rows = [(date(2022, 3, d), "c", d) for d in range(10, 31) if d not in missing]
    rows += [(date(2022, 3, 20), "c", None), (date(2022, 3, 20), "other", 99)]
    return spark.createDataFrame(rows, "event_date date, actor2 string, fatalities long")


def test_calendar_mean_needs_every_day(spark):
    out = {r.event_date.day: r for r in counterfactual.harm_series(conflict(spark, missing=(18,)), "c").collect()}
    assert 18 not in out and min(out) == 15
    assert out[16].elasticity_ma == pytest.approx(13.0)
    assert all(out[d].elasticity_ma is None for d in range(19, 25))
    assert out[25].elasticity_ma == pytest.approx(22.0)
    assert (out[20].civcas, out[20].civcas_event) == (20, 1)


def test_rows_only_in_the_alert_table(spark):
    days = spark.createDataFrame([(date(2022, 3, 16), 2, 100.0), (date(2022, 7, 1), 1, 50.0)], "smart_date date, alert int, movement double")
    harm = counterfactual.harm_series(conflict(spark), "c")
    for last, want in ((False, None), (True, 3)):
        rows = {r.smart_date: r for r in counterfactual.merged_days(harm, days, last).collect()}
        only = rows[date(2022, 7, 1)]
        assert (only.merge_code, only.period_of_conflict, only.mvmt_trend) == (2, want, None)
    table = {r.smart_date.day: r for r in counterfactual.counterfactuals(counterfactual.merged_days(harm, days)).collect()
             if r.smart_date.month == 3}
    assert table[16].deaths_avoided_1 == pytest.approx(2 * 16.0 * -100.0 * MOVEMENT_COEF)
    assert table[16].excess_deaths_2 is None  # first period


def test_interpolation_stays_between_known_points(spark):
    rows = [(date(2022, 1, d), {3: 10.0, 7: 30.0}.get(d)) for d in (1, 3, 4, 6, 7, 9)]
    df = spark.createDataFrame(rows, "d date, y double").withColumn("s", F.lit(1))
    out = {r.d.day: r.z for r in counterfactual.interpolate(df, ["s"], "d", "y", "z").collect()}
    assert out == {1: None, 3: 10.0, 4: 15.0, 6: 25.0, 7: 30.0, 9: None}


def harm_rows(spark, n=40):
    rng = np.random.default_rng(23)
    rows = [(date(2022, 3, 1 + i % 28), i // 10, float(v)) for i, v in enumerate(rng.uniform(1, 9, n))]
    df = spark.createDataFrame(rows, "d date, cluster int, v double")
    return resample.indexed(df, ["d", "v"], F.lit(0)).cache(), [r[2] for r in rows]


def test_bootstrap_invariants(spark):
    rows, values = harm_rows(spark)
    sums = [r.v for r in resample.bootstrap_sums(rows, ["v"], reps=300).collect()]
    n = len(values)
    assert len(sums) == 300 and n * min(values) <= min(sums) and max(sums) <= n * max(values)
    spread = np.std(sums) / (np.std(values) * n**0.5)
    assert 0.85 < spread < 1.15 and abs(np.mean(sums) - sum(values)) < 4 * np.std(sums) / 300**0.5
    again = [r.v for r in resample.bootstrap_sums(rows.repartition(5), ["v"], reps=300).orderBy("rep").collect()]
    assert sorted(again) == pytest.approx(sorted(sums))


def test_subsample_of_everything_is_the_total(spark):
    rows, values = harm_rows(spark)
    out = resample.subsample_sums(rows, ["v"], size=len(values), reps=5).collect()
    assert [r.v for r in out] == pytest.approx([sum(values)] * 5)
    part = [r.v for r in resample.subsample_sums(rows, ["v"], size=10, reps=50).collect()]
    assert max(part) <= sum(sorted(values)[-10:]) + 1e-9 and len(set(part)) > 40


def test_cluster_bootstrap_draws_whole_clusters(spark):
    rows, values = harm_rows(spark)
    sums = {c: sum(v for i, v in enumerate(values) if i // 10 == c) for c in range(4)}
    out = resample.cluster_bootstrap_sums(rows, "cluster", ["v"], reps=60).collect()
    from itertools import combinations_with_replacement

    possible = [sum(sums[c] for c in pick) for pick in combinations_with_replacement(range(4), 4)]
    assert all(min(abs(r.v - p) for p in possible) < 1e-9 for r in out)


# --- estimates ------------------------------------------------------------------------------------------------

def test_long_estimates_and_unobserved_cells(spark):
    wide = spark.createDataFrame(
        [("2022-03-15 10:00:00Kiev City", 1.0, 0.0, 5.0, 7.0)],
        "id string, `e_TYPE_-600` double, e_TYPE_300 double, e_TYPE_360 double, e_TYPE_1860 double",
    )
    long = estimates.with_time_period(estimates.decode_id(estimates.long_estimates(wide, ["id"])))
    rows = {r.period_num: r for r in long.collect()}
    assert sorted(rows) == [-10.0, 5.0, 6.0, 31.0]
    some = estimates.long_estimates(wide, ["id"], cells=(300, 1800)).collect()
    assert sorted(r.period_num for r in some) == [5.0, 6.0]
    assert (rows[5.0].region_english, str(rows[5.0].day), rows[5.0].time_period) == ("Kiev City", "2022-03-15", 1)
    assert [r.period_num for r in estimates.drop_unobserved(long).collect()] == [-10.0, 6.0, 31.0]


def test_local_curve_reproduces_a_parabola(spark):
    points = spark.createDataFrame([(1, float(x), 2.0 + 0.5 * x - 0.1 * x * x) for x in range(-10, 31)], "g int, period_num double, x_mean double")
    for r in estimates.local_curve(points, ["g"]).collect():
        assert r.smooth == pytest.approx(2.0 + 0.5 * r.period_num - 0.1 * r.period_num**2, abs=1e-6)


def test_shop_index(spark):
    rows = [("r", date(2022, 1, 1 + i), float(i), 2) for i in range(31)] + [("r", date(2022, 2, 1), 8.0, 0)]
    econ = spark.createDataFrame(rows, "name string, day date, dwells_shops double, caid_unique int")
    out = {r.day: r for r in estimates.shop_index(econ, "name").collect()}
    assert out[date(2022, 2, 1)].dwells_shops == 0.0  # no devices
    assert out[date(2022, 1, 14)].dwells_shops_ma is None
    assert out[date(2022, 1, 15)].dwells_shops_ma == pytest.approx(3.5)
    assert out[date(2022, 1, 15)].dwells_shops_norm == pytest.approx(3.5 / 7.5)


def test_zero_denominators_give_null(spark):
    df = spark.createDataFrame([(0, 0), (3, 1)], "false_alarm long, true_alarm long")
    out = estimates.false_alarm_rates(df).collect()
    assert [(r.false_alarm_rate, r.abv_med_falserate) for r in out] == [(None, None), (0.75, 0)]
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert estimates.simple_fit(flat, "x", "y").first().r is None


def test_broadcast_needs_few_and_short_rows(spark):
    df = spark.range(50).withColumn("text", F.repeat(F.lit("x"), 100))
    assert joins.fits_broadcast(df)
    assert not joins.fits_broadcast(df, max_rows=49)
    assert not joins.fits_broadcast(df, max_bytes=5000)


def test_active_alerts_match_each_alert(spark):
    from pingscape.operators import panel

    at = lambda h, m: datetime(2022, 3, 1, h, m)
    rows = spark.createDataFrame([("d", "r", at(10, 0)), ("d", "r", at(11, 30)), ("d", "q", at(10, 0))],
                                 "caid string, region_english string, minute timestamp")
    given = spark.createDataFrame([("r", at(9, 50), at(10, 0)), ("r", at(10, 0), at(12, 0)), ("r", at(12, 0), None)],
                                  "region_english string, start_dt timestamp, end_dt timestamp")
    out = panel.active_alerts(rows, given).collect()
    assert sorted((r.minute.hour, r.start_dt.hour) for r in out) == [(10, 9), (10, 10), (11, 10)]


def test_subsample_ranks_few_rows_and_repairs_a_short_repetition(spark, monkeypatch):
    """The same rows as by ranking all of them, also with a threshold set too low on purpose."""
    drawn = resample._draws(spark.range(3000), 3000, 20).withColumnRenamed("draw", "idx")
    drawn = drawn.withColumn("h", resample.draw_number(F.col("rep"), F.col("idx")))
    order = Window.partitionBy("rep").orderBy("h", "idx")
    want = {(r.rep, r.idx) for r in drawn.withColumn("p", F.row_number().over(order)).filter("p <= 90").collect()}
    for spare in (12.0, 0.0, -5.0):
        assert {(r.rep, r.idx) for r in resample.subsample(3000, drawn, 90, spare).collect()} == want
    assert resample.subsample(50, drawn.filter("idx < 50"), 90).count() == 20 * 50
