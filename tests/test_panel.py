from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from pingscape.operators import events, panel

PING = "caid string, latitude double, longitude double, utc_timestamp long, altitude double"
BOX = "POLYGON ((30 49, 31 49, 31 50, 30 50, 30 49))"
WIDE = "POLYGON ((29 48, 32 48, 32 51, 29 51, 29 48))"
T0 = 1647338400  # a full hour


def ts(seconds):
    return datetime.fromtimestamp(T0 + int(seconds), timezone.utc).replace(tzinfo=None)


def alerts(spark, rows):
    return spark.createDataFrame(
        [(n, ts(a), None if b is None else ts(b)) for n, a, b in rows],
        "region_english string, start_dt timestamp, end_dt timestamp",
    )


def regions(spark):
    return spark.createDataFrame([("in", BOX), ("out", WIDE)], "region_english string, geometry string")


def pings(spark, times, caid="d"):
    return spark.createDataFrame(
        [(caid, 49.5 + 1e-5 * i, 30.5, T0 + t, None if i % 2 else 100.0) for i, t in enumerate(times)], PING
    )


def test_first_and_equal_second_pings_are_dropped(spark):
    out = panel.drop_jumps(panel.with_speed(pings(spark, [0, 10, 10, 3700]))).collect()
    assert sorted(r.utc_timestamp - T0 for r in out) == [10, 3700]


def test_null_altitude_is_ignored_in_the_mean(spark):
    out = panel.minute_means(panel.drop_jumps(panel.with_speed(pings(spark, [0, 5, 10, 15]))), "UTC").collect()
    assert [r.altitude_avg for r in out] == [100.0]


def test_nested_regions_fold_to_one_row_and_both_ends_count(spark):
    given = alerts(spark, [("in", 120, 240), ("out", 180, 300)])
    out = panel.minute_panel(pings(spark, range(0, 420, 20)), regions(spark), given, "UTC").collect()
    by_minute = {int((r.minute - ts(0)).total_seconds()): r for r in out}
    assert len(out) == len(by_minute) == 7
    assert [by_minute[m].alert for m in range(0, 420, 60)] == [0, 0, 1, 1, 1, 1, 0]
    assert by_minute[180].region_english == "in"  # the earlier alert
    assert by_minute[180].start_raid_min == ts(120) and by_minute[180].end_raid_max == ts(300)
    assert by_minute[300].region_english == "out"


def test_overlapping_alerts_and_open_alert(spark):
    given = alerts(spark, [("in", 60, 200), ("in", 100, 400), ("out", 300, None)])
    out = {
        (r.region_english, r.minute): (r.start_raid, r.end_raid) for r in panel.alert_minutes(given).collect()
    }
    assert out[("in", ts(120))] == (ts(60), ts(400))
    assert out[("in", ts(240))] == (ts(100), ts(400))
    assert not any(region == "out" for region, _ in out)


def test_region_without_any_alert_has_no_name(spark):
    given = alerts(spark, [("out", 60, 200)])
    only = spark.createDataFrame([("in", BOX)], "region_english string, geometry string")
    out = panel.minute_panel(pings(spark, range(0, 120, 20)), only, given, "UTC").collect()
    assert out and all(r.region_english is None for r in out)


def test_interval_join_matches_nested_loop(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    given = [("r" + str(rng.integers(3)), int(a), int(a + rng.integers(0, 900))) for a in rng.integers(0, 5000, 40)]
    minutes = [(f"d{d}", "r" + str(d % 4), ts(60 * int(m))) for d in range(8) for m in rng.choice(90, 40, replace=False)]
    df = spark.createDataFrame(minutes, "caid string, region_english string, minute timestamp")
    out = {(r.caid, r.minute): (r.start_raid, r.end_raid) for r in panel.attach_alerts(df, alerts(spark, given)).collect()}
    assert len(out) == len(minutes)
    for caid, region, minute in minutes:
        hit = [(ts(a), ts(b)) for n, a, b in given if n == region and ts(a) <= minute <= ts(b)]
        want = (min(a for a, _ in hit), max(b for _, b in hit)) if hit else (None, None)
        assert out[(caid, minute)] == want


PANEL = ("caid string, minute timestamp, day date, kmh_avg double, distance_sum double, longitude_center double, "
         "latitude_center double, region_english string, start_raid_min timestamp")


def panel_rows(spark, rows):
    day = ts(0).date()
    return spark.createDataFrame(
        [(c, ts(m), day, k, d, 30.0, lat, reg, None if s is None else ts(s)) for c, m, k, d, lat, reg, s in rows], PANEL
    )


def test_device_day_rules(spark):
    rows = [("ok", 0, 1.0, 5.0, 49.0, "r", None), ("still", 0, 1.0, 0.0, 49.0, "r", None),
            ("far", 0, 1.0, 100000.0, 49.0, "r", None), ("unknown", 0, 1.0, None, 49.0, "r", None)]
    out = events.plausible_days(panel_rows(spark, rows))
    assert {r.caid for r in out.collect()} == {"ok", "unknown"}


def test_next_alert_anchor_and_cells(spark):
    rows = [("d", 0, 1.0, 5.0, 49.0, "r", None), ("d", 60, 1.0, 5.0, 49.1, "r", None),
            ("d", 120, 1.0, 5.0, 49.2, "r", 130), ("d", 240, 1.0, 5.0, 49.3, "r", None)]
    near = events.next_alert(panel_rows(spark, rows))
    out = {int((r.minute - ts(0)).total_seconds()): r for r in events.with_anchor(near).collect()}
    assert sorted(out) == [0, 60, 120]  # nothing follows the last row
    assert [out[m].time_to_raid for m in (0, 60, 120)] == [-120, -60, 0]
    assert out[60].distance_point == 0.0
    assert out[120].distance_point == pytest.approx(2 * 6378000 * 0.000872664, rel=1e-4)
    cells = {r.time_to_raid: r.time_to_raid_post for r in events.with_cell(near, first=-60).collect()}
    assert cells == {-120: -1, -60: -60, 0: 0}


def test_event_id_text(spark):
    df = spark.createDataFrame([(ts(0), "Kiev")], "start_raid_next timestamp, region_english string")
    assert df.select(events.event_id().alias("id")).first().id == "2022-03-15 10:00:00Kiev"


def test_balanced_events_need_every_minute(spark):
    full = [("a", 60 * m, 1.0, 5.0, 49.0, "r", None) for m in range(31)]
    df = panel_rows(spark, full).withColumn("start_raid_next", F.lit(ts(900)).cast("timestamp")).withColumn(
        "time_to_raid", F.unix_timestamp("minute") - F.unix_timestamp("start_raid_next")
    )
    assert events.balanced_events(df, 0.25).count() == 31
    assert events.balanced_events(df.filter(F.col("minute") != F.lit(ts(300))), 0.25).count() == 0


def test_consistent_sample_and_exclusions(spark):
    rows = [("all", "2022-03-05"), ("all", "2022-05-05"), ("all", "2022-09-05"), ("two", "2022-03-05"), ("two", "2022-06-01")]
    df = spark.createDataFrame(rows, "caid string, d string").select("caid", F.to_date("d").alias("day"))
    assert {r.caid for r in events.consistent_sample(events.with_period(df)).collect()} == {"all"}
    named = spark.createDataFrame([("Kiev",), ("Donetsk oblast",), ("Luhansk",)], "region_english string")
    assert [r[0] for r in events.exclude_names(named).collect()] == ["Kiev"]


def test_repeated_hour_gives_one_row_per_minute(spark):
    """00:30 and 01:30 UTC on 2022-10-30 are both 03:30 in Kyiv."""
    at = 1667089800
    rows = [("a", at + d, 49.0 + k * 1e-4, 30.0, 1.0, 0.5, float(k)) for k, d in enumerate((0, 20, 3600, 3620))]
    speeds = spark.createDataFrame(rows, "caid string, utc_timestamp long, latitude double, longitude double, altitude double, kmh double, distance double")
    out = panel.minute_means(speeds, "Europe/Kyiv").collect()
    assert [(r["minute"].hour, r["minute"].minute, r["distance_sum"]) for r in out] == [(3, 30, 6.0)]


def test_long_alerts_take_a_row_per_hour_and_join_like_short_ones(spark):
    given = [("in", -30, 180 * 86400), ("in", 90, 100), ("in", 7200, 7500)]
    spans = panel.alert_spans(alerts(spark, given))
    assert spans.count() == 180 * 24 + 1  # the last minute starts a new hour
    df = spark.createDataFrame(
        [("d", "in", ts(m)) for m in (0, 60, 120, 7200, 180 * 86400, 180 * 86400 + 60)] + [("d", None, ts(0))],
        "caid string, region_english string, minute timestamp",
    )
    out = {(r.region_english, r.minute): (r.start_raid, r.end_raid, r.alert) for r in panel.attach_alerts(df, alerts(spark, given)).collect()}
    whole = (ts(-30), ts(180 * 86400), 1)
    assert [out["in", ts(m)] for m in (0, 60, 120, 7200, 180 * 86400)] == [whole] * 5
    assert out["in", ts(180 * 86400 + 60)] == (None, None, 0) and out[None, ts(0)] == (None, None, 0)
