import json

from pyspark.sql import functions as F

from pingscape.plans import jobs
from pingscape.queries import views as V
from pingscape.queries.common import local_alerts
from pingscape.sources import sinks, tables

SF = "/root/testdata/sf0.01"


def test_from_raw_pings_to_estimates(spark, tmp_path):
    raw = V.raw_pings(spark, SF).withColumns(
        {c: F.lit("") for c in ("id_type", "geo_hash", "ip_address")}
    ).select([f.name for f in tables.RAW_PING_SCHEMA])
    sinks.write_parquet(raw, f"{tmp_path}/raw/2022/03/15")
    pings = jobs.extract_pings(spark, f"{tmp_path}/raw/", "2022-03-15", "UA", f"{tmp_path}/pings")
    assert pings.count() == 6045
    dwells = jobs.write_dwells(spark, f"{tmp_path}/pings", f"{tmp_path}/dwells", partitions=3)
    assert dwells.count() == 318
    panel = jobs.write_panel(
        spark, f"{tmp_path}/pings", V.regions(spark, SF), V.cities(spark, SF), local_alerts(spark, SF),
        f"{tmp_path}/panel", V.ZONE,
    )
    assert panel.count() == 5895 and panel.select("day").distinct().count() == 1
    homes = V.dwells(spark, SF).groupBy("caid").agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude")
    ).withColumn("start_date", F.lit("2022-03-02"))
    jobs.write_study(
        spark, f"{tmp_path}/panel", local_alerts(spark, SF), homes, f"{tmp_path}/study", ["distance_sum"], (0.5,)
    )
    estimates = tables.scan_parquet(spark, f"{tmp_path}/study/estimates")
    assert estimates.filter("scenario = 'base' AND scale = ''").count() == 164
    assert tables.scan_parquet(spark, f"{tmp_path}/study/estimates_30").count() > 0
    jobs.write_front_study(spark, f"{tmp_path}/study/events", V.control(spark, SF), f"{tmp_path}/front", V.LAT0)
    front = tables.scan_parquet(spark, f"{tmp_path}/front/front_events")
    assert front.count() == 4235 and front.filter("distance_to_front < 0").count() == 0
    tables.scan_parquet(spark, f"{tmp_path}/front/front_estimates").count()


def test_alert_log_to_named_alerts(spark, tmp_path):
    log = tmp_path / "log.json"
    log.write_text("﻿" + json.dumps([{"locations": [1647338400, 1647342000, None, 1647400000]}, {"locations": [1647338400]}]),
                   encoding="utf-8")
    places = spark.createDataFrame([(0, "K"), (1, "L")], "place long, region_ukrainian string")
    labels = spark.createDataFrame([("K", "Kyiv oblast")], "key string, value string")
    one = spark.createDataFrame([("Kiev", None)], "NAME_1 string, VARNAME_1 string")
    two = spark.createDataFrame([("x", "y")], "name_2 string, varname_2 string")
    out = jobs.write_alerts(spark, str(log), places, labels, one, two, f"{tmp_path}/alerts").orderBy("start").collect()
    assert [(r.NAME_1, r.duration) for r in out] == [("Kiev", 60.0), ("Kiev", None)]
    assert str(out[0].start_dt) == "2022-03-15 12:00:00"


def test_homes_population_and_harm(spark, tmp_path):
    sinks.write_parquet(V.dwells(spark, SF), f"{tmp_path}/dwells")
    homes = jobs.write_homes(spark, f"{tmp_path}/dwells", f"{tmp_path}/homes", *V.HOME_SPAN)
    assert homes.count() == 270
    units = V.regions(spark, SF).filter("region_english <> 'R01'").withColumnRenamed("region_english", "unit")
    parents = units.select("unit", F.lit("all").alias("parent"))
    by_unit, _by_parent = jobs.population_fit(homes, V.cells(spark, SF), units, parents, "unit", "parent", 0.02)
    assert by_unit.first().ratio > 0
    days = jobs.write_counterfactuals(
        spark, V.casualties(spark, SF), "Civilians", V.alert_days(spark, SF), f"{tmp_path}/harm"
    )
    assert days.count() == 205
