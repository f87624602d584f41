"""Steps of st5_scenario_grid that must not be repeated per reader, per salt or in one task."""

import math

from pyspark.sql import functions as F

from pingscape.operators import clusters, front


def test_front_distances_are_worked_out_once(spark):
    lenses = spark.createDataFrame([("2022-03-15", 0.0, 0.0, 10.0, 0.0)], "day string, ax double, ay double, bx double, by double")
    points = spark.createDataFrame(
        [(i, "2022-03-15", 30.0 + i / 50, 49.0) for i in range(40)], "caid long, day string, longitude_center double, latitude_center double"
    )
    found = front.front_distance(points, lenses, ["caid"], 49.5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "lambda" not in plan
    assert found.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.count() == found.select("caid").distinct().count() == 40


def test_only_probes_of_dense_cells_are_repeated_by_salt(spark, monkeypatch):
    own, sizes = clusters.salted_join, []

    def counting(facts, dim, *more, **named):
        if "probe" in dim.columns:
            sizes.append(dim.count())
        return own(facts, dim, *more, **named)

    monkeypatch.setattr(clusters, "salted_join", counting)
    # key 1: 30 places far apart; key 2: a cell of 6 places, one place beside it, one far away
    eps = 1e-5
    step = math.degrees(eps)
    apart = [(1, 10.0 + i, 20.0, 1) for i in range(30)]
    close = [(2, 5.0 + i * step / 100, 5.0, 1) for i in range(6)] + [(2, 5.0 + 0.9 * step, 5.0, 1), (2, 7.0, 7.0, 1)]
    # key 3: a chain of places 0.8 eps apart without a dense cell
    chain = [(3, 1.0 + 0.8 * step * i, 1.0, 1) for i in range(5)]
    places = spark.createDataFrame(apart + close + chain, "k long, latitude double, longitude double, weight long")
    found = clusters.density_clusters(places, ["k"], eps, 3).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("c"))
    assert {r["k"]: (r["n"], r["c"]) for r in found.collect()} == {2: (7, 1), 3: (5, 1)}
    assert sizes and sum(sizes) < 10
