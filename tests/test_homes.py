import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from models import dbscan
from pingscape.operators import clusters, homes


@pytest.mark.parametrize("min_points", [3, 5])
def test_clusters_match_brute_force(spark, min_points):
    rng = np.random.default_rng(min_points)
    rows = []
    for g in range(40):
        base = rng.choice([49.0, -12.0, 0.0, 69.0])
        pts = base + rng.normal(0, rng.choice([0.0005, 0.002, 0.006]), (int(rng.integers(3, 140)), 2))
        rows += [(g, float(a), float(b), 1) for a, b in (np.round(pts, 4) if g % 3 == 0 else pts)]
    pdf = pd.DataFrame(rows, columns=["g", "latitude", "longitude", "weight"])
    pdf = pdf.groupby(["g", "latitude", "longitude"], as_index=False).weight.sum()
    out = clusters.density_clusters(spark.createDataFrame(pdf), ["g"], 0.05 / 6371, min_points).collect()
    got = {(r.g, r.latitude, r.longitude): tuple(r.cluster) for r in out}
    for g, x in pdf.groupby("g"):
        pts = x[["latitude", "longitude"]].values
        for p, label in zip(pts, dbscan(pts, x.weight.values, 0.05 / 6371, min_points)):
            assert got.get((g, *p)) == label


def test_long_chain_is_one_cluster(spark):
    step = 0.0004  # about 44 m of latitude
    rows = [(1, 10 + i * step, 20.0, 1) for i in range(60)]
    places = spark.createDataFrame(rows, "g long, latitude double, longitude double, weight long")
    out = clusters.density_clusters(places, ["g"], 0.05 / 6371, 3)
    assert out.count() == 60
    assert out.select("cluster").distinct().count() == 1


def test_dense_cells_linked_only_by_places_between_their_boxes(spark):
    # two clouds whose nearest places are 49.9 m / 50.1 m apart
    def cloud(lat, sign):
        return [lat + sign * 0.00001 * i for i in range(8)]

    m = 180 / np.pi / 6371000
    for gap, expected in ((49.9, 1), (50.1, 2)):
        rows = [(1, v, 0.0, 1) for v in cloud(10.0, -1)] + [(1, v, 0.0, 1) for v in cloud(10.0 + gap * m, 1)]
        places = spark.createDataFrame(rows, "g long, latitude double, longitude double, weight long")
        out = clusters.density_clusters(places, ["g"], 0.05 / 6371, 3)
        assert out.select("cluster").distinct().count() == expected


@pytest.mark.parametrize("centre", [(-17.0, 180.0), (89.99, 0.0), (-89.995, 120.0), (0.0, 0.0)])
def test_clusters_cross_the_180th_meridian_and_the_poles(spark, centre):
    """Clouds of places around a point, made on the sphere, so their longitudes jump or run all around."""
    rng = np.random.default_rng(11)
    lat, lon = np.radians(centre)
    up = np.array([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
    rows = []
    for g, spread in enumerate([2e-6, 6e-6, 2e-5]):
        p = up + rng.normal(0, spread, (70, 3))
        p /= np.linalg.norm(p, axis=1)[:, None]
        rows += [(g, float(a), float(b), 1) for a, b in zip(np.degrees(np.arcsin(p[:, 2])), np.degrees(np.arctan2(p[:, 1], p[:, 0])))]
    rows += [(9, -17.0, 179.99999, 2), (9, -17.0, -179.99999, 2)]  # 2 m apart
    pdf = pd.DataFrame(rows, columns=["g", "latitude", "longitude", "weight"])
    out = clusters.density_clusters(spark.createDataFrame(pdf), ["g"], 0.05 / 6371, 3).collect()
    got = {(r.g, r.latitude, r.longitude): tuple(r.cluster) for r in out}
    for g, x in pdf.groupby("g"):
        pts = x[["latitude", "longitude"]].values
        for p, label in zip(pts, dbscan(pts, x.weight.values, 0.05 / 6371, 3)):
            assert got.get((g, *p)) == label
    assert len({c for (g, _, _), c in got.items() if g == 9}) == 1 and len(got) > 20


DWELL = "caid string, latitude double, longitude double, utc_timestamp_start long, stay_length_sec int"


def epoch(text):
    return int(pd.Timestamp(text, tz="UTC").timestamp())


def test_nights_cross_new_year_and_the_end_date_is_excluded(spark):
    rows = [
        ("a", 1.0, 1.0, epoch("2023-12-31 20:00"), 8 * 3600),
        ("b", 1.0, 1.0, epoch("2024-01-09 22:30"), 8 * 3600),  # 00:30 local on the end date
        ("c", 1.0, 1.0, epoch("2024-01-03 08:00"), 3 * 3600),  # no midnight
        ("d", 1.0, 1.0, epoch("2024-01-03 20:00"), 7200),  # not long enough
        ("e", 1.0, 1.0, epoch("2024-01-03 20:00"), 40 * 3600),
    ]
    out = homes.overnight_stays(spark.createDataFrame(rows, DWELL), "2023-12-01", "2024-01-10").collect()
    assert sorted((r.caid, r.num_days) for r in out) == [("a", 1), ("e", 2)]


def test_windows_cover_both_ends(spark):
    start, end = "2022-01-01", "2022-12-31"
    days = spark.sql("select explode(sequence(timestamp'2022-01-01', timestamp'2022-12-31', interval 6 hours)) as date")
    out = homes.home_windows(days, start, end).groupBy("start_date").agg(
        F.min("date").alias("lo"), F.max("date").alias("hi")
    ).orderBy("start_date").collect()
    assert len(out) == 13
    assert str(out[0].start_date) == "2022-01-02"
    assert str(out[1].lo) == "2022-01-11 00:00:00" and str(out[1].hi) == "2022-02-22 00:00:00"


def test_device_without_dense_place_has_no_home(spark):
    rows = [("spread", 10.0 + i, 20.0, epoch(f"2024-01-0{i + 1} 20:00"), 8 * 3600) for i in range(5)]
    rows += [("home", 10.0, 20.0, epoch(f"2024-01-0{i + 1} 20:00"), 8 * 3600) for i in range(4)]
    rows += [("few", 10.0, 20.0, epoch(f"2024-01-0{i + 1} 20:00"), 8 * 3600) for i in range(3)]
    out = homes.home_locations(spark.createDataFrame(rows, DWELL), "2023-12-20", "2024-01-20").collect()
    assert {r.caid for r in out} == {"home"}  # four nights at the same coordinates count
    assert all((r.latitude, r.longitude) == (10.0, 20.0) for r in out)


def test_crowded_spots_are_left_out(spark):
    rows = [(f"d{i}", 1.0, 2.0) for i in range(4)] + [(f"e{i}", 3.0, 4.0) for i in range(3)]
    out = homes.drop_crowded_spots(spark.createDataFrame(rows, "caid string, longitude double, latitude double"))
    assert {r.caid for r in out.collect()} == {"e0", "e1", "e2"}
