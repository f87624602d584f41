import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from models import arc, even_odd
from pingscape.functions import geo
from pingscape.operators import context, front, polygons
from pingscape.sources.tables import wkt_rings


def ring_text(ring):
    return "(" + ", ".join(f"{x} {y}" for x, y in ring) + ")"


def shapes():
    """A star with a hole, two separate parts and a plain box."""
    rng = np.random.default_rng(11)

    def star(cx, cy, size, turn=1):
        angles = np.linspace(0, 2 * math.pi, 23)[:-1][::turn]
        radius = size * rng.uniform(0.5, 1, len(angles))
        pts = [(float(cx + r * math.cos(a)), float(cy + r * math.sin(a))) for a, r in zip(angles, radius)]
        return pts + pts[:1]

    holed = [star(0.5, 0.5, 0.9), star(0.5, 0.5, 0.3, -1)]
    parts = [star(2.0, 2.0, 0.6), star(-1.0, 1.5, 0.7)]
    box = [[(0.0, 0.0), (3.0, 0.0), (3.0, 0.75), (0.0, 0.75), (0.0, 0.0)]]
    text = {
        "holed": f"POLYGON ({', '.join(ring_text(r) for r in holed)})",
        "parts": f"MULTIPOLYGON ({', '.join('(' + ring_text(r) + ')' for r in parts)})",
        "box": f"POLYGON ({ring_text(box[0])})",
    }
    return {"holed": holed, "parts": parts, "box": box}, text


def polygon_frame(spark):
    rings, text = shapes()
    rows = [*text.items(), ("empty", None)]
    return rings, spark.createDataFrame(rows, "name string, geometry string")


@pytest.mark.parametrize("cell", [0.25, 0.6])
def test_locate_matches_the_ray_rule(spark, cell):
    rings, df = polygon_frame(spark)
    pts = np.random.default_rng(12).uniform(-2, 3.2, (1500, 2))
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "i long, x double, y double")
    want = {(i, n) for i, (x, y) in enumerate(pts) for n in rings if even_odd(rings[n], x, y)}
    out = polygons.locate(points, df, "name", "x", "y", cell=cell).collect()
    assert {(r.i, r.name) for r in out} == want and len(out) == len(want)
    left = polygons.locate(points, df, "name", "x", "y", how="left", cell=cell).collect()
    assert {(r.i, r.name) for r in left if r.name} == want
    assert {r.i for r in left} == set(range(len(pts)))


def test_locate_beyond_the_broadcast_limit(spark, monkeypatch):
    rings, df = polygon_frame(spark)
    pts = np.random.default_rng(13).uniform(-2, 3.2, (400, 2))
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "i long, x double, y double")
    broadcast = polygons.locate(points, df, "name", "x", "y").collect()
    monkeypatch.setattr("pingscape.operators.joins.fits_broadcast", lambda *_: False)
    salted = polygons.locate(points, df, "name", "x", "y").collect()
    assert sorted((r.i, r.name) for r in salted) == sorted((r.i, r.name) for r in broadcast)


def test_edge_points(spark):
    df = spark.createDataFrame([("box", "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))")], "name string, geometry string")
    pts = [(0.0, 0.5), (1.0, 0.5), (0.5, 0.0), (0.5, 1.0), (0.0, 0.0), (1.0, 1.0), (0.5, 0.5), (1.5, 1.0), (-0.5, 0.0)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "i int, x double, y double")
    within = {r.i for r in polygons.locate(points, df, "name", "x", "y").collect()}
    touching = {r.i for r in polygons.locate(points, df, "name", "x", "y", boundary=True).collect()}
    assert within == {6} and touching == {0, 1, 2, 3, 4, 5, 6}


def test_area_of_ring(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 3, 0 0))",)], "g string")
    assert df.select(polygons.ring_area(wkt_rings(F.col("g"))[0]).alias("a")).first().a == 6.0


def test_largest_overlap_matches_sampling(spark):
    rings, df = polygon_frame(spark)
    size = 0.5
    cells = [(i, -2 + size * (i % 10), -1 + size * (i // 10)) for i in range(100)]
    given = spark.createDataFrame(cells, "wp_index long, x double, y double").withColumn("v", F.lit(1.0))
    out = {r.wp_index: (r.name, r.area) for r in context.largest_overlap(given, df, "name", size, grid=0.7).collect()}
    at = (np.arange(40) + 0.5) / 40 * size
    for i, x, y in cells:
        share = {
            n: sum(even_odd(rings[n], x + a, y + b) for a in at for b in at) / 1600 * size**2 for n in rings
        }
        best = max(share.values())
        if best > 0.01:
            name, area = out[i]
            assert abs(area - share[name]) < 0.01 and share[name] > best - 0.01
        else:
            assert i not in out or out[i][1] < 0.02


@pytest.mark.parametrize("wkt, area", [
    ("MULTIPOLYGON (((0 0, 0.05 0, 0.05 0.1, 0 0.1, 0 0)), ((0.05 0, 0.05 0.1, 0.1 0.1, 0.1 0, 0.05 0)))", 0.01),
    ("POLYGON ((0 0, 0.1 0, 0.1 0.1, 0 0.1, 0 0), (0.02 0.02, 0.08 0.02, 0.08 0.08, 0.02 0.08, 0.02 0.02))", 0.0064),
    ("POLYGON ((0 0, 0 0.1, 0.1 0.1, 0.1 0, 0 0), (0.02 0.02, 0.08 0.02, 0.08 0.08, 0.02 0.08, 0.02 0.02))", 0.0064),
    ("MULTIPOLYGON (((0 0, 0.1 0, 0.1 0.1, 0 0.1, 0 0), (0.02 0.02, 0.08 0.02, 0.08 0.08, 0.02 0.08, 0.02 0.02)), "
     "((0.04 0.04, 0.04 0.06, 0.06 0.06, 0.06 0.04, 0.04 0.04)))", 0.0068),
])
def test_overlap_area_for_any_ring_direction(spark, wkt, area):
    df = spark.createDataFrame([("u", wkt)], "name string, geometry string")
    cells = spark.createDataFrame([(1, 0.0, 0.0, 1.0)], "wp_index long, x double, y double, v double")
    out = context.largest_overlap(cells, df, "name", 0.1).collect()
    assert len(out) == 1 and out[0].area == pytest.approx(area, abs=1e-12)


def test_distances(spark):
    df = spark.createDataFrame([(49.0, 30.0, 49.01, 30.02), (None, 30.0, 49.0, 30.0)], "a double, b double, c double, d double")
    cols = [F.col(c) for c in "abcd"]
    near = geo.within_arc(geo.unit_vector(cols[0], cols[1]), geo.unit_vector(cols[2], cols[3]), 1835.0)
    row, missing = df.select(
        geo.arc_m(*cols).alias("arc"), geo.chord_m(*cols).alias("chord"), near.alias("near")
    ).collect()
    exact = arc(49.0, 30.0, 49.01, 30.02)
    assert row.arc == pytest.approx(exact)
    assert row.near == (exact <= 1835.0)
    assert row.chord == pytest.approx(2 * 6378000 * math.sin(exact / 2 / 6371009), rel=1e-12)
    assert missing.arc is None and missing.chord is None


def test_lens_distance_matches_a_grid(spark):
    rng = np.random.default_rng(14)
    lenses = []
    while len(lenses) < 6:
        a, b = rng.uniform(-6, 6, 2), rng.uniform(-6, 6, 2)
        if 0.5 < np.hypot(*(a - b)) < 9.9:
            lenses.append((*map(float, a), *map(float, b)))
    pts = rng.uniform(-15, 15, (60, 2))
    rows = [(i, float(x), float(y), *lens) for i, (x, y) in enumerate(pts) for lens in lenses]
    df = spark.createDataFrame(rows, "i long, x double, y double, ax double, ay double, bx double, by double")
    out = df.groupBy("i").agg(
        F.min(front.lens_distance(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])).alias("d")
    )
    got = {r.i: r.d for r in out.collect()}
    g = np.arange(-12, 12, 0.03)
    gx, gy = np.meshgrid(g, g)
    inside = np.zeros_like(gx, bool)
    for ax, ay, bx, by in lenses:
        inside |= (np.hypot(gx - ax, gy - ay) <= 5) & (np.hypot(gx - bx, gy - by) <= 5)
    zx, zy = gx[inside], gy[inside]
    for i, (x, y) in enumerate(pts):
        assert abs(got[i] - np.hypot(zx - x, zy - y).min()) < 0.05


def test_front_distance_keeps_the_nearest_lens_of_every_area(spark):
    rng = np.random.default_rng(15)
    n = 250
    spots = [(i, float(30 + rng.uniform(0, 6)), float(48 + rng.uniform(0, 3)), "RU" if rng.random() < 0.5 else "UA") for i in range(n)]
    spots += [(n + i, lon, lat, side) for i, (_, lon, lat, side) in enumerate(spots[:40])]  # copies
    wide = spark.createDataFrame(spots, "locality int, longitude double, latitude double, ctr_20220315 string")
    lenses = front.contact_lenses(front.control_long(wide), 49.5)
    table = lenses.toPandas()
    assert len(table) > 20 and not table.duplicated().any()
    pts = [(f"d{i}", float(30 + rng.uniform(-1, 7)), float(48 + rng.uniform(-1, 4))) for i in range(80)]
    points = spark.createDataFrame(pts, "caid string, longitude_center double, latitude_center double").withColumn(
        "day", F.to_date(F.lit("2022-03-15"))
    )
    got = {r.caid: r.distance_to_front for r in front.front_distance(points, lenses, ["caid"], 49.5).collect()}
    everything = points.withColumns(
        {"x": geo.x_km(F.col("longitude_center"), 49.5), "y": geo.y_km(F.col("latitude_center"))}
    ).join(lenses, "day").groupBy("caid").agg(
        F.min(front.lens_distance(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])).alias("d")
    )
    want = {r.caid: r.d for r in everything.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_contested_counts_as_one_side(spark):
    df = spark.createDataFrame([(1, 30.0, 49.0, "CONTESTED"), (2, 30.01, 49.0, "UA")],
                               "locality int, longitude double, latitude double, ctr_20220316 string")
    assert front.contact_lenses(front.control_long(df), 49.0).count() == 1
