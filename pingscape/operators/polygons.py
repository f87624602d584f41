"""Point-in-polygon joins on a grid of cells."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import grid_cell
from ..sources.tables import wkt_rings
from .joins import reference_join

CELL = 0.25


def polygon_edges(polygons: DataFrame, name: str, wkt: str = "geometry", oriented: bool = False) -> DataFrame:
    """One row per edge (x1, y1, x2, y2) of every ring; rows without geometry give none.

    With `oriented`, rings run one way where they add area and the other way where they take it away.
    """
    given = polygons.filter(F.col(wkt).isNotNull()).select(name, wkt_rings(F.col(wkt)).alias("rings"))
    rings = oriented_rings(given, name) if oriented else given
    return (
        rings.select(name, F.explode("rings").alias("ring"))
        .select(name, "ring", F.posexplode("ring").alias("i", "a"))
        .filter(F.col("i") < F.size("ring") - 1)
        .withColumn("b", F.element_at("ring", F.col("i") + 2))
        .select(
            name,
            F.col("a.x").alias("x1"), F.col("a.y").alias("y1"),
            F.col("b.x").alias("x2"), F.col("b.y").alias("y2"),
        )
    )


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring of (x, y) structs, positive if it runs against the clock."""
    steps = F.sequence(F.lit(2), F.size(ring))
    twice = F.aggregate(
        steps,
        F.lit(0.0),
        lambda acc, i: acc
        + F.element_at(ring, i - 1)["x"] * F.element_at(ring, i)["y"]
        - F.element_at(ring, i)["x"] * F.element_at(ring, i - 1)["y"],
    )
    return twice / 2


def ring_area(ring: Column) -> Column:
    """Unsigned area of a closed ring."""
    return F.abs(signed_area(ring))


def polygon_areas(polygons: DataFrame, name: str, wkt: str = "geometry") -> DataFrame:
    """(name, area) of whole polygons: all parts, without their holes; rows without geometry give none."""
    given = polygons.filter(F.col(wkt).isNotNull()).select(name, wkt_rings(F.col(wkt)).alias("rings"))
    total = F.aggregate("rings", F.lit(0.0), lambda s, r: s + signed_area(r))
    return oriented_rings(given, name).select(name, total.alias("area"))


def _crossings(ring: Column, y: Column) -> Column:
    """Sorted x of the places where a ring crosses the line at height y."""
    at = lambda i: F.element_at(ring, i)
    edges = F.filter(F.sequence(F.lit(2), F.size(ring)), lambda i: (at(i - 1)["y"] > y) != (at(i)["y"] > y))
    slope = lambda i: (at(i)["x"] - at(i - 1)["x"]) / (at(i)["y"] - at(i - 1)["y"])
    return F.array_sort(F.transform(edges, lambda i: at(i - 1)["x"] + slope(i) * (y - at(i - 1)["y"])))


def oriented_rings(polygons: DataFrame, name: str) -> DataFrame:
    """(name, rings): rings inside an odd number of larger rings run with the clock, all others against it.

    WKT writers do not promise directions.  Rings of a polygon may touch but not cross, so a ring lies inside a larger
    one if a point of its interior does; the point is between the first two crossings just above its lowest corner.
    Rings without any height enclose nothing and stay as they are.
    """
    tall = polygons.withColumn("rings", F.filter("rings", lambda r: F.array_max(r["y"]) > F.array_min(r["y"])))
    height = lambda r: (lambda ys: (ys[0] + ys[1]) / 2)(F.array_sort(F.array_distinct(r["y"])))
    known = tall.withColumn(
        "rings", F.transform("rings", lambda r: F.struct(r.alias("ring"), signed_area(r).alias("area"), height(r).alias("y")))
    )
    known = known.withColumn(
        "rings", F.transform("rings", lambda k: F.struct(
            k["ring"].alias("ring"), k["area"].alias("area"), k["y"].alias("y"), _crossings(k["ring"], k["y"]).alias("xs")
        ))
    )

    def turned(k: Column) -> Column:
        x = (k["xs"][0] + k["xs"][1]) / 2
        around = F.filter("rings", lambda o: (F.abs(o["area"]) > F.abs(k["area"])) & (
            F.size(F.filter(_crossings(o["ring"], k["y"]), lambda c: c > x)) % 2 == 1
        ))
        adds = F.size(around) % 2 == 0
        return F.when((k["area"] > 0) == adds, k["ring"]).otherwise(F.reverse(k["ring"]))

    return known.select(name, F.transform("rings", turned).alias("rings"))


def polygon_cells(polygons: DataFrame, name: str, wkt: str = "geometry", cell: float = CELL) -> DataFrame:
    """Grid index: (cx, cy, name, edges) with the edges a ray to the east from that cell can meet.

    Groups are bounded by a polygon's corners in one row of cells.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    bands = polygon_edges(polygons, name, wkt).withColumn(
        "cy", F.explode(F.sequence(grid_cell(low, cell), grid_cell(high, cell)))
    )
    first_cx = F.min(grid_cell(F.least("x1", "x2"), cell)).over(W.partitionBy(name, "cy"))
    return (
        bands.withColumn("first_cx", first_cx)
        .withColumn(
            "cx", F.explode(F.sequence("first_cx", grid_cell(F.greatest("x1", "x2"), cell)))
        )
        .groupBy("cx", "cy", name)
        .agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    )


def _turn(e: Column, x: Column, y: Column) -> Column:
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * (e["y2"] - e["y1"])


def inside(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: an odd number of edges is crossed by the ray to the east."""
    def crosses(e: Column) -> Column:
        return ((e["y1"] > y) != (e["y2"] > y)) & (_turn(e, x, y) * F.signum(e["y2"] - e["y1"]) > 0)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def on_edge(edges: Column, x: Column, y: Column) -> Column:
    def touches(e: Column) -> Column:
        return (
            (_turn(e, x, y) == 0)
            & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    return F.exists(edges, touches)


def locate(
    points: DataFrame,
    polygons: DataFrame,
    name: str,
    x: str = "longitude_center",
    y: str = "latitude_center",
    wkt: str = "geometry",
    how: str = "inner",
    boundary: bool = False,
    cell: float = CELL,
) -> DataFrame:
    """Add the polygon name to each point, one row per polygon that holds it.

    `boundary=False` is "within" (points on an edge are outside), `True` is "intersects".  With
    how="left" points in no polygon stay with a null name.  Each point meets only the polygons of its
    cell; the index is broadcast if its counted size allows, else joined with salted cells.
    """
    index = polygon_cells(polygons, name, wkt, cell)
    px, py = F.col(x), F.col(y)
    test = inside(F.col("edges"), px, py)
    edge = on_edge(F.col("edges"), px, py)
    hit = (test | edge) if boundary else (test & ~edge)
    per_cell = index.groupBy("cx", "cy").agg(
        F.collect_list(F.struct(name, "edges")).alias("candidates")
    )
    keyed = points.withColumns({"cx": grid_cell(px, cell), "cy": grid_cell(py, cell)})
    if how == "inner":
        joined = reference_join(keyed, index, ["cx", "cy"], "inner", spread=points.columns)
        return joined.filter(hit).drop("cx", "cy", "edges")

    def holds(c: Column) -> Column:
        t, e = inside(c["edges"], px, py), on_edge(c["edges"], px, py)
        return (t | e) if boundary else (t & ~e)

    joined = reference_join(keyed, per_cell, ["cx", "cy"], "left", spread=points.columns)
    names = F.transform(F.filter("candidates", holds), lambda c: c[name])
    return joined.withColumn(name, F.explode_outer(names)).drop("cx", "cy", "candidates")
