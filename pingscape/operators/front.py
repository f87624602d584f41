"""Contact zone between two sides' localities, and the distance of points to it.

The zone of a date is the part of the plane within r km of a locality of each side: the union of the
lenses of all pairs (one locality of each side, at most 2r apart).  It is kept as that list of lenses
and never drawn.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import ZONE_RADIUS_KM
from ..functions.geo import grid_cell, planar, x_km, y_km
from ..sources.tables import date_of_column_name
from .checkpoints import cut
from .joins import first_row, reference_join

SIDES = ("RU", "UA")
CONTESTED = "CONTESTED"
AREA_KM = 50.0


def control_long(wide: DataFrame, prefix: str = "ctr_") -> DataFrame:
    """Wide control status -> (locality, longitude, latitude, day, status); contested counts as RU."""
    dated = [c for c in wide.columns if c.startswith(prefix)]
    rest = [c for c in wide.columns if c not in dated]
    return (
        wide.unpivot(rest, dated, "column", "status")
        .withColumn("day", date_of_column_name(F.col("column")))
        .withColumn("status", F.when(F.col("status") == CONTESTED, SIDES[0]).otherwise(F.col("status")))
        .drop("column")
    )


def near_localities(points: DataFrame, status: DataFrame, keys: list[str], lat0: float, radius: float = ZONE_RADIUS_KM) -> DataFrame:
    """(keys, day, status): the days and sides that have a locality within `radius` km of a point.

    `points` has keys, longitude and latitude, `status` what `control_long` gives.  Being in the union of a side's discs
    is being near one of its localities, so no union is drawn: localities stand in cells of side `radius` as arrays by
    day and side, and a point looks into its own cell and the eight around.
    """
    x, y = x_km(F.col("longitude"), lat0), y_km(F.col("latitude"))
    places = status.filter("status IS NOT NULL").select("day", "status", x.alias("x"), y.alias("y")).distinct()
    cell = {"cx": grid_cell(F.col("x"), radius), "cy": grid_cell(F.col("y"), radius)}
    held = places.withColumns(cell).groupBy("cx", "cy", "day", "status").agg(F.collect_list(F.struct("x", "y")).alias("places"))
    asking = points.select(*keys, x.alias("x"), y.alias("y")).withColumns(cell)
    for c in ("cx", "cy"):
        asking = asking.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    near = F.exists("places", lambda p: planar(F.col("x"), F.col("y"), p["x"], p["y"]) <= radius)
    return reference_join(asking, held, ["cx", "cy"], "inner", spread=keys).filter(near).select(*keys, "day", "status").distinct()


def contact_lenses(status: DataFrame, lat0: float, radius: float = ZONE_RADIUS_KM) -> DataFrame:
    """Pairs of localities of both sides within 2r: (day, ax, ay, bx, by) in km.

    Equal coordinates are taken once, as they give the same lens.  Localities meet through a grid of
    cells of side 2r: each looks into its own cell and the eight around.
    """
    places = status.select(
        "day", "status", x_km(F.col("longitude"), lat0).alias("x"), y_km(F.col("latitude")).alias("y")
    ).distinct()
    size = 2 * radius
    celled = places.withColumns({"cx": grid_cell(F.col("x"), size), "cy": grid_cell(F.col("y"), size)})
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    a = celled.filter(F.col("status") == SIDES[0]).select(
        "day", F.col("x").alias("ax"), F.col("y").alias("ay"), around("cx").alias("cx"), "cy"
    ).withColumn("cy", around("cy"))
    b = celled.filter(F.col("status") == SIDES[1]).select(
        "day", F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy"
    )
    apart = planar(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return a.join(b, ["day", "cx", "cy"]).filter(apart <= 2 * radius).select("day", "ax", "ay", "bx", "by")


def lens_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column,
                  radius: float = ZONE_RADIUS_KM) -> Column:
    """Distance from a point to the common part of two discs of equal radius.

    0 inside both; the distance to one disc if the nearest point of that disc lies in the other;
    else the distance to the nearer of the two corners.
    """
    r = F.lit(float(radius))
    da, db = planar(x, y, ax, ay), planar(x, y, bx, by)
    # nearest points on the circles around a and b
    pax, pay = ax + (x - ax) * F.try_divide(r, da), ay + (y - ay) * F.try_divide(r, da)
    pbx, pby = bx + (x - bx) * F.try_divide(r, db), by + (y - by) * F.try_divide(r, db)
    gap = planar(ax, ay, bx, by)
    mx, my = (ax + bx) / 2, (ay + by) / 2
    h = F.sqrt(F.greatest(r * r - gap * gap / 4, F.lit(0.0)))
    ux, uy = -F.try_divide(by - ay, gap), F.try_divide(bx - ax, gap)
    corner = F.least(planar(x, y, mx + h * ux, my + h * uy), planar(x, y, mx - h * ux, my - h * uy))
    return (
        F.when((da <= r) & (db <= r), 0.0)
        .when((da > r) & (planar(pax, pay, bx, by) <= r), da - r)
        .when((db > r) & (planar(pbx, pby, ax, ay) <= r), db - r)
        .otherwise(corner)
    )


#: Squares of the grid are also looked at in squares of twice, four times, ... their side; the last covers the earth.
LEVELS = 11


def front_distance(
    points: DataFrame, lenses: DataFrame, keys: list[str], lat0: float, radius: float = ZONE_RADIUS_KM,
    area: float = AREA_KM,
) -> DataFrame:
    """(keys, distance_to_front in km) to the zone of the point's day; points: keys, day, lon, lat, one row per key.

    Points are put into squares.  A day's square carries the lenses that can be nearest to one of its points as an
    array, so a point meets its square once and takes the least distance in an expression.  A point of a day without
    lenses gives no row.  The distances are stored: they cost much for few bytes, so points are dealt to all shuffle
    partitions and whoever reads the result several times does not work them out again.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    px = x_km(F.col("longitude_center"), lat0)
    py = y_km(F.col("latitude_center"))
    # points are read for their squares and for their distances, so they are stored once
    placed = cut(points.select(*keys, "day", px.alias("x"), py.alias("y")).withColumns(
        {"area_x": grid_cell(F.col("x"), area), "area_y": grid_cell(F.col("y"), area)}
    ))
    near = _area_lenses(placed.select(*SQUARE).distinct(), _tiles(lenses, area), area, radius)
    joined = reference_join(placed.repartition(parts, *keys), near, SQUARE, "inner", spread=keys)
    distance = lambda n: lens_distance(F.col("x"), F.col("y"), n["ax"], n["ay"], n["bx"], n["by"], radius)
    return cut(joined.select(*keys, F.array_min(F.transform("lenses", distance)).alias("distance_to_front")))


SQUARE = ["day", "area_x", "area_y"]
TILE = ["day", "tile_x", "tile_y"]


def _tiles(lenses: DataFrame, area: float) -> DataFrame:
    """Lenses by the square of the grid that holds their middle: (day, tile_x, tile_y, lenses); stored, as it is read twice."""
    tile = {"tile_x": grid_cell((F.col("ax") + F.col("bx")) / 2, area), "tile_y": grid_cell((F.col("ay") + F.col("by")) / 2, area)}
    return cut(lenses.withColumns(tile).groupBy(*TILE).agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("lenses")))


def _over(c: str | Column, level: Column) -> Column:
    """The square of a level that holds a square of the grid."""
    return F.floor(F.col(c) / F.pow(F.lit(2.0), level) if isinstance(c, str) else c / F.pow(F.lit(2.0), level)).cast("long")


def _around(squares: DataFrame) -> DataFrame:
    """Squares with the nine squares of their `level` around them as (level, sx, sy)."""
    for name, c in (("sx", "area_x"), ("sy", "area_y")):
        at = _over(c, F.col("level"))
        squares = squares.withColumn(name, F.explode(F.sequence(at - 1, at + 1)))
    return squares


def _area_lenses(areas: DataFrame, tiles: DataFrame, area: float, radius: float) -> DataFrame:
    """(day, area_x, area_y, lenses): the lenses that can be nearest to some point of a square.

    First a bound on the distance of a square's farthest point to its nearest lens: of all levels, the nearest occupied
    squares among the nine around.  Then the tiles that can hold a lens within the bound: those in the nine squares of the
    level at which they reach as far as the bound.  Tiles and squares meet by equal squares of a level, whatever the
    number of either; a square takes 9 rows per level.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))
    in_level = tiles.select(*TILE, levels.alias("level")).select(
        *TILE, "level", _over("tile_x", F.col("level")).alias("sx"), _over("tile_y", F.col("level")).alias("sy")
    )
    occupied = in_level.select("day", "level", "sx", "sy").distinct()
    meet = ["day", "level", "sx", "sy"]
    side = F.pow(F.lit(2.0), F.col("level"))

    def far(c: str, s: str) -> Column:  # greatest distance along an axis between points of both squares, in squares
        return F.greatest(F.abs((F.col(s) + 1) * side - F.col(c)), F.abs(F.col(c) + 1 - F.col(s) * side))

    # a lens lies within r of its middle, so within r of its tile
    most = area * F.sqrt(F.pow(far("area_x", "sx"), 2) + F.pow(far("area_y", "sy"), 2)) + radius
    bound = (
        _around(areas.withColumn("level", levels)).join(occupied, meet).groupBy(*SQUARE).agg(F.min(most).alias("bound"))
    )
    reach = F.greatest(F.ceil(F.log2((F.col("bound") + radius) / area)), F.lit(0)).cast("int")
    open_tiles = _around(bound.withColumn("level", reach)).join(in_level, meet).select(*SQUARE, "bound", "tile_x", "tile_y")
    dx, dy = F.abs(F.col("area_x") - F.col("tile_x")), F.abs(F.col("area_y") - F.col("tile_y"))
    zero = F.lit(0).cast("long")
    least = area * F.sqrt(F.pow(F.greatest(dx - 1, zero), 2) + F.pow(F.greatest(dy - 1, zero), 2)) - radius
    most = area * F.sqrt(F.pow(dx + 1, 2) + F.pow(dy + 1, 2)) + radius
    tile = F.struct("tile_x", "tile_y", least.alias("least"), most.alias("most"))
    near = open_tiles.filter(least <= F.col("bound")).groupBy(*SQUARE).agg(F.collect_list(tile).alias("near"))
    closest = F.array_min(F.transform("near", lambda t: t["most"]))
    near = near.withColumn("closest", closest).select(*SQUARE, F.explode(F.filter("near", lambda t: t["least"] <= F.col("closest"))).alias("t"))
    near = near.select(*SQUARE, "t.tile_x", "t.tile_y").join(tiles, TILE)
    # the same comparison, lens by lens: distance from the lens middle to the square's nearest and farthest point
    x0, y0 = F.col("area_x") * area, F.col("area_y") * area

    def reaches(n: Column) -> tuple[Column, Column]:
        out = lambda v, lo: F.greatest(lo - v, v - (lo + area), F.lit(0.0))
        far = lambda v, lo: F.greatest(F.abs(v - lo), F.abs(v - (lo + area)))
        mx, my = (n["ax"] + n["bx"]) / 2, (n["ay"] + n["by"]) / 2
        return F.hypot(out(mx, x0), out(my, y0)) - radius, F.hypot(far(mx, x0), far(my, y0))

    gathered = near.groupBy(*SQUARE).agg(F.flatten(F.collect_list("lenses")).alias("lenses"))
    closest = F.array_min(F.transform("lenses", lambda n: reaches(n)[1]))
    kept = F.filter("lenses", lambda n: reaches(n)[0] <= F.col("closest"))
    return gathered.withColumn("closest", closest).select(*SQUARE, kept.alias("lenses"))


def one_front_per_day(front: DataFrame) -> DataFrame:
    """One geometry per date (the first by text)."""
    return first_row(front, ["date"], [F.col("geometry")]).withColumnRenamed("date", "day")
