"""Population, country and download tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed_values import NO_SYSTEM_LABEL, NOT_A_COUNTRY, SYSTEM_LABEL
from ..functions.geo import grid_cell
from .joins import reference_join
from .polygons import CELL, polygon_edges


def _column_index(polygons: DataFrame, name: str, margin: float, wkt: str, cell: float) -> DataFrame:
    """(cx, cy, name, edges): for a grid cell, the edges above it or in it, with a margin around."""
    span = lambda lo, hi: F.sequence(grid_cell(lo - margin, cell), grid_cell(hi + margin, cell))
    columns = polygon_edges(polygons, name, wkt, oriented=True).filter("x1 != x2").withColumn(
        "cx", F.explode(span(F.least("x1", "x2"), F.greatest("x1", "x2")))
    )
    first_cy = F.min(grid_cell(F.least("y1", "y2") - margin, cell)).over(W.partitionBy(name, "cx"))
    return (
        columns.withColumn("first_cy", first_cy)
        .withColumn("cy", F.explode(F.sequence("first_cy", grid_cell(F.greatest("y1", "y2") + margin, cell))))
        .groupBy("cx", "cy", name)
        .agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    )


def overlap_area(edges: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area shared by a polygon and the rectangle [x0, x1] x [y0, y1].

    Adds, edge by edge, the signed area below the edge inside the rectangle; shells and holes must
    run in opposite directions, see `polygons.oriented_rings`.
    """
    height = y1 - y0

    def filled(z: Column) -> Column:  # integral of min(max(z, 0), height)
        return F.when(z <= 0, 0.0).when(z <= height, z * z / 2).otherwise(
            height * height / 2 + height * (z - height)
        )

    def below(e: Column) -> Column:
        left = F.greatest(F.least(e["x1"], e["x2"]), x0)
        right = F.least(F.greatest(e["x1"], e["x2"]), x1)
        slope = (e["y2"] - e["y1"]) / (e["x2"] - e["x1"])
        za, zb = e["y1"] + slope * (left - e["x1"]) - y0, e["y1"] + slope * (right - e["x1"]) - y0
        flat = F.least(F.greatest(za, F.lit(0.0)), height)
        mean = F.when(F.abs(zb - za) < 1e-12, flat).otherwise(F.try_divide(filled(zb) - filled(za), zb - za))
        return F.when(right > left, (right - left) * mean * F.signum(e["x2"] - e["x1"])).otherwise(0.0)

    return F.abs(F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + below(e)))


def largest_overlap(
    cells: DataFrame, polygons: DataFrame, name: str, size: float, key: str = "wp_index", x: str = "x",
    y: str = "y", wkt: str = "geometry", grid: float = CELL,
) -> DataFrame:
    """Attach to each square cell (lower left x, y and side `size`) the unit it overlaps most.

    Cells that touch no unit are left out; of equal overlaps the first unit by name is kept.
    """
    index = _column_index(polygons, name, size, wkt, grid)
    keyed = cells.withColumns(
        {"cx": grid_cell(F.col(x) + size / 2, grid), "cy": grid_cell(F.col(y) + size / 2, grid)}
    )
    joined = reference_join(keyed, index, ["cx", "cy"], "inner", spread=[key])
    area = overlap_area(F.col("edges"), F.col(x), F.col(y), F.col(x) + size, F.col(y) + size)
    rest = [c for c in cells.columns if c != key]
    best = (
        joined.withColumn("area", area).filter(F.col("area") > 0)
        .groupBy(key).agg(F.min_by(F.struct(*rest, name, "area"), F.struct(-F.col("area"), F.col(name))).alias("b"))
    )
    return best.select(key, "b.*")


def unit_population(cells: DataFrame, unit: str, value: str = "raster_val") -> DataFrame:
    """Population per unit; negative cells count as zero."""
    return cells.groupBy(unit).agg(F.sum(F.greatest(F.col(value), F.lit(0.0))).alias("population"))


def devices_and_population(homes: DataFrame, unit: str, population: DataFrame, scale: float = 1e6) -> DataFrame:
    """Devices living in each unit next to its population, both in millions.

    `homes` carry the unit; units without population keep a null.
    """
    counts = homes.filter(F.col(unit).isNotNull()).groupBy(unit).agg(F.count("caid").alias("devices"))
    return counts.join(population, unit, "left").select(
        unit, (F.col("devices") / scale).alias("devices"), (F.col("population") / scale).alias("population")
    )


def roll_up(units: DataFrame, parents: DataFrame, unit: str, parent: str) -> DataFrame:
    return reference_join(units, parents, [unit], "inner").groupBy(parent).agg(
        F.sum("devices").alias("devices"), F.sum("population").alias("population")
    )


def alert_systems(world: DataFrame, systems: DataFrame) -> DataFrame:
    """Populated countries with their alert systems (0 where unknown) and a yes/no label."""
    known = world.filter((F.col("pop_est") > 0) & (F.col("name") != NOT_A_COUNTRY))
    joined = known.join(systems, F.col("name") == F.col("country"), "left")
    filled = joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("cell_broadcast", "sirens")}
    )
    best = F.greatest("sirens", "cell_broadcast")
    return filled.withColumn("any_system", F.when(best > 0, SYSTEM_LABEL).otherwise(NO_SYSTEM_LABEL))


def install_series(installs: DataFrame, day: str, count: str, before: str = "2022-10-01") -> DataFrame:
    """Installs in millions from text, missing ones dropped, days before a date."""
    millions = F.try_divide(F.col(count).try_cast("double"), F.lit(1e6))
    return (
        installs.withColumn(count, millions).filter(F.col(count).isNotNull())
        .withColumn(day, F.to_date(day)).filter(F.col(day) < F.lit(before).cast("date"))
    )
