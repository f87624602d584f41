"""Density clusters (DBSCAN) of places per key, for groups of any size.

Distances are great-circle.  Places are points of the unit sphere in a grid of cubes, so neither the
180th meridian nor the poles are edges.  Cubes are small enough that all places of one are within eps
of each other.  A cell with at least `min_points` weight is *dense*: its
places are cores of one cluster.  The other cells hold fewer places than `min_points`, so comparing
them with the cells around is linear.  Clusters are the connected components of dense cells and
single cores.  No step pairs the places of a cell with each other.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut
from .joins import salted_join

FILL = 0.57  # cell side / chord of eps; below 1/sqrt(3), so that a cube's diagonal stays below it
PARTS = 8  # a cell is cut into PARTS x PARTS x PARTS pieces when two dense cells are compared
AXES = ("u", "v", "t")
CELL = ["cu", "cv", "ct"]
ROUNDING = 1e-15  # of a coordinate on the unit sphere


def _on_sphere(y: Column, x: Column) -> dict[str, Column]:
    return {"u": F.cos(y) * F.cos(x), "v": F.cos(y) * F.sin(x), "t": F.sin(y)}


def _haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    s, t = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    return s * s + F.cos(lat1) * F.cos(lat2) * t * t


def _cells_around(low: list[Column], high: list[Column], chord: float, side: float) -> Column:
    """Cells that can hold a place within the chord of a box: those in reach of it that the sphere passes through."""
    spans = [F.sequence(F.floor((lo - chord) / side), F.floor((hi + chord) / side)) for lo, hi in zip(low, high)]
    near = lambda c: F.greatest(c * side, -(c + 1) * side, F.lit(0.0))
    far = lambda c: F.greatest(F.abs(c * side), F.abs((c + 1) * side))
    square = lambda f, c: f(c["cu"]) * f(c["cu"]) + f(c["cv"]) * f(c["cv"]) + f(c["ct"]) * f(c["ct"])
    cells = F.flatten(F.transform(spans[0], lambda i: F.flatten(F.transform(spans[1], lambda j: F.transform(
        spans[2], lambda k: F.struct(i.alias("cu"), j.alias("cv"), k.alias("ct"))
    )))))
    return F.filter(cells, lambda c: (square(near, c) <= 1 + 1e-9) & (square(far, c) >= 1 - 1e-9))


def density_clusters(
    places: DataFrame, keys: list[str], eps: float, min_points: int, weight: str = "weight"
) -> DataFrame:
    """Add `cluster` (the lowest core place of the cluster) to the clustered places; noise is left out.

    `places` has distinct (keys, latitude, longitude) in degrees with a weight; eps is in radians.
    A border place joins the neighbouring cluster with the lowest core.
    """
    chord = 2 * math.sin(eps / 2)
    side, limit = FILL * chord, (chord / 2) ** 2
    y, x = F.radians("latitude"), F.radians("longitude")
    points = (
        places.select(*keys, "latitude", "longitude", F.col(weight).alias("w"))
        .withColumns({"y": y, "x": x})
        .withColumns(_on_sphere(F.col("y"), F.col("x")))
        .withColumns({c: F.floor(F.col(a) / side) for c, a in zip(CELL, AXES)})
        .withColumn("place", F.struct("latitude", "longitude"))
    )
    cell = [*keys, *CELL]
    sums = points.groupBy(*cell).agg(F.sum("w").alias("cell_w"), F.min("place").alias("cell_node"))
    points = cut(
        salted_join(points, sums, cell, "inner", spread=["latitude", "longitude"])
        .withColumn("dense", F.col("cell_w") >= min_points).drop("cell_w")
    )

    # places outside dense cells, with every place in reach
    probes = points.filter("NOT dense").select(
        *keys, F.col("place").alias("probe"), F.col("y").alias("py"), F.col("x").alias("px"),
        F.explode(_cells_around([F.col(a) for a in AXES], [F.col(a) for a in AXES], chord, side)).alias("c"),
    ).select(*keys, "probe", "py", "px", "c.*")
    target = F.when(F.col("dense"), F.col("cell_node")).otherwise(F.col("place"))
    # Only dense cells can hold many places, so only what asks for one is repeated by salt.
    solid_points = points.filter("dense")
    asking = probes.join(solid_points.select(*cell).distinct(), cell, "left_semi")
    met = points.filter("NOT dense").join(probes, cell).unionByName(
        salted_join(solid_points, asking, cell, "inner", spread=["latitude", "longitude"])
    )
    near = (
        met.filter(_haversine(F.col("py"), F.col("px"), F.col("y"), F.col("x")) <= limit)
        .groupBy(*keys, "probe", target.alias("other"), "dense").agg(F.sum("w").alias("w"))
    )
    contacts = cut(near)
    cores = (
        contacts.groupBy(*keys, "probe").agg(F.sum("w").alias("reach_w"))
        .filter(F.col("reach_w") >= min_points).select(*keys, "probe")
    )
    single_cores = cores.select(*keys, F.col("probe").alias("node"))
    core_of = cores.select(*keys, F.col("probe").alias("other"), F.lit(True).alias("core"))

    links = contacts.join(cores, [*keys, "probe"]).join(core_of, [*keys, "other"], "left").filter("dense OR core")
    edges = links.select(*keys, F.col("probe").alias("a"), F.col("other").alias("b")).filter("a != b")
    edges = edges.unionByName(_dense_links(points.filter("dense"), keys, chord, side, limit))
    solid = points.filter("dense").select(*keys, F.col("cell_node").alias("node")).distinct()
    labels = components(solid.unionByName(single_cores), edges, keys)

    # members: dense places by their cell, single cores by themselves, border places by a core in reach
    dense = points.filter("dense").select(*keys, "place", "w", F.col("cell_node").alias("node"))
    dense = salted_join(dense, labels, [*keys, "node"], "inner", spread=["place"]).drop("node")
    rest = points.filter("NOT dense").select(*keys, "place", "w")
    own = labels.select(*keys, F.col("node").alias("place"), F.col("cluster").alias("own"))
    by_contact = (
        contacts.join(labels.withColumnRenamed("node", "other"), [*keys, "other"])
        .groupBy(*keys, F.col("probe").alias("place")).agg(F.min("cluster").alias("touched"))
    )
    rest = (
        rest.join(own, [*keys, "place"], "left").join(by_contact, [*keys, "place"], "left")
        .withColumn("cluster", F.coalesce("own", "touched")).filter("cluster IS NOT NULL")
        .drop("own", "touched")
    )
    return dense.unionByName(rest).select(
        *keys, "place.latitude", "place.longitude", F.col("w").alias(weight), "cluster"
    )


def _graded(pairs: DataFrame, chord: float) -> DataFrame:
    """Keep pairs of boxes (u0a .. t1a, u0b .. t1b) that may be in reach; `sure` if they wholly are."""
    zero = F.lit(0.0)
    gap = lambda x: F.greatest(F.col(f"{x}0b") - F.col(f"{x}1a"), F.col(f"{x}0a") - F.col(f"{x}1b"), zero)
    span = lambda x: F.greatest(F.abs(F.col(f"{x}1b") - F.col(f"{x}0a")), F.abs(F.col(f"{x}1a") - F.col(f"{x}0b")))
    # margins far above rounding error keep the quick answers safe
    closest = sum((F.pow(F.greatest(gap(x) - ROUNDING, zero), 2) for x in AXES), zero)
    farthest = sum((F.pow(span(x) + ROUNDING, 2) for x in AXES), zero)
    return pairs.withColumns(
        {"sure": farthest <= chord**2 * (1 - 1e-9), "open": closest <= chord**2 * (1 + 1e-9)}
    ).filter("open").drop("open")


def _boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    ends = [(x, side, pick) for x in AXES for side, pick in ((0, F.min), (1, F.max))]
    return points.groupBy(*keys).agg(*[pick(x).alias(f"{x}{side}") for x, side, pick in ends])


def _side(df: DataFrame, tag: str, shared: list[str]) -> DataFrame:
    """Columns of one side of a pair: suffix a or b, the node becoming the column a or b itself."""
    names = {c: c + tag for c in df.columns if c not in shared}
    return df.withColumnsRenamed({**names, "cell_node": tag})


def _dense_links(points: DataFrame, keys: list[str], chord: float, side: float, limit: float) -> DataFrame:
    """Pairs of dense cells that hold places within eps of each other, as (a, b) of their nodes.

    Cells are compared by the tight boxes of their places: boxes that are surely close link their
    cells, boxes that are surely apart are dropped.  For the cells in between the same is done with
    the boxes of their pieces, and places are compared only where those leave it open too.
    """
    cells = _boxes(points, [*keys, *CELL, "cell_node"])
    low, high = [f"{x}0" for x in AXES], [f"{x}1" for x in AXES]
    around = cells.select(
        *keys, F.col("cell_node").alias("a"), *[F.col(c).alias(c + "a") for c in (*low, *high)],
        F.explode(_cells_around([F.col(c) for c in low], [F.col(c) for c in high], chord, side)).alias("c"),
    ).select("*", "c.*").drop("c")
    pairs = around.join(_side(cells, "b", [*keys, *CELL]), [*keys, *CELL]).filter("a < b")
    graded = cut(_graded(pairs, chord).select(*keys, "a", "b", "sure"))
    sure = graded.filter("sure").select(*keys, "a", "b")
    unsure = graded.filter("NOT sure").select(*keys, "a", "b")
    if unsure.isEmpty():
        return sure

    piece = [f"s{x}" for x in AXES]
    split = points.withColumns({p: F.floor(F.col(x) / (side / PARTS)) for p, x in zip(piece, AXES)})
    pieces = _boxes(split, [*keys, "cell_node", *piece])
    both = unsure.join(_side(pieces, "a", keys), [*keys, "a"]).join(_side(pieces, "b", keys), [*keys, "b"])
    at_a, at_b = [p + "a" for p in piece], [p + "b" for p in piece]
    graded = cut(_graded(both, chord).select(*keys, "a", "b", *at_a, *at_b, "sure"))
    linked = graded.filter("sure").select(*keys, "a", "b").distinct()
    open_pieces = graded.filter("NOT sure").drop("sure").join(linked, [*keys, "a", "b"], "left_anti")
    spots = split.select(*keys, "cell_node", *piece, "y", "x")
    compared = (
        open_pieces.join(_side(spots, "a", keys), [*keys, "a", *at_a])
        .join(_side(spots, "b", keys), [*keys, "b", *at_b])
        .filter(_haversine(F.col("ya"), F.col("xa"), F.col("yb"), F.col("xb")) <= limit)
        .select(*keys, "a", "b").distinct()
    )
    return sure.unionByName(linked).unionByName(compared)


def components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Connected components per key: (keys, node, cluster), cluster being the lowest node.

    Each round takes the lowest label around a node and then follows that label's own label, so long
    chains shrink fast.  Lineage is cut every round; the loop ends when no label changes.
    """
    both = cut(edges.select(*keys, "a", "b").unionByName(
        edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
    ).distinct())
    labels = cut(nodes.withColumn("cluster", F.col("node")))
    if both.isEmpty():
        return labels
    while True:
        lowest = (
            both.join(labels.select(*keys, F.col("node").alias("b"), "cluster"), [*keys, "b"])
            .groupBy(*keys, F.col("a").alias("node")).agg(F.min("cluster").alias("around"))
        )
        moved = labels.join(lowest, [*keys, "node"], "left").select(
            *keys, "node", F.col("cluster").alias("before"),
            F.least("cluster", F.coalesce("around", "cluster")).alias("cluster"),
        )
        roots = moved.select(*keys, F.col("node").alias("cluster"), F.col("cluster").alias("root"))
        jumped = salted_join(moved, roots, [*keys, "cluster"], "left", spread=["node"]).select(
            *keys, "node", F.coalesce("root", "cluster").alias("cluster"),
            (F.coalesce("root", "cluster") != F.col("before")).alias("changed"),
        )
        jumped = cut(jumped)
        labels = jumped.drop("changed")
        if jumped.filter("changed").isEmpty():
            return labels
