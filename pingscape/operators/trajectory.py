"""Stays of a device: density of pings along its path.

A ping is a core if the pings within `window` positions and `distance` metres of it, with itself,
span at least `seconds`.  Cores whose spans touch form a stay; its members are the neighbours of its
cores.  The path is cut into blocks of positions with overlapping edges, so a device may have any
number of pings.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed_values import STAY_DISTANCE_M, STAY_SECONDS, STAY_WINDOW
from ..functions.geo import unit_vector, within_arc
from .checkpoints import cut
from .ordered import CHUNK, hour_chunk, merge_in_sequence, with_halo, with_position
from .panel import PING_ORDER

BLOCK = 8192


def numbered_pings(pings: DataFrame) -> DataFrame:
    """Pings with their position in the device's path and its last position."""
    chunk = hour_chunk(F.col("utc_timestamp"))
    numbered = with_position(
        pings.select("caid", "latitude", "longitude", "utc_timestamp"), ["caid"], PING_ORDER, chunk
    )
    return numbered.drop(CHUNK)


def neighbours(
    numbered: DataFrame, window: int = STAY_WINDOW, distance: float = STAY_DISTANCE_M, halo: int | None = None,
    block_size: int = BLOCK,
) -> DataFrame:
    """Add `near`: (pos, t) of the other pings within `window` positions and `distance` metres.

    Rows are repeated in neighbouring blocks (`inner` marks the home copy); arrays of copies that
    lie less than `window` inside a block may be cut and are only used by their home copy.
    """
    blocks = with_halo(numbered, "pos", block_size, halo or window).withColumn(
        "p", unit_vector(F.col("latitude"), F.col("longitude"))
    )
    around = W.partitionBy("caid", "block").orderBy("pos").rowsBetween(-window, window)
    point = F.struct("pos", "p", F.col("utc_timestamp").alias("t"))

    def close(q: Column) -> Column:
        return (q["pos"] != F.col("pos")) & within_arc(F.col("p"), q["p"], distance)

    return (
        blocks.withColumn("around", F.collect_list(point).over(around))
        .withColumn(
            "near",
            F.transform(F.filter("around", close), lambda q: F.struct(q["pos"].alias("pos"), q["t"].alias("t"))),
        )
        .drop("around", "p")
    )


def core_pings(
    numbered: DataFrame, window: int = STAY_WINDOW, distance: float = STAY_DISTANCE_M,
    seconds: float = STAY_SECONDS, block_size: int = BLOCK,
) -> DataFrame:
    """Neighbours plus span_start, span_end and is_core.

    The last `window` pings of a device never become cores, so `window` or fewer pings give none.
    """
    last = W.partitionBy("caid", "block").orderBy("pos").rowsBetween(window, window)
    near = neighbours(numbered, window, distance, halo=2 * window, block_size=block_size)
    t = F.col("utc_timestamp")
    spans = near.withColumns(
        {
            "span_start": F.least(t, F.array_min(F.transform("near", lambda q: q["t"]))),
            "span_end": F.greatest(t, F.array_max(F.transform("near", lambda q: q["t"]))),
            "has_follower": F.max("pos").over(last).isNotNull(),
        }
    )
    long_enough = F.col("span_end") - F.col("span_start") >= seconds
    return spans.withColumn("is_core", F.col("has_follower") & long_enough).drop("has_follower")


def stays(
    pings: DataFrame, window: int = STAY_WINDOW, distance: float = STAY_DISTANCE_M,
    seconds: float = STAY_SECONDS, block_size: int = BLOCK,
) -> DataFrame:
    """Pings -> stays: caid, latitude, longitude, utc_timestamp_start, stay_length_sec."""
    members = stay_members(pings, window, distance, seconds, block_size)
    start, end = F.min("utc_timestamp"), F.max("utc_timestamp")
    return members.groupBy("caid", "group_no").agg(
        F.avg("latitude").alias("latitude"),
        F.avg("longitude").alias("longitude"),
        start.cast("long").alias("utc_timestamp_start"),
        (end - start).cast("int").alias("stay_length_sec"),
    ).drop("group_no")


def stay_members(
    pings: DataFrame, window: int = STAY_WINDOW, distance: float = STAY_DISTANCE_M,
    seconds: float = STAY_SECONDS, block_size: int = BLOCK,
) -> DataFrame:
    """(caid, group_no, ping) for every ping that is a neighbour of a core of the stay."""
    cores = core_pings(numbered_pings(pings), window, distance, seconds, block_size)
    # core neighbours of each ping; neighbourhood is mutual, so they are in the ping's own array
    around = W.partitionBy("caid", "block").orderBy("pos").rowsBetween(-window, window)
    own = F.transform("near", lambda q: q["pos"])
    # stored once: the stays are found from it and their members are then looked up in it
    linked = cut(
        cores.withColumn("core_pos", F.collect_list(F.when(F.col("is_core"), F.col("pos"))).over(around))
        .filter("inner")
        .withColumn("core_pos", F.array_intersect("core_pos", own))
        .filter("is_core OR size(core_pos) > 0")
        .drop("near")
    )
    return _with_groups(linked, stay_groups(linked), window, block_size)


def _with_groups(linked: DataFrame, groups: DataFrame, window: int, block_size: int) -> DataFrame:
    """(caid, block, pos, ..., group_no) of the pings near cores, one row per stay that one of these cores belongs to.

    The stay of a core is the last one that begins at or before it.  Beginnings go into the blocks of positions as rows
    of their own, with one row per block for the last beginning before it, so a running maximum numbers the cores and a
    window around a ping collects the numbers of its cores; pings and stays are not joined.
    """
    columns = ["latitude", "longitude", "utc_timestamp", "core_pos", "is_core"]
    rows = with_halo(linked.select("caid", "pos", *columns), "pos", block_size, window)
    begins = groups.select("caid", F.col("first_pos").alias("pos"), "group_no")
    heads = with_halo(begins, "pos", block_size, window).drop("inner").withColumn("own", F.lit(1))
    # the first block whose halo lies behind a beginning, and all later ones, know it from their carry row
    past = F.floor((F.col("pos") + window) / block_size).cast("long") + 1
    known = begins.groupBy("caid", past.alias("block")).agg(F.max("group_no").alias("group_no"))
    blocks = rows.select("caid", "block").distinct().withColumns({"group_no": F.lit(None).cast("long"), "asks": F.lit(1)})
    upto = W.partitionBy("caid").orderBy("block").rangeBetween(W.unboundedPreceding, 0)
    carry = (
        blocks.unionByName(known.withColumns({"asks": F.lit(0), "group_no": F.col("group_no").cast("long")}))
        .withColumn("group_no", F.max("group_no").over(upto))
        .filter("asks = 1 AND group_no IS NOT NULL")
        .select("caid", "block", "group_no", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("own"))
    )
    both = rows.withColumn("own", F.lit(2)).unionByName(heads, allowMissingColumns=True).unionByName(carry, allowMissingColumns=True)
    so_far = W.partitionBy("caid", "block").orderBy("pos", "own").rowsBetween(W.unboundedPreceding, 0)
    around = W.partitionBy("caid", "block").orderBy("pos").rangeBetween(-window, window)
    core = F.when(F.col("own") == 2, F.when(F.col("is_core"), F.struct("pos", F.col("so_far").alias("group_no"))))
    found = both.withColumn("so_far", F.max("group_no").over(so_far)).withColumn("cores", F.collect_list(core).over(around))
    near = F.filter("cores", lambda c: F.array_contains("core_pos", c["pos"]))
    mine = found.filter("own = 2 AND inner AND size(core_pos) > 0")
    return mine.select(
        "caid", "block", "pos", "latitude", "longitude", "utc_timestamp",
        F.explode(F.array_distinct(F.transform(near, lambda c: c["group_no"]))).alias("group_no"),
    )


def stay_groups(cores: DataFrame) -> DataFrame:
    """Core pings -> (caid, group_no, first_pos, last_pos): cores of one stay are a run of positions."""
    return merge_in_sequence(
        cores.filter("inner AND is_core"), ["caid"], "block", "pos", "span_start", "span_end"
    )
