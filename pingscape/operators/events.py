"""Event panel: minutes around the next alert of a device, and the samples drawn from it.

A panel has at most one row per device, minute and city, so a device's group is bounded by the
number of minutes in the period; windows on the device are therefore safe here.  Events can be hot
(a capital's alert), so nothing below puts an event into one task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clock import conflict_period, minute_of, seconds_between
from ..functions.fixed_values import (
    ANCHOR_SECONDS,
    BASE_CELL,
    EXCLUDED_NAMES,
    FIRST_CELL_S,
    MAX_DAY_DISTANCE_M,
    MIN_EVENT_ROWS,
    MIN_HOME_DISTANCE_M,
    MIN_MOVING_KMH,
    MIN_SPREAD_KM,
)
from ..functions.geo import chord_m
from .checkpoints import cut
from .joins import first_row, reference_join, salted_join

EVENT = ["start_raid_next", "region_english"]


def event_id(start: str | Column = "start_raid_next", region: str | Column = "region_english") -> Column:
    """Text id of an event: 19 characters of start time, then the region."""
    return F.concat(F.date_format(start, "yyyy-MM-dd HH:mm:ss"), region)


def plausible_days(panel: DataFrame, max_distance: float = MAX_DAY_DISTANCE_M) -> DataFrame:
    """Keep device-days that moved, but less than max_distance; an unknown distance is kept."""
    total = F.sum("distance_sum").over(W.partitionBy("caid", "day"))
    return (
        panel.withColumn("day_distance", total)
        .filter(F.coalesce((F.col("day_distance") > 0) & (F.col("day_distance") < max_distance), F.lit(True)))
        .drop("day_distance")
    )


def next_alert(panel: DataFrame) -> DataFrame:
    """Carry the next alert start (this minute or later) back to every minute of the device."""
    later = W.partitionBy("caid").orderBy(F.desc("minute"))
    start = minute_of(F.col("start_raid_min"))
    return (
        panel.filter("region_english IS NOT NULL")
        .withColumn("start_raid_min", start)
        .withColumn("start_raid_next", F.last("start_raid_min", ignorenulls=True).over(later))
        .withColumn("time_to_raid", seconds_between(F.col("minute"), F.col("start_raid_next")))
        .filter("time_to_raid IS NOT NULL")
    )


def long_alerts(alerts: DataFrame, hours: float) -> DataFrame:
    """Events (region, start minute) of the alerts longer than `hours`."""
    minutes = seconds_between(F.col("end_dt"), F.col("start_dt")) / 60
    return alerts.filter(minutes > 60 * hours).select(
        "region_english", minute_of(F.col("start_dt")).alias("start_raid_next")
    ).distinct()


def with_anchor(events: DataFrame) -> DataFrame:
    """Distance from the last position in the 24 hours before the alert (null without one)."""
    ok = (F.col("time_to_raid").between(-ANCHOR_SECONDS, -0.1)) & (F.col("latitude_center") != 0)
    device_event = W.partitionBy("caid", *EVENT)
    position = F.struct("latitude_center", "longitude_center")
    key = F.struct("time_to_raid", "latitude_center", "longitude_center")
    anchored = events.withColumn(
        "pre", F.max_by(F.when(ok, position), F.when(ok, key)).over(device_event)
    )
    moved = (F.col("latitude_center") != 0) & (F.col("pre.latitude_center") != 0)
    return anchored.withColumn(
        "distance_point",
        F.when(
            moved,
            chord_m(
                F.col("latitude_center"), F.col("longitude_center"),
                F.col("pre.latitude_center"), F.col("pre.longitude_center"),
            ),
        ),
    ).drop("pre")


def event_window(events: DataFrame, hours: float) -> DataFrame:
    reach = 3600 * hours
    return events.filter(F.col("time_to_raid").between(-reach, reach))


def balanced_events(events: DataFrame, hours: float) -> DataFrame:
    """Keep events in which every minute of the window is seen for some device.

    The rows are stored once: minutes are counted from them and the complete events selected.
    """
    stored = cut(events)
    minutes = stored.groupBy(*EVENT).agg(F.countDistinct("minute").alias("minute_count"))
    full = minutes.filter(F.col("minute_count") == 120 * hours + 1)
    return reference_join(stored, full, EVENT, "inner", spread=["caid"])


def with_cell(events: DataFrame, first: int = FIRST_CELL_S, base: int = BASE_CELL) -> DataFrame:
    """Event-time cell: the second from `first` on, one base cell before it."""
    return events.withColumn(
        "time_to_raid_post", F.when(F.col("time_to_raid") >= first, F.col("time_to_raid")).otherwise(base)
    )


def event_panel(panel: DataFrame, alerts: DataFrame, hours: float = 0.5, extend: bool = False) -> DataFrame:
    """The whole preparation; all windows of a device share the one shuffle made here."""
    events = next_alert(plausible_days(panel.repartition("caid")))
    if extend:
        events = reference_join(events, long_alerts(alerts, hours), EVENT, "left_semi", spread=["caid"])
    return with_cell(balanced_events(event_window(with_anchor(events), hours), hours))


def dummy_columns(events: DataFrame, cells: list[int], prefix: str = "e_TYPE_") -> DataFrame:
    """Wide 0/1 columns for a known, sorted list of cells (the base cell gets none)."""
    return events.withColumns(
        {f"{prefix}{c}": (F.col("time_to_raid_post") == c).cast("int") for c in cells if c != BASE_CELL}
    )


def interaction_columns(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    return df.withColumns({f"({c} * {by})": F.col(c) * F.col(by) for c in columns})


def with_period(events: DataFrame) -> DataFrame:
    """Month, period of the conflict and the number of periods a device is seen in."""
    dated = events.withColumn("month", F.month("day")).withColumn("period", conflict_period(F.col("month")))
    seen = dated.groupBy("caid").agg(F.countDistinct("period").alias("count"))
    return salted_join(dated, seen, ["caid"], "left", spread=["day"], salts=4)


def consistent_sample(events: DataFrame, periods: int = 3) -> DataFrame:
    return events.filter(F.col("count") == periods)


def home_distances(events: DataFrame, homes: DataFrame) -> DataFrame:
    """Distance to the device's home of the month, and its minimum per device and event."""
    by_month = homes.select(
        "caid",
        F.month(F.date_add(F.to_date("start_date"), 5)).alias("month"),
        F.col("latitude").alias("latitude_home"),
        F.col("longitude").alias("longitude_home"),
    )
    near = events.withColumn("month", F.month("start_raid_next")).join(by_month, ["month", "caid"])
    distance = chord_m(
        F.col("latitude_center"), F.col("longitude_center"), F.col("latitude_home"), F.col("longitude_home")
    )
    return near.withColumn("distance_home", distance).withColumn(
        "distance_home_min", F.min("distance_home").over(W.partitionBy("caid", *EVENT))
    )


def away_from_home(events: DataFrame, homes: DataFrame, metres: float = MIN_HOME_DISTANCE_M) -> DataFrame:
    return home_distances(events, homes).filter(F.col("distance_home_min") > metres)


def on_the_move(events: DataFrame, kmh: float = MIN_MOVING_KMH) -> DataFrame:
    slowest = F.min("kmh_avg").over(W.partitionBy("caid", *EVENT))
    return events.withColumn("kmh_avg_min", slowest).filter(F.col("kmh_avg_min") > kmh)


def exclude_names(events: DataFrame, names: list[str] = EXCLUDED_NAMES, column: str = "region_english") -> DataFrame:
    for name in names:
        events = events.filter(~F.col(column).contains(name))
    return events


def wide_spread_events(events: DataFrame, value: str, minimum: float = MIN_SPREAD_KM) -> DataFrame:
    """Keep events whose values differ by at least `minimum`."""
    kept = (
        events.groupBy(*EVENT).agg((F.max(value) - F.min(value)).alias("spread"))
        .filter(F.col("spread") >= minimum).drop("spread")
    )
    return reference_join(events, kept, EVENT, "left_semi", spread=["caid"])


def large_events(events: DataFrame, minimum: int = MIN_EVENT_ROWS) -> DataFrame:
    kept = events.groupBy(*EVENT).agg(F.count("caid").alias("obs")).filter(F.col("obs") >= minimum).drop("obs")
    return reference_join(events, kept, EVENT, "left_semi", spread=["caid"])


def approx_median_flag(events: DataFrame, value: str, out: str, accuracy: int = 10000) -> DataFrame:
    """1 where the value reaches its event's approximate median (a sketch of bounded size per event)."""
    medians = events.groupBy(*EVENT).agg(F.percentile_approx(value, 0.5, accuracy).alias("median"))
    return reference_join(events, medians, EVENT, "left", spread=["caid"]).withColumn(
        out, (F.col(value) >= F.col("median")).cast("int")
    ).drop("median")


def with_front_distance(events: DataFrame, distances: DataFrame) -> DataFrame:
    """Join the distance per device and event, add its log, the median flag and the post terms."""
    joined = events.join(distances, ["caid", *EVENT]).withColumn(
        "distance_to_front_log", F.log1p("distance_to_front")
    )
    flagged = approx_median_flag(joined, "distance_to_front", "distance_med")
    return flagged.withColumn("post", (F.col("time_to_raid") >= 0).cast("int")).withColumn(
        "post_inter", F.col("post") * F.col("distance_to_front_log")
    )


def front_sample(events: DataFrame, names: list[str] = EXCLUDED_NAMES, spread: float = MIN_SPREAD_KM,
                 rows: int = MIN_EVENT_ROWS) -> DataFrame:
    """Events outside the named regions, with enough spread of distance and enough rows.

    Both rules drop whole events, so one pass over the rows decides them together.
    """
    d = F.col("distance_to_front")
    named = exclude_names(events, names)
    kept = named.groupBy(*EVENT).agg((F.max(d) - F.min(d)).alias("spread"), F.count("caid").alias("obs"))
    kept = kept.filter((F.col("spread") >= spread) & (F.col("obs") >= rows)).select(*EVENT)
    return reference_join(named, kept, EVENT, "left_semi", spread=["caid"])


def event_positions(events: DataFrame) -> DataFrame:
    """One position per device and event: its earliest minute."""
    columns = ["caid", *EVENT, "day", "minute", "longitude_center", "latitude_center"]
    return first_row(
        events.select(*columns), ["caid", *EVENT],
        [F.col("minute"), F.col("latitude_center"), F.col("longitude_center")],
    )
