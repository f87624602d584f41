"""Steps that many queries share."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import local_time
from ..operators import events, homes, panel
from ..sources.tables import select_pings
from . import views as V

COUNTRY = "UA"


def r(column: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison between engines."""
    return F.round(column, digits)


def text(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def pings(spark, sf) -> DataFrame:
    return select_pings(V.raw_pings(spark, sf), COUNTRY)


def local_alerts(spark, sf, view=V.alerts) -> DataFrame:
    return view(spark, sf).select(
        "region_english",
        local_time(F.col("start_s"), V.ZONE).alias("start_dt"),
        local_time(F.col("end_s"), V.ZONE).alias("end_dt"),
    )


def speeds(spark, sf) -> DataFrame:
    return panel.with_speed(pings(spark, sf))


def minutes(spark, sf) -> DataFrame:
    return panel.minute_means(panel.drop_jumps(speeds(spark, sf)), V.ZONE)


def minute_panel(spark, sf) -> DataFrame:
    return panel.minute_panel(pings(spark, sf), V.regions(spark, sf), local_alerts(spark, sf), V.ZONE)


def city_panel(spark, sf, ping_view=V.raw_pings, alert_view=V.alerts) -> DataFrame:
    moved = select_pings(ping_view(spark, sf), COUNTRY)
    minutes_of = panel.minute_panel(moved, V.regions(spark, sf), local_alerts(spark, sf, alert_view), V.ZONE)
    return panel.with_city(minutes_of, V.cities(spark, sf))


def event_panel(spark, sf, hours: float = 0.5, extend: bool = False, ping_view=V.raw_pings, alert_view=V.alerts) -> DataFrame:
    return events.event_panel(city_panel(spark, sf, ping_view, alert_view), local_alerts(spark, sf, alert_view), hours, extend)


def study_homes(spark, sf) -> DataFrame:
    """Homes of the month of the events, from the dwells of that month."""
    return homes.home_locations(V.study_dwells(spark, sf), *V.STUDY_SPAN)


def night_windows(spark, sf) -> DataFrame:
    stays = homes.overnight_stays(V.dwells(spark, sf), *V.HOME_SPAN)
    return homes.home_windows(stays, *V.HOME_SPAN)


def home_table(spark, sf) -> DataFrame:
    return homes.home_locations(V.dwells(spark, sf), *V.HOME_SPAN)


def event_keys() -> list[Column]:
    return [text("start_raid_next").alias("start_raid_next"), F.col("region_english")]
