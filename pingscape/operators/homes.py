"""Home places: overnight stays in sliding windows, clustered per device."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import local_time, midnights_crossed
from ..functions.fixed_values import (
    HOME_EPS_KM,
    HOME_HALF_DAYS,
    HOME_MIN_POINTS,
    HOME_RADIUS_KM,
    HOME_STEP_DAYS,
    HOME_ZONE,
    MAX_HOMES_PER_SPOT,
    MIN_NIGHT_STAY_S,
    MIN_NIGHTS,
)
from .clusters import density_clusters
from .joins import salted_join


def clean_zone(zone: Column) -> Column:
    """Zone name without the list brackets and quotes around it."""
    return F.regexp_replace(zone, r"[\[\]']", "")


def overnight_stays(
    dwells: DataFrame, start: str, end: str, zone: str | Column = HOME_ZONE, min_seconds: int = MIN_NIGHT_STAY_S
) -> DataFrame:
    """Long stays that cross a local midnight, with the number of midnights.

    The local start lies between the two dates; the end date counts up to its first second.
    """
    begin = local_time(F.col("utc_timestamp_start"), zone)
    finish = local_time(F.col("utc_timestamp_start") + F.col("stay_length_sec"), zone)
    return (
        dwells.filter(F.col("stay_length_sec") > min_seconds)
        .withColumns({"date": begin, "num_days": midnights_crossed(begin, finish)})
        .filter(F.col("date").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
        .filter(F.col("num_days") != 0)
        .select("caid", "latitude", "longitude", "date", F.greatest("num_days", F.lit(1)).alias("num_days"))
    )


def home_windows(
    stays: DataFrame, start: str, end: str, step: int = HOME_STEP_DAYS, half: int = HOME_HALF_DAYS
) -> DataFrame:
    """One row per window a stay falls into; `start_date` is the window's centre.

    Centres lie `step` days apart from the day after `start` on and before `end`; both ends of
    centre +- `half` days count.  Computed per row, so the number of windows adds no jobs.
    """
    first = F.date_add(F.lit(start).cast("date"), 1)
    days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date"))
    last_no = F.floor((days - 2) / step)
    offset = (F.unix_timestamp("date") - F.unix_timestamp(first.cast("timestamp"))) / 86400
    lo = F.greatest(F.ceil((offset - half) / step), F.lit(0).cast("long"))
    hi = F.least(F.floor((offset + half) / step), last_no)
    numbers = F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi)))
    return (
        stays.withColumn("window_no", F.explode(numbers))
        .withColumn("start_date", F.date_add(first, (F.col("window_no") * step).cast("int")))
        .drop("window_no")
    )


def one_row_per_night(stays: DataFrame) -> DataFrame:
    """Repeat a stay once per night."""
    return stays.withColumn("night", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), "num_days"))))


def night_places(windowed: DataFrame, min_nights: int = MIN_NIGHTS) -> DataFrame:
    """(start_date, caid, place, weight = nights) of devices with enough nights in the window."""
    places = windowed.groupBy("start_date", "caid", "latitude", "longitude").agg(
        F.sum("num_days").alias("weight")
    )
    key = ["start_date", "caid"]
    keepers = (
        windowed.groupBy(*key).agg(F.sum("num_days").alias("nights"))
        .filter(F.col("nights") >= min_nights).select(*key)
    )
    return salted_join(places, keepers, key, "left_semi", spread=["latitude", "longitude"])


def home_clusters(
    places: DataFrame, eps_km: float = HOME_EPS_KM, min_points: int = HOME_MIN_POINTS
) -> DataFrame:
    """Clusters of night places per window and device: centre and number of nights."""
    key = ["start_date", "caid"]
    members = density_clusters(places, key, eps_km / HOME_RADIUS_KM, min_points)
    w = F.col("weight")
    return members.groupBy(*key, "cluster").agg(
        (F.sum(F.col("latitude") * w) / F.sum(w)).alias("latitude"),
        (F.sum(F.col("longitude") * w) / F.sum(w)).alias("longitude"),
        F.sum(w).alias("num_members"),
    )


def biggest_cluster(clusters: DataFrame) -> DataFrame:
    """The cluster with the most nights; of equal ones the one with the lowest place."""
    best = F.min_by(F.struct("latitude", "longitude"), F.struct(-F.col("num_members"), F.col("cluster")))
    return clusters.groupBy("start_date", "caid").agg(best.alias("home")).select(
        "caid", "home.latitude", "home.longitude", F.col("start_date").cast("string").alias("start_date")
    )


def home_locations(
    dwells: DataFrame, start: str, end: str, zone: str | Column = HOME_ZONE, step: int = HOME_STEP_DAYS,
    half: int = HOME_HALF_DAYS, min_nights: int = MIN_NIGHTS,
) -> DataFrame:
    """Dwells -> one home per device and window: caid, latitude, longitude, start_date.

    A device with enough nights but no dense place gets no row.
    """
    windowed = home_windows(overnight_stays(dwells, start, end, zone), start, end, step, half)
    return biggest_cluster(home_clusters(night_places(windowed, min_nights)))


def drop_crowded_spots(homes: DataFrame, most: int = MAX_HOMES_PER_SPOT) -> DataFrame:
    """Leave out coordinates shared by more than `most` devices."""
    spot = ["longitude", "latitude"]
    crowded = homes.groupBy(*spot).agg(F.count("caid").alias("n")).filter(F.col("n") > most).select(*spot)
    return salted_join(homes, crowded, spot, "left_anti", spread=["caid"])
