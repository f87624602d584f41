"""Alert log: switch times to named intervals with a duration."""

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import local_time, minute_of
from ..functions.fixed_values import LOCAL_ZONE, REGION_FIXES, REGION_RENAMES, REGION_SUFFIXES
from .joins import alias_join, map_values
from .ordered import pair_toggles


def day_chunk(epoch_seconds: Column) -> Column:
    return F.floor(epoch_seconds / 86400)


def alert_intervals(toggles: DataFrame, place: str, zone: str = LOCAL_ZONE, time: str = "t",
                    order: list[str] | None = None) -> DataFrame:
    """Switch times -> (place, start, end, start_dt, end_dt), paired within each place."""
    paired = pair_toggles(toggles, [place], time, order or [time], day_chunk(F.col(time)))
    return paired.withColumns(
        {"start_dt": local_time(F.col("start"), zone), "end_dt": local_time(F.col("end"), zone)}
    )


def tidy_region(name: Column) -> Column:
    """Spelling used by the region layer: fixed renames, then without the unit words."""
    for old, new in REGION_RENAMES:
        name = F.replace(name, F.lit(old), F.lit(new))
    for suffix in REGION_SUFFIXES:
        name = F.replace(name, F.lit(suffix), F.lit(""))
    return name


def region_fixes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGION_FIXES, "key string, value string")


def name_regions(alerts: DataFrame, level1: DataFrame, level2: DataFrame, fixes: DataFrame) -> DataFrame:
    """Add NAME_1: the level-1 unit of the region name, else the level-2 unit, else the fixed name.

    Units have (NAME_1, VARNAME_1) and (name_2, varname_2); variants are separated by bars.
    """
    one = alias_join(alerts, "region_english", level1, "NAME_1", "VARNAME_1")
    two = alias_join(one, "region_english", level2, "name_2", "varname_2")
    three = map_values(two, "region_english", fixes, "name_3")
    return three.withColumn("NAME_1", F.coalesce("NAME_1", "name_2", "name_3")).drop("name_2", "name_3")


def clean_alerts(
    toggles: DataFrame, names: DataFrame, level1: DataFrame, level2: DataFrame, fixes: DataFrame,
    place: str = "region_ukrainian", zone: str = LOCAL_ZONE, order: list[str] | None = None,
) -> DataFrame:
    """Switch times -> alerts with English region, unit name and duration in minutes.

    Durations are differences of epochs, so a change of the clocks during an alert does not count.

    `names` is the (key, value) dictionary of place labels; places without a label are left out.
    """
    named = map_values(alert_intervals(toggles, place, zone, order=order), place, names, "region_english")
    tidy = named.filter("region_english IS NOT NULL").withColumn(
        "region_english", tidy_region(F.col("region_english"))
    )
    return name_regions(tidy, level1, level2, fixes).withColumn(
        "duration", (F.col("end") - F.col("start")) / 60
    )


def alert_days(alerts: DataFrame) -> DataFrame:
    """One row per 24-hour step from start to end, as the date of the step."""
    steps = alerts.withColumn("day", F.explode(F.sequence("start_dt", "end_dt", F.expr("INTERVAL 1 DAY"))))
    return steps.withColumn("day", F.to_date("day"))


def alert_counts(alerts: DataFrame, region: str = "region_english") -> DataFrame:
    """Alerts per region and day."""
    return alert_days(alerts).groupBy(region, "day").agg(F.count(F.lit(1)).alias("alerts"))


def heat_table(counts: DataFrame, days: list[str] | None = None, region: str = "region_english") -> DataFrame:
    """Region x day table, zero filled, largest total first.

    Without a list, the days are all from the first to the last with an alert; a day that is missing from a given list
    stops the job instead of leaving the table and its total.
    """
    if days is None:
        first, last = counts.agg(F.min(F.to_date("day")), F.max(F.to_date("day"))).first()
        days = [str(first + timedelta(n)) for n in range((last - first).days + 1)] if first else []
    day = F.col("day").cast("string")
    unlisted = F.raise_error(F.concat(day, F.lit(" is not in the list of days"))).cast("string")
    listed = F.when(day.isin(days), day).otherwise(unlisted)
    wide = counts.withColumn("day", listed).groupBy(region).pivot("day", days).agg(F.sum("alerts")).fillna(0, days)
    total = sum((F.col(f"`{d}`") for d in days), F.lit(0))
    return wide.withColumn("total", total).orderBy(F.desc("total"), region)


def matched_alerts(alerts: DataFrame, event_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Alerts that reached the estimates, matched on region and start minute of the event id."""
    ids = event_ids.select(
        F.expr(f"substring({id_col}, 20)").alias("region_english"),
        F.to_timestamp(F.substring(id_col, 1, 19)).alias("start_date"),
    )
    return alerts.withColumn("start_date", minute_of(F.col("start_dt"))).join(
        ids, ["region_english", "start_date"]
    )


def city_layer(level2: DataFrame, level1: DataFrame, types: list[str], names: list[str]) -> DataFrame:
    """City polygons: level-2 units of the given types (or none), and the named level-1 cities."""
    kept = level2.filter(F.col("type_2").isin(types) | F.col("type_2").isNull())
    extra = level1.filter(F.col("NAME_1").isin(names))
    return kept.select(F.col("name_2").alias("city"), "geometry").unionByName(
        extra.select(F.col("NAME_1").alias("city"), "geometry"), allowMissingColumns=True
    )
