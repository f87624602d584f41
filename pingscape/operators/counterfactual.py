"""Daily harm series, movement trend and counterfactual harm.

Tables here have one row per date; the few windows over them are bounded by the number of days.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clock import conflict_period
from ..functions.fixed_values import (
    MINIMAL_MOVEMENT,
    MOVEMENT_COEF,
    MOVEMENT_END,
    MOVEMENT_START,
    TREND_END,
    TREND_START,
)
from .joins import full_merge


def daily_harm(conflict: DataFrame, actor: str, day: str = "event_date", who: str = "actor2",
               value: str = "fatalities") -> DataFrame:
    """Deaths of the actor, events with at least one death, and deaths per event, by date."""
    mine = F.col(who) == actor
    return conflict.groupBy(day).agg(
        F.coalesce(F.sum(F.when(mine, F.col(value))), F.lit(0)).alias("civcas"),
        F.coalesce(F.sum(F.when(mine & (F.col(value) >= 1), 1)), F.lit(0)).alias("civcas_event"),
    ).withColumn("civcas_elasticity", F.try_divide("civcas", "civcas_event"))


def calendar_mean(series: DataFrame, day: str, value: str, days: int, out: str) -> DataFrame:
    """Mean over the last `days` calendar days; null if any of them is missing or null.

    Each day sends its value to the days it counts for, so no ordered window over the series is needed.
    """
    sent = series.filter(F.col(value).isNotNull()).select(
        F.explode(F.sequence(F.col(day), F.date_add(day, days - 1))).alias(day), F.col(value).alias("v")
    )
    means = sent.groupBy(day).agg(F.avg("v").alias(out), F.count("v").alias("days_seen"))
    full = means.filter(F.col("days_seen") == days).drop("days_seen")
    return series.join(full, day, "left")


def interpolate(df: DataFrame, keys: list[str], x: str, y: str, out: str) -> DataFrame:
    """Straight lines between the known y of a key along x; nothing beyond the known points.

    A key's rows must be few (a daily series).
    """
    up = W.partitionBy(*keys).orderBy(x).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*keys).orderBy(x).rowsBetween(0, W.unboundedFollowing)
    point = F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    found = df.withColumn("point", point).withColumns(
        {"p0": F.last("point", ignorenulls=True).over(up), "p1": F.first("point", ignorenulls=True).over(down)}
    )
    share = F.try_divide(F.datediff(F.col(x), F.col("p0.x")), F.datediff(F.col("p1.x"), F.col("p0.x")))
    line = F.col("p0.y") + (F.col("p1.y") - F.col("p0.y")) * share
    value = F.when(F.col(x).isNull(), None).when(F.col("p0.x") == F.col("p1.x"), F.col("p0.y")).otherwise(line)
    return found.withColumn(out, value).drop("point", "p0", "p1")


def harm_series(conflict: DataFrame, actor: str, start: str = TREND_START, end: str = TREND_END) -> DataFrame:
    """Daily harm with the 7-day mean of deaths per event, cut to the study dates (both in)."""
    daily = calendar_mean(daily_harm(conflict, actor), "event_date", "civcas_elasticity", 7, "elasticity_ma")
    return daily.filter(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def merged_days(harm: DataFrame, alert_days: DataFrame, missing_is_last: bool = False) -> DataFrame:
    """Full merge on the date with the conflict period and the movement trend.

    Rows that are only in the alert table have no month; their period is null, or 3 with
    `missing_is_last` (a missing number compared as if it were the largest).
    """
    keyed = harm.withColumn("smart_date", F.col("event_date"))
    both = full_merge(keyed, alert_days, ["smart_date"]).withColumn("month", F.month("event_date"))
    period = conflict_period(F.col("month"), open_end=True)
    if missing_is_last:
        period = F.coalesce(period, F.when(F.col("month").isNull(), 3))
    known = F.when(F.col("event_date") == F.lit(TREND_START).cast("date"), MOVEMENT_START).when(
        F.col("event_date") == F.lit(TREND_END).cast("date"), MOVEMENT_END
    )
    dated = both.withColumns({"period_of_conflict": period, "mvmt_avg": known, "series": F.lit(1)})
    return interpolate(dated, ["series"], "event_date", "mvmt_avg", "mvmt_trend").drop("series", "mvmt_avg")


def counterfactuals(days: DataFrame, coef: float = MOVEMENT_COEF, start: float = MOVEMENT_START,
                    minimal: float = MINIMAL_MOVEMENT) -> DataFrame:
    """Avoided deaths (no movement, minimal movement) and excess deaths (trend, actual, smoothed harm)."""
    rate = F.col("alert") * F.col("civcas_elasticity")
    smooth = F.col("alert") * F.col("elasticity_ma")
    trend, actual = F.col("mvmt_trend") - start, F.col("movement") - start
    later = ~F.coalesce(F.col("period_of_conflict") == 1, F.lit(False))
    return days.select(
        "smart_date", "month", "period_of_conflict", "civcas",
        (rate * (0 - F.col("movement")) * coef).alias("deaths_avoided_1"),
        (rate * (minimal - F.col("movement")) * coef).alias("deaths_avoided_2"),
        F.when(later, rate * trend * coef).alias("excess_deaths_1"),
        F.when(later, rate * actual * coef).alias("excess_deaths_2"),
        F.when(later, smooth * trend * coef).alias("excess_deaths_3"),
    )
