"""The event study: samples, outcomes and windows of one panel, each panel read by one aggregate."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clock import conflict_period
from ..functions.fixed_values import MIN_HOME_DISTANCE_M, MIN_MOVING_KMH
from ..functions.geo import chord_m
from ..operators import events, regression
from ..operators.events import EVENT

SCENARIOS = ["base", "rural", "urban", "away_from_home", "moving"]
#: Longer windows around alerts that last longer than the window, in hours.
LONG_WINDOWS = [1, 4]
PERIODS = 3


def with_periods(panel: DataFrame) -> DataFrame:
    """Add `periods`, a bit for every period of the conflict in which the panel has the device."""
    bit = F.expr("shiftleft(1, period)")
    seen = panel.withColumn("period", conflict_period(F.month("day"))).withColumn("bit", F.when(F.col("period").isNotNull(), bit))
    return seen.withColumn("periods", F.coalesce(F.bit_or("bit").over(W.partitionBy("caid")), F.lit(0))).drop("period", "bit")


def sample_rules(periods: int = PERIODS) -> dict[str, Column]:
    """All rows, and those of devices that are seen in every period."""
    return {"": F.lit(True), "_sample": F.bit_count("periods") == periods}


def with_memberships(panel: DataFrame, homes: DataFrame) -> DataFrame:
    """Add what decides a row's scenarios: `away` and `moving` of its device in its event."""
    by_month = homes.select(
        "caid", F.month(F.date_add(F.to_date("start_date"), 5)).alias("home_month"),
        F.col("latitude").alias("latitude_home"), F.col("longitude").alias("longitude_home"),
    )
    device_event = W.partitionBy("caid", *EVENT)
    home_distance = chord_m(
        F.col("latitude_center"), F.col("longitude_center"), F.col("latitude_home"), F.col("longitude_home")
    )
    joined = panel.withColumn("home_month", F.month("start_raid_next")).join(by_month, ["caid", "home_month"], "left")
    return joined.withColumns(
        {
            "away": F.coalesce(F.min(home_distance).over(device_event) > MIN_HOME_DISTANCE_M, F.lit(False)),
            "moving": F.coalesce(F.min("kmh_avg").over(device_event) > MIN_MOVING_KMH, F.lit(False)),
        }
    ).drop("home_month", "latitude_home", "longitude_home")


def scenario_rules(scenarios: list[str] = SCENARIOS) -> dict[str, Column]:
    rules = {
        "base": F.lit(True),
        "rural": F.col("rural") == 1,
        "urban": F.col("rural") == 0,
        "away_from_home": F.col("away"),
        "moving": F.col("moving"),
    }
    return {s: rules[s] for s in scenarios}


def event_study(panel: DataFrame, homes: DataFrame, outcomes: list[str], scenarios: list[str] = SCENARIOS) -> DataFrame:
    """Effects by scenario, sample, outcome, scale, event and cell, in long form, from one aggregate of the panel."""
    rows = with_memberships(with_periods(panel), homes)
    rules = {(s, sample): rule & own for s, rule in scenario_rules(scenarios).items() for sample, own in sample_rules().items()}
    return regression.grid_effects(rows, EVENT, outcomes, rules, ("scenario", "sample"))


def window_study(panel: DataFrame, alerts: DataFrame, hours: float, outcomes: list[str]) -> DataFrame:
    """The same in a longer window, for alerts that last longer than it; the scenario is its length in minutes."""
    rows = with_periods(events.event_panel(panel, alerts, hours, extend=True))
    scenario = str(int(60 * hours))
    rules = {(scenario, sample): own for sample, own in sample_rules().items()}
    return regression.grid_effects(rows, EVENT, outcomes, rules, ("scenario", "sample"))


def interaction_study(panel: DataFrame, distances: DataFrame, y: str, **sample) -> DataFrame:
    """Effects of the cells, of their products with the distance to the contact zone, and of the distance itself.

    Returns (event, term, cell, b) for the events that `events.front_sample` keeps.
    """
    rows = events.front_sample(events.with_front_distance(panel, distances), **sample)
    return regression.interacted_effects(rows, EVENT, y, "distance_to_front")


def scenario_grid(
    panel: DataFrame, homes: DataFrame, distances: DataFrame, city_panel: DataFrame, alerts: DataFrame, outcome: str,
    hours: list[float] = LONG_WINDOWS, **front_sample,
) -> DataFrame:
    """Every scenario of one outcome on its own scale: (scenario, event, term, cell, b).

    The scenarios of `panel` (30 minutes), the longer windows of `city_panel` and the run with interactions.
    """
    fits = [event_study(panel, homes, [outcome]), *[window_study(city_panel, alerts, h, [outcome]) for h in hours]]
    columns = ["scenario", *EVENT, "term", "cell", "b"]
    plain = [
        f.filter("sample = '' and scale = ''").withColumns({"term": F.lit("cell"), "cell": F.col("time_to_raid_post").cast("long")})
        for f in fits
    ]
    whole = interaction_study(panel, distances, outcome, **front_sample).withColumn("scenario", F.lit("interaction")).select(columns)
    for fit in plain:
        whole = whole.unionByName(fit.select(columns))
    return whole
