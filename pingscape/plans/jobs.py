"""Whole jobs from stored inputs to stored results.

Each step that several later steps read is written as a table: the executors may be lost, and a job
can go on from the last table.
"""

from pyspark.sql import DataFrame, SparkSession

from ..functions.fixed_values import HOME_ZONE, LOCAL_ZONE
from ..operators import alerts, context, counterfactual, events, front, homes, panel, regression, trajectory
from ..operators.estimates import simple_fit
from ..operators.polygons import locate
from ..sources import sinks, tables
from .study import event_study, window_study


def extract_pings(spark: SparkSession, base: str, span: str, country: str, out: str) -> DataFrame:
    """Day folders of raw pings -> accurate pings of one country."""
    sinks.write_parquet(tables.select_pings(tables.scan_days(spark, base, span), country), out)
    return tables.scan_parquet(spark, out, schema=tables.PING_SCHEMA)


def write_dwells(spark: SparkSession, pings: str, out: str, partitions: int | None = None) -> DataFrame:
    """Stored pings -> stays; `partitions` spreads the result over that many files by device."""
    stays = trajectory.stays(tables.scan_parquet(spark, pings, schema=tables.PING_SCHEMA))
    sinks.write_parquet(stays.repartition(partitions, "caid") if partitions else stays, out)
    return tables.scan_parquet(spark, out, schema=tables.DWELL_SCHEMA)


def write_homes(spark: SparkSession, dwells: str, out: str, start: str, end: str, zone: str = HOME_ZONE) -> DataFrame:
    """Stored stays -> homes of all windows."""
    sinks.write_parquet(homes.home_locations(tables.scan_parquet(spark, dwells), start, end, zone), out)
    return tables.scan_parquet(spark, out)


def write_panel(spark: SparkSession, pings: str, regions: DataFrame, cities: DataFrame, alert_table: DataFrame,
                out: str, zone: str = LOCAL_ZONE) -> DataFrame:
    """Stored pings -> device-minute panel with regions, alerts and cities, one folder per day."""
    source = tables.scan_parquet(spark, pings, schema=tables.PING_SCHEMA)
    minutes = panel.minute_panel(source, regions, alert_table, zone)
    sinks.write_parquet(panel.with_city(minutes, cities), out, ["day"])
    return tables.scan_parquet(spark, out)


def write_study(spark: SparkSession, panel_path: str, alert_table: DataFrame, home_table: DataFrame, out: str,
                outcomes: list[str], long_windows: tuple[float, ...] = (1.0, 4.0)) -> None:
    """Stored panel -> event panel and estimates of all scenarios and windows."""
    source = tables.scan_parquet(spark, panel_path)
    sinks.write_parquet(events.event_panel(source, alert_table), f"{out}/events")
    stored = tables.scan_parquet(spark, f"{out}/events")
    sinks.write_parquet(event_study(stored, home_table, outcomes), f"{out}/estimates")
    for hours in long_windows:
        sinks.write_parquet(window_study(source, alert_table, hours, outcomes), f"{out}/estimates_{round(60 * hours)}")


def write_front_study(spark: SparkSession, events_path: str, control: DataFrame, out: str, lat0: float,
                      outcome: str = "distance_sum") -> None:
    """Stored event panel -> distance to the contact zone and the interacted estimates."""
    source = tables.scan_parquet(spark, events_path)
    lenses = front.contact_lenses(front.control_long(control), lat0)
    keys = ["caid", *events.EVENT]
    distances = front.front_distance(events.event_positions(source), lenses, keys, lat0)
    sinks.write_parquet(events.with_front_distance(source, distances), f"{out}/front_events")
    rows = events.front_sample(tables.scan_parquet(spark, f"{out}/front_events"))
    sinks.write_parquet(
        regression.interacted_effects(rows, events.EVENT, outcome, "distance_to_front"), f"{out}/front_estimates"
    )


def write_alerts(spark: SparkSession, log: str, place_names: DataFrame, labels: DataFrame, level1: DataFrame,
                 level2: DataFrame, out: str, zone: str = LOCAL_ZONE) -> DataFrame:
    """JSON switch log -> named alerts.  `place_names` maps the position in the log to the place."""
    toggles = tables.scan_toggle_log(spark, log).join(place_names, "place")
    clean = alerts.clean_alerts(
        toggles, labels, level1, level2, alerts.region_fixes(spark), zone=zone, order=["t", "position"]
    )
    sinks.write_parquet(clean, out)
    return tables.scan_parquet(spark, out)


def population_fit(home_table: DataFrame, cells: DataFrame, units: DataFrame, parents: DataFrame, unit: str,
                   parent: str, cell_size: float) -> tuple[DataFrame, DataFrame]:
    """Fit of devices against population by unit and by parent unit."""
    kept = homes.drop_crowded_spots(home_table)
    located = locate(kept, units, unit, "longitude", "latitude", how="left", boundary=True)
    population = context.unit_population(context.largest_overlap(cells, units, unit, cell_size), unit)
    by_unit = context.devices_and_population(located, unit, population)
    by_parent = context.roll_up(by_unit, parents, unit, parent)
    return simple_fit(by_unit, "population", "devices"), simple_fit(by_parent, "population", "devices")


def write_counterfactuals(spark: SparkSession, conflict: DataFrame, actor: str, alert_days: DataFrame, out: str) -> DataFrame:
    """Conflict events and alert days -> daily counterfactual harm."""
    days = counterfactual.merged_days(counterfactual.harm_series(conflict, actor), alert_days)
    sinks.write_parquet(counterfactual.counterfactuals(days), out)
    return tables.scan_parquet(spark, out)
