"""Tables made from estimates: long form, period summaries, splits, trims and joins of context."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clock import conflict_period
from ..functions.fixed_values import (
    FALSE_RATE_THRESHOLD,
    SHOP_MEAN_ROWS,
    TRIM_IQR,
)
from .checkpoints import cut
from .joins import first_row, reference_join
from .quantiles import group_quantiles


def long_estimates(wide: DataFrame, ids: list[str], prefix: str = "e_TYPE_",
                   cells: tuple[int, int] | None = None) -> DataFrame:
    """Wide estimate columns -> (ids, period text, period_num in minutes, movement).

    All cells, before and after the alert, unless `cells` names the first and last second of a part.
    """
    columns = [c for c in wide.columns if c.startswith(prefix)]
    if cells:
        columns = [c for c in columns if cells[0] <= int(c[len(prefix):]) <= cells[1]]
    long = wide.unpivot(ids, columns, "period", "movement")
    text = F.replace(F.replace(F.col("period"), F.lit(prefix), F.lit("")), F.lit("."), F.lit("-"))
    return long.withColumn("period", text).withColumn(
        "period_num", F.try_divide(F.col("period").try_cast("double"), F.lit(60.0))
    )


def decode_id(estimates: DataFrame, id_col: str = "id") -> DataFrame:
    """Region, day and month of the text id (19 characters of time, then the region)."""
    return estimates.withColumns(
        {
            "region_english": F.trim(F.expr(f"substring({id_col}, 20)")),
            "day": F.make_date(
                F.substring(id_col, 1, 4).cast("int"), F.substring(id_col, 6, 2).cast("int"),
                F.substring(id_col, 9, 2).cast("int"),
            ),
            "month": F.substring(id_col, 6, 2),
        }
    )


def with_time_period(estimates: DataFrame, by_time: bool = True) -> DataFrame:
    """Conflict period of the month, 0 for other months; 0 throughout without by_time."""
    period = conflict_period(F.col("month").cast("int"), default=0) if by_time else F.lit(0)
    return estimates.withColumn("time_period", period)


def drop_unobserved(estimates: DataFrame, value: str = "movement") -> DataFrame:
    """Zero means the cell was not observed: set to null, then drop rows with any null."""
    return estimates.withColumn(value, F.nullif(F.col(value), F.lit(0.0))).dropna("any")


def mean_bands(df: DataFrame, keys: list[str], value: str = "movement", width: float = 2.0) -> DataFrame:
    """Mean, sample sd and mean +- 2 sd per group."""
    out = df.groupBy(*keys).agg(F.avg(value).alias("x_mean"), F.stddev_samp(value).alias("x_sd"))
    return out.withColumns(
        {
            "max_tick": F.col("x_mean") + width * F.col("x_sd"),
            "min_tick": F.col("x_mean") - width * F.col("x_sd"),
        }
    )


def above_median(df: DataFrame, split: str, facet: list[str], out: str = "grp") -> DataFrame:
    """Flag values above the exact median of their facet (null where the value is missing)."""
    facet = list(facet)
    work = df if facet else df.withColumn("all_rows", F.lit(1))
    keys = facet or ["all_rows"]
    medians = group_quantiles(work, keys, split, {"median": 0.5})
    joined = reference_join(work, medians, keys, "left", spread=[c for c in df.columns if c not in keys])
    return joined.withColumn(out, F.col(split) > F.col("median")).drop("median", "all_rows")


def split_bands(df: DataFrame, split: str, facet: list[str], value: str = "movement",
                group: str | None = None) -> DataFrame:
    """Mean +- 2 sd by period, group and facet; the group is "above the facet's median" or a column."""
    flagged = above_median(df, split, facet) if group is None else df.withColumn("grp", F.col(group))
    return mean_bands(flagged, ["period_num", "grp", *facet], value).filter("grp IS NOT NULL")


def trim_outliers(df: DataFrame, keys: list[str], value: str = "movement", width: float = TRIM_IQR) -> DataFrame:
    """Keep values in [q25 - width IQR, q75 + width IQR) of their group."""
    q = group_quantiles(df, keys, value, {"q25": 0.25, "q75": 0.75})
    q = q.select(
        *keys,
        (F.col("q25") - width * (F.col("q75") - F.col("q25"))).alias("low"),
        (F.col("q75") + width * (F.col("q75") - F.col("q25"))).alias("high"),
    )
    joined = reference_join(df, q, keys, "left", spread=[c for c in df.columns if c not in keys])
    return joined.filter((F.col(value) >= F.col("low")) & (F.col(value) < F.col("high"))).drop("low", "high")


def upper_lower(b: Column, slope: Column, sd: Column) -> Column:
    """Array of (conf, movement): the effect at distance 0 ("lower") and one sd away ("upper")."""
    return F.array(
        F.struct(F.lit("lower").alias("conf"), b.alias("movement")),
        F.struct(F.lit("upper").alias("conf"), (b + slope * sd).alias("movement")),
    )


def distance_bands(effects: DataFrame, keys: list[str], sd: Column | float, by: list[str]) -> DataFrame:
    """Effects at distance 0 ("lower") and one sd away ("upper"), trimmed and summarised.

    `effects` holds terms "cell" and "cell_x" with b; `by` are the columns of the summary.
    """
    paired = effects.filter(F.col("term") != "x").groupBy(*keys, "cell").agg(
        F.max(F.when(F.col("term") == "cell", F.col("b"))).alias("b"),
        F.max(F.when(F.col("term") == "cell_x", F.col("b"))).alias("g"),
    )
    sd = sd if isinstance(sd, Column) else F.lit(float(sd))
    both = upper_lower(F.col("b"), F.col("g"), sd)
    long = (
        paired.withColumn("v", F.explode(both)).select(*keys, "cell", "v.*")
        .withColumn("period_num", F.col("cell") / 60.0)
    )
    dated = cut(long.withColumn("time_period", conflict_period(F.month("start_raid_next"), default=0)))
    return mean_bands(trim_outliers(dated, ["time_period"]), by)


# --- context of regions -----------------------------------------------------------------------

def shop_index(econ: DataFrame, region: str, value: str = "dwells_shops", weight: str = "caid_unique",
               rows: int = SHOP_MEAN_ROWS) -> DataFrame:
    """Value per device, its January mean, trailing mean over `rows` rows and the ratio of both.

    `econ` has one row per region and day, `value` being a sum over devices.  The trailing mean needs
    a full set of rows.  A region's group is bounded by the number of days.
    """
    along = W.partitionBy(region).orderBy("day").rowsBetween(1 - rows, 0)
    whole = W.partitionBy(region)
    per_device = F.coalesce(F.try_divide(F.col(value), F.col(weight)), F.lit(0.0))
    out = econ.withColumn(value, per_device).withColumns(
        {
            f"{value}_jan": F.avg(F.when(F.month("day") == 1, F.col(value))).over(whole),
            f"{value}_ma": F.when(F.count(F.lit(1)).over(along) == rows, F.avg(value).over(along)),
        }
    )
    ratio = F.try_divide(F.col(f"{value}_ma"), F.col(f"{value}_jan"))
    return out.withColumn(f"{value}_norm", ratio).filter(F.col(f"{value}_jan").isNotNull())


def shop_levels(econ: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Region-day sums at both levels; the scaling per device is undone before summing."""
    base = econ.withColumn("dwells_shops", F.col("dwells_shops") * F.col("caid_unique"))
    sums = [F.sum("dwells_shops").alias("dwells_shops"), F.sum("caid_unique").alias("caid_unique")]
    return base.groupBy("name_1", "day").agg(*sums), base.groupBy("name_2", "day").agg(*sums)


def false_alarm_rates(days: DataFrame, threshold: float = FALSE_RATE_THRESHOLD) -> DataFrame:
    rate = F.try_divide(F.col("false_alarm"), F.col("false_alarm") + F.col("true_alarm"))
    return days.withColumn("false_alarm_rate", rate).withColumn(
        "abv_med_falserate", (F.col("false_alarm_rate") > threshold).cast("int")
    )


def trailing_mean(df: DataFrame, keys: list[str], order: str, value: str, rows: int, out: str) -> DataFrame:
    """Mean of the last `rows` rows of a key; null until there are that many."""
    along = W.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0)
    return df.withColumn(
        out, F.when(F.count(F.lit(1)).over(along) == rows, F.avg(value).over(along))
    )


def early_mean(df: DataFrame, keys: list[str], day: str, until: str, value: str, out: str) -> DataFrame:
    """Mean of a value over the days up to a date, attached to every row of the key."""
    early = df.filter(F.col(day) <= F.lit(until).cast("date")).groupBy(*keys).agg(F.avg(value).alias(out))
    return reference_join(df, early, keys, "left", spread=[c for c in df.columns if c not in keys])


def merge_context(estimates: DataFrame, econ: DataFrame, names: DataFrame, region_days: DataFrame,
                  false_days: DataFrame) -> DataFrame:
    """Estimates with the shop index of their region (level 1, else level 2), region and false-alarm days.

    `names` maps NAME_1 to region_english; one row per NAME_1 is used (the first by name).
    """
    one, two = shop_levels(econ)
    lookup = first_row(names.select("NAME_1", "region_english").distinct(), ["NAME_1"], [F.col("region_english")])
    lookup = lookup.filter("region_english IS NOT NULL")
    cols = ["dwells_shops", "dwells_shops_ma", "dwells_shops_norm"]

    def level(sums: DataFrame, name: str, tag: str) -> DataFrame:
        named = lookup.select(F.col("NAME_1").alias("unit"), "region_english").withColumnRenamed("unit", name)
        keyed = shop_index(sums, name).join(named, name)
        unique = first_row(
            keyed.select("day", "region_english", name, *cols), ["day", "region_english"], [F.col(name)]
        )
        return unique.select("day", "region_english", *[F.col(c).alias(c + tag) for c in cols])

    key = ["day", "region_english"]
    joined = reference_join(estimates, level(one, "name_1", ""), key, "left", spread=["period"])
    joined = reference_join(joined, level(two, "name_2", "_2"), key, "left", spread=["period"])
    filled = joined.withColumns({c: F.coalesce(c, c + "_2") for c in cols}).drop(*[c + "_2" for c in cols])
    with_region = reference_join(filled, region_days, key, "inner", spread=["period"])
    return reference_join(with_region, false_alarm_rates(false_days), key, "inner", spread=["period"])


def local_curve(points: DataFrame, keys: list[str], x: str = "period_num", y: str = "x_mean",
                span: float = 0.75) -> DataFrame:
    """Smoothed value at each x: local quadratic with tricube weights over the nearest share of points.

    Fitted per group and side of zero.  `points` are summaries, one row per group and cell, so a
    group is bounded by the number of cells; each point is joined with its side's points.
    """
    side = F.when(F.col(x) < 0, "before").otherwise("after")
    data = cut(points.select(*keys, side.alias("side"), F.col(x).alias("x"), F.col(y).alias("y")).dropna("any"))
    here = data.select(*keys, "side", F.col("x").alias("x0"))
    group = [*keys, "side"]
    pairs = here.join(data, group).withColumn("u", F.abs(F.col("x") - F.col("x0")))
    near = W.partitionBy(*group, "x0")
    ranked = pairs.withColumns(
        {"rank": F.row_number().over(near.orderBy("u", "x")), "n": F.count(F.lit(1)).over(near)}
    )
    in_span = F.col("rank") <= F.floor(F.col("n") * span + 1e-5)
    radius = F.max(F.when(in_span, F.col("u"))).over(near)
    weighted = ranked.withColumn("h", radius).filter("u < h").withColumns(
        {"w": F.pow(1 - F.pow(F.col("u") / F.col("h"), 3), 3), "t": F.col("x") - F.col("x0")}
    )
    t, w, v = F.col("t"), F.col("w"), F.col("y")
    sums = weighted.groupBy(*group, "x0").agg(
        *[F.sum(w * F.pow(t, k)).alias(f"s{k}") for k in range(5)],
        *[F.sum(w * v * F.pow(t, k)).alias(f"r{k}") for k in range(3)],
    )
    s0, s1, s2, s3, s4, r0, r1, r2 = [F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "r0", "r1", "r2")]
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    top = r0 * (s2 * s4 - s3 * s3) - s1 * (r1 * s4 - r2 * s3) + s2 * (r1 * s3 - r2 * s2)
    return sums.select(*group, F.col("x0").alias(x), F.try_divide(top, det).alias("smooth"))


def simple_fit(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Correlation, r squared, regression line, and the ends of the line y = x * sum(y)/sum(x)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    slope = F.try_divide(F.covar_pop(a, b), F.var_pop(a))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    ratio = F.try_divide(F.sum(b), F.sum(a))
    return df.groupBy(*(keys or [])).agg(
        r.alias("r"), (r * r).alias("r2"), slope.alias("slope"), (F.avg(b) - slope * F.avg(a)).alias("intercept"),
        ratio.alias("ratio"), F.min(a).alias("x_min"), F.max(a).alias("x_max"),
        (ratio * F.min(a)).alias("y_at_min"), (ratio * F.max(a)).alias("y_at_max"),
    )
