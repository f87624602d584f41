"""Exact quantiles of groups of any size, moving only values near the wanted ranks.

A KLL sketch (mergeable, of bounded size) brackets each wanted rank.  The brackets are sent to the
rows; every row is counted where it is, in one of the bins of a bracket or on either side of it, so
what is shuffled are counts.  They say exactly which bin holds the rank and how many values lie
below.  While that bin holds many values it becomes the next bracket; a rank outside its bracket is
found in the bin beside it, so a sketch that missed costs a round, not a result.  At last the values
of the chosen bins alone are shuffled and ordered.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .checkpoints import cut, stored_and_counted
from .joins import reference_join

#: Bins of a bracket, size of the sketch and the ranks (as a share) by which a bracket reaches to either side.
BINS, SKETCH, REACH = 64, 800, 0.005
#: Values of a bracket that are ordered in one window, and most rounds of bins (each has BINS times fewer values).
MOST_VALUES, MOST_ROUNDS = 100_000, 9


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles (as R type 7 and numpy) per group: one column per name in probs.

    Null values are left out; a group without others gives no row.  The values are stored once and read for every
    step; none is shuffled for the sketch or the counts.
    """
    return _quantiles(cut(_values(df, keys, value)), list(keys) or ["all_rows"], probs).drop("all_rows")


def _values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    data = df.select(*keys, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    return data if keys else data.withColumn("all_rows", F.lit(1))


def first_brackets(data: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """(keys, n, want): per name the wanted rank and the values between which the sketch puts it."""
    drawn = data.groupBy(*keys).agg(F.count("v").alias("n"), F.kll_sketch_agg_double("v", SKETCH).alias("sketch"))

    def at(share: float) -> Column:
        return F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, share))))

    return drawn.select(*keys, F.array(*[
        F.struct(F.lit(name).alias("name"), ((F.col("n") - 1) * F.lit(float(p))).alias("rank"),
                 at(p - REACH).alias("lo"), at(p + REACH).alias("hi"))
        for name, p in probs.items()
    ]).alias("want"))


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """Bin of a value, not decreasing in it: 0 and BINS + 1 are outside; a bracket without a finite width is one bin."""
    wide = hi - lo
    inner = F.when((wide > 0) & (wide < F.lit(float("inf"))), F.least(F.floor((v - lo) / wide * BINS), F.lit(BINS - 1))).otherwise(0)
    return F.when(v < lo, 0).when(v > hi, BINS + 1).otherwise(inner + 1).cast("int")


def _narrowed(data: DataFrame, keys: list[str], brackets: DataFrame) -> DataFrame:
    """(keys, name, rank, lo, hi, below, inside, new) after one count: the bins that hold the ranks on both sides of `rank`."""
    each = F.transform("want", lambda w: F.struct(w["name"].alias("name"), _bin(F.col("v"), w["lo"], w["hi"]).alias("bin")))
    counted = (
        reference_join(data, brackets, keys, "inner", spread=["v"])
        .select(*keys, "v", F.explode(each).alias("x"))
        .groupBy(*keys, "x")
        .agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("first"), F.max("v").alias("last"))
    )
    bins = counted.groupBy(*keys, F.col("x.name").alias("name")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("x.bin").alias("bin"), "m", "first", "last"))).alias("bins")  # BINS + 2 at most
    )
    wanted = brackets.select(*keys, F.explode("want").alias("w")).select(
        *keys, "w.name", "w.rank", F.col("w.lo").alias("old_lo"), F.col("w.hi").alias("old_hi")
    )
    upto = F.transform("bins", lambda b, i: F.struct(
        b["first"].alias("first"), b["last"].alias("last"),
        F.aggregate(F.slice("bins", 1, i), F.lit(0).cast("long"), lambda s, c: s + c["m"]).alias("below"), b["m"].alias("m"),
    ))
    holds = lambda b: (b["below"] <= F.ceil("rank")) & (b["below"] + b["m"] > F.floor("rank"))
    found = bins.join(wanted, [*keys, "name"]).withColumn("held", F.filter(upto, holds))
    first, last = F.element_at("held", 1), F.element_at("held", -1)
    return found.select(
        *keys, "name", "rank", first["first"].alias("lo"), last["last"].alias("hi"), first["below"].alias("below"),
        F.aggregate("held", F.lit(0).cast("long"), lambda s, c: s + c["m"]).alias("inside"),
        (~(first["first"].eqNullSafe(F.col("old_lo")) & last["last"].eqNullSafe(F.col("old_hi")))).alias("new"),
    )


def _quantiles(data: DataFrame, keys: list[str], probs: dict[str, float], brackets: DataFrame | None = None) -> DataFrame:
    brackets = first_brackets(data, keys, probs) if brackets is None else brackets
    for _ in range(MOST_ROUNDS):
        narrow = cut(_narrowed(data, keys, stored_and_counted(brackets).table))
        brackets = narrow.groupBy(*keys).agg(F.collect_list(F.struct("name", "rank", "lo", "hi", "below")).alias("want"))
        # A bracket that did not change holds values that bins cannot tell apart.
        many = (F.col("inside") > MOST_VALUES) & (F.col("lo") < F.col("hi")) & F.col("new")
        if narrow.filter(many).isEmpty():
            break
    inside = F.filter("want", lambda w: F.col("v").between(w["lo"], w["hi"]))
    near = reference_join(data, brackets, keys, "inner", spread=["v"]).select(*keys, "v", F.explode(inside).alias("w"))
    upto = W.partitionBy(*keys, "w.name").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    found = (
        near.groupBy(*keys, "w", "v").agg(F.count(F.lit(1)).alias("m"))
        .withColumn("last", F.sum("m").over(upto) + F.col("w.below") - 1)
        .withColumn("first", F.col("last") - F.col("m") + 1)
        .groupBy(*keys, F.col("w.name").alias("name"), F.col("w.rank").alias("rank"))
        .agg(
            F.max(F.when(F.floor("w.rank").between(F.col("first"), F.col("last")), F.col("v"))).alias("a"),
            F.max(F.when(F.ceil("w.rank").between(F.col("first"), F.col("last")), F.col("v"))).alias("b"),
        )
        .withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank")))
    )
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in probs])


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, sample sd, min, quartiles and max of a column per group."""
    data = cut(_values(df, keys, value))
    keys = list(keys) or ["all_rows"]
    basic = data.groupBy(*keys).agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    quart = _quantiles(data, keys, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return basic.join(quart, keys, "left").drop("all_rows")
