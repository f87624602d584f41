"""Resampling: all repetitions are rows of one job, drawn by hashing (repetition, draw).

The same hash gives the same draws on any cluster and after any retry.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed_values import RESAMPLES, SUBSAMPLE_ROWS
from .checkpoints import stored_and_counted
from .joins import reference_join
from .ordered import CHUNK, with_position


def draw_number(rep: Column, draw: Column) -> Column:
    """32-bit number from the text "rep-draw"."""
    text = F.concat_ws("-", rep.cast("string"), draw.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def indexed(rows: DataFrame, order: list[str], chunk: Column) -> DataFrame:
    """Rows with idx 0 .. n-1 in the given order; `chunk` must not decrease along it."""
    return with_position(rows.withColumn("series", F.lit(1)), ["series"], order, chunk, "idx").drop(
        CHUNK, "series"
    )


def _draws(rows: DataFrame, n: int, reps: int) -> DataFrame:
    ids = rows.sparkSession.range(reps * n)
    return ids.select(
        (F.floor(F.col("id") / n) + 1).cast("long").alias("rep"), (F.col("id") % n).alias("draw")
    )


def bootstrap_sums(rows: DataFrame, values: list[str], reps: int = RESAMPLES) -> DataFrame:
    """Sums of n draws with replacement per repetition; `rows` carry idx 0 .. n-1."""
    n = rows.count()
    drawn = _draws(rows, n, reps).withColumn("idx", draw_number(F.col("rep"), F.col("draw")) % n)
    picked = reference_join(drawn, rows.select("idx", *values), ["idx"], "inner", spread=["rep", "draw"])
    return picked.groupBy("rep").agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in values])


def cluster_bootstrap_sums(rows: DataFrame, cluster: str, values: list[str], reps: int = RESAMPLES) -> DataFrame:
    """Draw whole clusters with replacement, as many as there are; clusters are summed first."""
    sums = rows.groupBy(cluster).agg(*[F.sum(v).alias(v) for v in values])
    # few clusters (periods, months): one chunk is enough to number them
    return bootstrap_sums(indexed(sums, [cluster], F.lit(0)), values, reps)


def subsample(n: int, drawn: DataFrame, size: int, spare: float = 12.0) -> DataFrame:
    """(rep, idx, h): the `size` rows of each repetition with the smallest hashes; `drawn` has every (rep, idx, h).

    Only rows below a threshold are ranked.  It is set so that a repetition has `size` rows and a margin of `spare` standard
    deviations below it; should one have fewer than `size`, all of its rows are ranked.
    """
    order = W.partitionBy("rep").orderBy("h", "idx")

    def smallest(rows: DataFrame) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)

    share = (size + spare * size**0.5 + spare) / max(n, 1)
    if share >= 1:
        return smallest(drawn)
    below = drawn.filter(F.col("h") < int(share * 2**32))
    enough = below.groupBy("rep").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= size).select("rep")
    short = stored_and_counted(drawn.select("rep").distinct().join(enough, "rep", "left_anti"))
    if not short.rows:
        return smallest(below)
    rest = reference_join(drawn, short.table, ["rep"], "left_semi", spread=["idx"])
    return smallest(below.join(enough, "rep", "left_semi")).unionByName(smallest(rest))


def subsample_sums(rows: DataFrame, values: list[str], size: int = SUBSAMPLE_ROWS, reps: int = RESAMPLES) -> DataFrame:
    """Sums of `size` rows per repetition, drawn without replacement."""
    n = rows.count()
    drawn = _draws(rows, n, reps).withColumnRenamed("draw", "idx").withColumn("h", draw_number(F.col("rep"), F.col("idx")))
    picked = reference_join(subsample(n, drawn, size), rows.select("idx", *values), ["idx"], "inner", spread=["rep"])
    return picked.groupBy("rep").agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in values])


def rates(sums: DataFrame, values: list[str], base: str = "civcas") -> DataFrame:
    return sums.select("rep", *[F.try_divide(v, base).alias(f"{v}_rate") for v in values])
