"""Joins that stay even when one key holds a large share of the rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import stored_and_counted

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16


def salted_join(
    facts: DataFrame, dim: DataFrame, on: list[str], how: str = "inner", spread: list[str] | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join on few, possibly hot keys: each key of `facts` is split over `salts` tasks.

    The dimension is repeated once per salt.  `spread` names the columns that choose the salt
    (all columns of facts outside the key by default).  `how` is inner, left, left_semi or left_anti.
    """
    spread = spread or [c for c in facts.columns if c not in on]
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    left = facts.withColumn("salt", salt)
    right = dim.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "salt"], how).drop("salt")


def fits_broadcast(dim: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Check the size of a reference table: its rows and the length of its content as text.

    At most max_rows + 1 rows are looked at; one row of two numbers comes back.
    """
    size = F.length(F.to_json(F.struct(*dim.columns)))
    rows, length = dim.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    return rows <= max_rows and (length or 0) <= max_bytes


def reference_join(
    facts: DataFrame, dim: DataFrame, on: list[str], how: str = "inner", spread: list[str] | None = None,
    max_rows: int = MAX_BROADCAST_ROWS, salts: int | None = None,
) -> DataFrame:
    """Join a reference table: broadcast when its measured size allows it, salted join beyond.

    The table is stored first, and counted while it is written, so that counting and joining do not derive it twice.
    """
    dim, rows, length = stored_and_counted(dim)
    if rows <= max_rows and length <= MAX_BROADCAST_BYTES:
        return facts.join(F.broadcast(dim), on, how)
    return salted_join(facts, dim, on, how, spread, salts or SALTS)


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by `order`; an aggregate with map-side combine, not a window."""
    rest = [c for c in df.columns if c not in keys]
    ranked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return ranked.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def alias_table(units: DataFrame, name: str, variants: str) -> DataFrame:
    """(alias, name, priority): the name itself has priority -1, bar-separated variants 0, 1, ..."""
    own = units.select(F.col(name).alias("alias"), F.col(name).alias(name), F.lit(-1).alias("priority"))
    others = units.select(
        F.col(name), F.posexplode(F.split(F.col(variants), r"\|")).alias("priority", "alias")
    )
    return own.unionByName(others.select("alias", name, "priority"))


def alias_join(df: DataFrame, label: str, units: DataFrame, name: str, variants: str) -> DataFrame:
    """Left join of a label to a unit's name or any of its variants; the latest variant wins."""
    wanted = df.select(F.col(label).alias("alias")).distinct()
    best = (
        alias_table(units, name, variants)
        .join(wanted, "alias", "left_semi")
        .groupBy("alias")
        .agg(F.max_by(name, F.struct(F.col("priority"), F.col(name))).alias(name))
        .withColumnRenamed("alias", label)
    )
    return reference_join(df, best, [label], "left")


def map_values(df: DataFrame, column: str, pairs: DataFrame, out: str) -> DataFrame:
    """Look a column up in a (key, value) table; null where the key is missing."""
    lookup = pairs.select(F.col("key").alias(column), F.col("value").alias(out))
    return reference_join(df, lookup, [column], "left")


def full_merge(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Full outer merge with a code: 1 only left, 2 only right, 3 both."""
    a = left.withColumn("in_left", F.lit(1))
    b = right.withColumn("in_right", F.lit(2))
    code = F.coalesce("in_left", F.lit(0)) + F.coalesce("in_right", F.lit(0))
    return a.join(b, on, "full").withColumn("merge_code", code).drop("in_left", "in_right")


def join_coalesced(left: DataFrame, right: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Left join in which columns of both sides become one: the left value, or where it is missing the right."""
    named = right.withColumnsRenamed({c: f"{c}_right" for c in columns})
    joined = left.join(named, on, "left")
    return joined.withColumns({c: F.coalesce(c, f"{c}_right") for c in columns}).drop(*[f"{c}_right" for c in columns])
