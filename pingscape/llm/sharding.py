"""Reproducible shuffle into shards: a Feistel permutation of global row numbers, walked along its cycles.

Only column expressions, aggregates and windows. Row number r of n goes to place p(r), p being a permutation of
0..n-1 that a seed determines; the shard is p mod shards and the slot p div shards, so counts differ by one at most,
slots have no gaps, and the shard and slot of any row number can be computed without the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .frames import stored

ROUNDS = 6
MOST_WALK = 64
ROWS_PER_BUCKET = 20_000


def feistel(x: Column, left: int, right: int, seed: int) -> Column:
    """A permutation of 0 .. left * right - 1: each round adds a hash of one half to the other, modulo its size."""

    def one_round(halves: Column, i: Column) -> Column:
        a, b = halves["a"], halves["b"]
        even = i % 2 == 0
        more = F.xxhash64(F.when(even, b).otherwise(a), F.lit(seed), i)
        moved_a = F.pmod(a + F.pmod(more, F.lit(left)), F.lit(left))
        moved_b = F.pmod(b + F.pmod(more, F.lit(right)), F.lit(right))
        return F.struct(F.when(even, moved_a).otherwise(a).alias("a"), F.when(even, b).otherwise(moved_b).alias("b"))

    rest = F.pmod(x, F.lit(right)).cast("long")
    start = F.struct(((x - rest) / F.lit(right)).cast("long").alias("a"), rest.alias("b"))
    end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one_round)
    return end["a"] * F.lit(right) + end["b"]


def permuted(row: Column, n: int, seed: int) -> Column:
    """Place of a row number under the permutation of 0..n-1 that belongs to (n, seed).

    The Feistel domain is the smallest rectangle of nearly equal sides, so under sqrt(n) + 1 numbers lie outside;
    a place outside is sent through again. MOST_WALK steps are enough for every n up to 4,096 by counting, and beyond
    that a walk outlives them with probability below 2**-384; it would stop the job, not give a wrong place.
    """
    left = max(1, math.isqrt(n - 1) + 1)
    right = -(-n // left)
    steps = max(1, min(left * right - n, MOST_WALK))
    first = feistel(row, left, right, seed)
    place = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), first,
        lambda p, _: F.when(p < F.lit(n), p).otherwise(feistel(p, left, right, seed)),
    )
    return F.when(place < F.lit(n), place).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def row_numbers(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Add `row`, a global number from 0 that the values in `order` determine, without sorting the table as one.

    Rows are dealt by a hash of `order` to buckets of about ROWS_PER_BUCKET; a bucket's numbers begin after all rows
    of the buckets before it. Only bucket counts are summed in one place. Rows equal in `order` are interchangeable.
    """
    buckets = max(1, -(-rows // ROWS_PER_BUCKET))
    dealt = df.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy("bucket").count().select(
        "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")
    )
    within = F.row_number().over(W.partitionBy("bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return (
        dealt.withColumn("within", within).join(offsets, "bucket")
        .withColumn("row", F.col("before") + F.col("within") - 1).drop("bucket", "before", "within")
    )


def shards(documents: DataFrame, count: int = 16, seed: int = 20) -> DataFrame:
    """Deal all rows to `count` shards in a reproducible random order, counts at most one apart.

    Returns doc_id, size (UTF-8 bytes plus 1; 1 for a null text), text_crc32 (0 for null), law, shard, slot and
    grown_shard (null under this law). The row number orders rows by a hash of (doc_id, crc, size), then by these, so
    the result depends on the rows alone and not on their order or partitioning. Null ids are rows like others, rows
    that repeat an id with equal text are interchangeable and get places of their own, an empty table gives an empty
    result, and other columns are not read.
    """
    text = F.col("`text`").cast("string")
    narrow = stored(documents.select(
        F.col("`doc_id`").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).cast("long").alias("text_crc32"),
    ))
    rows = narrow.count()
    numbered = row_numbers(narrow, ["doc_id", "text_crc32", "size"], rows)
    place = permuted(F.col("row").cast("long"), max(1, rows), seed)
    return numbered.withColumn("place", place).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("place", F.lit(count)).cast("int").alias("shard"),
        F.expr(f"place div {int(count)}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
