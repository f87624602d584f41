"""Ordered operators (previous row, position, intervals in sequence) for keys of any size.

A plain ``Window.partitionBy(device)`` puts all rows of a device into one task.  Here a key is
first cut into chunks (an expression of the rows, e.g. the hour), the work is done per
``(key, chunk)`` and what a chunk needs from the others of its key travels in one *carry row* per
chunk.  The rows are read and shuffled once, on ``(key, chunk)``: the carry rows are an aggregate of
the same shuffled rows and come back to them by a join on the same key.  Both readers ask that
shuffle for the same columns, so that Spark makes it once and reuses it; a caller that wants few
columns selects them before.

Chunks by the clock can be uneven.  `even_chunks` counts them and cuts those with too many rows at
quantiles of their time, taken from sketches.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checkpoints import cut
from .joins import reference_join

CHUNK = "chunk"
#: The shuffle key: keys and chunk as one value, in which a null key is a key like others.
AT = "at_chunk"
#: Rows that a chunk may have before `even_chunks` cuts it.
MOST_ROWS = 4_000_000


def hour_chunk(epoch_seconds: Column) -> Column:
    """Chunk of one hour; also a function of the minute, so it may join minute-level keys."""
    return F.floor(epoch_seconds / 3600)


def even_chunks(
    df: DataFrame, keys: list[str], time: str, chunk: Column, most_rows: int = MOST_ROWS
) -> tuple[DataFrame, Column]:
    """A table and a chunk for the functions below, with no chunk of (much) more than `most_rows` rows.

    One job counts the chunks.  If one is too large, a second takes quantiles of `time` in those alone, and the
    chunk becomes (chunk, range of time); the table then has the column `range_cuts`, which the functions drop.  Rows of a
    key at one and the same time stay together, and so do those with a null in the key.
    """
    counted = cut(df.groupBy(*keys, chunk.alias(CHUNK)).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > most_rows))
    most = counted.agg(F.max("rows")).first()[0]
    if most is None:
        return df, chunk
    parts = -(-most // most_rows) + 1
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    large = df.withColumn(CHUNK, chunk).select(*keys, CHUNK, time)
    large = reference_join(large, counted.select(*keys, CHUNK), [*keys, CHUNK], "left_semi", spread=[time])
    ranges = large.groupBy(*keys, CHUNK).agg(F.percentile_approx(time, shares, max(10_000, 8 * parts)).alias("range_cuts"))
    wide = reference_join(df.withColumn(CHUNK, chunk), ranges, [*keys, CHUNK], "left", spread=[time])
    part = F.size(F.filter("range_cuts", lambda c: c < F.col(time)))
    return wide.drop(CHUNK), F.struct(chunk.alias("chunk"), F.when(F.col("range_cuts").isNotNull(), part).otherwise(0).alias("part"))


class _Dealt:
    """Rows shuffled on (keys, chunk), the one exchange that rows and carry rows are made from."""

    def __init__(self, df: DataFrame, keys: list[str], chunk: Column):
        self.keys, self.rest = keys, [c for c in df.columns if c not in keys and c not in ("range_cuts", CHUNK)]
        self.rows = df.select(F.struct(*keys, chunk.alias(CHUNK)).alias(AT), *self.rest).repartition(AT)
        self.along = W.partitionBy(*[F.col(f"{AT}.{k}") for k in keys]).orderBy(F.col(f"{AT}.{CHUNK}"))

    def within(self, *order: Column) -> W:
        return W.partitionBy(AT).orderBy(*order)

    def edge(self, order: list[str], pick, known: Column | None = None) -> Column:
        """One whole row of a chunk, the last or the first of those where `known` holds, or of all."""
        by = F.struct(*order)
        return pick(F.struct(AT, *self.rest), by if known is None else F.when(known, by))

    def count(self) -> Column:
        """The number of rows, from all their columns: a plain count would ask the shuffle for fewer."""
        plain = [f.name for f in self.rows.schema if not isinstance(f.dataType, T.MapType)]
        h = F.xxhash64(*plain)
        return F.count(F.when(h >= 0, 1)) + F.count(F.when(h < 0, 1))

    def carried(self, lagged: DataFrame, carry: DataFrame) -> DataFrame:
        return lagged.join(carry, AT, "left")

    def whole(self, rows: DataFrame, *more: Column) -> DataFrame:
        """The columns of the table, the chunk and more."""
        return rows.select(*[F.col(f"{AT}.{k}").alias(k) for k in self.keys], *self.rest, F.col(f"{AT}.{CHUNK}").alias(CHUNK), *more)


def beside(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None, position: str | None = None,
) -> DataFrame:
    """Add values of the previous and of the following row of the same key, and the 0-based position in it.

    `previous` and `following` are {new column: column}.  The chunk must not decrease along `order`.  The result has
    the column `chunk`.
    """
    dealt = _Dealt(df, keys, chunk)
    previous, following = previous or {}, following or {}
    edges = {}
    if previous:
        edges["last_row"] = dealt.edge(order, F.max_by)
    if following:
        edges["first_row"] = dealt.edge(order, F.min_by)
    if position:
        edges["rows"] = dealt.count()
    rows = dealt.within(*[F.col(c) for c in order])
    inside, carry, out = {}, [], {}
    if previous:
        inside["first_in_chunk"] = F.lag(F.lit(1)).over(rows).isNull()
        carry.append(F.lag("last_row").over(dealt.along).alias("carried_before"))
    if following:
        inside["last_in_chunk"] = F.lead(F.lit(1)).over(rows).isNull()
        carry.append(F.lead("first_row").over(dealt.along).alias("carried_after"))
    for name, c in previous.items():
        inside[f"own_{name}"] = F.lag(c).over(rows)
        out[name] = F.when(F.col("first_in_chunk"), F.col(f"carried_before.{c}")).otherwise(F.col(f"own_{name}"))
    for name, c in following.items():
        inside[f"own_{name}"] = F.lead(c).over(rows)
        out[name] = F.when(F.col("last_in_chunk"), F.col(f"carried_after.{c}")).otherwise(F.col(f"own_{name}"))
    if position:
        inside["own_position"] = F.row_number().over(rows)
        carry.append(F.sum("rows").over(dealt.along.rowsBetween(W.unboundedPreceding, -1)).alias("offset"))
        out[position] = (F.col("own_position") + F.coalesce("offset", F.lit(0)) - 1).cast("long")
    carries = dealt.rows.groupBy(AT).agg(*[c.alias(n) for n, c in edges.items()]).select(AT, *carry)
    both = dealt.carried(dealt.rows.withColumns(inside), carries)
    return dealt.whole(both, *[c.alias(n) for n, c in out.items()])


def previous_row(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: list[str],
    chunk: Column,
    prefix: str = "prev_",
    step: int = 1,
) -> DataFrame:
    """Add `prefix + v`: the value of v in the previous row of the same key (step = -1: next row).

    The chunk must not decrease along `order`.  The result has the column `chunk`.
    """
    wanted = {prefix + v: v for v in values}
    return beside(df, keys, order, chunk, **({"previous": wanted} if step > 0 else {"following": wanted}))


def next_known(
    df: DataFrame, keys: list[str], order: list[str], value: str, chunk: Column, out: str
) -> DataFrame:
    """Add `out`: the first known `value` at this row or after it (null if none follows)."""
    dealt = _Dealt(df, keys, chunk)
    firsts = dealt.rows.groupBy(AT).agg(dealt.edge(order, F.min_by, F.col(value).isNotNull()).alias("first_row"))
    after = dealt.along.rowsBetween(1, W.unboundedFollowing)
    carry = firsts.select(AT, F.first(F.col(f"first_row.{value}"), ignorenulls=True).over(after).alias("carried_after"))
    back = dealt.within(*[F.col(c).desc() for c in order]).rowsBetween(W.unboundedPreceding, 0)
    seen = dealt.rows.withColumn("own_next", F.last(value, ignorenulls=True).over(back))
    return dealt.whole(dealt.carried(seen, carry), F.coalesce("own_next", "carried_after").alias(out)).drop(CHUNK)


def with_position(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str = "pos"
) -> DataFrame:
    """Add the 0-based position of each row within its key (and the column `chunk`)."""
    return beside(df, keys, order, chunk, position=name)


def _with_carry(df: DataFrame, carry: DataFrame) -> DataFrame:
    """Rows of df (own = 1) plus carry rows (own = 0, sorting first in their chunk)."""
    return df.withColumn("own", F.lit(1)).unionByName(
        carry.withColumn("own", F.lit(0)), allowMissingColumns=True
    )


def with_halo(df: DataFrame, pos: str, block_size: int, halo: int) -> DataFrame:
    """Cut positions into blocks; rows within `halo` of a block edge also go to the neighbour block.

    Adds `block` and `inner` (true for the row's home block).  Windows of up to `halo` rows on each
    side are then complete inside (key, block).
    """
    home = F.floor(F.col(pos) / block_size).cast("long")
    first = F.floor((F.col(pos) - halo) / block_size).cast("long")
    last = F.floor((F.col(pos) + halo) / block_size).cast("long")
    return df.withColumn(
        "block", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), last))
    ).withColumn("inner", F.col("block") == home)


def merge_in_sequence(
    df: DataFrame, keys: list[str], block: str, pos: str, start: str, end: str
) -> DataFrame:
    """Merge intervals in position order: a new group starts where `start` is after every earlier end.

    Returns one row per group: keys, group_no (0-based), first_pos, last_pos.  Members are the input
    rows whose position lies between them.  The block must not decrease along the position.  Groups
    inside a block come first; the latest end and the number of groups before a block reach it in
    carry rows, so a window over a key sees one row per block.
    """
    earlier = W.unboundedPreceding, -1
    by_pos = W.partitionBy(*keys, block).orderBy(pos)
    local = cut(
        df.withColumn("seen_end", F.max(end).over(by_pos.rowsBetween(*earlier)))
        .withColumn("fresh", _after(start, "seen_end"))
        .withColumn("local_no", F.sum("fresh").over(by_pos.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, block, "local_no")
        .agg(
            F.min_by(start, pos).alias("first_start"),
            F.max(end).alias("last_end"),
            F.min(pos).alias("lo"),
            F.max(pos).alias("hi"),
        )
        .drop("local_no")
    )
    by_block = W.partitionBy(*keys).orderBy(block).rowsBetween(*earlier)
    by_lo = W.partitionBy(*keys, block).orderBy("own", "lo")
    ends = local.groupBy(*keys, block).agg(F.max("last_end").alias("block_end"))
    carry = ends.select(*keys, block, F.max("block_end").over(by_block).alias("last_end"))
    started = (
        _with_carry(local, carry)
        .withColumn("seen_end", F.max("last_end").over(by_lo.rowsBetween(*earlier)))
        .filter("own = 1")
        .select(*keys, block, "lo", "hi", _after("first_start", "seen_end").alias("fresh"))
    )
    counts = started.groupBy(*keys, block).agg(F.sum("fresh").alias("groups"))
    offsets = counts.select(*keys, block, F.coalesce(F.sum("groups").over(by_block), F.lit(0)).alias("offset"))
    number = F.sum(F.coalesce("offset", "fresh")).over(by_lo.rowsBetween(W.unboundedPreceding, 0)) - 1
    return (
        _with_carry(started, offsets)
        .withColumn("group_no", number)
        .filter("own = 1")
        .groupBy(*keys, "group_no")
        .agg(F.min("lo").alias("first_pos"), F.max("hi").alias("last_pos"))
    )


def _after(start: str, seen_end: str) -> Column:
    """1 where an interval starts after every earlier end, or none is earlier."""
    return (F.col(seen_end).isNull() | (F.col(start) > F.col(seen_end))).cast("int")


def pair_toggles(
    df: DataFrame, keys: list[str], time: str, order: list[str], chunk: Column
) -> DataFrame:
    """Alternate rows of a key as start and end: even positions start, the next row ends.

    A key with an odd number of rows keeps its last start with a null end; other keys are untouched.
    """
    ordered = beside(df, keys, order, chunk, following={"next_time": time}, position="pos")
    return ordered.filter(F.col("pos") % 2 == 0).select(*keys, F.col(time).alias("start"), F.col("next_time").alias("end"))
