"""Packing of token pieces into sequences by linear grouping, planned on the counts of lengths alone.

There are at most `size` different lengths, so a plan for any number of pieces needs their counts only. Large lengths
are rounded up within groups of about equal numbers; configurations of these few sizes are chosen by a linear program
with generated columns; the actual pieces take the places of their rounded ones, and everything left over, the small
lengths last, goes where it fits best. The plan is a list of ranges: pieces of a length and a run of ranks, one to
each sequence of a run. Pieces are then ranked within their length and look their range up.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .frames import stored
from .tokens import encoded_chunks

#: Sizes of the rounded problem, the share of a sequence above which a length is large, and most improving columns.
GROUPS, LARGE, MOST_COLUMNS = 64, 1 / 8, 600
ROWS_PER_BUCKET = 1_000


def cut_lengths(total: int, size: int) -> list[int]:
    """A document's pieces: whole if it fits, else the rest first and then full pieces."""
    if total <= size:
        return [total]
    return [total % size] * (total % size > 0) + [size] * (total // size)


def token_pieces(documents: DataFrame, path: str, size: int, end: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids followed by the id `end`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for a, _, tokens, coder, (length, at) in encoded_chunks(batch.column(1), path, keep_ids=True):
                ends = np.cumsum(length, dtype=np.int64)
                ids = coder.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - length), length)]
                stops = np.cumsum(tokens)
                for i, (stop, n) in enumerate(zip(stops.tolist(), tokens.tolist())):
                    own = np.append(ids[stop - n : stop], np.uint32(end)).astype("<u4")
                    start = 0
                    for piece, part in enumerate(cut_lengths(n + 1, size)):
                        out.append((a + i, piece, start, part, zlib.crc32(own[start : start + part].tobytes())))
                        start += part
            rows = pa.array([x[0] for x in out], pa.int64())
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), *[pa.array([x[k + 1] for x in out], kind) for k, kind in enumerate(kinds)]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = documents.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_filling(sizes: np.ndarray, worth: np.ndarray, size: int) -> np.ndarray:
    """How often to take each size so that the worth within one sequence is highest (unbounded knapsack)."""
    best, taken = np.zeros(size + 1), np.full(size + 1, -1)
    for room in range(int(sizes.min()), size + 1):
        fit = np.flatnonzero(sizes <= room)
        gain = best[room - sizes[fit]] + worth[fit]
        k = int(gain.argmax())
        if gain[k] > best[room - 1] + 1e-12:
            best[room], taken[room] = gain[k], fit[k]
        else:
            best[room] = best[room - 1]
    out, room = np.zeros(len(sizes), int), size
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            out[taken[room]] += 1
            room -= int(sizes[taken[room]])
    return out


def configurations(sizes: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of few sizes and how many sequences use each: a linear program, rounded down."""
    k = len(sizes)
    basis = np.diag(size // sizes).astype(float)
    for _ in range(MOST_COLUMNS):
        inverse = np.linalg.inv(basis)
        prices = inverse.sum(0)
        column = best_filling(sizes, np.maximum(prices, 0), size).astype(float)
        if prices @ column <= 1 + 1e-7:
            break
        used, step = inverse @ counts, inverse @ column
        ratio = np.where(step > 1e-9, np.maximum(used, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    used = np.floor(np.linalg.solve(basis, counts.astype(float)) + 1e-9).astype(int)
    return [(basis[:, j].astype(int), int(used[j])) for j in range(k) if used[j] > 0]


class Plan:
    """Ranges (length, first rank, first sequence, count, offset), and sequences in runs with equal room left."""

    def __init__(self, size: int):
        self.size, self.sequences, self.ranges = size, 0, []
        self.room: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []
        self.next_rank: dict[int, int] = {}

    def _leave(self, first: int, count: int, room: int) -> None:
        if count > 0 and room > 0:
            if room not in self.room:
                bisect.insort(self.rooms, room)
                self.room[room] = []
            self.room[room].append((first, count))

    def _put(self, length: int, first: int, count: int, offset: int) -> None:
        self.ranges.append((length, self.next_rank.get(length, 0), first, count, offset))
        self.next_rank[length] = self.next_rank.get(length, 0) + count

    def use(self, slots: list[list[list[int]]]) -> None:
        """New sequences, slot by slot: each slot is a list of [length, count] runs with the same total."""
        edges = sorted({int(e) for runs in slots for e in np.cumsum([c for _, c in runs])})
        at = 0
        for edge in edges:
            offset = 0
            for runs in slots:
                length = runs[0][0]
                self._put(length, self.sequences + at, edge - at, offset)
                offset += length
                runs[0][1] -= edge - at
                if not runs[0][1]:
                    runs.pop(0)
            self._leave(self.sequences + at, edge - at, self.size - offset)
            at = edge
        self.sequences += at

    def best_fit(self, length: int, count: int) -> None:
        """Each of `count` pieces to the sequence with the least room that it fits into."""
        while count:
            k = bisect.bisect_left(self.rooms, length)
            if k == len(self.rooms):
                new = -(-count // (self.size // length))
                self._leave(self.sequences, new, self.size)
                self.sequences += new
                continue
            room = self.rooms[k]
            first, have = self.room[room].pop()
            if not self.room[room]:
                del self.room[room]
                self.rooms.pop(k)
            now = min(have, count)
            self._put(length, first, now, self.size - room)
            self._leave(first, now, room - length)
            self._leave(first + now, have - now, room)
            count -= now


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Ranges that place all pieces; a pure function of the counts of lengths."""
    made, left = Plan(size), dict(counts)
    if left.get(size):
        made.use([[[size, left.pop(size)]]])
    large = sorted((x for x in left if x > size * LARGE), reverse=True)
    total = sum(left[x] for x in large)
    if total:
        groups: list[list[int]] = [[]]
        seen = 0
        for x in large:  # longest first, so a group's first length is what the group is rounded up to
            if groups[-1] and seen >= len(groups) * total / GROUPS:
                groups.append([])
            groups[-1].append(x)
            seen += left[x]
        sizes = np.array([g[0] for g in groups])
        numbers = np.array([sum(left[x] for x in g) for g in groups])

        def take(group: list[int], n: int) -> list[list[int]]:
            runs = []
            for x in group:
                now = min(n, left[x])
                if now:
                    runs.append([x, now])
                    left[x] -= now
                    n -= now
            return runs

        for column, used in configurations(sizes, numbers, size):
            room = numbers.copy()
            with np.errstate(divide="ignore"):
                used = int(min(used, np.min(np.where(column > 0, room // np.maximum(column, 1), used))))
            if used:
                made.use([take(groups[g], used) for g in np.repeat(np.arange(len(groups)), column)])
                numbers = numbers - column * used
    for x in sorted(left, reverse=True):
        if left[x]:
            made.best_fit(x, left[x])
    return made.ranges


def pack(spark: SparkSession, documents: DataFrame, path: str, size: int = 2048, end: int = 0) -> DataFrame:
    """Pack all documents, as token ids followed by `end`, into few sequences of at most `size` tokens.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; pieces of a sequence follow one
    another from offset 0 without gaps. Only documents over `size` are cut, the rest first, then full pieces. A null or
    empty text is the one id `end`. Null ids and repeated rows are documents like others, an empty table gives no
    pieces, and other columns are not read. Only counts per length and ranges come to the driver; their number depends
    on `size`, not on the rows.
    """
    pieces = stored(token_pieces(documents, path, size, end))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    ranges = sorted(plan(counts, size))
    table = np.array(ranges, np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)

    # Ranks within a length: a frequent length is dealt to buckets of about ROWS_PER_BUCKET, each after those before it.
    order = ["doc_id", "piece", "ids_crc32", "start"]
    frequent = {x: -(-n // ROWS_PER_BUCKET) for x, n in counts.items() if n > ROWS_PER_BUCKET}
    known = F.create_map(*[F.lit(v).cast("long") for pair in frequent.items() for v in pair]) if frequent else None
    buckets = F.coalesce(F.element_at(known, F.col("length")), F.lit(1)) if frequent else F.lit(1)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(*order), buckets))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "bucket").count().select(
        "length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")
    )
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    ranked = dealt.withColumn("within", within).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, sequences, _, places = shared.value.T
        keys = lengths * (1 << 48) + firsts
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequences[at] + rank - firsts[at]), pa.array(places[at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
