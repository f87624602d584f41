"""Hard negatives of anchors by vertical scans of vectors (BOND: branch and bound on decomposed data).

Blocks of vectors lie column by column. For an anchor the columns are read by descending size of its own components;
after every few columns the sum so far plus the least and the most that the columns left can still add (from each
column's smallest and largest value in the block) bounds every score from both sides, and a vector that can no longer
fall into what is asked for leaves the bitmap of candidates. What stays is computed in whole numbers.

Two searches work like this: the best vectors of the anchor's own label (positives), then, of the other labels, the
best whose scores lie in the window that each positive's score allows. Blocks of anchors and bands of vectors form a
grid of tasks: a task holds one block of anchors and streams the blocks of its band, so a vector is sent as often as
there are blocks of ANCHOR_ROWS anchors, and never once per anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .frames import stored, tasks
from .topk import _matrix

BLOCK_ROWS, ANCHOR_ROWS, BAND_ROWS = 4096, 8192, 1 << 18
#: Columns read between two looks at the bitmap.
COLUMNS = 8
NONE = -(2**62)


def labelled_vectors(vectors: DataFrame, scale: int, shift_every: int, labels: int) -> DataFrame:
    """(vec_id, label, v), one row per vec_id; where vec_id is divisible by `shift_every` the label moves one on."""
    vec_id, label, x = F.col("`vec_id`").cast("long"), F.col("`label`").cast("long"), F.col("`embedding`").cast("array<double>")
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    moved = F.when(vec_id % shift_every == 0, (label + 1) % labels).otherwise(label)
    rows = vectors.select(vec_id.alias("vec_id"), moved.alias("label"), x.alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & good)
    whole = F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", whole.alias("v"))).alias("row"))
    return rows.select("vec_id", "row.label", "row.v")


class Block:
    """Vectors as columns, with the smallest and largest value of each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels, self.rows = ids, labels, rows
        self.columns = np.ascontiguousarray(rows.T).astype(float)
        self.low, self.high = self.columns.min(1), self.columns.max(1)


def vertical_scan(query: np.ndarray, block: Block, alive: np.ndarray, least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the rows `alive` whose inner product with `query` lies within [least, most]."""
    q = query.astype(float)
    order = np.argsort(-np.abs(q), kind="stable")
    smallest, largest = np.minimum(q * block.low, q * block.high), np.maximum(q * block.low, q * block.high)
    size = np.abs(q) * np.maximum(np.abs(block.low), np.abs(block.high))
    slack = 0.5 + 1e-9 * float(size.sum())
    sums = np.zeros(len(alive))
    for a in range(0, len(order), COLUMNS):
        now, left = order[a : a + COLUMNS], order[a + COLUMNS :]
        if len(alive) == 0 or (least == -np.inf and most == np.inf):
            break
        own = block.columns[now][:, alive] if len(alive) < len(block.ids) else block.columns[now]
        sums = sums + q[now] @ own
        can = (sums + largest[left].sum() + slack >= least) & (sums + smallest[left].sum() - slack <= most)
        if not can.all():
            alive, sums = alive[can], sums[can]
    scores = block.rows[alive] @ query
    good = (scores >= least) & (scores <= most)
    return alive[good], scores[good]


class Best:
    """The k best scores found so far under a name, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> float:
        """What a score must reach to count."""
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        top = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[top], scores[top]


class Positives:
    """The best vectors of an anchor's own label."""

    def __init__(self, anchor: dict, k: int, **_):
        self.id, self.label, self.v = anchor["vec_id"], anchor["label"], np.array(anchor["v"], np.int64)
        self.best = Best(k)

    def look(self, block: Block) -> None:
        alive = np.flatnonzero((block.labels == self.label) & (block.ids != self.id))
        if len(alive):
            rows, scores = vertical_scan(self.v, block, alive, self.best.least(), np.inf)
            self.best.add(block.ids[rows], scores)

    def found(self) -> Iterator[tuple]:
        for i, s in zip(self.best.ids.tolist(), self.best.scores.tolist()):
            yield self.id, i, s, None, None


class Negatives:
    """For each of an anchor's positives the best vectors of other labels with a score in its window."""

    def __init__(self, anchor: dict, k: int, low: int, high: int):
        self.id, self.label, self.v = anchor["vec_id"], anchor["label"], np.array(anchor["v"], np.int64)
        self.windows = []
        for p in anchor["positives"]:
            first, last = -(-low * p["score"] // 100), high * p["score"] // 100  # whole scores within the bounds
            if first <= last:
                self.windows.append((p["vec_id"], p["score"], first, last, Best(k)))

    def look(self, block: Block) -> None:
        if not self.windows:
            return
        alive = np.flatnonzero(block.labels != self.label)
        least = min(max(first, best.least()) for _, _, first, _, best in self.windows)
        rows, scores = vertical_scan(self.v, block, alive, least, max(last for _, _, _, last, _ in self.windows))
        for _, _, first, last, best in self.windows:
            own = (scores >= max(first, best.least())) & (scores <= last)
            if own.any():
                best.add(block.ids[rows[own]], scores[own])

    def found(self) -> Iterator[tuple]:
        for positive, score, _, _, best in self.windows:
            for i, s in zip(best.ids.tolist(), best.scores.tolist()):
                yield self.id, i, s, positive, score


FOUND = "anchor_id long, vec_id long, score long, positive_id long, positive_score long"


def scanned(vectors: DataFrame, anchors: DataFrame, width: int, task: Callable, counts: tuple[int, int], **said) -> DataFrame:
    """What `task` (Positives or Negatives) finds for every anchor in every band of vectors.

    `vectors` and `anchors` have vec_id, label, v and positives (null for vectors). The grid has one line for every
    ANCHOR_ROWS anchors and a column for every BAND_ROWS vectors, or more columns if there are fewer tasks otherwise.
    """
    many, asked = counts
    lines = max(1, -(-asked // ANCHOR_ROWS))
    bands = max(1, -(-many // BAND_ROWS), min(-(-tasks(vectors) // lines), -(-many // BLOCK_ROWS)))
    columns = ["vec_id", "label", "v", "positives"]
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    line, band = (spread % lines).cast("int"), (spread % bands).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    first = anchors.select(line.alias("line"), every(bands).alias("band"), F.lit(0).alias("part"), *columns)
    then = vectors.select(every(lines).alias("line"), band.alias("band"), F.lit(1).alias("part"), *columns)
    cells = first.unionByName(then)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, waiting, n = None, [], [], 0

        def look(all_of_it: bool) -> None:
            nonlocal waiting, n
            ids, kinds, rows = (np.concatenate(x) for x in zip(*waiting)) if waiting else ((), (), ())
            while n >= BLOCK_ROWS or (n and all_of_it):
                block = Block(ids[:BLOCK_ROWS], kinds[:BLOCK_ROWS], rows[:BLOCK_ROWS])
                for h in held:
                    h.look(block)
                ids, kinds, rows = ids[BLOCK_ROWS:], kinds[BLOCK_ROWS:], rows[BLOCK_ROWS:]
                n = len(ids)
            waiting = [(ids, kinds, rows)] if n else []

        def results() -> Iterator[pa.RecordBatch]:
            look(True)
            out = [x for h in held for x in h.found()]
            for a in range(0, len(out), 1 << 16):
                columns = list(zip(*out[a : a + (1 << 16)]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in FOUND.split(", ")])

        for batch in batches:
            line, at, part = (batch.column(i).to_numpy() for i in range(3))
            begin = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (at[1:] != at[:-1]) | (part[1:] != part[:-1]))[: len(line)])
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(line)]):
                if (line[a], at[a]) != cell:
                    yield from results()
                    cell, held = (line[a], at[a]), []
                run = batch.slice(a, b - a)
                if part[a] == 0:
                    matrix = _matrix(run.column(5), width)
                    said_rows = zip(run.column(3).to_pylist(), run.column(4).to_pylist(), matrix, run.column(6).to_pylist())
                    held += [task({"vec_id": i, "label": k, "v": v, "positives": p}, **said) for i, k, v, p in said_rows]
                elif held:
                    waiting.append((run.column(3).to_numpy(), run.column(4).to_numpy(), _matrix(run.column(5), width)))
                    n += b - a
                    if n >= BLOCK_ROWS:
                        look(False)
        yield from results()

    dealt = cells.repartition("line", "band").sortWithinPartitions("line", "band", "part")
    return dealt.mapInArrow(search, FOUND)


def hard_negatives(
    spark: SparkSession, vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30,
    high: int = 90, scale: int = 256, shift_every: int = 7, labels: int = 10,
) -> DataFrame:
    """For each anchor and positive the best vectors of other labels whose scores lie within low % and high % of the positive's.

    Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score). Anchors are the rows whose
    vec_id is divisible by `every`; their positives the first `positives` other rows of the same label. Scores are
    inner products of floor(scale * x); higher ones come first, ties by smaller vec_id. Where vec_id is divisible by
    `shift_every`, the label counts as (label + 1) % labels. Rows with a null id, label or vector, or a null or
    non-finite component, take no part. Rows that repeat a vec_id are one row, that of the smallest label and then the
    smallest vector in array order. A shorter vector counts as filled up with zeros. Anchors without positives, and
    positives without negatives in their window (a negative positive_score allows none), give no rows. Empty tables,
    or none left, give an empty result. Scores must fit 64-bit numbers. Other columns are not read.
    """
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    none = F.lit(None).cast("array<struct<vec_id:long,score:long>>")
    rows = stored(labelled_vectors(vectors, scale, shift_every, labels)).withColumn("positives", none)
    anchor = F.col("vec_id") % every == 0
    width, many, asked = rows.agg(F.max(F.size("v")), F.count(F.lit(1)), F.count(F.when(anchor, 1))).first()
    if not width or not asked:
        return spark.createDataFrame([], kind)
    # Rows of equal vec_id share a band, so a band's best are enough; anchors without their positives come back by id.
    found = scanned(rows, rows.filter(anchor), width, Positives, (many, asked), k=positives)
    order = W.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= positives)
    best = best.groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("best"))  # `positives` at most
    asking = stored(rows.drop("positives").join(best.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumnRenamed("best", "positives"))
    found = scanned(rows, asking, width, Negatives, (many, asked), k=negatives, low=low, high=high)
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
