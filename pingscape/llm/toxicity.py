"""Toxicity by non-negative positive-unlabelled learning on the words of a text.

Known are confirmed toxic texts and unlabelled ones. With the share of toxic texts `prior`, the risk of a classifier
is prior * (toxic texts called clean) plus the unlabelled texts called toxic less the part of these that really is
toxic; the latter difference is a risk and cannot be negative, so where it falls below zero the step is turned round
(the non-negative estimator). The classifier is logistic on the presence of words, trained in numpy on the driver from
bounded samples; the words it looks at are those whose frequencies differ most between the two samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import key_of, stored
from .words import LETTERS, Words, as_long, chunks

#: Bounds of what is gathered for training: toxic texts, unlabelled texts, words.
TOXIC_ROWS, UNLABELLED_ROWS, FEATURES = 4000, 12000, 2048
STEPS, RATE, DECAY = 400, 0.05, 1e-4
LOOKUP_BITS = 16
BLOCK_ROWS = 2048


def held_out(doc_id: str = "doc_id", folds: int = 5) -> F.Column:
    """Rows whose labels are never learnt from: crc32 of the id as text (empty for null) is a multiple of `folds`."""
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))) % folds == 0


def _distinct(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, rows, words) of the distinct words of every text of a chunk."""
    for a, b, data, offsets in chunks(batch.column(text)):
        words = Words(data, offsets, LETTERS)
        row = words.row_of()
        order = np.lexsort((words.h, row))
        row, h = row[order], words.h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield a, b, row[new], h[new]


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text) of at most TOXIC_ROWS confirmed toxic texts and UNLABELLED_ROWS texts, by the order of a hash."""
    ours = ~held_out()
    order = [F.xxhash64("doc_id", F.lit(10)), F.col("doc_id")]
    known = labels.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`toxic`").cast("int").alias("toxic"))
    toxic = known.filter((F.col("toxic") == 1) & ours).select("doc_id").distinct().orderBy(*order).limit(TOXIC_ROWS)
    some = docs.select("doc_id").filter(ours & F.col("doc_id").isNotNull()).distinct().orderBy(*order).limit(UNLABELLED_ROWS)
    chosen = toxic.withColumn("toxic", F.lit(True)).unionByName(some.withColumn("toxic", F.lit(False)))
    rows = docs.join(F.broadcast(chosen), "doc_id")  # ids of bounded samples
    return rows.groupBy("toxic", "doc_id").agg(F.min("text").alias("text")).select("toxic", "text")  # one text per id


def word_shares(rows: DataFrame) -> DataFrame:
    """(word, in_toxic, in_unlabelled): the number of sampled texts of each kind that hold a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for a, _, row, h in _distinct(batch, 1):
                word, back = np.unique(h, return_inverse=True)
                is_toxic = toxic[a + row]
                yield pa.RecordBatch.from_arrays(
                    [
                        as_long(word), pa.array(np.bincount(back, is_toxic, len(word)).astype(np.int64)),
                        pa.array(np.bincount(back, ~is_toxic, len(word)).astype(np.int64)),
                    ],
                    names=["word", "in_toxic", "in_unlabelled"],
                )

    each = rows.mapInArrow(count, "word long, in_toxic long, in_unlabelled long")
    return each.groupBy("word").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_unlabelled").alias("in_unlabelled"))


class Features:
    """Which of a sorted list of word hashes a text holds."""

    def __init__(self, words: np.ndarray):
        self.words = np.sort(words)
        self.maybe = np.zeros(1 << LOOKUP_BITS, bool)
        self.maybe[(self.words >> np.uint64(64 - LOOKUP_BITS)).astype(np.int64)] = True

    def found(self, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = np.flatnonzero(self.maybe[(h >> np.uint64(64 - LOOKUP_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, h[some]), max(0, len(self.words) - 1))
        hit = self.words[at] == h[some] if len(self.words) else np.zeros(len(some), bool)
        return row[some][hit], at[hit]


def sampled_features(rows: DataFrame, features: Features) -> tuple["Ones", "Ones"]:
    """0/1 matrices of the toxic and the unlabelled texts: bounded by the sample and the number of words."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros((batch.num_rows, len(features.words)), bool)
            for a, _, row, h in _distinct(batch, 1):
                r, f = features.found(row, h)
                bits[a + r, f] = True
            packed = [x.tobytes() for x in np.packbits(bits, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["toxic", "bits"])

    out = rows.mapInArrow(look, "toxic boolean, bits binary").toArrow()
    bits = np.frombuffer(b"".join(out.column("bits").to_pylist()), np.uint8).reshape(out.num_rows, -1)
    flags = out.column("toxic").to_numpy().astype(bool)
    return Ones(bits[flags], len(features.words)), Ones(bits[~flags], len(features.words))


class Ones:
    """A 0/1 matrix, given as packed bits, by the places of its ones in blocks of rows.

    Texts hold few of the words, so this is much smaller than the numbers; at worst it is two bytes a place and row.
    """

    def __init__(self, bits: np.ndarray, width: int):
        self.rows, self.width, self.blocks = len(bits), width, []
        for a in range(0, self.rows, BLOCK_ROWS):
            row, column = np.nonzero(np.unpackbits(bits[a : a + BLOCK_ROWS], axis=1, count=width))
            self.blocks.append((slice(a, min(a + BLOCK_ROWS, self.rows)), row.astype(np.uint16), column.astype(np.uint16)))

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Per row the sum of the weights of its ones."""
        out = np.zeros(self.rows)
        for at, row, column in self.blocks:
            out[at] = np.bincount(row, weights[column], at.stop - at.start)
        return out

    def across(self, slopes: np.ndarray) -> np.ndarray:
        """Per column the sum of the slopes of the rows with a one."""
        out = np.zeros(self.width)
        for at, row, column in self.blocks:
            out += np.bincount(column, slopes[at][row], self.width)
        return out


def train(toxic: Ones | np.ndarray, unlabelled: Ones | np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative positive-unlabelled risk with the logistic loss (Adam)."""
    p, u = (x if isinstance(x, Ones) else Ones(np.packbits(x.astype(bool), axis=1), x.shape[1]) for x in (toxic, unlabelled))
    w, b = np.zeros(p.width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        zp, zu = p.times(w) + b, u.times(w) + b
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # Slopes of the loss in z: calling toxic texts clean, and the corrected risk of calling clean texts toxic.
        slope_p, slope_u = -prior * (1 - sp) / p.rows, np.zeros_like(su)
        if clean >= 0:
            slope_p, slope_u = slope_p - prior * sp / p.rows, su / u.rows
        else:
            slope_p, slope_u = prior * sp / p.rows, -su / u.rows
        g = np.append(p.across(slope_p) + u.across(slope_u) + DECAY * w, slope_p.sum() + slope_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], float(b - step[-1])
    return w, b


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(words, weights, bias), or None without confirmed toxic texts or unlabelled ones."""
    known = labels.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`toxic`").cast("int").alias("toxic"))
    toxic, labelled = known.filter(~held_out()).agg(F.sum(F.when(F.col("toxic") == 1, 1)), F.count("toxic")).first()
    if not toxic:
        return None
    prior = min(0.9, max(0.001, toxic / labelled))
    rows = stored(sample(docs, labels))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    a, b = F.col("in_toxic") / sizes[True], F.col("in_unlabelled") / sizes[False]
    both = (F.col("in_toxic") + F.col("in_unlabelled")) / (sizes[True] + sizes[False])
    unlike = F.abs(a - b) / F.sqrt(both * (1 - both) + 1e-4)
    words = word_shares(rows).filter(F.col("in_toxic") + F.col("in_unlabelled") >= 5).orderBy(F.desc(unlike), "word").limit(FEATURES)
    features = Features(np.array([r["word"] for r in words.select("word").collect()], np.int64).view(np.uint64))
    weights, bias = train(*sampled_features(rows, features), prior)
    return features.words, weights, bias


def toxicity(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of whole texts: (doc_id, text_key, held_out, score, predicted), one row per input row.

    Labels are read from rows that are not held out alone; a doc_id with several labels is toxic if one says so, null
    labels and ids say nothing. Scores come from the text only. Null and empty texts get the score of a text without
    any of the words; without a single confirmed toxic text all scores are 0. Null ids and repeated rows are scored
    like others, and an empty table gives an empty result. Other columns are not read.
    """
    docs = key_of(documents).select("doc_id", "text", "text_key")
    model = spark.sparkContext.broadcast(fitted(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.value[0]) if model.value else None
        for batch in batches:
            z = np.full(batch.num_rows, model.value[2] if model.value else -np.inf)
            for a, b, row, h in _distinct(batch, 1) if model.value else ():
                r, f = features.found(row, h)
                z[a:b] += np.bincount(r, model.value[1][f], b - a)
            s = 1 / (1 + np.exp(-np.clip(z, -700, 700))) if model.value else np.zeros(len(z))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                names=["doc_id", "text_key", "held_out", "score", "predicted"],
            )

    return docs.withColumn("held_out", held_out()).mapInArrow(
        score, "doc_id long, text_key long, held_out boolean, score double, predicted int"
    )
