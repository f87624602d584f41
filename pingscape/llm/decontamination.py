"""Benchmark decontamination: a prefix-filtered set join of item windows with the shingles of documents.

A window occurs in a document only if all its shingles do, so for containment of a whole window one prefix token is
necessary, and the rarest is joined. Documents are read twice: once to count the shingles of the benchmark, which
orders them by rarity, and once for the places of the prefix tokens, with the words around them. The join on the token
is bounded by position and length, and only exact word sequences come out of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .frames import key_of, stored
from .words import LETTERS, Words, as_long, chunks

SHINGLE = 3
#: Bits of the map that says which shingles are looked for; its size does not grow with the benchmark.
MAP_BITS = 24

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _windows(size: int):
    """Arrow function: the windows of every item as (item_id, words, length, width of shingles, shingles)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                words, low = Words(data, offsets, LETTERS), data.tobytes().translate(_LOWER)
                shingles = {k: words.windows(k) for k in range(1, min(SHINGLE, size) + 1)}
                out = []
                for i in range(b - a):
                    first, end = int(words.row[i]), int(words.row[i + 1])
                    length = min(size, end - first)
                    width = min(SHINGLE, length)
                    for s in range(first, end - length + 1) if length else ():
                        said = b" ".join(low[words.start[j] : words.end[j]] for j in range(s, s + length))
                        marks = shingles[width][s : s + length - width + 1].view(np.int64).tolist()
                        out.append((a + i, said.decode("utf-8", "replace"), length, width, marks))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([x[0] for x in out], pa.int64())), pa.array([x[1] for x in out], pa.string()),
                        pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.int32()),
                        pa.array([x[4] for x in out], pa.list_(pa.int64())),
                    ],
                    names=["item_id", "said", "length", "width", "marks"],
                )

    return cut


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, said, length, width, marks): every window of every item; items without id or words have none."""
    items = benchmark.select(F.col("`item_id`").cast("string").alias("item_id"), F.col("`text`").cast("string").alias("text"))
    return items.filter("item_id is not null").mapInArrow(
        _windows(size), "item_id string, said string, length int, width int, marks array<long>"
    )


def bit_map(marks: DataFrame) -> np.ndarray:
    """A map of 2**MAP_BITS bits with the bits of all hashes in column `mark` set, merged by the executors.

    At most 2**(MAP_BITS - 6) words come to the driver, whatever the number of hashes.
    """
    word = F.shiftrightunsigned(F.col("mark"), 64 - MAP_BITS + 6).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(mark, {64 - MAP_BITS}) & 63 as int))")
    rows = marks.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    for r in rows:
        out[r["word"]] = np.uint64(r["bits"] & (2**64 - 1))
    return out


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - MAP_BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _sought(words: Words, widths: list[int], bits) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places, hashes) of the shingles of a chunk that the map holds."""
    for k in widths:
        h = words.windows(k)
        at = np.flatnonzero(marked(bits, h) & words.whole(k))
        yield k, at, h[at]


def shingle_counts(documents: DataFrame, bits, widths: list[int]) -> DataFrame:
    """(mark, n): how often each looked-for shingle stands in the documents, added up per chunk first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, data, offsets in chunks(batch.column(0)):
                found += [h for _, _, h in _sought(Words(data, offsets, LETTERS), widths, bits.value)]
            mark, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([as_long(mark), pa.array(n.astype(np.int64))], names=["mark", "n"])

    return documents.select("text").mapInArrow(count, "mark long, n long").groupBy("mark").agg(F.sum("n").alias("n"))


def prefix_places(documents: DataFrame, bits, widths: list[int], size: int) -> DataFrame:
    """One row per document: doc_id, text_key, n_words and its prefix tokens with their place and the words around."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("mark", pa.int64()), ("at", pa.int32()), ("from", pa.int32()), ("around", pa.string())]))
        for batch in batches:
            counts, places = [], []
            for a, b, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets, LETTERS)
                counts.append(np.diff(words.row))
                own: list[list] = [[] for _ in range(b - a)]
                raw, row_of = None, words.row_of()
                for k, at, h in _sought(words, widths, bits.value):
                    for j, mark in zip(at.tolist(), h.view(np.int64).tolist()):
                        raw = data.tobytes().translate(_LOWER) if raw is None else raw
                        i = row_of[j]
                        first, end = int(words.row[i]), int(words.row[i + 1])
                        lo, hi = max(first, j - size + 1), min(end, j + size)
                        said = b" ".join(raw[s:e] for s, e in zip(words.start[lo:hi].tolist(), words.end[lo:hi].tolist()))
                        own[i].append({"mark": mark, "at": j - first, "from": lo - first, "around": said.decode("utf-8", "replace")})
                places += own
            n = np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n), pa.array(places, kind)], names=["doc_id", "text_key", "n_words", "places"]
            )

    return documents.mapInArrow(
        find, "doc_id long, text_key long, n_words long, "
        "places array<struct<mark: long, at: int, from: int, around: string>>"
    )


def _lowest(counts: DataFrame, windows: DataFrame) -> DataFrame:
    """The rarest shingle of every window and its place in it: (said, length, mark, shift)."""
    each = windows.select("said", "length", F.posexplode("marks").alias("shift", "mark"))
    ranked = each.join(counts, "mark", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return ranked.groupBy("said", "length").agg(
        F.min_by(F.struct("mark", "shift"), F.struct("n", "mark", "shift")).alias("token")
    ).select("said", "length", "token.mark", "token.shift")


def covered(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the number of words inside any span [start, end): `n_hit`."""
    before = W.partitionBy(*keys).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    reach = F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.col("start")))
    new = F.greatest(F.col("end") - reach, F.lit(0))
    return spans.withColumn("new", new).groupBy(*keys).agg(F.sum("new").cast("long").alias("n_hit"))


def contamination(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Words of each document inside occurrences of benchmark windows, and the items these come from.

    Returns, one row per input row: doc_id, n_words, n_hit, n_items, items (ids as strings, sorted), contaminated. A
    window is `size` consecutive words of an item; a shorter item is one window. Null texts and texts without words
    have no words and no hits; items without id or words are left out; an id with several rows has the windows of
    all. Repeated documents each get their own result; null doc_ids stay. Empty tables give empty results or none hit.
    Other columns are not read. Windows are as long as items say; a hot passage meets the few windows that share its
    prefix token, and no pairs of documents or of items are formed.
    """
    docs = key_of(documents)
    windows = stored(item_windows(benchmark, size))
    each = windows.select("said", "length", "width", "marks").distinct()
    marks = windows.select(F.explode("marks").alias("mark")).distinct()
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())
    bits = spark.sparkContext.broadcast(bit_map(marks))
    tokens = stored(_lowest(shingle_counts(docs, bits, widths), each))
    sought = spark.sparkContext.broadcast(bit_map(tokens.select("mark").distinct()))
    found = stored(prefix_places(docs.select("doc_id", "text", "text_key"), sought, widths, size))

    places = found.select("doc_id", "text_key", "n_words", F.explode("places").alias("place")).select(
        "doc_id", "text_key", "n_words", "place.*"
    )
    start = F.col("at") - F.col("shift")
    said = F.array_join(F.slice(F.split("around", " "), start - F.col("from") + 1, F.col("length")), " ")
    fits = (start >= F.col("from")) & (start + F.col("length") <= F.col("n_words"))
    hits = places.join(tokens, "mark").filter(fits).filter(F.when(fits, said) == F.col("said")).select(
        "doc_id", "text_key", start.alias("start"), (start + F.col("length")).alias("end"), "said"
    )
    hits = stored(hits.distinct())
    keys = ["doc_id", "text_key"]
    spans = covered(hits.groupBy(*keys, "start").agg(F.max("end").alias("end")), keys)
    items = (
        hits.select(*keys, "said").distinct().join(windows.select("said", "item_id").distinct(), "said")
        .groupBy(*keys).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    spans, items = spans.alias("s"), items.alias("i")
    hit = spans.join(items, same_columns("s", "i")).select("s.*", "i.items").withColumnsRenamed({"doc_id": "hit_id", "text_key": "hit_key"})
    own = F.coalesce("items", F.array().cast("array<string>"))
    return found.join(
        hit, found["doc_id"].eqNullSafe(hit["hit_id"]) & (found["text_key"] == hit["hit_key"]), "left"
    ).select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(own).cast("long").alias("n_items"), own.alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def same_columns(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))
