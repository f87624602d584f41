"""Near duplicates by SimHash: fingerprints of 64 bits that differ in few bits, found by pigeonring filtering.

A fingerprint is a ring of REACH + 1 segments. If two fingerprints differ in at most REACH bits, some segment of the
ring starts a chain of which every prefix of l segments holds at most l * REACH / (REACH + 1) differences (the
pigeonring principle): none in the first segment, one in the first two, two in the first three. The index key is the
first two links of such a chain: a fingerprint stands under its own pair of segments, and under those pairs in which
one 0 of the second segment is a 1, so that two fingerprints one bit apart there meet exactly once. Pairs of a key
pass the longer prefixes of the chain before all 64 bits are compared.

Fingerprints are made distinct first. A key of more than MOST fingerprints is not compared: its rows go on to longer
keys, one for each of the REACH + 1 parts of the bits left, of which two fingerprints within reach must share one
(pigeonhole again), round by round. After few rounds so few bits are left that no key can hold more. Of the links in
a key only those are given out that join two groups of the key not joined before, so never all pairs of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import key_of, stored, tasks
from .graph import components
from .words import as_long, mix

WIDTH, REACH, SEED = 3, 3, 42
SEGMENTS = REACH + 1
SEGMENT = 64 // SEGMENTS
#: Most fingerprints of a key that are compared with each other.
MOST = 4096
#: Hashes whose bits are counted at once.
COUNT_ROWS = 1 << 15
#: A fingerprint of more than a HEAVY-th part of all rows is looked up by broadcast; fewer than HEAVY can be so.
HEAVY = 1000


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 of the shingles of `width` words, repeats included; of the whole sequence, if it has fewer."""
    words = text.lower().split()  # of bytes: lower-cases A-Z, splits at \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), ends[width - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), COUNT_ROWS):
        part = np.ascontiguousarray(hashes[a : a + COUNT_ROWS])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's whole text as a signed 64-bit number."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column(1)):
                raw = text.as_buffer()
                if raw is not None and raw.size:
                    found[i] = fingerprint(shingle_hashes(raw.to_pybytes(), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), as_long(found)], names=["doc_id", "fp"])

    return key_of(documents).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(take, "doc_id long, fp long")


def turned(fp: np.ndarray, first: int) -> np.ndarray:
    """The ring read from a segment on: that segment in the lowest bits, the next above it, and so on."""
    down = np.uint64(first * SEGMENT)
    return fp if not first else (fp >> down) | (fp << np.uint64(64 - first * SEGMENT))


def chain_keys(fp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first segment, rows, keys): the first two links of the chains from every segment, own and one bit up."""
    low = np.uint64((1 << 2 * SEGMENT) - 1)
    every = np.arange(len(fp))
    for first in range(SEGMENTS):
        own = turned(fp, first) & low
        yield first, every, own
        for bit in range(SEGMENT, 2 * SEGMENT):
            rows = np.flatnonzero((own >> np.uint64(bit)) & np.uint64(1) == 0)
            yield first, rows, own[rows] | np.uint64(1 << bit)


def chained(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where every prefix of the chain from `first` stays within its share of REACH, the whole ring included."""
    x = a ^ b
    down = first.astype(np.uint64) * np.uint64(SEGMENT)
    x = (x >> down) | (x << (np.uint64(64) - down) % np.uint64(64))
    alive = np.arange(len(x))
    for links in range(1, SEGMENTS + 1):
        mask = np.uint64((1 << (links * SEGMENT)) - 1)
        alive = alive[np.bitwise_count(x[alive] & mask) <= links * REACH // SEGMENTS]
    good = np.zeros(len(x), bool)
    good[alive] = True
    return good


def joining_links(key: np.ndarray, first: np.ndarray, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between rows of equal neighbouring keys that join what earlier ones of the key have not joined.

    Rows are compared with those 1, 2, 3, ... places on, all keys at once; labels of joined rows go along.
    """
    n, out = len(key), []
    label = np.arange(n)
    ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) if n else np.zeros(0, np.int64)
    last = np.repeat(ends, np.diff(np.concatenate([[-1], ends])))  # the last row of each row's key
    live, step = np.flatnonzero(last > np.arange(n)), 1
    while len(live):
        other = live + step
        ask = live[label[live] != label[other]]
        good = ask[chained(fp[ask], fp[ask + step], first[ask])]
        if len(good):
            out.append((fp[good], fp[good + step]))
            a, b = good, good + step
            while True:  # the smaller label wins until none is left to change
                low = np.minimum(label[a], label[b])
                np.minimum.at(label, label[a], low)
                np.minimum.at(label, label[b], low)
                while (label[label] != label).any():
                    label = label[label]
                if (label[a] == label[b]).all():
                    break
        step += 1
        live = live[live + step <= last[live]]
    return out


def _key_rows(fps: DataFrame) -> DataFrame:
    """(key, first, free, fp): every distinct fingerprint under the keys of its chains; `free` is what the key leaves open."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for first, rows, keys in chain_keys(fp):
                own = fp[rows]
                yield _rows(mix(keys ^ np.uint64(first << 40)), np.full(len(rows), first), turned(own, first) >> np.uint64(2 * SEGMENT), own)

    return fps.select("fp").mapInArrow(spread, "key long, first byte, free long, fp long")


def _rows(key: np.ndarray, first: np.ndarray, free: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    columns = [as_long(key), pa.array(first.astype(np.int8)), as_long(free), as_long(fp)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "first", "free", "fp"])


def longer_keys(bits: int, key: np.ndarray, first: np.ndarray, free: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows under one longer key for each of SEGMENTS parts of the `bits` free bits; a part leaves the free bits."""
    edges = [bits * p // SEGMENTS for p in range(SEGMENTS + 1)]
    for part, (low, high) in enumerate(zip(edges, edges[1:])):
        value = (free >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        rest = (free & np.uint64((1 << low) - 1)) | ((free >> np.uint64(high)) << np.uint64(low))
        yield _rows(mix(mix(key + np.uint64(part + 1)) ^ value), first, rest, fp)


def _looked_at(keys: DataFrame, bits: int, most: int) -> DataFrame:
    """Links within keys, as rows of (fp, free) without a key, and the rows of keys of over `most` rows under longer keys."""

    def links(first: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in joining_links(key, first, fp):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int8()), as_long(b), as_long(a)], names=["key", "first", "free", "fp"]
            )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = None, None  # the rows so far of the key seen last, or that key if it is known to hold too many
        for batch in batches:
            key, first, free, fp = (batch.column(i).to_numpy() for i in range(4))
            cols = [key.view(np.uint64), first, free.view(np.uint64), fp.view(np.uint64)]
            if held is not None:
                cols = [np.concatenate(pair) for pair in zip(held, cols)]
            key = cols[0]
            if not len(key):
                continue
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(begin, len(key)))
            large = size > most if hot is None else (size > most) | (key[begin] == hot)
            hot = key[-1] if large[-1] else None
            still = np.arange(len(key)) >= begin[-1]  # the last key may go on in the next batch
            large = np.repeat(large, size)
            if large.any():
                yield from longer_keys(bits, *(c[large] for c in cols))
            done = [c[~large & ~still] for c in cols]
            yield from links(done[1], done[0], done[3])
            held = [c[~large & still] for c in cols]
        if held is not None:
            yield from links(held[1], held[0], held[3])

    dealt = keys.repartition(tasks(keys), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(look, "key long, first byte, free long, fp long")


def close_fingerprints(fps: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): links between fingerprints that join exactly those within REACH bits of each other, directly or by others."""
    bits, found = 64 - 2 * SEGMENT, []
    keys = _key_rows(fps)
    while True:
        # At 7 free bits a key holds 17 * 2**7 different fingerprints at most, so nothing is left to be divided.
        looked = stored(_looked_at(keys, bits, most if bits > 7 else 1 << 62))
        found.append(looked.filter("key is null").select(F.col("fp").alias("a"), F.col("free").alias("b")))
        keys, bits = looked.filter("key is not null"), bits - bits // SEGMENTS
        if keys.isEmpty():
            links = found[0]
            for more in found[1:]:
                links = links.unionByName(more)
            return links


def simhash_groups(spark: SparkSession, documents: DataFrame, width: int = WIDTH, most: int = MOST) -> DataFrame:
    """Components of documents whose fingerprints differ in REACH bits or fewer: (doc_id, fingerprint, component_id).

    One row per input row; `component_id` is the smallest doc_id reachable. A text of fewer than `width` words is one
    shingle; null texts and texts without words have fingerprint zero, which links like any other. Rows with equal
    fingerprints are linked, repeated ids and rows included; an id that stands with several texts has a component for
    each row. A row with a null doc_id has a fingerprint, no component, and links nothing. Empty tables give empty
    results. Other columns are not read.
    """
    docs = stored(fingerprints(documents, width))
    nodes = stored(docs.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")))
    labels = components(close_fingerprints(nodes, most), "a", "b").withColumnRenamed("node", "fp")
    joined = nodes.join(labels, "fp")
    lowest = joined.groupBy("label").agg(F.min("low").alias("component"))
    own = nodes.filter("copies > 1").select("fp", F.col("low").alias("own"), "copies")
    known = labels.join(lowest, "label").select("fp", "component").join(own, "fp", "full")
    known = stored(known.select("fp", F.coalesce("component", "own").alias("component"), "copies"))
    # Rows of heavy fingerprints do not meet at one key: fewer than HEAVY fingerprints can be heavy.
    rows = docs.count()
    heavy = known.filter(F.col("copies") * HEAVY > rows).select("fp", F.col("component").alias("held"))
    light = known.filter(~F.coalesce(F.col("copies") * HEAVY > rows, F.lit(False))).select("fp", "component", F.lit(0).alias("salt"))
    dealt = docs.join(F.broadcast(heavy), "fp", "left")
    salt = F.when(F.col("held").isNotNull(), F.lit(1) + F.pmod(F.xxhash64("doc_id"), F.lit(HEAVY))).otherwise(0).cast("int")
    whole = dealt.withColumn("salt", salt).join(light, ["fp", "salt"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("held", "component", "doc_id"))
    return whole.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
