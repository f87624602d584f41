"""Near duplicates by a multi-index Hamming join of MinHash signatures, confirmed on full shingle sets.

A signature is CHUNKS * CHUNK values of 16 bits. If two signatures differ in fewer than 2 * CHUNKS values, one of the
chunks differs in one value at most (pigeonhole); so every chunk is indexed once with each of its values left out, and
all pairs under that distance share a key. At a similarity of exactly 0.75 a chunk qualifies with probability 0.74, all
CHUNKS fail together with about 2e-6, and sooner the more alike two texts are.

Documents with equal sets become one node first. Among the nodes of a key only pairs that can still join two
components are confirmed: first every node with its key's pivot, the node with most copies, then, where a key still
holds several components, the pairs across them. Before texts are compared, pairs pass two exact bounds: sets of too
different sizes cannot qualify, nor can sets whose parity maps (BITS counters modulo 2 of hashed shingles) differ in
more places than their symmetric difference may have elements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import bit_map, marked
from .frames import few, key_of, stored
from .graph import relabelled
from .words import SPACED_LOWER, Words, as_long, chunks, mix, seeded

CHUNKS, CHUNK = 10, 4
VALUES = CHUNKS * CHUNK
FACTORS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Size of a set's parity map.
BITS = 1024


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles; the whole sequence if it has fewer words."""
    words = Words(data, offsets, SPACED_LOWER)
    h = words.windows(width)
    out = []
    for a, b in zip(words.row[:-1].tolist(), words.row[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        else:
            out.append(seeded(words.windows_at(a, b), b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, n, one, two, keys, bits): size, 128-bit sum, keys of the signature's chunks, parity map."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two, keys, parity = [], [], [], [], []
            for _, _, data, offsets in chunks(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                flat = np.concatenate([np.zeros(0, np.uint64), *sets])
                sums, sign_of, index = np.zeros((2, len(n)), np.uint64), np.zeros((len(n), VALUES), np.uint64), np.zeros((len(n), VALUES), np.uint64)
                if len(some):
                    first = (np.cumsum(n) - n)[some]
                    for k in (0, 1):
                        sums[k, some] = np.add.reduceat(seeded(flat, 31 + k), first)
                    for j in range(VALUES):
                        sign_of[some, j] = mix(np.minimum.reduceat(flat * FACTORS[j], first)) & np.uint64(0xFFFF)
                    for c in range(CHUNKS):
                        own = sign_of[:, c * CHUNK : (c + 1) * CHUNK]
                        for out in range(CHUNK):
                            rest = [own[:, i] for i in range(CHUNK) if i != out]
                            packed = rest[0] | (rest[1] << np.uint64(16)) | (rest[2] << np.uint64(32))
                            index[:, c * CHUNK + out] = seeded(packed, c * CHUNK + out)
                for own in sets:
                    odd = np.bincount((own >> np.uint64(20)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1
                    parity.append(np.packbits(odd.astype(bool)).view(np.int64))
                size.append(n)
                one.append(sums[0])
                two.append(sums[1])
                keys.append(index)
            flat = np.concatenate([np.zeros((0, VALUES), np.uint64), *keys])
            edges = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * VALUES)
            join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(join(size, np.int64)), as_long(join(one, np.uint64)), as_long(join(two, np.uint64)),
                    pa.ListArray.from_arrays(edges, as_long(flat.ravel())),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(parity) + 1, dtype=np.int32) * (BITS // 64)), pa.array(join(parity, np.int64))),
                ],
                names=["doc_id", "text_key", "n", "one", "two", "keys", "bits"],
            )

    return documents.mapInArrow(sign, "doc_id long, text_key long, n long, one long, two long, keys array<long>, bits array<long>")


def _texts_of(documents: DataFrame, wanted) -> DataFrame:
    """Texts whose doc_id is in a bit map; some others may be among them."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pa.array(marked(wanted.value, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)))
            yield batch.select([0, 1]).filter(kept)

    rows = documents.filter("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("mark"))
    return rows.mapInArrow(pick, "doc_id long, text string")


def confirmed(spark: SparkSession, documents: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(a, b, same, all): intersection and union of the full shingle sets of every pair, from both whole texts.

    The pairs must be stored; few are broadcast to the texts of their second nodes.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last = None, None
        for batch in batches:
            a_ids, b_ids, same, either = [], [], [], []
            for a, b, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                raw = text_a.as_buffer().to_pybytes()
                if raw != last_text:
                    last_text, last = raw, _one_set(raw, width)
                other = _one_set(text_b.as_buffer().to_pybytes(), width)
                at = np.searchsorted(last, other)
                both = int((last[np.minimum(at, len(last) - 1)] == other).sum()) if len(last) else 0
                a_ids.append(a)
                b_ids.append(b)
                same.append(both)
                either.append(len(last) + len(other) - both)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a_ids, pa.int64()), pa.array(b_ids, pa.int64()), pa.array(same, pa.int64()), pa.array(either, pa.int64())],
                names=["a", "b", "same", "all"],
            )

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    wanted = spark.sparkContext.broadcast(bit_map(ids.select(F.xxhash64("id").alias("mark"))))
    texts = _texts_of(documents, wanted)
    left, right = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    rows = right.join(_sent(pairs.select("a", "b")), "b").join(left, "a").select("a", "b", "text_a", "text_b")
    found = rows.mapInArrow(compare, "a long, b long, same long, all long")
    return found.groupBy("a", "b").agg(F.max_by(F.struct("same", "all"), F.col("same") / F.col("all")).alias("x")).select("a", "b", "x.*")


def _sent(rows: DataFrame) -> DataFrame:
    """Stored rows of ids, marked to be broadcast if they are few."""
    return F.broadcast(rows) if few(rows) else rows


def _one_set(raw: bytes, width: int) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    return shingle_sets(data, np.array([0, len(data)]), width)[0]


def near_duplicates(spark: SparkSession, documents: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of `percent` / 100 or more.

    Returns, one row per input row: doc_id, text_key, n_shingles, component_id (the smallest doc_id reachable), kept (doc_id is
    component_id). A text of fewer than `width` words is one shingle; null texts and texts without words have none
    and are linked with nothing, so they are their own component. A row with a null doc_id is linked with nothing,
    has no component and is kept. Rows that repeat a doc_id with equal sets share their component and `kept`; texts
    that differ under one doc_id are texts of their own, linked through nothing but their sets, unless that doc_id is
    the smallest of both sets. Empty tables give empty results. Other columns are not read.
    """
    docs = key_of(documents).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "text_key")
    signed = stored(signatures(docs, width))
    docs = docs.drop("text_key")
    member = signed.filter("doc_id is not null and n > 0")
    # A row for every set; equal sets have equal keys and maps.
    first = stored(member.groupBy("one", "two", "n").agg(
        F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.any_value("keys").alias("keys"), F.any_value("bits").alias("bits")
    ))
    each = first.select("node", "copies", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.min_by("node", F.struct(-F.col("copies"), F.col("node"))).alias("pivot")
    ).filter("low <> high").select("key", "pivot")
    held = stored(each.join(shared, "key"))  # nodes by key, for keys of several nodes

    # Pairs that the sizes and parity maps of the two sets do not rule out.
    def possible(x: str, y: str) -> Column:
        sizes = 100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")
        differ = sum((F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(BITS // 64)), F.lit(0))
        return sizes & (differ * (100 + percent) <= (100 - percent) * (F.col(f"{x}.n") + F.col(f"{y}.n")))

    maps = first.select("node", "n", "bits")
    linked = 100 * F.col("same") >= percent * F.col("all")
    stars = held.filter("node <> pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).count()
    x, y = maps.alias("x"), maps.alias("y")
    stars = stars.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).filter(possible("x", "y"))
    stars = stored(stars.select("a", "b", "count"))
    best = stored(stars.groupBy("b").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a")).select("a", "b"))
    tested = stored(confirmed(spark, docs, best, width))
    labels = relabelled(None, tested.filter(linked))

    # The other pivots of a node's keys, where they are not yet in one component.
    rest = stored(_apart(stars.select("a", "b"), labels).join(_sent(tested.select("a", "b")), ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = stored(confirmed(spark, docs, rest, width))
        tested = tested.unionByName(more)
        labels = relabelled(labels, more.filter(linked))
    tested = tested.select("a", "b")

    # Keys that still hold several components: the pairs across them.
    split = _labelled(held.select("key", "node"), "node", "label", labels)
    mixed = split.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    split = stored(split.join(mixed.select("key"), "key").join(maps, "node"))
    x, y = split.alias("x"), split.alias("y")
    across = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))
    pairs = x.join(y, across & possible("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    known = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    last = stored(pairs.join(_sent(known), ["a", "b"], "left_anti"))
    if not last.isEmpty():
        labels = relabelled(labels, stored(confirmed(spark, docs, last, width)).filter(linked))

    sets = _labelled(first, "node", "label", labels).select("one", "two", F.col("n").alias("size"), "label")
    whole = signed.alias("d").join(
        sets.alias("s"), (F.col("d.one") == F.col("s.one")) & (F.col("d.two") == F.col("s.two")) & (F.col("d.n") == F.col("s.size")), "left"
    )
    component = F.when(F.col("d.doc_id").isNotNull(), F.coalesce("s.label", "d.doc_id"))
    return whole.select(
        F.col("d.doc_id").alias("doc_id"), F.col("d.text_key").alias("text_key"), F.col("d.n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("d.doc_id") == component, F.lit(True)).alias("kept"),
    )


def _labelled(rows: DataFrame, node: str, name: str, labels: DataFrame) -> DataFrame:
    """Add the component of a node; a node without links is its own."""
    return rows.join(_sent(labels).toDF("labelled", "found"), F.col(node) == F.col("labelled"), "left").withColumn(name, F.coalesce("found", node)).drop("labelled", "found")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    return _labelled(_labelled(pairs, "a", "la", labels), "b", "lb", labels).filter("la <> lb").select("a", "b")
