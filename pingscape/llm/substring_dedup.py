"""Substring dedup: a count-min sketch tells which word windows may repeat, a second pass groups just these exactly.

Counting every window would be a counter per word, so a window is counted through its anchor: the smallest, first of
equals, of the hashes of the word runs of half its length in it. Equal windows have the same anchor at the same place
inside, so a window that starts at two places has an anchor that is chosen at two places: the count of the anchor is
never below that of the window. Partitions sketch the anchors they choose, the sketches are added up slice by slice,
and a window whose estimate is one is unique for certain. In the second pass the other windows meet by anchor, and are
equal if a second hash of all their words is too, 128 bits together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import key_of, stored
from .words import SPACED, Words, as_long, chunks, seeded

DEPTH = 2
SLICE_BITS = 16
#: Cells of one sketch row: as many as bytes of text / 16, a power of two between these bounds.
LEAST_BITS, MOST_BITS = 20, 28
#: Anchors with a higher estimate than this, or than the share of all text below, are grouped by window at once.
HOT_COUNT, HOT_SHARE = 2048, 1 << 22
FLUSH_CELLS = 1 << 22


def first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For every place the place of the smallest of the `width` values from there on, the first of equals."""
    n = len(values)
    best, at, have = values, np.arange(n), 1
    while have < width:
        step = min(have, width - have)
        left = best[: len(best) - step] <= best[step:]
        at = np.where(left, at[: len(at) - step], at[step:])
        best = np.where(left, best[: len(best) - step], best[step:])
        have += step
    return at


class Windows:
    """The windows of a chunk of texts: starts, and per run of windows with one anchor its first window and hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int):
        part = (size + 1) // 2
        words = Words(data, offsets, SPACED, second=True)
        anchors = words.windows(part)
        self.words, self.starts = words, np.flatnonzero(words.whole(size))
        at = first_smallest(anchors, size - part + 1)[self.starts] if len(self.starts) else self.starts
        self.first = np.flatnonzero(np.diff(at, prepend=-1))
        self.length = np.diff(np.append(self.first, len(at)))
        self.anchor = anchors[at[self.first]]
        self.hash = words.windows(size, second=True)[self.starts]


def cells_of(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (seeded(anchors, 11 + row) >> np.uint64(64 - bits)).astype(np.int64)


def sketches(texts: DataFrame, size: int, bits: int) -> DataFrame:
    """Sketches of the partitions, cut into slices: (slice, cells, counts)."""

    def packed(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for row in range(DEPTH):
            if not held[row]:
                continue
            cell, n = np.unique(np.concatenate(held[row]), return_counts=True)
            piece = cell >> SLICE_BITS
            first = np.flatnonzero(np.diff(piece, prepend=-1))
            edges = np.append(first, len(cell)).astype(np.int32)
            low, n = (cell & (2**SLICE_BITS - 1)).astype(np.uint16), n.astype(np.uint32)
            binary = lambda x: pa.Array.from_buffers(
                pa.binary(), len(first), [None, pa.py_buffer(edges * np.int32(x.itemsize)), pa.py_buffer(x)]
            )
            slices = (piece[first] + (row << (bits - SLICE_BITS))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(slices), binary(low), binary(n)], names=["slice", "cells", "counts"])
            held[row] = []

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
        size_held = 0
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                anchors = Windows(data, offsets, size).anchor
                for row in range(DEPTH):
                    held[row].append(cells_of(anchors, row, bits))
                size_held += len(anchors)
            if size_held > FLUSH_CELLS:
                yield from packed(held)
                size_held = 0
        yield from packed(held)

    return texts.select("text").mapInArrow(sketch, "slice int, cells binary, counts binary")


def merged(parts: DataFrame, hot: int) -> DataFrame:
    """Sketch slices added up: which cells count two or more, and the cells that count `hot` or more."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(piece: int, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([piece], pa.int32()), pa.array([np.packbits(total >= 2, bitorder="little").tobytes()], pa.binary()),
                    pa.array([np.flatnonzero(total >= hot).tolist()], pa.list_(pa.int32())),
                ],
                names=["slice", "twice", "hot"],
            )

        now, total = None, None
        for batch in batches:
            for piece, cells, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if piece != now:
                    if now is not None:
                        yield row(now, total)
                    now, total = piece, np.zeros(1 << SLICE_BITS, np.int64)
                total[np.frombuffer(cells.as_buffer(), np.uint16)] += np.frombuffer(counts.as_buffer(), np.uint32)
        if now is not None:
            yield row(now, total)

    dealt = parts.repartition("slice").sortWithinPartitions("slice")
    return dealt.mapInArrow(add, "slice int, twice binary, hot array<int>")


class Estimates:
    """The merged sketch as workers see it: a bit for every cell that counts two or more, and the hot cells."""

    def __init__(self, rows: list, bits: int):
        self.bits = bits
        self.twice = np.zeros((DEPTH, max(1, (1 << bits) // 8)), np.uint8)
        hot: list[list[int]] = [[] for _ in range(DEPTH)]
        per_row = 1 << (bits - SLICE_BITS)
        for r in rows:
            row, piece = divmod(r["slice"], per_row)
            at = piece << (SLICE_BITS - 3)
            self.twice[row, at : at + (1 << (SLICE_BITS - 3))] = np.frombuffer(r["twice"], np.uint8)
            hot[row] += [(piece << SLICE_BITS) + c for c in r["hot"]]
        self.hot = [np.array(sorted(x), np.int64) for x in hot]

    def any_hot(self) -> bool:
        return all(len(x) for x in self.hot)

    def look(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which anchors are estimated to be chosen at two places or more, and which are hot."""
        twice, hot = np.ones(len(anchors), bool), np.ones(len(anchors), bool)
        for row in range(DEPTH):
            cell = cells_of(anchors, row, self.bits)
            twice &= (self.twice[row, cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 != 0
            hot &= np.isin(cell, self.hot[row]) if len(self.hot[row]) else False
        return twice, hot


def _chosen(batch: pa.RecordBatch, size: int, estimates: Estimates, hot: bool) -> Iterator[tuple]:
    """Runs of windows that may repeat: (chunk's windows, indices of the runs, their rows, first word in the text)."""
    for a, _, data, offsets in chunks(batch.column(1)):
        found = Windows(data, offsets, size)
        twice, heavy = estimates.look(found.anchor)
        runs = np.flatnonzero(twice & (heavy if hot else ~heavy))
        first = found.starts[found.first[runs]]
        row = np.searchsorted(found.words.row, first, "right") - 1
        yield found, runs, row + a, (first - found.words.row[row]).astype(np.int32)


def _expand(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of every run one after another."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - length), length)


def anchored(docs: DataFrame, size: int, estimates) -> DataFrame:
    """Runs of windows by anchor: (anchor, doc_id, text_key, first, hashes)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, runs, row, first in _chosen(batch, size, estimates.value, hot=False):
                length = found.length[runs]
                hashes = found.hash[_expand(found.first[runs], length)]
                edges = np.concatenate([[0], np.cumsum(length * 8)]).astype(np.int32)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        as_long(found.anchor[runs]), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(first),
                        pa.Array.from_buffers(pa.binary(), len(runs), [None, pa.py_buffer(edges), pa.py_buffer(hashes)]),
                    ],
                    names=["anchor", "doc_id", "text_key", "first", "hashes"],
                )

    return docs.mapInArrow(find, "anchor long, doc_id long, text_key long, first int, hashes binary")


def _ranges(row: np.ndarray, place: np.ndarray, again: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi) of the word ranges under runs of flagged windows; windows are in the order of row and place."""
    row, place = row[again], place[again]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(row))[: len(begin)] - 1
    return row[begin], place[begin].astype(np.int32), (place[stop] + size).astype(np.int32)


def _met_twice(group: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which (group, hash) stand more than once, and the index of one row of each distinct of those."""
    order = np.lexsort((hashes, group))
    same = (group[order][1:] == group[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    again = np.zeros(len(group), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    first = np.flatnonzero(same & ~np.concatenate([[False], same[:-1]])) if len(same) else np.zeros(0, np.int64)
    return again, order[first]


def hot_windows(docs: DataFrame, size: int, estimates) -> DataFrame:
    """Windows of hot anchors, summed up per chunk of texts: (anchor, hash, n, doc_id, text_key, lo, hi).

    What stands twice in a chunk is a finished range (no anchor) and one row with n = 2 for the other chunks; a window
    that stands once is an open row with n = 1. So a window has at most one row per chunk, however often it stands.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, runs, row, first in _chosen(batch, size, estimates.value, hot=True):
                length = found.length[runs]
                place, row = _expand(first, length), np.repeat(row, length)
                anchor, hashes = np.repeat(found.anchor[runs], length), found.hash[_expand(found.first[runs], length)]
                again, one = _met_twice(anchor, hashes)
                done, lo, hi = _ranges(row, place, again, size)
                alone = np.flatnonzero(~again)
                n = [len(done), len(one), len(alone)]
                none = lambda k, kind: pa.nulls(k, kind)
                rows = pa.array(np.concatenate([done, np.zeros(n[1], np.int64), row[alone]]).astype(np.int64))
                known = np.concatenate([one, alone])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([none(n[0], pa.int64()), as_long(anchor[known])]),
                        pa.concat_arrays([none(n[0], pa.int64()), as_long(hashes[known])]),
                        pa.array(np.repeat(np.array([0, 2, 1], np.int32), n)),
                        batch.column(0).take(rows), batch.column(2).take(rows),
                        pa.array(np.concatenate([lo, np.zeros(n[1], np.int32), place[alone].astype(np.int32)])),
                        pa.array(np.concatenate([hi, np.zeros(n[1], np.int32), (place[alone] + size).astype(np.int32)])),
                    ],
                    names=["anchor", "hash", "n", "doc_id", "text_key", "lo", "hi"],
                )

    return docs.mapInArrow(find, "anchor long, hash long, n int, doc_id long, text_key long, lo int, hi int")


def hot_spans(rows: DataFrame) -> DataFrame:
    """Word ranges of hot windows that stand twice or more, from the stored rows of `hot_windows`."""
    twice = rows.filter("n > 0").groupBy("anchor", "hash").agg(F.sum("n").alias("all")).filter("all > 1")
    spans = ["doc_id", "text_key", "lo", "hi"]
    opened = rows.filter("n = 1").join(twice.select("anchor", "hash"), ["anchor", "hash"]).select(*spans)
    return rows.filter("n = 0").select(*spans).unionByName(opened)


def repeated_spans(runs: DataFrame, size: int) -> DataFrame:
    """Word ranges [lo, hi) of windows that stand at two places or more; a group has fewer rows than the hot bound."""

    def spans(table: pa.Table) -> pa.RecordBatch:
        anchor = table.column("anchor").to_numpy()
        packed = table.column("hashes").combine_chunks()
        packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
        edges = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
        hashes = np.frombuffer(packed.buffers()[2], np.uint8)[edges[0] : edges[-1]].view(np.uint64)
        length = np.diff(edges) // 8
        row = np.repeat(np.arange(len(anchor)), length)
        group = np.cumsum(np.diff(anchor, prepend=anchor[:1]) != 0)[row]
        again, _ = _met_twice(group, hashes)
        place = table.column("first").to_numpy()[row] + (np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length))
        begin, lo, hi = _ranges(row, place, again, size)
        rows = pa.array(begin)
        return pa.RecordBatch.from_arrays(
            [
                table.column("doc_id").combine_chunks().take(rows), table.column("text_key").combine_chunks().take(rows),
                pa.array(lo), pa.array(hi),
            ],
            names=["doc_id", "text_key", "lo", "hi"],
        )

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column(0).to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if waiting and (cut or waiting[-1].column(0)[-1].as_py() != anchor[-1]):
                yield spans(pa.Table.from_batches([*waiting, batch.slice(0, cut)]).combine_chunks())
                waiting = []
            elif cut:
                yield spans(pa.Table.from_batches([batch.slice(0, cut)]).combine_chunks())
            waiting.append(batch.slice(cut))
        if waiting:
            yield spans(pa.Table.from_batches(waiting).combine_chunks())

    dealt = runs.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(resolve, "doc_id long, text_key long, lo int, hi int")


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, kept = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2)):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            n.append(len(words))
            if spans.is_valid:
                step = np.zeros(len(words) + 1, np.int32)
                np.add.at(step, spans.values.field("lo").to_numpy(), 1)
                np.add.at(step, spans.values.field("hi").to_numpy(), -1)
                out = np.cumsum(step[:-1]) > 0
                removed.append(int(out.sum()))
                words = [words[i] for i in np.flatnonzero(~out).tolist()]
            else:
                removed.append(0)
            kept.append(b" ".join(words))
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                pa.Array.from_buffers(pa.string(), len(kept), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(kept))]),
            ],
            names=["rest", "n_words", "n_removed", "kept_text"],
        )


def dedup_substrings(spark: SparkSession, documents: DataFrame, size: int = 35, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Remove every word inside a window of `size` words that also starts anywhere else, in any text or the same.

    Returns, one row per input row: the columns named in `keep` as one struct `rest`, n_words, n_removed and kept_text
    (the kept words joined by one space). Windows are judged on the input. Null and empty texts have no words; a text
    of fewer words than a window keeps all; repeated rows are places of their own, so they lose all windows; null
    ids are ids like others; empty tables give empty results; columns that aren't named are not carried.
    """
    docs = key_of(documents).select("doc_id", "text", "text_key")
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (chars // 16).bit_length()))
    hot = max(HOT_COUNT, chars // HOT_SHARE)
    rows = merged(sketches(docs, size, bits), hot).collect()  # slices of a sketch of at most 2 * 2**MOST_BITS bits
    estimates = Estimates(rows, bits)
    shared = spark.sparkContext.broadcast(estimates)
    spans = repeated_spans(anchored(docs, size, shared), size)
    if estimates.any_hot():
        spans = spans.unionByName(hot_spans(stored(hot_windows(docs, size, shared))))
    per_text = spans.groupBy(F.col("doc_id").alias("span_id"), F.col("text_key").alias("span_key")).agg(
        F.collect_set(F.struct("lo", "hi")).alias("spans")  # rows that repeat a text have the same spans
    )
    text = F.col("`text`").cast("string")
    rest = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("rest"), text.alias("text"),
        F.col("`doc_id`").cast("long").alias("own_id"), F.xxhash64(text).alias("own_key"),
    )
    both = rest.join(per_text, F.col("own_id").eqNullSafe(F.col("span_id")) & (F.col("own_key") == F.col("span_key")), "left")
    kind = both.select("rest").schema["rest"].dataType.simpleString()
    return both.select("rest", "text", "spans").mapInArrow(
        _cut_out, f"rest {kind}, n_words long, n_removed long, kept_text string"
    )
