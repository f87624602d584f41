"""Alignment of two tokenizers by byte ranges, from fragments that compose in any grouping.

A stretch of a text gives a fragment: tokens of both sides before the first byte offset where both end (the open
prefix), the groups between such offsets (closed), and the tokens after the last one (the open suffix). Two neighbours
compose by closing what stands between them: the left suffix and the right prefix. Composition is associative, so the
fragments of a text can be folded in any tree; a closed group is given out once and never touched again.

Texts of up to LONG bytes are one fragment, made where they are read. Longer ones are cut into chunks of about LONG
bytes, each side where its own tokenizer allows it, so that a chunk's two ranges need not agree; chunks are encoded by
different tasks and folded FAN at a time, round by round. Only digests, which need an order, see a text's groups one
after another, streamed.

Inside a chunk both sides are cut together before spaces that follow a visible character: a byte-level BPE never puts
white space behind another character into one token, and no piece of the other vocabulary holds a space behind another
character (checked), so tokens are those of the cuts one after another. Cuts repeat; a worker remembers their
ids in a table of bounded size, and ends, groups and links of many texts come from sorted arrays of byte offsets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import stored, tasks, written
from .tokens import PLAIN, Encoder, cuts, row_sums
from .words import byte_hashes

LONG, FAN = 1 << 16, 8
#: Cuts and ids that a worker remembers, and the bytes of texts and of new cuts that it works on at once.
SLOTS, POOL_IDS, CHUNK_BYTES, ENCODE_BYTES = 1 << 18, 1 << 21, 1 << 18, 1 << 15
#: Pairs of ids with their counts are sent to the tasks up to this many (17 bytes each); more are joined.
MOST_PAIRS = 1_000_000
#: Copies of a pair in that join, so that rows of one pair spread.
SALTS = 16
SHIFT = 24
SPACE = "▁"


class Tokens(NamedTuple):
    """Tokens of one side: ids and the byte offset at which each ends."""

    ids: list[int]
    ends: list[int]

    def __add__(self, other: "Tokens") -> "Tokens":
        return Tokens(self.ids + other.ids, self.ends + other.ends)

    def part(self, low: int, high: int) -> "Tokens":
        return Tokens(self.ids[low:high], self.ends[low:high])


class Stretch(NamedTuple):
    """Tokens of both sides that are not yet closed, and where each side begins."""

    a_from: int
    b_from: int
    a: Tokens
    b: Tokens

    def ends(self) -> tuple[int, int]:
        return (self.a.ends[-1] if self.a.ends else self.a_from), (self.b.ends[-1] if self.b.ends else self.b_from)

    def __add__(self, other: "Stretch") -> "Stretch":
        return Stretch(self.a_from, self.b_from, self.a + other.a, self.b + other.b)


class Group(NamedTuple):
    """Tokens of both sides over the same bytes."""

    start: int
    a: Tokens
    b: Tokens

    def said(self) -> str:
        return ",".join(map(str, self.a.ids)) + "|" + ",".join(map(str, self.b.ids))

    def links(self) -> list[int]:
        """Pairs of ids, packed, of all tokens whose byte ranges overlap."""
        out, i, j = [], 0, 0
        while i < len(self.a.ids) and j < len(self.b.ids):
            out.append(self.a.ids[i] << SHIFT | self.b.ids[j])
            x, y = self.a.ends[i], self.b.ends[j]
            i, j = i + (x <= y), j + (y <= x)
        return out


class Fragment(NamedTuple):
    """An open prefix and an open suffix, or, with no suffix, one stretch that is open throughout."""

    prefix: Stretch
    suffix: Stretch | None


def closed(stretch: Stretch) -> tuple[Fragment, list[Group]]:
    """The fragment of a stretch and the groups inside it."""
    common = sorted({*stretch.a.ends} & {*stretch.b.ends})
    if stretch.a_from == stretch.b_from:
        common.insert(0, stretch.a_from)
    if not common:
        return Fragment(stretch, None), []
    places = [(np.searchsorted(stretch.a.ends, c, "right"), np.searchsorted(stretch.b.ends, c, "right")) for c in common]
    (i, j), groups = places[0], []
    prefix = Stretch(stretch.a_from, stretch.b_from, stretch.a.part(0, i), stretch.b.part(0, j))
    for start, (x, y) in zip(common, places[1:]):
        groups.append(Group(start, stretch.a.part(i, x), stretch.b.part(j, y)))
        i, j = x, y
    suffix = Stretch(common[-1], common[-1], stretch.a.part(i, len(stretch.a.ids)), stretch.b.part(j, len(stretch.b.ids)))
    return Fragment(prefix, suffix), groups


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, list[Group]]:
    """The fragment of two neighbouring stretches and the groups that close between them."""
    middle, groups = closed((left.suffix or left.prefix) + right.prefix)
    if left.suffix is None and right.suffix is None:
        return middle, groups
    first = middle.prefix if left.suffix is None else left.prefix
    return Fragment(first, middle.suffix if right.suffix is None else right.suffix), groups


def flat(fragment: Fragment) -> list[list[int]]:
    """A fragment as lists of numbers, five for each of its stretches."""
    stretches = [s for s in fragment if s is not None]
    return [x for s in stretches for x in ([s.a_from, s.b_from], s.a.ids, s.a.ends, s.b.ids, s.b.ends)]


def unflat(lists: list[list[int]]) -> Fragment:
    parts = [lists[i : i + 5] for i in range(0, len(lists), 5)]
    stretches = [Stretch(*p[0], Tokens(p[1], p[2]), Tokens(p[3], p[4])) for p in parts]
    return Fragment(stretches[0], stretches[1] if len(stretches) > 1 else None)


def byte_level(token: str) -> bytes:
    """The bytes that a byte-level token stands for: printable Latin characters are themselves, the rest count on from 256."""
    if not _BYTE_OF:
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        _BYTE_OF.update({chr(b): b for b in plain})
        _BYTE_OF.update({chr(256 + n): b for n, b in enumerate(sorted({*range(256)} - {*plain}))})
    return bytes(_BYTE_OF[c] for c in token)


_BYTE_OF: dict[str, int] = {}


class Sides:
    """Both tokenizers of a worker, and the cuts it remembers."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.coder = Encoder(path_a, keep_ids=True, plain=True)
        self.a = self.coder.tokenizer
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError(f"{path_b}: a piece holds a space behind another character, so texts cannot be cut at spaces")
        self.bytes_a = [byte_level(t) if t is not None and all(ord(c) < 0x144 for c in t) else b"" for t in map(self.a.id_to_token, range(self.a.get_vocab_size()))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b)]
        self.keys = np.zeros((2, SLOTS), np.uint64)
        self.good = np.zeros(SLOTS, bool)
        self.length, self.at = np.zeros((2, SLOTS), np.int32), np.zeros((2, SLOTS), np.int64)
        self.pools, self.used = [np.zeros(1 << 16, np.int32) for _ in range(2)], [0, 0]
        # Every id as text with what may follow it, of one width, and the length of that.
        self.said = [[np.array([f"{i}{c}".encode() for i in range(len(t))], "S7") for c in follow] for t, follow in ((self.bytes_a, ",|"), (self.bytes_b, ",;"))]
        self.said_length = [np.char.str_len(own[0]) for own in self.said]

    def _read(self, ids: list[int], table: list[bytes], raw: bytes, at: int) -> Tokens | None:
        parts = [table[i] for i in ids]
        if b"".join(parts) != raw:
            return None
        return Tokens(ids, (np.cumsum([len(p) for p in parts]) + at).tolist() if parts else [])

    def tokens_a(self, raw: bytes, at: int = 0) -> Tokens | None:
        """Tokens of the first side, or nothing where they do not read back as `raw`."""
        if not raw:
            return Tokens([], [])
        return self._read(self.a.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids, self.bytes_a, raw, at)

    def tokens_b(self, raw: bytes, at: int = 0) -> Tokens | None:
        """Tokens of the second side of bytes that begin with a space, which the tokenizer puts there itself."""
        if not raw:
            return Tokens([], [])
        return self._read(self.b.encode(raw[1:].decode("utf-8", "replace")), self.bytes_b, raw, at)

    def _ids_a(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the first side's ids of every text and the ids."""
        start = self.coder.cuts(data, offsets)
        length, at = self.coder.encode(data, start, np.append(start[1:], len(data)))
        stop = np.cumsum(length, dtype=np.int64)
        ids = self.coder.pool[np.arange(stop[-1]) + np.repeat(at - (stop - length), length)].astype(np.int32)
        return row_sums(length, np.searchsorted(start, offsets)), ids

    def _encode(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether both sides read cuts back, the numbers of their ids and where these lie in the pools."""
        data = np.frombuffer(b"".join(raws), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raws])]).astype(np.int64)
        found = [self._ids_a(data, offsets), self.b.encode([raw.decode("utf-8", "replace")[1:] for raw in raws], num_threads=1)]
        good = np.ones(len(raws), bool)
        ids, counts = [], []
        for own, table, sizes in zip(found, (self.bytes_a, self.bytes_b), self.sizes):
            if isinstance(own, tuple):
                n, flat_ids = own
            else:
                n = np.array([len(x) for x in own], np.int64)
                flat_ids = np.fromiter(chain.from_iterable(own), np.int32, int(n.sum()))
            stop = np.cumsum(n)
            run = np.concatenate([[0], np.cumsum(sizes[flat_ids])])
            if (run[stop] != offsets[1:]).any() or b"".join([table[i] for i in flat_ids.tolist()]) != data.tobytes():
                parts = np.split(flat_ids, stop[:-1])
                good &= [b"".join([table[i] for i in x.tolist()]) == raw for x, raw in zip(parts, raws)]
            ids.append(flat_ids)
            counts.append(n)
        length, at = np.zeros((2, len(raws)), np.int32), np.zeros((2, len(raws)), np.int64)
        for k, (n, own) in enumerate(zip(counts, ids)):
            length[k] = np.where(good, n, 0)
            flat_ids = own[np.repeat(good, n)]
            if self.used[k] + len(flat_ids) > len(self.pools[k]):
                self.pools[k] = np.concatenate([self.pools[k], np.zeros(max(len(flat_ids), len(self.pools[k]) // 2), np.int32)])
            self.pools[k][self.used[k] : self.used[k] + len(flat_ids)] = flat_ids
            at[k] = self.used[k] + np.cumsum(length[k]) - length[k]
            self.used[k] += len(flat_ids)
        return good, length, at

    def cuts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for the cuts of some bytes; different new ones are encoded once."""
        if max(self.used) > POOL_IDS:
            self.used, self.keys[:] = [0, 0], 0
        one, two = (byte_hashes(data, start, end, PLAIN, w) for w in (0, 1))
        slot = (one & np.uint64(SLOTS - 1)).astype(np.int64)
        good, length, at = self.good[slot], self.length[:, slot], self.at[:, slot]
        new = np.flatnonzero((self.keys[0, slot] != one) | (self.keys[1, slot] != two))
        if len(new):
            _, first, back = np.unique(one[new] ^ (two[new] << np.uint64(1)), return_index=True, return_inverse=True)
            places, raw = new[first], data.tobytes()
            sizes = np.cumsum(end[places] - start[places]) // ENCODE_BYTES
            parts = []
            for own in np.split(places, np.flatnonzero(np.diff(sizes)) + 1):
                parts.append(self._encode([raw[a:b] for a, b in zip(start[own].tolist(), end[own].tolist())]))
            known = [np.concatenate(x, axis=-1) for x in zip(*parts)]
            good[new], length[:, new], at[:, new] = known[0][back], known[1][:, back], known[2][:, back]
            # Of several new cuts with one slot the last entry stays whole: all arrays take the same last one.
            there = slot[places]
            self.keys[0, there], self.keys[1, there], self.good[there] = one[places], two[places], known[0]
            self.length[:, there], self.at[:, there] = known[1], known[2]
        return good, length, at


_SIDES: dict[tuple[str, str], Sides] = {}


def sides(path_a: str, path_b: str) -> Sides:
    """The worker's tokenizers."""
    if (path_a, path_b) not in _SIDES:
        _SIDES.clear()
        _SIDES[path_a, path_b] = Sides(path_a, path_b)
    return _SIDES[path_a, path_b]


def common_cuts(raw: bytes) -> np.ndarray:
    """Places other than the first where both sides can be cut; a space alone at the end stays with what is before it."""
    data = np.frombuffer(raw, np.uint8)
    at = cuts(data, np.array([0, len(data)]))
    at = at[(data[at] == 0x20) & (at > 0)]
    return at[at < len(data) - 1]


class Texts(NamedTuple):
    """What texts give, one entry each: good is false where a side does not read a text back, which then has nothing."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    said: list[bytes]
    pairs: list[np.ndarray]
    times: list[np.ndarray]


def aligned(side: Sides, raws: list[bytes]) -> Texts:
    """Tokens, groups and links of texts that begin and end at common cuts, all at once.

    Offsets count through all texts. Links are the stretches between neighbouring token ends of either side, groups
    those between common ends.
    """
    data = np.frombuffer(b"".join(raws), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raws])]).astype(np.int64)
    start = cuts(data, offsets)
    start = start[data[start] == 0x20]
    start = start[~(np.isin(start + 1, offsets) & ~np.isin(start, offsets))]  # a space alone at a text's end
    end = np.append(start[1:], len(data)) if len(start) else start
    text_of = np.searchsorted(offsets, start, "right") - 1
    cut_good, length, at = side.cuts(data, start, end)
    good = np.bincount(text_of, ~cut_good, len(raws)) == 0
    length = np.where(good[text_of], length, 0)
    ids, ends = [], []
    for k in range(2):
        stop = np.cumsum(length[k], dtype=np.int64)
        total = int(stop[-1]) if len(stop) else 0
        own = side.pools[k][np.arange(total) + np.repeat(at[k] - (stop - length[k]), length[k])]
        run = np.concatenate([[0], np.cumsum(side.sizes[k][own])])
        ids.append(own)
        ends.append(run[1:] + np.repeat(start - run[stop - length[k]], length[k]))
    marks = np.concatenate(ends)
    marks.sort(kind="stable")  # two sorted runs
    marks = marks[np.diff(marks, prepend=-1) > 0]
    in_a, in_b = (np.searchsorted(e, marks) for e in ends)
    common = marks[(ends[0][in_a] == marks) & (ends[1][in_b] == marks)]
    code = (np.searchsorted(offsets, marks) - 1) << 48 | ids[0][in_a].astype(np.int64) << SHIFT | ids[1][in_b]
    found, times = np.unique(code, return_counts=True)
    per_text = np.searchsorted(found >> 48, np.arange(1, len(raws)))
    found &= (1 << 48) - 1
    group = [np.searchsorted(common, e) for e in ends]
    begun = np.concatenate([[0], common])[:-1]
    place = [np.arange(len(ids[0])) + np.searchsorted(ends[1], begun, "right")[group[0]], np.arange(len(ids[1])) + np.searchsorted(ends[0], common, "right")[group[1]]]
    said, size = np.zeros(len(ids[0]) + len(ids[1]), "S7"), np.zeros(len(ids[0]) + len(ids[1]), np.int64)
    for k in range(2):
        last = np.append(group[k][1:] != group[k][:-1], True)[: len(group[k])]
        said[place[k]] = np.where(last, side.said[k][1][ids[k]], side.said[k][0][ids[k]])
        size[place[k]] = side.said_length[k][ids[k]]
    letters = said.view(np.uint8)
    letters = letters[letters != 0].tobytes()
    n_a, n_b, n_groups = (np.diff(np.searchsorted(e, offsets, "right")) for e in (*ends, common))
    edge = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
    return Texts(good, n_a, n_b, n_groups, [letters[a : max(a, b - 1)] for a, b in zip(edge, edge[1:])], np.split(found, per_text), np.split(times, per_text))


class Closed:
    """Groups of a stretch one after another: how many there are, what they say and their links."""

    def __init__(self):
        self.said, self.pairs, self.n_groups, self.good = [], [], 0, True

    def add_text(self, side: Sides, raw: bytes) -> tuple[int, int]:
        """Add the groups of bytes that begin and end at common cuts; the number of tokens of both sides."""
        if not raw:
            return 0, 0
        found = aligned(side, [raw])
        self.good &= bool(found.good[0])
        if found.said[0]:
            self.said.append(found.said[0].decode())
        self.n_groups += int(found.n_groups[0])
        self.pairs.append((found.pairs[0], found.times[0]))
        return int(found.n_a[0]), int(found.n_b[0])

    def add(self, groups: list[Group]) -> None:
        self.said += [g.said() for g in groups]
        self.n_groups += len(groups)
        links = np.array([x for g in groups for x in g.links()], np.int64)
        self.pairs.append((links, np.ones(len(links), np.int64)))

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Different links and how often each occurs."""
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, back = np.unique(np.concatenate([p for p, _ in self.pairs]), return_inverse=True)
        return pairs, np.bincount(back, np.concatenate([n for _, n in self.pairs]), len(pairs)).astype(np.int64)


#: Groups of a stretch of a text: `at` is its first byte; a whole text of up to LONG bytes is one stretch.
PIECE = "row long, doc_id long, at long, good boolean, n_a long, n_b long, n_groups long, said string, pairs array<long>, times array<long>"
FRAGMENT = "no long, fragment array<array<long>>"
TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<array<long>>": pa.list_(pa.list_(pa.int64()))}


def _batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in kind.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _in_batches(rows: Iterator[tuple], kind: str, most: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held, kind)
            held = []
    yield _batch(held, kind)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(row, doc_id, bytes) of the rows of batches."""
    for batch in batches:
        for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            yield row, doc_id, text.as_buffer().to_pybytes() if text.is_valid else b""


def _runs(texts: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Texts in runs of about CHUNK_BYTES."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text[2])
        if size >= CHUNK_BYTES or len(held) == 1 << 14:
            yield held
            held, size = [], 0
    if held:
        yield held


def short_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One piece for every text, where it is read; `said` is the digest of its groups already."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = sides(path_a, path_b)

        def rows() -> Iterator[tuple]:
            for held in _runs(_texts(batches)):
                found = aligned(side, [b" " + raw if raw else raw for _, _, raw in held])
                counts = zip(found.n_a.tolist(), found.n_b.tolist(), found.n_groups.tolist(), found.said, found.pairs, found.times)
                for (row, doc_id, _), (n_a, n_b, n_groups, said, pairs, times) in zip(held, counts):
                    yield row, doc_id, 0, True, n_a, n_b, n_groups, hashlib.sha256(said).hexdigest() if n_a else "", pairs, times

        yield from _in_batches(rows(), PIECE)

    return docs.mapInArrow(align, PIECE)


def next_cut(data: np.ndarray, at: int, spaces: bool) -> int:
    """The first place from `at` on where a side can be cut: the first side, or, with `spaces`, the second."""
    for low in range(at, len(data), LONG):
        part = data[low - 3 : low + LONG]
        if spaces:
            mark = (part[:-3] == 0xE2) & (part[1:-2] == 0x96) & (part[2:-1] == 0x81)
            can = np.flatnonzero((part[3:] == 0x20) & (part[2:-1] != 0x20) & ~mark)
        else:
            can = cuts(part, np.array([0, len(part)])) - 3
        can = can[(can >= 0) & (can + low < len(data) - 1)]
        if len(can):
            return low + int(can[0])
    return len(data)


CHUNK = "row long, doc_id long, no long, start long, places array<long>, chunk binary"


def chunked(docs: DataFrame) -> DataFrame:
    """Long texts as chunks: bytes from `start` on, with the first and last place of each side among them."""

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, doc_id, raw in _texts(batches):
            data = np.frombuffer(b" " + raw, np.uint8)
            a = b = no = 0
            for at in range(LONG, len(data) + LONG, LONG):
                a_to = max(a, next_cut(data, at, False)) if at < len(data) else len(data)
                b_to = max(b, next_cut(data, at, True)) if at < len(data) else len(data)
                if a == a_to and b == b_to:
                    continue
                low, high = min(a, b), max(a_to, b_to)
                columns = [[row], [doc_id], [no], [low], [[a, b, a_to, b_to]], [data[low:high].tobytes()]]
                kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split(" ")[0] for f in CHUNK.split(", ")])
                a, b, no = a_to, b_to, no + 1

    return docs.mapInArrow(divide, CHUNK)


def fragment_of(side: Sides, raw: bytes, start: int, a: int, b: int, a_to: int, b_to: int) -> tuple[Fragment | None, Closed, int, int]:
    """The fragment of a chunk, its closed groups, and its tokens of both sides; none if a side does not read back."""
    own = Closed()
    bytes_of = lambda x, y: raw[x - start : y - start]
    low, high = max(a, b), min(a_to, b_to)
    between = common_cuts(raw) + start
    between = between[(between > low) & (between < min(high, b_to - 1))].tolist()
    if a == b:
        between.insert(0, low)
    if a_to == b_to and high > low:
        between.append(high)
    if not between:
        one, two = side.tokens_a(bytes_of(a, a_to), a), side.tokens_b(bytes_of(b, b_to), b)
        if one is None or two is None:
            return None, own, 0, 0
        fragment, groups = closed(Stretch(a, b, one, two))
        own.add(groups)
        return fragment, own, len(one.ids), len(two.ids)
    first, last = between[0], between[-1]
    ends = [side.tokens_a(bytes_of(a, first), a), side.tokens_b(bytes_of(b, first), b), side.tokens_a(bytes_of(last, a_to), last), side.tokens_b(bytes_of(last, b_to), last)]
    if any(e is None for e in ends):
        return None, own, 0, 0
    nothing = Tokens([], [])
    whole, groups = compose(closed(Stretch(a, b, ends[0], ends[1]))[0], Fragment(Stretch(first, first, nothing, nothing), Stretch(last, last, nothing, nothing)))
    own.add(closed(Stretch(a, b, ends[0], ends[1]))[1] + groups)
    n_a, n_b = own.add_text(side, bytes_of(first, last))
    tail, groups = closed(Stretch(last, last, ends[2], ends[3]))
    whole, more = compose(whole, tail)
    own.add(groups + more)
    return (whole if own.good else None), own, n_a + len(ends[0].ids) + len(ends[2].ids), n_b + len(ends[1].ids) + len(ends[3].ids)


def long_texts(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """(pieces of long texts, rows with a text that a side does not read back)."""
    chunks = written(chunked(docs))
    kind = f"{PIECE}, {FRAGMENT}"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = sides(path_a, path_b)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for r in batch.to_pylist():
                    fragment, own, n_a, n_b = fragment_of(side, r["chunk"], r["start"], *r["places"])
                    if fragment is None:
                        yield r["row"], r["doc_id"], r["start"], False, 0, 0, 0, None, [], [], r["no"], None
                    else:
                        said = ";".join(own.said) if own.n_groups else None
                        yield r["row"], r["doc_id"], max(r["places"][:2]), True, n_a, n_b, own.n_groups, said, *own.counted(), r["no"], flat(fragment)

        yield from _in_batches(rows(), kind, 1)

    found = written(chunks.repartition(tasks(chunks), "row", "no").mapInArrow(align, kind))
    pieces, level = found.drop("no", "fragment"), found.select("row", "doc_id", "no", "fragment")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, doc_id, whole = None, None, None

            def folded() -> tuple:
                return now[0], doc_id, None, whole is not None, 0, 0, 0, None, [], [], now[1], flat(whole) if whole else None

            for batch in batches:
                for r in batch.to_pylist():
                    at, fragment = (r["row"], r["no"] // FAN), unflat(r["fragment"]) if r["fragment"] is not None else None
                    if at != now:
                        if now is not None:
                            yield folded()
                        now, doc_id, whole = at, r["doc_id"], fragment
                    elif whole is None or fragment is None:
                        whole = None
                    else:
                        whole, groups = compose(whole, fragment)
                        if groups:
                            own = Closed()
                            own.add(groups)
                            yield at[0], doc_id, groups[0].start, True, 0, 0, own.n_groups, ";".join(own.said), *own.counted(), None, None
            if now is not None:
                yield folded()

        yield from _in_batches(rows(), kind, 64)

    most = level.agg(F.max("no")).first()[0] or 0
    while most > 0:
        dealt = level.repartition(tasks(level), F.col("row"), F.floor(F.col("no") / FAN)).sortWithinPartitions("row", "no")
        found = stored(dealt.mapInArrow(fold, kind))
        pieces = pieces.unionByName(found.filter("no is null").drop("no", "fragment"))
        level, most = found.filter("no is not null").select("row", "doc_id", "no", "fragment"), most // FAN
    bad = level.filter("fragment is null").select("row", "doc_id")
    return pieces.join(bad.select("row"), "row", "left_anti"), bad


def digests(pieces: DataFrame) -> DataFrame:
    """The sums of a row's pieces and the digest of its groups in order, streamed."""
    kind = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, doc_id, sums, digest = None, None, [0, 0, 0], None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["row"] != now:
                        if now is not None:
                            yield now, doc_id, *sums, digest.hexdigest()
                        now, doc_id, sums, digest, some = r["row"], r["doc_id"], [0, 0, 0], hashlib.sha256(), False
                    sums = [s + r[c] for s, c in zip(sums, ("n_a", "n_b", "n_groups"))]
                    if r["said"] is not None:
                        digest.update((";" if some else "").encode() + r["said"].encode())
                        some = True
            if now is not None:
                yield now, doc_id, *sums, digest.hexdigest()

        yield from _in_batches(rows(), kind)

    ordered = pieces.repartition(tasks(pieces), "row").sortWithinPartitions("row", "at")
    return ordered.select("row", "doc_id", "at", "n_a", "n_b", "n_groups", "said").mapInArrow(run, kind)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): how many texts hold a pair of ids linked, and whether no other pair of its first id is in more."""
    a = F.shiftright("pair", SHIFT)
    counts = stored(found.groupBy("pair").agg(F.sum("texts").alias("n")))
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("highest"))
    return stored(counts.withColumn("a", a).join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")))


def scored(spark: SparkSession, rows: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """Rows with pairs and times, with n_links, n_best and count_sum instead."""
    if counts.count() > most:
        keep = [c for c in rows.columns if c not in ("pairs", "times")]
        each = rows.select("row", "at", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "at", "x.*")
        each = each.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
        spread = counts.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        met = each.join(spread, (each["pairs"] == spread["pair"]) & (each["salt"] == spread["salt"]))
        sums = met.groupBy("row", "at").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
        )
        links = F.aggregate("times", F.lit(0).cast("long"), lambda x, y: x + y).alias("n_links")
        own = rows.select(*keep, links).join(sums, ["row", "at"], "left")
        return own.select(*keep, "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"))
    table = counts.toArrow()  # `most` rows of 17 bytes at most
    order = np.argsort(table["pair"].to_numpy())
    shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy()[order] for c in ("pair", "n", "best")))
    names = [c for c in rows.columns if c not in ("pairs", "times")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            pairs, times = batch.column(batch.schema.get_field_index("pairs")), batch.column(batch.schema.get_field_index("times"))
            edges = pairs.offsets.to_numpy()
            flat_pairs, flat_times = (x.values.to_numpy()[x.offsets[0].as_py() : x.offsets[-1].as_py()] for x in (pairs, times))
            at = np.searchsorted(pair, flat_pairs)
            sums = []
            for value in (flat_times, flat_times * best[at], flat_times * n[at]) if len(pair) else [flat_times] * 3:
                running = np.concatenate([[0], np.cumsum(value)])
                sums.append(pa.array(np.diff(running[edges - edges[0]]).astype(np.int64)))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, *sums], names=[*names, "n_links", "n_best", "count_sum"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    return rows.mapInArrow(look_up, f"{kind}, n_links long, n_best long, count_sum long")


def align(spark: SparkSession, documents: DataFrame, path_a: str, path_b: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Groups and links of the tokens of two tokenizers over the same texts, one row per input row.

    Returns (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256). Side A encodes a space and the
    text with the tokenizers file `path_a`, side B the text with the sentencepiece file `path_b`, which puts that
    space there itself; strings of special tokens are plain text. Groups end where tokens of both sides end; links are
    all pairs of tokens whose bytes overlap. A pair of ids counts once for every row that holds it, repeated rows
    included; `n_best` counts the links of which no other pair of the A id is in more rows, ties included. Null and
    empty texts, and texts that a side does not read back as they are (with U+2581, for one), have zeros and ''. A
    null doc_id stays null. Empty tables give empty results. Other columns are not read.
    """
    text = F.col("`text`").cast("string")
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col("`doc_id`").cast("long").alias("doc_id"), text.alias("text"))
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > LONG
    # Rows are numbered once and written: whoever reads them later sees the same numbers.
    short = written(short_texts(docs.filter(~long), path_a, path_b))
    pieces, bad = long_texts(docs.filter(long), path_a, path_b)
    pieces = written(pieces)
    from_short = short.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("texts"))
    from_long = pieces.select("row", F.explode("pairs").alias("pair")).distinct().groupBy("pair").agg(F.count(F.lit(1)).alias("texts"))
    counts = pair_counts(from_short.unionByName(from_long))
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    one = scored(spark, short.withColumnRenamed("said", "groups_sha256"), counts, most_pairs)
    many = scored(spark, pieces.select("row", "at", "pairs", "times"), counts, most_pairs)
    many = many.groupBy("row").agg(*[F.sum(c).alias(c) for c in sums[3:]]).join(digests(pieces), "row")
    nothing = bad.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in sums], F.lit("").alias("groups_sha256"))
    columns = ["doc_id", *sums, "groups_sha256"]
    return one.select(columns).unionByName(many.select(columns)).unionByName(nothing)
