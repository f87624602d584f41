"""Words of Arrow text columns as numpy arrays: places, hashes and hashes of word windows.

A batch is worked through in chunks of bounded size; a text is never cut, so memory follows the chunk size or the
longest text. All rules on characters are rules on bytes: every separator is ASCII and no byte of a longer code
point is, so cutting bytes is the same as cutting code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(values: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of 64-bit hashes for each seed."""
    return mix(values + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)))


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as far as they have been asked for."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, len(self.up) * 3 // 2)
            for name, step in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                steps = np.full(size, step, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTE_POWERS = (Powers(0xD1342543DE82EF95), Powers(0xAF251AF3B0F025B5))
_WORD_POWERS = (Powers(0x9FB21C651E98DF25), Powers(0xA0761D6478BD642D))


class Alphabet:
    """Which bytes belong to words, whether A-Z is lower-cased, and a random value for every byte."""

    def __init__(self, separators: bytes, lower: bool):
        self.word = np.ones(256, bool)
        self.word[list(separators)] = False
        folded = np.arange(256, dtype=np.uint64)
        if lower:
            folded[65:91] += np.uint64(32)
        self.values = [np.where(self.word, seeded(folded, s), np.uint64(0)) for s in (1, 2)]


#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
LETTERS = Alphabet(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)
#: Words [^\x20\x09-\x0D]+ as they are, and after lower-casing A-Z.
SPACED = Alphabet(b" \t\n\x0b\x0c\r", lower=False)
SPACED_LOWER = Alphabet(b" \t\n\x0b\x0c\r", lower=True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null is empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    if len(column) == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most `limit` bytes, or of one longer row."""
    data, offsets = text_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """The words of some texts: byte places `start` and `end`, hash `h`, and `row` where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet, second: bool = False):
        inside = alphabet.word[data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        before[edges] = False
        after[edges[edges > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(self.start, offsets)
        self.h = byte_hashes(data, self.start, self.end, alphabet, 0)
        self.h2 = byte_hashes(data, self.start, self.end, alphabet, 1) if second else None

    def __len__(self) -> int:
        return len(self.start)

    def row_of(self) -> np.ndarray:
        """The text of every word."""
        return np.repeat(np.arange(len(self.row) - 1), np.diff(self.row))

    def windows(self, k: int, second: bool = False) -> np.ndarray:
        """Hashes of the windows of k words at every word; those that run over the end of a text mean nothing."""
        return window_hashes(self.h2 if second else self.h, k, int(second))

    def windows_at(self, a: int, b: int) -> np.ndarray:
        """Hash of the words from a up to b, as one value in an array."""
        up, _ = _WORD_POWERS[0].upto(b - a)
        return (self.h[a:b] * up).sum(keepdims=True, dtype=np.uint64)

    def whole(self, k: int) -> np.ndarray:
        """True where k words fit into the text."""
        ends = np.repeat(self.row[1:], np.diff(self.row))
        return np.arange(len(self)) + k <= ends


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, alphabet: Alphabet, which: int) -> np.ndarray:
    """Hash of the bytes of every span, from one running sum."""
    up, down = _BYTE_POWERS[which].upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(alphabet.values[which][data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def window_hashes(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    n = len(h)
    up, down = _WORD_POWERS[which].upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=sums[1:])
    ends = np.minimum(np.arange(n) + k, n)
    return seeded((sums[ends] - sums[:n]) * down[:n], k)


def as_long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))
