"""Token counts and token ids of whole texts by a tokenizer file of the tokenizers library.

A text is cut before every run of white space that follows a visible character. The splitting rule of a byte-level
BPE never puts white space after another character into one token and never looks back, so the ids of a text are
those of its cuts one after another, and special strings, which hold no white space, stay whole. It is cut between
ASCII letters, digits and other visible characters too, where that rule always ends a token, but not at an apostrophe,
which may begin a contraction, and not in or at a special string. Most cuts repeat: each worker encodes a cut once and
remembers it in a table of fixed size under a 128-bit hash. New cuts are encoded as one text, which is divided by the
bytes of its tokens; where these do not end with the cuts, one by one.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Alphabet, byte_hashes, chunks

PLAIN = Alphabet(b"", lower=False)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
#: First bytes of two-byte code points among which there is no white space (U+0085 and U+00A0 begin with C2).
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True
#: ASCII letters, digits and other visible characters without the apostrophe.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x27] = 0

#: What a worker keeps and works on at once: entries of its table, ids of its pool, bytes of new cuts and of texts.
SLOTS = 1 << 20
POOL_IDS = 1 << 22
ENCODE_BYTES = 1 << 16
TEXT_BYTES = 1 << 19


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a text begins or can be cut without changing its tokens."""
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        seen = _VISIBLE[data[:-1]]
        seen[1:] |= (data[1:-1] >= 0x80) & _LEAD[data[:-2]]
        cut[1:] = _SPACE[data[1:]] & seen
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


def fine_cuts(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> np.ndarray:
    """The same and the places between two kinds of ASCII characters, but none that touches a special string."""
    kind, cut = _KIND[data], np.zeros(len(data), bool)
    cut[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    raw = data.tobytes() if special else b""
    for text in special:
        at = raw.find(text)
        while at >= 0:
            cut[at : at + len(text) + 1] = False
            at = raw.find(text, at + 1)
    cut[cuts(data, offsets)] = True
    return np.flatnonzero(cut)


def checked_tokenizer(path: str):
    """The tokenizer without truncation and padding; cutting needs a byte-level rule and plain special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    rule = said.get("pre_tokenizer") or {}
    odd = [t["content"] for t in said.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"])]
    if rule.get("type") != "ByteLevel" or rule.get("add_prefix_space") or not rule.get("use_regex", True) or said.get("normalizer") or odd:
        raise ValueError(f"{path}: texts can be cut for byte-level tokenizers without normalisation only")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Encoder:
    """Token ids of cuts, remembered in a table of SLOTS entries and a pool of ids of bounded size."""

    def __init__(self, path: str, keep_ids: bool, plain: bool = False):
        """With `plain`, strings of special tokens are plain text."""
        self.tokenizer, self.keep_ids = checked_tokenizer(path), keep_ids
        self.tokenizer.encode_special_tokens = plain
        said = self.tokenizer.get_vocab(with_added_tokens=True)
        # A byte-level token has a character for every byte, an added one its own text.
        added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = [t for t in added.values() if t]
        self.sizes = np.zeros(max(said.values(), default=0) + 1, np.int64)
        for token, i in said.items():
            self.sizes[i] = len(added.get(i, token))
        self.keys = np.zeros((2, SLOTS), np.uint64)
        self.length = np.zeros(SLOTS, np.int32)
        self.at = np.zeros(SLOTS, np.int64)
        self.pool, self.used = np.zeros(1 << 20 if keep_ids else 0, np.uint32), 0

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return fine_cuts(data, offsets, self.special)

    def _joined(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Numbers of tokens and ids of cuts encoded as one text; none where its tokens do not end with the cuts.

        A line feed, a token of its own between visible characters, stands before a cut without white space.
        """
        apart = ~_SPACE[data[start]]
        size = end - start + apart
        stop = np.cumsum(size)
        text = data[np.arange(stop[-1]) + np.repeat(start - apart - (stop - size), size)]
        text[(stop - size)[apart]] = 0x0A
        found = self.tokenizer.encode_batch_fast([text.tobytes().decode("utf-8", "replace")], add_special_tokens=False)[0].ids
        ids = np.array(found, np.uint32)
        ends = np.cumsum(self.sizes[ids])
        feeds = (stop - size)[apart] + 1
        last, feed = np.searchsorted(ends, stop), np.searchsorted(ends, feeds)
        if ends[-1:].tolist() != stop[-1:].tolist() or (ends[last] != stop).any() or (ends[feed] != feeds).any():
            return None
        return np.diff(last, prepend=-1) - apart, np.delete(ids, feed)

    def _one_by_one(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(start.tolist(), end.tolist())]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.array([len(x) for x in found], np.int64)
        return lengths, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))

    def _encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and pool places of new cuts, in batches of about equal bytes."""
        lengths, at = np.zeros(len(start), np.int32), np.zeros(len(start), np.int64)
        first, last = data[start], data[end - 1]
        two = (end - start > 1) & (last >= 0x80) & _LEAD[data[np.maximum(end - 2, 0)]]
        whole = (_SPACE[first] | _VISIBLE[first]) & (_VISIBLE[last] | two)  # may stand beside others in one text
        for can, way in ((whole, self._joined), (~whole, self._one_by_one)):
            some = np.flatnonzero(can)
            batch = (np.cumsum((end - start)[some]) // ENCODE_BYTES).astype(np.int64)
            for own in np.split(some, np.flatnonzero(np.diff(batch)) + 1) if len(some) else []:
                n, ids = way(data, start[own], end[own]) or self._one_by_one(data, start[own], end[own])
                lengths[own] = n
                if self.keep_ids:
                    if self.used + len(ids) > len(self.pool):
                        self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool) // 2), np.uint32)])
                    self.pool[self.used : self.used + len(ids)] = ids
                    at[own] = self.used + np.cumsum(n) - n
                    self.used += len(ids)
        return lengths, at

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of every cut, and where its ids lie in the pool."""
        if self.used > POOL_IDS:
            self.used = 0
            self.keys[:] = 0
        one, two = (byte_hashes(data, start, end, PLAIN, w) for w in (0, 1))
        slot = (one & np.uint64(SLOTS - 1)).astype(np.int64)
        length, at = self.length[slot], self.at[slot]
        new = np.flatnonzero((self.keys[0, slot] != one) | (self.keys[1, slot] != two))
        if len(new):
            _, first, back = np.unique(one[new] ^ (two[new] << np.uint64(1)), return_index=True, return_inverse=True)
            places = new[first]
            lengths, ats = self._encode(data, start[places], end[places])
            length[new], at[new] = lengths[back], ats[back]
            there = slot[places]
            self.keys[0, there], self.keys[1, there] = one[places], two[places]
            self.length[there], self.at[there] = lengths, ats
            # Of several new cuts with one slot the last entry stays whole: all four arrays take the same last one.
        return length, at


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keep_ids: bool) -> Encoder:
    """The worker's encoder for a file."""
    if (path, keep_ids) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, keep_ids] = Encoder(path, keep_ids)
    return _ENCODERS[path, keep_ids]


def row_sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring firsts."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(sums[firsts])


def encoded_chunks(column: pa.Array, path: str, keep_ids: bool) -> Iterator[tuple]:
    """(first row, end row, tokens of each text, encoder, (lengths, pool places) of its cuts) for chunks of a column."""
    coder = encoder(path, keep_ids)
    for a, b, data, offsets in chunks(column, TEXT_BYTES):
        start = coder.cuts(data, offsets)
        end = np.append(start[1:], len(data)) if len(start) else start
        length, at = coder.encode(data, start, end)
        yield a, b, row_sums(length, np.searchsorted(start, offsets)), coder, (length, at)


def token_counts(documents: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Token counts of whole texts: (doc_id, n_bytes, n_tokens, over_limit), one row per input row.

    No begin, end or added special tokens; special strings inside a text become what the library makes of them.
    A null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows give repeated rows; an
    empty table gives an empty result. Other columns are not read, whatever their names.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(batch.num_rows, np.int64)
            for a, b, tokens, _, _ in encoded_chunks(batch.column(2), path, keep_ids=False):
                total[a:b] = tokens
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(total), pa.array(total > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    text = F.col("`text`").cast("string")
    rows = documents.select(
        F.col("`doc_id`").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"),
    )
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
