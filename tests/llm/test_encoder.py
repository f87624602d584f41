"""Token ids from cuts between kinds of characters, encoded as one text, against the library on whole texts."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from pingscape.llm import alignment, tokens
from pingscape.llm.words import text_bytes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    "a", "Zz", "they", "7", "42", "'", "'s", "'ll", "''", "’", ".", "?!", "<|", "|>", "<|endoftext|>", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1f",
    "\x00", "\x7f", "é", "ß", "é", "日本", "\u0085", " ", "　", "🙂", "½", "_", "-", "▁",
]


class Counting:
    """A tokenizer that counts the texts and bytes it is given."""

    def __init__(self, own):
        self.own, self.texts, self.size = own, 0, 0

    def encode_batch_fast(self, texts, **said):
        self.texts += len(texts)
        self.size += sum(len(t.encode()) for t in texts)
        return self.own.encode_batch_fast(texts, **said)


def ids_of(coder, texts):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    start = coder.cuts(data, offsets)
    length, at = coder.encode(data, start, np.append(start[1:], len(data)))
    edges = np.searchsorted(start, offsets)
    return [[int(i) for k in range(x, y) for i in coder.pool[at[k] : at[k] + length[k]]] for x, y in zip(edges, edges[1:])]


@pytest.mark.parametrize("plain", [False, True])
def test_ids_are_those_of_whole_texts(plain):
    draw = random.Random(5)
    texts = ["".join(draw.choices(PARTS, k=draw.randrange(1, 30))) for _ in range(4000)] + ["", "don't.stop'S9lives", "x<|endoftext|>'s<|endoftext|", "|>y"]
    coder = tokens.Encoder(A, keep_ids=True, plain=plain)
    library = tokens.checked_tokenizer(A)
    library.encode_special_tokens = plain
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids_of(coder, texts) == wanted
    assert ids_of(coder, texts) == wanted  # from its memory


def test_new_cuts_are_encoded_as_one_text():
    coder = tokens.Encoder(A, keep_ids=True)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(500)]
    texts = [" ".join(w + end for w in words) for end in ("", ",", ".", "!")]
    coder.tokenizer = Counting(coder.tokenizer)
    found = ids_of(coder, texts)
    assert coder.tokenizer.texts <= 2 and coder.tokenizer.size < 1.2 * len(texts[0])
    assert found == [coder.tokenizer.own.encode(t, add_special_tokens=False).ids for t in texts]


def test_bytes_that_are_no_text_are_encoded_cut_by_cut():
    raws = [b"ab\xff\xfecd ef", b"\xe6\x97 x", b"12\xc3"]
    data = np.frombuffer(b"".join(raws), np.uint8)
    offsets = np.cumsum([0, *map(len, raws)])
    coder = tokens.Encoder(A, keep_ids=True)
    start = coder.cuts(data, offsets)
    length, _ = coder.encode(data, start, np.append(start[1:], len(data)))
    counts = tokens.row_sums(length, np.searchsorted(start, offsets)).tolist()
    assert counts == [len(coder.tokenizer.encode(r.decode("utf-8", "replace"), add_special_tokens=False).ids) for r in raws]


def test_new_cuts_of_an_alignment_are_encoded_as_one_text():
    side = alignment.Sides(A, B)
    side.coder.tokenizer = Counting(side.a)
    raws = [" ".join(["", *[f"u{chr(97 + i % 26)}{chr(97 + i // 26)}v{end}" for i in range(300)]]).encode() for end in ("", ",", ".")]
    found = alignment.aligned(side, raws)
    assert side.coder.tokenizer.texts <= 3
    assert found.good.all()
    assert found.n_a.tolist() == [len(side.a.encode(r.decode(), add_special_tokens=False).ids) for r in raws]
    assert found.n_b.tolist() == [len(side.b.encode(r.decode()[1:])) for r in raws]
    mixed = alignment.aligned(side, [" fine".encode(), " a▁b".encode(), " ok �".encode(), b" no \xff"])
    assert mixed.good.tolist() == [True, False, True, False]
