"""Licence scan: Aho-Corasick over the words of a text, and licence expressions evaluated after shunting-yard."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notice phrases (words as the scan sees them) and the label each stands for.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases of the method.
MORE_PHRASES = {
    "apache license version 2 0": "apache-2.0",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by sa": "cc-by-sa",
    "gnu affero general public license version 3": "agpl-3.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
}
#: Fixed value: the words of an identifier tag; an expression follows it up to the end of the line.
TAG = "spdx license identifier"
TAG_LINE = re.compile(rb"(?i)spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)")
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
#: Binding strength: an exception binds closest, then "and", then "or".
STRENGTH = {"with": 3, "and": 2, "or": 1}

_FOLD = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)


def postfix(expression: str) -> list[str] | None:
    """Operators and licence ids in postfix order, or None if the expression does not parse as a whole."""
    out, held, want_id, end = [], [], True, 0
    for m in TOKEN.finditer(expression):
        if expression[end : m.start()].strip():
            break
        token, end = m.group().lower(), m.end()
        if token == "(":
            if not want_id:
                return None
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if want_id or not held:
                return None
            held.pop()
        elif token in STRENGTH:
            if want_id:
                return None
            while held and held[-1] != "(" and STRENGTH[held[-1]] >= STRENGTH[token]:
                out.append(held.pop())
            held.append(token)
            want_id = True
        else:
            if not want_id:  # prose after a whole expression
                break
            out.append(token)
            want_id = False
    if want_id or "(" in held:
        return None
    return out + held[::-1]


def choices(expression: str, most: int = 64) -> list[frozenset[str]] | None:
    """The ways to satisfy an expression: each a set of licences that then hold together.

    None if it does not parse, or has more than `most` ways on the way; `infix` says any expression.
    """
    order = postfix(expression)
    if order is None:
        return None
    stack: list[list[frozenset[str]]] = []
    for token in order:
        if token not in STRENGTH:
            stack.append([frozenset([token])])
            continue
        right, left = stack.pop(), stack.pop()
        if token == "or":
            ways = left + right
        elif token == "and":
            if len(left) * len(right) > most:
                return None
            ways = [a | b for a in left for b in right]
        else:
            if len(left) != 1 or len(right) != 1 or len(left[0]) != 1 or len(right[0]) != 1:
                return None
            ways = [frozenset([f"{min(left[0])} with {min(right[0])}"])]
        ways = list(dict.fromkeys(ways))
        if len(ways) > most:
            return None
        stack.append(ways)
    return stack[0]


def infix(order: list[str]) -> tuple[str, set[str]] | None:
    """A postfix order as one expression, as long as the order itself, and its licences.

    Equal operators in a row are one, with sorted operands; "or" inside "and" has brackets. None where "with" does not
    stand between two ids.
    """
    stack: list[tuple[str, set[str], set[str]]] = []  # operator, none for an id; operands; licences
    for token in order:
        if token not in STRENGTH:
            stack.append(("", {token}, {token}))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            if left[0] or right[0] or " " in min(left[1]) or " " in min(right[1]):
                return None
            one = {f"{min(left[1])} with {min(right[1])}"}
            stack.append(("", one, one))
            continue
        operands: set[str] = set()
        for kind, own, _ in (left, right):
            text = f" {kind} ".join(sorted(own))
            operands |= own if kind in ("", token) else {f"({text})" if kind == "or" else text}
        stack.append((token, operands, left[2] | right[2]))
    kind, own, licences = stack[0]
    return f" {kind} ".join(sorted(own)), licences


def expressed(expression: str, most: int = 64) -> tuple[str, set[str]] | None:
    """What an expression says and its licences: its ways, or, with more than `most`, the expression in its own shape."""
    order = postfix(expression)
    whole = infix(order) if order is not None else None
    ways = choices(expression, most) if whole is not None else None
    if ways is None:
        return whole
    return " or ".join(sorted(" and ".join(sorted(way)) for way in ways)), set().union(*ways)


class Scanner:
    """One automaton for the base phrases, the further phrases and the tag, on words with one space between."""

    def __init__(self, base: dict[str, str], more: dict[str, str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        kinds: dict[str, list[tuple[str, str]]] = {}
        for kind, phrases in (("base", base), ("more", more), ("tag", {TAG: ""})):
            for phrase, label in phrases.items():
                kinds.setdefault(" ".join(phrase.split()), []).append((kind, label))
        for phrase, found in kinds.items():
            key = f" {phrase.encode().decode('latin-1')} "
            self.automaton.add_word(key, (len(key), found))
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple:
        words = text.translate(_FOLD).split(b" ")
        words = [w for w in words if w]
        raw = b" " + b" ".join(words) + b" "
        line = raw.decode("latin-1")
        begins, base, more, tagged = [], set(), set(), False
        for end, (length, kinds) in self.automaton.iter(line):
            for kind, label in kinds:
                if kind == "base":
                    begins.append(end - length + 1)
                    base.add(label)
                elif kind == "more":
                    more.add(label)
                else:
                    tagged = True
        # The space before word number i is the i-th; one pass over them, however many places there are.
        spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x20) if begins else []
        places = np.searchsorted(spaces, begins).tolist()
        expressions = []
        if tagged:
            for m in TAG_LINE.finditer(text):
                found = expressed(m.group(1).decode("utf-8", "replace"))
                if found is not None:
                    expressions.append(found[0])
                    more |= found[1]
        score = 1.0 if expressions else 1 - 0.5 ** (len(places) + len(more)) if places or more else 0.5 * tagged
        return len(words), places, base, more, expressions, score


def license_scan(documents: DataFrame, base: dict[str, str] | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """Licence notices and identifier tags of whole texts, one row per input row.

    Returns doc_id, n_words, n_base (places of base phrases, overlapping ones too), first_word and last_word (their
    smallest and largest start, null without any), base_labels, labels, expressions (the ways to satisfy each parsed
    expression, or the expression in its own shape if they are over 64, one per "; "), score: 1 with a parsed expression, else growing with the notices found.
    A label never holds a comma. A null or empty text has no words and empty labels; null ids, repeated rows and empty
    tables pass through; other columns are not read. A tag with an expression that does not parse gives no label.
    """
    base = BASE_PHRASES if base is None else base
    more = MORE_PHRASES if more is None else more

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, more)
        for batch in batches:
            rows = [scanner.scan(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)]
            first = [min(r[1], default=None) for r in rows]
            last = [max(r[1], default=None) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([len(r[1]) for r in rows], pa.int64()), pa.array(first, pa.int64()),
                    pa.array(last, pa.int64()), pa.array([",".join(sorted(r[2])) for r in rows], pa.string()),
                    pa.array([",".join(sorted(r[2] | r[3])) for r in rows], pa.string()),
                    pa.array(["; ".join(r[4]) for r in rows], pa.string()), pa.array([r[5] for r in rows], pa.float64()),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "expressions", "score"],
            )

    rows = documents.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    return rows.mapInArrow(
        scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, expressions string, score double",
    )
