"""SimHash groups, tokenizer alignment and hard negatives against brute force."""

import math
import os
import random
import sys

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from pingscape.llm import alignment, negatives, queries, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"
PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
KIND = "doc_id long, text string, fp long, key string, label int, component string, salt int, copies string"


def docs_table(spark, rows):
    """Documents with extra columns named like the operators' own."""
    return spark.createDataFrame([(d, t, 7, "k", 1, "s", 3, "r") for d, t in rows], KIND)


def brute_fingerprint(text, width=3):
    w = brute.spaced((text or "").translate(brute.LOWER))
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(values, reach=3):
    """value -> smallest value reachable by steps of `reach` bits or fewer."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= reach:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def flipped(rng, value, n):
    for b in rng.sample(range(64), n):
        value ^= 1 << b
    return value


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=5))
def test_chains_find_what_is_within_reach(value, bits):
    other = value
    for b in bits:
        other ^= 1 << b
    a, b = (np.array([x], np.uint64) for x in (value, other))
    keys = [{(first, int(k)) for first, _, ks in simhash.chain_keys(x) for k in ks} for x in (a, b)]
    shared = {first for first, _ in keys[0] & keys[1]}
    passed = any(simhash.chained(a, b, np.array([first]))[0] for first in shared)
    assert passed == (len(bits) <= 3)


@pytest.mark.parametrize("most", [4096, 8])
def test_close_fingerprints(spark, most):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    values = [flipped(rng, centre, rng.randrange(7)) for _ in range(250)] + [rng.getrandbits(64) for _ in range(100)] + [0, 2**64 - 1]
    for _ in range(60):
        values.append(flipped(rng, values[-1], rng.randrange(1, 5)))  # chains
    values += [(centre & 0xFFFFFFFF) | (rng.getrandbits(32) << 32) for _ in range(150)]  # one key for all
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    table = spark.createDataFrame([(signed(v),) for v in set(values)], "fp long").repartition(3)
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.close_fingerprints(table, most).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in links)
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {v: find(v) for v in root} == brute_groups(values)


def test_a_key_gives_few_links():
    """Thousands of fingerprints that all link with each other give about one link each, not all pairs."""
    values = np.array([sum(1 << b for b in bits) for bits in [(i, j, 63 - k) for i in range(12) for j in range(12, 20) for k in range(12)]], np.uint64)
    values = np.unique(values)
    links = simhash.joining_links(np.zeros(len(values), np.uint64), np.zeros(len(values), np.int8), values)
    assert sum(len(a) for a, _ in links) <= 4 * len(values)


def test_simhash_groups(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(900)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "Ünder A-Z ÜNDER"), (None, "one two"), (None, None)]
    rows += [(10, " ".join(base)), (11, " ".join(base)), (11, "another text under this id"), (11, "another text under this id")]
    for i in range(25):  # near copies with single words changed
        w = list(base)
        for _ in range(i // 6):
            w[rng.randrange(900)] = "new"
        rows.append((100 - i, "\n".join(w)))
    rows += [(200 + i, "the same text over and over") for i in range(120)]  # a heavy fingerprint
    got = simhash.simhash_groups(spark, docs_table(spark, rows).repartition(3), most=4)
    prints = [brute_fingerprint(t) for _, t in rows]
    group = brute_groups([f for (d, _), f in zip(rows, prints) if d is not None])
    low = {}
    for (d, _), f in zip(rows, prints):
        if d is not None:
            low[group[f]] = min(d, low.get(group[f], d))
    want = [(d, f"{f:016x}", None if d is None else low[group[f]]) for (d, _), f in zip(rows, prints)]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
    assert len({w[2] for w in want}) < len({w[1] for w in want})
    assert simhash.simhash_groups(spark, docs_table(spark, [])).count() == 0


def test_simhash_query(spark):
    docs = [(r["doc_id"], brute_fingerprint(r["text"])) for r in queries.table(spark, SF, "documents").collect()]
    group = brute_groups([f for _, f in docs])
    low = {}
    for d, f in docs:
        low[group[f]] = min(d, low.get(group[f], d))
    got = queries.QUERIES["op11_simhash_near_duplicates"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((d, f"{f:016x}", low[group[f]]) for d, f in docs)


def brute_negatives(rows, every=100, positives=5, negatives=10):
    best = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        best[i] = min(best.get(i, row), row)
    out = []
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, (label, v) in best.items():
        if i % every:
            continue
        scores = sorted((-product(v, w), j, k) for j, (k, w) in best.items() if j != i)
        for p, pid, _ in [s for s in scores if s[2] == label][:positives]:
            inside = [(s, j) for s, j, k in scores if k != label and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(i, pid, n + 1, j, -p, -s) for n, (s, j) in enumerate(inside[:negatives])]
    return sorted(out)


def vectors_table(spark, rows):
    kind = "vec_id long, embedding array<float>, label int, v string, band int, positives int, score string"
    return spark.createDataFrame([(i, v, k, "v", 1, 2, "s") for i, v, k in rows], kind)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:  # several lines, bands and blocks
        monkeypatch.setattr(negatives, "ANCHOR_ROWS", 5)
        monkeypatch.setattr(negatives, "BAND_ROWS", 150)
        monkeypatch.setattr(negatives, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(-50, 700):
        centre = np.zeros(12)
        centre[i % 3] = 1.0
        v = np.round(centre + rng.normal(0, 0.4, 12), 1).astype(np.float32).tolist()  # rounded: ties
        rows.append((i, v, 1 if i % 3 == 0 else int(rng.integers(0, 10))))
    rows += [(10, rows[3][1], 4), (20, rows[4][1], 1), (20, rows[4][1], 1)]  # repeated ids
    rows += [(None, rows[0][1], 1), (1000, None, 1), (1010, rows[0][1], None), (1020, [None] * 12, 1), (1030, [float("nan")] * 12, 1),
             (1040, [0.0] * 12, 2), (1050, [1.0, -0.5], 3), (1060, [-9.0] * 12, 8), (1070, [], 2)]
    got = negatives.hard_negatives(spark, vectors_table(spark, rows).repartition(4), every=10)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, every=10)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500
    assert negatives.hard_negatives(spark, vectors_table(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.floats(-400, 400), st.floats(0, 500))
def test_vertical_scan_loses_nothing(seed, least, wide):
    rng = np.random.default_rng(seed)
    m, q = rng.integers(-12, 13, (60, 21)), rng.integers(-12, 13, 21)
    block = negatives.Block(np.arange(60), np.zeros(60), m)
    rows, scores = negatives.vertical_scan(q, block, np.arange(0, 60, 2), least, least + wide)
    whole = m @ q
    want = [i for i in range(0, 60, 2) if least <= whole[i] <= least + wide]
    assert rows.tolist() == want and scores.tolist() == whole[want].tolist()


def test_hard_negatives_query(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in queries.table(spark, SF, "embeddings").collect()]
    assert sorted(map(tuple, queries.QUERIES["op13_hard_negatives"](spark, SF).collect())) == brute_negatives(rows)


@pytest.fixture(scope="module")
def side():
    return alignment.sides(PATH_A, PATH_B)


def brute_tokens(side, text):
    """(ids, ends) of both sides of a whole text, or nothing where one does not read back."""
    whole = (" " + text).encode()
    return (side.tokens_a(whole), side.tokens_b(whole)) if text else (None, None)


def brute_alignment(side, docs):
    out, held = [], {}
    for d, text in docs:
        a, b = brute_tokens(side, text or "")
        if a is None or b is None:
            out.append((d, None, [], []))
            continue
        starts = lambda t: [0, *t.ends[:-1]]
        common = sorted({*a.ends} & {*b.ends})
        inside = lambda t, low, high: ",".join(str(i) for i, e in zip(t.ids, t.ends) if low < e <= high)
        groups = [f"{inside(a, low, high)}|{inside(b, low, high)}" for low, high in zip([0, *common], common)]
        links, j0 = [], 0
        for i, s, e in zip(a.ids, starts(a), a.ends):
            while b.ends[j0] <= s:
                j0 += 1
            j = j0
            while j < len(b.ids) and (b.ends[j - 1] if j else 0) < e:
                links.append((i, b.ids[j]))
                j += 1
        out.append((d, (len(a.ids), len(b.ids)), groups, links))
        for x in set(links):
            held[x] = held.get(x, 0) + 1
    best = {}
    for (i, _), n in held.items():
        best[i] = max(n, best.get(i, 0))
    rows = []
    for d, n, groups, links in out:
        digest = brute.sha(";".join(groups)) if n else ""
        rows.append((d, *(n or (0, 0)), len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), digest))
    return sorted(rows, key=repr)


ODD = st.text(alphabet=st.sampled_from("ab1.'’é ßλ中 \t\n\r\x85\xa0　😀▁<|endoftext|>"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_cuts_change_no_tokens_of_either_side(text):
    side = alignment.sides(PATH_A, PATH_B)
    raw = (" " + text).encode()
    own = alignment.Closed()
    n_a, n_b = own.add_text(side, raw if text else b"")
    want = brute_alignment(side, [(1, text)])[0]
    if own.good and text:
        assert (n_a, n_b, own.n_groups, brute.sha(";".join(own.said))) == (*want[1:4], want[-1])
        assert int(own.counted()[1].sum()) == want[4]
    else:
        assert want == (1, 0, 0, 0, 0, 0, 0, "")


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_fragments_compose_in_any_tree(data):
    """Any division of both sides' tokens, folded in any order, gives the groups of the whole."""
    size = data.draw(st.integers(1, 40))
    side_ends = [sorted(data.draw(st.sets(st.integers(1, size))) | {size}) for _ in range(2)]
    a, b = (alignment.Tokens(list(range(1, len(e) + 1)), e) for e in side_ends)
    _, whole = alignment.closed(alignment.Stretch(0, 0, a, b))
    n = data.draw(st.integers(1, 6))
    divided = []
    for t in (a, b):
        at = sorted(data.draw(st.lists(st.integers(0, len(t.ids)), min_size=n - 1, max_size=n - 1)))
        edges = [0, *at, len(t.ids)]
        divided.append([(0 if x == 0 else t.ends[x - 1], t.part(x, y)) for x, y in zip(edges, edges[1:])])
    parts, groups = [], []
    for (a_from, x), (b_from, y) in zip(*divided):
        fragment, found = alignment.closed(alignment.Stretch(a_from, b_from, x, y))
        parts.append(alignment.unflat(alignment.flat(fragment)))
        groups += found
    while len(parts) > 1:
        i = data.draw(st.integers(0, len(parts) - 2))
        fragment, found = alignment.compose(parts[i], parts[i + 1])
        parts[i : i + 2] = [fragment]
        groups += found
    assert sorted(groups) == whole
    assert all(not s.a.ids and not s.b.ids for s in parts[0] if s is not None)


@pytest.mark.parametrize("long,most", [(1 << 16, 10**6), (300, 10**6), (40, 10)])
def test_alignment(spark, side, monkeypatch, long, most):
    monkeypatch.setattr(alignment, "LONG", long)
    rng = random.Random(6)
    vocabulary = ["the", "Of", "Über", "x1", "don't", "λόγος", "end.", "<|endoftext|>", "\n", "\t\n", " ", "中文字", "😀", "tokenization", "12345", "<s>"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(1, None), (2, ""), (3, " "), (4, "  a "), (5, say(500)), (6, "bad ▁ " + say(300)), (7, say(300) + "▁"), (8, "x" * 700), (9, "中" * 400)]
    rows += [(None, say(60)), (None, None), (10, say(100)), (10, say(100)), (11, "same text"), (11, "same text")]
    rows += [(12, "\n".join(say(9) for _ in range(60))), (13, "a b" * 200), (14, "word\tword\n" * 90), (15, " " * 500 + "a"), (16, say(300) + " ")]
    docs = spark.createDataFrame([(d, t, 1, "at", 2, ["n"]) for d, t in rows], "doc_id long, text string, row int, at string, pair int, pairs array<string>")
    got = alignment.align(spark, docs.repartition(3), PATH_A, PATH_B, most)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_alignment(side, rows)
    if long == 300:
        assert alignment.align(spark, docs.filter("false"), PATH_A, PATH_B).count() == 0


def test_alignment_query(spark, side):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, SF, "documents").collect()]
    got = queries.QUERIES["op12_tokenizer_alignment"](spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == brute_alignment(side, docs)
