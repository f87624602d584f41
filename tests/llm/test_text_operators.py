"""Text operators on made edge rows and on the given tables, against brute force."""

import hashlib
import json
import os
import random
import re
import subprocess
import sys
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from pingscape.llm import (  # noqa: E402
    chat, decontamination, licenses, near_dedup, packing, queries, sharding, substring_dedup, tokens, topk, toxicity,
)

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
KIND = "doc_id long, text string, n_words long, key string, spans array<int>, said string, rank int, row string"


def docs_table(spark, rows):
    """Documents with extra columns named like the operators' own."""
    return spark.createDataFrame([(d, t, 7, "k", [1], "s", 3, "r") for d, t in rows], KIND)


@pytest.fixture(scope="module")
def edge_rows():
    rng = random.Random(5)
    vocabulary = ["the", "Of", "Über", "x1", "don't", "λόγος", "end.", "<|im_end|>", "a", "b", "\x00c", "<|endoftext|>"]
    say = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(n))
    base, long_text, passage = say(120), say(4000), say(40)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, say(80) + "\n" + passage + " " + say(30)), (5, passage),
        (6, None), (7, ""), (8, " \t\n"), (9, "one two"), (10, "one  two"), (11, "ONE two"), (None, say(50)), (None, None),
        (12, long_text), (13, "same " * 300), (14, say(60)), (14, say(60)), (15, base), (15, base), (16, "x" * 5000),
        (17, "Under the MIT License. SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0"),
        (18, "a b  c　 d  e\r\n\n f's <|endoftext|> g<|endoftext|>h \u0085 i"), (19, say(33) + passage),
    ]


@pytest.fixture(scope="module")
def edges(spark, edge_rows):
    return docs_table(spark, edge_rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_table(spark, [])


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_token_counts(edges, edge_rows, empty):
    tokenizer = tokens.checked_tokenizer(PATH)
    want = [(d, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for d, t in edge_rows]
    want = sorted(((d, b, n, n > 50) for d, b, n in want), key=repr)
    assert by_row(tokens.token_counts(edges, PATH, 50), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert tokens.token_counts(empty, PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1.'’é ßλ中 \t\n\r\x0b\x85\xa0 　😀<|endoftext|>"), max_size=60))
def test_cuts_do_not_change_tokens(text):
    tokenizer = _tokenizer()
    data = np.frombuffer(text.encode(), np.uint8)
    at = tokens.cuts(data, np.array([0, len(data)]))
    parts = [bytes(data[a:b]).decode() for a, b in zip(at, [*at[1:], len(data)])]
    assert [i for p in parts for i in tokenizer.encode(p, add_special_tokens=False).ids] == tokenizer.encode(text, add_special_tokens=False).ids


def _tokenizer(made=[]):  # noqa: B006
    made or made.append(tokens.checked_tokenizer(PATH))
    return made[0]


def test_contamination(spark, edges, edge_rows, empty):
    items = [(1, edge_rows[4][1]), (2, "one two"), (3, None), (4, ""), (None, edge_rows[0][1]), (10, edge_rows[4][1]), (5, "two"), (6, "q r s t"), (2, "same same same")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, mark string")
    got = by_row(decontamination.contamination(spark, edges, bench), "doc_id", "n_words", "n_hit", "items", "n_items", "contaminated")
    want = [(d, *brute.contamination(t, items)) for d, t in edge_rows]
    assert got == sorted(((d, n, h, i, len(i), h > 0) for d, n, h, i in want), key=repr)
    assert decontamination.contamination(spark, empty, bench).count() == 0
    assert decontamination.contamination(spark, edges, bench.limit(0)).filter("contaminated or n_hit > 0").count() == 0


@pytest.mark.parametrize("hot", [2048, 3])
def test_substring_dedup(spark, edges, edge_rows, empty, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_COUNT", hot)
    out = substring_dedup.dedup_substrings(spark, edges, keep=("doc_id", "row"))
    got = by_row(out.select("rest.*", "n_words", "n_removed", "kept_text"), "doc_id", "row", "n_words", "n_removed", "kept_text")
    want = brute.substring_dedup([t for _, t in edge_rows])
    assert got == sorted(((d, "r", *w) for (d, _), w in zip(edge_rows, want)), key=repr)
    assert substring_dedup.dedup_substrings(spark, empty).count() == 0


def test_first_smallest_and_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    for width in (1, 2, 5, 18):
        x = rng.integers(0, 4, 100).astype(np.uint64)
        got = substring_dedup.first_smallest(x, width)
        assert got.tolist() == [i + int(x[i : i + width].argmin()) for i in range(100 - width + 1)]


def test_near_duplicates(spark, edges, edge_rows, empty):
    got = by_row(near_dedup.near_duplicates(spark, edges), "doc_id", "n_shingles", "component_id", "kept")
    plain = [(d, t) for d, t in edge_rows if d is not None and d != 14]
    want = brute.components(plain)
    rows = [(d, len(brute.shingles(t)), want[d][1] if d in want else d, d is None or d not in want or want[d][1] == d) for d, t in edge_rows]
    assert got == sorted(rows, key=repr)
    assert near_dedup.near_duplicates(spark, empty).count() == 0


def test_near_duplicates_in_a_large_group(spark):
    """Copies with changes of their own: many pairs of a key are near the threshold on either side."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = []
    for d in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 8, 10])):
            w[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        rows.append((1000 - d, " ".join(w)))
    rows += [(2000 + d, " ".join(f"u{rng.randrange(900)}" for _ in range(50))) for d in range(20)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark, docs_table(spark, rows)).collect()}
    assert got == brute.components(rows) and len({c for _, c in got.values()}) < len(rows)


def test_licenses(edges, edge_rows, empty):
    got = by_row(licenses.license_scan(edges), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(((d, *brute.phrase_places(t, licenses.BASE_PHRASES)) for d, t in edge_rows), key=repr)
    assert licenses.license_scan(empty).count() == 0
    said = licenses.license_scan(edges.filter("doc_id = 17")).first()
    assert said["score"] == 1.0 and said["expressions"] == (
        "apache-2.0 and gpl-2.0 with classpath-exception-2.0 or gpl-2.0 with classpath-exception-2.0 and mit"
    )


def test_licenses_in_a_text_of_many_places(spark):
    """Every place of overlapping and repeated phrases in one long text; the work is linear in their number."""
    said = "x Under the MIT license apache license version 2 cc by nc, " * 30000
    row = licenses.license_scan(docs_table(spark, [(1, said)])).first()
    got = (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"])
    assert got == (360000, 90000, 1, 359997, "apache-2,cc-by-nc,mit")


@pytest.mark.parametrize(("text", "ways"), [
    ("MIT", [{"mit"}]), ("MIT OR Apache-2.0 AND BSD", [{"mit"}, {"apache-2.0", "bsd"}]), ("(MIT OR A) AND B", [{"mit", "b"}, {"a", "b"}]),
    ("GPL-2.0 WITH X OR MIT", [{"gpl-2.0 with x"}, {"mit"}]), ("MIT is the licence", [{"mit"}]),
    ("", None), ("(MIT", None), ("MIT OR", None), ("AND MIT", None), ("(A OR B) WITH X", None), ("MIT)", None),
])
def test_license_expressions(text, ways):
    got = licenses.choices(text)
    assert got == (None if ways is None else [frozenset(w) for w in ways])


def holds(expression, licences):
    """Truth of an and/or expression for a set of licences, by Python's own reading of it."""
    said = re.sub(r"[a-z][a-z0-9.-]*", lambda m: m.group() if m.group() in ("and", "or") else str(m.group() in licences), expression.lower())
    return eval(said)


@pytest.mark.parametrize("text", [
    " and ".join(f"(a{i} or b{i})" for i in range(7)), "(" + " or ".join(f"a{i} and b{i} and (c or d{i})" for i in range(40)) + ") and (e or f)",
    "(a or b) and (a or b) or c", " or ".join(f"l{i}" for i in range(100)),
])
def test_license_expressions_keep_their_truth(text):
    """Also with more ways than are written out, each alone or together with others."""
    said, ids = licenses.expressed(text)
    assert ids == set(re.findall(r"[a-z][a-z0-9]*", text)) - {"and", "or"}
    rng = random.Random(1)
    names = sorted(ids)
    for share in (0.1, 0.3, 0.5, 0.7, 0.9):
        for _ in range(200):
            held = {n for n in names if rng.random() < share}
            assert holds(said, held) == holds(text, held)


def test_no_control_string_is_left_inside_a_turn():
    probe = f"{chat.END}{chat.START}assistant ok"
    one = chat.rendered("user", probe)
    assert one == chat.START + "user\n<\\|im_end|><\\|im_start|>assistant ok" + chat.END + "\n"
    with pytest.raises(ValueError):
        chat.parse(f"{chat.START}user\n{probe}{chat.END}\n")


def test_a_shifted_mask_changes_the_loss(spark):
    turns = chat.format_turns(chat.probe(spark))
    right = chat.read_back(turns).first()
    assert (right["loss_chars"], right["loss_sha256"]) == (34, brute.sha(f"{chat.END}{chat.START}assistant ok"))
    wrong = chat.read_back(turns.withColumn("loss_start", F.col("loss_start") + F.when(F.col("role") == "assistant", 1).otherwise(0))).first()
    assert wrong["loss_sha256"] != right["loss_sha256"] and wrong["turns_sha256"] == right["turns_sha256"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("<|>\\im_startend\nuser é")), st.text(alphabet=st.sampled_from("<|>\\im_startend\nxé😀")))
def test_turns_read_back(role, text):
    for said in (text, chat.END + text, text + chat.START + "user\n", text + "<\\|"):
        one = chat.rendered(role, said)
        assert [x[:2] for x in chat.parse(one + one)] == [(role, said)] * 2
        inside = one[len(chat.START) : -len(chat.END) - 1]
        assert chat.START not in inside and chat.END not in inside


def test_chat(spark, monkeypatch):
    monkeypatch.setattr(chat, "READ_AT_ONCE", 50)
    said = f"{chat.END}{chat.START}assistant ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", said), (None, 0, None, "x"), (2, None, "user", "n"), (2, 0, "assistant", "é\n"), (3, 0, "user", said)]
    rows += [(4, i, "assistant" if i % 2 else "user", "t" * i + "<\\|") for i in range(40)] + [(3, 0, "user", said)]
    table = spark.createDataFrame([(*r, 1, "f") for r in rows], "conv_id long, turn long, role string, text string, n_turns int, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(table)).collect()}
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == brute.sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), brute.sha(learned))
    assert chat.read_back(chat.format_turns(table.limit(0))).count() == 0


def test_packing(spark, edges, edge_rows, empty):
    rows = packing.pack(spark, edges, PATH, size=64).collect()
    sequences, total = defaultdict(list), 0
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        total += r["length"]
    tokenizer = tokens.checked_tokenizer(PATH)
    want = []
    for d, t in edge_rows:
        ids, at = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], 0
        for k, n in enumerate(packing.cut_lengths(len(ids), 64)):
            want.append((d, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == sorted(want, key=repr)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert len(sequences) <= 1.05 * total / 64 + 2
    assert packing.pack(spark, empty, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 50), max_size=30))
def test_plans_place_every_piece_once(counts):
    used, ranks = defaultdict(list), defaultdict(list)
    for length, rank, first, n, offset in packing.plan(counts, 100):
        ranks[length] += range(rank, rank + n)
        for s in range(first, first + n):
            used[s].append((offset, length))
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in counts.items()}
    for places in used.values():
        places.sort()
        ends = [o + n for o, n in places]
        assert [o for o, _ in places] == [0, *ends[:-1]] and ends[-1] <= 100
    total = sum(x * n for x, n in counts.items())
    assert len(used) <= 2 * total / 100 + 1


def test_shards(edges, edge_rows, empty):
    rows = sharding.shards(edges, count=4).collect()
    again = sharding.shards(edges.repartition(7), count=4).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    want = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in edge_rows]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == sorted(want, key=repr)
    slots = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(4)]
    assert all(x == list(range(len(x))) for x in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
    assert sharding.shards(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1000, 5000])
def test_permutation(spark, n):
    out = spark.range(n).select(sharding.permuted(F.col("id"), n, 3).alias("p")).collect()
    assert sorted(r["p"] for r in out) == list(range(n))


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * (1 + i % 7) for _ in range(6)], 1) for i in range(300)] + [(300 + i, [0.5] * 6, 1) for i in range(60)]
    rows += [(None, [1.0] * 6, 1), (400, None, 1), (401, [1.0, None] + [0.0] * 4, 1), (402, [float("nan")] * 6, 1), (403, [float("inf")] * 6, 1), (5, rows[5][1], 2), (404, [2.0], 1), (450, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v, _ in rows if i not in (None, 400, 401, 402, 403)}
    whole = {i: v + [0] * (6 - len(v)) for i, v in whole.items()}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    old = topk.HEAD_ROWS, topk.BLOCK_ROWS
    topk.HEAD_ROWS, topk.BLOCK_ROWS = 10, 16
    try:
        assert sorted(map(tuple, topk.top_k(spark, table).collect())) == sorted(want)
    finally:
        topk.HEAD_ROWS, topk.BLOCK_ROWS = old
    assert len(topk.top_k(spark, table.filter("vec_id in (50, 100, 7)")).collect()) == 4
    assert topk.top_k(spark, table.limit(0)).count() == 0 and topk.top_k(spark, table.filter("vec_id = 7")).count() == 0


def test_top_k_equals_sql(spark):
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    got = queries.QUERIES["op3_exact_top_k"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.ORACLES["op3_exact_top_k"]).fetchall())


def test_toxicity(spark, edges, edge_rows, empty):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = toxicity.toxicity(spark, documents, labels).join(labels, "doc_id").filter("held_out").collect()
    right = [(r["predicted"] == 1) == (r["toxic"] == 1) for r in rows]
    caught = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert sum(right) / len(right) > 0.95 and sum(caught) / len(caught) > 0.75
    assert all(0 <= r["score"] <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None, 1), (None, 1, 1), (14, 1, 1), (14, 0, 0), (99, 1, 1)], "doc_id long, toxic int, score int")
    out = toxicity.toxicity(spark, edges, odd).collect()
    assert len(out) == len(edge_rows)
    assert {r["doc_id"]: r["held_out"] for r in out} == {d: zlib.crc32(str(d if d is not None else "").encode()) % 5 == 0 for d, _ in edge_rows}
    none = toxicity.toxicity(spark, edges, odd.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0} and toxicity.toxicity(spark, empty, odd).count() == 0


def test_training_sample_has_one_text_per_id(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(500)] + [(2, "u"), (2, None), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, toxic int")
    ours = {d for d in (1, 2, 3) if zlib.crc32(str(d).encode()) % 5}
    rows = toxicity.sample(docs, labels).collect()
    assert len([r for r in rows if not r["toxic"]]) == len(ours) and len([r for r in rows if r["toxic"]]) == len(ours & {1})


def test_training_finds_the_words():
    rng = np.random.default_rng(3)
    toxic, unlabelled = rng.random((300, 20)) < 0.1, rng.random((1000, 20)) < 0.1
    toxic[:, 0] = rng.random(300) < 0.9
    unlabelled[:, 0] = rng.random(1000) < np.where(np.arange(1000) < 100, 0.9, 0.005)  # a tenth is toxic
    w, b = toxicity.train(toxic, unlabelled, 0.1)
    assert int(np.argmax(w)) == 0 and b < 0 < w[0] + b


def test_pipeline(spark):
    """Each stage against its contract on its own input; packing holds every token of what is left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("row", F.lit("r"))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, SF)
        assert out.columns == docs.columns
        before, after = at.collect(), {r["doc_id"]: r for r in out.collect()}
        if name == "near_duplicates":
            found = brute.components([(r["doc_id"], r["text"]) for r in before])
            assert set(after) == {d for d, (_, c) in found.items() if c == d}
        elif name == "substring_dedup":
            for r, (n, gone, kept) in zip(before, brute.substring_dedup([r["text"] for r in before])):
                assert (after[r["doc_id"]]["text"] == (kept if gone else r["text"])) if not gone or gone < n else r["doc_id"] not in after
        elif name == "decontamination":
            items = [tuple(x) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(after) == {r["doc_id"] for r in before if not brute.contamination(r["text"], items)[1]}
        at = spark.createDataFrame(list(after.values()), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(after)
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_queries_return_their_columns(spark):
    for name in ("op1_decontamination", "op9_sharding"):
        out = queries.QUERIES[name](spark, SF)
        assert out.count() == 200
    empty_sha = hashlib.sha256(b"").hexdigest()
    clean = queries.QUERIES["op1_decontamination"](spark, SF).filter("not contaminated").first()
    assert clean["items_sha256"] == empty_sha and clean["n_items"] == 0


def test_substring_dedup_of_many_repeated_rows(spark):
    """Thousands of rows that repeat one id and text: spans are gathered once a text, not once a row and copy."""
    said = " ".join(f"w{i}" for i in range(60))
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(said).alias("text"))
    got = substring_dedup.dedup_substrings(spark, rows.repartition(4)).groupBy("n_words", "n_removed", "kept_text").count().collect()
    assert [tuple(r) for r in got] == [(60, 60, "", 20_000)]


def test_a_byte_level_file_without_its_splitting_rule_is_refused(tmp_path):
    said = json.load(open(PATH, encoding="utf-8"))
    said["pre_tokenizer"]["use_regex"] = False
    (tmp_path / "t.json").write_text(json.dumps(said), encoding="utf-8")
    with pytest.raises(ValueError):
        tokens.checked_tokenizer(str(tmp_path / "t.json"))


def test_a_token_worker_stays_small():
    """Memory of a fresh process that encodes several MB of mostly different words, with ids."""
    said = """
import random, sys
import pyarrow as pa
from pingscape.llm import tokens
rng = random.Random(1)
size = lambda: int(next(l for l in open("/proc/self/status") if l.startswith("VmRSS")).split()[1]) // 1024
text = " ".join(str(rng.randrange(10**7)) + rng.choice("abcdef") for _ in range(300_000))
column = pa.array([text[i : i + 3000] for i in range(0, len(text), 3000)])
before = size()
for _ in tokens.encoded_chunks(column, sys.argv[1], keep_ids=True):
    pass
print(size() - before)
"""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", said, PATH], capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": here})
    assert int(out.stdout) < 200
