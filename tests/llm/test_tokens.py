from __future__ import annotations

import random
import unicodedata

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import canonical, encode, packing
from codeloom.llm.bpe import Encoder, vocabulary_path

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RAW = open(vocabulary_path(), "rb").read()
OWN = Encoder(RAW)
REF = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=OWN.ranks, special_tokens={})
HARD = ["it's we're I'll 'sure ''s 's\n's x'd", "  \n\n  y \t z  ", " '", "'", "'l", "x'l", " ", " a", "\n\na", "<|endoftext|>", "　ｙ ０１２", "aaaa" * 2000, "1234567890" * 50, "é́​x", "\r\n\r\n", "a'S B'Re", "🚚👍🏽", "x" + " " * 50 + "y", "\x1c\x1d a"]


def test_encoder_equals_reference():
    ids, first = OWN.encode([*HARD, ""])
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [REF.encode_ordinary(t) for t in [*HARD, ""]]
    assert OWN.count(HARD).tolist() == [len(REF.encode_ordinary(t)) for t in HARD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'srtvemdl1é漢-"), st.characters(exclude_categories=["Cs"]))), max_size=5))
def test_encoder_on_any_text(texts):
    ids, first = OWN.encode(texts)
    got = [ids[a:b].tolist() for a, b in zip(first, first[1:])]
    for t, g in zip(texts, got):
        assert OWN.decode(g) == t.encode()
        if all(unicodedata.category(c) != "Cn" for c in t):
            assert g == REF.encode_ordinary(t)


def test_encode_table(spark):
    df = spark.createDataFrame([(1, HARD[0], "x"), (2, None, "x"), (3, "", "x"), (1, HARD[0], "x"), (4, "é x", "x")], "doc_id long, text string, ids string")
    rows = encode.encode(df.repartition(2), offsets=True).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in rows) == sorted([(1, len(REF.encode_ordinary(HARD[0])))] * 2 + [(2, 0), (3, 0), (4, len(REF.encode_ordinary("é x")))])
    for r in rows:
        text = {1: HARD[0], 4: "é x"}.get(r.doc_id, "").encode()
        cuts = [*r.starts, len(text)]
        assert [text[a:b] for a, b in zip(cuts, cuts[1:])] == [OWN.decode([i]) for i in r.ids]
    assert encode.encode(df.limit(0)).collect() == []


def test_packing(spark):
    rnd = random.Random(3)
    sizes = [(i, rnd.choice([0, 1, 5, rnd.randrange(400), 1500])) for i in range(500)] + [(500, 4096), (501, 1000)]
    packed = packing.pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long"), capacity=1000).collect()
    whole, load = {}, {}
    for r in packed:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.n_tokens
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
    assert whole == dict(sizes) and max(load.values()) <= 1000
    parts = {i: sum(r.doc_id == i for r in packed) for i, _ in sizes}
    assert all(parts[i] == max(1, -(-n // 1000)) for i, n in sizes)
    assert sum(load.values()) / (1000 * len(load)) > 0.95
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).collect() == []


def canon(text):
    return unicodedata.normalize("NFC", "".join(map(canonical.fold, text)))


PAIRS = [
    ("plain text", "ｐｌａｉｎ　ｔｅｘｔ"), ("café", "café"), ("file", "ﬁle"), ("a b", "a b"), ("a-b", "a‑b"), ("paypal", "pаypаl"), ("word", "wo​rd"), ("ấ", "ấ"), ("ạ̈", "ạ̈"),
    ("ёл", "ёл"), ("한", "한"), ("x\ny", "x\n﻿y"), ("ế", "ế"),
]
APART = ["A b", "a  b", "a\tb", "x²", "x2", "ﬀx", "a–b", "½", "①", "1", "привет", "PLAIN TEXT", "x\r\ny", "к", "k"]


def test_canonical_table(spark):
    rows, want = [], {}
    for k, t in enumerate([t for p in PAIRS for t in p] + APART + [PAIRS[0][0], "", "漢字" * 3000]):
        rows.append((k, t))
        want[k] = canon(t)
    df = spark.createDataFrame([*rows, (900, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in canonical.p10_canonical(df).collect()}
    assert got == want | {900: None}
    raw = dict(rows)
    brute = {(a, b) for a in raw for b in raw if a < b and raw[a] and raw[b] and raw[a] != raw[b] and want[a] == want[b]}
    assert {(2 * i, 2 * i + 1) for i in range(len(PAIRS))} <= brute
    assert {tuple(r) for r in canonical.p10_found(df).collect()} == brute
    of = {r.doc_id: (r.class_id, r.variant_id, r.n_links) for r in canonical.p10_classes(df).collect()}
    like = lambda x: [y for y in raw if raw[y] and want[x] == want[y]]
    assert of == {x: (min(like(x)), min(y for y in like(x) if raw[y] == raw[x]), sum(raw[y] != raw[x] for y in like(x))) for p in brute for x in p}
    assert canonical.p10_found(df.limit(0)).collect() == []


def test_repeated_rows_give_no_pair_with_themselves(spark):
    assert len(canonical.p10_canonical(spark.createDataFrame([(1, "é")] * 3 + [(2, "e")] * 2, "doc_id long, text string")).collect()) == 5
    df = spark.createDataFrame([(1, "a​b"), (1, "a​b"), (2, "ab"), (3, "ab")], "doc_id long, text string")
    assert {tuple(r) for r in canonical.p10_found(df).collect()} == {(1, 2), (1, 3)}
